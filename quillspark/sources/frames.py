"""Input frames derived from the driver's tables: page regions with boxes,
task events, files, bubble lines, and short constant relations. Each has a
Spark DataFrame and the same definition as ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..relation import Relation
from .shared import dealt

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(columns: str, *rows: tuple) -> str:
    def lit(x):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


#: Frame -> its definition over the tables (or other frames' definitions).
FRAMES: dict[str, Relation] = {
    # regions: boxes of a page in reading list order, confidence in thousandths
    "regions": Relation("D5", """
SELECT l_orderkey AS page,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag, l_linestatus) AS INT) AS ord,
  l_partkey % 1000 AS x0, l_suppkey * 7 % 800 AS y0,
  l_partkey % 1000 + 20 + 4 * CAST(l_quantity AS BIGINT) AS x1, l_suppkey * 7 % 800 + 15 + l_partkey % 40 AS y1,
  CAST(round(l_discount * 10000) AS BIGINT) AS conf,
  CASE l_returnflag WHEN 'A' THEN 'en' WHEN 'N' THEN 'zh' ELSE 'ja' END AS lang,
  CASE l_linestatus WHEN 'O' THEN 'h' ELSE 'v' END AS direction,
  CASE WHEN l_partkey % 2 = 0 THEN 'mit48' ELSE 'paddle' END AS engine
FROM {lineitem} AS d"""),
    # turn_regions: a page a conversation, a region a sentence; some are blank or punctuation
    # only, some stand in for Japanese and Chinese by exchanged letters
    "turn_regions": Relation("D5", """
SELECT page, ord, turn, text, lang, direction, conf, x0, y0, x0 + CASE WHEN direction = 'h' THEN long_side ELSE short_side END AS x1, y0 + CASE WHEN direction = 'h' THEN short_side ELSE long_side END AS y1
FROM (SELECT page, turn, CAST(row_number() OVER (PARTITION BY page ORDER BY turn, i) AS INT) AS ord, text, CASE page % 4 WHEN 0 THEN 'ja' WHEN 1 THEN 'zh' ELSE 'en' END AS lang, CASE WHEN page % 3 = 0 THEN 'v' ELSE 'h' END AS direction,
    (length(part) * 37 + turn * 101 + i * 59) % 1000 AS conf, (page * 97 + i * 211 + turn * 53) % 900 AS x0, (turn * 140 + i * 35 + page * 11) % 1200 AS y0,
    least(300, 20 + 6 * length(text)) AS long_side, 18 + length(part) * 7 % 25 AS short_side
  FROM (SELECT conv_id AS page, turn, i, part, CASE WHEN (conv_id + turn * 3 + i) % 11 = 0 THEN ' ' WHEN (conv_id + turn + i) % 5 = 0 THEN CASE i % 4 WHEN 0 THEN '！' WHEN 1 THEN '…。' WHEN 2 THEN '!?' ELSE '、' END WHEN conv_id % 4 = 0 AND (turn + i) % 3 = 0 THEN translate(lower(substring(part, 1, 60)), 'abcdefghijklmnopqrstuvwxyz', 'アイウエオかきくけこさしすせそたちつてとなにぬねの漢') WHEN conv_id % 4 < 2 AND (turn + i) % 3 = 1 THEN translate(lower(substring(part, 1, 60)), 'abcdefghijklmnopqrstuvwxyz', '漢字忍者学生先輩世界時間気持東京大阪春夏秋冬山川海空')
        WHEN conv_id % 4 = 1 AND (turn + i) % 3 = 0 THEN translate(lower(substring(part, 1, 60)), 'abcdefghijklmnopqrstuvwxyz', '的了是不我你他她它们这那有在和就都一个没什么可以吗吧') ELSE substring(part, 1, 60) END AS text
    FROM (SELECT conv_id, turn, [[posexplode(split(text, '[.] ')) AS (i, part)||generate_subscripts(regexp_split_to_array(text, '[.] '), 1) - 1 AS i, unnest(regexp_split_to_array(text, '[.] ')) AS part]] FROM {conversations} WHERE text IS NOT NULL AND conv_id IS NOT NULL) AS p) AS t) AS r"""),
    # stacks: two turns a group, their sentences in three columns
    "stacks": Relation("D5", """
SELECT page, turn, turn [[div||//]] 2 AS grp, ord, text, lang, CASE WHEN page % 5 = 0 THEN 'v' ELSE 'h' END AS direction, x0, y0,
  x0 + CASE WHEN page % 5 = 0 THEN 14 + length(text) % 9 ELSE least(300, 40 + 4 * length(text)) END AS x1, y0 + CASE WHEN page % 5 = 0 THEN least(200, 40 + 3 * length(text)) ELSE 20 + length(text) % 9 END AS y1
FROM (SELECT page, turn, ord, text, lang, CASE WHEN page % 5 = 0 THEN 24 ELSE 330 END * (ord % 3) + ord * 13 % 20 AS x0, 45 * (ord [[div||//]] 3) + turn % 3 * 7 AS y0 FROM {turn_regions}) AS s"""),
    "region_texts": Relation("D5", "SELECT page * 100000 + ord AS id, text, lang AS fallback FROM {turn_regions}"),
    # ink of a line: its words, five columns a letter; some words stand far apart
    "ink_marks": Relation("D5", """
SELECT page, ord, CAST(b - n AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (
  SELECT page, ord, 5 * length(word) AS n, sum(5 * length(word) + 4 + CASE WHEN k > 0 AND k % 3 = 0 AND (page + ord) % 2 = 0 THEN 22 + ord % 9 ELSE 0 END) OVER (PARTITION BY page, ord ORDER BY k) - 4 AS b
  FROM (SELECT page, ord, [[posexplode(split(text, ' ')) AS (k, word)||generate_subscripts(string_split(text, ' '), 1) - 1 AS k, unnest(string_split(text, ' ')) AS word]] FROM {turn_regions}) AS w) AS m"""),
    "ink_lines": Relation("D5", """
SELECT r.page, r.ord, r.x0, r.y0, r.x0 + m.w AS x1, r.y0 + 9 + r.ord % 14 AS y1, r.text, 'h' AS direction
FROM {turn_regions} r JOIN (SELECT page, ord, max(b) + 8 AS w FROM {ink_marks} GROUP BY page, ord) AS m ON m.page = r.page AND m.ord = r.ord"""),
    # rules: a dark line in some of the groups of stacks
    "rules": Relation("D5", """
SELECT DISTINCT page, page * 1000 + grp AS sheet, 322 AS x0, grp * 10 AS y0, 325 AS x1, 200 + page % 300 AS y1 FROM {stacks} WHERE (page + grp) % 3 = 0"""),
    # truth and found: regions, and what a detector might make of them
    "truth": Relation("D5", "SELECT page, ord, x0, y0, x1, y1, lang = 'zh' AND (page + ord) % 2 = 0 AS ignore FROM {regions}"),
    "found": Relation("D5", """
SELECT page, ord * 4 + k AS ord, x0 + dx AS x0, y0 + dy AS y0, x1 + dx AS x1, y1 + dy AS y1, (conf * 7 + ord * 131 + k * 57) % 1000 AS conf
FROM (SELECT page, ord, conf, x0, y0, x1, y1, k, (page + ord * 5 + k * 11) % 13 - 6 AS dx, (page * 3 + ord + k * 7) % 9 - 4 AS dy FROM {regions} CROSS JOIN (SELECT [[explode(array(0, 1, 2))||unnest([0, 1, 2])]] AS k) AS s) AS t WHERE (page + ord + k) % 3 <> 0"""),
    # strip: the same boxes on one long page, which is as hot as a page can be
    "strip": Relation("D5", """
SELECT 0 AS page, l_orderkey * 8 + l_linenumber AS ord, l_partkey % 1000 AS x0, l_orderkey * 10 + l_suppkey * 7 % 60 AS y0,
  l_partkey % 1000 + 20 + 4 * CAST(l_quantity AS BIGINT) AS x1, l_orderkey * 10 + l_suppkey * 7 % 60 + 15 + l_partkey % 40 AS y1,
  CASE l_linestatus WHEN 'O' THEN 'h' ELSE 'v' END AS direction
FROM {lineitem}"""),
    # tasks: one per event
    "tasks": Relation("D3", """
SELECT event_id AS id,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'queued' ELSE 'processing' END AS status,
  CAST([[floor(abs(value))||floor(abs(value))]] AS BIGINT) % 101 AS progress, user_id AS batch, ts, props AS meta,
  [[CAST(get_json_object(props, '$.k') AS BIGINT)||CAST(json_extract_string(props, '$.k') AS BIGINT)]] AS k
FROM {events}"""),
    "files": Relation("D15", """
SELECT page_id, coalesce(regexp_extract(coalesce(url, ''), '([^/?#]+)([?#].*)?$', 1), '') AS name, length(html) AS bytes FROM {pages}"""),
    "lines": Relation("D7", "SELECT conv_id AS grp, turn AS ord, role, text FROM {conversations}"),
    "terms": Relation("D1", _values(
        "id, source, target, lang, target_lang, note, disabled",
        (1, "the", "THE-1", "en", "zh", "article", False), (2, "thing", "THING", "en", "zh", "", False), (3, "of the", "OF-THE", "en", "zh", "", False),
        (4, "der", "DER", "de", "zh", "", False), (5, "und", "UND", "de", "zh", "", False), (6, "los", "LOS", "es", "zh", "", True),
        (7, "the", "THE-2", "en", "zh", "newer", False), (8, "the", "THE-JA", "en", "ja", "", False), (9, "erin", "ERIN", "en", "zh", "Name", False),
        (10, "火影", "HOKAGE", "ja", "zh", "", False), (11, "忍者", "NINJA", "ja", "zh", "", False), (12, "and the", "AND-THE", "en", "zh", "", False), (13, "漢字", "KANJI", "ja", "zh", "", False),
    )),
    # a glossary of parts and a log of changes to it; changes stay within fifty groups of parts
    "part_terms": Relation("D1 D2", """
SELECT p_partkey AS id, p_name || ' ' || CAST(p_partkey AS [[STRING||VARCHAR]]) AS source, p_brand AS target, 'en' AS lang, 'zh' AS target_lang, p_type AS note, p_partkey % 3 = 0 AS builtin, p_partkey % 7 = 0 AS disabled,
  p_partkey % 50 AS grp FROM {part}"""),
    "part_changes": Relation("D1 D2", """
SELECT e.seq, e.op, CASE WHEN e.op <> 'create' THEN CASE WHEN e.event_id % 9 = 0 THEN lag(e.seq) OVER (PARTITION BY e.p1 % 50 ORDER BY e.seq) ELSE e.p1 END END AS id, p.p_name || ' ' || CAST(p.p_partkey AS [[STRING||VARCHAR]]) AS source,
  CASE WHEN e.event_id % 3 = 0 THEN 'new' ELSE p.p_brand END AS target, 'en' AS lang, 'zh' AS target_lang, 'change ' || CAST(e.event_id AS [[STRING||VARCHAR]]) AS note, e.p1 % 50 AS grp
FROM (SELECT *, (p1 + 50 * (event_id % 4)) % n AS p2 FROM (
    SELECT event_id, event_id + 1000000000000 AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'disable' ELSE 'create' END AS op, (user_id * 13 + 50 * (event_id % 5)) % n AS p1, n
    FROM {events} CROSS JOIN (SELECT count(*) AS n FROM {part}) AS s) AS a) AS e JOIN {part} p ON p.p_partkey = e.p2"""),
    # a glossary of words and pairs of words that stand in conversations; some targets are words themselves
    "word_terms": Relation("D1", """
SELECT id, source, target, 'en' AS lang, 'zh' AS target_lang, false AS disabled FROM (
  SELECT conv_id * 100000 + turn * 1000 + i AS id, CASE WHEN i % 2 = 0 THEN w ELSE w || ' ' || coalesce(next, 'x') END AS source, CASE WHEN i % 3 = 0 THEN coalesce(next, w) ELSE '<' || w || '>' END AS target
  FROM (SELECT conv_id, turn, i, w, lead(w) OVER (PARTITION BY conv_id, turn ORDER BY i) AS next FROM (
    SELECT conv_id, turn, [[posexplode(regexp_extract_all(lower(text), '[a-z]+', 0)) AS (i, w)||generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) - 1 AS i, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w]] FROM {conversations} WHERE text IS NOT NULL) AS t) AS n
  WHERE (conv_id * 31 + turn * 7 + i) % 397 = 0) AS g"""),
    "samples": Relation("D12", _values(
        "id, text, fallback",
        (1, "", "ja"), (2, "123 !?", "zh"), (3, "これはペンです", "zh"), (4, "漢字漢字", "ja"), (5, "这是我们的东西", "ja"), (6, "Hello there", "ja"),
        (7, "OK", "zh"), (8, "カ漢字漢字漢字漢字漢字漢字漢字", "zh"), (9, "A漢字の本", "zh"), (10, "Ωmega", "ja"), (11, "ABC漢", "ja"), (12, "気持の方", "zh"),
        (13, "ab c", "ja"), (14, None, "en"), (15, "ナルト", "ja"), (16, "WOW！すごい", "en"), (17, "xyz1", "ja"),
    )),
    "pairs": Relation("D5", _values(
        "id, source, translated, source_lang, target_lang, backend",
        (1, "10 kg of rice", "十公斤大米", "en", "zh", "deepl"), (2, "10 kg of rice", "10 公斤大米", "en", "zh", "google"), (3, "これはペンです", "これはペンです", "ja", "zh", "deepl"),
        (4, "これはとても長い文章ですよね本当に", "是", "ja", "zh", "deepl"), (5, "Look at that man", "Look at that man", "en", "zh", "deepl"), (6, "100% sure", "百分百确定", "en", "zh", "deepl"),
        (7, "你好世界", "你好世界了", "zh", "en", "deepl"), (8, "你好世界", "漢字漢字漢字", "zh", "ja", "deepl"), (9, "Hello", "", "en", "zh", "original"),
        (10, "Run away now", "**快跑**", "en", "zh", "deepl"), (11, "Naruto Uzumaki", "鸣人", "en", "zh", "deepl"), (12, "the thing", "东西", "en", "zh", "deepl"),
        (13, "Price: $5", "Translation: 价格 5", "en", "zh", "openai"), (14, "火影は強い", "HOKAGE很强", "ja", "zh", "deepl"),
    )),
    "doc_texts": Relation("D5", "SELECT doc_id AS id, text, 'ja' AS fallback FROM {documents}"),
    # whole tables in the shape of the short constant relations
    "page_names": Relation("D15", "SELECT page_id AS id, coalesce(regexp_extract(coalesce(url, ''), '([^/?#]+)([?#].*)?$', 1), '') AS name FROM {pages}"),
    "page_colours": Relation("D5", "SELECT page_id AS id, coalesce(regexp_extract(html, '#[0-9a-zA-Z]+', 0), '') AS hex FROM {pages}"),
    # a document's stand-in for a translation is the next document
    "doc_pairs": Relation("D5", """
SELECT d.doc_id AS id, d.text AS source, coalesce(n.text, '') AS translated, d.lang AS source_lang, 'zh' AS target_lang, d.source AS backend
FROM {documents} d LEFT JOIN {documents} n ON d.doc_id + 1 = n.doc_id"""),
    "turn_backends": Relation("D18", "SELECT conv_id AS id, turn AS rank, role AS backend, text AS result FROM {conversations}"),
    "kv": Relation("D4", _values("key, value", ("seeded", "1"), ("schema", "3"), ("theme", "dark"))),
    "kv_new": Relation("D4", _values("key, value", ("schema", "4"), ("lang", "ja"))),
    # stored values of customers, and newer ones from events
    "kv_users": Relation("D4", "SELECT CAST(c_custkey AS [[STRING||VARCHAR]]) AS key, c_mktsegment AS value FROM {customer}"),
    "kv_events": Relation("D4", """
SELECT CAST(user_id AS [[STRING||VARCHAR]]) AS key, [[max_by(event_type, struct(ts, event_id))||arg_max(event_type, (ts, event_id))]] AS value FROM {events} GROUP BY user_id"""),
    "page_sizes": Relation("D15", "SELECT page_id AS id, CAST(length(html) AS BIGINT) * (1 + page_id % 5 * 700) AS n FROM {pages} WHERE html IS NOT NULL"),
    # a recogniser's texts, with fewer scores than texts
    "turn_raw": Relation("D6", """
SELECT conv_id * 1000 + turn AS id, [[split(text, '[.] ')||regexp_split_to_array(text, '[.] ')]] AS texts,
  [[transform(slice(split(text, '[.] '), 1, 2), x -> length(x) / 100D)||list_transform(regexp_split_to_array(text, '[.] ')[1:2], lambda x: length(x) / 100::DOUBLE)]] AS scores FROM {conversations} WHERE text IS NOT NULL"""),
    "backends": Relation("D18", _values(
        "id, rank, backend, result",
        (1, 1, "deepl", ""), (1, 2, "google", "hello"), (1, 3, "mymemory", "hi"), (2, 1, "deepl", None), (2, 2, "google", "  "), (2, 3, "mymemory", ""),
        (3, 1, "deepl", "ok"), (3, 2, "google", "fine"), (4, 2, "google", "late"), (4, 1, "deepl", None),
    )),
    "imports": Relation("D16", _values(
        "doc, content",
        ("ok", '[{"source":"a","target":"b"},{"source":"c","target":"d","lang":"en","note":"n"}]'), ("bad", "not json"), ("object", '{"source":"a"}'),
        ("mixed", '[{"source":"a","target":"b"},{"source":"","target":"x"},5,{"source":"q"},{"source":"a","target":"b"}]'), ("empty", "[]"),
    )),
    "names": Relation("D15", _values(
        "id, name",
        (1, "page10.png"), (2, "page2.png"), (3, "Page 1.JPG"), (4, "a/b/c:d?.webp"), (5, "noext"), (6, "x.tar.gz"), (7, "ch2/p1.png"), (8, "ch10/p1.png"), (9, "ch2/p01.png"), (10, "photo.jpeg"),
    )),
    "colours": Relation("D5", _values("id, hex", (1, "#FF8000"), (2, "#000000"), (3, "#ffffff"), (4, "red"), (5, "#12345"), (6, "#0a1B2c"))),
    "sizes": Relation("D15", _values("id, n", *((i, n) for i, n in enumerate((0, 1, 999, 1000, 1023, 1024, 1536, 1075, 9999, 10189, 10240, 59_950, 1048575, 1048576, 1310720, 10485760, 1073741823, 1073741824, 1610612736, 107374182400))))),
    "rawocr": Relation("D6", """
SELECT id, texts, scores FROM (
  SELECT 1 AS id, [[array('a', ' ', 'c')||['a', ' ', 'c']]] AS texts, [[array(0.9D, 0.8D)||[0.9::DOUBLE, 0.8::DOUBLE]]] AS scores
  UNION ALL SELECT 2, [[array('x')||['x']]], [[array(0.5D)||[0.5::DOUBLE]]]
  UNION ALL SELECT 3, [[array('', 'y', 'z')||['', 'y', 'z']]], [[CAST(array() AS ARRAY<DOUBLE>)||CAST([] AS DOUBLE[])]]) AS r"""),
}


#: Frames that number the rows of a page: by what their tables are dealt out, and the megabytes of a partition.
DEALT = {"regions": {"lineitem": ("l_orderkey", 4)}, "turn_regions": {"conversations": ("conv_id", 1)}}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input frame, or a table of the driver."""
    if name in FRAMES:
        own = FRAMES[name]
        rows = {n: frame(spark, sf_dir, n) for n in own.frames}
        return own(spark, **rows | {n: dealt(rows[n], [key], size) for n, (key, size) in DEALT.get(name, {}).items()})
    return table(spark, sf_dir, name)


def tables_of(name: str) -> set[str]:
    """The driver's tables that a frame is made of."""
    return set().union(*map(tables_of, FRAMES[name].frames)) if name in FRAMES else {name}


def ansi_sources() -> dict[str, str]:
    """Each frame's query; a frame that is made of others has them as CTEs."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in out and name in FRAMES:
            for other in FRAMES[name].frames:
                add(other)
            out[name] = FRAMES[name].ansi(out)

    for name in FRAMES:
        add(name)
    return out
