"""The recognition cascade over regions with texts; its SQL asks everybody
everything and decides by one CASE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.labels import HAN, KANA, misread_sql
from ..functions.scripts import region_hint, script_counts
from ..operators import cascade
from ..sources.frames import frame

_SHIFT = {"zh": 100, "ja": 400, "en": 250}


def _reading(lang: str) -> Column:
    """What a recogniser of a language would make of the table's texts."""
    text = {"en": F.regexp_replace("text", "[^ -~]", ""), "zh": F.col("text"), "ja": F.translate("text", "aeiou", "アイウエオ")}[lang]
    return F.struct(text.alias("text"), ((F.col("conf") * 7 + F.col("ord") * 131 + _SHIFT[lang]) % 1000).cast("long").alias("conf"))


_CONTEXT = lambda: F.struct(F.concat("text", F.lit("の")).alias("text"), ((F.col("conf") * 3 + F.col("ord") * 17) % 1000).cast("long").alias("conf"))
_RESCUE = lambda: F.struct(F.when(F.col("ord") % 2 == 0, "ナルト").otherwise("abc").alias("text"), F.lit(850).cast("long").alias("conf"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cascade.routed(frame(spark, sf_dir, "turn_regions"), _reading, _CONTEXT(), _RESCUE())
    return out.select("page", "ord", "reason", F.array_join("attempts", ",").alias("attempts"), "lang", "variant", "text", "conf", "engine", "fallback")


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "turn_regions")
    return rows.select("page", "ord", cascade.sufficient(F.col("text"), F.col("conf"), F.col("lang")).alias("sufficient"), cascade.crop_rank(F.col("text"), F.col("conf"), F.col("lang")).alias("rank6"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reading and one of every language, all asked (A.1, T4)."""
    rows = frame(spark, sf_dir, "turn_regions").withColumn("hint", labels.region_hint(F.col("text"), F.lit("ja")))
    rows = rows.join(cascade.page_hints(rows), "page", "left").withColumn("page_hint", F.coalesce("page_hint", F.lit("")))
    first = cascade.candidate(F.lit("mit48"), F.when(F.col("hint.language") == "ja", "ja").otherwise(""), F.lit("mit48"), F.struct("text", "conf"))
    others = [cascade.candidate(F.lit("paddle"), F.lit(lang), F.lit("original"), _reading(lang)) for lang in cascade.LANGUAGES]
    asked = F.array(first, *others)
    best = cascade.chosen(asked, F.when(F.col("text") != "", F.col("hint.language")).otherwise(""), F.col("page_hint"))
    # a row without any text has no best; a filter on the best would work it out once more
    rows = rows.where(F.exists(asked, lambda c: ~labels.blank(c["text"])))
    return rows.withColumn("best", best).select("page", "ord", "best.engine", "best.lang", "best.text", "best.conf")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"q_routed_regions": routed, "q_candidate_sufficient": _crops, "q_candidate_topk": _best}

_ROUTED = f"""
WITH r AS (SELECT *, page * 1000000 + ord * 10 AS id FROM turn_regions),
kinds AS (
  SELECT id, text, 'ja' AS fallback, '' AS l, conf FROM r
  UNION ALL SELECT id + 1, text, 'zh', 'zh', (conf * 7 + ord * 131 + 100) % 1000 FROM r
  UNION ALL SELECT id + 2, translate(text, 'aeiou', 'アイウエオ'), 'ja', 'ja', (conf * 7 + ord * 131 + 400) % 1000 FROM r
  UNION ALL SELECT id + 3, regexp_replace(text, '[^ -~]', '', 'g'), 'en', 'en', (conf * 7 + ord * 131 + 250) % 1000 FROM r
  UNION ALL SELECT id + 4, text || 'の', 'ja', 'ja', (conf * 3 + ord * 17) % 1000 FROM r),
h AS ({region_hint.ansi({"texts": "SELECT id, text, fallback FROM kinds"})}),
z AS ({script_counts.ansi({"texts": "SELECT id, text, fallback FROM kinds WHERE id % 10 = 0"})}),
k AS (SELECT kinds.*, h.language AS hl, h.confidence AS hc FROM kinds JOIN h USING (id)),
strong AS (SELECT id // 1000000 AS page, hl, count(*) AS n FROM k WHERE id % 10 = 0 AND hc >= 650 AND trim(text) <> '' GROUP BY ALL),
hints AS (SELECT page, arg_max(hl, n) AS page_hint FROM strong GROUP BY page HAVING max(n) >= 3 AND max(n) * 5 >= sum(n) * 4),
f AS (SELECT r.*, k.hl, k.hc, coalesce(p.page_hint, '') AS p, k.hl = 'zh' AND z.zh_hints > 0 AND z.meaningful > 1 AS common FROM r JOIN k USING (id) JOIN z USING (id) LEFT JOIN hints p ON p.page = r.page),
routes AS (
  SELECT *, CASE WHEN text <> '' AND hl = 'ja' AND hc >= 550 THEN 'kana' WHEN text <> '' AND NOT regexp_matches(text, '[\\p{{L}}{KANA}{HAN}]') THEN 'symbols' WHEN text <> '' AND hl = 'en' AND hc >= 550 THEN 'latin'
    WHEN text <> '' AND common THEN 'common zh' WHEN text <> '' AND hl = 'zh' AND p = 'zh' THEN 'page zh' WHEN text <> '' AND hl = 'zh' AND p = 'ja' THEN 'page ja' WHEN text <> '' AND hl = 'zh' THEN 'han' ELSE 'unclear' END AS reason FROM f),
asks AS (
  SELECT *, CASE reason WHEN 'kana' THEN [] WHEN 'symbols' THEN [] WHEN 'latin' THEN ['en'] WHEN 'common zh' THEN ['zh'] WHEN 'page zh' THEN ['zh'] WHEN 'page ja' THEN ['ja', 'zh'] WHEN 'han' THEN ['zh', 'ja']
    ELSE list_filter([p, 'ja', CASE WHEN text <> '' THEN hl ELSE '' END, 'zh', 'en', 'ja'], lambda x, i: x IN ('zh', 'ja', 'en') AND NOT list_contains([p, 'ja', CASE WHEN text <> '' THEN hl ELSE '' END, 'zh', 'en', 'ja'][1:i - 1], x)) END AS langs FROM routes),
each AS (SELECT id, len(langs) AS n, reason, unnest(langs) AS l, generate_subscripts(langs, 1) AS i FROM asks),
read AS (SELECT e.*, k.text, k.conf, k.hl, k.hc, trim(k.text) <> '' AND k.conf >= 450 AND (k.hl = e.l OR k.hc < 600) AS enough FROM each e JOIN k ON k.id - k.id % 10 = e.id AND k.id % 10 BETWEEN 1 AND 3 AND k.l = e.l),
stops AS (SELECT id, coalesce(min(CASE WHEN enough AND reason NOT IN ('page ja', 'han') THEN i END), max(n)) AS m FROM read GROUP BY id),
around AS (SELECT id FROM asks WHERE len(langs) > 0 AND p = 'ja' AND direction = 'v' AND conf < 450 AND (y1 - y0) <= 3.2 * greatest(1, x1 - x0)),
cands AS (
  SELECT a.id, 0 AS pos, 'mit48' AS engine, CASE WHEN a.hl = 'ja' THEN 'ja' ELSE '' END AS cl, 'mit48' AS variant, a.text, a.conf, a.hl AS dl, a.hc AS dc FROM asks a WHERE text <> ''
  UNION ALL SELECT read.id, i, 'paddle', l, 'original', text, conf, hl, hc FROM read JOIN stops USING (id) WHERE i <= m
  UNION ALL SELECT k.id - 4, 100, 'paddle', 'ja', 'vertical-context:original', text, conf, hl, hc FROM k JOIN around ON around.id = k.id - 4 WHERE k.id % 10 = 4),
facts AS (SELECT c.*, a.p, CASE WHEN a.text <> '' THEN a.hl ELSE '' END AS fl, regexp_full_match(regexp_replace(c.text, '[^\\p{{L}}{KANA}{HAN}]', '', 'g'), '[{KANA}{HAN}]+') AND a.p IN ('zh', 'ja') AS han
  FROM cands c JOIN asks a USING (id) WHERE len(a.langs) > 0 AND trim(c.text) <> ''),
langs AS (SELECT *, CASE WHEN dc >= 550 AND dl = p THEN dl WHEN han THEN p WHEN cl = '' THEN p ELSE cl END AS rl FROM facts),
scores AS (SELECT *, 1000 * conf + CASE WHEN dl = rl THEN 220 * dc WHEN dc >= 550 THEN -160000 ELSE 0 END + CASE WHEN fl = rl AND NOT han THEN 80000 ELSE 0 END + CASE WHEN han AND rl = p THEN 60000 ELSE 0 END
    + CASE WHEN p = 'ja' AND dl = 'ja' AND dc >= 550 THEN 220000 ELSE 0 END - CASE WHEN p = 'ja' AND dl = 'en' AND regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '[A-Za-z][A-Za-z][A-Za-z]') THEN 550000 ELSE 0 END AS score FROM langs),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, length(text) DESC, pos) AS rn FROM scores) WHERE rn = 1),
done AS (
  SELECT a.id, a.page, a.ord, a.reason, 'mit48' || coalesce((SELECT string_agg(',paddle:' || l, '' ORDER BY i) FROM read JOIN stops USING (id) WHERE read.id = a.id AND i <= m), '') || CASE WHEN o.id IS NOT NULL THEN ',paddle:ja-context' ELSE '' END AS attempts,
    len(a.langs) = 0 AS accepted, len(a.langs) > 0 AND b.id IS NULL AS none, a.p,
    CASE WHEN a.reason = 'kana' OR b.rl IS NULL OR b.rl = '' THEN 'ja' ELSE b.rl END AS lang, CASE WHEN len(a.langs) = 0 THEN a.text ELSE coalesce(b.text, '') END AS text, CASE WHEN len(a.langs) = 0 THEN a.conf ELSE coalesce(b.conf, 0) END AS conf,
    CASE WHEN len(a.langs) = 0 THEN 'mit48' ELSE coalesce(b.engine, '') END AS engine, CASE WHEN len(a.langs) = 0 THEN 'mit48' ELSE coalesce(b.variant, '') END AS variant
  FROM asks a LEFT JOIN best b USING (id) LEFT JOIN around o USING (id)),
review AS (SELECT *, NOT accepted AND NOT none AND lang = 'ja' AND ({misread_sql('text', 'conf', 'p')}) AND ord % 2 = 0 AS taken FROM done)
SELECT page, ord, reason, attempts, lang, variant, CASE WHEN taken THEN 'ナルト' ELSE text END AS text, CAST(CASE WHEN taken THEN 850 ELSE conf END AS BIGINT) AS conf, CASE WHEN taken THEN 'mangaocr' ELSE engine END AS engine,
  (NOT accepted AND NOT none AND (engine <> 'mit48' OR conf < 450)) OR taken AS fallback FROM review"""
#: As the routes, with every candidate asked.
_EVERY = _ROUTED[: _ROUTED.index("routes AS (")] + """asks AS (SELECT *, [1] AS langs FROM f),
cands AS (
  SELECT a.id, 0 AS pos, 'mit48' AS engine, CASE WHEN a.hl = 'ja' THEN 'ja' ELSE '' END AS cl, 'mit48' AS variant, a.text, a.conf, a.hl AS dl, a.hc AS dc FROM asks a
  UNION ALL SELECT k.id - k.id % 10, k.id % 10, 'paddle', l, 'original', text, conf, hl, hc FROM k WHERE k.id % 10 BETWEEN 1 AND 3),
""".replace("k.id % 10, 'paddle'", "CASE l WHEN 'zh' THEN 1 WHEN 'ja' THEN 2 ELSE 3 END, 'paddle'") + _ROUTED[_ROUTED.index("facts AS (") : _ROUTED.index("done AS (")].rstrip().rstrip(",") + " SELECT id // 1000000 AS page, CAST(id % 1000000 // 10 AS INT) AS ord, engine, rl AS lang, text, CAST(conf AS BIGINT) AS conf FROM best"
_HINTS = region_hint.ansi({"texts": "SELECT page * 100000 + ord AS id, text, lang AS fallback FROM turn_regions"})
ORACLES: dict[str, tuple[tuple[str, ...], str]] = {
    "q_routed_regions": (("turn_regions",), _ROUTED),
    "q_candidate_topk": (("turn_regions",), _EVERY),
    "q_candidate_sufficient": (
        ("turn_regions",),
        f"""SELECT page, ord, trim(text) <> '' AND conf >= 450 AND (h.language = r.lang OR h.confidence < 600) AS sufficient,
  CAST(1000 * conf + CASE WHEN h.language = r.lang THEN 100 * h.confidence WHEN h.confidence >= 600 THEN -100000 ELSE 0 END AS BIGINT) AS rank6
  FROM turn_regions r JOIN ({_HINTS}) AS h ON h.id = r.page * 100000 + r.ord""",
    ),
}
