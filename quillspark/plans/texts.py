"""Queries over recognised texts and pages of regions, with SQL of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, quality
from ..functions.scripts import region_hint
from ..operators import pages, replacing
from ..sources.frames import FRAMES, frame

Query = Callable[[SparkSession, str], DataFrame]


def _columns(name: str, *keys: str, **columns: Callable[[], Column]) -> Query:
    return lambda spark, sf_dir: frame(spark, sf_dir, name).select(*keys, *(f().alias(c) for c, f in columns.items()))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "turn_regions").withColumn("engine", F.when(F.col("turn") % 2 == 0, "mit48").otherwise("paddle")).withColumn("has_mask", F.col("turn") % 2 == 0)


def _group_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group is a turn's regions; only those to be translated vote."""
    return pages.language_vote(pages.handled(_regions(spark, sf_dir), "fr").where("action = 'translate'"), ["page", "turn"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = frame(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("page"), "turn", F.col("text").alias("block"))
    return pages.distributed_lines(frame(spark, sf_dir, "turn_regions"), turns, ["page", "turn"])


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replacing.replaced(frame(spark, sf_dir, "documents"), frame(spark, sf_dir, "word_terms"), "en", "zh", "doc_id")
    return out.select("doc_id", F.md5("replaced").alias("replaced"))


def _reply() -> Column:
    """A turn as a model might give it back: fenced, with a heading, or quoted."""
    text, kind = F.col("text"), (F.col("conv_id") + F.col("turn")) % 5
    return F.when(kind == 0, F.concat(F.lit("```text\n"), text, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("译文： "), text)).when(kind == 2, F.concat(F.lit('"'), text, F.lit('"'))).when(kind == 3, F.concat(F.lit("  ```\n翻译: “"), text, F.lit("”```"))).otherwise(text)


QUERIES: dict[str, Query] = {
    "q_latin_label_docs": _columns("doc_texts", "id", keep_label=lambda: labels.latin_label(F.col("text"), F.col("fallback"))),
    "q_latin_label_regions": _columns("turn_regions", "page", "ord", keep_label=lambda: labels.latin_label(F.col("text"), F.col("lang"))),
    "q_ocr_garbage_docs": _columns("doc_texts", "id", suspicious=lambda: labels.suspicious_japanese(F.col("text"), F.col("fallback"), F.lit(True)), misread=lambda: labels.misread_japanese(F.col("text"), F.col("id") % 1000, F.lit("ja"))),
    "q_ocr_garbage_regions": _columns(
        "turn_regions", "page", "ord", suspicious=lambda: labels.suspicious_japanese(F.col("text"), F.col("lang"), F.col("conf") < 450), misread=lambda: labels.misread_japanese(F.col("text"), F.col("conf"), F.col("lang"))
    ),
    "q_charclass": lambda spark, sf_dir: frame(spark, sf_dir, "doc_texts").where("text IS NOT NULL").select("id", *(c.alias(k) for k, c in labels.character_counts(F.col("text")).items())),
    "q_charclass_regions": lambda spark, sf_dir: frame(spark, sf_dir, "turn_regions").select("page", "ord", *(c.alias(k) for k, c in labels.character_counts(F.col("text")).items())),
    "q_keep_as_is_regions": _columns("turn_regions", "page", "ord", keep=lambda: labels.kept_as_is(F.col("text"))),
    "q_unwrapped_replies": lambda spark, sf_dir: frame(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.md5(quality.unwrapped(_reply())).alias("unwrapped")),
    "q_word_count": _columns("doc_texts", "id", listed=lambda: F.size(labels.english_words(F.col("text"))), counted=lambda: labels.english_word_count(F.col("text"))),
    "q_name_like_regions": _columns("turn_regions", "page", "ord", name_like=lambda: labels.name_like(labels.english_words(F.col("text")))),
    "q_region_hint_turns": lambda spark, sf_dir: frame(spark, sf_dir, "turn_regions").select("page", "ord", labels.region_hint(F.col("text"), F.col("lang")).alias("h")).select("page", "ord", "h.language", F.col("h.conf").alias("confidence")),
    "q_page_vote_texts": lambda spark, sf_dir: pages.language_vote(frame(spark, sf_dir, "turn_regions"), ["page"]),
    "q_group_language": _group_languages,
    "q_region_actions": lambda spark, sf_dir: pages.handled(_regions(spark, sf_dir)).select("page", "ord", "conf", "action"),
    "q_line_distribution": _lines,
    "q_glossary_replaced": _replaced,
}

_T = "coalesce(text, '')"
_THRESHOLD = "CASE WHEN turn % 2 = 0 AND lang NOT IN ('zh', 'en') THEN {a} WHEN lang IN ('zh', 'en') THEN {b} ELSE 500 END"


def _vote_sql(keys: str, rows: str) -> str:
    return f"""WITH v AS (SELECT * FROM {rows} WHERE trim(text) <> ''),
  t AS (SELECT {keys}, lang, sum(CASE WHEN conf < 50 THEN 50 ELSE conf END) AS w, min(ord) AS f FROM v GROUP BY {keys}, lang),
  r AS (SELECT *, sum(w) OVER (PARTITION BY {keys}) AS total, count(*) OVER (PARTITION BY {keys}) AS n, row_number() OVER (PARTITION BY {keys} ORDER BY w DESC, f) AS rn FROM t),
  k AS (SELECT DISTINCT {keys} FROM {rows})
  SELECT {', '.join('k.' + x for x in keys.split(', '))}, coalesce(lang, 'ja') AS lang, CAST(coalesce(w * 1000 // total, 0) AS BIGINT) AS share,
    CAST(CASE WHEN w IS NULL THEN 0 ELSE least(990, greatest(450, w * 1000 // total + 350)) END AS BIGINT) AS confidence, CAST(coalesce(n, 0) AS BIGINT) AS n_langs
  FROM k LEFT JOIN r ON {' AND '.join(f'k.{x} = r.{x}' for x in keys.split(', '))} AND rn = 1"""


def _classes_sql(keys: str, rows: str) -> str:
    """Character by character."""
    count = lambda test: f"CAST(len(list_filter(cs, lambda c: {test})) AS INT)"
    punctuation, space = "(unicode(c) BETWEEN 33 AND 47 OR unicode(c) BETWEEN 58 AND 64 OR unicode(c) BETWEEN 91 AND 96 OR unicode(c) BETWEEN 123 AND 126 OR regexp_full_match(c, '\\p{P}'))", "(unicode(c) IN (0, 9, 10, 13, 32) OR regexp_full_match(c, '\\p{Zs}'))"
    control, digit = "(unicode(c) NOT IN (9, 10, 13) AND regexp_full_match(c, '[\\p{Cc}\\p{Cf}]'))", f"regexp_full_match(c, '{labels.DIGIT}')"
    return f"""SELECT {keys}, {count(punctuation)} AS punctuation, {count(space)} AS blanks, {count(control)} AS controls, {count(digit)} AS digits, {count(f"regexp_full_match(c, '{labels.RIGHT_TO_LEFT}')")} AS right_to_left,
  len(list_filter(cs, lambda c: NOT {punctuation} AND NOT {space} AND NOT {control} AND NOT {digit})) > 0 AS valuable FROM (SELECT {keys}, list_filter(string_split(text, ''), lambda c: c <> '') AS cs FROM {rows}) AS s"""


_HINT = region_hint.ansi({"texts": "SELECT page * 100000 + ord AS id, text, lang AS fallback FROM turn_regions"})
#: Query -> (frames, SQL).
ORACLES: dict[str, tuple[tuple[str, ...], str]] = {
    "q_latin_label_docs": ((), f"SELECT doc_id AS id, {labels.latin_label_sql(_T, chr(39) + 'ja' + chr(39))} AS keep_label FROM documents"),
    "q_latin_label_regions": (("turn_regions",), f"SELECT page, ord, {labels.latin_label_sql(_T, 'lang')} AS keep_label FROM turn_regions"),
    "q_ocr_garbage_docs": ((), f"SELECT doc_id AS id, {labels.suspicious_sql(_T, chr(39) + 'ja' + chr(39), 'true')} AS suspicious, {labels.misread_sql(_T, 'doc_id % 1000', chr(39) + 'ja' + chr(39))} AS misread FROM documents"),
    "q_ocr_garbage_regions": (("turn_regions",), f"SELECT page, ord, {labels.suspicious_sql(_T, 'lang', '(conf < 450)')} AS suspicious, {labels.misread_sql(_T, 'conf', 'lang')} AS misread FROM turn_regions"),
    "q_charclass": ((), _classes_sql("id", "(SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)")),
    "q_charclass_regions": (("turn_regions",), _classes_sql("page, ord", "turn_regions")),
    "q_keep_as_is_regions": (("turn_regions",), f"SELECT page, ord, length(text) > 0 AND translate(text, '{labels.KEPT_SIGNS} ', '') = '' AS keep FROM turn_regions"),
    # the turns' own texts neither begin nor end with a quote, a fence or a heading
    "q_unwrapped_replies": ((), "SELECT conv_id, turn, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS unwrapped FROM conversations WHERE text IS NOT NULL"),
    "q_word_count": ((), f"SELECT doc_id AS id, CAST(len({labels.english_words_sql(_T)}) AS INT) AS listed, CAST(len(regexp_extract_all({_T}, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*')) AS INT) AS counted FROM documents"),
    "q_name_like_regions": (("turn_regions",), f"SELECT page, ord, {labels.name_like_sql(labels.english_words_sql(_T))} AS name_like FROM turn_regions"),
    "q_region_hint_turns": (("turn_regions",), f"SELECT id // 100000 AS page, CAST(id % 100000 AS INT) AS ord, language, confidence FROM ({_HINT}) AS h"),
    "q_page_vote_texts": (("turn_regions",), _vote_sql("page", "turn_regions")),
    "q_group_language": (("turn_regions",), _vote_sql("page, turn", f"(SELECT * FROM turn_regions WHERE trim(text) <> '' AND conf >= {_THRESHOLD.format(a=200, b=550)})")),
    "q_region_actions": (
        ("turn_regions",),
        f"""SELECT page, ord, conf, CASE WHEN lang = 'zh' THEN 'keep' WHEN conf >= {_THRESHOLD.format(a=200, b=550)} AND trim(text) <> '' THEN 'translate'
  WHEN conf >= {_THRESHOLD.format(a=0, b=250)} AND (turn % 2 = 0 OR trim(text) = '') THEN 'erase' ELSE 'keep' END AS action FROM turn_regions""",
    ),
    "q_line_distribution": (
        ("turn_regions",),
        """SELECT r.page, r.turn, r.ord, l[least(row_number() OVER (PARTITION BY r.page, r.turn ORDER BY r.ord), len(l))] AS line
  FROM turn_regions r JOIN (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations) t ON t.conv_id = r.page AND t.turn = r.turn""",
    ),
}
# SQL takes minutes over the rule of q_glossary_replaced; a test takes it in Python
assert set(QUERIES) == {*ORACLES, "q_glossary_replaced"} and all(f in FRAMES for frames, _ in ORACLES.values() for f in frames)
