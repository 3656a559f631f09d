"""Glossary terms in texts: where they occur (J5), which are missing from a
translation (J6), replacing them (F3, T2), and their short forms (J7).

A term with kana or Han characters counts wherever it stands; any other only as
a whole word or phrase, in English whatever the case. Texts meet terms by a
join on the term's first word (or first kana or Han character), so no text is
compared with terms that it can't hold; the containment check follows on the hits
only. Where the terms are few (``HEADS`` at most, which is checked) each text is
first reduced to the first words it has, in its own row, and the
terms are broadcast; beyond, all words of the texts take part in the join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most terms whose first words are put into the plan; most terms that are replaced
#: by a chain of expressions of their own.
HEADS, CHAIN = 5_000, 64
CJK = "[぀-ヿ㐀-鿿]"
#: Fixed values of the operator J7: words that are no short form of a name.
NO_ALIAS = ("big", "black", "little", "new", "old", "the", "white", "young")


def is_cjk(term: Column) -> Column:
    return F.regexp_like(term, F.lit(CJK))


def pattern_of(term: Column, ignore_case: Column) -> Column:
    """The pattern of a whole word or phrase."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.when(ignore_case, F.lit("(?iuU)")).otherwise(F.lit("(?U)")), F.lit(r"(?<!\w)"), quoted, F.lit(r"(?!\w)"))


def occurs(text: Column, term: Column, ignore_case: Column) -> Column:
    return F.when(is_cjk(term), F.contains(text, term)).otherwise(F.regexp_like(text, pattern_of(term, ignore_case)))


def _words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_distinct(F.concat(words, F.regexp_extract_all(text, F.lit(CJK), F.lit(0))))


def _head(term: Column) -> Column:
    first = lambda column, pattern: F.coalesce(F.get(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), F.lit(0)), F.lit(""))
    return F.when(is_cjk(term), first(term, CJK)).otherwise(first(F.lower(term), r"(?U)\w+"))


def term_hits(texts: DataFrame, terms: DataFrame, key: str = "id", text: str = "text", only: Column | None = None) -> DataFrame:
    """The rows of ``texts`` with each term that occurs in ``text``, as a
    column ``term`` (its id, source, target, lang, target_lang). ``terms`` has
    these columns and ``disabled``; disabled terms count nothing, nor do blank
    ones and ones without a letter or digit. Null texts have no term. ``only``
    says, of texts and terms, which pairs count; no other is looked at."""
    names = ("id", "source", "target", "lang", "target_lang")
    live = terms.where("NOT disabled AND trim(source) <> ''").select(_head(F.col("source")).alias("head"), F.struct(*names).alias("term")).where("head <> ''")
    few = live.limit(HEADS + 1).count() <= HEADS  # terms, as many may begin with one word
    words = _words(F.col(text))
    if few:
        words = F.array_intersect(words, F.array(*(F.lit(r["head"]) for r in live.select("head").distinct().collect())).cast("array<string>"))
    found = texts.where(F.col(text).isNotNull()).withColumn("head", F.explode(words))
    hits = found.join(F.broadcast(live) if few else live, "head")
    hits = hits if only is None else hits.where(only)
    return hits.where(occurs(F.col(text), F.col("term.source"), F.col("term.lang") == "en")).drop("head")


def missing_terms(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term) where a term of the pair's languages occurs in the source
    and its target, in whatever case, not in the translation."""
    own = (F.col("term.lang") == F.col("source_lang")) & (F.col("term.target_lang") == F.col("target_lang")) & (F.trim("term.target") != "")
    hits = term_hits(pairs.where("source IS NOT NULL"), terms, text="source", only=own)
    return hits.where(~F.contains(F.lower(F.coalesce("translated", F.lit(""))), F.lower("term.target"))).select("id", F.col("term.id").alias("term"))


def mapping(terms: DataFrame, lang: str, target_lang: str) -> list[tuple[str, str]]:
    """(source, target) of a language pair, the newest of each source,
    longest sources first. A glossary is kept by hand and bounded so."""
    own = terms.where((F.col("lang") == lang) & (F.col("target_lang") == target_lang) & ~F.col("disabled") & (F.col("source") != ""))
    last = own.groupBy("source").agg(F.max_by("target", "id").alias("target"), F.min("id").alias("id"))
    return [(r["source"], r["target"]) for r in last.orderBy(F.desc(F.length("source")), "id").collect()]


def replaced(text: Column, pairs: list[tuple[str, str]], lang: str) -> Column:
    """the text with all terms replaced, one after the other."""
    if len(pairs) > CHAIN:
        rows = F.array(*(F.struct(F.lit(a).alias("s"), F.lit(b).alias("t")) for a, b in pairs))
        safe = lambda t: F.regexp_replace(t, F.lit(r"([\\$])"), F.lit(r"\\$1"))
        step = lambda acc, r: F.when(is_cjk(r["s"]), F.replace(acc, r["s"], r["t"])).otherwise(F.regexp_replace(acc, pattern_of(r["s"], F.lit(lang == "en")), safe(r["t"])))
        return F.aggregate(rows, text, step)
    for source, target in pairs:
        if re.search(CJK, source):
            text = F.replace(text, F.lit(source), F.lit(target))
        else:
            quoted = r"\Q" + source.replace(r"\E", r"\E\\E\Q") + r"\E"
            text = F.regexp_replace(text, ("(?iuU)" if lang == "en" else "(?U)") + rf"(?<!\w){quoted}(?!\w)", re.sub(r"([\\$])", r"\\\1", target))
    return text


def alias_hits(texts: DataFrame, terms: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, alias, target): the first or last word of a term of two words or
    more that occurs beside the term itself, unless it is a term of its own."""
    live = terms.where("NOT disabled AND lang = 'en'")
    words = F.regexp_extract_all("source", F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0))
    full = live.withColumn("words", words).where(F.size("words") >= 2).select("id", "source", "target", "lang", "target_lang", F.explode(F.array_distinct(F.array(F.element_at("words", 1), F.element_at("words", -1)))).alias("alias"))
    full = full.where((F.length("alias") >= 3) & ~F.lower("alias").isin(*NO_ALIAS))
    full = full.join(live.select(F.col("source").alias("alias")).distinct(), "alias", "left_anti")
    # the full term travels as the alias's note
    as_terms = full.select("id", F.col("alias").alias("source"), F.struct("target", "source").alias("target"), "lang", "target_lang", F.lit(False).alias("disabled"))
    hits = term_hits(texts, as_terms, key, text)
    yes = F.lit(True)
    rest = F.regexp_replace(F.col(text), pattern_of(F.col("term.target.source"), yes), F.lit(" "))
    hits = hits.where(F.regexp_like(rest, pattern_of(F.col("term.source"), yes)))
    return hits.groupBy(key, F.col("term.source").alias("alias")).agg(F.min_by("term.target.target", "term.id").alias("target"))


def _sql_is(term: str) -> str:
    return f"regexp_matches({term}, '{CJK}')"


def _sql_occurs(text: str, term: str, lang: str) -> str:
    """Containment for an engine without lookaround."""
    edge = "[^\\pL\\pN_]"
    body = f"'(^|{edge})' || regexp_escape({term}) || '($|{edge})'"
    return f"(CASE WHEN {_sql_is(term)} THEN contains({text}, {term}) WHEN {lang} = 'en' THEN regexp_matches({text}, '(?i)' || {body}) ELSE regexp_matches({text}, {body}) END)"


_LIVE = "t.disabled = false AND trim(t.source) <> ''"
#: SQL that compares every text with every term, for tables of test size.
MATCHES = f"SELECT d.doc_id, t.id AS term FROM documents d JOIN terms t ON {_LIVE} AND {_sql_occurs('d.text', 't.source', 't.lang')}"
MATCHES_CJK = f"SELECT s.id, t.id AS term FROM samples s JOIN terms t ON {_LIVE} AND {_sql_occurs('s.text', 't.source', 't.lang')}"


def missing_sql(pairs: str) -> str:
    return f"""SELECT p.id, t.id AS term FROM {pairs} p JOIN terms t ON {_LIVE} AND t.lang = p.source_lang AND t.target_lang = p.target_lang
  AND trim(t.target) <> '' AND {_sql_occurs('p.source', 't.source', 't.lang')} WHERE NOT contains(lower(coalesce(p.translated, '')), lower(t.target))"""


def replaced_sql(pairs: list[tuple[str, str]], lang: str) -> str:
    """Each term becomes a mark (twice over, as neighbours share their border),
    then the mark its target."""
    edge, mark, text = "[^\\pL\\pN_]", "chr(1)", "text"
    for source, target in pairs:
        q = lambda x: x.replace("'", "''")
        if re.search(CJK, source):
            text = f"replace({text}, '{q(source)}', '{q(target)}')"
        else:
            body = f"'{'(?i)' if lang == 'en' else ''}(^|{edge})' || regexp_escape('{q(source)}') || '($|{edge})'"
            for _ in range(2):
                text = f"regexp_replace({text}, {body}, '\\1' || {mark} || '\\2', 'g')"
            text = f"replace({text}, {mark}, '{q(target)}')"
    return f"SELECT doc_id, md5({text}) AS replaced FROM documents"


ALIASES = f"""
WITH w AS (SELECT id, source, target, regexp_extract_all(source, '[A-Za-z][A-Za-z''-]*') AS words FROM terms WHERE NOT disabled AND lang = 'en'),
a AS (SELECT DISTINCT id, source, target, unnest([words[1], words[len(words)]]) AS alias FROM w WHERE len(words) >= 2),
b AS (SELECT * FROM a WHERE length(alias) >= 3 AND lower(alias) NOT IN {NO_ALIAS} AND alias NOT IN (SELECT source FROM w)),
h AS (
  SELECT d.doc_id, b.alias, b.target, b.id, regexp_replace(regexp_replace(d.text, '(?i)(^|[^\\pL\\pN_])' || regexp_escape(b.source) || '($|[^\\pL\\pN_])', '\\1 \\2', 'g'), '(?i)(^|[^\\pL\\pN_])' || regexp_escape(b.source) || '($|[^\\pL\\pN_])', '\\1 \\2', 'g') AS rest
  FROM documents d, b
)
SELECT doc_id, alias, arg_min(target, id) AS target FROM h WHERE {_sql_occurs('rest', 'alias', "'en'")} GROUP BY doc_id, alias"""
