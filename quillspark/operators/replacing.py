"""Replacing the terms of a glossary of any size in texts.

The rule takes all terms, the longest first, each on the text that the ones
before it left; a replacement can so make a match for a later term. Here a
text meets only terms that it may need: it sends the words it has to the terms,
which are known by their longest word, and gets back those of which it has
every word. They are applied in the row, in the rule's order, and each text that
comes about tells which new words it brought. Texts with new words ask again with
these; the others are done. At the end no term is left that any text on the way could hold, so
the result is the rule's. The glossary is joined, never gathered.

A glossary of up to ``TERMS`` terms and ``CHARS`` characters goes to every task instead,
and each text is done where it is, in one pass (``functions.glossary_pass``):
no text and no term is sent. The join is for larger glossaries.

Terms with kana or Han characters are replaced wherever they stand, others as
whole words, in English whatever the case. Blank sources are no terms. A null text stays
null. Of several targets of a source the newest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.glossary_pass import pass_of
from ..sources.shared import kept
from .terms import CJK, is_cjk, pattern_of

#: The largest glossary that goes to every task; texts that a task works on at once.
TERMS, CHARS, TEXTS = 250_000, 16 << 20, 256
_TERM = "struct<size: int, at: bigint, source: string, target: string, words: array<string>>"


def folded_case(text: Column) -> Column:
    """Equal for texts that differ in case only."""
    return F.lower(F.upper(text))


def parts(text: Column) -> Column:
    """The words of a text and its kana and Han characters, each once."""
    words = F.regexp_extract_all(folded_case(text), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_distinct(F.concat(words, F.regexp_extract_all(text, F.lit(CJK), F.lit(0))))


def glossary_of(terms: DataFrame, lang: str, target_lang: str) -> DataFrame:
    """(head, term): the terms of a language pair under the digest of their longest
    part; one without letters and digits is under that of the empty one."""
    own = terms.where((F.col("lang") == lang) & (F.col("target_lang") == target_lang) & ~F.col("disabled") & (F.col("source") != ""))
    last = own.groupBy("source").agg(F.max_by("target", "id").alias("target"), F.min("id").alias("at"))
    # a term with kana or Han can stand within a word, so only its characters tell
    words = F.when(is_cjk(F.col("source")), F.array_distinct(F.regexp_extract_all("source", F.lit(CJK), F.lit(0)))).otherwise(parts(F.col("source")))
    term = F.struct((-F.length("source")).alias("size"), F.col("at").cast("bigint").alias("at"), "source", "target", words.alias("words"))
    longest = F.coalesce(F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"], F.lit(""))
    return last.select(F.xxhash64(longest).alias("head"), term.alias("term"))


def _applied(text: Column, terms: Column, lang: str) -> Column:
    """struct<text, seen>: all terms on the text in order, and the parts of
    every text on the way that weren't in the one before."""
    safe = lambda t: F.regexp_replace(t, F.lit(r"([\\$])"), F.lit(r"\\$1"))

    def step(acc: Column, t: Column) -> Column:
        new = F.when(is_cjk(t["source"]), F.replace(acc["text"], t["source"], t["target"])).otherwise(F.regexp_replace(acc["text"], pattern_of(t["source"], F.lit(lang == "en")), safe(t["target"])))
        told = F.transform(F.array(new), lambda x: F.struct(x.alias("text"), F.when(x == acc["text"], acc["seen"]).otherwise(F.array_union(acc["seen"], parts(x))).alias("seen")))
        return F.element_at(told, 1)

    return F.aggregate(terms, F.struct(text.alias("text"), F.array().cast("array<string>").alias("seen")), step)


def _told(texts: DataFrame, glossary: DataFrame, lang: str, key: str, text: str) -> DataFrame:
    """(key, replaced) by a glossary that every task has."""
    rows = glossary.select("term.size", "term.at", "term.source", "term.target").collect()
    terms = texts.sparkSession.sparkContext.broadcast([(r["source"], r["target"]) for r in sorted(rows, key=lambda r: (r["size"], r["at"], r["source"]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pass_of(terms.value, lang == "en")
        for b in batches:
            for first in range(0, b.num_rows, TEXTS):
                some = b.slice(first, TEXTS)
                out = [t if t is None else own(t) for t in some.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.string())], [key, "replaced"])

    rows = texts.select(key, F.when(F.col(key).isNotNull(), F.col(text)).alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, replaced string")


def replaced(texts: DataFrame, terms: DataFrame, lang: str, target_lang: str, key: str = "id", text: str = "text", asked: list[int] | None = None) -> DataFrame:
    """(key, replaced) of texts with distinct keys. ``asked`` gets the number of texts that
    asked in each round; where it is given, the glossary is joined, whatever its size."""
    glossary = kept(glossary_of(terms, lang, target_lang), "glossary")
    if asked is None:
        size = glossary.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("term.source") + F.length("term.target")).alias("chars"), F.count_if(F.col("term.target").isNull()).alias("void")).first()
        if size.n <= TERMS and (size.chars or 0) <= CHARS and not size.void:
            return _told(texts, glossary, lang, key, text)
    own = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    done = [own.where("text IS NULL OR key IS NULL").select("key", F.lit(None).cast("string").alias("replaced"))]
    first = F.array_union(parts(F.col("text")), F.array(F.lit("")))
    open_ = own.where("text IS NOT NULL AND key IS NOT NULL").select("key", "text", F.array().cast("array<string>").alias("seen"), F.array().cast(f"array<{_TERM}>").alias("terms"))
    new = first
    while True:
        # digests of words travel, and each text once; its words are found again where it arrives
        sent = open_.select("key", F.explode(F.transform(new, lambda w: F.xxhash64(w))).alias("head"))
        met = sent.join(glossary, "head").groupBy("key").agg(F.collect_list("term").alias("met"))
        row = open_.select("key", "text", "seen", "terms").join(met, "key", "left").withColumn("words", F.array_union(first, "seen"))
        # a term that lacks a word is kept until a replacement brings it
        terms_ = F.array_union("terms", F.coalesce("met", F.array().cast(f"array<{_TERM}>")))
        fit = F.array_sort(F.filter(terms_, lambda t: F.size(F.array_except(t["words"], F.col("words"))) == 0))
        now = row.withColumn("terms", terms_).withColumn("out", _applied(F.col("text"), fit, lang)).withColumn("new", F.array_except("out.seen", "words"))
        # what is done is written as the result alone
        more = F.size("new") > 0
        now = now.select("key", *(F.when(more, c).alias(n) for n, c in (("text", F.col("text")), ("terms", F.col("terms")), ("seen", F.array_union("seen", "out.seen")))), "new", F.when(~more, F.col("out.text")).alias("replaced"))
        now = kept(now, "replaced")
        done.append(now.where(F.size("new") == 0).select("key", "replaced"))
        counts = now.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("new") > 0).alias("left")).first()
        if asked is not None:
            asked.append(counts.n)
        if not counts.left:
            break
        open_, new = now.where(F.size("new") > 0).drop("replaced"), F.col("new")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("key", key)
