"""What a page's regions decide together: its language, what is translated or
only erased, and which line of a block goes where (A3, A4, P6, P7, W12).

Confidences are in thousandths. ``ord`` is a region's place on its page; a
region whose text is blank has no vote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import blank

LEAST_WEIGHT = 50


def language_vote(regions: DataFrame, keys: list[str], fallback: str = "ja") -> DataFrame:
    """(*keys, lang, share, confidence, n_langs): the language with most
    confidence behind it, of equal ones the first seen. Two groupings with
    partial sums: no window, and no page is gathered."""
    votes = regions.where(~blank(F.col("text"))).groupBy(*keys, "lang").agg(F.sum(F.greatest(F.lit(LEAST_WEIGHT), F.coalesce("conf", F.lit(0)))).alias("weight"), F.min("ord").alias("first"))
    best = F.max(F.struct("weight", (-F.col("first")).alias("first"), "lang"))
    won = votes.groupBy(*keys).agg(best.alias("best"), F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n_langs"))
    share = F.floor(1000 * F.col("best.weight") / F.col("total"))
    own = won.select(*keys, F.col("best.lang").alias("lang"), share.alias("share"), F.least(F.lit(990), F.greatest(F.lit(450), share + 350)).alias("confidence"), "n_langs")
    none = regions.select(*keys).distinct().join(own, keys, "left_anti").select(*keys, F.lit(fallback).alias("lang"), *(F.lit(0).cast("long").alias(c) for c in ("share", "confidence", "n_langs")))
    return own.unionByName(none)


def thresholds(engine: Column, lang: Column) -> tuple[Column, Column]:
    """P5: the least confidence to translate and to erase."""
    known, sharp = lang.isin("zh", "en"), engine == "mit48"
    return (F.when(sharp & ~known, 200).when(known, 550).otherwise(500), F.when(sharp & ~known, 0).when(known, 250).otherwise(500))


def handled(regions: DataFrame, target: str = "zh") -> DataFrame:
    """The regions with ``action``: translate (sure enough, with a text, of
    another language than the target's), else erase (sure enough for that, and
    with a mask or without a text), else keep (P6, P7)."""
    to_translate, to_erase = thresholds(F.col("engine"), F.col("lang"))
    other, none = F.col("lang") != target, blank(F.col("text"))
    action = F.when(other & (F.col("conf") >= to_translate) & ~none, "translate").when(other & (F.col("conf") >= to_erase) & (F.col("has_mask") | none), "erase").otherwise("keep")
    return regions.withColumn("action", action)


def distributed_lines(members: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, ord, line): a group's block, line by line over its regions in
    order; regions beyond the last line take that one (W12)."""
    places = members.groupBy(*keys).agg(F.sort_array(F.collect_list("ord")).alias("ords"))
    lines = blocks.select(*keys, F.split(F.coalesce("block", F.lit("")), "\n").alias("lines"))
    each = places.join(lines, keys).select(*keys, "lines", F.posexplode("ords").alias("i", "ord"))
    return each.select(*keys, "ord", F.element_at("lines", F.least(F.col("i") + 1, F.size("lines"))).alias("line"))
