"""Splitting a line at a wide gap in its ink, by a sweep over interval ends
(W6, W7, W8, A.9).

``marks`` are intervals [a, b) of columns with ink, from a line's left edge;
they may overlap. Their ends are events, +1 and -1; where the running sum is
over 0 there is ink. Three shifted copies of that, one column apart, give the
smoothing: a column counts if two of itself and its neighbours do. What lies
between is a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dealt


def swept(intervals: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """(*keys, a, b): the stretches, as long as they can be, that ``least`` of
    the intervals cover or more. Empty intervals cover nothing."""
    ends = intervals.where("a < b").select(*keys, F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    line = Window.partitionBy(*keys).orderBy("at")
    depth = F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0))
    # only where the depth passes ``least`` does a stretch begin or end
    levels = steps.select(*keys, "at", (depth >= least).alias("on"))
    turns = levels.withColumn("was", F.coalesce(F.lag("on").over(line), F.lit(False))).where("on <> was")
    return turns.select(*keys, F.col("at").alias("a"), F.lead("at").over(line).alias("b"), "on").where("on").drop("on")


def smoothed(ink: DataFrame, keys: list[str]) -> DataFrame:
    """The stretches of columns of which two in three have ink. ``ink`` are
    stretches that don't touch."""
    near = ink.select(*keys, F.explode(F.array(*(F.struct((F.col("a") + k).alias("a"), (F.col("b") + k).alias("b")) for k in (-1, 0, 1)))).alias("x")).select(*keys, "x.a", "x.b")
    return swept(near, keys, 2)


def _round(x: Column) -> Column:
    """To the nearest, halves to even."""
    return F.bround(x, 0).cast("long")


def split_lines(lines: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, side, x0, y0, x1, y1): two boxes for each line that a wide gap
    parts, one for each other line (side null). Only level lines that are wide,
    flat and have two blanks in their text are parted; the gap keeps clear of the ends,
    and enough ink is left on both sides."""
    lines, marks = dealt(lines, keys, 1), dealt(marks, keys, 1)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    blanks = F.length(F.trim("text")) - F.length(F.replace(F.trim("text"), F.lit(" "), F.lit("")))
    wide = lines.where((F.coalesce("direction", F.lit("h")) == "h") & (w >= 80) & (h >= 8) & (w >= 6 * h) & (blanks >= 2)).select(*keys, w.alias("w"), h.alias("h"))
    inside = marks.join(wide, keys).select(*keys, F.greatest(F.lit(0), "a").alias("a"), F.least("w", "b").alias("b"))
    ink = smoothed(swept(inside, keys), keys).join(wide, keys).select(*keys, "w", "h", F.greatest(F.lit(0), "a").alias("a"), F.least("w", "b").alias("b")).where("a < b")
    line = Window.partitionBy(*keys).orderBy("a")
    margin, least, rest = F.greatest(F.lit(4), _round(F.col("h") * 0.45)), F.greatest(F.lit(8), _round(F.col("h") * 0.55)), F.greatest(F.lit(16), _round(F.col("h") * 1.4))
    gaps = ink.withColumns({"gap0": F.col("b"), "gap1": F.lead("a").over(line), "first": F.min("a").over(Window.partitionBy(*keys)), "last": F.max("b").over(Window.partitionBy(*keys))})
    # the widest, of equal ones the first; the others have no say
    free = gaps.where((F.col("gap0") >= margin) & (F.col("gap1") <= F.col("w") - margin))
    best = free.groupBy(*keys, "w", "h", "first", "last").agg(F.max(F.struct((F.col("gap1") - F.col("gap0")).alias("n"), (-F.col("gap0")).alias("at"))).alias("g")).select(*keys, "h", "first", "last", F.col("g.n").alias("n"), (-F.col("g.at")).alias("gap0"))
    cut = best.where((F.col("n") >= least) & (F.least(F.col("gap0") - F.col("first"), F.col("last") - F.col("gap0") - F.col("n")) >= rest)).select(*keys, "gap0", (F.col("gap0") + F.col("n")).alias("gap1"))
    pad = F.least(F.lit(3), F.greatest(F.lit(1), F.floor((F.col("gap1") - F.col("gap0")) / 4)))
    both = F.array(
        F.struct(F.lit("left").alias("side"), F.col("x0").alias("a"), F.least("x1", F.col("x0") + F.col("gap0") + pad).alias("b")),
        F.struct(F.lit("right").alias("side"), F.greatest("x0", F.col("x0") + F.col("gap1") - pad).alias("a"), F.col("x1").alias("b")),
    )
    whole = F.array(F.struct(F.lit(None).cast("string").alias("side"), F.col("x0").alias("a"), F.col("x1").alias("b")))
    return lines.join(cut, keys, "left").withColumn("p", F.explode(F.when(F.col("gap0").isNotNull(), both).otherwise(whole))).select(*keys, "p.side", F.col("p.a").alias("x0"), "y0", F.col("p.b").alias("x1"), "y1")
