"""Splitting a group of text boxes where two columns or stacks meet (W9, A.7).

Boxes are put in the order of their centres; a cut's two sides are described
by running extremes from both ends and by medians, which are places in the sorted
centres. The best valid cut splits a group. ``side_by_side`` looks at both
halves again, round by round, and carries on only what was split; a group's
``part`` tells its way: 0 for the left half, 1 for the right one, for each split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Words that a column goes on with.
CONJUNCTIONS = ("AND", "BUT", "OR", "SO", "THEN", "ALSO")
_BOX = ("x0", "y0", "x1", "y1")


def _share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common extent, as a share of the smaller one."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0)) / F.greatest(F.lit(1), F.least(a1 - a0, b1 - b0))


def _median(sorted_: Column, first: Column, n: Column) -> Column:
    """Of n values of a sorted array from ``first`` (0 is the begin) on."""
    low, high = first + F.floor((n - 1) / 2), first + F.floor(n / 2)
    return (F.element_at(sorted_, (low + 1).cast("int")) + F.element_at(sorted_, (high + 1).cast("int"))) / 2


def _cuts(rows: DataFrame, keys: list[str], order: str, axis: str) -> DataFrame:
    """A row for each box but a group's first: the cut before it, along
    ``axis``. Sides are l and r; ``cut`` boxes are left of it. Centres are doubled."""
    other = "y" if axis == "x" else "x"
    centre = F.col(f"{axis}0") + F.col(f"{axis}1")
    lined = Window.partitionBy(*keys).orderBy("_c", order)
    before, after = lined.rowsBetween(Window.unboundedPreceding, -1), lined.rowsBetween(0, Window.unboundedFollowing)
    area = F.greatest(F.lit(1), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    first = F.struct("y0", "x0", "_c", order, F.upper(F.regexp_extract(F.ltrim(F.coalesce("text", F.lit(""))), "^[A-Za-z]+", 0)).isin(*CONJUNCTIONS).alias("joins"))
    out = rows.withColumn("_c", centre).withColumns({"_area": area, "_first": first}).withColumn("cut", F.row_number().over(lined) - 1)
    for side, w in (("l", before), ("r", after)):
        for i, f in ((0, F.min), (1, F.max)):
            out = out.withColumns({f"{side}{a}{i}": f(f"{a}{i}").over(w) for a in "xy"})
        out = out.withColumns({f"{side}_area": F.sum("_area").over(w), f"{side}_joins": F.min("_first").over(w)["joins"], f"{side}_n": F.count(F.lit(1)).over(w)})
    facts = rows.withColumn("_c", centre).groupBy(*keys).agg(
        F.sort_array(F.collect_list("_c")).alias("centres"),
        *(F.median(F.greatest(F.lit(1), F.col(f"{a}1") - F.col(f"{a}0"))).alias(f"median_{n}") for a, n in (("x", "w"), ("y", "h"))),
    )
    gutter = F.col(f"r{axis}0") - F.col(f"l{axis}1")
    share = _share(*(F.col(f"{s}{other}{i}") for s in "lr" for i in (0, 1)))
    return out.where("cut > 0").join(facts, keys).withColumns({"gutter": gutter, "share": share})


def _compact(side: str) -> Column:
    """Few gaps: the hull is at most 2.2 times the boxes; one box always is."""
    hull = F.greatest(F.lit(1), (F.col(f"{side}x1") - F.col(f"{side}x0")) * (F.col(f"{side}y1") - F.col(f"{side}y0")))
    return (F.col(f"{side}_n") <= 1) | (10 * hull <= 22 * F.col(f"{side}_area"))


def _best(cuts: DataFrame, keys: list[str], valid: Column, score: Column, order: str) -> DataFrame:
    """(*keys, at): where the best cut is, as (centre, order) of its first box
    to the right; the first of equal ones."""
    return cuts.where(valid).groupBy(*keys).agg(F.max(F.struct(score.alias("score"), (-F.col("cut")).alias("cut"), F.struct("_c", order).alias("at"))).alias("x")).select(*keys, F.col("x.at").alias("_at"))


def _cut(rows: DataFrame, best: DataFrame, keys: list[str], order: str, axis: str) -> DataFrame:
    """The rows of groups that have a cut, with their half's number."""
    here = F.struct((F.col(f"{axis}0") + F.col(f"{axis}1")).alias("_c"), F.col(order))
    return rows.join(best, keys).withColumn("_half", F.when(here < F.col("_at"), "0").otherwise("1")).drop("_at")


def side_by_side(boxes: DataFrame, keys: list[str], order: str = "ord", rounds: list[int] | None = None) -> DataFrame:
    """``boxes`` (text, lang, direction, x0 to y1) with ``part``: groups of four
    boxes or more, all horizontal or unknown, some in English or Chinese, are
    cut where a gutter parts two columns of two or more. ``rounds`` gets the number of groups
    that each round cut."""
    rows = kept(boxes.withColumn("part", F.lit("")), "split")
    own, done = [*keys, "part"], []
    while True:
        fit = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("direction", F.lit("h")) == "h").alias("level"), F.bool_or(F.coalesce("lang", F.lit("")).isin("en", "zh")).alias("known")).where("n >= 4 AND level AND known").select(*own)
        cuts = _cuts(rows.join(fit, own, "left_semi"), own, order, "x")
        centres, n, cut = F.col("centres"), F.size("centres"), F.col("cut")
        gap = (_median(centres, cut, n - cut) - _median(centres, F.lit(0), cut)) / 2
        high = F.col("median_h")
        valid = (
            (cut >= 2) & (cut <= n - 2) & (F.col("gutter") >= F.greatest(F.lit(6.0), 0.3 * high)) & (F.col("share") >= 0.3)
            & (gap >= F.greatest(3.0 * high, 1.5 * F.col("gutter"))) & ~(F.col("l_joins") & F.col("r_joins"))
        )
        best = _best(cuts, own, valid, F.col("gutter") + gap * 0.25 + F.col("share") * high, order)
        split = kept(_cut(rows, best, own, order, "x"), "split")
        n_cut = split.select(*own).distinct().count()
        if rounds is not None:
            rounds.append(n_cut)
        done.append(rows.join(split.select(*own).distinct(), own, "left_anti") if n_cut else rows)
        if not n_cut:
            break
        rows = split.withColumn("part", F.concat("part", "_half")).drop("_half")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def separated(boxes: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """``boxes`` with ``half``: groups of two boxes or more of one direction
    are cut once, across a smaller gutter, where both sides are compact; upright
    ones that have no such cut also between stacks. Null where nothing was cut."""
    ways = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("direction", F.lit("h")) == "h").alias("level"), (F.bool_and(F.coalesce("direction", F.lit("v")) == "v") & F.bool_or(F.coalesce("direction", F.lit("")) == "v")).alias("upright"))
    fit = ways.where("n >= 2 AND (level OR upright)").select(*keys, "upright")
    compact = _compact("l") & _compact("r")
    across = _cuts(boxes.join(fit, keys), keys, order, "x")
    least = F.when(F.col("upright"), F.greatest(F.lit(2.0), 0.6 * F.col("median_w"))).otherwise(F.greatest(F.lit(2.0), 0.4 * F.col("median_h")))
    first = _best(across, keys, (F.col("gutter") >= least) & compact & (F.col("share") >= 0.25), F.col("gutter") + F.col("share") * F.col("median_h"), order)
    stacks = _cuts(boxes.join(fit.where("upright"), keys).join(first, keys, "left_anti"), keys, order, "y")
    second = _best(stacks, keys, (F.col("gutter") >= F.greatest(F.lit(2.0), 0.2 * F.col("median_w"))) & compact & (F.col("share") >= 0.25), F.col("gutter") + F.col("share") * F.col("median_w"), order)
    cut = _cut(boxes, first, keys, order, "x").unionByName(_cut(boxes, second, keys, order, "y")).withColumnRenamed("_half", "half")
    cut_keys = first.select(*keys).unionByName(second.select(*keys))
    return cut.unionByName(boxes.join(cut_keys, keys, "left_anti").withColumn("half", F.lit(None).cast("string")))
