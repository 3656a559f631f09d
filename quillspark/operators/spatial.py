"""Spatial joins over a grid.

On a page of up to ``CROWD`` boxes all boxes meet. On a fuller one a box goes
to each square of a grid that it touches, and pairs meet on (page, square); the
squares are two to eight times as large as the page's mean box, the larger the fewer
boxes lie over each other, so most boxes are on one.
The corner where two boxes begin to overlap lies in one square only, which is the
first of one of them along each axis, and only
there a pair is kept, so no distinct is needed. A page of a million boxes is
spread over its squares; where many boxes lie on one square, the join is an
equi-join that Spark can split.

Suppression (T8) takes rounds over the pairs that the join gives: who has no
better box over it stays, and what lies under it goes.

Boxes are ``x0, y0, x1, y1``. One that is turned over or lacks a coordinate
touches nothing. Other columns go along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .numbering import numbered

#: Pixels a side of a square, where none is measured: about the width of a line of text.
SIDE = 128
#: Boxes that all meet on their page; squares by the mean box, at least and at most; boxes that a
#: square has if the page is even; pages that go to every task.
CROWD, SQUARE, MEET, TOLD = 64, (2, 8), 256, 100_000
BOX = ("x0", "y0", "x1", "y1")
#: A box, made larger or not, from a function that gives the row's columns.
Reach = Callable[[Callable[[str], Column]], dict[str, Column]]


def _plain(at: Callable[[str], Column]) -> dict[str, Column]:
    return {c: at(c) for c in BOX}


def _squares(reach: dict[str, Column], axis: str, side: Column, origin: Column) -> list[Column]:
    """The first and the last square along an axis; a side that is null is without end."""
    return [F.coalesce(F.floor((reach[f"{axis}{i}"] - origin) / side), F.lit(0).cast("long")) for i in (0, 1)]


def _spread(rows: DataFrame, reach: dict[str, Column], sides: dict[str, Column], origins: dict[str, Column] | None = None) -> DataFrame:
    """Each row once for every square (tx, ty) that ``reach`` touches."""
    rows = rows.where((reach["x0"] <= reach["x1"]) & (reach["y0"] <= reach["y1"]))
    for axis in "xy":
        rows = rows.withColumn(f"t{axis}", F.explode(F.sequence(*_squares(reach, axis, sides[axis], origins[axis] if origins else F.lit(0)))))
    return rows


def on_grid(boxes: DataFrame, reach: dict[str, Column], side: int = SIDE) -> DataFrame:
    """(row, reach, tx, ty): each row once for every square that ``reach``
    (its box, made larger or not) touches."""
    rows = boxes.select(F.struct("*").alias("row"), F.struct(*(reach[c].alias(c) for c in BOX)).alias("reach"))
    return _spread(rows, {c: F.col(f"reach.{c}") for c in BOX}, {axis: F.lit(side) for axis in "xy"})


def _crowded(sides: list[tuple[DataFrame, Reach]], same: list[str]) -> DataFrame:
    """(_0, _1, .., sx, sy, ox, oy): the pages of more than ``CROWD`` boxes, their squares and where those begin."""
    every = None
    for rows, reach in sides:
        own = reach(F.col)
        rows = rows.where((own["x0"] <= own["x1"]) & (own["y0"] <= own["y1"])).select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(same)), *(own[c].cast("double").alias(c) for c in BOX))
        every = rows if every is None else every.unionByName(rows)
    keys = [f"_{i}" for i in range(len(same))]
    mean = lambda axis: F.greatest(F.lit(1.0), F.avg(F.col(f"{axis}1") - F.col(f"{axis}0")))
    wide = lambda axis: F.greatest(F.lit(1.0), F.max(f"{axis}1") - F.min(f"{axis}0"))
    over = F.count(F.lit(1)) * mean("x") * mean("y") / (wide("x") * wide("y"))  # boxes over a point, on the mean
    times = F.greatest(F.lit(SQUARE[0]), F.least(F.lit(SQUARE[1]), F.sqrt(MEET / over)))
    sizes = every.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.ceil(times * mean(axis)).cast("long").alias(f"s{axis}") for axis in "xy"), *(F.floor(F.min(f"{axis}0")).cast("long").alias(f"o{axis}") for axis in "xy"))
    return kept(sizes.where(F.col("_n") > CROWD).drop("_n"), "crowded")


def touching(left: DataFrame, right: DataFrame, same: list[str], left_reach: Reach | None = None, right_reach: Reach | None = None, side: int | None = None, rule: Callable[..., Column] | None = None) -> DataFrame:
    """(a, b): rows of ``left`` and ``right``, as structs, that have equal
    ``same`` columns and whose reaches share a point. All columns of the rows travel,
    so they should have no more than is asked for. ``side`` sets all squares' side.
    ``rule``, from two functions that give a's and b's columns, is what pairs have to
    pass; it holds only where the reaches share a point, so that isn't asked apart."""
    reaches = {"a": left_reach or _plain, "b": right_reach or _plain}
    keys, name = [f"_{i}" for i in range(len(same))], {"a": left, "b": right}
    crowded = n = None
    if side is None:
        once = left is right and reaches["a"] is reaches["b"]
        crowded = _crowded([(name[r], reaches[r]) for r in ("a" if once else "ab")], same)
        n = crowded.count()

    # a row travels once, and alike on both sides, so that a join of a table with itself deals it out once; a
    # reach is worked out again where the rows meet
    others = {r: [c for c in name[r].columns if c not in same] for r in "ab"}
    at = lambda r, c: F.col(keys[same.index(c)] if c in same else f"`{r}__{c}`")
    flat = {r: reaches[r](lambda c, r=r: at(r, c)) for r in "ab"}

    def put(r: str) -> DataFrame:
        own = flat[r]
        rows = name[r].select(*(F.col(f"`{c}`").alias(f"{r}__{c}") for c in others[r]), *(F.col(k).alias(i) for i, k in zip(keys, same)))
        if n == 0:
            return rows.where((own["x0"] <= own["x1"]) & (own["y0"] <= own["y1"]))
        if crowded is None:
            sides, origins = ({axis: F.lit(x) for axis in "xy"} for x in (side, 0))
        else:
            rows = rows.join(F.broadcast(crowded) if n <= TOLD else crowded, keys, "left")
            sides, origins = ({axis: F.col(f"{x}{axis}") for axis in "xy"} for x in "so")
        rows = _spread(rows, own, sides, origins)
        # 1: it begins in this column of squares, 2: in this row of them
        begins = [F.when(F.col(f"t{axis}") == _squares(own, axis, sides[axis], origins[axis])[0], bit).otherwise(0) for axis, bit in (("x", 1), ("y", 2))]
        return rows.withColumn(f"{r}_begins", (begins[0] + begins[1]).cast("byte")).drop("sx", "sy", "ox", "oy")

    pairs = put("a").join(put("b"), keys if n == 0 else [*keys, "tx", "ty"])
    if rule is not None:
        pairs = pairs.where(rule(*(lambda c, r=r: at(r, c) for r in "ab")))
    else:
        for axis in "yx":
            pairs = pairs.where((flat["a"][f"{axis}0"] <= flat["b"][f"{axis}1"]) & (flat["b"][f"{axis}0"] <= flat["a"][f"{axis}1"]))
    if n != 0:
        pairs = pairs.where(F.col("a_begins").bitwiseOR(F.col("b_begins")) == 3)
    return pairs.select(*(F.struct(*(at(r, c).alias(c) for c in name[r].columns)).alias(r) for r in "ab"))


def _side(row: str, axis: str) -> Column:
    return F.col(f"{row}.{axis}1") - F.col(f"{row}.{axis}0")


def shared(axis: str) -> Column:
    """The extent that a and b share along an axis."""
    return F.greatest(F.lit(0), F.least(f"a.{axis}1", f"b.{axis}1") - F.greatest(f"a.{axis}0", f"b.{axis}0"))


def intersection() -> Column:
    return shared("x") * shared("y")


def joined_area() -> Column:
    return _side("a", "x") * _side("a", "y") + _side("b", "x") * _side("b", "y") - intersection()


def overlaps(boxes: DataFrame, order: str = "ord", same: tuple[str, ...] = ("page",), side: int | None = None) -> DataFrame:
    """(*same, a, b, shared, total) of all pairs that overlap, a before b:
    the cells of the IoU matrix that aren't 0 (J17)."""
    rows = boxes.select(*same, order, *BOX)
    pairs = touching(rows, rows, list(same), side=side).where(F.col(f"a.{order}") < F.col(f"b.{order}"))
    return pairs.select(*(F.col(f"a.{k}").alias(k) for k in same), F.col(f"a.{order}").alias("a"), F.col(f"b.{order}").alias("b"), intersection().alias("shared"), joined_area().alias("total")).where("shared > 0")


def uncovered(boxes: DataFrame, covers: Column, tenths: int = 3, order: str = "ord", same: tuple[str, ...] = ("page",), side: int | None = None) -> DataFrame:
    """The boxes that aren't ``covers``, without those whose IoU with one that
    is lies above ``tenths`` / 10 (J11). Equal covering boxes of a page are
    compared once."""
    keys = [*same, order, *BOX]  # an order that isn't unique tells nothing
    above = boxes.where(covers).select(*same, *BOX).distinct()
    rest = boxes.where(~covers)
    # products, as a quotient's rounding errs at the border
    hit = touching(rest.select(*keys), above, list(same), side=side).where((10 * intersection() > tenths * joined_area()) & (intersection() > 0))
    return rest.join(hit.select(*(F.col(f"a.{k}").alias(k) for k in keys)).distinct(), keys, "left_anti")


#: Share of the smaller extent, and gap by the larger one, for lines of text
#: that follow each other across and along their direction.
ACROSS_SHARE, ACROSS_GAP, ALONG_SHARE, ALONG_GAP = 0.45, 1.5, 0.5, 0.25


def adjacent_texts(boxes: DataFrame, order: str = "ord", same: tuple[str, ...] = ("page",), side: int | None = None) -> DataFrame:
    """(*same, a, b, direction) of all pairs of neighbours in a text, a before
    b (J15, A.4). The direction is a's or else b's.

    A pair's direction says how far apart its boxes may be, as a share of the
    larger one, along one axis; along the other they share some extent. So boxes meet
    with a reach along both axes by their own size, once."""

    def reach(at: Callable[[str], Column]) -> dict[str, Column]:
        by = {axis: F.ceil(max(ACROSS_GAP, ALONG_GAP) * (at(f"{axis}1") - at(f"{axis}0"))) for axis in "xy"}
        return {c: at(c) + (-by[c[0]] if c[1] == "0" else by[c[0]]) for c in BOX}

    def fits(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        side = lambda r, axis: r(f"{axis}1") - r(f"{axis}0")
        upright = F.when(a("direction") == 0, b("direction") == 2).otherwise(a("direction") == 2)

        def along(far: str, near: str, least: Column, most: Column) -> Column:
            shared = F.least(a(f"{near}1"), b(f"{near}1")) - F.greatest(a(f"{near}0"), b(f"{near}0"))
            apart = F.greatest(a(f"{far}0"), b(f"{far}0")) - F.least(a(f"{far}1"), b(f"{far}1"))
            # the first two spare most pairs the others
            return (a(f"{near}0") < b(f"{near}1")) & (b(f"{near}0") < a(f"{near}1")) & (F.greatest(F.lit(0), apart) <= most * F.greatest(side(a, far), side(b, far))) & (shared / F.greatest(F.lit(1), F.least(side(a, near), side(b, near))) >= least)

        of = lambda v, h: F.when(upright, v).otherwise(h)
        return (a(order) < b(order)) & (
            along("x", "y", of(ACROSS_SHARE, ALONG_SHARE), of(ACROSS_GAP, ALONG_GAP)) | along("y", "x", of(ALONG_SHARE, ACROSS_SHARE), of(ALONG_GAP, ACROSS_GAP))
        )

    # a number, as both sides ask for it whether it may be null or not
    way = F.when(F.col("direction").isNull(), 0).when(F.col("direction") == "v", 2).otherwise(1).cast("byte")
    rows = boxes.select(*same, order, *BOX, way.alias("direction"))
    pairs = touching(rows, rows, list(same), reach, reach, side, fits)
    upright = F.when(F.col("a.direction") == 0, F.col("b.direction") == 2).otherwise(F.col("a.direction") == 2)
    return pairs.select(*(F.col(f"a.{k}").alias(k) for k in same), F.col(f"a.{order}").alias("a"), F.col(f"b.{order}").alias("b"), F.when(upright, "v").otherwise("h").alias("direction"))


def suppressed(boxes: DataFrame, kind: str = "lang", order: str = "ord", page: str = "page", least: int = 250, percent: int = 45, most: int = 30_000, most_kept: int = 300, side: int | None = None, rounds: list[int] | None = None) -> DataFrame:
    """The boxes that stay of each page, with ``rank``. Those over ``least``
    of ``conf`` take part, the ``most`` best of a page; from the best on, a box goes if
    its IoU with one of its ``kind`` that stays is over ``percent``; the ``most_kept``
    best stay. ``rounds`` gets the number of pairs before each round."""
    best = [F.desc("conf"), F.asc(order)]
    rows = kept(numbered(boxes.where(F.col("conf") > least), best, "_rank", (page,)).where(F.col("_rank") <= most), "candidates")
    met = rows.select(page, kind, "_rank", *BOX)
    over = touching(met, met, [page, kind], side=side).where((F.col("a._rank") < F.col("b._rank")) & (100 * intersection() > percent * joined_area()))
    pairs, gone = kept(over.select(F.col(f"a.{page}").alias("p"), F.col("a._rank").alias("a"), F.col("b._rank").alias("b")), "pairs"), []
    while True:
        n = pairs.count()
        if rounds is not None:
            rounds.append(n)
        if not n:
            break
        heads = pairs.select("p", "a").distinct().join(pairs.select("p", F.col("b").alias("a")).distinct(), ["p", "a"], "left_anti")
        under = kept(pairs.join(heads, ["p", "a"], "left_semi").select("p", "b").distinct(), "gone")
        gone.append(under)
        pairs = kept(pairs.join(under, ["p", "b"], "left_anti").join(under.select("p", F.col("b").alias("a")), ["p", "a"], "left_anti"), "pairs")
    under = None
    for g in gone:
        under = g if under is None else under.unionByName(g)
    if under is not None:
        rows = rows.join(under.select(F.col("p").alias(page), F.col("b").alias("_rank")), [page, "_rank"], "left_anti")
    return numbered(rows.select(*boxes.columns), best, "rank", (page,)).where(F.col("rank") <= most_kept)
