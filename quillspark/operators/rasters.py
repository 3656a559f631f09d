"""Bit masks of page areas and what follows from them: overlap of masks,
barriers between texts, and how well two texts go together (J13, J16, J23,
A25, U5, A.5, A.6).

A mask is an array of longs: the page in cells of a few pixels, row after row,
64 cells a word. It is made from boxes and combined in the JVM, by shifts, & and
bit_count; no pixel leaves the engine. All masks of a comparison have one
layout; null is no mask. A mask can be cut to the rows that its boxes touch;
it then goes with the place of its first word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import touching

BOX = ("x0", "y0", "x1", "y1")


@dataclass(frozen=True)
class Layout:
    """``width`` and ``height`` in pixels, ``cell`` pixels a side of a cell."""

    width: int
    height: int
    cell: int = 8

    @property
    def words(self) -> int:
        return -(-self.width // (64 * self.cell))

    @property
    def rows(self) -> int:
        return -(-self.height // self.cell)

    def mask(self, boxes: Column) -> Column:
        """Of an array of boxes (x0, y0, x1, y1): the cells that any of them
        touches. What lies off the page is left out."""
        return F.when(boxes.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(self.words * self.rows - 1)), self._word(boxes)))

    def cut(self, boxes: Column) -> Column:
        """``mask`` as struct<at, words> of the rows that any of the boxes touches; ``at`` words
        before them are 0, as is all that follows."""
        edge = lambda of, c, to: F.coalesce(of(F.transform(boxes, lambda b: to(b[c] / self.cell).cast("int"))), F.lit(0))
        first = F.greatest(F.lit(0), edge(F.array_min, "y0", F.floor)) * self.words
        end = F.least(F.lit(self.rows), edge(F.array_max, "y1", F.ceil)) * self.words
        words = F.when(first < end, F.transform(F.sequence(first, end - 1), self._word(boxes))).otherwise(F.array().cast("array<bigint>"))
        return F.when(boxes.isNotNull(), F.struct(first.alias("at"), words.alias("words")))

    def _word(self, boxes: Column):
        """The word at a place."""
        cells = F.transform(boxes, lambda b: F.struct(*(F.greatest(F.lit(0), F.floor(b[c] / self.cell)).cast("int").alias(c) for c in BOX[:2]), *(F.ceil(b[c] / self.cell).cast("int").alias(c) for c in BOX[2:])))

        def word(i: Column) -> Column:
            row, first = F.floor(i / self.words), (i % self.words) * 64

            def bits(b: Column) -> Column:
                low, high = F.greatest(b["x0"] - first, F.lit(0)), F.least(b["x1"] - first, F.lit(64))
                inside = (b["y0"] <= row) & (row < b["y1"]) & (low < high) & (b["x0"] < b["x1"])
                # ones from low to 63, and from 0 to high - 1; Java's shifts take the count modulo 64
                ones = F.call_function("shiftleft", F.lit(-1).cast("long"), low.cast("int")).bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - high).cast("int")))
                return F.when(inside, ones).otherwise(F.lit(0).cast("long"))

            return F.aggregate(cells, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bits(b)))

        return word


def ones(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("long"), lambda acc, w: acc + F.bit_count(w))


def met(a: Column, b: Column) -> Column:
    """The cells that two cut masks have both, in the rows that both have."""
    first = F.greatest(a["at"], b["at"])
    n = F.greatest(F.lit(0), F.least(*(x["at"] + F.size(x["words"]) for x in (a, b))) - first)
    return both(*(F.slice(x["words"], first - x["at"] + 1, n) for x in (a, b)))


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def without(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def _extent(r: str, axis: str) -> Column:
    return F.col(f"{r}.{axis}1") - F.col(f"{r}.{axis}0")


def _common(axis: str) -> Column:
    return F.greatest(F.lit(0), F.least(f"a.{axis}1", f"b.{axis}1") - F.greatest(f"a.{axis}0", f"b.{axis}0"))


def _gap(axis: str) -> Column:
    return F.greatest(F.lit(0), F.greatest(f"a.{axis}0", f"b.{axis}0") - F.least(f"a.{axis}1", f"b.{axis}1"))


def adjacent() -> Column:
    """A.4 of the structs a and b."""
    share = lambda axis: _common(axis) / F.greatest(F.lit(1), F.least(_extent("a", axis), _extent("b", axis)))
    most = lambda axis: F.greatest(_extent("a", axis), _extent("b", axis))
    rule = lambda far, near: ((share(near) >= 0.45) & (_gap(far) <= 1.5 * most(far))) | ((share(far) >= 0.5) & (_gap(near) <= 0.25 * most(near)))
    return F.when(F.coalesce("a.direction", "b.direction", F.lit("h")) == "v", rule("x", "y")).otherwise(rule("y", "x"))


def separated(pairs: DataFrame, dark: DataFrame, same: str = "page", order: str = "ord") -> DataFrame:
    """``pairs`` (a, b) with ``separated``: whether a long dark box stands in the
    corridor between them; null where there is no corridor to judge (A.6).

    ``dark`` has boxes that don't touch one another. In a corridor a box counts
    by what of it lies there: long enough, and thin."""
    axis = F.when((F.col("a.x1") <= F.col("b.x0")) | (F.col("b.x1") <= F.col("a.x0")), "x").when((F.col("a.y1") <= F.col("b.y0")) | (F.col("b.y1") <= F.col("a.y0")), "y")
    corridor = F.struct(*(F.when(F.col("_axis") == k, F.least(f"a.{k}1", f"b.{k}1")).otherwise(F.greatest(f"a.{k}0", f"b.{k}0")).alias(f"{k}0") for k in "xy"), *(F.when(F.col("_axis") == k, F.greatest(f"a.{k}0", f"b.{k}0")).otherwise(F.least(f"a.{k}1", f"b.{k}1")).alias(f"{k}1") for k in "xy"))
    rows = pairs.withColumn("_axis", axis).withColumn("c", corridor)
    side = lambda k: F.col(f"c.{k}1") - F.col(f"c.{k}0")
    needs = lambda k: F.greatest(F.lit(8), F.floor(F.least(F.greatest(F.lit(1), _extent("a", k)), F.greatest(F.lit(1), _extent("b", k))) / 4))
    wide = {"x": side("y") >= needs("y"), "y": side("x") >= needs("x")}
    judged = F.when(F.col("_axis").isNull(), F.when(adjacent(), F.lit(False))).when(F.col("_axis") == "x", F.when(wide["x"], F.when(side("x") >= 3, F.lit(True)).otherwise(F.lit(False)))).otherwise(F.when(wide["y"], F.when(side("y") >= 3, F.lit(True)).otherwise(F.lit(False))))
    rows = rows.withColumn("_open", judged)
    # only corridors that are wide enough meet the dark boxes
    ask = rows.where("_open").select(F.col(f"a.{same}").alias(same), F.col(f"a.{order}").alias("a_"), F.col(f"b.{order}").alias("b_"), "_axis", *(F.col(f"c.{k}").alias(k) for k in BOX))
    met = touching(ask, dark, [same])
    inside = {k: F.least(f"a.{k}1", f"b.{k}1") - F.greatest(f"a.{k}0", f"b.{k}0") for k in "xy"}
    span, thick = (F.when(F.col("a._axis") == "x", inside[p]).otherwise(inside[q]) for p, q in (("y", "x"), ("x", "y")))
    corridor_span = F.when(F.col("a._axis") == "x", _extent("a", "y")).otherwise(_extent("a", "x"))
    barrier = (inside["x"] > 0) & (inside["y"] > 0) & (_extent("a", "x") >= 2) & (_extent("a", "y") >= 2) & (span >= 6) & (100 * span >= 45 * corridor_span) & ((thick <= 12) | (100 * thick <= 45 * span))
    barred = met.where(barrier).select(F.col(f"a.{same}").alias("s_"), "a.a_", "a.b_").distinct().withColumn("_barred", F.lit(True))
    out = rows.join(barred, (F.col(f"a.{same}") == F.col("s_")) & (F.col(f"a.{order}") == F.col("a_")) & (F.col(f"b.{order}") == F.col("b_")), "left")
    return out.withColumn("separated", F.when(F.col("_open"), F.coalesce("_barred", F.lit(False))).otherwise(F.col("_open"))).drop("_axis", "c", "_open", "s_", "a_", "b_", "_barred")


def pair_score(overlap_percent: int = 55, cut: bool = False) -> Column:
    """A.5 in thousandths, of the structs a and b with masks (``cut`` or whole) and ``separated``:
    0 not together; 2000 and the masks' overlap where both have masks; else
    1000 and the boxes' overlap, 1000 for one within the other, 500 for near ones."""
    area = lambda r: _extent(r, "x") * _extent(r, "y")
    hull = (F.greatest("a.x1", "b.x1") - F.least("a.x0", "b.x0")) * (F.greatest("a.y1", "b.y1") - F.least("a.y0", "b.y0"))
    common = _common("x") * _common("y")
    shared = F.floor(1000 * common / F.greatest(F.lit(1), F.least(area("a"), area("b"))))
    ma, mb = F.col("a.mask"), F.col("b.mask")
    least = F.least(*(ones(m["words"] if cut else m) for m in (ma, mb)))
    masks = F.when(least > 0, F.floor(1000 * ones(met(ma, mb) if cut else both(ma, mb)) / least)).otherwise(0)
    balloon = 10 * hull <= 16 * (area("a") + area("b"))
    fits = F.coalesce(F.col("a.direction") == F.col("b.direction"), F.lit(True))
    within = lambda p, q: (F.col(f"{p}.x0") <= F.col(f"{q}.x0")) & (F.col(f"{p}.y0") <= F.col(f"{q}.y0")) & (F.col(f"{p}.x1") >= F.col(f"{q}.x1")) & (F.col(f"{p}.y1") >= F.col(f"{q}.y1"))
    pad = F.floor(F.least(_extent("a", "x"), _extent("a", "y")) / 5)
    grown = {k: F.greatest(F.lit(0), F.least(F.col(f"a.{k}1") + pad, F.col(f"b.{k}1")) - F.greatest(F.col(f"a.{k}0") - pad, F.col(f"b.{k}0"))) for k in "xy"}
    near = 100 * grown["x"] * grown["y"] > 15 * F.greatest(F.lit(1), F.least((_extent("a", "x") + 2 * pad) * (_extent("a", "y") + 2 * pad), area("b")))
    boxes = F.when(~balloon | (10 * hull > 22 * (area("a") + area("b"))) | ~adjacent() | ~fits, 0).when(shared >= 450, 1000 + shared).when(within("a", "b") | within("b", "a"), 1000).when(near, 500).otherwise(0)
    masked = F.when((masks < 10 * overlap_percent) | ~balloon, 0).otherwise(2000 + masks)
    return F.when(F.coalesce("separated", F.lit(False)), 0).when(ma.isNotNull() & mb.isNotNull(), masked).otherwise(boxes).cast("long")


def groups_separated(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, separated): whether all pairs that can be judged are separated,
    and there is one (J16)."""
    return pairs.groupBy(*keys).agg(F.coalesce(F.bool_and("separated"), F.lit(False)).alias("separated"))
