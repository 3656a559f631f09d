"""Packed masks against cells in numpy; barriers and scores by worked cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import greedy, rasters

BOXES = "array<struct<x0: int, y0: int, x1: int, y1: int>>"


def cells(layout, boxes):
    on = np.zeros((layout.rows, layout.words * 64), bool)
    for x0, y0, x1, y1 in boxes:
        if x0 < x1:
            on[max(0, y0 // layout.cell) : max(0, -(-y1 // layout.cell)), max(0, x0 // layout.cell) : max(0, -(-x1 // layout.cell))] = True
    return on


def test_masks_equal_cells(spark):
    r, layout, rows = random.Random(3), rasters.Layout(700, 90, 4), []
    for i in range(60):
        box = lambda: (lambda x, y: (x, y, x + r.randrange(300), y + r.randint(1, 40)))(r.randrange(-20, 690), r.randrange(-10, 85))
        rows.append((i, [box() for _ in range(r.randint(0, 3))], [box() for _ in range(r.randint(0, 3))]))
    rows += [(100, [(0, 0, 256, 4)], [(252, 0, 260, 4)]), (101, [(0, 0, 768, 92)], [(255, 3, 257, 5)])]
    frame = spark.createDataFrame(rows, f"i int, p {BOXES}, q {BOXES}").select("i", layout.mask(F.col("p")).alias("a"), layout.mask(F.col("q")).alias("b"))
    got = {x.i: x for x in frame.select("i", "a", rasters.ones(F.col("a")).alias("n"), *(rasters.ones(f(F.col("a"), F.col("b"))).alias(f.__name__) for f in (rasters.both, rasters.either, rasters.without))).collect()}
    for i, p, q in rows:
        a, b = cells(layout, p), cells(layout, q)
        x = got[i]
        assert (x.n, x.both, x.either, x.without) == (a.sum(), (a & b).sum(), (a | b).sum(), (a & ~b).sum())
        bits = np.array([w & (2**64 - 1) for w in x.a], np.uint64).view(np.uint8).reshape(layout.rows, -1)
        assert (np.unpackbits(bits, axis=1, bitorder="little").astype(bool) == a).all()
    assert spark.range(1).select(layout.mask(F.lit(None).cast(BOXES)).isNull()).first()[0]


def test_cut_masks_are_the_masks_rows(spark):
    """A cut mask has its boxes' rows only, and meets others as the whole one does."""
    r, layout, rows = random.Random(4), rasters.Layout(700, 90, 4), []
    for i in range(60):
        box = lambda: (lambda x, y: (x, y, x + r.randrange(300), y + r.randint(1, 40)))(r.randrange(-20, 690), r.randrange(-30, 95))
        rows.append((i, [box() for _ in range(r.randint(0, 3))], [box() for _ in range(r.randint(0, 2))]))
    frame = spark.createDataFrame(rows, f"i int, p {BOXES}, q {BOXES}").select("p", *(f(F.col(c)).alias(n + c) for c in "pq" for n, f in (("m", layout.mask), ("c", layout.cut))))
    n = layout.words * layout.rows
    for x in frame.select("*", rasters.ones(rasters.both(F.col("mp"), F.col("mq"))).alias("n"), rasters.ones(rasters.met(F.col("cp"), F.col("cq"))).alias("m")).collect():
        assert x.n == x.m
        for whole, cut in ((x.mp, x.cp), (x.mq, x.cq)):
            assert [0] * cut.at + cut.words + [0] * (n - cut.at - len(cut.words)) == whole or not any(whole) and not any(cut.words)
        assert len(x.cp.words) <= layout.words * sum(-(-b.y1 // 4) - b.y0 // 4 for b in x.p) or len(x.p) > 1
    assert spark.range(1).select(layout.cut(F.lit(None).cast(BOXES)).isNull()).first()[0]


def pair(spark, a, b, dark=(), masks=(None, None), ways=("h", "h")):
    region = lambda i, box, way, mask: (0, i, *box, way, mask)
    schema = "struct<page: int, ord: int, x0: int, y0: int, x1: int, y1: int, direction: string, mask: array<bigint>>"
    pairs = spark.createDataFrame([(region(0, a, ways[0], masks[0]), region(1, b, ways[1], masks[1]))], f"a {schema}, b {schema}")
    out = rasters.separated(pairs, spark.createDataFrame([(0, *d) for d in dark], "page int, x0 int, y0 int, x1 int, y1 int"))
    row = out.select("separated", rasters.pair_score().alias("score")).first()
    return row.separated, row.score


def test_barriers(spark):
    a, b = (0, 0, 40, 20), (60, 0, 100, 20)
    assert pair(spark, a, b)[0] is False
    assert pair(spark, a, b, [(48, -5, 51, 30)])[0] is True  # a rule between them
    assert pair(spark, a, b, [(48, 0, 51, 8)])[0] is False  # shorter than 45 %
    assert pair(spark, a, b, [(41, 0, 59, 20)])[0] is False  # a block, not a line
    assert pair(spark, a, (42, 0, 80, 20), [(40, 0, 42, 20)])[0] is False  # a corridor of two pixels
    assert pair(spark, a, (60, 15, 100, 35))[0] is None  # too little in common
    assert pair(spark, (0, 0, 40, 20), (0, 40, 40, 60), [(0, 29, 40, 31)])[0] is True
    assert pair(spark, a, (10, 10, 50, 30))[0] is False and pair(spark, (0, 0, 100, 10), (90, 9, 200, 200))[0] is None


def test_scores(spark):
    a = (0, 0, 100, 20)
    assert pair(spark, a, (0, 5, 100, 25))[1] == 1750
    assert pair(spark, a, (0, 18, 100, 38))[1] == 500 and pair(spark, a, (0, 22, 100, 42))[1] == 0 and pair(spark, a, (0, 40, 100, 60))[1] == 0
    assert pair(spark, a, (0, 18, 100, 38), ways=("h", "v"))[1] == 0
    one, half, other = [0b1111], [0b0111], [0b110000]
    assert pair(spark, a, (0, 22, 100, 42), masks=(one, half))[1] == 3000
    assert pair(spark, a, (0, 22, 100, 42), masks=(one, other))[1] == 0
    assert pair(spark, a, (0, 40, 100, 60), masks=(one, one), dark=[(0, 29, 100, 31)])[1] == 0
    r = random.Random(2)
    for _ in range(12):  # without masks and barriers it is the score of the greedy pass
        box = lambda: (lambda x, y: (x, y, x + r.randint(20, 60), y + r.randint(10, 30)))(r.randrange(40), r.randrange(40))
        p, q = box(), box()
        assert abs(pair(spark, p, q)[1] / 1000 - greedy.fit_score(p, [(p, "h")], q, "h")) < 0.001
