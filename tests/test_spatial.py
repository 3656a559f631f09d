"""Grid joins against all pairs, and how even they are on one hot page."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import greedy, spatial
from quillspark.sources.frames import frame

SCHEMA = "page long, ord long, x0 long, y0 long, x1 long, y1 long, direction string, row string, tx string, a string"


@pytest.fixture(scope="module")
def made():
    r, out = random.Random(5), []
    for page in range(3):
        for i in range(150):
            x, y = r.randrange(-200, 600), r.randrange(-100, 500)
            out.append((page, i, x, y, x + r.choice([0, 5, 40, 90, 700]), y + r.choice([0, 8, 20, 60, 300]), r.choice("hvv")))
    # on the grid's lines, equal boxes, one box on another page only, one without a coordinate, one turned over
    out += [(3, i, 128 * i, 128, 128 * i + 128, 256, "h") for i in range(6)] + [(3, 10 + i, 128, 128, 256, 256, "v") for i in range(4)]
    out += [(4, 0, 0, 0, 9, 9, "h"), (5, 0, None, 0, 9, 9, "h"), (5, 1, 50, 50, 40, 40, "v")]
    return out


@pytest.fixture(scope="module")
def boxes(spark, made):
    return spark.createDataFrame([(*x, "r", "t", "a") for x in made], SCHEMA)


def pairs_of(made):
    whole = [b for b in made if b[2] is not None and b[2] <= b[4] and b[3] <= b[5]]
    return [(a, b) for a in whole for b in whole if a[0] == b[0] and a[1] < b[1]]


@pytest.mark.parametrize("side", [16, 128, 5000])
def test_overlaps_equal_all_pairs(boxes, made, side):
    want = []
    for a, b in pairs_of(made):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        if w > 0 and h > 0:
            want.append((a[0], a[1], b[1], w * h, greedy.area(a[2:6]) + greedy.area(b[2:6]) - w * h))
    assert sorted(tuple(r) for r in spatial.overlaps(boxes, side=side).collect()) == sorted(want)


def test_uncovered_equals_all_pairs(boxes, made):
    want = []
    for a in made:
        covered = any(b[0] == a[0] and b[6] == "v" and None not in (*a, *b) and b[2] <= b[4] and greedy.iou(a[2:6], b[2:6]) > 0.3 for b in made)
        if a[6] != "v" and not covered:
            want.append(a[:2])
    assert sorted((r.page, r.ord) for r in spatial.uncovered(boxes, F.col("direction") == "v").collect()) == sorted(want)


def test_a_border_of_three_tenths(spark):
    # 30 of 100 shared is no more than three tenths, 31 is
    rows = [(0, 0, 0, 0, 65, 10, "h"), (0, 1, 35, 0, 100, 10, "v"), (1, 0, 0, 0, 66, 10, "h"), (1, 1, 34, 0, 100, 10, "v")]
    frame = spark.createDataFrame([(*x, "", "", "") for x in rows], SCHEMA)
    assert [(r.page, r.ord) for r in spatial.uncovered(frame, F.col("direction") == "v").collect()] == [(0, 0)]


def test_neighbours_equal_all_pairs(boxes, made):
    want = [(a[0], a[1], b[1], a[6]) for a, b in pairs_of(made) if greedy.adjacent(a[2:6], b[2:6], a[6])]
    assert len(want) > 50
    assert sorted(tuple(r) for r in spatial.adjacent_texts(boxes).collect()) == sorted(want)


def test_neighbours_of_a_full_page_are_dealt_out_once(spark, capsys):
    """One exchange serves both sides and both axes, and a box is on few squares; a direction may be missing."""
    r = random.Random(9)
    made = [(0, i, x, y, x + r.choice([0, 30, 120]), y + r.randrange(0, 40), r.choice(["h", "v", None])) for i in range(1500) for x, y in [(r.randrange(-50, 1000), r.randrange(0, 4000))]]
    frame = spark.createDataFrame(made, "page long, ord long, x0 long, y0 long, x1 long, y1 long, direction string").repartition(3)
    with_joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spatial.adjacent_texts(frame)
        got = found.collect()
        found.explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_joins)
    want = [(0, a[1], b[1], a[6] or b[6] or "h") for a, b in pairs_of(made) if greedy.adjacent(a[2:6], b[2:6], a[6] or b[6] or "h")]
    assert len(want) > 500 and sorted(map(tuple, got)) == sorted(want)
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    assert plan.count("SortMergeJoin") == 1 and "ReusedExchange" in plan


def test_squares_grow_where_boxes_are_few_above_each_other(spark):
    strip = frame(spark, "/root/testdata/sf0.01", "strip")
    page = spatial._crowded([(strip, spatial._plain)], ["page"]).first()
    put = spatial._spread(strip, {c: F.col(c) for c in spatial.BOX}, {a: F.lit(page[f"s{a}"]) for a in "xy"}, {a: F.lit(page[f"o{a}"]) for a in "xy"})
    assert put.count() < 1.5 * strip.count()
    # all boxes over each other: squares of twice their size, no more
    heap = spark.range(100).selectExpr("0 AS page", "0 AS x0", "0 AS y0", "40 + id % 2 AS x1", "30 AS y1")
    page = spatial._crowded([(heap, spatial._plain)], ["page"]).first()
    assert (page.sx, page.sy) == (81, 60)


def test_few_boxes_meet_on_their_page(spark, capsys):
    """No box is put on squares where no page has many; a table that meets itself is dealt out once."""
    frame = spark.createDataFrame([(p, i, 300 * i, 0, 300 * i + 500, 900, "h", "", "", "") for p in range(9) for i in range(5)], SCHEMA).repartition(3)
    with_joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spatial.overlaps(frame)
        assert found.count() == 36
        found.collect()
        found.explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_joins)
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    assert "Generate" not in plan and "ReusedExchange" in plan


def test_one_hot_page_is_spread(spark):
    """All boxes of the table on one page: no task gets much more than another,
    and the rows put on the grid grow with the boxes."""
    strip = frame(spark, "/root/testdata/sf0.01", "strip")
    put = spatial.on_grid(strip, {c: F.col(c) for c in spatial.BOX})
    sizes = [r["count"] for r in put.select(F.pmod(F.hash("row.page", "tx", "ty"), F.lit(64)).alias("task")).groupBy("task").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 1.5 * sum(sizes) / 64 and sum(sizes) < 4 * strip.count()


@pytest.mark.parametrize("side", [16, 128])
def test_suppression_equals_a_pass(spark, made, side):
    r, rounds, want = random.Random(1), [], []
    # near copies of each box, so that one goes for a better one that goes itself
    more = [(p, 1000 * k + o, x0 + 12 * k, y0 + k, x1 + 12 * k, y1 + k, d) for p, o, x0, y0, x1, y1, d in made if x0 is not None and x1 - x0 > 30 for k in (1, 2)]
    rows = [(*x[:6], x[6], r.choice([100, 250, 251, *range(300, 1000, 50)])) for x in [*made, *more]]
    # a chain of boxes, each over the next: every other one stays
    rows += [(5, 500 + i, 1000 + 14 * i, 0, 1040 + 14 * i, 20, "h", 900 - 50 * i) for i in range(6)]
    frame = spark.createDataFrame([(*x, "a") for x in rows], "page long, ord long, x0 long, y0 long, x1 long, y1 long, lang string, conf int, p string")
    for page in range(6):
        alive = sorted((-x[7], x[1], x) for x in rows if x[0] == page and x[7] > 250)[:100]
        stay = []
        for _, _, x in alive:
            if not any(s[6] == x[6] and None not in (*s, *x) and min(s[4] - s[2], s[5] - s[3], x[4] - x[2], x[5] - x[3]) >= 0 and greedy.iou(s[2:6], x[2:6]) > 0.45 for s in stay):
                stay.append(x)
        want += [(page, x[1], k) for k, x in enumerate(stay[:60], 1)]
    got = spatial.suppressed(frame, most=100, most_kept=60, side=side, rounds=rounds)
    assert sorted((x.page, x.ord, x.rank) for x in got.collect()) == sorted(want)
    assert len(rounds) > 2 and rounds[0] > 20 and rounds[-1] == 0
