"""Column splits against a plain stack of groups."""

import random
import re
from statistics import median

import pytest
from pyspark.sql import functions as F

from quillspark.operators import splits

SCHEMA = "page long, ord int, text string, lang string, direction string, x0 long, y0 long, x1 long, y1 long"
WORDS = splits.CONJUNCTIONS


def share(a0, a1, b0, b1):
    return max(0, min(a1, b1) - max(a0, b0)) / max(1, min(a1 - a0, b1 - b0))


def joins(side):
    top = min(side, key=lambda r: (r[6], r[5], r[5] + r[7], r[1]))
    return (re.match("[A-Za-z]+", (top[2] or "").lstrip(" ")) or [""])[0].upper() in WORDS


def best_cut(group):
    if len(group) < 4 or any(r[4] not in (None, "h") for r in group) or not {r[3] for r in group} & {"en", "zh"}:
        return None
    line, high, best = sorted(group, key=lambda r: (r[5] + r[7], r[1])), median(max(1, r[8] - r[6]) for r in group), None
    for cut in range(2, len(line) - 1):
        l, r = line[:cut], line[cut:]
        gutter = min(x[5] for x in r) - max(x[7] for x in l)
        over = share(min(x[6] for x in l), max(x[8] for x in l), min(x[6] for x in r), max(x[8] for x in r))
        gap = (median(x[5] + x[7] for x in r) - median(x[5] + x[7] for x in l)) / 2
        if gutter < max(6, 0.3 * high) or over < 0.3 or gap < max(3 * high, 1.5 * gutter) or (joins(l) and joins(r)):
            continue
        score = gutter + gap * 0.25 + over * high
        if best is None or score > best[0]:
            best = (score, l, r)
    return best and best[1:]


def brute(rows):
    out, pending = {}, [("", [r for r in rows if r[0] == p]) for p in {r[0] for r in rows}]
    while pending:
        part, group = pending.pop()
        cut = best_cut(group)
        if cut:
            pending += [(part + "0", cut[0]), (part + "1", cut[1])]
        else:
            out |= {r[:2]: part for r in group}
    return out


def compact(side):
    hull = (max(r[7] for r in side) - min(r[5] for r in side)) * (max(r[8] for r in side) - min(r[6] for r in side))
    return len(side) == 1 or max(1, hull) <= 2.2 * sum(max(1, (r[7] - r[5]) * (r[8] - r[6])) for r in side)


def brute_half(group):
    kinds = {r[4] for r in group}
    upright, level = kinds <= {None, "v"} and "v" in kinds, kinds <= {None, "h"}
    if len(group) < 2 or not (upright or level):
        return None
    high, wide = (median(max(1, r[b] - r[a]) for r in group) for a, b in ((6, 8), (5, 7)))
    for a, b, c, d, least, scale in ((5, 7, 6, 8, max(2, 0.6 * wide) if upright else max(2, 0.4 * high), high), *([(6, 8, 5, 7, max(2, 0.2 * wide), wide)] if upright else [])):
        line, best = sorted(group, key=lambda r: (r[a] + r[b], r[1])), None
        for cut in range(1, len(line)):
            l, r = line[:cut], line[cut:]
            gutter, over = min(x[a] for x in r) - max(x[b] for x in l), share(min(x[c] for x in l), max(x[d] for x in l), min(x[c] for x in r), max(x[d] for x in r))
            if gutter >= least and over >= 0.25 and compact(l) and compact(r) and (best is None or gutter + over * scale > best[0]):
                best = (gutter + over * scale, {x[1] for x in l})
        if best:
            return best[1]
    return None


@pytest.fixture(scope="module")
def rows():
    r, out = random.Random(2), []
    for page in range(60):
        columns, upright = r.randint(1, 5), r.random() < 0.3
        for i in range(r.randint(1, 16)):
            c = r.randrange(columns)
            x, y = 150 * c + r.randrange(30), 30 * r.randrange(8) + r.randrange(5)
            w, h = (r.randint(8, 20), r.randint(40, 90)) if upright else (r.randint(30, 110), r.randint(8, 20))
            text = r.choice(["and so", " But", "hello", "orange", None, "THEN x"])
            out.append((page, i, text, r.choice(["en", "zh", "ja"]) if page % 7 else "ja", r.choice(["v", "v", None]) if upright else r.choice(["h", "h", "h", None]), x, y, x + w, y + h))
    return out


def test_side_by_side(spark, rows):
    rounds = []
    got = splits.side_by_side(spark.createDataFrame(rows, SCHEMA).repartition(3), ["page"], rounds=rounds).collect()
    want = brute(rows)
    assert {(r.page, r.ord): r.part for r in got} == want and len(got) == len(rows)
    assert max(map(len, want.values())) >= 3 and rounds[0] > rounds[-2] > rounds[-1] == 0


def test_separated(spark, rows):
    rows = [r for r in rows if r[1] < 4 or r[0] % 5 == 0]  # smaller groups are compact more often
    got = splits.separated(spark.createDataFrame(rows, SCHEMA).repartition(3), ["page"]).collect()
    want, cut = {}, 0
    for page in range(60):
        group = [r for r in rows if r[0] == page]
        left = brute_half(group)
        cut += left is not None
        want |= {r[:2]: None if left is None else "0" if r[1] in left else "1" for r in group}
    assert {(r.page, r.ord): r.half for r in got} == want and cut >= 4


def test_partitions_go_by_the_size_of_the_tables(spark, tmp_path):
    """A task has as much to sort however large the tables are; small ones stay as they are."""
    from quillspark.sources.frames import frame
    from quillspark.sources.shared import dealt

    r = spark.range(2_000_000).select("id", F.md5(F.col("id").cast("string")).alias("x"))
    r.coalesce(1).write.parquet(str(tmp_path / "large"))
    large = spark.read.parquet(str(tmp_path / "large"))
    size = sum(p.stat().st_size for p in (tmp_path / "large").glob("*.parquet"))
    assert dealt(large, ["id"]).rdd.getNumPartitions() == -(-size // (4 << 20)) > 4
    assert dealt(large.limit(5), ["id"], 1000).rdd.getNumPartitions() == 1
    regions = frame(spark, "/root/testdata/sf0.1", "turn_regions")
    assert "REPARTITION_BY_NUM" not in regions._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        regions = frame(spark, "/root/testdata/sf0.1", "turn_regions")
        assert "REPARTITION_BY_NUM" in regions._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
