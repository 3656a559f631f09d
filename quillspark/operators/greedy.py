"""Order-dependent region operators: each page's rows, in list order, go
through a greedy pass that no set operation expresses. A page is a group, so
the passes run in parallel over pages; a page holds a bounded number of boxes.
Also the packing of texts into chunks, which is a fold over an ordered array.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Box = tuple[int, int, int, int]


def overlap(a0: int, a1: int, b0: int, b1: int) -> float:
    """Shared extent over the smaller one (1 at least)."""
    return max(0, min(a1, b1) - max(a0, b0)) / max(1, min(a1 - a0, b1 - b0))


def gap(a0: int, a1: int, b0: int, b1: int) -> int:
    return max(0, max(a0, b0) - min(a1, b1))


def area(a: Box) -> int:
    return (a[2] - a[0]) * (a[3] - a[1])


def union(a: Box, b: Box) -> Box:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def iou(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / (area(a) + area(b) - w * h)


def merged_boxes(boxes: list[Box], least: float = 0.4, near: int = 30) -> list[Box]:
    """Boxes in (y, x) order; each joins the first one so far on its row and near by."""
    out: list[Box] = []
    for b in sorted(boxes, key=lambda b: (b[1], b[0])):
        for i, o in enumerate(out):
            if overlap(o[1], o[3], b[1], b[3]) > least and gap(o[0], o[2], b[0], b[2]) < near:
                out[i] = union(o, b)
                break
        else:
            out.append(b)
    return out


def suppressed(rows: list[tuple[int, Box, float]], limit: float = 0.3, most: int = 300) -> list[int]:
    """Non-maximum suppression: the numbers kept, best first."""
    kept: list[tuple[int, Box]] = []
    for n, box, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if all(iou(box, k) <= limit for _, k in kept):
            kept.append((n, box))
        if len(kept) == most:
            break
    return [n for n, _ in kept]


def assigned(detections: list[Box], targets: list[Box]) -> list[int | None]:
    """Each detection, in order, takes the nearest target not yet taken; None is left over."""
    free, out = list(range(len(targets))), []
    for d in detections:
        best = min(free, key=lambda t: ((d[0] + d[2] - targets[t][0] - targets[t][2]) ** 2 + (d[1] + d[3] - targets[t][1] - targets[t][3]) ** 2, t), default=None)
        out.append(best)
        if best is not None:
            free.remove(best)
    return out


def adjacent(a: Box, b: Box, direction: str | None) -> bool:
    """A.4 of the survey."""
    ox, oy = overlap(a[0], a[2], b[0], b[2]), overlap(a[1], a[3], b[1], b[3])
    gx, gy = gap(a[0], a[2], b[0], b[2]), gap(a[1], a[3], b[1], b[3])
    w, h = max(a[2] - a[0], b[2] - b[0]), max(a[3] - a[1], b[3] - b[1])
    if direction == "v":
        return (oy >= 0.45 and gx <= 1.5 * w) or (ox >= 0.5 and gy <= 0.25 * h)
    return (ox >= 0.45 and gy <= 1.5 * h) or (oy >= 0.5 and gx <= 0.25 * w)


def fit_score(group: Box, members: list[tuple[Box, str | None]], box: Box, direction: str | None) -> float:
    """How well a box goes with a group, without masks (A.5)."""
    both = union(group, box)
    if area(both) > 1.6 * (area(group) + area(box)):
        return 0.0
    if area(both) > 2.2 * (sum(area(b) for b, _ in members) + area(box)):
        return 0.0
    if not any(adjacent(b, box, d or direction) and (d is None or direction is None or d == direction) for b, d in members):
        return 0.0
    w, h = min(group[2], box[2]) - max(group[0], box[0]), min(group[3], box[3]) - max(group[1], box[1])
    share = max(0, w) * max(0, h) / max(1, min(area(group), area(box)))
    if share >= 0.45:
        return 1 + share
    if (group[0] <= box[0] and group[1] <= box[1] and group[2] >= box[2] and group[3] >= box[3]) or (
        box[0] <= group[0] and box[1] <= group[1] and box[2] >= group[2] and box[3] >= group[3]
    ):
        return 1.0
    pad = min(group[2] - group[0], group[3] - group[1]) // 5
    wide = (group[0] - pad, group[1] - pad, group[2] + pad, group[3] + pad)
    w, h = min(wide[2], box[2]) - max(wide[0], box[0]), min(wide[3], box[3]) - max(wide[1], box[1])
    return 0.5 if max(0, w) * max(0, h) / max(1, min(area(wide), area(box))) > 0.15 else 0.0


def grouped(boxes: list[tuple[Box, str | None]]) -> list[int]:
    """Each box joins the group it fits best, or opens one (J13); then groups that
    overlap merge, pair by pair, until none does (J14). The group of each box."""
    groups: list[dict] = []
    for i, (box, direction) in enumerate(boxes):
        scores = [fit_score(g["box"], g["members"], box, direction) for g in groups]
        best = max(range(len(groups)), key=lambda k: (scores[k], -k), default=None)
        if best is not None and scores[best] > 0:
            g = groups[best]
            g["box"] = union(g["box"], box)
            g["members"].append((box, direction))
            g["rows"].append(i)
        else:
            groups.append({"box": box, "members": [(box, direction)], "rows": [i]})
    again = True
    while again:
        again = False
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = groups[i], groups[j]
                if fit_score(a["box"], a["members"], b["box"], b["members"][0][1]) > 1:
                    groups[i] = {"box": union(a["box"], b["box"]), "members": a["members"] + b["members"], "rows": a["rows"] + b["rows"]}
                    del groups[j]
                    again = True
                    break
            if again:
                break
    out = [0] * len(boxes)
    for n, g in enumerate(groups):
        for i in g["rows"]:
            out[i] = n
    return out


#: Column numbers of a region in the rows that a pass gets.
_COLUMNS = ("page", "lang", "ord", "x0", "y0", "x1", "y1", "conf", "direction")


def _by_page(regions: DataFrame, keys: tuple[str, ...], one: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Apply ``one`` to each page's rows in list order. Pages are dealt into
    buckets, several to a bucket, so that a call handles many pages."""
    n = 16 * int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part[list(_COLUMNS)].sort_values([*keys, "ord"])
        key = [_COLUMNS.index(k) for k in keys]
        out: list[tuple] = []
        for _, rows in groupby(part.itertuples(index=False, name=None), lambda r: tuple(r[k] for k in key)):
            out.extend(one(list(rows)))
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({c: "Int32" for c in names if f"{c} int" in schema})

    dealt = regions.select(*_COLUMNS).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(n)))
    return dealt.groupBy("bucket").applyInPandas(run, schema)


def _box(row: tuple) -> Box:
    return row[3:7]


def merge_boxes(regions: DataFrame) -> DataFrame:
    """Page, x0, y0, x1, y1 of merged boxes."""
    return _by_page(regions, ("page",), lambda rows: [(rows[0][0], *b) for b in merged_boxes([_box(r) for r in rows])], "page long, x0 long, y0 long, x1 long, y1 long")


def assign_detections(regions: DataFrame) -> DataFrame:
    """Page, detection, target (null if left over); horizontal boxes are the
    detections, vertical ones the targets."""

    def one(rows: list[tuple]) -> list[tuple]:
        found, targets = [r for r in rows if r[8] == "h"], [r for r in rows if r[8] == "v"]
        got = assigned([_box(r) for r in found], [_box(r) for r in targets])
        return [(r[0], r[2], None if g is None else targets[g][2]) for r, g in zip(found, got)]

    return _by_page(regions, ("page",), one, "page long, detection int, target int")


def group_regions(regions: DataFrame) -> DataFrame:
    """Page, ord, grp."""
    return _by_page(regions, ("page",), lambda rows: [(r[0], r[2], g) for r, g in zip(rows, grouped([(_box(r), r[8]) for r in rows]))], "page long, ord int, grp int")


def pack_chunks(lines: DataFrame, most_items: int = 24, most_chars: int = 6000) -> DataFrame:
    """Grp, ord, chunk. A new chunk starts at ``most_items`` lines, or when the lengths
    (each with 16 more) would exceed ``most_chars``."""
    ordered = lines.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("ord", (F.length("text") + 16).alias("cost")))).alias("rows"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("items"), F.lit(0).alias("chars"), F.array().cast("array<struct<ord:bigint,chunk:int>>").alias("out"))

    def step(acc, row):
        new = (acc["items"] > 0) & ((acc["items"] >= most_items) | (acc["chars"] + row["cost"] > most_chars))
        chunk = acc["chunk"] + new.cast("int")
        return F.struct(
            chunk.alias("chunk"),
            F.when(new, 1).otherwise(acc["items"] + 1).alias("items"),
            F.when(new, row["cost"]).otherwise(acc["chars"] + row["cost"]).alias("chars"),
            F.concat(acc["out"], F.array(F.struct(row["ord"].cast("bigint").alias("ord"), chunk.alias("chunk")))).alias("out"),
        )

    return ordered.select("grp", F.explode(F.aggregate("rows", start, step)["out"]).alias("r")).select("grp", F.col("r.ord").alias("ord"), F.col("r.chunk").alias("chunk"))
