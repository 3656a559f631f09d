"""Ink gaps and fragments against pixels and a plain loop."""

import random

import numpy as np

from quillspark.operators import fragments, ink


def by_pixels(x0, y0, x1, y1, text, direction, marks):
    w, h = x1 - x0, y1 - y0
    whole = [(None, x0, y0, x1, y1)]
    if direction not in (None, "h") or w < 80 or h < 8 or w / h < 6 or text.strip().count(" ") < 2:
        return whole
    on = np.zeros(w, np.uint8)
    for a, b in marks:
        on[max(0, a) : max(0, b)] = 1
    on = np.convolve(on, np.ones(3, np.uint8), mode="same") >= 2
    runs, start = [], None
    for i, v in enumerate([*on, True]):
        if not v and start is None:
            start = i
        if v and start is not None:
            runs.append((start, i))
            start = None
    margin = max(4, round(h * 0.45))
    runs = [r for r in runs if r[0] >= margin and r[1] <= w - margin]
    if not runs:
        return whole
    a, b = max(runs, key=lambda r: r[1] - r[0])
    left, right = np.flatnonzero(on[:a]), np.flatnonzero(on[b:])
    if b - a < max(8, round(h * 0.55)) or not len(left) or not len(right) or min(left[-1] - left[0] + 1, right[-1] - right[0] + 1) < max(16, round(h * 1.4)):
        return whole
    pad = min(3, max(1, (b - a) // 4))
    return [("left", x0, y0, min(x1, x0 + a + pad), y1), ("right", max(x0, x0 + b - pad), y0, x1, y1)]


def test_ink_splits_equal_pixels(spark):
    r, lines, marks = random.Random(6), [], []
    for i in range(400):
        w, h, x, y = r.randint(60, 400), r.randint(6, 30), r.randrange(50), r.randrange(50)
        at, own = r.randint(0, 10), []
        while at < w:
            size = r.choice([1, 1, 2, 8, 20, 40])
            own.append((at - r.choice([0, 0, 3]), min(at + size, w + 9)))
            at += size + r.choice([0, 1, 1, 2, 5, 9, 25])
        lines.append((i, x, y, x + w, y + h, r.choice(["a b c", "ab", " a b ", "one two three four"]), r.choice(["h", "h", "h", None, "v"])))
        marks += [(i, a, b) for a, b in own if i % 20] + [(i, 5, 5)]
    got = ink.split_lines(spark.createDataFrame(lines, "id int, x0 int, y0 int, x1 int, y1 int, text string, direction string").repartition(3), spark.createDataFrame(marks, "id int, a int, b int"), ["id"]).collect()
    want = sorted((i, str(s), *box) for i, *line in lines for s, *box in by_pixels(*line, [m[1:] for m in marks if m[0] == i]))
    assert sorted((r.id, str(r.side), r.x0, r.y0, r.x1, r.y1) for r in got) == want
    assert sum(x[1] == "left" for x in want) > 20


def brute_merge(rows):
    frag = lambda t: 0 < len((t or "").strip()) <= 2 and set((t or "").strip()) <= set(fragments.MARKS)
    mains, frags = [dict(o=r[1], t=r[2] or "", d=r[3] or "", b=list(r[4:]), n=1) for r in rows if not frag(r[2])], [r for r in rows if frag(r[2])]
    if not mains or not frags:
        return [(r[0], r[1], r[2] or "", *r[4:], 1) for r in rows]
    for _, _, t, d, *b in frags:
        m = min(mains, key=lambda m: (m["b"][0] + m["b"][2] - b[0] - b[2]) ** 2 + (m["b"][1] + m["b"][3] - b[1] - b[3]) ** 2)
        k = 1 if (m["d"] or d or "") == "v" else 0
        behind = b[k] + b[k + 2] >= m["b"][k] + m["b"][k + 2]
        m["t"] = m["t"] + t.strip() if behind else t.strip() + m["t"]
        m["b"] = [min(m["b"][0], b[0]), min(m["b"][1], b[1]), max(m["b"][2], b[2]), max(m["b"][3], b[3])]
        m["n"] += 1
    return [(rows[0][0], m["o"], m["t"], *m["b"], m["n"]) for m in mains]


def test_fragments_equal_a_loop(spark):
    r, pages = random.Random(3), []
    for page in range(40):
        rows = []
        for i in range(r.randint(1, 12)):
            x, y = 10 * r.randrange(12), 10 * r.randrange(12)
            rows.append((page, i, r.choice(["text", "！", "…。", " ? ", "abc", "!x", "", None, "...", "--"]) if page % 6 else r.choice(["!", "?"]), r.choice(["h", "v", None]), x, y, x + 10 * r.randint(1, 4), y + 10 * r.randint(1, 4)))
        pages.append(rows)
    frame = spark.createDataFrame([x for p in pages for x in p], "page int, ord int, text string, direction string, x0 int, y0 int, x1 int, y1 int").repartition(3)
    got = sorted(tuple(x) for x in fragments.merged_fragments(frame).collect())
    assert got == sorted(x for p in pages for x in brute_merge(p))
    assert max(x[-1] for x in got) >= 4
