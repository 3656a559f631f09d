"""Matches and precision against a pass over the boxes."""

import random

from quillspark.operators import evaluation, greedy

TRUTH, FOUND = "page int, ord int, x0 int, y0 int, x1 int, y1 int, ignore boolean", "page int, ord int, x0 int, y0 int, x1 int, y1 int, conf int"


def part(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return max(0, w) * max(0, h)


def brute(truth, found):
    aside = {f[:2] for f in found for t in truth if t[6] and t[0] == f[0] and 2 * part(t[2:6], f[2:6]) > greedy.area(f[2:6])}
    taken, out = set(), []
    for t in sorted(truth):
        for f in sorted(found):
            if not t[6] and t[0] == f[0] and f[:2] not in aside | taken and greedy.iou(t[2:6], f[2:6]) > 0.5:
                taken.add(f[:2])
                out.append((t[0], t[1], f[1]))
                break
    return out, aside


def test_evaluation_equals_a_pass(spark):
    r, truth, found = random.Random(8), [], []
    for page in range(40):
        for i in range(r.randint(0, 12) if page % 9 else 0):
            x, y, w, h = r.randrange(200), r.randrange(100), r.randint(20, 60), r.randint(10, 30)
            truth.append((page, i, x, y, x + w, y + h, r.random() < 0.2))
            if r.random() < 0.3:  # nearly the same box once more
                truth.append((page, 20 + i, x + 2, y, x + w, y + h, False))
            for k in range(r.choice([0, 1, 1, 2, 3])):
                dx, dy = r.randint(-6, 6), r.randint(-3, 3)
                found.append((page, 10 * i + k, x + dx, y + dy, x + w + dx, y + h + dy, r.choice([None, *range(5)])))
        found += [(page, 900, 5, 5, 5, 9, 1)] if page % 4 == 0 else []  # without an area
    t, f = spark.createDataFrame(truth, TRUTH).repartition(3), spark.createDataFrame(found, FOUND).repartition(3)
    want, aside = brute(truth, found)
    rounds = []
    got = evaluation.matches(t, f, rounds=rounds)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(rounds) > 2
    assert {tuple(x) for x in evaluation.set_aside(t, f).collect()} == aside and aside
    pages = {x.page: x for x in evaluation.evaluated(t, f, matched=got).collect()}
    assert set(pages) == {x[0] for x in truth} | {x[0] for x in found}
    for page, x in pages.items():
        m, n, k = sum(w[0] == page for w in want), sum(a[0] == page and not a[6] for a in truth), sum(a[0] == page and a[:2] not in aside for a in found)
        p, q = (0 if k else 1, 1) if n == 0 else (m / k if k else 0, m / n)
        mean = 0 if p + q == 0 else 2 * p * q / (p + q)
        assert (x.matched, x.truth, x.found) == (m, n, k) and all(abs(a - b * 1e6) <= 1 for a, b in ((x.precision6, p), (x.recall6, q), (x.hmean6, mean)))
    ranked = sorted((-(a[6] or 0), *a[:2]) for a in found if a[:2] not in aside)
    hit, correct, total = {(p, d) for p, _, d in want}, 0, 0
    for k, (_, *key) in enumerate(ranked, 1):
        if tuple(key) in hit:
            correct += 1
            total += 1_000_000 * correct // k
    care = sum(not a[6] for a in truth)
    assert tuple(evaluation.average_precision(t, f, matched=got).first()) == (len(want), care, len(ranked), total // care)


def test_nothing_to_match(spark):
    t, f = spark.createDataFrame([], TRUTH), spark.createDataFrame([(1, 1, 0, 0, 9, 9, 5)], FOUND)
    assert evaluation.matches(t, f).count() == 0
    assert tuple(evaluation.evaluated(t, f).first()) == (1, 0, 0, 1, 0, 1_000_000, 0)
    assert tuple(evaluation.average_precision(t, f).first()) == (0, 0, 1, 0)
    assert tuple(evaluation.average_precision(t, f.limit(0)).first()) == (0, 0, 0, 0)
