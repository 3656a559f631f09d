"""Quadrilaterals of text lines (T10, G13, G15, G16, G18) and colour distance
(G17). Plain geometry over four corners each; ``described`` runs it over
Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Points = np.ndarray


def ordered(corners: Points) -> tuple[Points, bool]:
    """Corners as top left, top right, bottom right, bottom left, and whether
    the text runs down. The long sides' mean direction decides."""
    p = np.asarray(corners, float)
    sides = [p[j] - p[i] for i in range(4) for j in range(i + 1, 4)]
    sides.sort(key=lambda v: float(np.hypot(*v)))
    a, b = sides[2], sides[3]  # the two long sides; the diagonals come after
    mean = np.abs((a + (b if a @ b >= 0 else -b)) / 2)
    vertical = bool(mean[0] <= mean[1])
    axis = 1 if vertical else 0
    low, high = np.split(p[np.argsort(p[:, axis], kind="stable")], 2)
    if vertical:
        top, bottom = low[np.argsort(low[:, 0], kind="stable")], high[np.argsort(high[:, 0], kind="stable")]
        return np.array([top[0], top[1], bottom[1], bottom[0]]), True
    left, right = low[np.argsort(low[:, 1], kind="stable")], high[np.argsort(high[:, 1], kind="stable")]
    return np.array([left[0], right[0], right[1], left[1]]), False


class Quad:
    """Derived values of ordered corners. ``direction`` is 'h', 'v' or None."""

    def __init__(self, corners: Points, direction: str | None = None):
        self.p, self.direction = np.asarray(corners, float), direction
        middle = lambda i, j: np.trunc((self.p[i] + self.p[j]) / 2)
        self.middles = middle(0, 1), middle(2, 3), middle(1, 2), middle(3, 0)
        self.down, self.across = self.middles[1] - self.middles[0], self.middles[3] - self.middles[2]
        self.height, self.width = float(np.hypot(*self.down)), float(np.hypot(*self.across))
        self.font_size = min(self.height, self.width)
        self.aspect = self.width / self.height if self.height else math.inf
        self.centre = self.p.mean(0)
        self.low, self.high = self.p.min(0), self.p.max(0)

    def _cosines(self) -> list[float]:
        return [abs(float(v[k])) / n for v, n in ((self.down, self.height), (self.across, self.width)) if n for k in (0, 1)]

    @property
    def valid(self) -> bool:
        """Its two middle lines cross at nearly a right angle."""
        if not self.height or not self.width:
            return False
        return abs(math.degrees(math.acos(max(-1.0, min(1.0, float(self.down @ self.across) / (self.height * self.width))))) - 90) < 10

    @property
    def angle(self) -> float:
        return math.fmod(math.acos(max(-1.0, min(1.0, float(self.down[0]) / self.height))) + math.pi, math.pi) if self.height else 0.0

    @property
    def upright(self) -> bool:
        return any(c < 0.05 for c in self._cosines())


def hull(points: Points) -> Points:
    """Convex hull, counter-clockwise, without inner points of its sides."""
    p = sorted({(float(x), float(y)) for x, y in points})
    if len(p) < 3:
        return np.array(p)

    def half(ps):
        out: list[tuple[float, float]] = []
        for c in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def area(polygon: Points) -> float:
    if len(polygon) < 3:
        return 0.0
    x, y = polygon[:, 0], polygon[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def to_segment(p: Points, a: Points, b: Points) -> float:
    """From a point to a segment."""
    d = b - a
    n = float(d @ d)
    t = min(1.0, max(0.0, float((p - a) @ d) / n)) if n else 0.0
    return float(np.hypot(*(p - a - t * d)))


def _sides(polygon: Points) -> list[tuple[Points, Points]]:
    return [(polygon[i], polygon[(i + 1) % len(polygon)]) for i in range(len(polygon))]


def to_point(q: Quad, point: Points) -> float:
    """The least distance to a corner or side."""
    return min(to_segment(np.asarray(point, float), a, b) for a, b in _sides(q.p))


def _apart(a: Points, b: Points) -> bool:
    """Whether a side's normal separates two convex polygons."""
    for p in (a, b):
        for s, e in _sides(p):
            normal = np.array([e[1] - s[1], s[0] - e[0]])
            if (a @ normal).max() < (b @ normal).min() or (b @ normal).max() < (a @ normal).min():
                return True
    return False


def between(a: Quad, b: Quad) -> float:
    """Distance of the convex hulls; 0 where they meet."""
    p, q = hull(a.p), hull(b.p)
    if len(p) > 2 and len(q) > 2 and not _apart(p, q):
        return 0.0
    return min(min(to_segment(x, s, e) for x in p for s, e in _sides(q)), min(to_segment(x, s, e) for x in q for s, e in _sides(p)))


def reading_distance(a: Quad, b: Quad, rho: float = 0.5) -> float:
    """Along one direction, the distance of the edge on which two lines are
    aligned best: left, right or middle ones; top or bottom ones down the page."""
    if a.direction is None or a.direction != b.direction:
        return between(a, b)
    size = max(a.font_size, b.font_size)
    strip = lambda pairs: area(hull(np.array([x for q in (a, b) for x in pairs(q)]))) / size
    if a.direction == "h":
        edges = [(strip(lambda q: (q.p[0], q.p[3])), lambda q: q.p[0]), (strip(lambda q: (q.p[1], q.p[2])), lambda q: q.p[1]), (strip(lambda q: q.middles[:2]), lambda q: q.middles[0])]
    else:
        edges = [(strip(lambda q: (q.p[0], q.p[1])), lambda q: q.p[0]), (strip(lambda q: (q.p[2], q.p[3])), lambda q: q.p[2])]
    best = 0
    for i in range(1, len(edges)):
        if edges[i][0] < size * rho and all(edges[i][0] < edges[j][0] for j in range(i)):
            best = i
    corner = edges[best][1]
    return float(np.hypot(*(corner(a) - corner(b))))


def may_merge(a: Quad, b: Quad, ratio: float = 1.9, gap: float = 2, near: float = 0.6, aligned: float = 1.5, sizes: float = 1.5, aspects: float = 2) -> bool:
    """Whether two lines are of one block."""
    char, apart = min(a.font_size, b.font_size), between(a, b)
    if not char or apart > gap * char or max(a.font_size, b.font_size) / char > sizes:
        return False
    if any(x.aspect > aspects and y.aspect < 1 / aspects for x, y in ((a, b), (b, a))):
        return False
    if not (a.upright and b.upright):
        return abs(a.angle - b.angle) < math.radians(15) and apart <= aligned * char and abs(a.font_size - b.font_size) / char <= 0.25
    if apart >= near * char:
        return False
    (wa, ha), (wb, hb) = a.high - a.low, b.high - b.low
    if abs(a.low[0] + wa // 2 - (b.low[0] + wb // 2)) < aligned:
        return True
    wide, tall = (wa > ratio * ha, wb > ratio * hb), (ha > ratio * wa, hb > ratio * wb)
    if (wide[0] and tall[1]) or (wide[1] and tall[0]):
        return False
    axis = 0 if any(wide) else 1 if any(tall) else None
    return axis is not None and min(abs(a.low[axis] - b.low[axis]), abs(a.high[axis] - b.high[axis])) < aligned * char


def may_merge_coarse(a: Quad, b: Quad, gap: float = 2, sizes: float = 0.7) -> bool:
    small = min(a.font_size, b.font_size)
    return (
        a.direction == b.direction and small > 0 and abs(a.angle - b.angle) <= math.radians(15)
        and abs(a.font_size - b.font_size) / small <= sizes and between(a, b) <= gap * max(a.font_size, b.font_size)
    )


def unclipped(polygon: Points, ratio: float, steps: int = 8) -> Points:
    """A convex polygon grown by area x ratio / perimeter, with round corners
    of ``steps`` points each."""
    p = hull(np.asarray(polygon, float))
    if len(p) < 3:
        return p
    by = area(p) * ratio / sum(float(np.hypot(*(e - s))) for s, e in _sides(p))
    out = []
    for i in range(len(p)):
        before, after = p[i] - p[i - 1], p[(i + 1) % len(p)] - p[i]
        start = math.atan2(-before[0], before[1])
        turn = math.atan2(before[0] * after[1] - before[1] * after[0], float(before @ after))
        out += [p[i] + by * np.array([math.cos(start + turn * k / steps), math.sin(start + turn * k / steps)]) for k in range(steps + 1)]
    return np.array(out)


def lab(rgb: tuple[int, int, int]) -> np.ndarray:
    """CIE L*a*b* (D65) of 8-bit sRGB."""
    c = np.array(rgb, float) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]) @ c / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.array([116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])])


def colour_distance(a: tuple[int, int, int], b: tuple[int, int, int]) -> float:
    """Distance in L*a*b* of 8 bits a channel."""
    steps = [np.rint(lab(x) * (2.55, 1, 1)) for x in (a, b)]
    return float(np.linalg.norm((steps[0] - steps[1]) * (0.392, 1, 1)))


def described(boxes: DataFrame) -> DataFrame:
    """G13, T10 over boxes (page, ord, x0, y0, x1, y1): direction, font size,
    aspect in thousandths, validity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, o, x0, y0, x1, y1 in b.itertuples(index=False, name=None):
                corners, vertical = ordered(np.array([[x1, y1], [x0, y0], [x1, y0], [x0, y1]]))
                q = Quad(corners)
                rows.append((page, o, "v" if vertical else "h", int(q.font_size), int(1000 * q.aspect) if math.isfinite(q.aspect) else -1, q.valid))
            yield pd.DataFrame(rows, columns=["page", "ord", "direction", "font_size", "aspect", "valid"])

    return boxes.select("page", "ord", "x0", "y0", "x1", "y1").mapInPandas(run, "page long, ord int, direction string, font_size long, aspect long, valid boolean")
