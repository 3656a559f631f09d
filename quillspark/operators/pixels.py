"""Pixel operators over image arrays, with numpy only: flood fill, masks,
colour counts, density, crops, row fill. Model stages (detection, recognition,
inpainting, drawing) are interfaces in ``engines``."""

from __future__ import annotations

from collections import deque

import numpy as np


def density(gray: np.ndarray, dark: int = 128) -> float:
    """Share of dark pixels as a stand-in confidence, 0.3 to 0.95."""
    return min(0.95, 0.3 + float((gray < dark).mean())) if gray.size else 0.3


def mask_overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Shared pixels over the smaller mask."""
    return float((a & b).sum()) / max(1, min(int(a.sum()), int(b.sum())))


def coverage(mask: np.ndarray, box: tuple[int, int, int, int]) -> float:
    x0, y0, x1, y1 = box
    part = mask[y0:y1, x0:x1]
    return float(part.mean()) if part.size else 0.0


def flood(gray: np.ndarray, seed: tuple[int, int], tolerance: int = 40) -> np.ndarray:
    """The 4-connected area around (x, y) whose values are within the tolerance of the seed's."""
    h, w = gray.shape
    out = np.zeros((h, w), bool)
    x, y = seed
    base = int(gray[y, x])
    todo = deque([(x, y)])
    out[y, x] = True
    while todo:
        x, y = todo.popleft()
        for a, b in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if 0 <= a < w and 0 <= b < h and not out[b, a] and abs(int(gray[b, a]) - base) <= tolerance:
                out[b, a] = True
                todo.append((a, b))
    return out


def labelled(mask: np.ndarray) -> list[np.ndarray]:
    """4-connected components of a mask, in reading order of their first pixel."""
    left, out = mask.copy(), []
    for y, x in np.argwhere(mask):
        if left[y, x]:
            part = flood(left.astype(np.uint8), (x, y), 0) & left
            left &= ~part
            out.append(part)
    return out


def crops(mask: np.ndarray, near: int = 14, context: int = 40) -> list[tuple[int, int, int, int]]:
    """Boxes around what is masked, near ones joined, widened; the whole page if they cover 85 % of it."""
    h, w = mask.shape
    boxes = []
    for part in labelled(mask):
        y, x = np.nonzero(part)
        boxes.append([int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1])
    again = True
    while again:
        again = False
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                a, b = boxes[i], boxes[j]
                if max(a[0], b[0]) - min(a[2], b[2]) <= near and max(a[1], b[1]) - min(a[3], b[3]) <= near:
                    boxes[i] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
                    del boxes[j]
                    again = True
                    break
            if again:
                break
    wide = [(max(0, a - context), max(0, b - context), min(w, c + context), min(h, d + context)) for a, b, c, d in boxes]
    if sum((c - a) * (d - b) for a, b, c, d in wide) >= 0.85 * w * h:
        return [(0, 0, w, h)]
    return wide


def filled_rows(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Each masked run of a row gets the median of the pixels beside it."""
    out = image.copy()
    for y in range(image.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2]):
            side = np.concatenate([image[y, max(0, a - 5) : a], image[y, b : b + 5]])
            if len(side):
                out[y, a:b] = np.median(side, axis=0)
    return out


def top_colours(gray: np.ndarray, k: int = 3, bins: int = 32, apart: int = 10) -> list[int]:
    """The most frequent values, at least ``apart`` from one another."""
    count, edge = np.histogram(gray, bins, (0, 256))
    out: list[int] = []
    for i in np.argsort(-count, kind="stable"):
        value = int((edge[i] + edge[i + 1]) / 2)
        if count[i] and all(abs(value - o) >= apart for o in out):
            out.append(value)
        if len(out) == k:
            break
    return out


def ink_runs(gray: np.ndarray, dark: int = 170) -> list[tuple[int, int]]:
    """W6, A.9: runs of columns with ink, after three-tap smoothing."""
    h = gray.shape[0]
    active = (gray < dark).sum(0) >= max(1, round(0.08 * h))
    active = np.convolve(active, np.ones(3), "same") >= 2
    edge = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]


def barrier(gray: np.ndarray, vertical: bool, dark: int = 150) -> bool:
    """J23, A.6: whether a long thin dark line crosses a corridor."""
    mask = gray < dark
    if vertical:
        mask = mask.T
    span = mask.shape[1]
    need = max(6, 0.45 * span)
    for part in labelled(mask):
        y, x = np.nonzero(part)
        if x.max() - x.min() + 1 >= need and len(x) >= need and y.max() - y.min() + 1 <= max(12, 0.45 * span):
            return True
    return False
