"""Mask and map operators over arrays, with numpy only: bit operations (U5), grey
thresholds and mask refinement (T13, M5), reliability and border tests (P29,
P30), look-up of components (J19), stitching of tiles (W13), growing a box (G21),
boxes from a score map (G23), beam search over scores (W14), erase masks (M12),
crops (M4), and image files (K14). Models are not here: their scores come in."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence

import numpy as np

from . import quads
from .pixels import labelled

Box = tuple[int, int, int, int]


def combined(kind: str, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """U5: 'or', 'and', 'xor' of two masks of 0 and 255, or 'not' of one."""
    return {"or": lambda: np.maximum(a, b), "and": lambda: np.minimum(a, b), "xor": lambda: a ^ b, "not": lambda: 255 - a}[kind]()


def grown(mask: np.ndarray, by: int = 1) -> np.ndarray:
    """Dilation by a square of 2 by + 1."""
    h, w = mask.shape
    wide = np.pad(mask, by)
    return np.max([wide[y : y + h, x : x + w] for y in range(2 * by + 1) for x in range(2 * by + 1)], axis=0)


def shrunk(mask: np.ndarray, by: int = 1) -> np.ndarray:
    return 255 - grown(255 - mask, by)


def otsu(gray: np.ndarray) -> int:
    """The grey level that parts the histogram into classes of least variance."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    low, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    high = low[-1] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * high * (total / low - (total[-1] - total) / high) ** 2
    return int(np.nan_to_num(between).argmax())


def nearer(candidate: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, int]:
    """The candidate or its negative, whichever differs less from the mask."""
    both = [(c, int((c ^ mask).astype(np.int64).sum())) for c in (candidate, 255 - candidate)]
    return min(both, key=lambda c: c[1])


def candidates(image: np.ndarray, gray: np.ndarray, mask: np.ndarray, colours: Sequence[int], spread: int = 30) -> list[tuple[np.ndarray, int]]:
    """Masks by the best channel's threshold and by each grey of the
    text, those nearest to the model's mask first."""
    channels = [nearer(np.where(image[..., c] > otsu(image[..., c]), 255, 0).astype(np.uint8), mask) for c in range(3)]
    out = [min(channels, key=lambda c: c[1])]
    for colour in colours:
        top = min(colour + spread, 255)
        out.append(nearer(np.where((gray >= top - 2 * spread) & (gray <= top), 255, 0).astype(np.uint8), mask))
    return sorted(out, key=lambda c: c[1])


def refined(found: list[tuple[np.ndarray, int]], mask: np.ndarray) -> np.ndarray:
    """M5: parts of the candidates that bring the union nearer to the model's mask,
    widened, with all but the largest gap filled where that brings it nearer too."""
    goal = np.where(shrunk(mask) > 60, 255, 0).astype(np.uint8)
    out = np.zeros_like(mask)

    def add(part: np.ndarray) -> None:
        if (part & (out == 0) & (goal > 0)).sum() > (part & (out == 0) & (goal == 0)).sum():
            out[part] = 255

    for candidate, _ in found:
        for part in labelled(candidate > 0):
            if part.any(0).sum() * part.any(1).sum() >= 3:
                add(part)
    out = grown(out, 2)
    gaps = sorted(labelled(out == 0), key=lambda g: int(g.sum()))
    for gap in gaps[:-1]:
        add(gap)
    return out


def reliable(mask: np.ndarray, group: Box, strokes: np.ndarray, text_area: int) -> bool:
    """A bubble mask is at most six times the text's area, its bounds are
    within 15 % of the group's, and it covers 85 % of the strokes."""
    y, x = np.nonzero(mask)
    if not len(x) or len(x) > 6 * max(1, text_area):
        return False
    w, h = group[2] - group[0], group[3] - group[1]
    near = all(abs(a - b) <= 0.15 * n for a, b, n in zip((x.min(), y.min(), x.max() + 1, y.max() + 1), group, (w, h, w, h)))
    return near and (not strokes.any() or float((mask & strokes).sum() / strokes.sum()) >= 0.85)


def in_bubble(gray: np.ndarray, box: Box, bright: int = 200, least: float = 0.30) -> bool:
    """Enough bright pixels in the box."""
    part = gray[box[1] : box[3], box[0] : box[2]]
    return bool(part.size and (part > bright).mean() > least)


def noisy_border(binary: np.ndarray, ignore: float) -> bool:
    """The border of a region is neither mostly paper nor mostly ink."""
    edge = np.concatenate([binary[0], binary[-1], binary[1:-1, 0], binary[1:-1, -1]])
    share = float((edge > 0).mean()) if edge.size else 0.0
    return ignore / 100 < share < 1 - ignore / 100


def best_holder(parts: list[Box], holders: list[Box]) -> list[int | None]:
    """For each component the box that shares most with it, if any does."""
    shared = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    out = []
    for p in parts:
        best = max(range(len(holders)), key=lambda i: (shared(p, holders[i]), -i), default=None)
        out.append(best if best is not None and shared(p, holders[best]) > 0 else None)
    return out


def tile_plan(height: int, width: int, size: int = 1280) -> list[int] | None:
    """The tops of square-row tiles of a page that is long enough, else None."""
    if height / size <= 2.5 or height / width <= 3:
        return None
    tile = max(2 * size // width, 2) * width
    n = -(-height // tile)
    step = (height - tile) // (n - 1) if n > 1 else 0
    return [i * step for i in range(n)]


def stitched(tiles: list[np.ndarray], tops: list[int], height: int) -> np.ndarray:
    """Tiles laid one over the other; where two meet, their mean."""
    out = np.zeros((height, *tiles[0].shape[1:]), np.float32)
    done = 0
    for tile, top in zip(tiles, tops):
        end = min(top + len(tile), height)
        out[top:end] += tile[: end - top]
        out[top : min(done, end)] /= 2
        done = max(done, end)
    return out


def grown_box(gradient: np.ndarray, box: Box, step: int = 3, most: float = 1.8, edge: float = 40.0, share: float = 0.06) -> Box | None:
    """A box that grows side by side while the strip it takes has few edges,
    up to ``most`` times its size about its centre; None if it can't grow."""
    h, w = gradient.shape
    x0, y0, x1, y1 = box
    if x1 <= x0 or y1 <= y0:
        return None
    limit = max(edge, 1.5 * float(gradient[y0:y1, x0:x1].mean()) + 8)
    cx, cy, rx, ry = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) * most / 2, (y1 - y0) * most / 2
    low, high = (max(0, int(cx - rx)), max(0, int(cy - ry))), (min(w, int(cx + rx)), min(h, int(cy + ry)))
    calm = lambda a, b, c, d: not (s := gradient[b:d, a:c]).size or float((s > limit).mean()) <= share
    grew = True
    while grew:
        grew = False
        if y0 - step >= low[1] and calm(x0, y0 - step, x1, y0):
            y0, grew = y0 - step, True
        if y1 + step <= high[1] and calm(x0, y1, x1, y1 + step):
            y1, grew = y1 + step, True
        if x0 - step >= low[0] and calm(x0 - step, y0, x0, y1):
            x0, grew = x0 - step, True
        if x1 + step <= high[0] and calm(x1, y0, x1 + step, y1):
            x1, grew = x1 + step, True
    return None if (x0, y0, x1, y1) == box else (x0, y0, x1, y1)


def first_geometry(steps: Sequence[Callable[[], Box | None]], fallback: Box) -> Box:
    """The first way that gives a box; the padded text box in the end."""
    return next((b for s in steps if (b := s()) is not None), fallback)


def boxes_from_map(score: np.ndarray, threshold: float = 0.3, least: float = 0.7, ratio: float = 2.2, most: int = 1000, side: int = 3) -> list[tuple[Box, float]]:
    """Upright boxes of the parts over a threshold, with the mean score
    in each part, grown by the unclip rule; small and weak ones are left out."""
    out = []
    for part in labelled(score > threshold)[:most]:
        y, x = np.nonzero(part)
        x0, y0, x1, y1 = int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1
        value = float(score[part].mean())
        if min(x1 - x0, y1 - y0) < side or value < least:
            continue
        p = quads.unclipped(np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]]), ratio)
        (a, b), (c, d) = np.rint(p.min(0)), np.rint(p.max(0))
        if min(c - a, d - b) >= side + 2:
            out.append(((max(0, int(a)), max(0, int(b)), min(score.shape[1], int(c)), min(score.shape[0], int(d))), value))
    return out


def beam_search(scores: Callable[[tuple[int, ...]], np.ndarray], end: int, k: int = 5, most: int = 255, finished: int = 2) -> tuple[tuple[int, ...], float]:
    """The best sequence of tokens by summed log-probability per token.
    ``scores`` gives log-probabilities after a prefix; a search ends with
    ``finished`` ended sequences, or at ``most`` tokens."""
    live: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    done: list[tuple[float, tuple[int, ...]]] = []
    while live and len(done) < finished and len(live[0][1]) < most:
        nxt = []
        for total, prefix in live:
            p = scores(prefix)
            nxt += [(total + float(p[t]), (*prefix, int(t))) for t in np.argsort(-p, kind="stable")[:k]]
        nxt.sort(key=lambda s: (-s[0], s[1]))
        live = []
        for s in nxt[:k]:
            (done if s[1][-1] == end else live).append(s)
    best = max(done or live, key=lambda s: (s[0] / len(s[1]), s[1]))
    return tuple(t for t in best[1] if t != end), best[0] / len(best[1])


def erase_mask(gray: np.ndarray, box: Box, pad: int = 2, dark_ground: bool | None = None) -> np.ndarray:
    """Strokes in a box by threshold against its border's level, widened; all
    of it where the ground is too mixed. Parts that run along the box's whole
    border are frames, not strokes."""
    x0, y0, x1, y1 = box
    part = gray[y0:y1, x0:x1]
    out = np.zeros_like(gray)
    if not part.size:
        return out
    edge = np.concatenate([part[0], part[-1], part[:, 0], part[:, -1]])
    ground = float(np.median(edge))
    if float((np.abs(edge - ground) < 40).mean()) < 0.6:
        out[y0:y1, x0:x1] = 255
        return out
    dark = ground < 128 if dark_ground is None else dark_ground
    level = otsu(part)
    strokes = part > level if dark else part <= level
    kept = np.zeros_like(strokes)
    for p in labelled(strokes):
        if not (p[0].all() or p[-1].all() or p[:, 0].all() or p[:, -1].all()):
            kept |= p
    out[y0:y1, x0:x1] = np.where(kept, 255, 0)
    return grown(out, pad)


def crop(mask: np.ndarray, box: Box) -> np.ndarray | None:
    """M4: a region's part of a page mask, if it has any."""
    part = mask[max(0, box[1]) : box[3], max(0, box[0]) : box[2]]
    return part.copy() if part.size and part.any() else None


def png(image: np.ndarray) -> bytes:
    """An 8-bit grey or RGB array as a PNG file."""
    h, w = image.shape[:2]
    colour = 2 if image.ndim == 3 else 0
    rows = np.ascontiguousarray(image, np.uint8).reshape(h, -1)
    body = np.hstack([np.zeros((h, 1), np.uint8), rows]).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
