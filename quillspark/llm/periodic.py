"""Operator 13: runs of a repeated period of words.

A run is a stretch of words with smallest period q and at least
``max(6, 4 * q)`` words that can't be extended. Words q apart agree over at
least 3 * q places of it (5 if q is 1), so one of the places that are
multiples of 3 * p (5) lies among them for p = q: the grid of period p. The
grids of all periods together have about n / 3 * ln n places. All of a
slice's (period, place) pairs, in blocks, are compared at once: where the
words at a place and p later agree, the common extension to both sides is
found by binary search over prefix hashes (polynomials mod 2**64, random
values for words).

A stretch of period p that is 4 * p long or more has a smallest period that
divides p, and the same ends for both; so of candidates with equal ends the one
with the least period is the run, and the others go. The runs are then compared
word by word; if a hash was wrong, the document's runs are found by comparing words.

Defined cases: a null or empty text has no words and no runs. A very long
text is a slice of its own, judged whole; its pairs come in blocks of bounded
size. Of runs with the same exponent the one with the least start, then the
least period, is the strongest. A null doc_id is kept, with 0 for the crc of
its decimal. Repeated rows are judged each for itself. Extra columns, whatever
their names, are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import mix, slices

#: Least words of a run, and least periods that it has.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: (period, place) pairs that are compared at once.
PAIRS_AT_ONCE = 1 << 20
_BASE = np.uint64(0x9FB21C651E98DF25)  # odd


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word in order, words of each text)."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = split.flatten()
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    seen = np.zeros(len(real) + 1, np.int64)
    np.cumsum(real, out=seen[1:])
    counts = np.diff(seen[np.asarray(split.offsets)])
    numbered = flat.filter(pa.array(real)).dictionary_encode()
    return numbered.dictionary, np.asarray(numbered.indices).astype(np.int64), counts


def grids(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, place) of all grids, in blocks. Periods are taken
    in turn over all documents that are long enough; a block ends where it is
    full, in the middle of a grid too."""
    order = np.argsort(-counts, kind="stable")
    by_size = counts[order]
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for p in range(1, int(by_size[0]) // LEAST_PERIODS + 1 if len(by_size) else 0):
        least = max(LEAST_WORDS, LEAST_PERIODS * p)
        docs = order[: np.searchsorted(-by_size, -least, side="right")]
        if not len(docs):
            break
        gap = least - p
        places = -(-(counts[docs] - p) // gap)  # multiples of gap with a partner
        ends = np.cumsum(places)
        for a in range(0, int(ends[-1]), PAIRS_AT_ONCE):
            which = np.arange(a, min(a + PAIRS_AT_ONCE, int(ends[-1])))
            d = np.searchsorted(ends, which, side="right")
            held.append((docs[d], np.full(len(which), p, np.int64), (which - ends[d] + places[d]) * gap))
            size += len(which)
            if size >= PAIRS_AT_ONCE:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


class PrefixHashes:
    """Of all words of a slice, one after the other."""

    def __init__(self, words: np.ndarray):
        self.power = np.ones(len(words) + 1, np.uint64)
        np.cumprod(np.full(len(words), _BASE), out=self.power[1:])
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * self.power[:-1], out=self.sums[1:])

    def agree(self, at: np.ndarray, p: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``at`` equal those p later."""
        left = self.sums[at + length] - self.sums[at]
        right = self.sums[at + p + length] - self.sums[at + p]
        return left * self.power[p] == right

    def common(self, at: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The most words, up to ``most``, from ``at`` on (or up to it) that
        equal those p later: all binary searches at once."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            half = (low[open_] + high[open_] + 1) // 2
            begin = at[open_] - half if back else at[open_]
            same = self.agree(begin, p[open_], half)
            low[open_[same]] = half[same]
            high[open_[~same]] = half[~same] - 1


def by_comparing(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text, by words alone."""
    n, found = len(words), {}
    for p in range(1, n // LEAST_PERIODS + 1):
        same = np.zeros(n - p + 2, np.int8)
        same[1:-1] = words[p:] == words[:-p]
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + p >= max(LEAST_WORDS, LEAST_PERIODS * p):
                found.setdefault((a, b - a + p), p)
    return sorted((a, n, p) for (a, n), p in found.items())


def runs_of(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in it, length, period) of all runs, by document, start
    and period. ``counts`` has the words of each document."""
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=begin[1:])
    hashes, found = PrefixHashes(words), [np.zeros((4, 0), np.int64)]
    for doc, p, place in grids(counts):
        at = begin[doc] + place
        met = words[at] == words[at + p]
        doc, p, at = doc[met], p[met], at[met]
        end = begin[doc + 1]
        ahead = hashes.common(at, p, end - p - at, False)
        behind = hashes.common(at, p, at - begin[doc], True)
        length = ahead + behind + p
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        some = np.stack([doc, at - behind, length, p])[:, long]
        found.append(some[:, _least_periods(some)])
    every = np.concatenate(found, axis=1)
    every = every[:, _least_periods(every)]
    doc, start, length, p = every
    wrong = np.unique(doc[~_holds(words, start, length, p)])
    if len(wrong):
        right = [[(d, begin[d] + a, n, q) for a, n, q in by_comparing(words[begin[d] : begin[d + 1]])] for d in wrong.tolist()]
        more = np.array([r for rows in right for r in rows], np.int64).reshape(-1, 4).T
        every = np.concatenate([every[:, ~np.isin(doc, wrong)], more], axis=1)
    every = every[:, np.lexsort((every[3], every[1], every[0]))]
    return every[0], every[1] - begin[every[0]], every[2], every[3]


def _least_periods(runs: np.ndarray) -> np.ndarray:
    """Columns that stay: of equal ends the one with the least period."""
    order = np.lexsort((runs[3], runs[2], runs[1]))
    a, n = runs[1][order], runs[2][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (n[1:] != n[:-1])
    return order[new]


def _holds(words: np.ndarray, start: np.ndarray, length: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether each stretch has its period and can't go on with it, by words.
    Ends at a document's ends were never passed by the search."""
    out = np.ones(len(start), bool)
    for a in _blocks(length, PAIRS_AT_ONCE):
        size = length[a] - p[a]
        first = np.cumsum(size) - size
        at = np.repeat(start[a] - first, size) + np.arange(int(size.sum()))
        same = words[at] == words[at + np.repeat(p[a], size)]
        out[a] = np.logical_and.reduceat(same, first)
    return out


def _blocks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices with about ``most`` in sum; a larger one stands alone."""
    if not len(sizes):
        return
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield slice(a, b)


def stretched(counts: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """For each word the word of the same text (as a place among all) that
    stands there in the contract's texts: where crc % 10 is 0, all words from
    a on repeat the first p of them."""
    total = int(counts.sum())
    take = np.arange(total)
    begin = np.cumsum(counts) - counts
    g = crc // 10
    for d in np.flatnonzero((crc % 10 == 0) & (counts > 0)).tolist():
        n, own = int(counts[d]), int(g[d])
        a = own % n
        p = 1 + (n - a) // (3 + own % 8)
        take[begin[d] + a : begin[d] + n] = begin[d] + a + np.arange(n - a) % p
    return take


def described(texts: pa.Array, crc: np.ndarray | None) -> dict[str, pa.Array]:
    """The columns of each text: its runs, and the text without repeats."""
    distinct, words, counts = words_of(texts)
    if crc is not None:
        words = words[stretched(counts, crc)]
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=begin[1:])
    doc, start, length, p = runs_of(words, counts)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, begin[doc] + start + p, 1)
    np.add.at(edge, begin[doc] + start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    stay = np.zeros(len(words) + 1, np.int64)
    np.cumsum(kept, out=stay[1:])
    left = pa.ListArray.from_arrays(pa.array(stay[begin], pa.int32()), distinct.take(pa.array(words[kept])))
    n_runs = np.bincount(doc, minlength=len(counts))
    at = np.cumsum(n_runs) - n_runs
    ratio = length / p
    best, lists = [], []
    for d, (i, n) in enumerate(zip(at.tolist(), n_runs.tolist())):
        own = range(i, i + n)
        lists.append([{"start": int(start[k]), "length": int(length[k]), "period": int(p[k])} for k in own])
        if not n:
            best.append(None)
            continue
        # floats narrow it down, whole numbers decide
        top = ratio[i : i + n].max() * (1 - 1e-9)
        close = [k for k in own if ratio[k] >= top]
        best.append(min(close, key=lambda k: (-Fraction(int(length[k]), int(p[k])), start[k], p[k])))
    pick = lambda x: pa.array([None if k is None else int(x[k]) for k in best], pa.int64())
    return {
        "n_words": pa.array(counts),
        "n_runs": pa.array(n_runs),
        "start": pick(start), "length": pick(length), "period": pick(p),
        "exponent_milli": pick(1000 * length // np.maximum(p, 1)),
        "runs": pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        "collapsed": pc.binary_join(left, pa.scalar(" ", pa.large_string())),
    }


_OWN = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_DIGESTS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _crc(keys: pa.Array) -> np.ndarray:
    return np.fromiter((0 if k is None else crc32(str(k).encode()) for k in keys.to_pylist()), np.int64, len(keys))


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", stretch: bool = False, digests: bool = False) -> DataFrame:
    """The runs of each text, the strongest one, and the text with each run
    cut to its first period (words joined by a blank). ``stretch`` repeats
    words of a tenth of the texts first, by their ids' crc; ``digests`` gives
    hashes in place of the runs and the text."""
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in slices(batches, text):
            out = described(b.column(text), _crc(b.column(key)) if stretch else None)
            if digests:
                runs = ["".join(f"{r['start']},{r['length']},{r['period']}\n" for r in own) for own in out.pop("runs").to_pylist()]
                out["runs_sha256"] = pa.array([hashlib.sha256(r.encode()).hexdigest() for r in runs], pa.string())
                out["collapsed_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in out.pop("collapsed").cast(pa.large_binary()).to_pylist()], pa.string())
                del out["n_words"]
            else:
                out["collapsed"] = out["collapsed"].cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(key), *out.values()], ["doc_id", *out])

    return docs.select(key, text).mapInArrow(run, f"doc_id {id_type}, {_DIGESTS if digests else _OWN}")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), stretch=True, digests=True)
