"""Operator 9: best-fit packing by the linear grouping scheme.

Only lengths matter for the plan, and there are ``capacity`` of them at most,
so the plan is made from a histogram. Lengths of the whole capacity are
sequences of their own. The other large lengths are dealt into ``GROUPS`` groups
of equal cardinality and rounded up to their group's largest. Configurations
(multisets of the few rounded sizes that fit a sequence) are optimised by
column generation: a linear programme over configurations, whose next column
is the best one by a knapsack over the dual prices. Each configuration is used
a whole number of times. Actual lengths are then put in place of the rounded
ones, the last slot taking the largest that fits, so that what rounding up lost
is regained; what the programme's rounding down leaves is filled up by exact
subset sums. Small lengths go best-fit into the space that is left. The plan is
a list of runs (so many sequences, each with these lengths), bounded by the
number of lengths and configurations, never by the number of documents.

Each document then finds its place by its rank among those of its length.
Ranks come from counts by (length, salt), so that one length that a third of
all documents share is numbered by many tasks.

Defined cases: a null text counts as empty; an empty document is one token
(the closing id 0). A document over the capacity is cut into full pieces; the
last may be shorter, so very long texts are many pieces. Repeated rows are
packed each. Equal lengths are ranked by salt, doc_id, piece and checksum; which
of two equal rows comes first makes no difference. A null doc_id is kept.
Extra columns are dropped, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import TOKENIZER, encoder
from .common import WORD_BYTES, raw, slices, written

CAPACITY = 2048
#: Lengths up to 1 / SMALL_SHARE of the capacity are small; groups of large
#: ones; columns that the optimisation may try.
SMALL_SHARE, GROUPS, COLUMNS = 8, 32, 5_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, salt."""
    id_type = docs.schema[key].dataType.simpleString()
    stop = (0).to_bytes(4, "little")

    def run(batches):
        enc = encoder(tokenizer)
        for b in slices(batches, text, WORD_BYTES):
            rows, piece, start, length, crc, salt = [], [], [], [], [], []
            for i, ids in enumerate(enc.encode_many(raw(b.column(text)))):
                ids += stop
                n, seed = len(ids) // 4, xxhash.xxh3_64_intdigest(ids)
                for k, at in enumerate(range(0, n, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    salt.append(((seed + k * 0x9E3779B9) ^ (i * 0x85EBCA6B)) & 0x7FFF)
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(salt, pa.int32())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "salt"],
            )

    return docs.select(key, text).mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, salt int")


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths with their numbers, largest first, in groups of equal
    cardinality (a length that has more than a group's share may end several)."""
    total = sum(counts.values())
    share = max(1, -(-total // groups))
    out, room = [[]], share
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = share
            take = min(left, room)
            out[-1].append((length, take))
            left -= take
            room -= take
    return [g for g in out if g]


def fullest(sizes: list[int], left: list[int], first: int, capacity: int) -> list[tuple[int, int]]:
    """A configuration that holds size ``first`` and fills the rest of the
    capacity as far as the sizes left allow: (index, copies)."""
    space = capacity - sizes[first]
    mask = (1 << (space + 1)) - 1
    reach, steps = 1, []
    for j in range(first, len(sizes)):
        s = sizes[j]
        copies = min(left[j] - (j == first), space // s)
        for _ in range(copies):
            wider = (reach | (reach << s)) & mask
            if wider == reach:
                break
            steps.append((j, reach))
            reach = wider
        if reach >> space:
            break
    at, used = reach.bit_length() - 1, defaultdict(int, {first: 1})
    for j, was in reversed(steps):
        if not (was >> at) & 1:
            used[j] += 1
            at -= sizes[j]
    return sorted(used.items())


def best_column(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the highest price that fits: copies of each size."""
    best, taken = np.zeros(capacity + 1), []
    for size, price in zip(sizes, prices.tolist()):
        copies = np.zeros(capacity + 1, np.int32)
        if price > 1e-12:
            now = best.copy()
            for k in range(1, capacity // size + 1):
                other = best[: capacity + 1 - k * size] + k * price
                better = other > now[k * size :] + 1e-12
                now[k * size :][better] = other[better]
                copies[k * size :][better] = k
            best = now
        taken.append(copies)
    at, out = capacity, np.zeros(len(sizes))
    for j in reversed(range(len(sizes))):
        out[j] = taken[j][at]
        at -= int(out[j]) * sizes[j]
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int, most: int = COLUMNS) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, configuration) from the linear programme that covers the demand
    of each size with the fewest sequences, times rounded down. A configuration
    is (index of size, copies). ``most`` bounds the columns tried; any stage of
    the programme is a valid plan."""
    if not sizes:
        return []
    columns = np.diag([float(capacity // s) for s in sizes])
    inverse, need = np.linalg.inv(columns), np.array(demand, float)
    times = inverse @ need
    for step in range(most):
        price, column = best_column(sizes, inverse.sum(0), capacity)
        if price <= 1 + 1e-7:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-9, times / np.where(change > 1e-9, change, 1.0), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = column
        if step % 32 == 31:  # keep rounding errors small
            inverse = np.linalg.inv(columns)
        else:
            row = inverse[out] / change[out]
            inverse = inverse - np.outer(change, row)
            inverse[out] = row
        times = np.maximum(inverse @ need, 0.0)
    found, left = [], list(demand)
    for k, column in zip(np.floor(times + 1e-7).astype(np.int64).tolist(), columns.T):
        config = [(j, int(n)) for j, n in enumerate(column.tolist()) if n > 0]
        k = min([k, *(left[j] // n for j, n in config)])
        if k > 0:
            found.append((k, config))
            for j, n in config:
                left[j] -= k * n
    return found


class Lengths:
    """Lengths that are left, with their numbers."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c}
        self.mask = sum(1 << n for n in self.left)

    def largest(self, space: int, held: list[int]) -> int:
        """The largest length up to ``space`` of which there is more than
        ``held`` has; 0 if there is none."""
        mask = self.mask & ((1 << (max(space, 0) + 1)) - 1)
        while mask:
            n = mask.bit_length() - 1
            if self.left[n] > held.count(n):
                return n
            mask ^= 1 << n
        return 0

    def take(self, lengths: list[int], most: int) -> int:
        """Take ``lengths`` as often as there are enough of each."""
        each = {n: lengths.count(n) for n in lengths}
        times = min([most, *(self.left[n] // c for n, c in each.items())])
        for n, c in each.items():
            self.left[n] -= c * times
            if not self.left[n]:
                del self.left[n]
                self.mask ^= 1 << n
        return times


def substituted(times: int, slots: list[int], lengths: Lengths, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Runs of ``times`` sequences at most with actual lengths in place of the
    rounded sizes ``slots`` (largest first): each slot takes the largest length
    left that its size covers, the last one the largest that fits, and more
    follow while one fits. Then the last two become the pair that fills the
    sequence best, the first of them no smaller than it was."""
    runs = []
    while times and lengths.left:
        held, space, at = [], capacity, 0
        while True:
            size = slots[at] if at < len(slots) - 1 else space
            n = lengths.largest(min(size, space), held)
            at += 1
            if n:
                held.append(n)
                space -= n
            elif at >= len(slots):
                break
        if not held:
            break
        if len(held) > 1 and space:
            x, y = held[-2:]
            rest, room = held[:-2], space + x + y
            for first in sorted(n for n in lengths.left if x <= n < room and lengths.left[n] > rest.count(n)):
                second = lengths.largest(room - first, [*rest, first])
                if second and first + second > x + y:
                    x, y = first, second
                    if x + y == room:
                        break
            held = [*rest, x, y]
        run = lengths.take(held, times)
        runs.append((run, tuple(held)))
        times -= run
    return runs


def filled(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Runs of actual lengths, each sequence filled up by an exact subset sum."""
    sizes = sorted(counts, reverse=True)
    left, first, runs = [counts[s] for s in sizes], 0, []
    while first < len(sizes):
        if not left[first]:
            first += 1
            continue
        config = fullest(sizes, left, first, capacity)
        times = min(left[j] // k for j, k in config)
        for j, k in config:
            left[j] -= k * times
        runs.append((times, tuple(sizes[j] for j, k in config for _ in range(k))))
    return runs


def plan(counts: dict[int, int], capacity: int = CAPACITY, small_share: int = SMALL_SHARE, groups: int = GROUPS) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (number of sequences, lengths in each) that hold all lengths."""
    small = {n: c for n, c in counts.items() if n <= capacity // small_share}
    large = {n: c for n, c in counts.items() if capacity // small_share < n < capacity}
    runs: list[tuple[int, tuple[int, ...]]] = [(counts[capacity], (capacity,))] if counts.get(capacity) else []
    merged: dict[int, int] = defaultdict(int)
    for g in grouped(large, groups):  # groups that round up to the same size are one
        merged[g[0][0]] += sum(c for _, c in g)
    sizes, lengths = sorted(merged, reverse=True), Lengths(large)
    for times, config in configurations(sizes, [merged[s] for s in sizes], capacity):
        runs.extend(substituted(times, [sizes[j] for j, k in config for _ in range(k)], lengths, capacity))
    runs.extend(filled(lengths.left, capacity))
    return best_fit(runs, small, capacity)


def best_fit(runs: list[tuple[int, tuple[int, ...]]], counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Put further lengths, largest first, where the least space is left."""
    by_space: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for times, lengths in runs:
        by_space[capacity - sum(lengths)].append((times, lengths))
    for n in sorted(counts, reverse=True):
        left = counts[n]
        for space in range(n, capacity + 1):
            while left and by_space.get(space):
                times, lengths = by_space[space].pop()
                k = min(space // n, left)
                full = min(times, left // k)
                by_space[space - k * n].append((full, lengths + (n,) * k))
                left -= full * k
                if full < times:
                    by_space[space].append((times - full, lengths))
            if not left:
                break
        while left:  # a new sequence
            k = min(capacity // n, left)
            full = left // k
            by_space[capacity - k * n].append((full, (n,) * k))
            left -= full * k
    return [r for rs in by_space.values() for r in rs]


def places(runs: list[tuple[int, tuple[int, ...]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> (first rank, number, first sequence, offset), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    next_rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for times, lengths in runs:
        at = 0
        for n in lengths:
            out[n].append((next_rank[n], times, sequence, at))
            next_rank[n] += times
            at += n
        sequence += times
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = written(pieces(docs, capacity, tokenizer, key, text), "pieces")
    cells = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    flat = [(n, *x) for n, xs in places(plan(histogram, capacity)).items() for x in xs]
    # Salts of a length are summed up per length: 2**15 salts at most.
    base = cells.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    ranked = (
        rows.withColumn("own", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .join(base, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("own"))
    )
    firsts = np.array(sorted((n, f, s, o) for n, f, _, s, o in flat), dtype=np.int64).reshape(-1, 4)
    table = spark.sparkContext.broadcast(firsts)  # the plan's runs: bounded by lengths and configurations

    def run(batches):
        t = table.value
        codes = t[:, 0] << 44 | t[:, 1]
        for b in batches:
            length, rank = (np.asarray(b.column(c), dtype=np.int64) for c in ("length", "rank"))
            at = np.searchsorted(codes, length << 44 | rank, side="right") - 1
            out = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(t[at, 2] + rank - t[at, 1]), pa.array(t[at, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    id_type = docs.schema[key].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
