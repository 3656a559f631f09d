"""Operator 7: repeated windows by depth-limited radix sort.

A *window* is ``length`` bytes of one document. It is removed where a
document with a smaller doc_id has it too. Windows are found equal by
most-significant-digit radix passes (8 bytes a digit) that stop at the
threshold: groups that are equal after the last pass are exactly the repeated
windows.

Sorting every window of the corpus would move it fifty times over, so only
those that can repeat are sorted:

1. Each window has a mark: the least hash of its ``GRAM``-byte pieces. Equal
   windows have equal marks, and neighbouring windows mostly share one.
   Marks, once per task, are exchanged by hash range; those that two documents
   have go into a bitmap of fixed size (a fuller one only means more sorting).
2. Runs of windows whose mark is in the bitmap are sent, as one piece of text
   with the smallest doc_id that has it, to the mark's bucket. Equal pieces are
   joined before sending, so a passage that very many documents share is sent
   once a task. The bucket sorts the windows of distinct pieces and answers the
   smallest doc_id of each window to the document buckets that asked.
3. The documents, dealt by hash of doc_id, are met with the answers.

doc_id is an integer. Defined cases: a null text is empty; texts under the
length have no window; a null doc_id counts as larger than all others, so it
loses what they have too but keeps what other null ids have; rows with the same
doc_id don't remove from one another. Repeated rows all stay. A very long text is
a slice of its own, whole. An empty table gives an empty result. Columns with
clashing names don't matter: ``remove_repeats`` keeps the input's columns,
``repeat_spans`` drops all but doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bitmap, buckets_by_size, mix, range_bucket, raw, six_bytes, slices, split_by

LENGTH, GRAM = 50, 24
#: Bits of the marks' bitmap: 32 MB at any size of input.
MARK_BITS = 28
LAST = np.iinfo(np.int64).max


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as numbers."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))


class Runs:
    """Runs of windows with the same mark in some texts.

    ``start`` and ``size`` (windows, at most LENGTH - GRAM + 1) are in the
    joined bytes; ``doc`` numbers the texts; ``mark`` is spread evenly.
    """

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        self.blob = b"".join(texts)
        n, width = len(self.blob), length - GRAM + 1
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(sizes) - sizes
        if n < length:
            self.start = self.size = self.doc = np.zeros(0, np.int64)
            self.mark = np.zeros(0, np.uint64)
            return
        w = _words(np.frombuffer(self.blob, np.uint8))
        m = n - GRAM + 1
        with np.errstate(over="ignore"):
            h = w[:m] * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h += w[8 : 8 + m]
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            h += w[16 : 16 + m]
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        span = 1
        while 2 * span <= width:  # least of the next ``span`` pieces
            h = np.minimum(h[: len(h) - span], h[span:])
            span *= 2
        if span < width:
            h = np.minimum(h[: n - length + 1], h[width - span : width - span + n - length + 1])
        windows = np.maximum(sizes - length + 1, 0)
        some = np.flatnonzero(windows)
        count = windows[some]
        total = int(count.sum())
        before = np.cumsum(count) - count
        at = np.arange(total) + np.repeat(self.first[some] - before, count)
        mark = h[at]
        new = np.ones(total, bool)
        new[1:] = mark[1:] != mark[:-1]
        new[before] = True
        begin = np.flatnonzero(new)
        run = np.diff(np.append(begin, total))
        # a longer run (periodic text) is cut, by its own start
        parts = -(-run // width)
        piece = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(begin, parts) + piece * width
        self.size = np.minimum(np.repeat(run, parts) - piece * width, width)
        self.start = at[begin]
        self.mark = mix(mark[begin])
        self.doc = some[np.searchsorted(before, begin, side="right") - 1]

    def pick(self, keep: np.ndarray) -> None:
        self.start, self.size, self.doc, self.mark = self.start[keep], self.size[keep], self.doc[keep], self.mark[keep]

    def pieces(self, length: int = LENGTH) -> list[bytes]:
        blob = self.blob
        return [blob[a:b] for a, b in zip(self.start.tolist(), (self.start + self.size + (length - 1)).tolist())]


def ids(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column.cast(pa.int64()), int(LAST)), dtype=np.int64)


def equal_windows(data: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """Positions (in ``at``) of windows of ``data``, grouped by equal content:
    the order of those that repeat, and where each group begins in it."""
    words = _words(data)
    live = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    offsets = [*range(0, length - 7, 8)]
    if offsets[-1] + 8 < length:
        offsets.append(length - 8)
    for off in offsets:
        if not len(live):
            break
        digit = words[at[live] + off].byteswap()
        order = np.lexsort((digit, group)) if off else np.argsort(digit, kind="stable")
        live, g, d = live[order], group[order], digit[order]
        new = np.ones(len(live), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        alone = new.copy()
        alone[:-1] &= new[1:]
        group = np.cumsum(new) - 1
        live, group = live[~alone], group[~alone]
    begin = np.flatnonzero(np.diff(group, prepend=-1)) if len(live) else np.zeros(0, np.int64)
    return [live, begin]


def _marks(docs: DataFrame, key: str, text: str, length: int, n: int) -> Bitmap:
    def send(batches):
        for b in slices(batches, text):
            runs = Runs(raw(b.column(text)), length)
            if not len(runs.mark):
                continue
            order = np.lexsort((runs.doc, runs.mark))
            m, d = runs.mark[order], runs.doc[order]
            new = np.ones(len(m), bool)
            new[1:] = (m[1:] != m[:-1]) | (d[1:] != d[:-1])
            m = m[new]
            # a mark of two documents goes twice, whatever their number
            third = np.zeros(len(m), bool)
            third[2:] = m[2:] == m[:-2]
            m = m[~third]
            for bucket, at in split_by(range_bucket(m, n)):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([six_bytes(m[at])], pa.binary())], ["bucket", "marks"])

    return Bitmap.of_repeated(docs.select(key, text).mapInArrow(send, "bucket int, marks binary"), MARK_BITS)


def squeezed(data: bytes) -> bytes:
    """Neighbouring runs overlap, so pieces press well."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def opened(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


_ASK = "bucket int, pieces binary, sizes binary, least binary, several binary, askers binary, n_askers binary"
_ANSWER = "home int, keys binary, sizes binary, least binary"


def _answers(docs: DataFrame, key: str, text: str, length: int, n: int, shared) -> DataFrame:
    """Rows of packed answers per document bucket: for a piece (by digest) the
    smallest doc_id of each of its windows, or one number if they all agree."""

    def ask(batches):
        for b in slices(batches, text):
            runs = Runs(raw(b.column(text)), length)
            runs.pick(shared.value.has(runs.mark))
            if not len(runs.mark):
                continue
            own, home = ids(b.column(key)), np.asarray(b.column("home"), dtype=np.int64)
            seen: dict[bytes, int] = {}
            number = np.fromiter((seen.setdefault(p, len(seen)) for p in runs.pieces(length)), np.int64, len(runs.mark))
            doc = own[runs.doc]
            least = np.full(len(seen), LAST)
            np.minimum.at(least, number, doc)
            several = np.zeros(len(seen), np.uint8)
            several[number[doc != least[number]]] = 1
            mark = np.zeros(len(seen), np.uint64)
            mark[number] = runs.mark
            asked = np.unique(number << 32 | home[runs.doc])
            asker, per = (asked & 0xFFFFFFFF).astype("<u4"), np.bincount(asked >> 32, minlength=len(seen))
            ends = np.cumsum(per)
            pieces = list(seen)
            for bucket, at in split_by(range_bucket(mark, n)):
                part = [pieces[i] for i in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([bucket], pa.int32()),
                        *(
                            pa.array([x], pa.binary())
                            for x in (
                                squeezed(b"".join(part)),
                                np.fromiter(map(len, part), "<u2", len(part)).tobytes(),
                                least[at].tobytes(),
                                several[at].tobytes(),
                                b"".join([asker[ends[i] - per[i] : ends[i]].tobytes() for i in at.tolist()]),
                                per[at].astype("<u4").tobytes(),
                            )
                        ),
                    ],
                    ["bucket", "pieces", "sizes", "least", "several", "askers", "n_askers"],
                )

    def answer(t: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
        blob, sizes = b"".join(map(opened, t["pieces"].to_pylist())), join("sizes", "<u2").astype(np.int64)
        ends = np.cumsum(sizes)
        seen: dict[bytes, int] = {}
        number = np.fromiter((seen.setdefault(blob[e - s : e], len(seen)) for s, e in zip(sizes.tolist(), ends.tolist())), np.int64, len(sizes))
        own = join("least", np.int64)
        least = np.full(len(seen), LAST)
        np.minimum.at(least, number, own)
        several = np.zeros(len(seen), bool)
        several[number[(own != least[number]) | (join("several", np.uint8) > 0)]] = True
        pieces = list(seen)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        length_of = np.fromiter(map(len, pieces), np.int64, len(pieces))
        windows = length_of - length + 1
        before = np.cumsum(windows) - windows
        of = np.repeat(np.arange(len(pieces)), windows)
        at = np.arange(len(of)) - before[of] + (np.cumsum(length_of) - length_of)[of]
        smallest = least[of]
        live, begin = equal_windows(data, at, length)
        if len(begin):
            group = np.minimum.reduceat(smallest[live], begin)
            smallest[live] = np.repeat(group, np.diff(np.append(begin, len(live))))
        # only what makes some document lose bytes is answered
        loses = several.copy()
        loses[of[smallest < least[of]]] = True
        low, high = np.minimum.reduceat(smallest, before), np.maximum.reduceat(smallest, before)
        even = low == high
        askers, per = join("askers", "<u4"), join("n_askers", "<u4").astype(np.int64)
        pairs = np.unique(np.repeat(number, per) | askers.astype(np.int64) << 32)
        home, which = pairs >> 32, pairs & 0xFFFFFFFF
        good = loses[which]
        home, which = home[good], which[good]
        keys = {i: xxhash.xxh3_128_digest(pieces[i]) for i in np.flatnonzero(loses).tolist()}
        out = []
        for bucket, rows in split_by(home):
            w = which[rows]
            count = np.where(even[w], 1, windows[w])
            numbers = np.concatenate([low[i : i + 1] if even[i] else smallest[before[i] : before[i] + windows[i]] for i in w.tolist()])
            out.append((bucket, b"".join([keys[i] for i in w.tolist()]), count.astype("<u2").tobytes(), numbers.tobytes()))
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.table({"home": pa.array(cols[0], pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in zip(("keys", "sizes", "least"), cols[1:])}})

    return docs.select(key, text, "home").mapInArrow(ask, _ASK).groupBy("bucket").applyInArrow(answer, _ANSWER)


def removed(texts: list[bytes], own: np.ndarray, answers: dict[bytes, np.ndarray], has, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of the joined texts go, and where each text begins."""
    runs = Runs(texts, length)
    runs.pick(has(runs.mark))
    edge = np.zeros(len(runs.blob) + 1, np.int32)
    lost = []
    for piece, start, size, doc in zip(runs.pieces(length), runs.start.tolist(), runs.size.tolist(), own[runs.doc].tolist()):
        least = answers.get(xxhash.xxh3_128_digest(piece))
        if least is None:
            continue
        if len(least) == 1:
            if least[0] < doc:
                lost.append((start, start + size + length - 1))
        else:
            for i in np.flatnonzero(least < doc).tolist():
                lost.append((start + i, start + i + length))
    if lost:
        a, b = np.array(lost).T
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
    return np.cumsum(edge[:-1]) > 0, runs.first


def _met(docs: DataFrame, key: str, text: str, length: int, make, schema) -> DataFrame:
    """Documents met with their answers: ``make(batch, lost, first, texts)``
    turns a slice of them into output rows."""
    spark = docs.sparkSession
    n = buckets_by_size(docs, text)
    home = "home"
    while home in docs.columns:
        home += "_"
    bucket = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    shared = spark.sparkContext.broadcast(_marks(docs, key, text, length, n))
    answers = _answers(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), bucket.alias("home")), "doc_id", "text", length, n, shared)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[bytes, np.ndarray] = {}
        for keys, sizes, least in zip(*(right[c].to_pylist() for c in ("keys", "sizes", "least"))):
            numbers = np.frombuffer(least, np.int64)
            ends = np.cumsum(np.frombuffer(sizes, "<u2").astype(np.int64))
            for i, part in enumerate(np.split(numbers, ends[:-1])):
                found[keys[16 * i : 16 * i + 16]] = part
        out = []
        for b in slices(left.to_batches(), text):
            texts = raw(b.column(text))
            out.append(make(b, *removed(texts, ids(b.column(key)), found, shared.value.has, length), texts))
        # answers go to the buckets of documents that asked, so left has rows
        return pa.Table.from_batches(out or [make(pa.RecordBatch.from_pylist([], schema=left.schema), np.zeros(0, bool), np.zeros(0, np.int64), [])])

    return docs.withColumn(home, bucket).groupBy(home).cogroup(answers.groupBy("home")).applyInArrow(meet, schema)


def repeat_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def make(b, lost, first, texts):
        rows = []
        for x, a in zip(texts, first.tolist()):
            gone = lost[a : a + len(x)]
            count = int(gone.sum())
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if count else 0
            kept = np.frombuffer(x, np.uint8)[~gone].tobytes() if count else x
            rows.append((len(x), count, spans, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([b.column(key), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    id_type = docs.schema[key].dataType.simpleString()
    return _met(docs.select(key, text), key, text, length, make, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the bytes ``gone``; a character of which a byte goes,
    goes whole, so what is left of two can't meet and make a third."""
    if not gone.any():
        return text
    data = np.frombuffer(text, np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(starts) or starts[0] != 0:  # no UTF-8: bytes as they are
        return data[~gone].tobytes()
    whole = np.logical_or.reduceat(gone, starts)
    return data[~np.repeat(whole, np.diff(np.append(starts, len(data))))].tobytes()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``. A character of
    which a byte goes, goes whole."""
    names = docs.columns

    def make(b, lost, first, texts):
        out = []
        for x, a, null in zip(texts, first.tolist(), b.column(text).is_null().to_pylist()):
            out.append(None if null else without(x, lost[a : a + len(x)]))
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).view(pa.string()) if c == text else b.column(c) for c in names], names)

    return _met(docs, key, text, length, make, docs.schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 50-byte repeats take from each document."""
    return repeat_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
