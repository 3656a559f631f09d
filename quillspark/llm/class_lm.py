"""Operator 8: scoring by a Brown class-based bigram model.

A text's log-probability is the sum over its tokens (words and one end) of
log10 P(class | class before) + log10 P(token | class).

Classes. Exchange clustering first works on the ``TOP`` most frequent training
words, each an item of its own, and on items for the shapes of all other words
(their last letters, the punctuation after them, and whether they have other
characters): items move between ``CLASSES`` classes as long as that raises the
training text's class-bigram likelihood. Then each further training word, however
rare, is moved by the same gain, taken from its own neighbours' classes over all
training text, in hash-range buckets. Only unseen words have their shape's class.
So each word has exactly one class.

Probabilities. P(token | class) = (c + 0.5) / (T + 0.5 (V + 1)), with c the
token's count, T and V the class's training tokens and distinct tokens; one
slot of each class is for unknown tokens. P(class | before) backs off to the
smoothed frequency of the class with weight ``BACK_OFF``; its counts are those
of the final classes over all training tokens. Before a text stands an end.

Counts are exact over all training tokens. Distinct words are counted by
64-bit hash in packed hash-range buckets; words with a share of at least
1/``HOT`` of the tokens (so ``HOT`` words at most) go to every task with their
class and count. Those of the other words are looked up in the buckets, where each
task sends a word once a slice; the pairs of tokens that have such a word wait at
the slice's home for the answers. ``HOT`` sets what travels, not what comes out. What
the driver gets is bounded: hot words, the item-bigram table, and totals per class.

Defined cases: a null or empty text has the end only. A very long text is a
slice of its own, whole. A null doc_id isn't held out, and is learned from.
Repeated rows count and are scored each. Words of equal count rank by hash.
Extra columns are dropped, whatever their names. Without training tokens all
probabilities are those of the smoothing alone; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, crc_of, range_bucket, slices, split_by, written

#: Frequent words with an item of their own; classes; sweeps of the exchange.
TOP, CLASSES, SWEEPS = 1024, 96, 8
#: Shape items: endings x marks after the word x other characters.
ENDINGS, SHAPES = 64, 64 * 4 * 2
HOT = 2_000_000
BACK_OFF = 20.0
END = b"\n"  # a token no word can be
END_HASH = xxhash.xxh3_64_intdigest(END)
#: Bytes of text that the passes count at once: for words, for neighbours.
LEARN_BYTES, SCORE_BYTES = 16 << 20, 4 << 20


def shape_of(word: bytes) -> int:
    """The shape item of a word outside the top."""
    body = word.rstrip(b".,;:!?")
    mark = 0 if len(body) == len(word) else 1 if word.endswith(b".") else 2 if word.endswith(b",") else 3
    return ((xxhash.xxh3_64_intdigest(body[-2:]) % ENDINGS) * 4 + mark) * 2 + (not body.isalpha())


class Known:
    """What is known of some words: by hash (sorted) a value, and a count. Any
    other word has the value of its shape."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray, shapes: np.ndarray, counts: np.ndarray | None = None):
        order = np.argsort(hashes)
        self.hashes, self.values, self.shapes = hashes[order], values[order], shapes
        self.counts = np.zeros(len(hashes), np.int64) if counts is None else counts[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash; -1 if it isn't known."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def value_of(self, h: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        at = self.find(h)
        return np.where(at >= 0, self.values[at], self.shapes[shapes]) if len(self.hashes) else self.shapes[shapes]


class Vocabulary:
    """Numbers for the words of the last slices, with their hash, value and
    count (0 if not known)."""

    def __init__(self, known: Known):
        self.known = known
        self.at: dict[bytes, int] = {}
        self.hash: list[int] = []
        self.shape: list[int] = []
        self.hashes, self.values, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, words: list[bytes], tokens_: np.ndarray) -> np.ndarray:
        if len(self.hash) > 300_000:
            self.__init__(self.known)
        at, hashes, shapes = self.at, self.hash, self.shape
        done = len(hashes)
        for w in set(words).difference(at):
            at[w] = len(hashes)
            hashes.append(xxhash.xxh3_64_intdigest(w))
            shapes.append(shape_of(w))
        h, s = np.array(hashes[done:], np.uint64), np.array(shapes[done:], np.int64)
        place = self.known.find(h)
        count = np.where(place >= 0, self.known.counts[place], 0) if len(self.known.hashes) else np.zeros(len(h), np.int64)
        self.hashes, self.values = np.concatenate([self.hashes, h]), np.concatenate([self.values, self.known.value_of(h, s)])
        self.count = np.concatenate([self.count, count])
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))[tokens_]


def tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of some texts, the end last; the tokens in order, as
    numbers of words, with an end after each text; and each text's tokens."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = lists.flatten().dictionary_encode()
    words, number = found.dictionary.cast(pa.binary()).to_pylist(), found.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    if b"" in words:  # blanks at a text's border
        real = number != words.index(b"")
        number, doc = number[real], doc[real]
    size = np.bincount(doc, minlength=len(texts)) + 1
    out = np.full(len(number) + len(texts), len(words), np.int64)
    out[np.arange(len(number)) + doc] = number
    return [*words, END], out, size


#: Items: 0 is the end, 1..TOP the frequent words, then the shapes.
N_ITEMS = 1 + TOP + SHAPES


def _cat(t: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t[column].to_pylist()), kind)


def word_counts(train: DataFrame, text: str, n: int) -> DataFrame:
    """Rows (bucket, hashes, counts, shapes, total), packed and sorted by
    hash: exact counts of all distinct tokens."""

    def send(batches):
        for b in slices(batches, text, LEARN_BYTES):
            words, number, _ = tokens(b.column(text))
            c = np.bincount(number, minlength=len(words))
            own = [w for w, n in zip(words, c.tolist()) if n]
            c = c[c > 0]
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
            s = np.fromiter(map(shape_of, own), np.int64, len(own)).astype("<u2")
            for bucket, at in split_by(range_bucket(h, n)):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x[at].tobytes()], pa.binary()) for x in (h, c, s))], ["bucket", "hashes", "counts", "shapes"])

    def merge(t: pa.Table) -> pa.Table:
        h, c, s = _cat(t, "hashes", np.uint64), _cat(t, "counts", np.int64), _cat(t, "shapes", "<u2")
        order = np.argsort(h, kind="stable")
        h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        c = np.add.reduceat(c[order], first)
        return pa.table({"bucket": t["bucket"].slice(0, 1), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in (("hashes", h[first]), ("counts", c), ("shapes", s[order][first]))}, "total": pa.array([int(c.sum())])})

    return train.select(text).mapInArrow(send, "bucket int, hashes binary, counts binary, shapes binary").groupBy("bucket").applyInArrow(merge, "bucket int, hashes binary, counts binary, shapes binary, total long")


def top_words(counts: DataFrame) -> list[int]:
    """Hashes of the ``TOP`` most frequent words, the end left out."""

    def pick(batches):
        for b in batches:
            for h, c in zip(b.column("hashes").to_pylist(), b.column("counts").to_pylist()):
                h, c = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                at = np.lexsort((h, -c))[: TOP + 1]
                # as signed numbers in the same order
                yield pa.RecordBatch.from_arrays([pa.array((h[at] ^ np.uint64(1 << 63)).view(np.int64)), pa.array(c[at])], ["h", "c"])

    rows = counts.select("hashes", "counts").mapInArrow(pick, "h long, c long").orderBy(F.desc("c"), "h").limit(TOP + 1).collect()
    return [h for h in (r["h"] + (1 << 63) for r in rows) if h != END_HASH][:TOP]


_ROWS = 32  # rows of the item-bigram table that travel together


def item_bigrams(train: DataFrame, text: str, shared) -> np.ndarray:
    """How often item b follows item a in training texts."""

    def send(batches):
        voc = Vocabulary(shared.value)
        total = None
        for b in slices(batches, text, SCORE_BYTES):
            number = voc.numbers(*tokens(b.column(text))[:2])
            items = voc.values[number]
            before = np.empty_like(items)
            before[0], before[1:] = 0, items[:-1]  # a text's first token follows an end
            pairs, times = np.unique(before * N_ITEMS + items, return_counts=True)
            if total is None:
                total = np.zeros(N_ITEMS * N_ITEMS, np.int64)
            total[pairs] += times
        if total is not None:
            at = np.flatnonzero(total)
            for part, rows in split_by(at // (N_ITEMS * _ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at[rows].astype("<u4").tobytes()], pa.binary()), pa.array([total[at[rows]].tobytes()], pa.binary())], ["part", "at", "n"])

    def merge(t: pa.Table) -> pa.Table:
        at = np.frombuffer(b"".join(t["at"].to_pylist()), "<u4")
        n = np.frombuffer(b"".join(t["n"].to_pylist()), np.int64)
        base = int(t["part"][0].as_py()) * N_ITEMS * _ROWS
        own = np.bincount(at.astype(np.int64) - base, weights=n, minlength=N_ITEMS * _ROWS).astype(np.int64)
        some = np.flatnonzero(own)
        return pa.table({"at": pa.array([(some + base).astype("<u4").tobytes()], pa.binary()), "n": pa.array([own[some].tobytes()], pa.binary())})

    parts = train.mapInArrow(send, "part int, at binary, n binary").groupBy("part").applyInArrow(merge, "at binary, n binary")
    out = np.zeros(N_ITEMS * N_ITEMS, np.int64)
    for r in parts.toLocalIterator():  # the table has a fixed size
        out[np.frombuffer(r["at"], "<u4")] = np.frombuffer(r["n"], np.int64)
    return out.reshape(N_ITEMS, N_ITEMS)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each item, by exchange clustering: items move, one by one,
    to the class that raises the likelihood most. The end has class 0 alone."""
    n = bigrams.astype(np.float64)
    freq = n.sum(0)
    k = len(freq)
    order = np.argsort(-freq[1:], kind="stable") + 1
    cls = np.zeros(k, np.int64)
    cls[order] = 1 + np.arange(k - 1) % (classes - 1)
    one = np.zeros((k, classes))
    one[np.arange(k), cls] = 1
    left, right = n @ one, n.T @ one  # to and from classes, by item
    cc = one.T @ left
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    into, out = one.T @ n.sum(0), one.T @ n.sum(1)
    items = [i for i in order.tolist() if freq[i] > 0]
    for _ in range(sweeps):
        moved = 0
        for i in items:
            old = cls[i]
            to, fro, self_ = left[i].copy(), right[i].copy(), n[i, i]
            to[old] -= self_
            fro[old] -= self_
            # take the item out
            cc[old] -= to
            cc[:, old] -= fro
            cc[old, old] -= self_
            into[old] -= freq[i]
            out[old] -= n[i].sum()
            # gain of putting it into each class k
            base = f(cc)
            gain = (f(cc + to[None, :]) - base).sum(1) + (f(cc + fro[:, None]) - base).sum(0)
            d = np.diag(cc)
            gain += f(d + to + fro + self_) - f(d + to) - f(d + fro) + f(d)
            gain -= f(into + freq[i]) - f(into) + f(out + n[i].sum()) - f(out)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            cc[new] += to
            cc[:, new] += fro
            cc[new, new] += self_
            into[new] += freq[i]
            out[new] += n[i].sum()
            if new != old:
                moved += 1
                cls[i] = new
                left[:, old] -= n[:, i]
                left[:, new] += n[:, i]
                right[:, old] -= n[i]
                right[:, new] += n[i]
        if moved <= len(items) // 200:
            break
    return cls


def moved(train: DataFrame, text: str, shared, hot, gains, n: int) -> DataFrame:
    """(bucket, hashes, classes), packed, of the words outside the top: each goes
    to the class that the likelihood gains most by, given its neighbours' classes.

    ``shared`` tells the classes so far, ``hot`` the words to move (None: all), and
    ``gains`` has a row for each class that stands before a word, then for each
    that follows, and a column for each class that the word may go to. Tasks send
    how often a word has a neighbour class, once a slice, to the word's bucket.
    """

    def send(batches):
        voc, movable = Vocabulary(shared.value), hot and hot.value
        for b in slices(batches, text, LEARN_BYTES):
            number = voc.numbers(*tokens(b.column(text))[:2])
            moves = voc.known.find(voc.hashes) < 0
            if movable:
                moves &= movable.find(voc.hashes) >= 0
            cls = voc.values[number]
            at = np.flatnonzero(moves[number])  # never an end, so a token follows
            before = np.where(at > 0, cls[at - 1], 0)
            pairs, times = np.unique(np.concatenate([number[at] * 2 * CLASSES + before, number[at] * 2 * CLASSES + CLASSES + cls[at + 1]]), return_counts=True)
            word, place = pairs // (2 * CLASSES), (pairs % (2 * CLASSES)).astype("u1" if 2 * CLASSES <= 256 else "<u2")
            h = voc.hashes[word]
            for bucket, rows in split_by(range_bucket(h, n)):
                first = np.flatnonzero(np.diff(word[rows], prepend=-1))
                many = np.diff(np.append(first, len(rows))).astype("<u2")
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (h[rows][first], many, place[rows], times[rows].astype("<u4")))], ["bucket", "hashes", "many", "places", "times"])

    def choose(t: pa.Table) -> pa.Table:
        kind = "u1" if 2 * CLASSES <= 256 else "<u2"
        h, many = _cat(t, "hashes", np.uint64), _cat(t, "many", "<u2").astype(np.int64)
        words, which = np.unique(h, return_inverse=True)
        cell = np.repeat(which.ravel(), many) * (2 * CLASSES) + _cat(t, "places", kind)
        order = np.argsort(cell, kind="stable")
        cell, times = cell[order], _cat(t, "times", "<u4").astype(np.float64)[order]
        best = np.zeros(len(words), np.uint8 if CLASSES <= 256 else np.uint16)
        step = 4096  # words whose neighbour counts are spread out at once
        for a in range(0, len(words), step):
            x, y = np.searchsorted(cell, [a * 2 * CLASSES, (a + step) * 2 * CLASSES])
            own = np.bincount(cell[x:y] - a * 2 * CLASSES, weights=times[x:y], minlength=min(step, len(words) - a) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
            best[a : a + step] = np.argmax(own @ gains.value, axis=1)
        return pa.table({"bucket": t["bucket"].slice(0, 1), "hashes": pa.array([words.tobytes()], pa.binary()), "classes": pa.array([best.astype("<u2").tobytes()], pa.binary())})

    sent = train.mapInArrow(send, "bucket int, hashes binary, many binary, places binary, times binary")
    return sent.groupBy("bucket").applyInArrow(choose, "bucket int, hashes binary, classes binary")


def own_classes(train: DataFrame, text: str, shared, hot, gains, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and classes of the ``hot`` words, as ``moved`` has them."""
    rows = moved(train, text, shared, hot, gains, n).collect()
    join = lambda c, kind: np.frombuffer(b"".join(bytes(r[c]) for r in rows), kind)
    return join("hashes", np.uint64), join("classes", "<u2").astype(np.int64)


def classed(counts: DataFrame, moves: DataFrame, shared) -> DataFrame:
    """(bucket, hashes, counts, classes), packed and sorted by hash: all training
    words with their class. ``shared`` tells the classes of the words that didn't move."""

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        h, c, s = _cat(left, "hashes", np.uint64), _cat(left, "counts", np.int64), _cat(left, "shapes", "<u2").astype(np.int64)
        cls = shared.value.value_of(h, s)
        cls[np.searchsorted(h, _cat(right, "hashes", np.uint64))] = _cat(right, "classes", "<u2")
        return pa.table({"bucket": left["bucket"].slice(0, 1), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in (("hashes", h), ("counts", c), ("classes", cls.astype("<u2")))}})

    return counts.groupBy("bucket").cogroup(moves.groupBy("bucket")).applyInArrow(put, "bucket int, hashes binary, counts binary, classes binary")


def totals(table: DataFrame, least: int) -> tuple[np.ndarray, ...]:
    """Training tokens and distinct training tokens of each class; hashes, classes
    and counts of the words with a count of ``least`` or more."""

    def add(batches):
        tokens_, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for b in batches:
            for row in zip(*(b.column(x).to_pylist() for x in ("hashes", "counts", "classes"))):
                h, c, cls = (np.frombuffer(x, kind) for x, kind in zip(row, (np.uint64, np.int64, "<u2")))
                # sums of whole numbers under 2**53 are exact as floats
                tokens_ += np.bincount(cls, weights=c, minlength=CLASSES).astype(np.int64)
                distinct += np.bincount(cls, minlength=CLASSES)
                keep = c >= least
                yield pa.RecordBatch.from_arrays([*(pa.array([x[keep].tobytes()], pa.binary()) for x in (h, cls, c)), *(pa.array([None], pa.binary()) for _ in "tv")], names)
        yield pa.RecordBatch.from_arrays([*(pa.array([None], pa.binary()) for _ in names[:3]), *(pa.array([x.tobytes()], pa.binary()) for x in (tokens_, distinct))], names)

    names = ["hashes", "classes", "counts", "t", "v"]
    rows = table.select("hashes", "counts", "classes").mapInArrow(add, "hashes binary, classes binary, counts binary, t binary, v binary").collect()
    join = lambda c, kind: np.frombuffer(b"".join(bytes(r[c]) for r in rows if r[c] is not None), kind)
    t, v = (join(c, np.int64).reshape(-1, CLASSES).sum(0) for c in "tv")
    return t, v, join("hashes", np.uint64), join("classes", "<u2").astype(np.int64), join("counts", np.int64)


def move_gains(cc: np.ndarray) -> np.ndarray:
    """What the class-bigram likelihood gains by one token of a word in class k
    (columns) that follows, or stands before, a token of each class (rows): the
    first-order term of the exchange's gain. The end's class takes no word."""
    soft = cc + 0.5
    share = 0.5 * (np.log(soft.sum(0)) + np.log(soft.sum(1)))  # a word's tokens are counted once on each side
    gains = np.concatenate([np.log(soft) - share, np.log(soft).T - share])
    gains[:, 0] = -1e9
    return gains


def waiting(voc: Vocabulary, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice's tokens the codes of each and of the one before: its class, or
    ``CLASSES`` and the place in the slice's words that aren't known; where
    either is such a word; and these words' numbers."""
    code, rare = voc.values[number].astype(np.int64), voc.count[number] == 0
    own = number[rare]
    words = np.flatnonzero(np.bincount(own, minlength=1))
    place = np.zeros(len(voc.hash), np.int64)
    place[words] = np.arange(len(words))
    code[rare] = CLASSES + place[own]
    before = np.zeros_like(code)
    before[1:] = code[:-1]  # texts end with the end, and before the first stands one
    return before, code, np.flatnonzero((code >= CLASSES) | (before >= CLASSES)), words


_SENT = "bucket int, home int, part int, piece int, words binary, hashes binary, pairs binary, many binary, fall binary, stats binary"
_BACK = "home int, part int, piece int, words binary, classes binary, counts binary, pairs binary, many binary, fall binary, stats binary"


def asked(voc: Vocabulary, words: np.ndarray, n: int, part: int, piece: int, before: np.ndarray, code: np.ndarray, many: np.ndarray, stats: np.ndarray):
    """Batches of ``_SENT``: a slice's pairs that wait, to its home, and its words, to their buckets."""
    home, kind = (part * 7919 + piece) % n, _code_kind(len(words))
    at_home = [np.concatenate([before, code]).astype(kind), many.astype("<u4"), voc.values[words].astype("<u2"), stats]
    out, hashes = [(home, None, None, *at_home)], voc.hashes[words]
    for bucket, at in split_by(range_bucket(hashes, n)):
        out.append((bucket, at.astype("<u4"), hashes[at], None, None, None, None))
    for bucket, *arrays in out:
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (bucket, home, part, piece)), *(pa.array([None if x is None else x.tobytes()], pa.binary()) for x in arrays)], _names(_SENT))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _code_kind(words: int) -> str:
    return "<u2" if CLASSES + words < 1 << 16 else "<u4"


def answered(sent: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of ``_BACK``: the classes and counts of the words that ``table`` (of ``classed``)
    has, for the slices that asked; what waits at home as it is."""

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        known, count, cls = _cat(right, "hashes", np.uint64), _cat(right, "counts", np.int64), _cat(right, "classes", "<u2")
        out = []
        for home, part, piece, words, hashes, *at_home in zip(*(left[c].to_pylist() for c in _names(_SENT)[1:])):
            if hashes is None:
                out.append((home, part, piece, None, None, None, *at_home))
            elif len(known):
                w, h = np.frombuffer(words, "<u4"), np.frombuffer(hashes, np.uint64)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                out.append((home, part, piece, w[hit].tobytes(), cls[at[hit]].tobytes(), count[at[hit]].tobytes(), None, None, None, None))
        cols = list(zip(*out)) if out else [[]] * 10
        return pa.table({c: pa.array(x, pa.int32() if c in ("home", "part", "piece") else pa.binary()) for c, x in zip(_names(_BACK), cols)})

    return sent.groupBy("bucket").cogroup(table.select("bucket", "hashes", "counts", "classes").groupBy("bucket")).applyInArrow(look_up, _BACK)


def resolved(t: pa.Table):
    """Of each slice at home its waiting pairs: class before, class, count, whether the
    token's word was asked for; how many a text has; the texts' stats."""
    rows, answers = [], {}
    for part, piece, words, classes, counts, *at_home in zip(*(t[c].to_pylist() for c in _names(_BACK)[1:])):
        if words is None:
            rows.append(((part, piece), at_home))
        else:
            answers.setdefault((part, piece), []).append((words, classes, counts))
    for key, (pairs, many, fall, stats) in rows:
        fall = np.frombuffer(fall, "<u2")
        value, count = np.concatenate([np.arange(CLASSES), fall]), np.zeros(CLASSES + len(fall), np.int64)
        for words, classes, counts in answers.pop(key, ()):
            at = CLASSES + np.frombuffer(words, "<u4").astype(np.int64)
            value[at], count[at] = np.frombuffer(classes, "<u2"), np.frombuffer(counts, np.int64)
        before, code = np.frombuffer(pairs, _code_kind(len(fall))).reshape(2, -1).astype(np.int64)
        yield value[before], value[code], count[code], code >= CLASSES, np.frombuffer(many, "<u4"), stats


def class_bigrams(train: DataFrame, text: str, shared, table: DataFrame | None = None, n: int = 1) -> np.ndarray:
    """How often class b follows class a in training texts. Words that ``shared``
    doesn't count have the class that ``table`` tells; without it, none is asked for."""
    whole = table is None

    def pack(total: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])

    def add(batches):
        voc, total = Vocabulary(shared.value), np.zeros(CLASSES * CLASSES, np.int64)
        for b in slices(batches, text, SCORE_BYTES):
            number = voc.numbers(*tokens(b.column(text))[:2])
            cls = voc.values[number]
            total += np.bincount(np.concatenate([[0], cls[:-1]]) * CLASSES + cls, minlength=CLASSES * CLASSES)
        yield pack(total)

    def send(batches):
        voc, part, none = Vocabulary(shared.value), TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for piece, b in enumerate(slices(batches, text, LEARN_BYTES)):
            before, code, at, words = waiting(voc, voc.numbers(*tokens(b.column(text))[:2]))
            told = np.ones(len(code), bool)
            told[at] = False
            own = np.bincount(before[told] * CLASSES + code[told], minlength=CLASSES * CLASSES)
            yield from asked(voc, words, n, part, piece, before[at], code[at], none, own)

    def finish(t: pa.Table) -> pa.Table:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for before, cls, _, _, _, own in resolved(t):
            total += np.frombuffer(own, np.int64) + np.bincount(before * CLASSES + cls, minlength=CLASSES * CLASSES)
        return pa.Table.from_batches([pack(total)])

    rows = train.mapInArrow(add, "at long, n long") if whole else answered(train.mapInArrow(send, _SENT), table).groupBy("home").applyInArrow(finish, "at long, n long")
    out = np.zeros(CLASSES * CLASSES, np.int64)
    for at, times in rows.groupBy("at").agg(F.sum("n")).collect():
        out[at] = times
    return out.reshape(CLASSES, CLASSES)


class Model:
    """What a task needs to score: bounded by HOT and CLASSES. ``known`` tells
    the hot words' classes and counts, and the shapes' classes."""

    def __init__(self, known: Known, cc: np.ndarray, tokens_of: np.ndarray, distinct_of: np.ndarray):
        self.known = known
        into = (cc.sum(0) + 0.5) / (cc.sum() + 0.5 * CLASSES)
        self.step = np.log10((cc + BACK_OFF * into) / (cc.sum(1, keepdims=True) + BACK_OFF))
        self.room = np.log10(tokens_of + 0.5 * (distinct_of + 1))


def learned(train: DataFrame, text: str, counts: DataFrame, n_train: int, n: int) -> tuple[Model, int, DataFrame]:
    """The model of the training texts, the number of distinct tokens, and the
    table of all of them with their classes."""
    spark = train.sparkSession
    least = max(1, -(-n_train // HOT))
    top = np.array([END_HASH, *top_words(counts)], np.uint64)
    items = Known(top, np.arange(len(top)), 1 + TOP + np.arange(SHAPES))
    bigrams = item_bigrams(train, text, spark.sparkContext.broadcast(items))
    cls = exchange(bigrams)
    shapes = cls[1 + TOP :]
    one = np.zeros((N_ITEMS, CLASSES))
    one[np.arange(N_ITEMS), cls] = 1
    # the classes so far: TOP of them
    so_far = spark.sparkContext.broadcast(Known(top, cls[: len(top)], shapes))
    moves = moved(train, text, so_far, None, spark.sparkContext.broadcast(move_gains(one.T @ bigrams @ one)), n)
    table = written(classed(counts, moves, so_far), "classes")
    tokens_of, distinct_of, hot, classes, hot_counts = totals(table, least)
    told = np.union1d(hot, np.array([END_HASH], np.uint64))  # an end may be no hot word; its class is its own all the same
    times, own = np.zeros(len(told), np.int64), np.zeros(len(told), np.int64)
    times[np.searchsorted(told, hot)] = hot_counts  # 0: looked up in the buckets
    own[np.searchsorted(told, hot)] = classes
    known = Known(told, own, shapes, times)  # hot words and their counts: HOT of them
    shared = spark.sparkContext.broadcast(known)
    bigrams = class_bigrams(train, text, shared, table if least > 1 else None, n)
    return Model(known, bigrams, tokens_of, distinct_of), int(distinct_of.sum()), table


def learn(train: DataFrame, text: str, counts: DataFrame, n_train: int, n: int) -> tuple[Model, int]:
    """The model of the training texts, and the number of distinct tokens."""
    return learned(train, text, counts, n_train, n)[:2]


_STATS = np.dtype([("doc", "<i8"), ("null", "u1"), ("held", "u1"), ("n", "<i8"), ("known", "<i8"), ("sum", "<f8"), ("model", "<f8")])


def score(docs: DataFrame, held_out, train_docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is the boolean column of ``docs`` to report; the model is
    learned from ``train_docs``. doc_id is an integer."""
    spark = docs.sparkSession
    n = buckets_for(docs)
    train = train_docs.select(text)
    counts = written(word_counts(train, text, n), "words")
    n_train = counts.agg(F.sum("total")).first()[0] or 0
    own, n_distinct, table = learned(train, text, counts, n_train, n)
    model = spark.sparkContext.broadcast(own)
    step, room = own.step, own.room
    per_base = float(np.log10(n_train + 0.5 * (n_distinct + 1)))

    def send(batches):
        m = model.value
        voc, part = Vocabulary(m.known), TaskContext.get().partitionId()
        for piece, b in enumerate(slices(batches, text, SCORE_BYTES)):
            words, number, size = tokens(b.column(text))
            number = voc.numbers(words, number)
            doc = np.repeat(np.arange(len(size)), size)
            before, code, at, asks = waiting(voc, number)
            count = voc.count[number]
            known, told = count > 0, np.ones(len(code), bool)
            told[at] = False
            stats = np.zeros(len(size), _STATS)
            stats["null"] = np.asarray(b.column(key).is_null())
            stats["doc"] = np.asarray(b.column(key).fill_null(0), dtype=np.int64)
            stats["held"] = np.asarray(b.column("held_out"))
            stats["n"] = size
            stats["known"] = np.bincount(doc[known], minlength=len(size))
            stats["sum"] = np.bincount(doc[known], weights=np.log10(count[known] + 0.5), minlength=len(size))
            stats["model"] = np.bincount(doc[told], weights=m.step[before[told], code[told]] - m.room[code[told]], minlength=len(size))
            yield from asked(voc, asks, n, part, piece, before[at], code[at], np.bincount(doc[at], minlength=len(size)), stats)

    def finish(t: pa.Table) -> pa.Table:
        out = []
        for before, cls, count, rare, many, stats in resolved(t):
            s = np.frombuffer(stats, _STATS).copy()
            doc, size = np.repeat(np.arange(len(s)), many), len(s)
            s["model"] += np.bincount(doc, weights=step[before, cls] - room[cls], minlength=size)
            s["sum"] += np.bincount(doc[rare], weights=np.log10(count[rare] + 0.5), minlength=size)
            s["known"] += np.bincount(doc[count > 0], minlength=size)
            out.append(s)
        s = np.concatenate([np.zeros(0, _STATS), *out])
        doc = pa.array(s["doc"], mask=s["null"] > 0)
        return pa.table(
            {
                "doc_id": doc, "held_out": pa.array(s["held"] > 0), "n_tokens": pa.array(s["n"]), "n_known": pa.array(s["known"]),
                "train_tokens": pa.array(np.full(len(s), n_train)), "base_score": pa.array(s["sum"] - s["n"] * per_base), "score": pa.array(s["sum"] + s["model"]),
            }
        )

    sent = docs.select(F.col(key).cast("long").alias(key), text, held_out.alias("held_out")).mapInArrow(send, _SENT)
    return answered(sent, table).groupBy("home").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_of(F.col("doc_id")) % 5 == 1
    return score(docs, held_out, docs.where(~held_out))
