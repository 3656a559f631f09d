"""Operator 12: byte-level BPE, with boundaries found by a scan.

A match of the tokenizers' pattern is found by a machine that reads classes
of code points: blank, other white space, apostrophe, letters (those of the
short endings apart), numbers, the rest. What a code point does to the
machine is a function from states to states, and functions compose
associatively, so the states of all positions come from a prefix scan: the
text is laid out in columns, functions are composed down all columns at once
(by a table over the finite set of functions that can arise), then across
them. A position begins a match by its own state and its neighbours' states.
The first code point of a text resets the machine, so a slice of many texts is
one scan.

The slices between boundaries are numbered by Arrow; distinct ones that a
worker doesn't remember are merged, thousands side by side: in each round
every slice merges its leftmost pair of least rank. A slice that is a token
as a whole is that token, as in the library. The lengths of the tokens give
the offsets by which ids are decoded.

Which code points are letters, numbers or white space is asked of the library
once a worker, as versions of Unicode differ.

Defined cases: a null text counts as empty (no ids, empty decoding). Strings
of special tokens are ordinary text. A very long text is a slice of its own,
whole, at some 60 bytes a code point; so is a very long match. Extra columns are dropped, whatever their
names. Repeated rows are encoded each for itself; a null doc_id is kept. An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .bpe import Store
from .common import WORD_BYTES, raw, slices

RANKS = "byte_bpe_50k.tiktoken"
#: Encoded matches that a worker remembers. When the store is full, what the
#: last full store didn't use is dropped.
KEPT_MATCHES = 250_000
#: Matches of up to so many bytes are merged side by side, by size; longer ones with a heap.
WIDTHS = (8, 16, 32, 64)
NO_RANK = np.int32(2**31 - 1)

# -- the machine --------------------------------------------------------------

#: What a code point is. The endings 's 't 'm 'd take ONE letter, 're 've
#: FIRST and E, 'll two of ELL.
BLANK, WHITE, MARK, OTHER, NUMBER, LETTER, ONE, FIRST, E, ELL = range(10)
#: What the last code point was: START none, AT_MARK an apostrophe that begins
#: a match, HALF and AT_ELL a letter after it that may become an ending, DONE
#: the last letter of an ending.
START, AT_BLANK, AT_WHITE, AT_MARK, AT_OTHER, AT_NUMBER, AT_LETTER, HALF, AT_ELL, DONE = range(10)
STATES = 10
_PLAIN = {BLANK: AT_BLANK, WHITE: AT_WHITE, MARK: AT_MARK, OTHER: AT_OTHER, NUMBER: AT_NUMBER}
_ENDING = {(AT_MARK, ONE): DONE, (AT_MARK, FIRST): HALF, (AT_MARK, ELL): AT_ELL, (HALF, E): DONE, (AT_ELL, ELL): DONE}
#: An apostrophe after these goes on with their match.
_HOLDS = (AT_BLANK, AT_MARK, AT_OTHER)


def step(state: int, symbol: int) -> int:
    if symbol == MARK and state in _HOLDS:
        return AT_OTHER
    return _ENDING.get((state, symbol), _PLAIN.get(symbol, AT_LETTER))


#: Whether a match begins at a code point, by the state before and after it:
#: never, always, if a code point that isn't white follows, unless an ending
#: is done with the next.
NEVER, ALWAYS, BEFORE_TEXT, NO_ENDING = range(4)


def begins(before: int, now: int) -> int:
    white = before in (AT_BLANK, AT_WHITE)
    if now in (AT_BLANK, AT_WHITE):
        return BEFORE_TEXT if white else ALWAYS
    if white or before == START:
        return NEVER if before == AT_BLANK else ALWAYS
    if now in (HALF, AT_ELL):
        return NO_ENDING
    goes_on = {AT_NUMBER: (AT_NUMBER,), AT_OTHER: (AT_OTHER, AT_MARK), AT_LETTER: (AT_LETTER, HALF, AT_ELL), DONE: (AT_MARK, HALF, AT_ELL)}
    return NEVER if before in goes_on.get(now, ()) else ALWAYS


class Functions:
    """The functions from states to states that sequences of code points can
    be, numbered: ``of[symbol]`` and, for a text's first, ``of[symbol + 10]``;
    ``then[f * n + g]`` is f followed by g, ``at[f * STATES + state]`` its value."""

    def __init__(self):
        symbols = range(10)
        plain = [tuple(step(s, x) for s in range(STATES)) for x in symbols]
        first = [(step(START, x),) * STATES for x in symbols]
        makers = plain + first
        known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(STATES)), *makers]))}
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in makers:
                h = tuple(g[s] for s in f)
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
        table = np.array(list(known), np.uint8)
        self.n, self.identity = len(known), known[tuple(range(STATES))]
        self.of = np.array([known[f] for f in makers], np.uint16)
        self.then = np.array([[known[tuple(g[f].tolist())] for g in table] for f in table], np.uint16).ravel()
        self.at = table.ravel()

    def prefixes(self, x: np.ndarray) -> np.ndarray:
        """The composition of x[0] to x[i], for each i."""
        n = len(x)
        if n <= 64:
            out, f = np.empty(n, np.uint16), self.identity
            for i, g in enumerate(x.tolist()):
                f = out[i] = self.then[int(f) * self.n + g]
            return out
        down, columns = self._down(x)
        before = np.full(columns, self.identity, np.uint16)
        before[1:] = self.prefixes(down[-1])[:-1]
        return self.then[before.astype(np.int32) * self.n + down].T.ravel()[:n]

    def _down(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        n = len(x)
        columns = int(n**0.5) + 1
        rows = -(-n // columns)
        held = np.full(columns * rows, self.identity, np.uint16)
        held[:n] = x
        down = np.ascontiguousarray(held.reshape(columns, rows).T)
        at = np.empty(columns, np.int32)
        for i in range(1, rows):
            np.multiply(down[i - 1], self.n, out=at, casting="unsafe")
            at += down[i]
            down[i] = self.then[at]
        return down, columns

    def states(self, x: np.ndarray) -> np.ndarray:
        """The state after each position, from START."""
        if not len(x):
            return np.zeros(0, np.uint8)
        down, columns = self._down(x)
        enter = np.zeros(columns, np.int32)
        enter[1:] = self.at[self.prefixes(down[-1])[:-1].astype(np.int32) * STATES + START]
        return self.at[down.astype(np.int32) * STATES + enter].T.ravel()[: len(x)]


@lru_cache(1)
def functions() -> Functions:
    return Functions()


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}

    def of(pattern: str) -> np.ndarray:
        """Code points of a Unicode class: what is left of all of them."""
        left = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        return np.frombuffer(bytes(left).decode().encode("utf-32-le"), "<u4")

    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        out[of(pattern)] = kind
    for letters, kind in ((" ", BLANK), ("'", MARK), ("stmd", ONE), ("rv", FIRST), ("e", E), ("l", ELL)):
        out[[ord(c) for c in letters]] = kind
    return out


@lru_cache(1)
def _begins() -> np.ndarray:
    return np.array([[begins(a, b) for b in range(STATES)] for a in range(STATES)], np.uint8).ravel()


def boundaries(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets where matches begin in the joined texts, number of
    matches of each text)."""
    code = [np.frombuffer(t.decode().encode("utf-32-le"), "<u4") for t in texts]
    sizes = np.fromiter(map(len, code), np.int64, len(code))
    points = np.concatenate(code) if code else np.zeros(0, "<u4")
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    first = np.zeros(n + 1, bool)
    first[np.cumsum(sizes)] = True
    first[0], last = True, first[1:]
    symbol = classes()[points]
    machine = functions()
    now = machine.states(machine.of[symbol + np.uint8(10) * first[:-1]])
    before = np.zeros(n, np.uint8)
    before[1:] = now[:-1]
    before[first[:-1]] = START
    after = np.zeros(n, np.uint8)
    after[:-1] = now[1:]
    after[last] = START
    kind = _begins()[before * np.uint8(STATES) + now]
    text_next = (after != AT_BLANK) & (after != AT_WHITE) & (after != START)
    start = (kind == ALWAYS) | ((kind == BEFORE_TEXT) & text_next) | ((kind == NO_ENDING) & (after != DONE))
    width = np.ones(n, np.int64)
    for least in (0x80, 0x800, 0x10000):
        width += points >= least
    at = np.cumsum(width) - width
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=edges[1:])
    counted = np.zeros(n + 1, np.int64)
    np.cumsum(start, out=counted[1:])
    return at[start], np.diff(counted[edges])


# -- merging ------------------------------------------------------------------


class Pairs:
    """(token, token) -> the rank of the token that both make, as an open
    table: the next place is tried until a key or a free place is met."""

    _FACTOR = np.uint64(0x9E3779B97F4A7C15)
    _FREE = np.uint64(2**64 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, self._FREE), np.full(1 << bits, NO_RANK, np.int32)
        key, value = np.array(keys, np.uint64), np.array(values, np.int32)
        at = self._at(key)
        while len(key):
            free = self.keys[at] == self._FREE
            self.keys[at[free]] = key[free]  # of several for one place the last stays
            self.values[at[free]] = value[free]
            put = free & (self.keys[at] == key)
            key, value, at = key[~put], value[~put], (at[~put] + 1) & self.mask

    def _at(self, key: np.ndarray) -> np.ndarray:
        return ((key * self._FACTOR) >> self.shift).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self._at(key)
        held = self.keys[at]
        out = self.values[at]
        lost = np.flatnonzero((held != key) & (held != self._FREE))
        out[held != key] = NO_RANK
        at = at[lost]
        while len(lost):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == key[lost]
            out[lost[hit]] = self.values[at[hit]]
            go = ~hit & (held != self._FREE)
            lost, at = lost[go], at[go]
        return out


class ByteBpe:
    """The encoder of one file of ranks."""

    def __init__(self, name: str = RANKS):
        with open(public_tokenizers.path(name), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pairs = Pairs(self.ranks)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        most = max(self.ranks.values()) + 1
        self.token = [b""] * most
        for token, i in self.ranks.items():
            self.token[i] = token
        self.tokens = pa.array(self.token, pa.large_binary())
        self.length = np.fromiter(map(len, self.token), np.int64, most)
        self.known = Store(KEPT_MATCHES)  # match -> packed ids

    def merged(self, matches: list[bytes]) -> list[bytes]:
        """Packed ids of each."""
        out: list[bytes | None] = [None] * len(matches)
        sizes = np.fromiter(map(len, matches), np.int64, len(matches))
        least = 0
        for width in WIDTHS:
            rows = np.flatnonzero((sizes > least) & (sizes <= width))
            if len(rows):
                for i, ids in zip(rows.tolist(), self._side_by_side([matches[i] for i in rows.tolist()], sizes[rows], width)):
                    out[i] = ids
            least = width
        for i in np.flatnonzero(sizes > least).tolist():
            out[i] = self._long(matches[i])
        return out

    def _side_by_side(self, matches: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        n = len(matches)
        letters = np.array(matches, dtype=f"S{width}").view(np.uint8).reshape(n, width)
        ids = np.zeros((n, width + 1), np.int32)
        ids[:, :width] = self.single[letters]
        place = np.arange(width + 1)
        alive = place[None, :] < sizes[:, None]
        after = np.broadcast_to((place + 1).astype(np.int16), ids.shape).copy()
        before = after - 2
        rank = np.full(ids.shape, NO_RANK, np.int32)
        paired = alive[:, 1:]  # a symbol that has a next one
        rank[:, :-1][paired] = self.pairs.of(ids[:, :-1][paired], ids[:, 1:][paired])
        rows = np.arange(n)
        while True:
            j = rank[rows].argmin(1)
            best = rank[rows, j]
            go = best != NO_RANK
            rows, j, best = rows[go], j[go], best[go]
            if not len(rows):
                break
            k = after[rows, j]
            ids[rows, j], alive[rows, k], rank[rows, k] = best, False, NO_RANK
            far = after[rows, k]
            after[rows, j] = far
            inside = far < sizes[rows]
            rank[rows, j] = NO_RANK
            r, a, b = rows[inside], j[inside], far[inside]
            before[r, b] = a
            rank[r, a] = self.pairs.of(ids[r, a], ids[r, b])
            back = before[rows, j]
            inside = back >= 0
            r, a, b = rows[inside], back[inside], j[inside]
            rank[r, a] = self.pairs.of(ids[r, a], ids[r, b])
        blob = ids[alive].astype("<u4").tobytes()
        cuts = np.zeros(n + 1, np.int64)
        np.cumsum(4 * alive.sum(1), out=cuts[1:])
        cuts = cuts.tolist()
        return [blob[x:y] for x, y in zip(cuts, cuts[1:])]

    def _long(self, match: bytes) -> bytes:
        """One long match: pairs wait in a heap by rank and place."""
        ids = self.single[np.frombuffer(match, np.uint8)]
        n = len(ids)
        first = self.pairs.of(ids[:-1], ids[1:])
        waiting = [(r, i) for i, r in enumerate(first.tolist()) if r != NO_RANK]
        heapq.heapify(waiting)
        parts: list[bytes | None] = [match[i : i + 1] for i in range(n)]
        now, after, before = first.tolist() + [int(NO_RANK)], list(range(1, n + 1)), list(range(-1, n - 1))

        def judge(i: int) -> None:
            k = after[i]
            r = self.ranks.get(parts[i] + parts[k]) if k < n else None
            now[i] = int(NO_RANK) if r is None else r
            if r is not None:
                heapq.heappush(waiting, (r, i))

        while waiting:
            r, i = heapq.heappop(waiting)
            if parts[i] is None or now[i] != r:
                continue
            k = after[i]
            parts[i], parts[k] = parts[i] + parts[k], None
            after[i] = after[k]
            if after[i] < n:
                before[after[i]] = i
            judge(i)
            if before[i] >= 0:
                judge(before[i])
        return b"".join(self.ranks[p].to_bytes(4, "little") for p in parts if p is not None)

    def learn(self, matches: set[bytes]) -> dict[bytes, bytes]:
        """A dict that has every one of the matches."""
        lacking = list(self.known.lacking(matches))
        whole = list(map(self.ranks.get, lacking))
        now = self.known.now
        now.update((m, i.to_bytes(4, "little")) for m, i in zip(lacking, whole) if i is not None)
        split = [m for m, i in zip(lacking, whole) if i is None]
        now.update(zip(split, self.merged(split)))
        return now

    def encode_many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin)."""
        at, counts = boundaries(texts)
        blob = b"".join(texts)
        wide = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(blob)).astype("<i8")), pa.py_buffer(blob)])
        numbered = wide.dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        known = self.learn(set(distinct))
        packed = pa.array(list(map(known.__getitem__, distinct)), pa.large_binary()).take(numbered.indices)
        cuts = np.zeros(len(texts) + 1, np.int64)
        if len(packed):
            ends = np.frombuffer(packed.buffers()[1], np.int64)[: len(packed) + 1]
            cuts[1:] = ends[np.cumsum(counts)] // 4
            return np.frombuffer(packed.buffers()[2], "<u4")[: cuts[-1]], cuts
        return np.zeros(0, "<u4"), cuts

    def decode_many(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(bytes of all texts, where each text begins, where each token begins)."""
        starts = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.length[ids], out=starts[1:])
        data = self.tokens.take(pa.array(ids, pa.uint32())).buffers()[2] if len(ids) else None
        return (data.to_pybytes()[: starts[-1]] if data is not None else b""), starts[cuts], starts[:-1]


@lru_cache(2)
def encoder(name: str = RANKS) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(name)


def round_trip(docs: DataFrame, ranks: str = RANKS, key: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """doc_id, ids (packed little-endian), starts (the byte at which each
    token begins) and decoded if ``full``; else doc_id, n_tokens, ids_sha256,
    decoded_sha256."""
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(ranks)
        for b in slices(batches, text, WORD_BYTES):
            ids, cuts = enc.encode_many(raw(b.column(text)))
            decoded, edges, starts = enc.decode_many(ids, cuts)
            blob, at, text_at = ids.tobytes(), (4 * cuts).tolist(), edges.tolist()
            packed = [blob[x:y] for x, y in zip(at, at[1:])]
            texts = [decoded[x:y] for x, y in zip(text_at, text_at[1:])]
            if full:
                own = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(starts - np.repeat(edges[:-1], np.diff(cuts)), pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(packed, pa.binary()), own, pa.array(texts, pa.binary())], ["doc_id", "ids", "starts", "decoded"])
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(key),
                    pa.array(np.diff(cuts), pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    columns = "ids binary, starts array<long>, decoded binary" if full else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text).mapInArrow(run, f"doc_id {id_type}, {columns}")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by bytes and decoded again, as digests."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
