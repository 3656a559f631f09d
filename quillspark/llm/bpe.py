"""Operator 5: BPE encoding and decoding over a trie of distinct words.

The distinct words of a slice are walked in sorted order, which is a
depth-first walk of their trie; the stack holds, for each prefix on the path,
the last token of the prefix's encoding. A prefix that words share is
encoded once. The last token of a prefix is the one among its suffixes that
are tokens which may follow the last token of what stands before it. Two
tokens may stand side by side if no merge across their border would come
before the merges that make them. A word's ids follow from the last tokens,
from its end backwards.

Normalising and splitting into pre-tokens follow the tokenizer's file;
ASCII words take a short way with the same result.

Defined cases: a null text counts as empty (no ids, empty decoding). The
special tokens' strings in a text become their ids, as in the library. A very
long text is a slice of its own, whole. Extra columns are dropped, whatever their
names. Repeated rows are encoded each for itself; a null doc_id is kept. An empty
table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import WORD_BYTES, raw, slices, table

TOKENIZER = "word_bpe_49k.json"
#: Encoded words, pre-tokens, token pairs and automaton moves that a worker remembers. When a
#: store is full, what the last full store didn't use is dropped.
KEPT_WORDS, KEPT_TOKENS, KEPT_PAIRS, KEPT_MOVES = 250_000, 200_000, 300_000, 300_000
#: Stands before a word, as no token.
START = -1
#: Up to so many bytes, the ids of each prefix on the path are at hand.
SHORT = 64

_ASCII_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0da-z0-9]+").findall
#: Printable words below U+0250, which are all in normal form C.
_LATIN = re.compile("[!-~\xa1-\u024f]+").fullmatch


def _latin_pretoken():
    """Splits lower-cased words of that kind, a line each; an end of line is
    a match of its own."""
    of = lambda kind: "".join(chr(c) for c in range(128, 0x250) if unicodedata.category(chr(c))[0] == kind)
    letter, number = "a-z" + of("L"), "0-9" + of("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|\n|[^\n{letter}{number}]+").findall


_LATIN_PRETOKEN = _latin_pretoken()


class Store:
    """Two dicts of bounded size: ``now`` has what was used since the last
    turn, ``old`` what was used in the turn before."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def lacking(self, keys: set) -> set:
        """The keys that aren't here; those that are will be in ``now``."""
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now
        missing = keys.difference(self.now)
        lacking = missing.difference(self.old)
        missing -= lacking
        self.now.update(zip(missing, map(self.old.__getitem__, missing)))
        return lacking


def shared_prefixes(words: list[bytes], most: int = 32) -> list[int]:
    """How many bytes of a path over all but the last byte each word shares
    with the one before it."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.array(words, dtype=f"S{most}").view(np.uint8).reshape(-1, most)
    other = letters[1:] != letters[:-1]
    equal = np.where(other.any(1), other.argmax(1), most)
    shared = np.minimum(equal, np.minimum(sizes[1:], sizes[:-1]) - 1).tolist()
    for i in np.flatnonzero(equal == most).tolist():  # long ones: the rest of the path
        a, b = words[i], words[i + 1]
        k, end = shared[i], min(len(a), len(b)) - 1
        while k < end and a[k] == b[k]:
            k += 1
        shared[i] = k
    return [0, *shared]


class State(dict):
    """A state of the automaton over the vocabulary: byte -> the next
    state. ``text`` is the longest ending of what was read that some token
    begins with; ``inside`` and ``closing`` are the tokens that end here,
    within a word and at its end, as (size, id, packed id, fits), longest
    first."""

    __slots__ = ("closing", "inside", "machine", "text")

    def __init__(self, machine: "Automaton", text: bytes):
        super().__init__()
        endings = [text[i:] for i in range(len(text))]
        self.machine, self.text = machine, text
        self.inside = tuple((len(x), *machine.inside[x]) for x in endings if x in machine.inside)
        self.closing = tuple((len(x), *machine.closing[x]) for x in endings if x in machine.closing)

    def __missing__(self, byte: int) -> "State":
        state = self[byte] = self.machine.state(self.text + bytes((byte,)))
        self.machine.moves += 1
        return state


class Automaton:
    """States are made when they are first reached."""

    def __init__(self, inside: dict[bytes, tuple], closing: dict[bytes, tuple]):
        self.inside, self.closing = inside, closing
        self.begun = {t[:i] for t in chain(inside, closing) for i in range(1, len(t) + 1)}
        self.reset()

    def reset(self) -> None:
        self.moves, self.states = 0, {}
        self.start = self.state(b"")

    def state(self, read: bytes) -> State:
        while read and read not in self.begun:
            read = read[1:]
        found = self.states.get(read)
        if found is None:
            found = self.states[read] = State(self, read)
        return found


class Fits(dict):
    """For one token: the token before it -> whether they may stand so."""

    __slots__ = ("encoder", "token")

    def __init__(self, encoder: "WordPieces", token: int):
        super().__init__()
        self.encoder, self.token = encoder, token

    def __missing__(self, before: int) -> bool:
        fit = self[before] = self.encoder.fits(before, self.token)
        self.encoder.judged += 1
        return fit


class WordPieces:
    """The encoder of one tokenizer file, for words without ASCII white space."""

    def __init__(self, name: str = TOKENIZER):
        path = public_tokenizers.path(name)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["model"]["vocab"]
        self.end = model["model"]["end_of_word_suffix"] or ""
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"])
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special_pattern = re.compile("|".join(f"({re.escape(t)})" for t in self.special) or "(?!)")
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        cut = len(self.end)
        self.packed = {i: i.to_bytes(4, "little") for i in self.vocab.values()}
        self.judged, self.pairs = 0, {i: Fits(self, i) for i in self.vocab.values()}
        self.automaton = Automaton(
            {self._bytes(t): (i, self.packed[i], self.pairs[i]) for t, i in self.vocab.items() if not t.endswith(self.end)},
            {self._bytes(t[:-cut]): (i, self.packed[i], self.pairs[i]) for t, i in self.vocab.items() if t.endswith(self.end) and len(t) > cut},
        )
        self.size_of = {i: len(t) - cut * (t.endswith(self.end) and len(t) > cut) for t, i in self.vocab.items()}
        #: token -> the tokens it is merged from, and the merge's rank
        self.parts = {self.vocab[a + b]: (self.vocab[a], self.vocab[b], r) for (a, b), r in self.ranks.items()}
        self.ends: dict[int, list] = {}
        self.starts: dict[int, list] = {}
        self.tokens = Store(KEPT_TOKENS)  # pre-token -> packed ids
        self.words = Store(KEPT_WORDS)  # word -> packed ids

    # -- splitting ---------------------------------------------------------

    def pretokens(self, word: bytes) -> list[bytes]:
        text = word.decode()
        if text.isascii():
            return [x.encode() for x in _ASCII_PRETOKEN(text.lower())]
        text = self.library.normalizer.normalize_str(text)
        return [self._bytes(x) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pretokens_of(self, words: list[bytes]) -> dict[bytes, list[bytes]]:
        """Pre-tokens of each word; Latin ones are split all at once."""
        if not words:
            return {}
        texts = b"\n".join(words).decode().split("\n")
        latin = [w for w, text in zip(words, texts) if _LATIN(text)]
        out = {}
        if latin:
            found = _LATIN_PRETOKEN(b"\n".join(latin).decode().lower())
            out = dict(zip(latin, map(bytes.split, " ".join(found).encode().split(b"\n"))))
        if len(latin) < len(words):
            out |= {w: self.pretokens(w) for w in words if w not in out}
        return out

    @staticmethod
    @lru_cache(1)
    def _alphabet() -> dict[int, int]:
        """The vocabulary's characters for bytes: printable Latin-1 bytes
        stand for themselves, the rest from 256 on."""
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in own]
        return {256 + i: b for i, b in enumerate(rest)}

    def _bytes(self, token: str) -> bytes:
        return token.translate(self._alphabet()).encode("latin-1")

    # -- the model ---------------------------------------------------------

    def _spine(self, token: int, right: bool) -> list[tuple[str, int]]:
        """The parts at one end of a token, from the token down to a symbol,
        each with the rank of the merge that uses it up."""
        out, until = [], 1 << 30
        while True:
            out.append((self.names[token], until))
            pair = self.parts.get(token)
            if pair is None:
                return out
            until, token = pair[2], pair[1 if right else 0]

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens may stand side by side: no merge across their
        border comes before both sides of it are used up. Of equal merges the
        left one comes first."""
        if a == START:
            return True
        left, right = self.ends.get(a), self.starts.get(b)
        if left is None:
            left = self.ends[a] = self._spine(a, True)
        if right is None:
            right = self.starts[b] = self._spine(b, False)
        ranks = self.ranks
        for x, until_x in left:
            for y, until_y in right:
                m = ranks.get((x, y))
                if m is not None and m < until_x and m <= until_y:
                    return False
        return True

    def encode_sorted(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of sorted distinct pre-tokens in the vocabulary's
        characters."""
        packed = self.walk([self._bytes(w) for w in words])
        return ((w, np.frombuffer(p, "<u4").tolist()) for w, p in zip(words, packed))

    def walk(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of sorted distinct pre-tokens."""
        if not words:
            return []
        done, size_of, packed = [], self.size_of, self.packed
        if self.judged > KEPT_PAIRS:
            self.judged = 0
            for fits in self.pairs.values():
                fits.clear()
        if self.automaton.moves > KEPT_MOVES:
            self.automaton.reset()
        # for each prefix on the path: its last token, the automaton's state,
        # and (up to SHORT bytes) its ids
        last, path, ids = [START], [self.automaton.start], [b""]
        for word, shared in zip(words, shared_prefixes(words)):
            n, i = len(word), shared
            del last[shared + 1 :], path[shared + 1 :], ids[shared + 1 :]
            state = path[-1]
            for byte in word[shared : min(n - 1, SHORT)]:
                i += 1
                state = state[byte]
                for size, token, own, fits in state.inside:
                    if fits[last[i - size]]:
                        break
                last.append(token)
                path.append(state)
                ids.append(ids[i - size] + own)
            for byte in word[i : n - 1]:
                i += 1
                state = state[byte]
                for size, token, _, fits in state.inside:
                    if fits[last[i - size]]:
                        break
                last.append(token)
                path.append(state)
            for size, token, own, fits in state[word[-1]].closing:
                if fits[last[n - size]]:
                    break
            at = n - size
            if at < len(ids):
                done.append(ids[at] + own)
                continue
            out = [own]
            while at >= len(ids):
                token = last[at]
                out.append(packed[token])
                at -= size_of[token]
            out.append(ids[at])
            out.reverse()
            done.append(b"".join(out))
        return done

    def learn(self, words: set[bytes]) -> None:
        """Make sure that ``self.words.now`` has every word."""
        # Many small lists live at once here; none is part of a cycle.
        collecting = gc.isenabled()
        gc.disable()
        try:
            lacking = self.words.lacking(words)
            plain = [w for w in lacking if w.isalpha()]  # of ASCII letters: one pre-token
            lower = b"\n".join(plain).lower().split(b"\n") if plain else []
            split = self.pretokens_of(list(lacking.difference(plain)))
            fresh = sorted(self.tokens.lacking(set(lower).union(*split.values())))
            tokens = self.tokens.now
            tokens.update(zip(fresh, self.walk(fresh)))
            of = tokens.__getitem__
            self.words.now.update(zip(plain, map(of, lower)))
            self.words.now.update([(w, b"".join(map(of, parts))) for w, parts in split.items()])
        finally:
            if collecting:
                gc.enable()

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each text. Arrow
        splits the texts, numbers the distinct words and lays out the ids."""
        special = {i: parts for i, t in enumerate(texts) if b"<|" in t and (parts := self._parts(t))}
        words = pc.ascii_split_whitespace(pa.array([b"" if i in special else t for i, t in enumerate(texts)], pa.string()))
        numbered = words.flatten().dictionary_encode()
        distinct = numbered.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self.learn(set(distinct).union(*[p for parts in special.values() for p in parts if isinstance(p, list)]) - {b""})
        known = self.words.now
        known[b""] = b""
        ids = pa.array(list(map(known.__getitem__, distinct)), pa.large_binary()).take(numbered.indices)
        cuts = np.zeros(1, np.int64) if not len(ids) else np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        at = cuts[np.asarray(words.offsets)].tolist()
        blob = memoryview(ids.buffers()[2] or b"")
        out = [bytes(blob[x:y]) for x, y in zip(at, at[1:])]
        for i, parts in special.items():
            out[i] = b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(known.__getitem__, p)) for p in parts])
        return out

    def _parts(self, text: bytes) -> list[list[bytes] | int] | None:
        """A text that holds special tokens: their ids, and the words between."""
        pieces = self.special_pattern.split(text.decode())
        if len(pieces) < 2:
            return None
        return [self.special[p] if p in self.special else p.encode().split() for p in pieces if p is not None]

    def decode(self, packed: bytes) -> bytes:
        """The library's decoding for a file without a decoder: the tokens'
        strings, with a blank between."""
        return b" ".join([self._name(i) for i in np.frombuffer(packed, "<u4").tolist()])

    def _name(self, i: int) -> bytes:
        return self.encoded_names[i]

    @property
    def encoded_names(self) -> dict[int, bytes]:
        if not hasattr(self, "_names"):
            self._names = {i: t.encode() for i, t in self.names.items()}
        return self._names


@lru_cache(2)
def encoder(name: str = TOKENIZER) -> WordPieces:
    """One per worker process."""
    return WordPieces(name)


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """doc_id, ids (packed little-endian), decoded: the operator's own output
    if ``full``; else doc_id, n_tokens, ids_sha256, decoded_sha256."""
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer)
        names = enc.encoded_names
        for b in slices(batches, text, WORD_BYTES):
            packed = enc.encode_many(raw(b.column(text)))
            decoded = [b" ".join(map(names.__getitem__, np.frombuffer(p, "<u4").tolist())) for p in packed]
            if full:
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(key),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    columns = "ids binary, decoded string" if full else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text).mapInArrow(run, f"doc_id {id_type}, {columns}")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, as digests."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
