"""Operators 12 and 13 against the library and against brute force."""

import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from quillspark.llm import byte_bpe, periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, ids string, start string, words string"
ODD = ["", None, "   \n\t ", "a", "a a a a a a", "x" * 3000, " " * 500, "'ll've're's't'm'd 'l 're 'x 'rx ''s \n's  's !'s", "no　break\xa0space\r\n", "٣ 10 ½ 𐐷 中文 é", "<|endoftext|>", "a\x0bb\x0cc"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    letters = list("  \n''strevldmxyzAB12.,!é中")
    out = [(i, t) for i, t in enumerate(ODD)]
    out += [(100 + i, "".join(r.choice(letters) for _ in range(r.randint(0, 80)))) for i in range(150)]
    for i in range(300):
        few, text = [f"w{k}" for k in range(r.choice([1, 2, 3, 6]))], []
        while len(text) < r.randint(0, 90):
            text += [r.choice(few) for _ in range(r.randint(1, 7))] * (r.randint(2, 7) if r.random() < 0.4 else 1)
        out.append((1000 + i, " ".join(text)))
    # a key that holds a third of all rows, repeated rows, an unknown id
    out += [(7, out[200][1])] * 120 + [(None, "a b a b a b a b a b"), (5000, "long " * 20000 + "er")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_byte_bpe_equals_the_library(spark, docs, rows):
    ranks = byte_bpe.encoder().ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    got = byte_bpe.round_trip(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    for r in byte_bpe.round_trip(docs, full=True).where("doc_id is not null and doc_id < 300").collect():
        parts = [byte_bpe.encoder().token[i] for i in np.frombuffer(r.ids, "<u4")]
        assert list(r.starts) == [sum(map(len, parts[:k])) for k in range(len(parts))] and b"".join(parts) == bytes(r.decoded)
    assert byte_bpe.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_short_text_of_a_few_classes():
    """All texts of up to five of the code points that the machine tells apart."""
    from itertools import product

    ranks = byte_bpe.encoder().ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["".join(x) for n in range(1, 6) for x in product(" \n'sreLl1!", repeat=n)]
    ids, cuts = byte_bpe.encoder().encode_many([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == library.encode_ordinary_batch(texts, num_threads=2)


def test_functions_compose():
    """A prefix scan over functions gives the states of a step at a time, also
    over more positions than columns."""
    machine, r = byte_bpe.functions(), np.random.default_rng(1)
    symbols = r.integers(0, 10, 5000).astype(np.uint8)
    first = r.random(5000) < 0.01
    got, state = machine.states(machine.of[symbols + 10 * first]), byte_bpe.START
    for i in range(5000):
        state = byte_bpe.step(byte_bpe.START if first[i] else state, int(symbols[i]))
        assert got[i] == state


def test_long_matches_merge_as_short_ones():
    enc = byte_bpe.encoder()
    pieces = [b"unbelievablyinterestingthings"[:n] for n in range(2, 30)] + [b"a" * 64, b"ab" * 31]
    assert enc.merged(pieces) == [enc._long(p) for p in pieces]


def brute_runs(w):
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length, part = j - i + p, w[i : j + p]
            if length >= max(6, 4 * p) and not any(all(part[k] == part[k + q] for k in range(length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda t: (t[0], t[2]))


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    h, n = 0 if doc_id is None else crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = [(0, 20000, 1)] if doc_id == 5000 and h % 10 else brute_runs(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda t: (-Fraction(t[1], t[2]), t[0], t[2]), default=None)
    return (
        str(doc_id), len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode()),
    )


@pytest.mark.parametrize("at_once", [1 << 20, 50])
def test_periodic_runs_equal_brute_force(spark, docs, rows, at_once, monkeypatch):
    if at_once == 50:  # blocks that end within a grid; in this process
        monkeypatch.setattr(periodic, "PAIRS_AT_ONCE", at_once)
        some = [t for _, t in rows[150:260]]
        for t, runs in zip(some, periodic.described(pa.array(some), None)["runs"].to_pylist()):
            assert [tuple(x.values()) for x in runs] == brute_runs((t or "").split())
        return
    assert 5 < sum(crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    got = periodic.periodic_runs(docs, stretch=True, digests=True).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(key(brute_row(i, t)) for i, t in rows)
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_own_output_of_periodic_runs(spark):
    docs = spark.createDataFrame([(1, "b a a a a a a c"), (2, "a b  a b\na b a b x")], "doc_id long, text string")
    one, two = periodic.periodic_runs(docs).orderBy("doc_id").collect()
    assert (one.collapsed, one.n_runs, one.start, one.length, one.period, one.exponent_milli) == ("b a c", 1, 1, 6, 1, 6000)
    assert two.collapsed == "a b x" and [tuple(r) for r in two.runs] == [(0, 8, 2)] and two.n_words == 9


def test_a_wrong_hash_does_no_harm(monkeypatch):
    """Hashes that always agree: words decide."""
    monkeypatch.setattr(periodic.PrefixHashes, "agree", lambda self, at, p, length: np.ones(len(at), bool))
    texts = ["a a a a a a b a b a b a b c", "a b c d a b", "q q q q q q"]
    out = periodic.described(pa.array(texts), None)["runs"].to_pylist()
    assert [[tuple(x.values()) for x in runs] for runs in out] == [brute_runs(t.split()) for t in texts]


def test_buckets_follow_the_size_of_the_texts(spark):
    """One large partition makes as many buckets as many small ones: a bucket's share of the text is bounded."""
    from quillspark.llm import common

    docs = spark.createDataFrame([(i, "x" * 5000) for i in range(20)], "doc_id long, text string").coalesce(1)
    assert common.buckets_by_size(docs, "text", 1000) == 100
    assert common.buckets_by_size(docs, "text") == common.buckets_for(docs) and common.buckets_by_size(docs.limit(0), "text") >= 1
