"""Operator 11 against brute force, with conversations over many ranges."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from quillspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, a string, n string, depth string"


def brute(rows, borrows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0), role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    turns = {c: [(r, t) for _, r, _, t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % 4 if borrows else 0
        built[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        words = len(node[-1][1].split()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own) - 1) * words
    return sorted(
        (min(own), len(node), min(members[node[:-1]]) if node else -1, len(own), children[node], leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, own in members.items()
    )


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def made(seed, convs, few):
    r, out = random.Random(seed), []
    for c in r.sample(range(10 * convs), convs):
        for t in range(r.randint(1, 9)):
            turn = r.choice([t, t, t, None, 2])
            out.append((c, turn, r.choice(["user", "user", "assistant", None]), r.choice([None, "", "one two", " three\tfour five ", *[f"t{k}" for k in range(few)]])))
    # a third of all rows in one conversation, repeated rows, no id, equal conversations
    out += [(5, t, "user", f"long {t % 7}") for t in range(400)] + [(6, 1, "user", "same")] * 30 + [(None, 0, "user", "lost")] * 3
    out += [(20 * k, t, "user", "hello there") for k in range(convs, convs + 60) for t in range(2)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed,few,borrows", [(1, 1, True), (2, 30, True), (3, 2, False)])
def test_trie_equals_brute_force(spark, seed, few, borrows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURNS_A_BLOCK", 50)
    rows = made(seed, 120, few)
    frame = spark.createDataFrame([(*x, "A", "N", "D") for x in rows], SCHEMA).repartition(5)
    assert got(prefix_trie.prefix_trie(frame, borrows)) == brute(rows, borrows)


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(empty, True).count() == 0
    # 2 leaves out its only turn (crc % 4 is over 0), and its family has no first conversation
    lone = next(c for c in range(1, 20) if crc32(str(c).encode()) % 4)
    rows = [(lone, 0, "user", "x y")]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame([(*x, "", "", "") for x in rows], SCHEMA), True)) == brute(rows, True) == [(lone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_arithmetic_modulo_the_prime():
    r = random.Random(1)
    x = [r.randrange(prefix_trie.PRIME) for _ in range(2000)] + [0, 1, prefix_trie.PRIME - 1]
    y = [r.randrange(prefix_trie.PRIME) for _ in range(2000)] + [prefix_trie.PRIME - 1] * 3
    a, b = np.array(x, np.uint64), np.array(y, np.uint64)
    p = prefix_trie.PRIME
    assert prefix_trie.times(a, b).tolist() == [i * j % p for i, j in zip(x, y)]
    assert prefix_trie.minus(a, b).tolist() == [(i - j) % p for i, j in zip(x, y)]
    assert prefix_trie.running(a).tolist() == [sum(x[: i + 1]) % p for i in range(len(x))]
    assert prefix_trie.powers(12345, 77).tolist() == [pow(12345, i, p) for i in range(77)]


def test_long_lists_of_ids_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 200)
    ids = spark.range(5000).selectExpr("1L AS a", "id % 2 AS b", "id AS conv").repartition(7)
    out = {r.b: r.ends_sha256 for r in prefix_trie.joined_ids(ids).collect()}
    assert out == {k: hashlib.sha256(",".join(map(str, range(k, 5000, 2))).encode()).hexdigest() for k in (0, 1)}
