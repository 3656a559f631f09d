"""Operator 11: the trie of conversation prefixes, rolled up by pointer jumping.

A node is a distinct sequence of first turns, known by a digest: a polynomial
in the turns' 128-bit digests, modulo 2**61 - 1, with two bases (122 bits).
Such digests append: a piece of a conversation has a length and a digest of
its own, and what stands before it only shifts and adds. So the turns are
sorted into ranges over all tasks, whatever conversation they belong to; each
range digests what it has, and one row a range (the piece at its end)
tells the next ones what came before. No task holds a whole conversation.

Every turn gives a parent edge between two digests; equal ones are combined.
Then each node has a pointer to its parent, and in every round it adds its sums
to the node that it points to and takes that node's pointer. After k rounds a
node has the sums of the 2**k levels from itself down, so the rounds are as
many as the depth has binary digits. Pointers to the root need no lookup: the root
has none.

The ids of the conversations that end at a node are joined in ranges to
pieces of bounded size; one task then hashes a node's pieces one after the
other, as SHA-256 must, without holding them.

Defined cases: rows without a conv_id take no part. A null turn comes
first; rows of a conversation with equal turns are ordered by role, then by
the MD5 digest of role and text; repeated rows are turns of their own. Null roles
and texts are empty. A very long text is digested where it is read and goes no
further. An empty table gives an empty result (no root). Extra columns, whatever
their names, are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import EDGES_A_TASK, buckets_for, crc_of, written

#: Rows of a table that a Python step works on at once.
ROWS_AT_ONCE = 1 << 16
#: Turns of a conversation that are joined to its row under one key.
TURNS_A_BLOCK = 4096
#: Bytes of joined ids in one piece.
PIECE_BYTES = 1 << 16
#: Turns of a conversation that others may begin with, and ids that share them.
HEAD, FAMILY = 3, 20

PRIME = (1 << 61) - 1
#: A base for each half of a turn's digest.
BASES = (0x0F3A5C96B1D2E487, 0x1B0E6D3C95F7A241)
_P, _31, _30 = np.uint64(PRIME), np.uint64(31), np.uint64(30)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x >> np.uint64(61)) + (x & _P)
    return np.where(x >= _P, x - _P, x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products modulo the prime, of numbers below it, in halves of 31 bits."""
    xh, xl, yh, yl = x >> _31, x & _LOW31, y >> _31, y & _LOW31
    middle = xl * yh + xh * yl
    return reduced(((xh * yh) << np.uint64(1)) + (middle >> _30) + ((middle & _LOW30) << _31) + xl * yl)


def plus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return reduced(x + y)


def minus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return reduced(x + (_P - y))


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = times(out[:more], np.uint64(pow(base, done, PRIME)))
        done += more
    return out


def running(terms: np.ndarray) -> np.ndarray:
    """Running sums modulo the prime (halves of 32 bits can't overflow here)."""
    low = np.cumsum(terms & np.uint64(0xFFFFFFFF))
    high = np.cumsum(terms >> np.uint64(32))
    return plus(times(reduced(high), np.uint64(1 << 32)), reduced(low))


def gathered(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Small batches joined."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _longs(b: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(b.column(name)).astype(np.uint64)


# -- positions and digests ------------------------------------------------------


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """(conv, words, digest) in ranges of the order (conversation, turn)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
        # parts even a row that is repeated without end
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc(), F.col("tie").asc()]
    return rows.repartitionByRange(buckets_for(rows), *order).sortWithinPartitions(*order).select("conv", "words", "digest")


_PIECES = "conv long, part int, place long, before_a long, before_b long, a long, b long, words long, closes boolean, opens long"


def digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn's place in its range's piece of the conversation, and the
    digests of the piece before and after it. The range's last row is marked,
    and tells which conversation the range begins with."""
    part = TaskContext.get().partitionId()
    conv, count, sums, opens, held = None, 0, [0, 0], None, None
    for b in gathered(batches):
        own = np.asarray(b.column("conv"))
        n = len(own)
        opens = int(own[0]) if opens is None else opens
        first = np.ones(n, bool)
        first[1:] = own[1:] != own[:-1]
        begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        place = np.arange(n) - begin
        goes_on = conv is not None and int(own[0]) == conv
        piece = begin == 0 if goes_on else np.zeros(n, bool)
        halves = np.frombuffer(b"".join(b.column("digest").to_pylist()), "<u8").reshape(-1, 2)
        out = []
        for lane, base in enumerate(BASES):
            all_ = running(times(reduced(halves[:, lane]), powers(base, int(place.max()) + 1)[place]))
            start = np.concatenate([np.zeros(1, np.uint64), all_])[begin]
            after = minus(all_, start)
            before = np.concatenate([np.zeros(1, np.uint64), after[:-1]])
            before[first] = 0
            if goes_on:
                shift, held_sum = np.uint64(pow(base, count, PRIME)), np.uint64(sums[lane])
                after[piece] = plus(times(after[piece], shift), held_sum)
                before[piece] = plus(times(before[piece], shift), held_sum)
            sums[lane] = int(after[-1])
            out.append((before.astype(np.int64), after.astype(np.int64)))
        place = place + 1 + np.where(piece, count, 0)
        conv, count = int(own[-1]), int(place[-1])
        if held is not None:
            yield held
        closes = np.zeros(n, bool)
        held = pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array(np.full(n, part, np.int32)), pa.array(place), *(pa.array(x[k]) for k in (0, 1) for x in out), b.column("words"), pa.array(closes), pa.array(np.full(n, opens, np.int64))],
            ["conv", "part", "place", "before_a", "before_b", "a", "b", "words", "closes", "opens"],
        )
    if held is not None:
        closes = np.zeros(held.num_rows, bool)
        closes[-1] = True
        yield held.set_column(8, "closes", pa.array(closes))


def carried(ends: list) -> dict[int, tuple[int, int, list[int]]]:
    """Range -> (the conversation that it begins within, turns before, their
    digests), from the last row of each range in order."""
    out, conv, count, sums = {}, None, 0, [0, 0]
    for r in sorted(ends, key=lambda r: r.part):
        if r.opens == conv:
            out[r.part] = (conv, count, list(sums))
        own, now = r.place, [r.a, r.b]
        if r.opens == conv == r.conv:  # the whole range is of that conversation
            now = [(s + pow(base, count, PRIME) * x) % PRIME for s, base, x in zip(sums, BASES, now)]
            own += count
        conv, count, sums = r.conv, own, now
    return out


def placed(pieces: DataFrame) -> DataFrame:
    """(conv, place, before_a, before_b, a, b, words): places and digests in
    whole conversations."""
    before = carried(pieces.where("closes").select("part", "opens", "conv", "place", "a", "b").collect())  # one row a range

    def run(batches):
        for b in gathered(batches):
            conv, part, place = np.asarray(b.column("conv")), np.asarray(b.column("part")), np.asarray(b.column("place")).copy()
            sums = {name: _longs(b, name) for name in ("before_a", "before_b", "a", "b")}
            for k in np.unique(part).tolist():
                if k not in before:
                    continue
                own, count, start = before[k]
                rows = (part == k) & (conv == own)
                place[rows] += count
                for lane, names in enumerate((("before_a", "a"), ("before_b", "b"))):
                    shift = np.uint64(pow(BASES[lane], count, PRIME))
                    for name in names:
                        sums[name][rows] = plus(times(sums[name][rows], shift), np.uint64(start[lane]))
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(place), *(pa.array(x.astype(np.int64)) for x in sums.values()), b.column("words")], ["conv", "place", *sums, "words"])

    return pieces.select("conv", "part", "place", "before_a", "before_b", "a", "b", "words").mapInArrow(run, "conv long, place long, before_a long, before_b long, a long, b long, words long")


# -- conversations and their nodes ----------------------------------------------


def _chosen(which: Column, heads: list[Column]) -> Column:
    """The head that ``which`` counts to; null for none."""
    out = F.lit(None)
    for i, head in enumerate(heads, 1):
        out = F.when(which == i, head).otherwise(out)
    return out


def described(turns: DataFrame, borrows: bool) -> DataFrame:
    """A row a conversation: its turns, how many it leaves out and takes from
    its family's first conversation, and the digests of those."""
    heads = [F.max(F.when(F.col("place") == i, F.struct("a", "b", "words"))).alias(f"head{i}") for i in range(1, HEAD + 1)]
    own = turns.groupBy("conv").agg(F.max("place").alias("n"), *heads)
    own = own.withColumn("first", F.col("conv") - F.col("conv") % FAMILY)
    drops = F.when(F.col("conv") == F.col("first"), 0).otherwise((crc_of(F.col("conv")) % (HEAD + 1)).cast("long")) if borrows else F.lit(0)
    own = own.withColumn("drops", drops.cast("long"))
    base = own.where("conv = first").select(F.col("conv").alias("first"), F.col("n").alias("base_n"), *(F.col(f"head{i}").alias(f"base{i}") for i in range(1, HEAD + 1)))
    both = own.join(base, "first", "left")
    both = both.withColumn("takes", F.least("drops", F.coalesce("base_n", F.lit(0))))
    head = _chosen(F.col("takes"), [F.col(f"base{i}") for i in range(1, HEAD + 1)])
    left_out = _chosen(F.col("drops"), [F.col(f"head{i}") for i in range(1, HEAD + 1)])
    zero = F.lit(0).cast("long")
    return both.select(
        "conv", "n", "drops", "takes", *(f"base{i}" for i in range(1, HEAD + 1)),
        F.coalesce(head["a"], zero).alias("head_a"), F.coalesce(head["b"], zero).alias("head_b"),
        F.coalesce(left_out["a"], zero).alias("left_a"), F.coalesce(left_out["b"], zero).alias("left_b"),
    )


_MEMBERS = "conv long, depth long, a long, b long, parent_a long, parent_b long, words long, ends boolean"


def own_members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that a conversation's own turns lead to: what it takes from
    its family's first one, then the turns after those that it leaves out."""
    for b in gathered(batches):
        drops, takes = np.asarray(b.column("drops")), np.asarray(b.column("takes"))
        place = np.asarray(b.column("place"))
        columns = {}
        for lane, x in enumerate("ab"):
            # base ** (takes - drops), of at most HEAD each
            shift = np.array([[pow(BASES[lane], t - d, PRIME) for t in range(HEAD + 1)] for d in range(HEAD + 1)], np.uint64)[drops, takes]
            left, head = _longs(b, f"left_{x}"), _longs(b, f"head_{x}")
            for to, of in ((x, x), (f"parent_{x}", f"before_{x}")):
                columns[to] = plus(times(minus(_longs(b, of), left), shift), head).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("conv"), pa.array(place - drops + takes), *(pa.array(columns[k]) for k in ("a", "b", "parent_a", "parent_b")), b.column("words"), pa.array(place == np.asarray(b.column("n")))],
            ["conv", "depth", "a", "b", "parent_a", "parent_b", "words", "ends"],
        )


def members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conversation, node) for each node that a conversation starts with. The
    root's digests are 0."""
    block = F.floor((F.col("place") - 1) / TURNS_A_BLOCK)
    rows = convs.where("n > drops").select("conv", "n", "drops", "takes", "head_a", "head_b", "left_a", "left_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / TURNS_A_BLOCK))).alias("block"))
    own = turns.withColumn("block", block).join(rows, ["conv", "block"]).where("place > drops").drop("block").mapInArrow(own_members, _MEMBERS)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    heads, before = [F.struct(zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("parent_a"), none.alias("parent_b"), zero.alias("words"))], (zero, zero)
    for i in range(1, HEAD + 1):
        x = F.col(f"base{i}")
        heads.append(F.when(F.col("takes") >= i, F.struct(F.lit(i).cast("long").alias("depth"), x["a"].alias("a"), x["b"].alias("b"), before[0].alias("parent_a"), before[1].alias("parent_b"), x["words"].alias("words"))))
        before = (x["a"], x["b"])
    taken = convs.select("conv", "n", "drops", "takes", F.explode(F.array(*heads)).alias("node")).where("node is not null")
    taken = taken.select("conv", "node.*", ((F.col("n") <= F.col("drops")) & (F.col("node.depth") == F.col("takes"))).alias("ends"))
    return own.unionByName(taken)


# -- rolling up -----------------------------------------------------------------


def rolled_up(nodes: DataFrame, values: list[str], depth: int, tasks: int) -> DataFrame:
    """(a, b, *values): the sums of ``values`` over each node and all below it.

    ``nodes`` has (a, b, parent_a, parent_b, *values); the root's digests are
    0 and it has no parent. ``depth`` is the greatest distance from the root.
    """
    state = nodes.select("a", "b", "parent_a", "parent_b", *values)
    none = F.lit(None).cast("long")
    at_end = F.col("parent_a").isNull() | ((F.col("parent_a") == 0) & (F.col("parent_b") == 0))
    for _ in range(depth.bit_length()):
        # those that point to no node or to the root have nothing to look up
        near = state.where(at_end).withColumns({"next_a": none, "next_b": none})
        far = state.where(~at_end).join(
            state.select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("parent_a").alias("next_a"), F.col("parent_b").alias("next_b")), ["parent_a", "parent_b"]
        )
        both = near.unionByName(far)
        keeps = F.struct("a", "b", F.col("next_a").alias("parent_a"), F.col("next_b").alias("parent_b"), *values)
        gives = F.when(F.col("parent_a").isNotNull(), F.struct(F.col("parent_a").alias("a"), F.col("parent_b").alias("b"), none.alias("parent_a"), none.alias("parent_b"), *values))
        moved = both.select(F.explode(F.array(keeps, gives)).alias("x")).where("x is not null").select("x.*")
        # of a node's rows only its own has a pointer
        state = moved.groupBy("a", "b").agg(F.max("parent_a").alias("parent_a"), F.max("parent_b").alias("parent_b"), *(F.sum(v).alias(v) for v in values))
        state = written(state.coalesce(tasks), "jump")
    return state.select("a", "b", *values)


def joined_ids(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) from (a, b, conv)."""

    def pieces(batches):
        for b in gathered(batches):
            a, c, conv = (np.asarray(b.column(x)) for x in ("a", "b", "conv"))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            cuts = [*np.flatnonzero(new).tolist(), len(a)]
            cuts = [k for x, y in zip(cuts, cuts[1:]) for k in range(x, y, PIECE_BYTES // 20)] + [len(a)]
            rows = [(int(a[x]), int(c[x]), int(conv[x]), ",".join(map(str, conv[x:y].tolist()))) for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "first", "ids"), r)) for r in rows])

    def hashed(batches):
        now, digest = None, None
        for b in batches:
            out = []
            for key, ids in zip(zip(b.column("a").to_pylist(), b.column("b").to_pylist()), b.column("ids").to_pylist()):
                if key == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "ends_sha256"), r)) for r in out])
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"a": now[0], "b": now[1], "ends_sha256": digest.hexdigest()}])

    n = buckets_for(ends)
    cut = ends.repartitionByRange(n, "a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(pieces, "a long, b long, first long, ids string")
    return cut.repartition(n, "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashed, "a long, b long, ends_sha256 string")


_NO_ENDS = hashlib.sha256(b"").hexdigest()


def prefix_trie(conversations: DataFrame, borrows: bool = False) -> DataFrame:
    """A row a node of the trie of ``conversations`` (conv_id, turn, role, text).

    With ``borrows`` a conversation leaves out its first turns, as many as its
    id's crc says, and begins with as many of its family's first conversation.
    Besides the numbers of the contract, node_a and node_b are the node's digests.
    """
    spark = conversations.sparkSession
    turns = placed(written(sorted_turns(conversations).mapInArrow(digested, _PIECES), "turns"))
    convs = written(described(turns, borrows), "convs")
    every = written(members(turns, convs), "members")
    nodes = written(
        every.groupBy("a", "b").agg(
            F.min("conv").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
            F.max("parent_a").alias("parent_a"), F.max("parent_b").alias("parent_b"),
        ),
        "nodes",
    )
    children = nodes.where("depth > 0").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    trie = written(
        nodes.join(children, ["a", "b"], "left").select(
            "a", "b", "conv_id", "depth", "n_convs", "parent_a", "parent_b",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        ),
        "trie",
    )
    size = trie.agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"), F.min("conv_id").alias("root")).first()
    sums = rolled_up(trie, ["n_leaves", "saved_tokens"], size.depth or 0, 4 + size.n // EDGES_A_TASK)
    ends = joined_ids(every.where("ends").select("a", "b", "conv"))
    own = trie.drop("n_leaves", "saved_tokens").join(sums, ["a", "b"]).join(ends, ["a", "b"], "left")
    ids = trie.select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("up"))
    under_root = (F.col("parent_a") == 0) & (F.col("parent_b") == 0)
    far = own.where(~under_root).join(ids, ["parent_a", "parent_b"])
    near = own.where(F.coalesce(under_root, F.lit(True))).withColumn("up", F.when(F.col("depth") > 0, F.lit(size.root).cast("long")))
    return near.unionByName(far).select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"), F.col("a").alias("node_a"), F.col("b").alias("node_b"),
    )


#: crc32 of the decimal id: its bytes, then eight halvings each.
_HALVINGS = "list_reduce(list_prepend(xor(s, z), list_transform(range(8), lambda k: k::UBIGINT)), lambda q, k: xor(q >> 1, CASE WHEN q & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(s.c::VARCHAR, ''), lambda z: unicode(z)::UBIGINT)), lambda s, z: {_HALVINGS}), 4294967295::UBIGINT)"

#: A node is the joined digests of its turns; the paths of all nodes are cut
#: at each depth to give their ancestors.
ORACLE = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(text, '') AS x, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS y,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
plans AS (SELECT s.c, s.c - s.c % 20 AS f, {_CRC} % 4 AS h FROM sizes s),
convs AS (SELECT p.c, p.f, p.h, least(p.h, coalesce(b.n, 0)) AS m FROM plans p LEFT JOIN sizes b ON b.c = p.f),
rebuilt AS (
  SELECT v.c, t.i AS d, t.x, t.y FROM convs v JOIN turns t ON t.c = v.f AND t.i <= v.h
  UNION ALL SELECT v.c, t.i - v.h + v.m, t.x, t.y FROM convs v JOIN turns t ON t.c = v.c AND t.i > v.h),
paths AS (
  SELECT c, CAST(d AS BIGINT) AS d, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w, string_agg(y, '') OVER (PARTITION BY c ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w FROM paths GROUP BY path, d),
kids AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
trie AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
sums AS (
  SELECT left(path, 32 * e) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS e FROM trie) GROUP BY 1),
lasts AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d DESC) AS r FROM paths) WHERE r = 1 GROUP BY path)
SELECT t.conv_id, t.d AS depth, u.conv_id AS parent_conv_id, t.n_convs, t.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(l.ids, '')) AS ends_sha256
FROM trie t JOIN sums s USING (path) LEFT JOIN lasts l USING (path) LEFT JOIN nodes u ON t.d > 0 AND u.path = left(t.path, 32 * (t.d - 1))"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, rebuilt as the contract says."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), borrows=True).drop("node_a", "node_b")
