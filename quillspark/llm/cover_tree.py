"""Operator 1: exact top-k search by a dual-tree walk over cover trees.

Queries and data are indexed together. A top level of at most ``CELLS`` centres
(farthest-first picks of a bounded sample) deals all vectors into *cells* with
covering radii, queries too. A cell's vectors are dealt into data blocks and its
queries into query groups, both of bounded size, and each block and each group
has a cover tree.

The cover trees are simplified ones (levels, nesting, covering, separation): a
node of level i covers its points within BASE**i of its centre; its children
are centres among its points, the node's own one included, more than
BASE**(i - 1) apart, and each point goes to its nearest. Levels that split
nothing are left out. A node that a net of few children can't cover stays a
leaf.

The walk goes over pairs of a query node and a data node. For centres p, q with
covering radii r, s no inner product of the pair exceeds
p.q + s|p| + r|q| + rs; if that is below the worst k-th score of all queries
in the query node, the pair is pruned. At the leaves all products are exact
integers.

Each group first meets the blocks of its own cell. Its queries' k-th scores then
bound the cells that can still matter; only these pairs of group and block
travel, at most ``LANE`` groups to a task. A group-by keeps the best k.

Components are floored at 1/256: floor(256 x). Equal vectors of a block stand
once in its tree, with the ids that ties can ask for.

Defined cases: vectors that are null, empty, or have null or non-finite
components take no part, nor do null ids. Very large components are multiplied
as integers of any size; a score that doesn't fit 64 bits is the nearest that
does, and a component over 2**1015 counts as that. Scores are taken between
vectors of one length only; other candidates don't count. An own row is any row
with the query's id. A repeated query row counts once; a repeated candidate row
with another id than the query's counts as often as it stands there, up to
k times. Fewer candidates than k give fewer rows. Ties go to the smaller
vec_id. Extra columns are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

K = 5
#: Vectors in a data block and in a query group; query groups in a task.
DATA_BLOCK, QUERY_BLOCK, LANE = 16_384, 2_048, 64
#: Cells of the top level, and the rows that its centres are picked from.
CELLS, SAMPLE = 1_024, 4_096
#: Points that a node of data, and of queries, may have as a leaf; ratio of a
#: level's radius to the next.
LEAF, QUERY_LEAF, BASE = 64, 8, 1.3
#: Data rows whose products with a query node are held at once.
STRIP = 512
LOW = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max


class Node:
    __slots__ = ("rows", "centre", "radius", "norm", "children")

    def __init__(self, rows: np.ndarray, centre: np.ndarray, radius: float):
        self.rows, self.centre, self.radius = rows, centre, radius
        self.norm = float(np.linalg.norm(centre))
        self.children: list[Node] = []


def net(points: np.ndarray, first: int, dist: np.ndarray, goal: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres picked farthest first, from ``first`` on, until all points are
    within ``goal`` or there are ``most``; each point's centre and distance."""
    centres, owner, dist = [first], np.zeros(len(points), np.int64), dist.copy()
    square = (points**2).sum(1)
    while len(centres) < most:
        far = int(dist.argmax())
        if dist[far] <= goal:
            break
        d = np.sqrt(np.maximum(square - 2 * (points @ points[far]) + square[far], 0.0))
        d[far] = 0.0
        closer = d < dist
        owner[closer], dist[closer] = len(centres), d[closer]
        centres.append(far)
    return centres, owner, dist


def tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """A simplified cover tree of the rows of x (floats, distinct)."""
    rows = np.arange(len(x))
    dist = np.sqrt(((x - x[0]) ** 2).sum(1))
    root = Node(rows, x[0], float(dist.max()))
    todo = [(root, 0, dist)]  # a node, its centre's place in its rows, distances to it
    while todo:
        at, place, dist = todo.pop()
        if len(at.rows) <= leaf or at.radius == 0:
            continue
        points, most = x[at.rows], 2 * len(at.rows) // leaf + 2
        level = np.floor(np.log(at.radius) / np.log(BASE))  # the highest one that splits the node
        centres, owner, near = net(points, place, dist, BASE**level, most)
        if near.max() > BASE**level:
            continue
        if len(centres) < 2:
            centres, owner, near = net(points, place, dist, BASE ** (level - 1), most)
            if near.max() > BASE ** (level - 1):
                continue
        for i, c in enumerate(centres):
            own = np.flatnonzero(owner == i)
            child = Node(at.rows[own], points[c], float(near[own].max()))
            at.children.append(child)
            todo.append((child, int(np.searchsorted(own, c)), near[own]))
    return root


class Best:
    """The k best (score, id) of each query so far. ``floor`` is a score that
    each query is known to reach k times elsewhere."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.compared = k, 0
        self.score = np.full((n, k), LOW)
        self.ids = np.full((n, k), NO_ID)
        self.floor = np.full(n, LOW) if floor is None else floor

    def kth(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def worst(self, rows: np.ndarray) -> float:
        """The least k-th score of these queries; minus infinity while one has fewer."""
        least = int(self.kth(rows).min())
        return -np.inf if least == LOW else float(least)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        self.compared += scores.size
        s = np.where(ids[None, :] == own[:, None], LOW, scores)
        least = self.kth(rows)
        if s.shape[1] > self.k:
            least = np.maximum(least, np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k])
        r, c = np.nonzero((s >= least[:, None]) & (s > LOW))
        if not len(r):
            return
        have = np.repeat(np.arange(len(rows)), self.k)
        row = np.concatenate([have, r])
        score = np.concatenate([self.score[rows].ravel(), s[r, c]])
        names = np.concatenate([self.ids[rows].ravel(), ids[c]])
        order = np.lexsort((names, ~score, row))  # ~score falls as score grows
        row, score, names = row[order], score[order], names[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.score[rows] = score[keep].reshape(-1, self.k)
        self.ids[rows] = names[keep].reshape(-1, self.k)


def small_enough(x: np.ndarray) -> np.ndarray:
    """Rows whose products with one another fit 64 bits."""
    limit = 2.0 ** ((62 - int(np.ceil(np.log2(max(x.shape[1], 2))))) // 2)
    return (np.abs(x) < limit).all(1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of whole numbers (as floats): by floats
    where these are exact, by 64 bits where those are, else by Python's integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**52:
        return np.rint(q @ x.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda a: np.array([[int(v) for v in row] for row in a], dtype=object)
    exact = whole(q) @ whole(x).T
    return np.array([[max(-NO_ID, min(NO_ID, v)) for v in row] for row in exact], np.int64).reshape(len(q), len(x))


def distinct_rows(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct rows, and of each the ids that a tie can ask for: whatever id a
    query has, the k least others are among them, repeats counted."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    x, which = np.unique(x, axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    which, ids = which.ravel()[order], ids[order]
    place = np.arange(len(ids))
    new = np.ones(len(ids), bool)
    new[1:] = (which[1:] != which[:-1]) | (ids[1:] != ids[:-1])
    first = np.maximum.accumulate(np.where(new, place, 0))
    few = place - first < k  # an id more than k times says nothing more
    which, ids = which[few], ids[few]
    begin = np.searchsorted(which, np.arange(len(x)))
    keep = np.arange(len(ids)) - begin[which] < 2 * k
    which, ids = which[keep], ids[keep]
    return x, np.split(ids, np.searchsorted(which, np.arange(1, len(x))))


class Block:
    """A data block: its distinct rows, ids and cover tree."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int):
        self.x, self.ids = distinct_rows(x, ids, k)
        self.k = k
        self.count = np.fromiter(map(len, self.ids), np.int64, len(self.ids))
        small = small_enough(self.x)
        self.loose = np.flatnonzero(~small)  # met by all queries
        self.at = np.flatnonzero(small)
        self.root = tree(self.x[self.at]) if len(self.at) else None

    def meet(self, best: Best, q: np.ndarray, q_ids: np.ndarray, some: np.ndarray, rows: np.ndarray) -> None:
        """Compute all products of some queries with some rows."""
        for a in range(0, len(rows), STRIP):
            part = rows[a : a + STRIP]
            ids = np.concatenate([self.ids[i] for i in part.tolist()])
            best.add(some, np.repeat(products(q[some], self.x[part]), self.count[part], axis=1), ids, q_ids[some])


def bound(a: Node, b: Node) -> float:
    top = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
    return top + 1e-6 * (1 + abs(top) + (a.norm + a.radius) * (b.norm + b.radius))


def dual_search(q: np.ndarray, q_ids: np.ndarray, block: Block, k: int, floor: np.ndarray | None = None) -> Best:
    """The k best of a block for each q (rows of whole numbers)."""
    best = Best(len(q), k, floor)
    every = np.arange(len(q))
    small = small_enough(q)
    large = np.flatnonzero(~small)
    if len(large):
        block.meet(best, q, q_ids, large, np.arange(len(block.x)))
    some = every[small]
    if not len(some):
        return best
    if len(block.loose):
        block.meet(best, q, q_ids, some, block.loose)
    if block.root is None:
        return best
    # equal vectors of different ids are one point of the query tree
    points, which = np.unique(q[some], axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    of_point = np.split(some[order], np.searchsorted(which.ravel()[order], np.arange(1, len(points))))
    members = lambda node: np.concatenate([of_point[i] for i in node.rows.tolist()])
    queries = tree(points, QUERY_LEAF)
    known: dict[int, np.ndarray] = {}
    stack = [(bound(queries, block.root), queries, block.root)]
    while stack:
        top, a, b = stack.pop()
        own = known.get(id(a))
        if own is None:
            own = known[id(a)] = members(a)
        if top < best.worst(own):
            continue
        if not a.children and not b.children:
            block.meet(best, q, q_ids, own, block.at[b.rows])
            continue
        if a.children and (not b.children or a.radius >= b.radius):
            pairs = [(bound(c, b), c, b) for c in a.children]
        else:
            pairs = [(bound(a, c), a, c) for c in b.children]
        pairs.sort(key=lambda p: p[0])  # the most promising pair is taken first
        stack.extend(pairs)
    return best


def floored(x: Column) -> Column:
    """floor(256 x) as a double; from 2**44 on 256 x is whole."""
    x = x.cast("double")
    large = F.greatest(F.least(x, F.lit(2.0**1015)), F.lit(-(2.0**1015)))
    return F.when(F.abs(x) < F.lit(2.0**44), F.floor(F.lit(256.0) * x).cast("double")).otherwise(F.lit(256.0) * large)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): rows that take part, as whole numbers."""
    c = F.col(vector)
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != F.lit(float("inf")))
    return vectors.where(F.col(key).isNotNull() & c.isNotNull() & (F.size(c) > 0) & F.forall(c, finite)).select(F.col(key).cast("long").alias("vec_id"), F.transform(c, floored).alias("v"))


class Cells:
    """The top level: centres by vector length. A length that the sample hasn't
    has the cell -1."""

    def __init__(self, sample: list[list[float]], n: int):
        by_size: dict[int, list[list[float]]] = {}
        for v in sample:
            by_size.setdefault(len(v), []).append(v)
        self.centres: dict[int, tuple[int, np.ndarray]] = {}
        first = 0
        for size, rows in sorted(by_size.items()):
            x = np.unique(np.array(rows, dtype=np.float64), axis=0)
            x = x[small_enough(x)]
            if not len(x):
                continue
            share = max(1, n * len(rows) // max(1, len(sample)))
            with np.errstate(all="ignore"):
                picked, _, _ = net(x, 0, np.sqrt(((x - x[0]) ** 2).sum(1)), 0.0, min(share, len(x)))
            self.centres[size] = (first, x[picked])
            first += len(picked)

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell and distance to its centre (infinite where it isn't a number)."""
        if v.shape[1] not in self.centres:
            return np.full(len(v), -1), np.zeros(len(v))
        first, c = self.centres[v.shape[1]]
        with np.errstate(all="ignore"):
            square = (v**2).sum(1)[:, None] - 2 * (v @ c.T) + (c**2).sum(1)
            square = np.where(np.isnan(square), np.inf, square)
            near = square.argmin(1)
            dist = np.sqrt(((v - c[near]) ** 2).sum(1))
        return first + near, np.where(np.isnan(dist), np.inf, dist)


def _by_size(column: pa.Array):
    """(rows, matrix) for each length of a column of vectors."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[(starts[rows, None] + np.arange(size)).ravel()].reshape(-1, size)


def _dealt(rows: DataFrame, cells: Cells) -> DataFrame:
    """``rows`` (vec_id, v) with cell and distance."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)  # CELLS centres of SAMPLE rows

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cell, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for at, x in _by_size(b.column("v")):
                cell[at], dist[at] = shared.value.of(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell), pa.array(dist)], ["vec_id", "v", "cell", "dist"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, cell int, dist double")


def _lookup(column: Column, values: dict[int, int]) -> Column:
    """values[column], 1 where there is none; one entry a cell at most."""
    pairs = [F.lit(x) for kv in sorted(values.items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(1)) if pairs else F.lit(1)


_FOUND = "query_id long, vec_id long, score long"


def _packed(queries: DataFrame) -> DataFrame:
    """Query groups: one row of blobs per (cell, part, length of vectors)."""

    def pack(t: pa.Table) -> pa.Table:
        v = np.asarray(t["v"].combine_chunks().flatten(), dtype=np.float64)
        blob = lambda x: pa.array([x.tobytes()], pa.binary())
        worst = np.asarray(t["worst"].combine_chunks().fill_null(int(LOW)), dtype=np.int64)
        return pa.table({"cell": t["cell"].slice(0, 1), "part": t["part"].slice(0, 1), "size": t["size"].slice(0, 1), "ids": blob(np.asarray(t["vec_id"], dtype=np.int64)), "rows": blob(v), "worst": blob(worst)})

    return queries.groupBy("cell", "part", "size").applyInArrow(pack, "cell int, part int, size int, ids binary, rows binary, worst binary")


def _searched(data: DataFrame, asked: DataFrame, blocks: dict[int, int], k: int) -> DataFrame:
    """Found rows of the groups in ``asked`` (to, ids, rows, worst, size), each
    met with all blocks of the cell ``to``."""
    n_asked = {r["to"]: r["n"] for r in asked.groupBy("to").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    lanes = {c: -(-n // LANE) for c, n in n_asked.items()}
    block = F.pmod(F.xxhash64("vec_id", "v"), _lookup(F.col("cell"), blocks)).cast("int")
    left = data.where(F.col("cell").isin(list(n_asked))).withColumn("block", block)
    left = left.withColumn("lane", F.explode(F.sequence(F.lit(0), _lookup(F.col("cell"), lanes) - 1)))
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), _lookup(F.col("to"), blocks) - 1)))
    right = right.withColumn("lane", F.pmod(F.xxhash64("ids"), _lookup(F.col("to"), lanes)).cast("int"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        groups = list(zip(*(right[c].to_pylist() for c in ("size", "ids", "rows", "worst"))))
        if groups and left.num_rows:
            all_ids = np.asarray(left["vec_id"], dtype=np.int64)
            for at, x in _by_size(left["v"].combine_chunks()):
                mine = [g for g in groups if g[0] == x.shape[1]]
                if not mine:
                    continue
                own = Block(x, all_ids[at], k)
                for size, ids, rows, worst in mine:
                    ids = np.frombuffer(ids, np.int64)
                    best = dual_search(np.frombuffer(rows, np.float64).reshape(-1, size), ids, own, k, np.frombuffer(worst, np.int64))
                    some = best.ids != NO_ID
                    out[0].append(np.repeat(ids, some.sum(1)))
                    out[1].append(best.ids[some])
                    out[2].append(best.score[some])
        a, b, c = (np.concatenate(y) if y else np.zeros(0, np.int64) for y in out)
        return pa.table({"query_id": pa.array(a), "vec_id": pa.array(b), "score": pa.array(c)})

    on = ["cell", "block", "lane"]
    left = left.select(*on, "vec_id", "v")
    right = right.select(F.col("to").alias("cell"), "block", "lane", "size", "ids", "rows", "worst")
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(search, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    n = rows.count()
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").collect()]
    cells = Cells(sample, min(CELLS, max(n // DATA_BLOCK, min(spark.sparkContext.defaultParallelism, n // 2_000), 1)))
    data = _dealt(rows, cells)
    stats = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"), F.count_if(is_query).alias("asked")).collect()  # a row a cell
    blocks = {r["cell"]: -(-r["n"] // DATA_BLOCK) for r in stats}
    parts = {r["cell"]: max(1, -(-r["asked"] // QUERY_BLOCK)) for r in stats}
    radius = {r["cell"]: r["radius"] for r in stats}
    queries = _dealt(rows.where(is_query).distinct(), cells).withColumn("size", F.size("v"))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), _lookup(F.col("cell"), parts)).cast("int"))
    first = _packed(queries.withColumn("worst", F.lit(None).cast("long"))).withColumn("to", F.col("cell"))
    near = written(_best(_searched(data, first, blocks, k), k), "near")
    kth = near.groupBy("query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "worst")
    groups = _packed(queries.join(kth, "vec_id", "left"))

    def reach(batches):
        """The other cells that can hold one of a group's k best."""
        for b in batches:
            out: tuple[list, list] = ([], [])
            for i, (cell, size, q, worst) in enumerate(zip(*(b.column(c).to_pylist() for c in ("cell", "size", "rows", "worst")))):
                if size not in cells.centres:
                    continue
                start, c = cells.centres[size]
                q, worst = np.frombuffer(q, np.float64).reshape(-1, size), np.frombuffer(worst, np.int64)
                r = np.array([radius.get(start + j, -1.0) for j in range(len(c))])
                with np.errstate(all="ignore"):
                    norm = np.linalg.norm(q, axis=1)
                    top = q @ c.T + norm[:, None] * np.maximum(r, 0.0)
                    top = top + 1e-6 * (1 + np.abs(top) + norm[:, None] * (np.linalg.norm(c, axis=1) + r))
                    out_of_reach = (top < worst[:, None]) & (worst[:, None] > LOW)  # what isn't a number is in reach
                for j in np.flatnonzero(~out_of_reach.all(0) & (r >= 0)).tolist():
                    if start + j != cell:
                        out[0].append(i)
                        out[1].append(start + j)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[1], pa.int32()), *(b.column(c).take(at) for c in ("size", "ids", "rows", "worst"))], ["to", "size", "ids", "rows", "worst"])

    asked = written(groups.select("cell", "size", "ids", "rows", "worst").mapInArrow(reach, "to int, size int, ids binary, rows binary, worst binary"), "asked")
    far = _searched(data, asked, blocks, k)
    return _best(near.select("query_id", "vec_id", "score").union(far), k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for each whose id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id AND len(q.v) = len(d.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
