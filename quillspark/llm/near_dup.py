"""Operator 3: near-duplicates by one-permutation hashing.

Each document's set of word shingles (64-bit hashes) is hashed once; the
range of the hash is cut into ``bins`` bins that keep their least value, and
an empty bin borrows from a non-empty one by optimal densification (a hash
of the empty bin's number and an attempt count picks the donor). Bands of
``rows`` bins give bucket keys.

Documents with equal sets (by 128-bit digests) are one *class* and take part as
its smallest doc_id. Candidate edges are star-shaped at first: in each bucket every class
is joined with one hub, so a bucket of m members gives m - 1 edges. The hub is
the member that meets most classes in all its buckets, which is a cluster's
centre. Links are confirmed on full sets (sent as the upper
six bytes of each hash). Then an exact pass takes the buckets whose other
members belong to different components: every pair of them that isn't in one
component is tested, in the first bucket that it shares, except where the set
sizes rule a link out.

Only classes that share a bucket with another have their full sets made, once;
the texts come by a bitmap of fixed size and a join.

Recall: two sets of similarity s share no band with probability
(1 - s**rows)**bands, below 1e-7 at s = 0.8 for 4 x 32. Every pair that shares
a band is tested, or its sizes rule it out, or it is in one component already;
tests hold the components against brute force.

Defined cases: a document without words or text has an empty set and no
link; one with fewer words than a shingle has its whole word sequence as its
only shingle. A null doc_id has no link: its component is null and it
is kept. Rows that share a doc_id are judged each by its own text, and
exact repeats of a row are all kept (they carry the same id). A very long text is
a slice of its own, whole. Members of equal weight in a bucket rank by hash; which
of them is the hub doesn't change the components. Extra columns, whatever their
names, are dropped by ``near_duplicates`` and kept by ``keep_first``. An empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bitmap, WordHashes, bound_batches, buckets_for, components, from_six, mix, range_bucket, raw, signed, six_bytes, slices, split_by, written

BINS, ROWS = 128, 4
#: Bits of the filter that fetches texts: 8 MB at any size of input.
FETCH_BITS = 26
#: Bits of the filter for bucket keys that occur twice: 16 MB. Beyond some 50
#: million such keys it lets most through, which costs time but not results.
KEY_BITS = 27
#: A bucket's members are dealt into blocks of about so many, or of about so
#: many shingles; all pairs of blocks are compared.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 400_000
#: Up to so many classes, a round's are broadcast to pick their sets; beyond,
#: all sets take part in the join.
FEW_ENDS = 100_000


def shingles(words: np.ndarray, doc: np.ndarray, n_words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) pairs, distinct and sorted."""
    n = len(words)
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        out = np.zeros(max(n - width + 1, 0), np.uint64)
        for i in range(width):
            out = mix(out * base + words[i : i + len(out)])
        at = np.arange(len(out))
        good = doc[at] == doc[np.minimum(at + width - 1, max(n - 1, 0))] if n else np.zeros(0, bool)
        d, h = doc[: len(out)][good], out[good]
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        if len(short):
            starts = np.cumsum(n_words) - n_words
            own = [int(n_words[k]) for k in short]
            values = []
            for k, m in zip(short, own):
                x = np.array([m], np.uint64)
                for w in words[starts[k] : starts[k] + m]:
                    x = mix(x * base + w)
                values.append(x[0])
            d, h = np.concatenate([d, short]), np.concatenate([h, np.array(values, np.uint64)])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


def sets_of(texts: list[bytes], width: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, and the sorted sets one after the other with their documents."""
    words = [t.lower().split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    flat = hashes.of(list(chain.from_iterable(words)))
    d, h = shingles(flat, np.repeat(np.arange(len(words)), n_words), n_words, width)
    return np.bincount(d, minlength=len(words)), d, h


def digests(sizes: np.ndarray, h: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each set."""
    out, at = [], 0
    for n in sizes.tolist():
        out.append(xxhash.xxh3_128_digest(h[at : at + n].tobytes()))
        at += n
    return out


def signatures(n_docs: int, d: np.ndarray, h: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signatures; rows of empty sets are zero."""
    out = np.zeros((n_docs, bins), np.uint64)
    full = np.zeros((n_docs, bins), bool)
    b = range_bucket(h, bins)
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (b[1:] != b[:-1])
    out[d[new], b[new]] = h[new]
    full[d[new], b[new]] = True
    have = full.any(1)
    row, at = np.nonzero(~full & have[:, None])
    attempt = np.uint64(1)
    with np.errstate(over="ignore"):
        while len(row):
            donor = range_bucket(mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + attempt * np.uint64(0xD6E8FEB86659FD93)), bins)
            got = full[row, donor]
            # a borrowed value keeps its donor's hash; the band key mixes in the bin's place
            out[row[got], at[got]] = out[row[got], donor[got]]
            row, at = row[~got], at[~got]
            attempt += np.uint64(1)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    n, bins = signature.shape
    with np.errstate(over="ignore"):
        keys = np.zeros((n, bins // rows), np.uint64) + np.arange(bins // rows, dtype=np.uint64)
        for i in range(rows):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, i::rows][:, : bins // rows])
    return keys


def _profile(docs: DataFrame, key: str, text: str, width: int, bins: int, rows: int) -> DataFrame:
    def run(batches):
        hashes = WordHashes()
        for b in slices(batches, text):
            sizes, d, h = sets_of(raw(b.column(text)), width, hashes)
            bands = band_keys(signatures(b.num_rows, d, h, bins), rows).astype("<u8")
            yield pa.RecordBatch.from_arrays(
                [b.column(key), pa.array(sizes, pa.int64()), pa.array(digests(sizes, h), pa.binary()), pa.array([x.tobytes() for x in bands], pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    id_type = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"doc_id {id_type}, n_shingles long, digest binary, bands binary")


def crowded_buckets(classes: DataFrame) -> DataFrame:
    """(key, node, size) of all buckets that two or more classes share.

    Most keys are one class's own: a bitmap of those that occur twice, from
    packed keys, keeps them out of the join. Where it lets too much through,
    the counts decide all the same."""
    n = buckets_for(classes)

    def bands_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<u8").reshape(batch.num_rows, -1)

    def send(batches):
        for b in batches:
            if b.num_rows:
                keys = np.sort(bands_of(b).ravel())
                third = np.zeros(len(keys), bool)
                third[2:] = keys[2:] == keys[:-2]
                keys = keys[~third]
                for bucket, at in split_by(range_bucket(keys, n)):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([six_bytes(keys[at])], pa.binary())], ["bucket", "marks"])

    shared = classes.sparkSession.sparkContext.broadcast(Bitmap.of_repeated(classes.select("bands").mapInArrow(send, "bucket int, marks binary"), KEY_BITS))

    def explode(batches):
        for b in batches:
            if b.num_rows:
                bands = bands_of(b)
                hit = shared.value.has(bands)
                node = np.repeat(np.asarray(b.column("node"), dtype=np.int64), hit.sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(signed(bands[hit])), pa.array(node)], ["key", "node"])

    pairs = classes.select("node", "bands").mapInArrow(explode, "key long, node long")
    size = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return pairs.join(size, "key")


def fetched(nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(node, shingles): the full sets of the classes in ``nodes`` (node,
    digest, doc_id), from the texts of their documents."""
    ends = written(nodes, "ends")
    keep = Bitmap.of(ends.select(F.xxhash64("doc_id").alias("h")), "h", FETCH_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(keep)  # 2**FETCH_BITS bits

    def wanted(batches):
        hashes = WordHashes()
        for batch in batches:
            hit = shared.value.has(np.asarray(batch.column("h"), dtype=np.int64).view(np.uint64))
            for b in slices([batch.filter(pa.array(hit))], "text"):
                sizes, _, h = sets_of(raw(b.column("text")), width, hashes)
                cuts = np.concatenate([[0], np.cumsum(sizes)]) * 6
                blob = six_bytes(h)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(digests(sizes, h), pa.binary()), pa.array([blob[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary())],
                    ["doc_id", "digest", "shingles"],
                )

    id_type = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key).alias("h"), F.col(text).alias("text")).where("doc_id is not null")
    sets = source.mapInArrow(wanted, f"doc_id {id_type}, digest binary, shingles binary")
    # A repeated row gives its set twice: one is enough.
    return written(sets.join(ends, ["doc_id", "digest"]).dropDuplicates(["node"]).select("node", "shingles"), "sets")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    few = 2 * edges.count() <= FEW_ENDS
    if few:
        sets = sets.join(F.broadcast(ends), "node", "left_semi")
    both = (
        edges.select("a", "b")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    )

    def check(batches):
        for b in slices(batches, "sa"):
            good = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                x, y = from_six(x), from_six(y)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                common = int((x[at] == y).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return written(both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"), "links")


def cell_links(bands: np.ndarray, band: int, component: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the components of a cell's members, enough of them to
    join what its pairs join. Where the cell has two sides, a pair takes one
    of each. A pair that shares an earlier band is left to that one."""
    sizes = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts, mark = ends - sizes, np.zeros(int(flat.max()) + 1, np.int64)
    two = side.min() != side.max()
    root, out = component.copy(), []
    for i in range(len(sets) - 1):
        rest = slice(i + 1, None)
        fit = (root[rest] != root[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
        if two:
            fit &= side[rest] != side[i]
        at = np.flatnonzero(fit) + i + 1
        at = at[~(bands[at, :band] == bands[i, :band]).any(1)]
        if not len(at):
            continue
        own = flat[starts[i] : ends[i]]
        mark[own] = 1
        many = sizes[at]
        common = np.add.reduceat(mark[np.concatenate([flat[starts[j] : ends[j]] for j in at])], np.cumsum(many) - many)
        mark[own] = 0
        for j in at[100 * common >= percent * (sizes[i] + many - common)]:
            if root[j] != root[i]:
                out.append((int(component[i]), int(component[j])))
                root[root == root[j]] = root[i]
    return out


def crossing(open_: DataFrame, bands: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that a pair of members of a bucket links. Every pair
    of ``open_`` (key, node, n, component) whose members share a bucket and
    not a component is tested, once, in the first bucket that it shares.

    A bucket's members are dealt into blocks; a *cell* has one or two blocks
    of a bucket, and each pair of blocks is a cell. Pairs exist inside a
    cell's task only."""
    size = open_.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("all_n"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("all_n") / BLOCK_SHINGLES)).cast("int")
    rows = open_.join(size.where("x <> y").select("key", blocks.alias("blocks")), "key").withColumn("side", F.expr("CAST(pmod(xxhash64(node), blocks) AS INT)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "component")
    full = rows.join(bands, "node").join(sets, "node").select("key", "i", "j", "side", "component", "bands", "shingles")
    full = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def links(cell):
        side = np.concatenate([np.asarray(b.column("side")) for b in cell])
        component = np.concatenate([np.asarray(b.column("component"), dtype=np.int64) for b in cell])
        if component.min() == component.max():
            return []
        bands = np.frombuffer(b"".join(chain.from_iterable(b.column("bands").to_pylist() for b in cell)), "<i8").reshape(len(side), -1)
        sets = [from_six(x) for b in cell for x in b.column("shingles").to_pylist()]
        band = int(np.flatnonzero(bands[0] == cell[0].column("key")[0].as_py())[0])
        if cell[0].column("i")[0].as_py() != cell[0].column("j")[0].as_py() and side.min() == side.max():
            return []
        return cell_links(bands, band, component, side, sets, percent)

    def run(batches):
        cell, at = [], None
        for b in batches:
            if not b.num_rows:
                continue
            names = np.stack([np.asarray(b.column(c), dtype=np.int64) for c in ("key", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), b.num_rows]
            found = []
            for x, y in zip(cuts, cuts[1:]):
                if at != (name := tuple(names[x].tolist())):
                    found += links(cell) if cell else []
                    cell, at = [], name
                cell.append(b.slice(x, y - x))
            yield ends(found)
        yield ends(links(cell) if cell else [])

    def ends(found):
        x = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    return written(full.mapInArrow(run, "a long, b long"), "crossing")


def _linked(classes: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(node, component) of the classes that have a link."""
    crowded = written(crowded_buckets(classes.select("node", "bands")), "crowded")
    # The more classes meet a class in its buckets, the likelier it is the
    # one that a cluster's others are near to: it becomes the hub.
    weight = crowded.groupBy("node").agg(F.sum("size").alias("weight"))
    weight = weight.join(classes.select("node", F.col("n_shingles").alias("n")), "node")
    crowded = written(crowded.select("key", "node").join(weight, "node"), "crowded")
    sets = fetched(classes.select("node", "digest", "doc_id").join(weight.select("node"), "node", "left_semi"), docs, key, text, width)
    best = F.max(F.struct("weight", F.xxhash64("node").alias("h"), "node", "n")).alias("best")
    hubs = written(crowded.groupBy("key").agg(best).select("key", F.col("best.node").alias("hub"), F.col("best.n").alias("hub_n")), "hubs")
    others = crowded.join(hubs, "key").where("node <> hub")
    # Sets of too different sizes can't be similar.
    edges = others.where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    edges = written(edges.groupBy(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).agg(F.count(F.lit(1)).alias("n")), "candidates")
    # First each class's candidate that most buckets gave, then what still
    # crosses components.
    ends = edges.select("a", "b", "n").union(edges.select("b", "a", "n")).toDF("v", "u", "n")
    best = ends.groupBy("v").agg(F.max_by("u", F.struct("n", F.xxhash64("u"))).alias("u"))
    best = written(best.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "best")
    joined = components(confirmed(best, sets, percent))
    side = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias("c" + c))
    rest = edges.join(best, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    fresh = confirmed(rest.where("coalesce(ca, a) <> coalesce(cb, b)"), sets, percent)
    # The components so far stand for the links that made them.
    so_far = lambda: joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if not fresh.isEmpty():
        joined = components(so_far().union(fresh))
    # A bucket's hub has met all others there; pairs of others that are still
    # in different components have not.
    open_ = others.select("key", "node", "n").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    fresh = crossing(open_, classes.select("node", "bands"), sets, percent)
    return joined if fresh.isEmpty() else components(so_far().union(fresh))


def near_duplicates(docs: DataFrame, width: int, percent: int, key: str = "doc_id", text: str = "text", bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest, component_id, kept of every row."""
    bound_batches(docs.sparkSession)
    profile = written(_profile(docs, key, text, width, bins, rows), "profile")
    live = profile.where("n_shingles > 0 and doc_id is not null")
    same = live.groupBy("digest").agg(F.min_by("bands", "doc_id").alias("bands"), F.max("n_shingles").alias("n_shingles"), F.min("doc_id").alias("doc_id"))
    classes = written(same.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbered once, as written
    joined = _linked(classes, docs, key, text, width, percent)
    nodes = classes.select("node", "digest", "doc_id")
    # A component's label is the smallest doc_id of its classes.
    label = nodes.join(joined, "node").groupBy("component").agg(F.min("doc_id").alias("label"))
    label = joined.join(label, "component").select("node", "label")
    found = nodes.join(label, "node", "left").select("digest", F.coalesce("label", "doc_id").alias("label"))
    out = profile.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", "digest", component.alias("component_id"), (F.coalesce(component == F.col("doc_id"), F.lit(True))).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that near_duplicates doesn't keep."""
    gone = near_duplicates(docs, width, percent, key, text).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[key].eqNullSafe(gone["__gone"]), "left_anti")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each document by three-word shingles, similarity 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
