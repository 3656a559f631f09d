"""Plumbing shared by the operators: shared-folder tables, packed exchanges,
text slicing, word hashing, and a bitmap of fixed size.

A *packed exchange* moves columnar blobs instead of rows: each task groups
what it has to send by target bucket and ships one row of binary columns per
bucket. The buckets are hash ranges, so they are even; whatever a task can
combine (equal keys) it combines before it sends.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step works on at once; what counts or encodes
#: distinct words gains by more. A longer text is a slice of its own; nothing is cut.
SLICE_BYTES, WORD_BYTES = 1 << 20, 2 << 20
#: Bytes of a row group in the tables that are written on the way: a task holds
#: one in memory.
ROW_GROUP = 16 << 20
#: Edges of a graph that a task works on, where there are few.
EDGES_A_TASK = 20_000
#: Distinct words whose hashes a worker remembers between slices.
WORDS_KEPT = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share. Where none is set, a local session
    gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="quillspark-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


#: Tables that ``written`` made, by application.
_TABLES: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.

    The read-back lists the columns explicitly, so an empty table keeps them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Remove all that ``written`` made in this application: for when the
    operators' results have been written elsewhere."""
    delete(spark, _TABLES.pop(spark.sparkContext.applicationId, []))


def buckets_for(df: DataFrame, per_partition: int = 2) -> int:
    """Buckets of an exchange: in proportion to the input's partitions."""
    spark = df.sparkSession
    parts = df.rdd.getNumPartitions()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_partition * parts, 4)


#: Bytes of text of which a bucket gets its share.
BUCKET_BYTES = 8 << 20


def buckets_by_size(df: DataFrame, text: str, at_once: int = BUCKET_BYTES) -> int:
    """Buckets that don't grow with the input: ``buckets_for``, and more where
    partitions are large."""
    size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(buckets_for(df), -(-size // at_once))


def bound_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand Python at most ``rows`` rows at once, for the rest of the session:
    texts are long, and both sides hold a batch in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def six_bytes(h: np.ndarray) -> bytes:
    """The upper six bytes of 64-bit numbers; sorted ones stay sorted."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))


def slices(batches: Iterable[pa.RecordBatch], column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Join or cut batches so that a slice has about ``budget`` bytes of ``column``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        total = int(lengths.sum())
        if held and size + total > budget:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, size = [], 0
        if total <= budget:
            held.append(batch)
            size += total
            continue
        part = np.cumsum(lengths) // budget
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash, the same on every machine."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORDS_KEPT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalising step of MurmurHash3: a bijection of 64-bit numbers."""
    h = h ^ (h >> _S)
    h = h * _M1
    h ^= h >> _S
    h = h * _M2
    h ^= h >> _S
    return h


def split_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) for each bucket that occurs."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    for rows in np.split(order, cuts):
        yield int(bucket[rows[0]]), rows


def range_bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the 64-bit numbers each hash falls in."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


class Bitmap:
    """One bit for each of 2**bits ranges of the 64-bit hashes.

    Its size is a parameter and doesn't depend on the data; a fuller bitmap
    lets more candidates through, which the exact steps after it drop.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    @staticmethod
    def of(keys: DataFrame, column: str, bits: int) -> "Bitmap":
        """From rows of 64-bit keys (as long). Spark ORs the bytes; only
        those that aren't 0 reach the driver, 2**bits / 8 at most."""
        at = F.shiftrightunsigned(F.col(column), 64 - bits)
        rows = (
            keys.select(F.shiftrightunsigned(at, 3).alias("i"), F.expr("1").alias("one"), (at.bitwiseAND(F.lit(7))).cast("int").alias("b"))
            .groupBy("i")
            .agg(F.bit_or(F.expr("shiftleft(1, b)")).cast("int").alias("v"))
            .toArrow()
        )
        words = np.zeros(1 << (bits - 3), dtype=np.uint8)
        words[np.asarray(rows["i"], dtype=np.int64)] = np.asarray(rows["v"], dtype=np.int64).astype(np.uint8)
        return Bitmap(words, bits)


    @staticmethod
    def of_repeated(parts: DataFrame, bits: int) -> "Bitmap":
        """From rows (bucket, marks) of packed 64-bit numbers, six bytes each:
        what occurs twice or more. Senders need not send a number more than
        twice. The driver gets 2**bits bits at most."""

        def meet(t: pa.Table) -> pa.Table:
            m = np.sort(from_six(b"".join(t["marks"].to_pylist())))
            twice = np.unique(m[1:][m[1:] == m[:-1]])
            at = twice >> np.uint64(64 - bits)
            byte, first = np.unique(at >> np.uint64(3), return_index=True)
            bit = np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8)
            value = np.bitwise_or.reduceat(bit, first) if len(first) else bit
            return pa.table({"at": pa.array([byte.astype("<u4").tobytes()], pa.binary()), "value": pa.array([value.tobytes()], pa.binary())})

        words = np.zeros(1 << (bits - 3), np.uint8)
        for r in parts.groupBy("bucket").applyInArrow(meet, "at binary, value binary").toLocalIterator():
            np.bitwise_or.at(words, np.frombuffer(r["at"], "<u4"), np.frombuffer(r["value"], np.uint8))
        return Bitmap(words, bits)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph: each node with the least
    node of its component; nodes without edges don't appear.

    Alternating large-star and small-star rounds, each a group-by with a
    minimum; a hub is never gathered in one place. Every round's edges are
    written to the shared folder.
    """
    now = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "cc")
    spark, count = edges.sparkSession, F.count(F.lit(1))
    table = _TABLES[spark.sparkContext.applicationId][-1]
    before, rows = None, now.count()
    while True:
        # Few edges need few tasks; each task makes files at every exchange.
        tasks = 4 + rows // EDGES_A_TASK
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct().coalesce(tasks)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct().coalesce(tasks), "cc")
        delete(spark, [table])  # the next round is there, whole
        table = _TABLES[spark.sparkContext.applicationId][-1]
        state = now.agg(count, F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, rows = state, state[0]
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
