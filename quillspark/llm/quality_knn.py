"""Operator 6: quality by nearest-neighbour voting in a latent space.

A text's terms are its byte pairs, and a few ratios (case, digits, signs,
blanks, repeated words and lines, word lengths). A singular value
decomposition of the weighted terms of a bounded labelled sample gives
``DIMS`` latent directions; the sample's latent vectors are broadcast (SAMPLE
vectors of DIMS numbers). Every document is projected, its cosines to all
labelled vectors are exact blocked matrix products, and its ``NEIGHBOURS``
nearest vote with their similarity.

Defined cases: a null or empty text has the zero vector, for which the score
is the sample's share of good texts; so it is without labels (0.5 if none).
A very long text is scored whole. A null doc_id isn't held out. Repeated rows
are scored each; for learning, rows that share an id count once. Of labelled
vectors that are equally near as the last neighbour, those vote that come first in
the sample's order (by term vector, then label). Extra columns are dropped, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of, raw, slices
from .labelled import labelled_sample

#: Bounds of what is fitted and broadcast.
SAMPLE, PAIRS, DIMS, NEIGHBOURS = 4_000, 1_024, 32, 15
THRESHOLD = 0.7
RATIOS = 10
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN[48:58] = _SIGN[65:91] = _SIGN[97:123] = False


def pair_counts(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    return np.bincount(b[:-1].astype(np.int32) << 8 | b[1:], minlength=65536) if len(b) > 1 else np.zeros(65536, np.int64)


def term_counts(text: bytes, term_of: np.ndarray, n: int, step: int = 1 << 20) -> np.ndarray:
    """How often each of n terms occurs; ``term_of`` has each byte pair's term,
    n for those that are none. A long text is read in steps."""
    b, out = np.frombuffer(text, np.uint8), np.zeros(n + 1, np.int64)
    for a in range(0, len(b) - 1, step):
        part = b[a : a + step + 1]
        out += np.bincount(term_of[part[:-1].astype(np.uint16) << 8 | part[1:]], minlength=n + 1)
    return out[:n]


def ratios(text: bytes) -> np.ndarray:
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(len(text), 1)
    words = text.split()
    m = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    triples = list(zip(words, words[1:], words[2:]))
    return np.array(
        [
            b[_UPPER].sum() / n, b[_DIGIT].sum() / n, b[_BLANK].sum() / n, b[_SIGN].sum() / n, 1 - len(set(lines)) / k,
            1 - len(set(words)) / m, 1 - len(set(triples)) / max(len(triples), 1), min(sum(map(len, words)) / m / 20, 1.0),
            min(np.log1p(m) / 12, 1.0), b[128:].sum() / n,
        ]
    )


#: How much a ratio weighs against the byte pairs.
RATIO_WEIGHT = 1.0


@dataclass(frozen=True)
class Space:
    pairs: np.ndarray  # the byte pairs that are terms
    idf: np.ndarray
    basis: np.ndarray  # terms x DIMS
    mean: np.ndarray
    vectors: np.ndarray  # labelled, of length 1
    votes: np.ndarray
    prior: float

    def terms(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.pairs) + RATIOS), np.float32)
        term_of = np.full(65536, len(self.pairs), np.int16)
        term_of[self.pairs] = np.arange(len(self.pairs))
        for i, t in enumerate(texts):
            if t:
                out[i, : len(self.pairs)] = np.sqrt(term_counts(t, term_of, len(self.pairs)) / len(t)) * self.idf
                out[i, len(self.pairs) :] = RATIO_WEIGHT * ratios(t)
        return out

    def project(self, terms: np.ndarray) -> np.ndarray:
        x = (terms - self.mean) @ self.basis
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.maximum(norm, 1e-9)

    def scores(self, texts: list[bytes], block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for a in range(0, len(texts), block):
            part = texts[a : a + block]
            cos = self.project(self.terms(part)) @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            last = np.take_along_axis(cos, near, 1).min(1)
            for r in np.flatnonzero((cos >= last[:, None]).sum(1) > k).tolist():  # others are as near as the last
                near[r] = np.lexsort((np.arange(cos.shape[1]), -cos[r]))[:k]
            w = np.maximum(np.take_along_axis(cos, near, 1), 0.0).astype(np.float64) ** 4 + 1e-9
            got = (w * self.votes[near]).sum(1) / w.sum(1)
            out[a : a + block] = np.where([bool(t) for t in part], got, self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(sample: DataFrame) -> Space:
    """The latent space of a sample (text, y) of at most SAMPLE rows. Tasks
    turn texts into term vectors; the driver gets these."""

    def df(batches):
        total, rows = np.zeros(65536, np.int64), 0
        for b in slices(batches, "text"):
            for t in raw(b.column("text")):
                total += pair_counts(t) > 0
                rows += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i4").tobytes()], pa.binary()), pa.array([rows], pa.int64())], ["df", "n"])

    parts = sample.mapInArrow(df, "df binary, n long").collect()
    n = sum(r["n"] for r in parts)
    count = sum((np.frombuffer(r["df"], "<i4").astype(np.int64) for r in parts), np.zeros(65536, np.int64))
    pairs = np.sort(np.lexsort((np.arange(65536), -count))[:PAIRS])
    idf = np.log((n + 1) / (count[pairs] + 1)) + 0.25
    width = PAIRS + RATIOS
    empty = Space(pairs, idf, np.zeros((width, 1)), np.zeros(width), np.zeros((0, 1)), np.zeros(0), 0.5)
    if not n:
        return empty

    def vectors(batches):
        for b in slices(batches, "text"):
            x = empty.terms(raw(b.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array([v.astype("<f4").tobytes() for v in x], pa.binary()), b.column("y")], ["v", "y"])

    rows = sample.mapInArrow(vectors, "v binary, y int").orderBy("v", "y").toArrow()
    x = np.frombuffer(b"".join(rows["v"].to_pylist()), "<f4").reshape(-1, width).astype(np.float64)
    y = np.asarray(rows["y"], dtype=np.float64)
    mean = x.mean(0)
    value, vector = np.linalg.eigh((x - mean).T @ (x - mean))
    basis = vector[:, np.argsort(-value)[:DIMS]]
    space = Space(pairs, idf, basis, mean, np.zeros((0, DIMS)), y, float(y.mean()))
    return Space(pairs, idf, basis.astype(np.float32), mean.astype(np.float32), space.project(x).astype(np.float32), y, float(y.mean()))


def score_texts(docs: DataFrame, space: Space, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(space)  # SAMPLE x DIMS numbers and the basis

    def run(batches):
        for b in slices(batches, text):
            s = shared.value.scores(raw(b.column(text)))
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    id_type = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, held_out.alias("held_out")).mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    return crc_of(doc_id) % 4 == 2


def train_rows(doc_id: Column) -> Column:
    return crc_of(doc_id) % 4 != 2


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by votes of the labelled training rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    space = fit(labelled_sample(docs, labels, "quality", train_rows, SAMPLE))
    return score_texts(docs, space, held_out(F.col("doc_id")))
