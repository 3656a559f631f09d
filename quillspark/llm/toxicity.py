"""Operator 4: toxicity by a weighted lexicon and Aho-Corasick.

Folding: lower case, homoglyphs (Cyrillic, Greek, full-width) to Latin
letters, digits and signs that stand for letters to these letters, and all
punctuation to blanks. Every term starts at a word's border: a whole word or the
beginning of a word.

The lexicon is learned on a bounded sample of labelled documents: terms that
enough toxic documents have, weighted by the log of their odds against
clean ones. A phrase of a term and a neighbouring word which clean documents
have and toxic ones hardly do is an exception; a term within it counts
nothing. A text's matched weight, and that per length, go through a logistic
curve fitted on the same sample.

Defined cases: a null or empty text has no match and gets the score of that.
A very long text is scored whole. A null doc_id isn't held out. Repeated rows
are scored each; for learning, rows that share an id count once. Terms of equal
weight rank by their text. ``score_texts`` drops extra columns, whatever their
names; ``keep_clean`` keeps all of them. Without labels of both kinds there is
no lexicon and the score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of, slices
from .labelled import labelled_sample

#: Bounds of what is fitted: labelled rows, terms and phrases counted (those
#: that most documents have), terms kept.
SAMPLE, COUNTED, TERMS = 20_000, 20_000, 2_000
#: A term needs so many toxic documents and so large a log of odds.
SUPPORT, LEAST_WEIGHT = 6, 2.5
STEMS = (4, 5, 6)

_HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s",
    "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ǀ": "l", "ɡ": "g", "ɑ": "a",
}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_BLANK = "!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~\t\n\r\v\f\xa0–—‘’“”…«»¿¡"
_IGNORED = "­​‌‍⁠﻿"
FOLD = (
    {ord(a): b for a, b in _HOMOGLYPHS.items()}
    | {ord(a): b for a, b in _DIGITS.items()}
    | dict.fromkeys(map(ord, _BLANK), " ")
    | dict.fromkeys(map(ord, _IGNORED), None)
    | {0xFF41 + i: chr(97 + i) for i in range(26)}
    | {0xFF10 + i: _DIGITS.get(str(i), str(i)) for i in range(10)}
)


def fold(text: str) -> str:
    """The folded text: its words, each between single blanks."""
    return f" {' '.join(text.lower().translate(FOLD).split())} "


def terms_of(folded: str) -> set[str]:
    """All terms a text has: words (closed by a blank) and stems."""
    out = set()
    for w in set(folded.split()):
        if len(w) > 2:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in STEMS if len(w) > n)
    return out


def phrases_at(folded: str, start: int) -> list[str]:
    """The word after ``start`` with its left and its right neighbour."""
    end = folded.index(" ", start + 1)
    left = folded.rfind(" ", 0, start)
    right = folded.find(" ", end + 1)
    return [folded[left : end + 1]] * (left >= 0) + [folded[start : right + 1]] * (right >= 0)


def phrases_of(folded: str, automaton) -> set[str]:
    """The phrases of all words that terms match."""
    return {p for start in starts_of(folded, automaton) for p in phrases_at(folded, start)}


def starts_of(folded: str, automaton) -> dict[int, float]:
    """Where words that terms match begin, with the largest weight."""
    out: dict[int, float] = {}
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight > out.get(start, 0.0):
            out[start] = weight
    return out


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, float, float]

    def automaton(self):
        a = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            a.add_word(term, (len(term), weight))
        if len(a):
            a.make_automaton()
        return a if len(a) else None

    def matched(self, text: str, automaton) -> tuple[float, int]:
        """Summed weight of a text's terms, and its words."""
        folded = fold(text)
        words = folded.count(" ") - 1
        if automaton is None:
            return 0.0, words
        found = starts_of(folded, automaton)
        if found and self.exceptions:
            for start in list(found):
                if not self.exceptions.isdisjoint(phrases_at(folded, start)):
                    del found[start]
        return sum(found.values()), words

    def scores(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(weight))
        return 1 / (1 + np.exp(-(features(weight, words) @ np.array(self.curve))))


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(1000 * weight / (words + 20))], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def _count(sample: DataFrame, of: Callable[[], Callable[[str], set[str]]], least: int, most: int, toxic_only: bool) -> list[tuple[str, int, int]]:
    """(term, toxic documents, clean documents) of the terms that ``least``
    documents have; the ``most`` frequent ones, summed up by Spark."""

    def run(batches):
        found = of()
        for b in slices(batches, "text"):
            toxic, clean = Counter(), Counter()
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                (toxic if y else clean).update(found(fold(t or "")))
            names = list(toxic | clean)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())], ["term", "toxic", "clean"])

    rows = sample.where("y = 1") if toxic_only else sample
    total = rows.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    order = F.col("toxic") if toxic_only else F.col("toxic") + F.col("clean")
    return [tuple(r) for r in total.where(order >= least).orderBy(order.desc(), "term").limit(most).collect()]


def learn(sample: DataFrame) -> Lexicon:
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon({}, frozenset(), (0.0, 0.0, 0.0))
    counted = frozenset(t for t, _, _ in _count(sample, lambda: terms_of, SUPPORT, COUNTED, True))
    weights = {}
    totals = _count(sample, lambda: lambda folded: terms_of(folded) & counted, SUPPORT, COUNTED, False)
    # a stem that occurs in one word only says no more than the word
    of_word = {w[: n + 1]: toxic for w, toxic, _ in sorted(totals, key=lambda x: x[1]) if w[-1] == " " for n in STEMS}
    for term, toxic, clean in totals:
        if term[-1] != " " and of_word.get(term, 0) >= 0.8 * toxic:
            continue
        weight = float(np.log((toxic + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1)))
        if toxic >= SUPPORT and weight >= LEAST_WEIGHT:
            weights[term] = weight
    weights = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:TERMS])
    plain = Lexicon(weights, frozenset(), (0.0, 0.0, 0.0))
    found = _count(sample, lambda: lambda folded, a=plain.automaton(): phrases_of(folded, a) if a else set(), SUPPORT, COUNTED, False)
    exceptions = frozenset(p for p, toxic, clean in found if clean >= SUPPORT and toxic * n[0] <= 0.2 * clean * n[1])
    lexicon = Lexicon(weights, exceptions, (0.0, 0.0, 0.0))

    def measure(batches):
        a = lexicon.automaton()
        for b in slices(batches, "text"):
            got = [lexicon.matched(t or "", a) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64()), b.column("y")], ["weight", "words", "y"])

    rows = sample.mapInArrow(measure, "weight double, words long, y int").toPandas()  # SAMPLE rows of three numbers
    curve = fit_curve(features(rows.weight.to_numpy(), rows.words.to_numpy()), rows.y.to_numpy().astype(float))
    return Lexicon(weights, exceptions, tuple(float(x) for x in curve))


def _scored(lexicon: Lexicon, texts: list[str | None], automaton) -> np.ndarray:
    got = [lexicon.matched(t or "", automaton) for t in texts]
    return lexicon.scores(np.array([w for w, _ in got], float), np.array([n for _, n in got], float))


def score_texts(docs: DataFrame, lexicon: Lexicon, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        a = lexicon.automaton()
        for b in slices(batches, text):
            s = _scored(lexicon, b.column(text).to_pylist(), a)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    id_type = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, held_out.alias("held_out")).mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The rows that score under 0.5, with all their columns."""

    def run(batches):
        a = lexicon.automaton()
        for b in slices(batches, text):
            yield b.filter(pa.array(_scored(lexicon, b.column(text).to_pylist(), a) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return doc_id.isNotNull() & (crc_of(doc_id) % 5 == 0)


def train_rows(doc_id: Column) -> Column:
    return ~held_out(doc_id)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a lexicon of the labelled training rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = learn(labelled_sample(docs, labels, "toxic", train_rows, SAMPLE))
    return score_texts(docs, lexicon, held_out(F.col("doc_id")))
