"""Operator 10: repetition rules from a suffix array.

The words of a text are its symbols. Its suffixes are sorted by prefix
doubling; the ranks of all doublings give the longest common prefix (LCP) of
neighbours in that order. The LCP intervals' repeated
substrings, each at full length, start where a suffix has a neighbour with an
LCP of ``min_repeat`` words or more; their spans' union is the covered part.
A text goes if more than ``max_covered`` percent of its words are covered or
if its longest repeat has more than ``max_longest`` words.

The plain counts (word characters, symbols, repeated lines, repeated 8-word
windows) come from the same pass. Words are compared by 64-bit hash within
one text.

Defined cases: a null or empty text has no words, so it fails the base rule.
A very long text is a slice of its own, judged whole; its ranks take 4 bytes a
word for each doubling of its longest repeat. A null doc_id is kept as it is.
Repeated rows are judged each for itself. Extra columns, whatever their names,
are dropped by ``repetition`` and kept by ``keep_good``. An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import raw, slices

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: The method's limits: least length of a repeat, covered share, longest repeat.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 5, 30, 200
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)


def suffix_ranks(symbols: np.ndarray, doc: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(span, ranks) of each doubling of a suffix sort of all documents.

    A rank is the place of its group's first suffix; equal ranks at a span
    mean that so many symbols are equal. A suffix alone in its group keeps
    its rank from then on, so later passes sort the others only. A suffix
    that ends comes before those that go on.
    """
    n = len(symbols)
    live = np.lexsort((symbols, doc))
    s, d = symbols[live], doc[live]
    new = np.ones(n, bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    place = np.arange(n)
    first = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.empty(n, np.int32)  # one a doubling is kept
    rank[live] = first
    levels, span = [(1, rank)], 1
    while True:
        last = np.ones(len(live), bool)
        last[:-1] = new[1:]
        shared = ~(new & last)
        live, place = live[shared], place[shared]
        if not len(live):
            return levels
        ahead = live + span
        inside = ahead < n
        ahead[~inside] = 0
        inside &= doc[ahead] == doc[live]
        own, second = rank[live], np.where(inside, rank[ahead], -1)
        order = np.lexsort((second, own))
        live, own, second = live[order], own[order], second[order]
        # the places of a group are consecutive, and stay so
        new = np.ones(len(live), bool)
        new[1:] = (own[1:] != own[:-1]) | (second[1:] != second[:-1])
        rank = rank.copy()
        rank[live] = np.maximum.accumulate(np.where(new, place, 0))
        span *= 2
        levels.append((span, rank))


def longest_repeats(symbols: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each position the length of the longest prefix of its suffix that
    occurs again in its document, if that is ``least`` or more; else 0.

    ``doc`` numbers the documents that stand one after the other.
    """
    n = len(symbols)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    levels = suffix_ranks(symbols, doc)
    base = max((k for k, (span, _) in enumerate(levels) if span <= least), default=0)
    # neighbours in suffix order that share the largest span up to ``least``
    ranks = levels[base][1]
    shared = np.flatnonzero(np.bincount(ranks, minlength=n)[ranks] > 1)
    sa = shared[np.argsort(levels[-1][1][shared])]
    if len(sa) < 2:
        return out
    i, j = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(i), np.int64)
    end = np.full(n + 1, -1, doc.dtype)
    end[:n] = doc
    for span, rank in reversed(levels):
        ii, jj = np.minimum(i, n - 1), np.minimum(j, n - 1)
        same = (rank[ii] == rank[jj]) & (i < n) & (j < n) & (end[i] == doc[sa[:-1]]) & (end[j] == doc[sa[1:]])
        step = span * same
        lcp += step
        i, j = i + step, j + step
    lcp[lcp < least] = 0
    wide = np.zeros(len(sa) + 1, np.int64)
    wide[1:-1] = lcp
    out[sa] = np.maximum(wide[:-1], wide[1:])
    return out


def covered(doc: np.ndarray, lengths: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of ``least`` words or more."""
    n = len(lengths)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(lengths >= least)
    edge[:n][at] += 1
    np.add.at(edge, at + lengths[at], -1)
    return np.cumsum(edge[:n]) > 0


def repetition(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered: int = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """The counts and verdicts of every document, with n_covered and
    longest_repeat (words) as further columns."""
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in slices(batches, text):
            yield judge(b, key, text, min_repeat, max_covered, max_longest)

    return docs.select(key, text).mapInArrow(
        run,
        f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " n_covered long, longest_repeat long, base_failed boolean, kept boolean",
    )


def judge(b: pa.RecordBatch, key: str, text: str, min_repeat: int, max_covered: int, max_longest: int) -> pa.RecordBatch:
    data = raw(b.column(text))
    words = [x.split() for x in data]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    doc = np.repeat(np.arange(len(words)), n_words)
    lengths = longest_repeats(hashes(flat), doc, min_repeat)
    n_docs = len(words)
    cover = np.bincount(doc[covered(doc, lengths, min_repeat)], minlength=n_docs)
    repeat = np.bincount(doc[covered(doc, lengths, WINDOW)], minlength=n_docs)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, doc[lengths > 0], lengths[lengths > 0])
    chars, symbols, lines = [], [], []
    for x in data:
        s = x.decode()
        chars.append(len(s) - sum(map(s.count, BLANKS)))
        symbols.append(sum(map(s.count, SYMBOLS)))
        own = [y for y in s.split("\n") if y.strip(BLANKS)]
        lines.append(len(own) - len(set(own)))
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    kept = ~failed & (100 * cover <= max_covered * n_words) & (longest <= max_longest)
    columns = {
        "doc_id": b.column(key), "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines,
        "n_repeat_words": repeat, "n_covered": cover, "longest_repeat": longest, "base_failed": failed, "kept": kept,
    }
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k, x in columns.items()], list(columns))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    One pass: the rows themselves go through the step, so no join on an id
    that may be null or repeated is needed."""

    def run(batches):
        for b in slices(batches, text):
            yield b.filter(judge(b, key, text, MIN_REPEAT, MAX_COVERED, MAX_LONGEST).column("kept"))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and verdicts of all documents."""
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"))
