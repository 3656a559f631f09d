"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of documents. ``run`` writes each stage's result to the
shared folder and reads it again for the next one.

Defined cases, in every stage: extra columns go along, whatever their names, up
to packing, which drops them. A null or empty text fails the quality rules, so
later stages don't see one there; given one, toxicity keeps it, near-dedup and
suffix dedup leave it alone, packing gives it its end token. A null doc_id is kept, and
no other row is a copy of it. Of repeated rows near-dedup keeps all that share
the least doc_id of their group. A very long text is handled whole. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import near_dup, packing, quality_rules, suffix_dedup, toxicity
from quillspark.llm.common import bound_batches, written
from quillspark.llm.labelled import labelled_sample


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    bound_batches(spark)
    return quality_rules.keep_good(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the lexicon is learned from the
    labelled training rows of what came in."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn(labelled_sample(docs, labels, "toxic", toxicity.train_rows, toxicity.SAMPLE))
    return toxicity.keep_clean(docs, lexicon)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8."""
    bound_batches(spark)
    return near_dup.keep_first(docs, width=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that an earlier one has; n_chars follows."""
    bound_batches(spark)
    out = suffix_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("best_fit_packing", pack),
]

#: Hashing, learning and packing can't be said in SQL; the stages are tested
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
