"""A bounded sample of labelled documents, for operators 4 and 6."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Callable[[Column], Column], rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y) of labelled documents whose id ``train`` accepts: those
    ``rows`` with the least hash of their id.

    Ids and labels are broadcast, ``rows`` pairs at most. A document with
    several labels takes the largest; null ids and labels are left out; of
    document rows that share an id the one with the least text counts.
    """
    ids = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .where("id is not null and y is not null")
        .where(train(F.col("id")))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return written(own.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y"), "sample")
