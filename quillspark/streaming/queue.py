"""The task queue as a file stream, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import new_folder


def task_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """Rows of a folder's Parquet files as they arrive, oldest first."""
    return spark.readStream.schema(schema).option("latestFirst", "false").option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(stream: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and type, with a bound on lateness."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def event_windows(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Run the stream over what is there now, and return its complete table.
    Every batch writes the counts as of then under its own number in the
    shared folder; one that is run again writes the same."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    out, checkpoint = new_folder(spark, "windows"), new_folder(spark, "windows-checkpoint")
    counts = windowed_counts(task_stream(spark, folder, schema, pattern)).select(F.col("w.start").alias("start"), "event_type", "n")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
