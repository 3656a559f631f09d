"""JSON imports with errors per row, image files, and JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp")


def import_rows(documents: DataFrame) -> DataFrame:
    """(doc, pos, source, target, lang, target_lang, note, error).

    A text that isn't JSON, or no array, gives one row with an error and
    position 0; an item that is no object, or lacks source or target, an error
    with its position from 1."""
    parsed = F.try_parse_json("content")
    kind = F.schema_of_variant(parsed)
    base = documents.select("doc", parsed.alias("v"), kind.alias("kind"))
    bad = base.where(F.col("v").isNull() | ~F.col("kind").startswith("ARRAY")).select(
        "doc", F.lit(0).alias("pos"), F.lit(None).cast("variant").alias("item"), F.when(F.col("v").isNull(), "not JSON").otherwise("not an array").alias("problem")
    )
    items = base.where(F.col("kind").startswith("ARRAY")).select("doc", F.posexplode(F.col("v").cast("array<variant>")).alias("p", "item"))
    rows = items.select("doc", (F.col("p") + 1).alias("pos"), "item", F.lit(None).cast("string").alias("problem")).union(bad)
    get = lambda k: F.try_variant_get("item", f"$.{k}", "string")
    blank = lambda k: F.coalesce(F.trim(get(k)), F.lit("")) == ""
    error = F.when(F.col("problem").isNotNull(), F.col("problem")).when(~F.schema_of_variant("item").startswith("OBJECT"), "not an object").when(blank("source") | blank("target"), "missing source or target")
    return rows.select(
        "doc", "pos", get("source").alias("source"), get("target").alias("target"), F.coalesce(get("lang"), F.lit("ja")).alias("lang"),
        F.coalesce(get("target_lang"), F.lit("zh")).alias("target_lang"), F.coalesce(get("note"), F.lit("")).alias("note"), error.alias("error"),
    )


def import_report(documents: DataFrame) -> DataFrame:
    """doc, imported, skipped, errors: a row that an earlier one equals in
    (source, target, lang, target_lang) is skipped."""
    from pyspark.sql import Window as W

    rows = import_rows(documents)
    key = W.partitionBy("doc", "source", "target", "lang", "target_lang", F.col("error").isNull()).orderBy("pos")
    rows = rows.withColumn("rn", F.row_number().over(key))
    good = F.col("error").isNull()
    counts = rows.groupBy("doc").agg(F.count_if(good & (F.col("rn") == 1)).alias("imported"), F.count_if(good & (F.col("rn") > 1)).alias("skipped"), F.count_if(~good).alias("errors"))
    return documents.select("doc").join(counts, "doc", "left").na.fill(0, ["imported", "skipped", "errors"])


def image_files(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,webp}") -> DataFrame:
    """Path, name, length, content of the images under a folder; unreadable files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length", "content")


def checked_digest(files: DataFrame, expected: str) -> DataFrame:
    """Path, and whether the content has the SHA-256 expected."""
    return files.select("path", (F.sha2("content", 256) == F.lit(expected)).alias("ok"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line; text outside ASCII is kept."""
    rows.write.mode("overwrite").json(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """State as Parquet, never as pickled objects."""
    rows.write.mode("overwrite").parquet(path)


TERM_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("target_lang", T.StringType()), T.StructField("note", T.StringType()), T.StructField("builtin", T.BooleanType()), T.StructField("disabled", T.BooleanType()),
    ]
)


def migrated(rows: DataFrame, schema: T.StructType = TERM_SCHEMA) -> DataFrame:
    """Missing columns are added as nulls, known ones cast."""
    have = {f.name for f in rows.schema.fields}
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
