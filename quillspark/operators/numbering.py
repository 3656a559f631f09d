"""Numbers in an order, for tables and groups of any size.

The rows are sorted into ranges over all tasks; each range is numbered apart,
and the ranges' counts tell where a range begins. A group with a third of all rows
is spread over ranges; groups of up to ``SMALL`` rows are each numbered by a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


#: Rows of a group that one task numbers.
SMALL = 100_000


def numbered(rows: DataFrame, by: list[Column], name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their number from 1 in the order ``by``, in each group of
    equal ``within`` columns. ``by`` should order all rows; of equal ones any may come first."""
    if not within:
        return _ranged(rows, by, name, within)
    large = kept(rows.groupBy(*within).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SMALL).drop("_n"), "large")
    window = lambda rows: rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*by)).cast("long"))
    if not large.count():
        return window(rows)
    # a large group has over SMALL rows, so there are few
    at = F.broadcast(large.select(*(F.col(c).alias(f"_of_{c}") for c in within)))
    on = F.lit(True)
    for c in within:
        on = on & rows[c].eqNullSafe(F.col(f"_of_{c}"))
    return window(rows.join(at, on, "left_anti")).unionByName(_ranged(rows.join(at, on, "left_semi"), by, name, within))


def _ranged(rows: DataFrame, by: list[Column], name: str, within: tuple[str, ...]) -> DataFrame:
    """``numbered``, for groups of any size."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [*(F.asc(c) for c in within), *by]
    # the range is written with the row, so that it stays the same when a task is run again
    ranged = kept(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_range", *within).agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*within) if within else Window).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sums.select("_range", *within, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = ranged.withColumn(name, F.row_number().over(Window.partitionBy("_range", *within).orderBy(*by)))
    same = [own["_range"] == starts["_range"], *(own[c].eqNullSafe(starts[c]) for c in within)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    # there are as many starts as ranges, and one more for each group
    return own.join(starts, on).select(*(own[c] for c in rows.columns), (own[name] + starts["_before"]).cast("long").alias(name))


def natural_key(name: Column) -> Column:
    """A key whose order is the natural one of names: numbers by value, case aside."""
    pieces = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.when(F.regexp_like(x, F.lit("^[0-9]")), F.lpad(F.regexp_replace(x, "^0+", ""), 12, "0")).otherwise(x)), "")


def natural_order(names: DataFrame) -> DataFrame:
    """(id, place) of names (id, name)."""
    return numbered(names.select("id", natural_key(F.col("name")).alias("_key")), [F.asc("_key"), F.asc("id")], "place").select("id", "place")


def export_names(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """(page_id, idx, file_name) of the files whose task is completed:
    numbered in order, names that stand twice with a number of their own."""
    done = files.join(tasks.where("status = 'completed'").select(F.col("id").alias("page_id")), "page_id", "left_semi")
    stems = done.select("page_id", F.regexp_replace("name", "[.][^.]*$", "").alias("stem"))
    once = numbered(stems, [F.asc("page_id")], "copy", ("stem",))
    both = numbered(once, [F.asc("page_id")], "idx")
    number = F.when(F.col("copy") > 1, F.concat(F.lit("_"), F.col("copy").cast("string"))).otherwise("")
    return both.select("page_id", "idx", F.concat(F.lpad(F.col("idx").cast("string"), 4, "0"), F.lit("_"), F.col("stem"), number, F.lit("_translated.png")).alias("file_name"))
