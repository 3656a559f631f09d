"""Detections against the truth over all pages.

Pairs come from the grid join. The matches are those of a pass over the true
boxes in order, each taking its first free detection: a pair that is the first
of all that are left for its true box and for its detection belongs to them, so
every round takes all such pairs at once, on all pages, and drops what they touch.

Boxes marked ``ignore`` take no part; a detection that lies mostly on one is set aside.
The average precision of the data set ranks all detections: ranges of the order are
counted apart, and only their sums meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .spatial import BOX, intersection, joined_area, touching


def _met(truth: DataFrame, found: DataFrame, page: str, order: str, halves: int = 1) -> DataFrame:
    """(page, truth, found, ignore): the pairs that may match, and those where a
    detection lies mostly on a box to be ignored."""
    pairs = touching(truth.select(page, order, *BOX, "ignore"), found.select(page, order, *BOX), [page])
    own = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    ignore = F.col("a.ignore")
    pairs = pairs.where((ignore & (2 * intersection() > own)) | (~ignore & (2 * intersection() > halves * joined_area())))
    return pairs.select(F.col(f"a.{page}").alias(page), F.col(f"a.{order}").alias("truth"), F.col(f"b.{order}").alias("found"), ignore.alias("ignore"))


def _aside(met: DataFrame, page: str, order: str) -> DataFrame:
    return met.where("ignore").select(page, F.col("found").alias(order)).distinct()


def set_aside(truth: DataFrame, found: DataFrame, page: str = "page", order: str = "ord") -> DataFrame:
    """(page, ord) of the detections of which more than half lies on one box to be ignored."""
    return _aside(_met(truth.where("ignore"), found, page, order), page, order)


def matches(truth: DataFrame, found: DataFrame, page: str = "page", order: str = "ord", halves: int = 1, rounds: list[int] | None = None, met: DataFrame | None = None) -> DataFrame:
    """(page, truth, found): one-to-one matches of an IoU over a half (``halves``
    / 2). ``rounds`` gets the number of matches that each round makes; ``met``
    has the pairs, if they are known."""
    if met is None:
        met = kept(_met(truth, found, page, order, halves), "met")
    left = met.where("NOT ignore").join(_aside(met, page, "found"), [page, "found"], "left_anti").select(page, "truth", "found")
    out = []
    while True:
        pair = F.struct("truth", "found")
        first = left.withColumn("t", F.min(pair).over(Window.partitionBy(page, "truth"))).withColumn("f", F.min(pair).over(Window.partitionBy(page, "found")))
        taken = kept(first.where((F.col("t") == pair) & (F.col("f") == pair)).select(page, "truth", "found"), "matches")
        n = taken.count()
        if rounds is not None:
            rounds.append(n)
        out.append(taken)
        if not n:
            break
        left = left.join(taken.select(page, "truth"), [page, "truth"], "left_anti").join(taken.select(page, "found"), [page, "found"], "left_anti")
        left = kept(left, "pairs")
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def _quality(matched: Column, truth: Column, found: Column) -> list[Column]:
    """Precision, recall and their harmonic mean in millionths: without true
    boxes recall is whole, and precision too if nothing was found."""
    million = F.lit(1_000_000).cast("long")
    recall = F.when(truth == 0, million).otherwise(F.floor(million * matched / F.greatest(truth, F.lit(1))))
    precision = F.when(truth == 0, F.when(found > 0, 0).otherwise(million)).when(found == 0, 0).otherwise(F.floor(million * matched / F.greatest(found, F.lit(1))))
    # of whole numbers, as a mean of rounded ones would err
    mean = F.when(truth == 0, F.when(found > 0, 0).otherwise(million)).otherwise(F.floor(2 * million * matched / F.greatest(truth + found, F.lit(1))))
    return [precision.cast("long").alias("precision6"), recall.cast("long").alias("recall6"), mean.cast("long").alias("hmean6")]


def evaluated(truth: DataFrame, found: DataFrame, page: str = "page", order: str = "ord", matched: DataFrame | None = None) -> DataFrame:
    """(page, matched, truth, found, precision6, recall6, hmean6): what counts of each page."""
    met = kept(_met(truth, found, page, order), "met")
    m = matches(truth, found, page, order, met=met) if matched is None else matched
    care = found.join(_aside(met, page, order), [page, order], "left_anti")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = truth.select(page, F.when(F.col("ignore"), none).otherwise(one).alias("t"), none.alias("f"), none.alias("m"))
    rows = rows.unionByName(found.select(page, none.alias("t"), none.alias("f"), none.alias("m")))
    rows = rows.unionByName(care.select(page, none.alias("t"), one.alias("f"), none.alias("m"))).unionByName(m.select(page, none.alias("t"), none.alias("f"), one.alias("m")))
    sums = rows.groupBy(page).agg(F.sum("m").alias("matched"), F.sum("t").alias("truth"), F.sum("f").alias("found"))
    return sums.select(page, "matched", "truth", "found", *_quality(F.col("matched"), F.col("truth"), F.col("found")))


def average_precision(truth: DataFrame, found: DataFrame, page: str = "page", order: str = "ord", matched: DataFrame | None = None) -> DataFrame:
    """(matched, truth, found, ap6): the average precision over the detections
    of all pages by falling ``conf``, of equal ones by page and order."""
    met = kept(_met(truth, found, page, order), "met")
    m = matches(truth, found, page, order, met=met) if matched is None else matched
    care = found.join(_aside(met, page, order), [page, order], "left_anti")
    hits = m.select(page, F.col("found").alias(order), F.lit(1).alias("hit"))
    rows = care.select(page, order, F.coalesce("conf", F.lit(0)).alias("conf")).join(hits, [page, order], "left").select(F.col("conf"), page, order, F.coalesce("hit", F.lit(0)).alias("hit"))
    by = [F.desc("conf"), F.asc(page), F.asc(order)]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the range that a row fell in is written with it, so it stays the same
    ranged = kept(rows.repartitionByRange(parts, *by).withColumn("range", F.spark_partition_id()), "ranked")
    sums = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sums.select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "nh"))
    own = Window.partitionBy("range").orderBy(*by)
    ranks = ranged.withColumns({"k": F.row_number().over(own), "c": F.sum("hit").over(own.rowsBetween(Window.unboundedPreceding, 0))}).join(F.broadcast(starts), "range")
    share = F.floor(1_000_000 * (F.col("c") + F.col("h_before")) / (F.col("k") + F.col("n_before")))
    total = ranks.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("matched"), F.count(F.lit(1)).alias("found"), F.coalesce(F.sum(F.when(F.col("hit") == 1, share)), F.lit(0)).alias("s"))
    counted = truth.where("NOT ignore").agg(F.count(F.lit(1)).alias("truth"))
    return total.crossJoin(counted).select("matched", "truth", "found", F.when(F.col("truth") > 0, F.floor(F.col("s") / F.greatest("truth", F.lit(1)))).otherwise(0).cast("long").alias("ap6"))
