"""Punctuation on its own goes to the nearest text of its page (J9, A.8).

The fragments of a page are taken in order, each by the text whose box is
nearest at that time: a box that took one has grown, and its centre moved. It is
a fold over the page's arrays in the JVM, a page a row; pages without a fragment
or without a text stay out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import stripped

#: Characters of punctuation fragments.
MARKS = "。、，,！!？?…〜~ー―─-「」『』（）()♪☆★・･ "
_BOX = ("x0", "y0", "x1", "y1")


def is_fragment(text: Column) -> Column:
    """One or two characters, all of them marks."""
    t = stripped(text)
    return F.length(t).between(1, 2) & (F.translate(t, MARKS, "") == "")


def merged_fragments(regions: DataFrame, page: str = "page", order: str = "ord") -> DataFrame:
    """(page, ord, text, x0, y0, x1, y1, parts) of the regions that stay, with
    what they took in and how many. A fragment goes behind the text if it lies
    after its centre (below for upright text, to the right for level text), else
    before it. Of equally near texts the first is taken."""
    rows = regions.select(page, order, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("direction", F.lit("")).alias("direction"), *(F.col(c).cast("long").alias(c) for c in _BOX)).withColumn("f", is_fragment(F.col("text")))
    mixed = rows.groupBy(page).agg(F.count_if("f").alias("nf"), F.count_if(~F.col("f")).alias("nm")).where("nf > 0 AND nm > 0").select(page)
    own = F.struct(order, "text", "direction", *_BOX, F.lit(1).alias("parts"))
    arrays = rows.join(mixed, page, "left_semi").groupBy(page).agg(F.sort_array(F.collect_list(F.when(~F.col("f"), own))).alias("mains"), F.sort_array(F.collect_list(F.when(F.col("f"), own))).alias("frags"))

    def taken(mains: Column, f: Column) -> Column:
        near = F.transform(mains, lambda m, i: F.struct((
            (m["x0"] + m["x1"] - f["x0"] - f["x1"]) * (m["x0"] + m["x1"] - f["x0"] - f["x1"]) + (m["y0"] + m["y1"] - f["y0"] - f["y1"]) * (m["y0"] + m["y1"] - f["y0"] - f["y1"])).alias("d"), i.alias("i")))
        which = F.array_min(near)["i"]

        def grown(m: Column, i: Column) -> Column:
            upright = F.when(m["direction"] != "", m["direction"]).otherwise(f["direction"]) == "v"
            behind = F.when(upright, f["y0"] + f["y1"] >= m["y0"] + m["y1"]).otherwise(f["x0"] + f["x1"] >= m["x0"] + m["x1"])
            mark = stripped(f["text"])
            return F.when(i == which, F.struct(
                m[order].alias(order), F.when(behind, F.concat(m["text"], mark)).otherwise(F.concat(mark, m["text"])).alias("text"), m["direction"].alias("direction"),
                *(F.least(m[c], f[c]).alias(c) for c in _BOX[:2]), *(F.greatest(m[c], f[c]).alias(c) for c in _BOX[2:]), (m["parts"] + 1).alias("parts"),
            )).otherwise(m)

        return F.transform(mains, grown)

    folded = arrays.select(page, F.explode(F.aggregate("frags", F.col("mains"), taken)).alias("m")).select(page, f"m.{order}", "m.text", *(f"m.{c}" for c in _BOX), "m.parts")
    rest = rows.join(mixed, page, "left_anti").select(page, order, "text", *_BOX, F.lit(1).alias("parts"))
    return folded.unionByName(rest)
