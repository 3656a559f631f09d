"""normalising recognised text, and strict numbered segments. Both need
lookaround or back-references, which the Java engine has and RE2 hasn't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HAN = "㐀-鿿"


def normalized(text: Column, lang: Column) -> Column:
    """No-break spaces and runs of blanks become one blank; curly quotes become straight in
    English; blanks between Han characters go in Chinese."""
    base = F.trim(F.regexp_replace(F.translate(text, " 　", "  "), r"\s+", " "))
    english = F.translate(base, "‘’“”", "''\"\"")
    chinese = F.regexp_replace(base, f"(?<=[{_HAN}]) (?=[{_HAN}])", "")
    return F.when(lang == "en", english).when(lang == "zh", chinese).otherwise(base)


def numbered(texts: Column) -> Column:
    """Array of texts as <1>…</1> segments."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("<"), (i + 1).cast("string"), F.lit(">"), t, F.lit("</"), (i + 1).cast("string"), F.lit(">"))), "\n")


def parsed(content: Column, n: Column) -> Column:
    """The texts of segments 1 to n in order; null unless each number stands there once."""
    pattern = r"<(\d+)>\s*([\s\S]*?)\s*</\1>"
    numbers = F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    bodies = F.regexp_extract_all(content, F.lit(pattern), F.lit(2))
    complete = (F.size(numbers) == n) & (F.array_sort(numbers) == F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    rows = F.array_sort(F.arrays_zip(numbers.alias("i"), bodies.alias("t")))
    return F.when(complete, F.transform(rows, lambda r: r["t"]))
