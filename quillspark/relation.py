"""Operators stated once, as SQL over named input frames.

``{name}`` stands for an input frame. Where the dialects differ, the text has
``[[Spark form||ANSI form]]``. In Spark the frames are DataFrames of any
origin, and Catalyst plans the statement like any other; the ANSI form is what
the driver's oracle runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: The innermost pair of forms; a form may end in a bracket of its own.
_FORMS = re.compile(r"\[\[((?:(?!\[\[).)*?)\|\|((?:(?!\[\[).)*?)\]\](?!\])", re.S)
_FRAMES = re.compile(r"\{(\w+)\}")


def _form(text: str, which: int) -> str:
    while True:
        text, n = _FORMS.subn(lambda m: m[which], text)
        if not n:
            return text


@dataclass(frozen=True)
class Relation:
    """An operator; ``ids`` names the inventory entries that it covers."""

    ids: str
    text: str

    @property
    def frames(self) -> list[str]:
        return list(dict.fromkeys(_FRAMES.findall(self.text)))

    def __call__(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        text = _form(self.text, 1)
        return spark.sql(text, **{name: frames[name] for name in self.frames})

    def ansi(self, sources: dict[str, str]) -> str:
        """The oracle's text, with ``sources`` (name -> query) as CTEs."""
        text = _form(self.text, 2)
        ctes = ", ".join(f"{n} AS ({sources[n]})" for n in self.frames if n in sources)
        text = _FRAMES.sub(lambda m: m[1], text).strip()
        if not ctes:
            return text
        head = re.match(r"WITH\s+(RECURSIVE\s+)?", text, re.I)
        return f"WITH {head[1] or ''}{ctes}, {text[head.end():]}" if head else f"WITH {ctes} {text}"
