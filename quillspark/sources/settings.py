"""Settings (S18), stored client state (S19, K15), ids and times (F25, N7, N8), JSON
of arrays (N4), ZIP files (K12), prompts (F10) and task states (X2)."""

from __future__ import annotations

import io
import json
import os
import time
import zipfile
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Limits and defaults; the environment, then a file of KEY=value lines, may
    set others. A value that isn't of the field's type leaves the default."""

    host: str = "0.0.0.0"
    port: int = 8000
    max_upload_mb: int = 10
    batch_max_files: int = 100
    batch_max_total_mb: int = 500
    default_source_lang: str = "auto"
    default_target_lang: str = "zh"
    translator_backend: str = "google"
    ocr_candidate_fallback_threshold: float = 0.45
    render_padding: float = 0.12
    render_diagnostics: bool = False


def dotenv(text: str) -> dict[str, str]:
    """KEY=value lines; blanks, comments and quotes around values are left out."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, value = line.split("=", 1)
            out[key.strip()] = value.strip().strip("\"'")
    return out


def settings(environment: dict[str, str] | None = None, file_text: str = "") -> Settings:
    given = {k.lower(): v for k, v in {**dotenv(file_text), **(os.environ if environment is None else environment)}.items()}
    own = {}
    for f in fields(Settings):
        if f.name in given:
            kind = type(f.default)
            try:
                own[f.name] = given[f.name].lower() in ("1", "true", "yes", "on") if kind is bool else kind(given[f.name])
            except ValueError:
                pass
    return Settings(**own)


def restored(spark: SparkSession, path: str, most: int = 12) -> DataFrame:
    """Stored batches, the newest ``most`` by ``saved_at``; lines that aren't
    JSON are left out."""
    rows = spark.read.option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.desc("saved_at")).limit(most)


def new_id() -> Column:
    """16 hexadecimal digits at random. Not deterministic: write it before it is used twice."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)


def utc_text(at: Column, iso: bool = False) -> Column:
    """A time as UTC text, or in ISO 8601."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'+00:00'" if iso else "yyyy-MM-dd HH:mm:ss")


class Stopwatch:
    """Whole milliseconds by stage, on a clock that doesn't go back; what the
    stages leave of the total is ``other_ms``."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.began, self.spent = clock, clock(), {}

    @contextmanager
    def stage(self, name: str):
        began = self.clock()
        try:
            yield
        finally:
            self.spent[name] = self.spent.get(name, 0) + round((self.clock() - began) * 1000)

    def report(self) -> dict[str, int]:
        total = round((self.clock() - self.began) * 1000)
        return {**self.spent, "total_ms": total, "other_ms": max(0, total - sum(self.spent.values()))}


def as_json(value) -> str:
    """JSON of values with numpy numbers and arrays."""
    plain = lambda x: x.tolist() if isinstance(x, np.ndarray) else x.item() if isinstance(x, np.generic) else str(x)
    return json.dumps(value, default=plain, ensure_ascii=False)


def zipped(files: Iterable[tuple[str, bytes]], manifest: dict) -> bytes:
    """One batch's files and its manifest. A batch is bounded by the upload
    limits, so it is one task's work: see ``zip_batches``."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
        z.writestr(zipfile.ZipInfo("manifest.json", (1980, 1, 1, 0, 0, 0)), as_json(manifest))
    return out.getvalue()


def zip_batches(files: DataFrame) -> DataFrame:
    """(batch, content, n_files, error) of files (batch, idx, name, content).
    Files without content are named in the manifest's errors; a batch over the
    upload limits isn't gathered: its error says so."""
    limits = Settings()
    size = F.sum(F.coalesce(F.length("content"), F.lit(0)))
    sizes = files.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes"))
    fits = (F.col("n") <= limits.batch_max_files) & (F.col("bytes") <= limits.batch_max_total_mb << 20)

    def pack(key, t):
        t = t.sort_values("idx")
        good = [(n, bytes(c)) for n, c in zip(t["name"], t["content"]) if c is not None]
        errors = [{"name": n, "error": "no result"} for n, c in zip(t["name"], t["content"]) if c is None]
        import pandas as pd

        return pd.DataFrame([(key[0], zipped(good, {"files": [n for n, _ in good], "errors": errors}), len(good), None)], columns=["batch", "content", "n_files", "error"])

    packed = files.join(sizes.where(fits).select("batch"), "batch", "left_semi").groupBy("batch").applyInPandas(pack, f"batch {files.schema['batch'].dataType.simpleString()}, content binary, n_files long, error string")
    over = sizes.where(~fits).select("batch", F.lit(None).cast("binary").alias("content"), F.lit(0).cast("long").alias("n_files"), F.lit("over the limits").alias("error"))
    return packed.unionByName(over)


def prompt(source: Column, target: Column, names: Column, terms: Column) -> Column:
    """instructions for a page, in own words: direction, names that must stay
    the same, and terms (an array of 'source=target')."""
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("Translate numbered lines from "), source, F.lit(" to "), target, F.lit(". Keep the numbering and add nothing.")),
            F.when(F.size(names) > 0, F.concat(F.lit("Give each of these names one form throughout: "), F.array_join(names, ", "), F.lit("."))),
            F.when(F.size(terms) > 0, F.concat(F.lit("Use these terms: "), F.array_join(terms, "; "), F.lit("."))),
        )
    )
    return F.array_join(parts, "\n")


#: Which state may follow which.
NEXT = {"": ("queued",), "queued": ("processing", "failed"), "processing": ("processing", "completed", "failed"), "completed": (), "failed": ()}


def task_states(events: DataFrame) -> DataFrame:
    """(id, status, refused) from an event log (id, at, status): each event that
    may follow the state so far is taken, the others are counted."""
    ordered = events.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "status"))), lambda x: x["status"]).alias("log"))
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, bs in NEXT.items() for b in bs))
    start = F.struct(F.lit("").alias("status"), F.lit(0).alias("refused"))
    step = lambda acc, s: F.when(F.array_contains(pairs, F.concat(acc["status"], F.lit(">"), s)), F.struct(s.alias("status"), acc["refused"].alias("refused"))).otherwise(F.struct(acc["status"].alias("status"), (acc["refused"] + 1).alias("refused")))
    state = F.aggregate("log", start, step)
    return ordered.select("id", state["status"].alias("status"), state["refused"].alias("refused"))


def dragged(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """A box that was dragged or resized: 28 pixels at least, 96 % of the
    page at most, 18 pixels of it on the page."""
    width = F.least(F.greatest(w, F.lit(28)), F.floor(page_w * 96 / 100))
    height = F.least(F.greatest(h, F.lit(28)), F.floor(page_h * 96 / 100))
    return F.struct(
        F.least(F.greatest(x, 18 - width), page_w - 18).alias("x"), F.least(F.greatest(y, 18 - height), page_h - 18).alias("y"),
        width.alias("w"), height.alias("h"),
    )
