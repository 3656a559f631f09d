"""Plug-in stages. Five interfaces; a registry keeps one engine
per worker process; capabilities choose the plan; all engines of a pipeline are
injected. The engines here are stubs with fixed rules, marked as such in their
output: none recognises or translates anything. Connectors have their request
and reply formats here and get their transport from outside (there is no
network)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import english_word_count


@dataclass(frozen=True)
class Capabilities:
    """What an engine can do besides its interface."""

    detects: bool = False
    routes_languages: bool = False
    batch: bool = True
    takes_glossary: bool = False


class Detector(Protocol):
    capabilities: Capabilities

    def detect(self, image: bytes) -> list[dict[str, Any]]:
        """Regions of an image."""


class Recogniser(Protocol):
    capabilities: Capabilities

    def recognise(self, image: bytes, regions: list[dict[str, Any]], language: str) -> list[dict[str, Any]]:
        """The regions with texts; one that detects may be given none."""


class Translator(Protocol):
    capabilities: Capabilities

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str]:
        """As many texts as were given; an empty one says that this engine failed."""


class Inpainter(Protocol):
    capabilities: Capabilities

    def inpaint(self, image: bytes, regions: list[dict[str, Any]]) -> bytes: ...


class Renderer(Protocol):
    capabilities: Capabilities

    def render(self, image: bytes, regions: list[dict[str, Any]], language: str) -> bytes: ...


class Echo:
    """A stub that marks each text with the target language."""

    capabilities = Capabilities()

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str]:
        return [f"[{target}] {t}" if t.strip() else "" for t in texts]


class Silent:
    """A stub that always fails."""

    capabilities = Capabilities()

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str]:
        return [""] * len(texts)


class FixedRegion:
    """A stub that finds one region, reads a fixed text and draws nothing."""

    capabilities = Capabilities(detects=True)

    def detect(self, image: bytes) -> list[dict[str, Any]]:
        return [{"box": (0, 0, 10, 10), "text": ""}] if image else []

    def recognise(self, image: bytes, regions: list[dict[str, Any]], language: str) -> list[dict[str, Any]]:
        return [{**r, "text": f"stub-{i}", "lang": language} for i, r in enumerate(regions or self.detect(image))]

    def inpaint(self, image: bytes, regions: list[dict[str, Any]]) -> bytes:
        return image

    def render(self, image: bytes, regions: list[dict[str, Any]], language: str) -> bytes:
        return image + b"".join(r.get("translated", "").encode() for r in regions)


#: A request's transport: (address, headers, body) to the reply's text.
Transport = Callable[[str, dict[str, str], str], str]


@dataclass
class Connector:
    """A translation service as data: how a request is written and a reply
    read. A reply that can't be read, or has too few texts, counts as failed."""

    write: Callable[[list[str], str, str], tuple[str, dict[str, str], str]]
    read: Callable[[str], list[str]]
    transport: Transport
    at_once: int = 1
    capabilities: Capabilities = field(default_factory=Capabilities)

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str]:
        out: list[str] = []
        for a in range(0, len(texts), self.at_once):
            part = texts[a : a + self.at_once]
            try:
                got = self.read(self.transport(*self.write(part, source, target)))
            except (ValueError, KeyError, IndexError, TypeError, OSError):
                got = []
            out += [*got, *[""] * len(part)][: len(part)]
        return out


def json_connector(address: str, transport: Transport, key: str = "", at_once: int = 50) -> Connector:
    """A service that takes {"text": [...], "source_lang", "target_lang"} and
    answers {"translations": [{"text"}]}."""
    head = {"Content-Type": "application/json"} | ({"Authorization": key} if key else {})
    write = lambda texts, s, t: (address, head, json.dumps({"text": texts, "source_lang": s, "target_lang": t}, ensure_ascii=False))
    return Connector(write, lambda reply: [x["text"] for x in json.loads(reply)["translations"]], transport, at_once)


def numbered_connector(address: str, transport: Transport, prompt: str, parse: Callable[[str, int], list[str] | None]) -> Connector:
    """A chat service: texts as numbered segments, the reply parsed strictly."""
    asked: list[int] = [0]

    def write(texts: list[str], s: str, t: str) -> tuple[str, dict[str, str], str]:
        asked[0] = len(texts)
        body = "\n".join(f"<{i}>{x}</{i}>" for i, x in enumerate(texts, 1))
        return address, {}, json.dumps({"messages": [{"role": "system", "content": f"{prompt} {s} {t}"}, {"role": "user", "content": body}]}, ensure_ascii=False)

    return Connector(write, lambda reply: parse(json.loads(reply)["choices"][0]["message"]["content"], asked[0]) or [], transport, 24)


ENGINES: dict[str, Callable[[], Any]] = {"echo": Echo, "silent": Silent, "fixed": FixedRegion}


def register(name: str, make: Callable[[], Any]) -> None:
    """Y2: an engine by name. A name that is taken is an error. Workers import
    the module that registers."""
    if name in ENGINES:
        raise ValueError(f"engine {name} is there already")
    ENGINES[name] = make


def register_function(spark: SparkSession, name: str, function: Callable, kind: str | None = None) -> None:
    """A user's function, for SQL: with a return type a function of pandas
    series (with an aggregate's signature, an aggregate); without one, a table
    function (made by ``udtf``)."""
    if kind is None:
        spark.udtf.register(name, function)
    else:
        spark.udf.register(name, F.pandas_udf(function, kind))


@lru_cache
def engine(name: str) -> Any:
    return ENGINES[name]()


def chosen(wanted: list[str], available: set[str]) -> list[str]:
    """The configured engines that exist, in order."""
    return [w for w in wanted if w in available]


def with_fallback(wanted: str, ladder: dict[str, list[str]], works: Callable[[str], bool]) -> str:
    """The engine asked for, or the first below it that works."""
    return next((n for n in [wanted, *ladder.get(wanted, [])] if works(n)), ladder.get("", [""])[-1])


@dataclass
class Remembered:
    """Which backend last worked for each direction. One that echoes a
    whole batch is forgotten."""

    probe: Callable[[str, str, str], bool]
    chain: list[str]
    known: dict[tuple[str, str], str] = field(default_factory=dict)

    def backend(self, source: str, target: str) -> str | None:
        at = (source, target)
        if at not in self.known:
            found = next((n for n in self.chain if self.probe(n, source, target)), None)
            if found is not None:
                self.known[at] = found
        return self.known.get(at)

    def seen(self, source: str, target: str, texts: list[str], results: list[str]) -> None:
        if texts and all(a == b for a, b in zip(texts, results)):
            self.known.pop((source, target), None)


@dataclass(frozen=True)
class Stages:
    """The engines of a pipeline, by name, all given from outside. ``plan``
    leaves the detector out where the recogniser detects."""

    recogniser: str
    translator: list[str]
    inpainter: str
    renderer: str
    detector: str = ""

    def plan(self) -> list[str]:
        detects = engine(self.recogniser).capabilities.detects
        return [*([] if detects or not self.detector else ["detect"]), "recognise", "inpaint", "translate", "render"]

    def run(self, pages: DataFrame, source: str, target: str) -> DataFrame:
        """(page_id, n_regions, result, error) of pages (page_id, content). A
        page's failure is its own row's error (X2, M17), never the job's."""
        plan = self.plan()

        def one(content: bytes) -> tuple[int, bytes]:
            regions = engine(self.detector).detect(content) if "detect" in plan else []
            regions = engine(self.recogniser).recognise(content, regions, source)
            clean = engine(self.inpainter).inpaint(content, regions)
            texts = [r["text"] for r in regions]
            for name in self.translator:
                todo = [i for i, r in enumerate(regions) if not r.get("translated")]
                for i, t in zip(todo, engine(name).translate_batch([texts[i] for i in todo], source, target)):
                    regions[i]["translated"] = t
            return len(regions), engine(self.renderer).render(clean, regions, target)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for page, content in b.itertuples(index=False, name=None):
                    try:
                        rows.append((page, *one(bytes(content)), None))
                    except Exception as problem:  # one page's
                        rows.append((page, 0, None, f"{type(problem).__name__}: {problem}"[:300]))
                yield pd.DataFrame(rows, columns=["page_id", "n_regions", "result", "error"])

        return pages.select("page_id", "content").mapInPandas(run, "page_id long, n_regions int, result binary, error string")


def rescued(first: DataFrame, second: DataFrame) -> DataFrame:
    """Texts of a first recogniser, and a second one's where the first's
    is blank (id, text, engine)."""
    empty = F.trim(F.coalesce(F.col("f.text"), F.lit(""))) == ""
    both = first.alias("f").join(second.alias("s"), F.col("f.id") == F.col("s.id"), "left")
    return both.select(F.col("f.id").alias("id"), F.when(empty, F.col("s.text")).otherwise(F.col("f.text")).alias("text"), F.when(empty, F.lit("second")).otherwise(F.lit("first")).alias("engine"))


def empty_only(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows without text."""
    return rows.where(F.trim(F.coalesce(F.col(text), F.lit(""))) == "")


def accept_split(left: Column, right: Column, left_conf: Column, right_conf: Column) -> Column:
    """Both halves have two words or more and a confidence of 0.45."""
    return (english_word_count(left) >= 2) & (english_word_count(right) >= 2) & (F.least(left_conf, right_conf) >= 0.45)


def translated(rows: DataFrame, chain: list[str], target: str = "zh") -> DataFrame:
    """Id, text, result, backend. Equal texts go to an engine once; what
    one engine leaves empty goes to the next; a blank text is kept; in the end the text itself stands."""
    distinct = rows.select("text").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].fillna("").tolist()
            out, names = [""] * len(texts), ["keep" if not t.strip() else "original" for t in texts]
            for name in chain:
                todo = [i for i, t in enumerate(texts) if t.strip() and not out[i]]
                for i, r in zip(todo, engine(name).translate_batch([texts[i] for i in todo], "auto", target)):
                    if r:
                        out[i], names[i] = r, name
            yield pd.DataFrame({"text": b["text"], "result": [o or t for o, t in zip(out, texts)], "backend": names})

    results = distinct.mapInPandas(run, "text string, result string, backend string")
    return rows.join(results.withColumnRenamed("text", "t"), F.col("text").eqNullSafe(F.col("t")), "left").drop("t")
