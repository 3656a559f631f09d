"""All registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality, scripts, segments, text
from ..operators import engines, glossary, greedy, numbering, quads, regions, replacing, tasks, terms
from ..relation import Relation
from ..sources import imports, settings
from ..sources.frames import ansi_sources, frame, tables_of
from ..streaming import queue
from . import geometry, logs, oracles, routing, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries over short constant relations, or through stand-ins, with their SQL:
#: the tests run them; they aren't registered.
CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CASES_SQL: dict[str, str] = {}


def _query(relation: Relation, inputs: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return relation(spark, **{name: frame(spark, sf_dir, inputs.get(name, name)) for name in relation.frames})

    run.__doc__ = f"Covers {relation.ids}."
    return run


def _register(queries: dict) -> None:
    sources = ansi_sources()
    for name, entry in queries.items():
        relation, inputs = entry if isinstance(entry, tuple) else (entry, {})
        made = set().union(*(tables_of(inputs.get(f, f)) for f in relation.frames))
        # what reads no table is a case for the tests
        queries_, sql = (QUERIES, ORACLE_SQL) if made else (CASES, CASES_SQL)
        queries_[name] = _query(relation, inputs)
        sql[name] = relation.ansi({**sources, **{to: sources[of] for to, of in inputs.items() if of in sources}})


for _module in (regions, scripts, text, tasks, glossary):
    _register(_module.QUERIES)


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(frame(spark, sf_dir, name))


def _segments(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("texts"))
    parsed = segments.parsed(segments.numbered(F.col("texts")), F.size("texts"))
    return grouped.select("grp", F.size("texts").alias("n"), F.coalesce(F.size(parsed), F.lit(-1)).alias("n_parsed"))


#: Order-dependent passes, strict parsing and streams: SQL can't state them (or
#: RE2 lacks the pattern), so unit tests hold them to worked cases.
QUERIES |= {
    "q_merge_boxes": _over("regions", greedy.merge_boxes),
    "q_assign_detections": _over("regions", lambda r: greedy.assign_detections(r).withColumn("target", F.coalesce("target", F.lit(-1)))),
    "q_group_regions": _over("regions", greedy.group_regions),
    "q_chunk_pack": _over("lines", greedy.pack_chunks),
    "q_json_import_rows": _over("imports", imports.import_rows),
    "q_json_import_errors": _over("imports", imports.import_report),
    "q_segment_parse": _over("lines", _segments),
    "q_ocr_normalize": _over("samples", lambda rows: rows.select("id", segments.normalized(F.col("text"), F.lit("zh")).alias("text"))),
    "q_translate_chain": _over("lines", lambda rows: engines.translated(rows.select("grp", "ord", "text"), ["silent", "echo"])),
    "q_stream_windows": lambda spark, sf_dir: queue.event_windows(spark, sf_dir),
}

ORACLE_SQL["q_json_import_errors"] = "SELECT * FROM (VALUES ('ok', 2::BIGINT, 0::BIGINT, 0::BIGINT), ('bad', 0, 0, 1), ('object', 0, 0, 1), ('mixed', 1, 1, 3), ('empty', 0, 0, 0)) AS t(doc, imported, skipped, errors)"
ORACLE_SQL["q_stream_windows"] = "SELECT date_trunc('day', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL"
ORACLE_SQL["q_translate_chain"] = "SELECT conv_id AS grp, turn AS ord, text, CASE WHEN trim(text) = '' THEN text ELSE '[zh] ' || text END AS result, CASE WHEN trim(text) = '' THEN 'keep' ELSE 'echo' END AS backend FROM conversations"


def _ctes(names: tuple[str, ...], query: str) -> str:
    """``query`` with frames of these names."""
    sources = ansi_sources()
    frames = ", ".join(f"{n} AS ({sources[n]})" for n in names)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", query)
    return f"WITH {head[1] or ''}{frames}, {query[head.end() :]}" if head else f"WITH {frames} {query}"


def _hits(texts: str, key: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: terms.term_hits(frame(spark, sf_dir, texts).select(key, "text"), frame(spark, sf_dir, "terms"), key).select(key, F.col("term.id").alias("term"))


def _missing(pairs: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: terms.missing_terms(frame(spark, sf_dir, pairs), frame(spark, sf_dir, "terms"))


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replacing.replaced(frame(spark, sf_dir, "documents"), frame(spark, sf_dir, "terms"), "en", "zh", "doc_id")
    return out.select("doc_id", F.md5("replaced").alias("replaced"))


#: Terms in texts (J5, J6, J7, F3, T2); their SQL is stated apart, in other means.
QUERIES |= {
    "q_term_matches": _hits("documents", "doc_id"),
    "q_term_matches_cjk": _hits("samples", "id"),
    "q_term_missing": _missing("doc_pairs"),
    "q_term_missing_pairs": _missing("pairs"),
    "q_term_replace_literal": _replaced,
    "q_alias_expand": lambda spark, sf_dir: terms.alias_hits(frame(spark, sf_dir, "documents").select("doc_id", "text"), frame(spark, sf_dir, "terms"), "doc_id"),
}
ORACLE_SQL |= {
    "q_term_matches": _ctes(("terms",), terms.MATCHES),
    "q_term_matches_cjk": _ctes(("terms", "samples"), terms.MATCHES_CJK),
    "q_term_missing": _ctes(("terms",), terms.missing_sql("(SELECT d.doc_id AS id, d.text AS source, n.text AS translated, d.lang AS source_lang, 'zh' AS target_lang FROM documents d LEFT JOIN documents n ON d.doc_id + 1 = n.doc_id)")),
    "q_term_missing_pairs": _ctes(("terms", "pairs"), terms.missing_sql("pairs")),
    # the terms of en to zh, the newest of each source, longest first
    "q_term_replace_literal": terms.replaced_sql([("and the", "AND-THE"), ("of the", "OF-THE"), ("thing", "THING"), ("erin", "ERIN"), ("the", "THE-2")], "en"),
    "q_alias_expand": _ctes(("terms",), terms.ALIASES),
}


def _warnings(pairs: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, glossary_terms = frame(spark, sf_dir, pairs), frame(spark, sf_dir, "terms")
        targets = terms.missing_terms(rows, glossary_terms).join(glossary_terms.select(F.col("id").alias("term"), "target"), "term")
        lost = targets.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("term", "target"))), lambda x: x["target"]).alias("terms"))
        return quality.warnings_of(rows, lost).select("id", F.array_join("warnings", "|").alias("warnings"))

    return run


_DOC_PAIRS = "(SELECT d.doc_id AS id, d.text AS source, coalesce(n.text, '') AS translated, d.lang AS source_lang, 'zh' AS target_lang, d.source AS backend FROM documents d LEFT JOIN documents n ON d.doc_id + 1 = n.doc_id)"


def _lost(pairs: str) -> str:
    return terms.missing_sql(pairs).replace("t.id AS term FROM", "t.id AS term, t.target FROM", 1)


def _of(name: str, **columns) -> Callable[[SparkSession, str], DataFrame]:
    """Columns over a frame, each a function of nothing but column names."""
    return lambda spark, sf_dir: frame(spark, sf_dir, name).select(*(f().alias(c) for c, f in columns.items()))


#: Checks, names and bounds (F5, F6, F8, F9, F11, F12, F14, F20); SQL apart.
QUERIES |= {
    "q_quality_all": _warnings("pairs"),
    "q_quality_all_docs": _warnings("doc_pairs"),
    "q_units": _of("pairs", id=lambda: F.col("id"), unit_missing=lambda: quality.units_missing(F.col("source"), F.col("translated"))),
    "q_units_docs": _of("doc_pairs", id=lambda: F.col("id"), unit_missing=lambda: quality.units_missing(F.coalesce("source", F.lit("")), F.col("translated"))),
    "q_entities": _of("documents", doc_id=lambda: F.col("doc_id"), names=lambda: F.array_join(quality.entity_hints(F.coalesce("text", F.lit(""))), "|")),
    "q_mixed_names": _of("samples", id=lambda: F.col("id"), names=lambda: F.array_join(quality.mixed_names(F.coalesce("text", F.lit(""))), "|")),
    "q_bounded_text": _of("documents", doc_id=lambda: F.col("doc_id"), bounded=lambda: F.md5(quality.bounded(F.col("text")))),
    "q_format_bytes": _of("sizes", id=lambda: F.col("id"), size_text=lambda: quality.size_text(F.col("n")), duration_text=lambda: quality.duration_text(F.col("n"))),
    "q_decorated": _of("pairs", id=lambda: F.col("id"), decorated=lambda: quality.decorated(F.col("source"), F.col("translated"))),
}
ORACLE_SQL |= {
    "q_quality_all": _ctes(("terms", "pairs"), oracles.warnings_sql("pairs", _lost("pairs"))),
    "q_quality_all_docs": _ctes(("terms",), oracles.warnings_sql(_DOC_PAIRS, _lost(_DOC_PAIRS))),
    "q_units": _ctes(("pairs",), f"SELECT id, {oracles.units_sql('source', 'translated')} AS unit_missing FROM pairs"),
    "q_units_docs": f"SELECT id, {oracles.units_sql('coalesce(source, chr(32))', 'translated')} AS unit_missing FROM {_DOC_PAIRS}",
    "q_mixed_names": _ctes(("samples",), "SELECT id, array_to_string(list_distinct(regexp_extract_all(coalesce(text, ''), '[ァ-ヶー]{1,8}[㐀-鿿]{1,3}')), '|') AS names FROM samples"),
    "q_entities": oracles.entities_sql(),
    "q_bounded_text": oracles.BOUNDED,
    "q_format_bytes": _ctes(("sizes",), oracles.SIZES),
    "q_decorated": _ctes(("pairs",), oracles.HEARTS),
}


def _task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task a user: its events in the order of their times."""
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("processing")
    return settings.task_states(frame(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("at"), status.alias("status")))


def _files_zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in batches of 100, their html as the files."""
    pages = frame(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 100).alias("batch"), F.col("page_id").alias("idx"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("content"))
    return settings.zip_batches(pages).select("batch", "n_files", "error")


#: Quads, drags, states, files.
QUERIES |= {
    "q_quads": _over("regions", quads.described),
    "q_dragged": _over("regions", lambda r: r.select("page", "ord", settings.dragged(F.col("x0") - 300, F.col("y0") + 200, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1200), F.lit(900)).alias("b")).select("page", "ord", "b.x", "b.y", "b.w", "b.h")),
    "q_task_states": _task_log,
    "q_zip_batches": _files_zipped,
}
ORACLE_SQL |= {
    # upright boxes: the longer side tells the direction, the corners are whole numbers
    "q_quads": _ctes(("regions",), """SELECT page, ord, CASE WHEN x1 - x0 <= y1 - y0 THEN 'v' ELSE 'h' END AS direction, CAST(least(x1 - x0, y1 - y0) AS BIGINT) AS font_size,
  CAST(floor(1000 * ((x1 - x0)::DOUBLE / (y1 - y0))) AS BIGINT) AS aspect, true AS valid FROM regions"""),
    "q_dragged": _ctes(("regions",), """SELECT page, ord, least(greatest(x0 - 300, 18 - w), 1182) AS x, least(greatest(y0 + 200, 18 - h), 882) AS y, w, h FROM (
  SELECT *, CAST(least(greatest(x1 - x0, 28), 1152) AS BIGINT) AS w, CAST(least(greatest(y1 - y0, 28), 864) AS BIGINT) AS h FROM regions) AS r"""),
    "q_zip_batches": "SELECT page_id // 100 AS batch, CAST(sum(CASE WHEN html IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_files, NULL::VARCHAR AS error FROM pages GROUP BY 1",
}

for _part in (geometry, texts, logs, routing):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= {name: _ctes(frames, text) if frames else text for name, (frames, text) in _part.ORACLES.items()}


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars", "source")
    out = numbering.numbered(rows, [F.asc("doc_id")], "idx", ("source",))
    return out.select("doc_id", F.substring("text", 1, 160).alias("preview"), F.bround(F.col("n_chars") / 7 * 10000, 0).cast("long").alias("confidence4"), "lang", F.length("text").alias("n_text"), "idx")


#: Numbers in an order, by ranges (T6, J2, P1); whole tables for rules that had short
#: relations only.
QUERIES |= {
    "q_natural_sort_pages": _over("page_names", numbering.natural_order),
    "q_zip_manifest": lambda spark, sf_dir: numbering.export_names(frame(spark, sf_dir, "files"), frame(spark, sf_dir, "tasks")),
    "q_region_diagnostics": _diagnostics,
    "q_mixed_names_regions": _of("region_texts", id=lambda: F.col("id"), names=lambda: F.array_join(quality.mixed_names(F.col("text")), "|")),
    "q_format_bytes_pages": _of("page_sizes", id=lambda: F.col("id"), size_text=lambda: quality.size_text(F.col("n")), duration_text=lambda: quality.duration_text(F.col("n"))),
    "q_ocr_normalize_regions": _of("region_texts", id=lambda: F.col("id"), text=lambda: segments.normalized(F.col("text"), F.col("fallback"))),
}
ORACLE_SQL |= {
    "q_natural_sort_pages": text.natural_sort.ansi({**ansi_sources(), "names": ansi_sources()["page_names"]}),
    "q_zip_manifest": tasks.manifest.ansi(ansi_sources()),
    "q_region_diagnostics": regions.diagnostics.ansi({}),
    "q_mixed_names_regions": _ctes(("region_texts",), "SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:12], '|') AS names FROM (SELECT id, regexp_extract_all(text, '[ァ-ヶー]{1,8}[㐀-鿿]{1,3}') AS l FROM region_texts) AS r"),
    "q_format_bytes_pages": _ctes(("page_sizes",), oracles.SIZES.replace("FROM sizes", "FROM page_sizes")),
    "q_ocr_normalize_regions": _ctes(("region_texts",), """SELECT id, CASE fallback WHEN 'en' THEN translate(t, '‘’“”', '''''""') WHEN 'zh' THEN regexp_replace(regexp_replace(t, '([㐀-鿿]) ([㐀-鿿])', '\\1\\2', 'g'), '([㐀-鿿]) ([㐀-鿿])', '\\1\\2', 'g') ELSE t END AS text
  FROM (SELECT id, fallback, trim(regexp_replace(translate(text, chr(160) || chr(12288), '  '), '\\s+', ' ', 'g')) AS t FROM region_texts) AS r"""),
}
for _name in ("q_term_matches_cjk", "q_term_missing_pairs", "q_quality_all", "q_units", "q_mixed_names", "q_format_bytes", "q_decorated", "q_json_import_rows", "q_json_import_errors", "q_ocr_normalize", "q_quads", "q_translate_chain"):
    CASES[_name] = QUERIES.pop(_name)
    if _name in ORACLE_SQL:
        CASES_SQL[_name] = ORACLE_SQL.pop(_name)

#: Passes over ordered rows, one row of each group at a time.
ORACLE_SQL |= {
    "q_segment_parse": "SELECT conv_id AS grp, CAST(count(*) AS INT) AS n, CAST(count(*) AS INT) AS n_parsed FROM conversations GROUP BY conv_id",
    "q_chunk_pack": """WITH RECURSIVE r AS (SELECT conv_id AS grp, turn AS ord, length(text) + 16 AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
s AS (SELECT grp, ord, i, 0 AS chunk, 1 AS items, cost AS chars FROM r WHERE i = 1
  UNION ALL SELECT r.grp, r.ord, r.i, s.chunk + CASE WHEN s.items >= 24 OR s.chars + r.cost > 6000 THEN 1 ELSE 0 END, CASE WHEN s.items >= 24 OR s.chars + r.cost > 6000 THEN 1 ELSE s.items + 1 END, CASE WHEN s.items >= 24 OR s.chars + r.cost > 6000 THEN r.cost ELSE s.chars + r.cost END
  FROM s JOIN r ON r.grp = s.grp AND r.i = s.i + 1)
SELECT grp, ord, chunk FROM s""",
    "q_assign_detections": _ctes(("regions",), """WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ord) AS i FROM regions WHERE direction = 'h'),
t AS (SELECT page, list({'o': ord, 'x': x0 + x1, 'y': y0 + y1} ORDER BY ord) AS t FROM regions WHERE direction = 'v' GROUP BY page),
s AS (SELECT p.page, CAST(0 AS BIGINT) AS i, NULL::INT AS detection, NULL::INT AS target, coalesce(t.t, []) AS free FROM (SELECT DISTINCT page FROM d) AS p LEFT JOIN t ON t.page = p.page
  UNION ALL SELECT page, i, ord, best.o, list_filter(free, lambda z: best IS NULL OR z.o <> best.o) FROM (
    SELECT d.page, d.i, d.ord, s.free, list_min(list_transform(s.free, lambda z: {'d': (d.x0 + d.x1 - z.x) * (d.x0 + d.x1 - z.x) + (d.y0 + d.y1 - z.y) * (d.y0 + d.y1 - z.y), 'o': z.o})) AS best FROM s JOIN d ON d.page = s.page AND d.i = s.i + 1) AS x)
SELECT page, detection, coalesce(target, -1) AS target FROM s WHERE i > 0"""),
}
