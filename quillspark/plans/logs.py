"""Queries over event logs: the task stream and the change log. Their SQL
takes one event after the other, by recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes
from ..sources.frames import frame
from ..sources.shared import hadoop, kept
from ..streaming import machine

Query = Callable[[SparkSession, str], DataFrame]
#: A task that is silent for a day is asked for again.
WAIT, LATE_HOURS = 86_400_000, 1


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    fs, at = hadoop(spark, path)
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    # a stream's source is a folder
    return machine.from_events(source.parquet(path) if fs.getFileStatus(at).isDirectory() else source.option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def _task_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine.task_run(spark, _stream(spark, sf_dir), WAIT, f"{LATE_HOURS} hours")


def _fold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    table = frame(spark, sf_dir, "part_terms")
    return table, *changes.folded(table, kept(frame(spark, sf_dir, "part_changes"), "log"), group="grp")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir)[1].withColumn("id", F.coalesce("id", F.lit(-1)))


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _, touched = _fold(spark, sf_dir)
    return changes.applied(table, touched)


QUERIES: dict[str, Query] = {
    "q_task_stream": _task_stream,
    "q_change_outcomes": _outcomes,
    "q_change_table": _table,
}

_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END"
_MAY = "(s.status = '' AND e.status = 'queued' OR s.status = 'queued' AND e.status IN ('processing', 'failed') OR s.status = 'processing' AND e.status IN ('processing', 'completed', 'failed'))"


def _asked(until: str) -> str:
    return f"CASE WHEN s.status IN ('queued', 'processing') AND {until} >= s.at THEN length(bin(({until} - s.at) // {WAIT} + 1)) - 1 ELSE 0 END"


def _states(order: str, columns: str, last: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS i, epoch_ms(ts) AS at, {_STATUS} AS status FROM events),
s AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS i, '' AS status, CAST(0 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS polls, CAST(0 AS BIGINT) AS at FROM e
  UNION ALL SELECT e.id, e.i, CASE WHEN {_MAY} THEN e.status ELSE s.status END, s.refused + CASE WHEN {_MAY} THEN 0 ELSE 1 END, s.polls + {_asked('e.at')}, e.at FROM s JOIN e ON e.id = s.id AND e.i = s.i + 1),
l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i DESC) AS rn FROM s)
SELECT id, status, refused{columns} FROM l AS s {last} WHERE rn = 1"""


_HERE = "x.s = c.source AND x.t = c.target"
_SAME_ROW = "{'rid': x.rid, 's': x.s, 't': x.t, 'note': x.note, 'builtin': x.builtin, 'disabled': %s}"
_NEW_ROW = "{'rid': %s, 's': c.source, 't': c.target, 'note': c.note, 'builtin': false, 'disabled': %s}"
_ROUND = f"""
f AS (
  SELECT grp, CAST(0 AS BIGINT) AS i, list({{'rid': id, 's': source, 't': target, 'note': note, 'builtin': builtin, 'disabled': disabled}}) AS state, NULL::BIGINT AS seq, NULL::VARCHAR AS op, NULL::BIGINT AS id, NULL::VARCHAR AS outcome FROM part_terms GROUP BY grp
  UNION ALL
  SELECT grp, i, CASE outcome WHEN 'inserted' THEN list_append(state, {_NEW_ROW % ('c.seq', 'false')})
      WHEN 'revived' THEN list_transform(state, lambda x: CASE WHEN x.rid = held.rid THEN {_NEW_ROW % ('x.rid', 'false')} ELSE x END)
      WHEN 'updated' THEN list_transform(state, lambda x: CASE WHEN x.rid = own.rid THEN {_NEW_ROW % ('x.rid', 'x.disabled')} ELSE x END)
      WHEN 'disabled' THEN list_transform(state, lambda x: CASE WHEN x.rid = own.rid THEN {_SAME_ROW % 'true'} ELSE x END)
      WHEN 'deleted' THEN list_filter(state, lambda x: x.rid <> own.rid) ELSE state END,
    seq, op, CASE WHEN op <> 'create' THEN id WHEN outcome = 'inserted' THEN seq ELSE held.rid END, outcome
  FROM (SELECT c.*, state, own, held, CASE WHEN op = 'create' THEN CASE WHEN held IS NULL THEN 'inserted' WHEN held.disabled THEN 'revived' ELSE 'rejected' END WHEN own IS NULL THEN 'missing'
      WHEN op = 'update' THEN CASE WHEN held IS NOT NULL AND held.rid <> c.id THEN 'conflict' ELSE 'updated' END WHEN op = 'delete' THEN 'deleted' ELSE 'disabled' END AS outcome
    FROM (SELECT c.*, f.state, list_filter(f.state, lambda x: x.rid = c.id)[1] AS own, list_filter(f.state, lambda x: {_HERE})[1] AS held FROM f JOIN c ON c.grp = f.grp AND c.i = f.i + 1) AS c) AS c)"""
_LOG = "WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY seq) AS i FROM part_changes), " + _ROUND
#: Query -> (frames, SQL).
ORACLES: dict[str, tuple[tuple[str, ...], str]] = {
    "q_task_states": ((), _states("ts, event_id", "", "")),
    "q_task_stream": ((), _states("epoch_ms(ts), event_id", f", polls + {_asked('w')} AS polls", f"CROSS JOIN (SELECT max(epoch_ms(ts)) - {LATE_HOURS * 3_600_000} AS w FROM events) AS m")),
    "q_change_outcomes": (("part_terms", "part_changes"), _LOG + " SELECT seq, op, coalesce(id, -1) AS id, outcome FROM f WHERE i > 0"),
    "q_change_table": (
        ("part_terms", "part_changes"),
        _LOG + """, l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY i DESC) AS rn FROM f)
SELECT x.rid AS id, x.s AS source, x.t AS target, 'en' AS lang, 'zh' AS target_lang, x.note, x.builtin, x.disabled FROM (SELECT unnest(state) AS x FROM l WHERE rn = 1)""",
    ),
}
