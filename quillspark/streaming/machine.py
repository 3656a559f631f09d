"""The task queue as a stateful stream: states, refused steps, and polls with
back-off (X1, X2, X4).

Each task has a state of its own in Spark's state store. An event that may
follow the state so far is taken, any other is refused. A task that is queued
or processing is asked for again when nothing was heard for a while, then after twice
that time, and so on: an event-time timer wakes it as the watermark passes.
Polls that an event's own time has passed count before the event, so the
counts don't depend on how the events are cut into batches.

Checkpoint and results lie in the shared folder. A run that was ended goes on
where its checkpoint says, and the file sink drops what was written twice.

Events come in the order of their times, batch by batch (within a batch they
are sorted). One at or before the last that was handled is late or repeated:
it is refused. Rows without a task or a time are left out; a null status is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.settings import NEXT
from ..sources.shared import new_folder

ACTIVE = ("queued", "processing")
_STATE = "status string, refused long, polls long, asked long, version long, at long, seq long"
_OUT = "id long, version long, status string, refused long, polls long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def polls_until(wait: int, at: int, until: int) -> int:
    """How often a task that was heard at ``at`` has been asked by ``until``:
    after wait, 3 * wait, 7 * wait and so on."""
    return max(0, ((until - at) // wait + 1).bit_length() - 1) if until >= at else 0


class TaskMachine(StatefulProcessor):
    """Times are milliseconds; ``seq`` orders events of one time."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("task", _STATE)

    def _ask(self, status: str, polls: int, asked: int, at: int, until: int) -> tuple[int, int]:
        """(polls, asked) with what is due by ``until``."""
        now = polls_until(self.wait, at, until) if status in ACTIVE else asked
        return polls + max(0, now - asked), max(now, asked)

    def _wake(self, status: str, asked: int, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status in ACTIVE:
            self.handle.registerTimer(at + self.wait * ((2 << asked) - 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, refused, polls, asked, version, at, seq = self.state.get() if self.state.exists() else ("", 0, 0, 0, 0, -1, -1)
        batch = pd.concat(list(rows)).sort_values(["at", "seq"])
        for t, n, step in zip(batch["at"].tolist(), batch["seq"].tolist(), batch["status"].tolist()):
            if (t, n) <= (at, seq):
                refused += 1
                continue
            polls, _ = self._ask(status, polls, asked, at, t)
            asked, at, seq = 0, t, n
            if step in NEXT[status]:
                status = step
            else:
                refused += 1
        self._wake(status, asked, at)
        yield self._told(key, (status, refused, polls, asked, version + 1, at, seq))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, refused, polls, asked, version, at, seq = self.state.get()
        polls, asked = self._ask(status, polls, asked, at, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        self._wake(status, asked, at)
        yield self._told(key, (status, refused, polls, asked, version + 1, at, seq))

    def _told(self, key, state: tuple) -> pd.DataFrame:
        self.state.update(state)
        return pd.DataFrame({"id": [key[0]], "version": [state[4]], "status": [state[0]], "refused": [state[1]], "polls": [state[2]]})

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession):
    """State with timers needs this store; the session's own comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def states(events: DataFrame, wait: int, late: str) -> DataFrame:
    """The stream (id, version, status, refused, polls) of a stream (id, ts,
    seq, status). A task's row of greatest version has its state."""
    own = events.where("id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = own.select("id", "ts", F.unix_millis("ts").alias("at"), F.col("seq").cast("long").alias("seq"), "status")
    return rows.groupBy("id").transformWithStateInPandas(TaskMachine(wait), _OUT, "Append", "EventTime")


def started(events: DataFrame, wait: int, late: str, out: str, checkpoint: str) -> StreamingQuery:
    """Handle what there is now, from where ``checkpoint`` stands."""
    with _rocks(events.sparkSession):
        return states(events, wait, late).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """(id, status, refused, polls) as of now."""
    rows = spark.read.schema(_OUT).parquet(out)
    return rows.groupBy("id").agg(F.max(F.struct("version", "status", "refused", "polls")).alias("x")).select("id", "x.status", "x.refused", "x.polls")


def task_run(spark: SparkSession, events: DataFrame, wait: int, late: str) -> DataFrame:
    """One run over a stream of events, to its end."""
    out, checkpoint = new_folder(spark, "tasks"), new_folder(spark, "tasks-checkpoint")
    started(events, wait, late, out, checkpoint).awaitTermination()
    return latest(spark, out)


def from_events(events: DataFrame) -> DataFrame:
    """The driver's events as steps of a task a user."""
    kinds = {"signup": "queued", "purchase": "completed", "error": "failed"}
    status = F.lit("processing")
    for kind, to in kinds.items():
        status = F.when(F.col("event_type") == kind, to).otherwise(status)
    return events.select(F.col("user_id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), status.alias("status"))
