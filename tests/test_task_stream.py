"""The task machine: batches, restarts and failures don't change its answer."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.sources.settings import NEXT
from quillspark.sources.shared import new_folder
from quillspark.streaming import machine

WAIT = 60_000
SCHEMA = "id long, ts timestamp, seq long, status string"


def brute(rows, watermark):
    """(status, refused, polls) of each task, a step at a time."""
    out = {}
    for i in {r[0] for r in rows if r[0] is not None}:
        status, refused, polls, last = "", 0, 0, None
        for t, _, step in sorted((t, n, s or "") for k, t, n, s in rows if k == i):
            if status in ("queued", "processing"):
                polls += asked(last, t)
            last = t
            if step in NEXT[status]:
                status = step
            else:
                refused += 1
        if status in ("queued", "processing"):
            polls += asked(last, watermark)
        out[i] = (status, refused, polls)
    return out


def asked(at, until):
    n, due, step = 0, at + WAIT, WAIT
    while due <= until:
        n, step = n + 1, 2 * step
        due += step
    return n


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [(r.randrange(40), r.randrange(1_700_000_000_000, 1_700_020_000_000), n, r.choice(["queued", "processing", "processing", "completed", "failed", "odd", None])) for n in range(600)]
    return sorted(out, key=lambda x: x[1]) + [(None, 1_700_000_000_000, 900, "queued")]


@pytest.fixture()
def folder(spark, rows):
    """The events in six files, in the order of their times."""
    path = new_folder(spark, "events")
    size = len(rows) // 6 + 1
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], "id long, ms long, seq long, status string").select("id", F.timestamp_millis("ms").alias("ts"), "seq", "status").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder, files):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def got(spark, out):
    return {r.id: (r.status, r.refused, r.polls) for r in machine.latest(spark, out).collect()}


@pytest.mark.parametrize("files", [1, 100])
def test_batches_make_no_difference(spark, folder, rows, files):
    out = new_folder(spark, "out")
    machine.started(stream(spark, folder, files), WAIT, "10 minutes", out, new_folder(spark, "cp")).awaitTermination()
    assert got(spark, out) == brute(rows, max(r[1] for r in rows) - 600_000)


def test_goes_on_after_a_failure(spark, folder, rows, monkeypatch):
    """The first run dies in the middle of a batch, the second is stopped by
    hand, the third ends; state and files are as if there had been one."""
    out, checkpoint = new_folder(spark, "out"), new_folder(spark, "cp")

    class Dies(machine.TaskMachine):
        def handleInputRows(self, key, rows, timerValues):
            batch = pd.concat(list(rows))
            if key[0] == 7 and batch["seq"].size and timerValues.getCurrentWatermarkInMs() > 1_700_003_000_000:
                raise RuntimeError("a lost executor")
            yield from super().handleInputRows(key, iter([batch]), timerValues)

    monkeypatch.setattr(machine, "TaskMachine", Dies)
    with pytest.raises(Exception, match="lost executor"):
        machine.started(stream(spark, folder, 1), WAIT, "10 minutes", out, checkpoint).awaitTermination()
    assert got(spark, out) and got(spark, out) != brute(rows, max(r[1] for r in rows) - 600_000)
    monkeypatch.undo()
    machine.started(stream(spark, folder, 1), WAIT, "10 minutes", out, checkpoint).stop()
    machine.started(stream(spark, folder, 1), WAIT, "10 minutes", out, checkpoint).awaitTermination()
    assert got(spark, out) == brute(rows, max(r[1] for r in rows) - 600_000)
    versions = spark.read.schema(machine._OUT).parquet(out)
    assert versions.groupBy("id", "version").count().where("count > 1").count() == 0


def test_late_and_repeated_events_are_refused(spark):
    path, out = new_folder(spark, "late"), new_folder(spark, "out")
    for batch in ([(1, 10_000, 1, "queued"), (1, 20_000, 2, "processing")], [(1, 15_000, 3, "failed"), (1, 20_000, 2, "processing"), (1, 30_000, 4, "completed")]):
        spark.createDataFrame(batch, "id long, ms long, seq long, status string").select("id", F.timestamp_millis("ms").alias("ts"), "seq", "status").coalesce(1).write.mode("append").parquet(path)
    machine.started(stream(spark, path, 1), WAIT, "1 hour", out, new_folder(spark, "cp")).awaitTermination()
    assert got(spark, out) == {1: ("completed", 2, 0)}


def test_polls_double():
    assert [machine.polls_until(10, 100, t) for t in (90, 100, 109, 110, 129, 130, 169, 170, 250)] == [0, 0, 0, 1, 1, 2, 2, 3, 4]
