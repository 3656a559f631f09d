"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from quillspark.plans import catalog
from quillspark.sources.frames import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


EVERY, EVERY_SQL = catalog.QUERIES | catalog.CASES, catalog.ORACLE_SQL | catalog.CASES_SQL


@pytest.mark.parametrize("name", sorted(EVERY_SQL))
def test_same_as_sql(spark, duck, name):
    got, want = EVERY[name](spark, DATA).toPandas(), duck.execute(EVERY_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(EVERY) - set(EVERY_SQL)))
def test_runs(spark, duck, name):
    assert EVERY[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name,rows_of", [
    ("q_latin_label_docs", "SELECT count(*) FROM documents"), ("q_ocr_garbage_docs", "SELECT count(*) FROM documents"),
    ("q_numbers_diff_docs", "SELECT count(*) FROM documents"), ("q_units_docs", "SELECT count(*) FROM documents"),
    ("q_safe_names_pages", "SELECT count(*) FROM pages"), ("q_natural_sort_pages", "SELECT count(*) FROM pages"), ("q_ext_filter_pages", "SELECT count(*) FROM pages"),
    ("q_hex_color_pages", "SELECT count(*) FROM pages"), ("q_batch_status_all", "SELECT 3 * count(*) FROM events"), ("q_poll_merge_all", "SELECT count(*) FROM events"), ("q_first_backend_turns", "SELECT count(DISTINCT conv_id) FROM conversations"),
])
def test_covers_its_whole_table(spark, duck, name, rows_of):
    assert catalog.QUERIES[name](spark, DATA).count() == duck.execute(rows_of).fetchone()[0]


def test_all_tasks_are_asked_for(spark, duck):
    ids = sorted(x for x, in duck.execute("SELECT event_id FROM events").fetchall())
    got = catalog.QUERIES["q_batch_status_all"](spark, DATA).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 3 * len(ids) + 1))
    assert [r.id for r in got] == [*ids, *(i + 100000000000 for i in ids), *ids]
    assert [r.error for r in got] == [None] * len(ids) + ["task not found"] * len(ids) + [None] * len(ids)


def test_every_registered_query_reads_a_table():
    """Constant relations are cases, not queries."""
    assert len(catalog.CASES) > 30 and not set(catalog.CASES) & set(catalog.QUERIES) and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
