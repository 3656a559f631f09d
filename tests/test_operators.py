import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import segments
from quillspark.operators import engines, greedy, pixels
from quillspark.sources import imports


def test_boxes_on_one_row_merge():
    assert greedy.merged_boxes([(0, 0, 10, 10), (30, 2, 40, 12), (200, 0, 210, 10), (0, 100, 10, 110)]) == [(0, 0, 40, 12), (200, 0, 210, 10), (0, 100, 10, 110)]


def test_suppression_keeps_the_best_of_overlapping():
    rows = [(1, (0, 0, 10, 10), 5), (2, (1, 1, 11, 11), 9), (3, (50, 50, 60, 60), 1)]
    assert greedy.suppressed(rows) == [2, 3]


def test_each_target_is_taken_once():
    assert greedy.assigned([(0, 0, 2, 2), (1, 1, 3, 3), (9, 9, 10, 10)], [(0, 0, 2, 2), (20, 20, 22, 22)]) == [0, 1, None]


def test_lines_of_two_balloons_are_two_groups():
    left = [((10, 10 + 12 * i, 90, 24 + 12 * i), "h") for i in range(2)]
    right = [((300, 200 + 12 * i, 380, 214 + 12 * i), "h") for i in range(2)]
    groups = greedy.grouped([*left, *right])
    assert groups[0] == groups[1] != groups[2] == groups[3]


def test_chunks_by_length_and_number(spark):
    rows = [("a", 1, "x" * 3000), ("a", 2, "x" * 3000), ("a", 3, "x")] + [("b", i, "y") for i in range(25)]
    got = {(r.grp, r.ord): r.chunk for r in greedy.pack_chunks(spark.createDataFrame(rows, "grp string, ord long, text string")).collect()}
    assert [got["a", i] for i in (1, 2, 3)] == [0, 1, 1]
    assert got["b", 23] == 0 and got["b", 24] == 1


def test_segments_must_be_complete(spark):
    rows = spark.createDataFrame([("<1>a</1>\n<2>b</2>", 2), ("<2>b</2><1>a</1>", 2), ("<1>a</1>", 2), ("<1>a</1><1>b</1>", 2), ("<1>a</1><2>b</2><3>c</3>", 2)], "c string, n int")
    got = [r.t for r in rows.select(segments.parsed(F.col("c"), F.col("n")).alias("t")).collect()]
    assert got == [["a", "b"], ["a", "b"], None, None, None]


def test_import_reports_errors_by_row(spark):
    docs = spark.createDataFrame([("d", '[{"source":"a","target":"b"},3,{"source":" "}]'), ("x", "no")], "doc string, content string")
    assert sorted((r.doc, r.pos, r.error) for r in imports.import_rows(docs).collect() if r.error) == [("d", 2, "not an object"), ("d", 3, "missing source or target"), ("x", 0, "not JSON")]


def test_chain_goes_on_where_an_engine_is_silent(spark):
    rows = spark.createDataFrame([(1, "hello"), (2, " "), (3, "hello"), (4, None)], "id int, text string")
    got = {r.id: (r.result, r.backend) for r in engines.translated(rows, ["silent", "echo"]).collect()}
    assert got[1] == got[3] == ("[zh] hello", "echo") and got[2][1] == "keep" and got[4][1] == "keep"
    assert engines.chosen(["a", "echo"], set(engines.ENGINES)) == ["echo"]


def test_migration_adds_columns(spark):
    assert imports.migrated(spark.createDataFrame([(1, "a")], "id int, source string")).columns == [f.name for f in imports.TERM_SCHEMA]


def test_flood_stops_at_an_edge():
    g = np.full((20, 20), 255, np.uint8)
    g[:, 10] = 0
    assert pixels.flood(g, (2, 2)).sum() == 200


def test_crops_join_near_blobs():
    m = np.zeros((300, 400), bool)
    m[20:30, 20:30] = m[20:30, 38:44] = m[250:260, 350:360] = True
    assert pixels.crops(m) == [(0, 0, 84, 70), (310, 210, 400, 300)]


def test_ink_runs_barriers_and_fills():
    g = np.full((60, 260), 255, np.uint8)
    g[:, 10:60] = g[:, 100:150] = 0
    assert pixels.ink_runs(g) == [(10, 60), (100, 150)]
    line = np.full((40, 40), 255, np.uint8)
    line[20:22, :] = 0
    assert pixels.barrier(line, False) and not pixels.barrier(np.full((40, 40), 255, np.uint8), False)
    filled = pixels.filled_rows(g, g < 128)
    assert filled.min() == 255
    assert pixels.top_colours(np.array([[0, 0, 0, 200, 200, 100]], np.uint8), 2)[0] < 10
    assert pixels.density(np.zeros((2, 2))) == 0.95 and pixels.mask_overlap(g < 128, g < 128) == 1 and pixels.coverage(g < 128, (10, 0, 60, 60)) == 1
