"""Quads, masks, engines and settings on worked cases."""

import json
import math
import zipfile
from io import BytesIO

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import quality
from quillspark.functions.segments import parsed
from quillspark.operators import engines, masks, quads, terms
from quillspark.sources import settings


def test_corners_are_ordered():
    box = np.array([[0, 0], [100, 0], [100, 20], [0, 20]])
    for turn in range(4):
        p, vertical = quads.ordered(np.roll(box, turn, 0))
        assert p.tolist() == box.tolist() and not vertical
    tall = np.array([[0, 0], [20, 0], [20, 100], [0, 100]])
    p, vertical = quads.ordered(tall[[2, 0, 3, 1]])
    assert p.tolist() == tall.tolist() and vertical


def test_quads_and_their_distances():
    q = lambda x, y, w, h, d=None: quads.Quad(np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]]), d)
    a, b, c = q(0, 0, 100, 20, "h"), q(0, 24, 100, 20, "h"), q(400, 0, 20, 100, "v")
    assert (a.font_size, a.aspect, a.valid, a.upright, a.centre.tolist()) == (20, 5, True, True, [50, 10])
    assert quads.between(a, b) == 4 and quads.between(a, q(50, 10, 20, 20)) == 0 and quads.between(a, c) == 300
    assert quads.to_point(a, np.array([103, 24])) == 5 and quads.to_segment(np.array([0.0, 3.0]), np.array([0.0, 0.0]), np.array([0.0, 0.0])) == 3
    assert quads.reading_distance(a, b) == 24 and quads.reading_distance(a, c) == 300
    assert quads.reading_distance(a, q(50, 24, 50, 20, "h")) == 24  # right edges are aligned
    assert quads.may_merge(a, b) and not quads.may_merge(a, c) and not quads.may_merge(a, q(0, 90, 100, 20))
    assert quads.may_merge_coarse(a, b) and not quads.may_merge_coarse(a, c)
    assert quads.area(quads.hull(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]]))) == 4
    wide = quads.unclipped(a.p, 2.0)
    by = 2000 * 2 / 240
    assert np.allclose([*wide.min(0), *wide.max(0)], [-by, -by, 100 + by, 20 + by], atol=1e-9)
    assert quads.colour_distance((10, 20, 30), (10, 20, 30)) == 0 and abs(quads.colour_distance((0, 0, 0), (255, 255, 255)) - 100) < 0.1


def test_masks():
    m = np.zeros((20, 20), np.uint8)
    m[5:10, 5:10] = 255
    assert masks.combined("xor", m, m).max() == 0 and (masks.combined("not", m) == 255 - m).all() and masks.combined("or", m, 255 - m).min() == 255
    assert (masks.grown(m) > 0).sum() == 49 and (masks.shrunk(m) > 0).sum() == 9
    gray = np.where(m > 0, 30, 220).astype(np.uint8)
    assert 30 <= masks.otsu(gray) < 220
    assert masks.nearer(255 - m, m)[1] == 0
    found = masks.candidates(np.stack([gray] * 3, -1), gray, m, [30])
    out = masks.refined(found, masks.grown(m))
    assert ((out > 0) | (m == 0)).all() and (out > 0).sum() < 200
    assert masks.reliable(m > 0, (5, 5, 10, 10), m > 0, 20) and not masks.reliable(m > 0, (0, 0, 20, 20), m > 0, 20) and not masks.reliable(m > 0, (5, 5, 10, 10), m > 0, 2)
    assert masks.in_bubble(gray, (0, 0, 20, 20)) and not masks.in_bubble(gray, (5, 5, 10, 10)) and not masks.in_bubble(gray, (3, 3, 3, 9))
    border = np.zeros((10, 10), np.uint8)
    border[0] = 255
    assert masks.noisy_border(border, 10) and not masks.noisy_border(np.zeros((10, 10)), 10)
    assert masks.best_holder([(0, 0, 4, 4), (50, 50, 51, 51)], [(3, 3, 9, 9), (0, 0, 3, 3)]) == [1, None]
    assert masks.tile_plan(1000, 500) is None and masks.tile_plan(6400, 640) == [0, 1920, 3840]
    tiles = [np.full((4, 2), 1.0, np.float32), np.full((4, 2), 3.0, np.float32)]
    assert masks.stitched(tiles, [0, 2], 6)[:, 0].tolist() == [1, 1, 2, 2, 3, 3]
    flat = np.zeros((60, 60))
    flat[:, 40] = 500
    x0, y0, x1, y1 = masks.grown_box(flat, (20, 20, 35, 40))
    assert x0 < 20 and y0 < 20 and y1 > 40 and x1 <= 40 and masks.grown_box(flat, (5, 5, 5, 9)) is None
    assert masks.first_geometry([lambda: None, lambda: (1, 2, 3, 4)], (0, 0, 9, 9)) == (1, 2, 3, 4) and masks.first_geometry([], (0, 0, 9, 9)) == (0, 0, 9, 9)
    score = np.zeros((40, 60))
    score[10:20, 10:40] = 0.9
    score[30:32, 1:3] = 0.9
    (box, value), = masks.boxes_from_map(score)
    assert abs(value - 0.9) < 1e-9 and box[0] < 10 and box[2] > 40 and box[1] < 10
    page = np.full((30, 40), 250, np.uint8)
    page[10:14, 12:20] = 5
    page[5, 5:35] = 0
    erased = masks.erase_mask(page, (5, 5, 35, 25))
    assert erased[10:14, 12:20].min() == 255 and erased[5, 30] == 0
    assert masks.crop(m, (0, 0, 4, 4)) is None and masks.crop(m, (4, 4, 7, 7)).sum() == 255 * 4
    assert masks.png(page).startswith(b"\x89PNG") and masks.png(np.stack([page] * 3, -1)).endswith(b"IEND\xaeB`\x82")


def test_beam_search_finds_the_best():
    table = {(): [0.6, 0.4, 1e-9], (0,): [0.1, 0.1, 0.8], (1,): [0.02, 0.02, 0.96]}
    p = lambda prefix: np.log(np.array(table.get(prefix, [1e-9, 1e-9, 1.0])) + 1e-12)
    tokens, value = masks.beam_search(p, end=2)
    assert tokens == (0,) and abs(value - math.log(0.6 * 0.8) / 2) < 1e-6


def test_engines(spark):
    pages = spark.createDataFrame([(1, bytearray(b"img")), (2, bytearray(b""))], "page_id long, content binary")
    stages = engines.Stages("fixed", ["silent", "echo"], "fixed", "fixed", "fixed")
    assert stages.plan() == ["recognise", "inpaint", "translate", "render"]
    got = {r.page_id: r for r in stages.run(pages, "ja", "zh").collect()}
    assert bytes(got[1].result) == b"img[zh] stub-0" and got[1].error is None and got[2].n_regions == 0
    broken = engines.Stages("fixed", ["echo"], "echo", "fixed").run(pages, "ja", "zh").collect()
    assert all(r.error.startswith("AttributeError") for r in broken)
    with pytest.raises(ValueError):
        engines.register("echo", engines.Echo)
    assert engines.with_fallback("lama", {"lama": ["cv"]}, {"cv"}.__contains__) == "cv"
    asked = []
    memory = engines.Remembered(lambda n, s, t: asked.append(n) or n == "b", ["a", "b"])
    assert memory.backend("ja", "zh") == memory.backend("ja", "zh") == "b" and asked == ["a", "b"]
    memory.seen("ja", "zh", ["x"], ["x"])
    assert memory.known == {}
    service = engines.json_connector("https://service.invalid", lambda a, h, b: json.dumps({"translations": [{"text": t.upper()} for t in json.loads(b)["text"]]}), at_once=2)
    assert service.translate_batch(["a", "b", "c"], "en", "zh") == ["A", "B", "C"]
    assert engines.json_connector("x", lambda *_: "oops").translate_batch(["a"], "en", "zh") == [""]
    chat = engines.numbered_connector("x", lambda a, h, b: json.dumps({"choices": [{"message": {"content": "<1>q</1><2>r</2>"}}]}), "From", lambda c, n: ["q", "r"] if n == 2 else None)
    assert chat.translate_batch(["a", "b"], "en", "zh") == ["q", "r"] and chat.translate_batch(["a"], "en", "zh") == [""]
    first, second = spark.createDataFrame([(1, "a"), (2, " ")], "id int, text string"), spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string")
    assert sorted(tuple(r) for r in engines.rescued(first, second).collect()) == [(1, "a", "first"), (2, "y", "second")] and engines.empty_only(first).count() == 1
    row = spark.range(1).select(engines.accept_split(F.lit("a b"), F.lit("c d"), F.lit(0.5), F.lit(0.45)).alias("x"), engines.accept_split(F.lit("a"), F.lit("c d"), F.lit(0.5), F.lit(0.9)).alias("y")).first()
    assert (row.x, row.y) == (True, False)


def twice(x: pd.Series) -> pd.Series:
    return 2 * x


def test_functions_can_be_registered(spark):
    engines.register_function(spark, "q_twice", twice, "long")
    assert [r[0] for r in spark.sql("SELECT q_twice(id) FROM range(3)").collect()] == [0, 2, 4]
    from pyspark.sql.functions import udtf

    @udtf(returnType="n int")
    class Upto:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    engines.register_function(spark, "q_upto", Upto)
    assert [r.n for r in spark.sql("SELECT * FROM q_upto(3)").collect()] == [0, 1, 2]


def test_settings_ids_times_and_files(spark, tmp_path):
    s = settings.settings({"PORT": "x", "MAX_UPLOAD_MB": "7"}, "# note\nHOST='h'\nPORT=9\nRENDER_DIAGNOSTICS=true")
    assert (s.host, s.port, s.max_upload_mb, s.render_diagnostics) == ("h", 8000, 7, True)
    (tmp_path / "b.json").write_text("\n".join(json.dumps({"id": i, "saved_at": i}) for i in range(20)) + "\nno json\n")
    assert sorted(r.id for r in settings.restored(spark, str(tmp_path / "b.json")).collect()) == list(range(8, 20))
    ids = [r.i for r in spark.range(50).select(settings.new_id().alias("i")).collect()]
    assert len(set(ids)) == 50 and all(len(i) == 16 and int(i, 16) >= 0 for i in ids)
    at = spark.sql("SELECT timestamp'2024-05-06 07:08:09' AS t")
    assert at.select(settings.utc_text(F.col("t"))).first()[0] == "2024-05-06 07:08:09" and at.select(settings.utc_text(F.col("t"), True)).first()[0] == "2024-05-06T07:08:09+00:00"
    now = iter([0.0, 1.0, 1.5, 4.0])
    watch = settings.Stopwatch(lambda: next(now))
    with watch.stage("ocr_ms"):
        pass
    assert watch.report() == {"ocr_ms": 500, "total_ms": 4000, "other_ms": 3500}
    assert settings.as_json({"a": np.int64(3), "b": np.array([1.5]), "c": "é"}) == '{"a": 3, "b": [1.5], "c": "é"}'
    files = spark.createDataFrame([("x", 2, "b.png", bytearray(b"2")), ("x", 1, "a.png", bytearray(b"1")), ("x", 3, "c.png", None), *(("y", i, str(i), bytearray(b"z")) for i in range(101))], "batch string, idx int, name string, content binary")
    got = {r.batch: r for r in settings.zip_batches(files).collect()}
    assert got["y"].error == "over the limits" and got["x"].n_files == 2
    with zipfile.ZipFile(BytesIO(got["x"].content)) as z:
        assert z.namelist() == ["a.png", "b.png", "manifest.json"] and json.loads(z.read("manifest.json"))["errors"] == [{"name": "c.png", "error": "no result"}]
    log = spark.createDataFrame([(1, 1, "queued"), (1, 2, "processing"), (1, 3, "completed"), (1, 4, "processing"), (2, 1, "completed"), (3, 1, "queued"), (3, 2, "failed")], "id int, at int, status string")
    assert sorted(tuple(r) for r in settings.task_states(log).collect()) == [(1, "completed", 1), (2, "", 1), (3, "failed", 0)]
    box = spark.range(1).select(settings.dragged(*(F.lit(v) for v in (-500, 890, 5, 2000, 1200, 900))).alias("b")).first().b
    assert (box.x, box.y, box.w, box.h) == (-10, 882, 28, 864)
    text = spark.range(1).select(settings.prompt(F.lit("en"), F.lit("zh"), F.array(F.lit("Ann Lee")), F.array().cast("array<string>"))).first()[0]
    assert "Ann Lee" in text and text.count("\n") == 1


def test_terms_keep_their_borders(spark):
    rows = spark.createDataFrame([(1, "Other THE the, then the."), (2, "火影忍者"), (3, "mother's of the the"), (4, None)], "id int, text string")
    table = spark.createDataFrame([(1, "the", "T$1", "en", "zh", False), (2, "of the", "O\\T", "en", "zh", False), (3, "忍者", "N", "ja", "zh", False), (4, "then", "X", "en", "zh", True), (5, "The", "x", "de", "zh", False)], "id int, source string, target string, lang string, target_lang string, disabled boolean")
    assert sorted((r.id, r.term.id) for r in terms.term_hits(rows, table).collect()) == [(1, 1), (2, 3), (3, 1), (3, 2)]
    pairs = terms.mapping(table, "en", "zh")
    assert pairs == [("of the", "O\\T"), ("the", "T$1")]
    for most in (64, 0):
        terms.CHAIN = most
        got = {r.id: r.t for r in rows.select("id", terms.replaced(F.col("text"), pairs, "en").alias("t")).collect()}
        assert got == {1: "Other T$1 T$1, then T$1.", 2: "火影忍者", 3: "mother's O\\T T$1", 4: None}
    terms.CHAIN = 64
    names = spark.createDataFrame([(1, "Ann Lee", "A", "en", "zh", False), (2, "Old Tom", "B", "en", "zh", False), (3, "Tom", "C", "en", "zh", False)], table.schema)
    texts = spark.createDataFrame([(1, "Ann Lee met lee"), (2, "Ann Lee and Old Tom"), (3, "Tom, old Ann")], "id int, text string")
    assert sorted(tuple(r) for r in terms.alias_hits(texts, names).collect()) == [(1, "Lee", "A"), (3, "Ann", "A")]


def test_names_bounds_and_decoration(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    assert one(quality.entity_hints(F.lit("He met JOHN SMITH and Anna Maria Bell; like THE KING, called BIG BOB. Anna  Maria Bell."))) == ["JOHN SMITH", "BIG BOB", "Anna Maria Bell"]
    assert one(quality.mixed_names(F.lit("ナル太郎とナル太郎、サス次"))) == ["ナル太郎", "サス次"]
    assert one(quality.bounded(F.lit("é\r\nb\rc\x00\x07\td"))) == "é\nb\nc\td"
    assert one(quality.bounded(F.lit("x" * 1300))) == "x" * 1199 + "…" and one(quality.bounded(F.lit(None).cast("string"))) == ""
    assert one(quality.decorated(F.lit("a♥♥b♡"), F.lit("□x"))) == "♡x♥♥" and one(quality.decorated(F.lit("♥"), F.lit("a□b□c"))) == "a♥b□c"
    assert one(quality.unwrapped(F.lit("```text\n译文：“你好”\n```"))) == "你好" and one(quality.unwrapped(F.lit(" plain "))) == "plain"
    assert one(quality.units_missing(F.lit("10 kg, 5°F"), F.lit("十公斤"))) and not one(quality.units_missing(F.lit("10 kg and 3 kgs"), F.lit("十公斤")))
    assert one(parsed(F.lit("<1>a</1>"), F.lit(1))) == ["a"]


def test_only_texts_that_nfc_may_change_go_to_python(spark):
    import re
    import unicodedata

    python = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", quality._unsettled()))
    settled = re.compile(quality.SETTLED)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)]):
        unsettled = unicodedata.normalize("NFC", c) != c or unicodedata.combining(c)
        assert python.match(c) or not unsettled
        assert not settled.fullmatch(c) or not python.match(c)
    texts = ["plain", "“café”", "cafe\u0301", "\u1100\u1161\u11a8", "가\u11a8", "か\u3099", "\u2001", "\u212b", "\u0344", "a\u0323\u0307", "a\u0307\u0323", "", None, "漢字カナ가"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", quality.composed(F.col("text")).alias("t"), F.regexp_like(F.regexp_replace("text", quality.SETTLED, ""), F.lit(quality._unsettled())).alias("sent")).collect()
    assert {x.id: x.t for x in got} == {i: None if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
    assert [texts[x.id] for x in got if x.sent] == texts[2:11]
