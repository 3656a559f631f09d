"""Rules on recognised texts and on a page's regions, by worked cases."""

from pyspark.sql import functions as F

from quillspark.functions import labels
from quillspark.operators import cascade, pages


def column(spark, rows, schema, made):
    return [r[0] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], f"i int, {schema}").orderBy("i").select(made).collect()]


def test_latin_labels(spark):
    rows = [("A1-B2&C3", "ja"), ("A1-B2&C3", "en"), ("abc", "ja"), ("Rock'n 歌歌", "ja"), ("ab cd 歌", "ja"), ("", "ja"), (None, "ja"), ("ab　cd\x1c", "ja"), ("ＡＢＣＤ", "ja")]
    assert column(spark, rows, "text string, lang string", labels.latin_label(F.col("text"), F.col("lang"))) == [True, False, False, True, True, False, False, True, False]


def test_suspicious_japanese(spark):
    rows = [
        ("123", "ja", True), ("123", "ja", False), ("123", "zh", True), ("123かな", "ja", True), ("1か", "ja", True), ("漢1", "ja", True), ("Ωか", "ja", True), ("ͱ", "ja", True),
        ("ab", "ja", True), ("ab かな", "ja", True), ("ab かな 1", "ja", True), ("abc", "ja", True), ("abc 1", "ja", True), ("か", "ja", True), (" ", "ja", True), (None, "ja", None), ("٣", "ja", True),
    ]
    want = [True, False, False, False, True, False, True, True, True, False, True, False, True, False, False, False, True]
    assert column(spark, rows, "text string, lang string, fallback boolean", labels.suspicious_japanese(F.col("text"), F.col("lang"), F.col("fallback"))) == want


def test_misread_japanese(spark):
    rows = [("Hello", 700, "ja"), ("Hello", 699, "ja"), ("abc", 900, "ja"), ("!?", 900, "ja"), ("かな", 100, "ja"), ("漢", 100, "ja"), ("abc", 100, "zh"), ("  ", 100, "ja"), (None, 100, "ja")]
    assert column(spark, rows, "text string, conf long, hint string", labels.misread_japanese(F.col("text"), F.col("conf"), F.col("hint"))) == [False, True, True, True, False, False, False, False, False]


def test_english_words(spark):
    texts = ["I don't know a b", "they're we’ll", "abé éab ab_ 1ab ab", "x'ab", "don'tx1 rock-n-roll", "", None, "a--b a-'b 10's"]
    assert column(spark, [(t,) for t in texts], "text string", F.array_join(labels.english_words(F.col("text")), "|")) == ["don't|know", "they're|we’ll", "ab", "ab", "don|rock|roll", "", "", ""]
    assert column(spark, [(t,) for t in texts], "text string", labels.english_word_count(F.col("text"))) == [5, 2, 5, 1, 2, 0, 0, 5]


def test_names_and_abbreviations(spark):
    lists = [["NASA", "of"], ["Anna", "Berg"], ["Anna", "berg"], ["McDonald", "Anna"], ["USA"], [], ["ab", "cde"], ["don't"]]
    assert column(spark, [(x,) for x in lists], "words array<string>", labels.name_like(F.col("words"))) == [True, True, False, False, True, False, True, False]


def test_region_hints(spark):
    rows = [("", "ja"), ("  ", "zh"), ("1", "zh"), ("a", "ja"), ("これはペンです", "zh"), ("我们", "ja"), ("漢字漢字", "ja"), ("気持から", "zh"), ("Hello", "ja"), (None, "en"), ("漢", "ja")]
    got = column(spark, rows, "text string, fallback string", labels.region_hint(F.col("text"), F.col("fallback")))
    assert [tuple(h) for h in got] == [
        ("ja", 0, False), ("zh", 0, False), ("zh", 0, False), ("en", 450, False), ("ja", 970, False), ("zh", 800, True), ("zh", 740, False), ("ja", 845, False), ("en", 920, False), ("en", 0, False), ("zh", 450, False),
    ]


def test_votes_and_lines(spark):
    rows = [(1, 1, "a", "en", 10), (1, 2, "b", "ja", 50), (1, 3, " ", "zh", 900), (1, 4, None, "zh", 900), (2, 1, "", "en", 900), (3, 1, "x", "zh", None), (3, 2, "y", "en", 100)]
    frame = spark.createDataFrame(rows, "page int, ord int, text string, lang string, conf int")
    got = sorted(tuple(r) for r in pages.language_vote(frame, ["page"]).collect())
    assert got == [(1, "en", 500, 850, 2), (2, "ja", 0, 0, 0), (3, "en", 666, 990, 2)]
    members = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (2, 1), (3, 1)], "g int, ord int")
    blocks = spark.createDataFrame([(1, "one\ntwo"), (2, ""), (3, None)], "g int, block string")
    assert sorted(tuple(r) for r in pages.distributed_lines(members, blocks, ["g"]).collect()) == [(1, 1, "one"), (1, 2, "two"), (1, 3, "two"), (2, 1, ""), (3, 1, "")]


def test_actions(spark):
    rows = [("mit48", "ja", 200, "x", False), ("mit48", "ja", 100, "x", True), ("mit48", "ja", 100, "x", False), ("paddle", "en", 300, "x", True), ("paddle", "en", 600, " ", False), ("paddle", "zh", 900, "x", True), ("paddle", "ja", 499, "", True)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, engine string, lang string, conf int, text string, has_mask boolean")
    assert [r.action for r in pages.handled(frame).orderBy("i").collect()] == ["translate", "erase", "keep", "erase", "erase", "keep", "keep"]


def test_classes_are_counted_on_what_letters_leave(spark):
    """Long classes never meet the letters, and no list of matches is made."""
    text = "Ab, c!  1²\t\x00é مZ　(x)​"
    counts = labels.character_counts(F.col("text"))
    row = spark.createDataFrame([(text,), ("ab",), ("",), (" 1",)], "text string").select(*(c.alias(k) for k, c in counts.items())).collect()
    assert tuple(row[0]) == (4, 7, 2, 2, 1, True) and [r.valuable for r in row[1:]] == [True, False, False]
    assert "[A-Za-z]+" in str(counts["digits"]) and "regexp_count" not in str(labels.latin_label(F.col("text"), F.lit("ja")))


def test_a_hint_is_worked_out_once(spark):
    """Blanks are taken out once a text, not once a hint word and once a rule; what
    stops a pass, ranks a crop or filters the best asks for one hint."""
    hint, again = str(labels.region_hint(F.col("text"), F.lit("ja"))), labels.BLANKS
    assert hint.count(f"[{again}]+") == 1 and hint.count("contains") == 2
    for one in (cascade.sufficient, cascade.crop_rank):
        assert str(one(F.col("text"), F.col("conf"), F.col("lang"))).count("contains") == 2
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a 漢 字", "です漢字", "", None, "Hello you", "的"])], "page int, ord int, text string")
    rows = rows.withColumn("hint", labels.region_hint(F.col("text"), F.lit("ja")))
    plan = cascade.page_hints(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter ") == 1  # the hints are in none
