"""Replacement by a glossary against the rule, a term at a time."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import glossary_pass
from quillspark.functions.glossary_pass import Glossary
from quillspark.operators import replacing, terms
from quillspark.plans import catalog
from quillspark.sources.frames import frame

SCHEMA = "id long, source string, target string, lang string, target_lang string, disabled boolean"


def by_rule(text, glossary, lang):
    mapping, order = {}, {}
    for i, s, t, *_ in sorted(glossary):
        order.setdefault(s, i)
        mapping[s] = t
    for s in sorted(mapping, key=lambda s: (-len(s), order[s])):
        if re.search(terms.CJK, s):
            text = text.replace(s, mapping[s])
        else:
            text = re.sub(rf"(?<!\w){re.escape(s)}(?!\w)", lambda _, t=mapping[s]: t, text, flags=re.I if lang == "en" else 0)
    return text


@pytest.mark.parametrize("lang", ["en", "ja"])
def test_replacements_equal_the_rule(spark, lang):
    r = random.Random(9)
    pool = ["a", "b", "ab", "the", "cat", "Cat", "mat", "火", "影", "火影", "忍", "x$1", "\\E", "!!", "ba"]
    phrase = lambda: r.choice(["", " ", "-"]).join(r.choice(pool) for _ in range(r.randint(1, 3)))
    for _ in range(3):
        glossary = [(i, phrase(), phrase(), lang, "zh", False) for i in range(40)]
        rows = [(i, " ".join(phrase() for _ in range(r.randint(0, 8)))) for i in range(80)] + [(900, ""), (901, None)]
        asked = []
        off = [(500, "the", "NO", lang, "zh", True), (501, "cat", "NO", "fr", "zh", False), (502, "mat", "NO", lang, "en", False), (503, "", "NO", lang, "zh", False)]
        got = replacing.replaced(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(glossary + off, SCHEMA), lang, "zh", asked=asked).collect()
        assert {x.id: x.replaced for x in got} == {i: None if t is None else by_rule(t, glossary, lang) for i, t in rows} and len(got) == len(rows)
        assert len(asked) > 1 and asked == sorted(asked, reverse=True)


def test_a_replacement_makes_a_match(spark):
    glossary = [(1, "first name", "second", "en", "zh", False), (2, "second", "third", "en", "zh", False), (3, "third", "SECOND", "en", "zh", False), (4, "火", "fi", "en", "zh", False), (5, "fire", "hot", "en", "zh", False)]
    rows = [(1, "the First Name is"), (2, "a second third"), (3, "火re")]
    got = replacing.replaced(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(glossary, SCHEMA), "en", "zh").collect()
    # second is longer than third: its result is met, and what third makes is not
    assert {x.id: x.replaced for x in got} == {1: "the SECOND is", 2: "a SECOND SECOND", 3: "fire"}


def test_a_hundred_thousand_terms(spark):
    """Part names with numbers, most of which no text has; the plan has none."""
    names = frame(spark, "/root/testdata/sf0.01", "part").select("p_name", "p_partkey")
    glossary = names.crossJoin(spark.range(50)).select((F.col("p_partkey") * 50 + F.col("id")).alias("id"), F.concat_ws(" ", "p_name", F.when(F.col("id") > 0, F.col("id"))).alias("source"), F.concat(F.lit("<"), F.col("p_partkey"), F.lit(">")).alias("target"), F.lit("en").alias("lang"), F.lit("zh").alias("target_lang"), F.lit(False).alias("disabled"))
    assert glossary.count() == 100_000
    r, own = random.Random(2), [x.p_name for x in names.collect()]
    rows = [(i, ", ".join(f"{r.choice(own)}{r.choice(['', ' 7', ' 77', 's'])}" for _ in range(20))) for i in range(100)]
    texts = spark.createDataFrame(rows, "id long, text string")
    got = {x.id: x.replaced for x in replacing.replaced(texts, glossary, "en", "zh").collect()}
    short = [tuple(x) for x in glossary.where("id % 50 IN (0, 7)").collect()]
    assert got == {i: by_rule(t, short, "en") for i, t in rows}


def test_the_query_equals_the_rule(spark):
    data = "/root/testdata/sf0.001"
    glossary = [tuple(x) for x in frame(spark, data, "word_terms").select("id", "source", "target").collect()]
    want = {x.doc_id: None if x.text is None else hashlib.md5(by_rule(x.text, glossary, "en").encode()).hexdigest() for x in frame(spark, data, "documents").select("doc_id", "text").collect()}
    assert {x.doc_id: x.replaced for x in catalog.QUERIES["q_glossary_replaced"](spark, data).collect()} == want
    assert sum(hashlib.md5((x.text or "").encode()).hexdigest() != want[x.doc_id] for x in frame(spark, data, "documents").collect()) > 50


@pytest.mark.parametrize("lang", ["en", "ja"])
def test_one_pass_equals_the_rule(lang):
    """Terms with signs at their ends, of Han, that overlap themselves or make others."""
    r = random.Random(3)
    for k in range(60):
        seps = r.choice([["", " ", "-"], [" "], [" ", "  "], [" ", ", "]])
        pool = ["a", "b", "c", "A", "the", "cat"] if k % 2 else ["a", "ab", "Cat", "cat", "火", "影", "火影", "x$1", "\\E", "!!", "é", "É", "-"]
        phrase = lambda: r.choice(seps).join(r.choice(pool) for _ in range(r.randint(1, 3)))  # noqa: B023,E731
        glossary, order, mapping = [(i, phrase(), r.choice([phrase(), phrase(), "", "!"])) for i in range(r.choice([3, 10, 40]))], {}, {}
        for i, s, t in glossary:
            order.setdefault(s, i)
            mapping[s] = t
        own = Glossary([(s, mapping[s]) for s in sorted(mapping, key=lambda s: (-len(s), order[s]))], lang == "en")
        for _ in range(20):
            x = " ".join(phrase() for _ in range(r.randint(0, 10)))
            assert own.replaced(x) == by_rule(x, glossary, lang)


def test_texts_stay_where_they_are(spark):
    """A glossary that a task can hold: the texts are not dealt out. Both ways give the same."""
    data = "/root/testdata/sf0.001"
    texts, glossary = frame(spark, data, "documents"), frame(spark, data, "word_terms")
    out = replacing.replaced(texts, glossary, "en", "zh", "doc_id")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    some = texts.where("doc_id < 40")
    joined = replacing.replaced(some, glossary, "en", "zh", "doc_id", asked=[])
    assert sorted(map(tuple, replacing.replaced(some, glossary, "en", "zh", "doc_id").collect())) == sorted(map(tuple, joined.collect()))


@pytest.mark.parametrize("lang", ["en", "ja"])
def test_few_terms_equal_the_rule(lang, monkeypatch):
    """Few terms are sought in the bytes: no text is taken apart, also with letters, signs
    and marks beyond ASCII beside the terms."""
    r, cases = random.Random(4), []
    for k in range(60):
        seps = r.choice([["", " ", "-"], [" "], [" ", "…", "“"], [" ", ", "]])
        pool = ["a", "b", "A", "the", "The", "cat"] if k % 2 else ["a", "ab", "Cat", "火", "火影", "x$1", "\\E", "!!", "é", "É", "’", "𝒜", "-", "_", "7"]
        phrase = lambda p: r.choice(seps).join(r.choice(p) for _ in range(r.randint(1, 3)))  # noqa: B023,E731
        own = [p for p in pool if lang == "ja" or p.isascii() or p[0] == "火"]
        while True:
            glossary, order, mapping = [(i, phrase(own), r.choice([phrase(pool), ""])) for i in range(r.choice([1, 5, 40]))], {}, {}
            if lang == "ja" or all(s.isascii() or re.search(terms.CJK, s) for _, s, _ in glossary):
                break
        for i, s, t in glossary:
            order.setdefault(s, i)
            mapping[s] = t
        texts = [" ".join(phrase(pool) for _ in range(r.randint(0, 10))) for _ in range(20)]
        cases.append((glossary, [(s, mapping[s]) for s in sorted(mapping, key=lambda s: (-len(s), order[s]))], texts))
    with monkeypatch.context() as m:
        m.setattr(glossary_pass, "_Chain", None)
        for glossary, pairs, texts in cases:
            own = glossary_pass.pass_of(pairs, lang == "en")
            assert [own(x.encode()).decode() for x in texts] == [by_rule(x, glossary, lang) for x in texts]


def test_few_terms_leave_letters_like_ascii_to_the_chain():
    """The long s, the dotless i and the Kelvin sign are an s, an i and a k in other case."""
    for source, text in (("sea", "the \u017fea"), ("ink", "an \u0131n\u212a"), ("ink", "an \u0130nk")):
        few, own = glossary_pass.Few([(source, "X")], True), glossary_pass.pass_of([(source, "X")], True)
        assert not few.takes(text.encode()) and own(text.encode()) == text.split(" ")[0].encode() + b" X"
    # as a target, one would make a match for a later term
    assert glossary_pass.pass_of([("long", "\u017fea"), ("sea", "X")], True)(b"a long sea") == b"a X X"


@pytest.mark.parametrize("lang", ["en", "ja"])
def test_words_that_no_term_joins_are_apart(lang, monkeypatch):
    """Only words that a term may join, now or after a replacement, go through a chain together."""
    r, sizes, chain = random.Random(6), [], glossary_pass._Chain
    monkeypatch.setattr(glossary_pass, "_Chain", lambda g, text, *rank: sizes.append(len(text.split())) or chain(g, text, *rank))
    monkeypatch.setattr(glossary_pass, "MEMO", 20)
    for _ in range(20):
        pool = [f"w{i}" for i in range(60)] + ["The", "the", "É"]
        phrase = lambda n: r.choice([" ", " ", "-"]).join(r.choice(pool) for _ in range(r.randint(1, n)))  # noqa: B023,E731
        glossary, order, mapping = [(i, phrase(3), r.choice([phrase(2), f"<{phrase(1)}>"])) for i in range(70)], {}, {}
        for i, s, t in glossary:
            order.setdefault(s, i)
            mapping[s] = t
        own = Glossary([(s, mapping[s]) for s in sorted(mapping, key=lambda s: (-len(s), order[s]))], lang == "en")
        for _ in range(20):
            x = " ".join(phrase(3) for _ in range(40))
            assert own.replaced(x) == by_rule(x, glossary, lang)
    # texts have 80 words
    assert sum(sizes) / len(sizes) < 6
