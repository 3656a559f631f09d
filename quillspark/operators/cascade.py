"""Recognition in passes: first reading, further languages, context, rescue
(M9, M11, A.1, A.2, A.3, O5, P15, T4).

A pass runs its recogniser over the rows that are still open and no others,
and is written to the shared folder; rows whose reading suffices leave. The
cascade ends with the first pass that leaves none open. Confidences are in
thousandths, scores in millionths; of equal candidates the first is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import HAN, KANA, blank, let, misread_japanese, region_hint
from ..sources.shared import kept

LANGUAGES = ("zh", "ja", "en")
#: What it takes to stop, and to trust a hint.
ENOUGH, TRUSTED, HINTED = 450, 600, 550
CANDIDATE = "struct<engine: string, lang: string, variant: string, text: string, conf: long>"
#: Rows -> the reading (text, conf) of each, in one language.
Recogniser = Callable[[str], Column]


def candidate(engine: Column, lang: Column, variant: Column, reading: Column) -> Column:
    return F.struct(engine.alias("engine"), lang.alias("lang"), variant.alias("variant"), reading["text"].alias("text"), reading["conf"].cast("long").alias("conf"))


def sufficient(text: Column, conf: Column, lang: Column) -> Column:
    """Sure enough, and no trusted hint of another language."""
    return ~blank(text) & (conf >= ENOUGH) & let(region_hint(text, lang), lambda hint: (hint["language"] == lang) | (hint["conf"] < TRUSTED))


def crop_rank(text: Column, conf: Column, lang: Column) -> Column:
    """A.2: the score of one crop's candidate."""
    return 1000 * conf + let(region_hint(text, lang), lambda hint: F.when(hint["language"] == lang, 100 * hint["conf"]).when(hint["conf"] >= TRUSTED, -100_000).otherwise(0))


def _scored(c: Column, first: Column, page: Column) -> Column:
    """A.1: struct<score, lang> of one candidate."""
    lang, text = F.coalesce(c["lang"], F.lit("")), c["text"]
    letters = F.regexp_replace(text, rf"[^\p{{L}}{KANA}{HAN}]", "")
    cjk = F.regexp_like(letters, F.lit(f"^[{KANA}{HAN}]+$"))
    facts = F.struct(region_hint(text, lang).alias("d"), (cjk & page.isin("zh", "ja")).alias("han"))

    def judged(x: Column) -> Column:
        d, han = x["d"], x["han"]
        own = F.when((d["conf"] >= HINTED) & (d["language"] == page), d["language"]).when(han, page).otherwise(F.when(lang == "", page).otherwise(lang))
        score = (
            1000 * c["conf"]
            + F.when(d["language"] == own, 220 * d["conf"]).when(d["conf"] >= HINTED, -160_000).otherwise(0)
            + F.when((first == own) & ~han, 80_000).otherwise(0)
            + F.when(han & (own == page), 60_000).otherwise(0)
            + F.when((page == "ja") & (d["language"] == "ja") & (d["conf"] >= HINTED), 220_000).otherwise(0)
            - F.when((page == "ja") & (d["language"] == "en") & F.regexp_like(text, F.lit("[A-Za-z]")) & ~F.regexp_like(text, F.lit("[A-Za-z]{3}")), 550_000).otherwise(0)
        )
        return F.struct(score.alias("score"), own.alias("lang"))

    return let(facts, judged)


def chosen(candidates: Column, first: Column, page: Column) -> Column:
    """A.1, T4: the best candidate with its language resolved; null without one.
    ``first`` is the language of the first reading's hint, ``page`` the
    page's, each empty for none."""
    usable = F.filter(candidates, lambda c: ~blank(c["text"]))
    ranked = F.transform(usable, lambda c, i: F.struct(_scored(c, first, page).alias("s"), c.alias("c"), i.alias("i")))
    best = F.array_max(F.transform(ranked, lambda x: F.struct(x["s"]["score"].alias("score"), F.length(x["c"]["text"]).alias("size"), (-x["i"]).alias("i"), x["c"].withField("lang", x["s"]["lang"]).alias("c"))))
    return best["c"]


def page_hints(regions: DataFrame, same: str = "page") -> DataFrame:
    """(page, page_hint): the language of three trusted hints or more, if it
    has four fifths of them (A5)."""
    # no filter on hints, as that would work them out once more
    strong = let(F.col("hint"), lambda h: F.when((h["conf"] >= 650) & ~blank(F.col("text")), h["language"]))
    counts = regions.groupBy(same, strong.alias("language")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(same, "language", F.when(F.col("language").isNotNull(), F.col("n")).alias("n"))
    best = counts.groupBy(same).agg(F.max(F.when(F.col("n").isNotNull(), F.struct("n", "language"))).alias("x"), F.sum("n").alias("all"))
    return best.where("x.n >= 3 AND 5 * x.n >= 4 * all").select(same, F.col("x.language").alias("page_hint"))


def asked_in_passes(rows: DataFrame, recogniser: Recogniser, engine: str, seen: list[int] | None = None) -> DataFrame:
    """``rows`` with ``candidates`` and ``attempts`` extended: each row asks the
    recogniser for its ``langs`` in turn, and stops at the first that suffices
    if it ``stops``. ``seen`` gets the number of rows of each pass."""
    closed, k = [], 0
    open_ = rows.where(F.size("langs") > 0)
    closed.append(rows.where(F.coalesce(F.size("langs"), F.lit(0)) <= 0))
    while True:
        parts = []
        for lang in LANGUAGES:
            own = open_.where(F.col("langs")[k] == lang).withColumn("_reading", recogniser(lang))
            added = F.when(~blank(F.col("_reading.text")), F.array(candidate(F.lit(engine), F.lit(lang), F.lit("original"), F.col("_reading")))).otherwise(F.array().cast(f"array<{CANDIDATE}>"))
            parts.append(own.withColumns({
                "candidates": F.concat("candidates", added),
                "attempts": F.concat("attempts", F.array(F.lit(f"{engine}:{lang}"))),
                "_done": F.col("stops") & sufficient(F.col("_reading.text"), F.col("_reading.conf"), F.lit(lang)),
            }).drop("_reading"))
        now = kept(parts[0].unionByName(parts[1]).unionByName(parts[2]), "pass")
        k += 1
        more = ~F.col("_done") & (F.size("langs") > k)
        closed.append(now.where(~more).drop("_done"))
        counts = now.agg(F.count(F.lit(1)).alias("n"), F.count_if(more).alias("left")).first()
        if seen is not None:
            seen.append(counts.n)
        if not counts.left:
            break
        open_ = now.where(more).drop("_done")
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out


def routed(regions: DataFrame, recogniser: Recogniser, context: Column, rescue: Column, fallback: str = "ja", seen: list[int] | None = None) -> DataFrame:
    """A.3 over regions (page, ord, text, conf, direction, x0, y0, x1, y1) whose
    text and conf are the first reading: (page, ord, text, conf, lang, engine,
    variant, reason, attempts, fallback). ``context`` and ``rescue`` are the
    readings of a vertical region with its surroundings and of the last resort."""
    text = F.coalesce("text", F.lit(""))
    rows = regions.withColumn("text", text).withColumn("hint", region_hint(text, F.lit("ja")))
    rows = rows.join(page_hints(rows), "page", "left").withColumn("page_hint", F.coalesce("page_hint", F.lit("")))
    has, lang, sure, page = F.col("text") != "", F.col("hint.language"), F.col("hint.conf"), F.col("page_hint")
    zh = has & (lang == "zh")
    ordered = F.array_distinct(F.filter(F.array(page, F.lit(fallback), F.when(has, lang).otherwise(""), F.lit("zh"), F.lit("en"), F.lit("ja")), lambda x: x.isin(*LANGUAGES)))
    reasons = [  # in order; the languages asked, none where the first reading is accepted
        ("kana", has & (lang == "ja") & (sure >= HINTED), None),
        ("symbols", has & ~F.regexp_like("text", F.lit(rf"[\p{{L}}{KANA}{HAN}]")), None),
        ("latin", has & (lang == "en") & (sure >= HINTED), ["en"]),
        ("common zh", zh & F.col("hint.common"), ["zh"]),
        ("page zh", zh & (page == "zh"), ["zh"]),
        ("page ja", zh & (page == "ja"), ["ja", "zh"]),
        ("han", zh, ["zh", "ja"]),
        ("unclear", F.lit(True), ordered),
    ]
    reason, langs = F.lit(None), F.lit(None).cast("array<string>")
    for name, test, asked in reversed(reasons):
        reason = F.when(test, name).otherwise(reason)
        langs = F.when(test, F.lit(None).cast("array<string>") if asked is None else F.array(*map(F.lit, asked)) if isinstance(asked, list) else asked).otherwise(langs)
    first = candidate(F.lit("mit48"), F.when(lang == "ja", "ja").otherwise(""), F.lit("mit48"), F.struct("text", "conf"))
    rows = rows.withColumns({
        "reason": reason, "langs": langs, "attempts": F.array(F.lit("mit48")),
        "candidates": F.when(has, F.array(first)).otherwise(F.array().cast(f"array<{CANDIDATE}>")),
    }).withColumn("stops", ~F.coalesce(F.array_sort("langs") == F.array(F.lit("ja"), F.lit("zh")), F.lit(False)))
    # written, as each language's rows and the accepted ones are taken from it apart
    asked = asked_in_passes(kept(rows, "routes"), recogniser, "paddle", seen)

    # a vertical region that is not much higher than wide is read again with what is around it
    around = F.col("langs").isNotNull() & (page == "ja") & (F.col("direction") == "v") & (F.col("conf") < ENOUGH) & (5 * (F.col("y1") - F.col("y0")) <= 16 * F.greatest(F.lit(1), F.col("x1") - F.col("x0")))
    wide = asked.withColumn("_context", context)
    wide = wide.withColumns({
        "candidates": F.when(around & ~blank(F.col("_context.text")), F.concat("candidates", F.array(candidate(F.lit("paddle"), F.lit("ja"), F.lit("vertical-context:original"), F.col("_context"))))).otherwise(F.col("candidates")),
        "attempts": F.when(around, F.concat("attempts", F.array(F.lit("paddle:ja-context")))).otherwise(F.col("attempts")),
    })
    accepted = F.col("langs").isNull()
    best = F.when(~accepted, chosen(F.col("candidates"), F.when(has, lang).otherwise(""), page))
    out = wide.withColumn("_best", best)
    none = ~accepted & F.col("_best").isNull()
    own_lang = F.when(F.col("reason") == "kana", "ja").when(accepted | none, fallback).otherwise(F.when(F.col("_best.lang") == "", fallback).otherwise(F.col("_best.lang")))
    out = out.select(
        "page", "ord", "reason", "attempts", "page_hint", "direction", rescue.alias("_rescue"), own_lang.alias("lang"), F.col("text").alias("first"), none.alias("none"), accepted.alias("accepted"),
        F.when(accepted, F.col("text")).otherwise(F.coalesce("_best.text", F.lit(""))).alias("text"), F.when(accepted, F.col("conf")).otherwise(F.coalesce("_best.conf", F.lit(0))).alias("conf"),
        F.when(accepted, "mit48").otherwise(F.coalesce("_best.engine", F.lit(""))).alias("engine"), F.when(accepted, "mit48").otherwise(F.coalesce("_best.variant", F.lit(""))).alias("variant"),
    )
    review = ~F.col("accepted") & ~F.col("none") & (F.col("lang") == "ja") & misread_japanese(F.col("text"), F.col("conf"), page)
    again = F.col("_rescue.text")
    # a review that brings no Japanese is taken back
    taken = review & (blank(again) | F.regexp_like(again, F.lit(f"[{KANA}{HAN}]")))
    out = out.withColumn("_taken", taken)
    taken = F.col("_taken")
    doubtful = ~F.col("accepted") & ~F.col("none") & ((F.col("engine") != "mit48") | (F.col("conf") < ENOUGH))
    return out.select(
        "page", "ord", "reason", "attempts", "lang", "variant",
        F.when(taken, again).otherwise(F.col("text")).alias("text"), F.when(taken, F.col("_rescue.conf")).otherwise(F.col("conf")).cast("long").alias("conf"),
        F.when(taken, "mangaocr").otherwise(F.col("engine")).alias("engine"), (doubtful | taken).alias("fallback"),
    )
