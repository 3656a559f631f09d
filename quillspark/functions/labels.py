"""Predicates on recognised texts: labels to keep, misread lines, English words,
and which language a region's text looks like (P9, P10, P11, P14, F2, F13, F16).

``conf`` is in thousandths. A null text counts as blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scripts import JA_HINTS, ZH_HINTS

HAN, KANA, GREEK = (f"{chr(a)}-{chr(b)}" for a, b in ((0x3400, 0x9FFF), (0x3040, 0x30FF), (0x0370, 0x03FF)))
#: What counts as blank: Unicode's white space and the four separators of ASCII.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A character that a word can go on with.
_WORDLY = r"[\p{L}\p{N}_]"
_SURE = 700


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _chars(text: Column, some: str) -> Column:
    """Characters of a class: what is gone without its runs, as a list of all matches takes long."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{some}+", ""))


def _has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def latin_label(text: Column, language: Column) -> Column:
    """On a Japanese page a text of at least four ASCII letters, digits
    and - ' &, which are seven tenths or more of what isn't blank."""
    latin, all_ = _chars(_text(text), "[A-Za-z0-9&'-]"), F.length(F.regexp_replace(_text(text), f"[{BLANKS}]+", ""))
    return (language == "ja") & (latin >= 4) & (10 * latin >= 7 * all_)


def suspicious_japanese(text: Column, language: Column, fallback: Column) -> Column:
    """P10: on a Japanese page a text of a fallback reading without Han that
    has Greek, or only Latin words under three letters (with at most one kana,
    or with digits), or no Latin words but digits and at most one kana."""
    t = _text(text)
    few_kana, digits = _count(t, f"[{KANA}]") <= 1, _has(t, r"\p{Nd}")
    return (language == "ja") & F.coalesce(fallback, F.lit(False)) & ~_has(t, f"[{HAN}]") & (
        F.when(_has(t, f"[{GREEK}]"), True).when(_has(t, "[A-Za-z]") & ~_has(t, "[A-Za-z]{3}"), few_kana | digits).otherwise(digits & few_kana)
    )


def misread_japanese(text: Column, conf: Column, hint: Column) -> Column:
    """A text without kana and Han on a page that is taken for Japanese,
    unless it is sure and has a Latin word of four letters or more."""
    t = _text(text)
    return (hint == "ja") & _has(t, f"[^{BLANKS}]") & ~_has(t, f"[{KANA}{HAN}]") & ((conf < _SURE) | ~_has(t, "[A-Za-z]{4}"))


def english_words(text: Column) -> Column:
    """F13, the list: runs of two ASCII letters or more that no other letter,
    digit or _ touches, with what an apostrophe adds."""
    return F.regexp_extract_all(_text(text), F.lit(rf"(?<!{_WORDLY})[A-Za-z]{{2,}}(?:['’][A-Za-z]+(?!{_WORDLY}))?(?!{_WORDLY})"), F.lit(0))


def english_word_count(text: Column) -> Column:
    """F13, the count: runs of ASCII letters and digits; a single ' ’ or -
    between two of them joins them."""
    runs, joints = _count(_text(text), "[A-Za-z0-9]+"), _count(_text(text), "(?<=[A-Za-z0-9])['’-](?=[A-Za-z0-9])")
    return runs - joints


def name_like(words: Column) -> Column:
    """P14 over a word list: all of three letters at most or in upper case, or all capitalised."""
    short = F.forall(words, lambda w: (F.length(w) <= 3) | ((F.upper(w) == w) & (F.lower(w) != w)))
    title = F.forall(words, lambda w: _has(F.substring(w, 1, 1), "[A-Z]") & (F.lower(F.substring(w, 2, 1000)) == F.substring(w, 2, 1000)) & _has(F.substring(w, 2, 1000), "[a-z]"))
    return (F.size(words) > 0) & (short | title)


def _ranges(test) -> str:
    """The characters that pass, as ranges of a class."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and test(chr(c))]
    starts = [c for c in codes if c - 1 not in (known := set(codes))]
    ends = [c for c in codes if c + 1 not in known]
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


#: F16: classes of characters, for both engines. Digits are more than decimal ones.
PUNCTUATION = "[\\p{P}!-/:-@\\[-`{-~]"
SPACE = "[ \t\n\r\\x00\\p{Zs}]"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\p{Cf}]"
DIGIT = f"[{_ranges(str.isdigit)}]"
RIGHT_TO_LEFT = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF), (0x10E60, 0x10E7F), (0x1EE00, 0x1EEFF))) + "]"
WORTHLESS = "[" + "".join(x[1:-1] for x in (PUNCTUATION, SPACE, CONTROL, DIGIT)) + "]"
#: Signs that a text may consist of to be kept as it is.
KEPT_SIGNS = "~！!？?…☆★♪♫◎○●▲△□■"


def character_counts(text: Column) -> dict[str, Column]:
    """F16: how many characters of each class a text has, and whether any is of value."""
    # ASCII letters, most of a text, are in none of the classes, and spaces in one: the long classes meet the rest
    spaced = F.regexp_replace(text, "[A-Za-z]+", "")
    rest = F.regexp_replace(spaced, " +", "")
    return {
        "punctuation": _chars(rest, PUNCTUATION), "blanks": F.length(spaced) - F.length(rest) + _chars(rest, SPACE), "controls": _chars(rest, CONTROL), "digits": _chars(rest, DIGIT), "right_to_left": _chars(rest, RIGHT_TO_LEFT),
        "valuable": (F.length(text) > F.length(spaced)) | (F.length(F.regexp_replace(rest, f"{WORTHLESS}+", "")) > 0),
    }


def kept_as_is(text: Column) -> Column:
    """Nothing but blanks and decorative signs, and something."""
    return _has(_text(text), f"^[{BLANKS}{KEPT_SIGNS}]+$")


def blank(text: Column) -> Column:
    return ~_has(_text(text), f"[^{BLANKS}]")


def stripped(text: Column) -> Column:
    return F.btrim(_text(text), F.lit(BLANKS))


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _words_in(text: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))


def region_hint(text: Column, fallback: Column) -> Column:
    """struct<language, conf, common> of one region's text; ``common``
    says whether common Chinese words decided. A text of one letter at most is
    unsure."""

    def counted(t: Column) -> Column:
        classes = (("kana", f"[{KANA}]"), ("han", f"[{HAN}]"), ("latin", "[A-Za-z]"))
        return let(F.struct(t.alias("text"), *(_chars(t, some).alias(k) for k, some in classes)), words)

    def words(c: Column) -> Column:
        tight = F.regexp_replace(c["text"], f"[{BLANKS}]+", "")
        hints = lambda t: F.struct(F.length(t).alias("size"), _words_in(t, ZH_HINTS).alias("zh"), _words_in(t, JA_HINTS).alias("ja"))
        # only texts with Han, and no more kana than may stand with it, are asked for words
        asked = (c["han"] > 0) & ~((c["kana"] >= 2) | (100 * c["kana"] >= 12 * (c["kana"] + c["han"] + c["latin"])) & (c["kana"] > 0))
        none = F.struct(F.lit(0).alias("size"), F.lit(0).alias("zh"), F.lit(0).alias("ja"))
        return let(F.struct(c["kana"].alias("kana"), c["han"].alias("han"), c["latin"].alias("latin"), (c["kana"] + c["han"] + c["latin"]).alias("all"), F.when(asked, let(tight, hints)).otherwise(none).alias("w")), judged)

    def judged(c: Column) -> Column:
        all_, zh, ja = c["all"], c["w"]["zh"], c["w"]["ja"]
        kana, latin = (F.floor(1000 * c[k] / F.greatest(all_, F.lit(1))) for k in ("kana", "latin"))
        unsure = lambda conf: F.when(all_ <= 1, F.least(conf, F.lit(450))).otherwise(conf)
        found = lambda language, conf, common=F.lit(False): F.struct(language.alias("language"), unsure(conf.cast("long")).cast("long").alias("conf"), ((all_ > 1) & common).alias("common"))
        return (
            F.when(all_ == 0, found(fallback, F.lit(0)))
            .when((c["kana"] >= 2) | ((c["kana"] > 0) & (100 * c["kana"] >= 12 * all_)), found(F.lit("ja"), F.least(F.lit(990), 720 + F.floor(kana / 4))))
            .when((c["latin"] >= F.greatest(F.lit(2), 2 * c["han"])) | (100 * c["latin"] >= 55 * all_), found(F.lit("en"), F.least(F.lit(980), 620 + F.floor(latin * 3 / 10))))
            .when((c["han"] > 0) & (ja > zh) & (c["w"]["size"] >= 2), found(F.lit("ja"), F.lit(580)))
            .when(c["han"] > 0, found(F.lit("zh"), F.least(F.lit(900), 620 + 30 * F.least(c["han"], F.lit(8)) + 40 * zh), zh > 0))
            .when(c["latin"] > 0, found(F.lit("en"), F.lit(550)))
            .otherwise(found(fallback, F.lit(0)))
        )

    return let(stripped(text), counted)


_SQL_BLANKS = f"[{BLANKS}]"


def _sql_chars(text: str, test: str) -> str:
    """Characters, one by one."""
    return f"len(list_filter(string_split({text}, ''), lambda c: c <> '' AND {test}))"


def latin_label_sql(text: str, language: str) -> str:
    latin = _sql_chars(text, "(c BETWEEN 'A' AND 'Z' OR c BETWEEN 'a' AND 'z' OR c BETWEEN '0' AND '9' OR c IN ('-', '''', '&'))")
    rest = _sql_chars(text, f"NOT regexp_full_match(c, '{_SQL_BLANKS}')")
    return f"({language} = 'ja' AND {latin} >= 4 AND {latin}::DOUBLE / greatest(1, {rest}) >= 0.7)"


def _sql_between(text: str, low: int, high: int) -> str:
    return _sql_chars(text, f"unicode(c) BETWEEN {low} AND {high}")


def suspicious_sql(text: str, language: str, fallback: str) -> str:
    han, kana, greek = (_sql_between(text, *x) for x in ((0x3400, 0x9FFF), (0x3040, 0x30FF), (0x0370, 0x03FF)))
    words, digits = f"regexp_extract_all({text}, '[A-Za-z]+')", f"len(regexp_extract_all({text}, '\\p{{Nd}}'))"
    return f"""CASE WHEN {language} <> 'ja' OR NOT {fallback} OR trim({text}) = '' OR {han} > 0 THEN false WHEN {greek} > 0 THEN true
    WHEN len({words}) > 0 AND len(list_filter({words}, lambda w: length(w) >= 3)) = 0 THEN {kana} <= 1 OR {digits} > 0 ELSE {digits} > 0 AND {kana} <= 1 END"""


def misread_sql(text: str, conf: str, hint: str) -> str:
    words = f"regexp_extract_all({text}, '[A-Za-z]+')"
    longest = f"coalesce(list_max(list_transform({words}, lambda w: length(w))), 0)"
    return f"""CASE WHEN {hint} <> 'ja' OR NOT regexp_matches({text}, '[^{_SQL_BLANKS[1:]}') OR {_sql_between(text, 0x3040, 0x30FF)} + {_sql_between(text, 0x3400, 0x9FFF)} > 0 THEN false
    WHEN {longest} >= 4 AND {conf} >= 700 THEN false ELSE {conf} < 700 OR {longest} <= 3 END"""


def english_words_sql(text: str) -> str:
    """Letters and digits beyond ASCII become _, so that RE2's word borders fit."""
    flat = f"regexp_replace(regexp_replace({text}, '[^\\P{{L}}A-Za-z]|[^\\P{{N}}0-9]', '_', 'g'), '’', '''', 'g')"
    return f"regexp_extract_all({flat}, '\\b[A-Za-z]{{2,}}(?:''[A-Za-z]+)?\\b')"


def name_like_sql(words: str) -> str:
    return f"""(len({words}) > 0 AND (len(list_filter({words}, lambda w: length(w) > 3 AND w <> upper(w))) = 0
    OR len(list_filter({words}, lambda w: NOT regexp_full_match(w, '[A-Z][^A-Z]*[a-z][^A-Z]*'))) = 0))"""
