"""Language and script functions as relations over a text column.

Han is U+3400 to U+9FFF; kana are hiragana and katakana letters; Latin is ASCII.
"""

from ..relation import Relation


def _n(pattern: str, column: str = "text") -> str:
    return f"[[regexp_count({column}, '{pattern}')||len(regexp_extract_all({column}, '{pattern}'))]]"


def _chars(chars: str, column: str = "text") -> str:
    """Characters of a class: what is gone without its runs."""
    return f"length({column}) - length([[regexp_replace({column}, '{chars}+', '')||regexp_replace({column}, '{chars}+', '', 'g')]])"


KANA, HAN, LATIN = f"[{chr(0x3040)}-{chr(0x30FF)}]", "[㐀-鿿]", "[A-Za-z]"

# The hint words of the two languages; each counts once.
ZH_HINTS = tuple("的了是不我你他她它们这那有在和就都一个没什么可以吗吧啊呢") + ("我们", "你们", "他们", "然后", "因为", "所以", "现在", "真的", "不是")
JA_HINTS = ("です", "ます", "でした", "ください", "ない", "する", "した", "こと", "もの", "から", "まで")


def _hints(words: tuple[str, ...]) -> str:
    """How many of the words a text without blanks has; only texts with Han need it."""
    tight = "[[regexp_replace(text, '(?U)[ \\t\\n\\r]+', '')||regexp_replace(text, '[ \\t\\n\\r]+', '', 'g')]]"
    quoted = ", ".join(f"'{w}'" for w in words)
    return f"[[size(filter(array({quoted}), w -> contains({tight}, w)))||len(list_filter([{quoted}], lambda w: contains({tight}, w)))]]"


_COUNTS = f"""
SELECT *, CASE WHEN han > 0 THEN {_hints(JA_HINTS)} ELSE 0 END AS ja_hints, CASE WHEN han > 0 THEN {_hints(ZH_HINTS)} ELSE 0 END AS zh_hints FROM (
  SELECT id, text, fallback, coalesce({_chars(KANA)}, 0) AS kana, coalesce({_chars(HAN)}, 0) AS han, coalesce({_chars(LATIN)}, 0) AS latin,
    coalesce({_chars(KANA)}, 0) + coalesce({_chars(HAN)}, 0) + coalesce({_chars(LATIN)}, 0) AS meaningful FROM {{texts}}) AS n"""

#: Rules in order; confidences in thousandths.
_DETECT = f"""
WITH c AS ({_COUNTS}),
s AS (SELECT *, kana + han + latin AS total FROM c),
r AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE kana * 1000 [[div||//]] total END AS kana_share, CASE WHEN total = 0 THEN 0 ELSE latin * 1000 [[div||//]] total END AS latin_share FROM s)
SELECT id, text, fallback, kana, han, latin, meaningful,
  CASE WHEN total = 0 THEN fallback
    WHEN kana > 0 AND (kana_share >= 120 OR kana >= 2) THEN 'ja'
    WHEN (latin >= greatest(2, 2 * han) OR latin_share >= 550) THEN 'en'
    WHEN han > 0 THEN CASE WHEN ja_hints > zh_hints AND length(trim(text)) >= 2 THEN 'ja' ELSE 'zh' END
    WHEN latin > 0 THEN 'en' ELSE fallback END AS language,
  CAST(CASE WHEN total = 0 THEN 0
    WHEN kana > 0 AND (kana_share >= 120 OR kana >= 2) THEN least(990, 720 + kana_share [[div||//]] 4)
    WHEN (latin >= greatest(2, 2 * han) OR latin_share >= 550) THEN least(980, 620 + latin_share * 3 [[div||//]] 10)
    WHEN han > 0 THEN CASE WHEN ja_hints > zh_hints AND length(trim(text)) >= 2 THEN 580 ELSE least(900, 620 + 30 * least(han, 8) + 40 * zh_hints) END
    WHEN latin > 0 THEN 550 ELSE 0 END AS BIGINT) AS confidence
FROM r"""

script_counts = Relation("F1 P12", f"SELECT id, kana, han, latin, ja_hints, zh_hints, meaningful FROM ({_COUNTS}) AS c")
detect_language = Relation("F1 D12", f"SELECT id, language, confidence FROM ({_DETECT}) AS d")
region_hint = Relation("F2 P31", f"""
SELECT id, CASE WHEN text IS NULL OR trim(text) = '' THEN fallback ELSE language END AS language,
  CASE WHEN text IS NULL OR trim(text) = '' THEN 0 WHEN meaningful <= 1 THEN least(450, confidence) ELSE confidence END AS confidence FROM ({_DETECT}) AS d""")
QUERIES = {
    "q_lang_detect": (detect_language, {"texts": "doc_texts"}),
    "q_lang_detect_cjk": (detect_language, {"texts": "samples"}),
    "q_region_hint": (region_hint, {"texts": "samples"}),
    "q_script_counts": (script_counts, {"texts": "samples"}),
    "q_script_counts_docs": (script_counts, {"texts": "doc_texts"}),
}
