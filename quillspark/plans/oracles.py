"""SQL of its own for operators of ``functions.quality``: stated from the rules,
for an engine without lookaround or back-references."""

from __future__ import annotations

from ..functions import quality as q


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]"


def _chars(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_WORD = "[A-Za-z]{2,}(?:[''’][A-Za-z]+)?"
#: Words between word borders (ASCII, as the rule's letters are).
_WORDS = "list_filter(regexp_extract_all({0}, '[\\pL\\pN_]+(?:[''’][A-Za-z]+)?'), lambda w: regexp_full_match(w, '" + _WORD + "'))"
_NAME = "(len({0}) > 0 AND (len(list_filter({0}, lambda w: NOT (len(w) <= 3 OR upper(w) = w))) = 0 OR len(list_filter({0}, lambda w: NOT regexp_full_match(w, '[A-Z][^A-Z]*[a-z][^A-Z]*'))) = 0))"
_EXPLAINED = "(?i)" + q.EXPLAINED
_UNIT = "(?i)(?:^|[^\\pL\\pN_])\\d+(?:[.,]\\d+)?\\s*(" + "|".join(sorted(q.UNITS, key=len, reverse=True)) + ")(?:$|[^A-Za-z])"


def units_sql(source: str, translated: str) -> str:
    """A unit after a number has no form in the translation. Blanks are doubled,
    so that neighbours needn't share their border."""
    found = f"list_distinct(regexp_extract_all(lower(regexp_replace({source}, '(\\s)', '\\1\\1', 'g')), '{_UNIT}', 1))"
    cases = " ".join(f"WHEN {_text(u)} THEN {_list(vs)}" for u, vs in q.UNITS.items())
    return f"len(list_filter({found}, lambda u: len(list_filter(CASE u {cases} ELSE [u] END, lambda v: contains(lower({translated}), v))) = 0)) > 0"


def warnings_sql(pairs: str, missing: str | None = None) -> str:
    """F11 over ``pairs``; ``missing`` is a query of (id, term, target), by J6."""
    m = q.MESSAGES
    terms = f"coalesce((SELECT list(target ORDER BY term) FROM ({missing}) AS j WHERE j.id = c.id), [])" if missing else "CAST([] AS VARCHAR[])"
    case = lambda when, kind: f"CASE WHEN {when} THEN {_text(m[kind])} END"
    head = "'[' || " + " || '→' || ".join(f"(CASE {c} " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in q.LANGUAGES.items()) + f" ELSE {c} END)" for c in ("source_lang", "target_lang")) + " || ']'"
    return f"""
WITH b AS (SELECT *, coalesce(source, '') AS s, coalesce(translated, '') AS t FROM {pairs}),
c AS (
  SELECT *, length(regexp_replace(s, '[^\\pL\\pN\\pM_]+', '', 'g')) AS src, length(regexp_replace(t, '[^\\pL\\pN\\pM_]+', '', 'g')) AS dst,
    {_chars('t', q.KANA)} AS kana, {_chars('t', q.HAN)} AS han, {_chars('t', '[A-Za-z]')} AS latin,
    source_lang = 'ja' AND target_lang = 'zh' AS ja_zh, source_lang = 'en' AND target_lang = 'zh' AS en_zh,
    {_WORDS.replace('{0}', 's')} AS sw, {_WORDS.replace('{0}', 't')} AS tw, regexp_matches(t, '{_EXPLAINED}') AS explained,
    regexp_replace(lower(s), '[^a-z0-9]+', '', 'g') AS ps, regexp_replace(lower(t), '[^a-z0-9]+', '', 'g') AS pt,
    lower(regexp_replace(s, '\\s+', '', 'g')) AS ts, lower(regexp_replace(t, '\\s+', '', 'g')) AS tt
  FROM b
),
d AS (SELECT *, en_zh AND len(sw) >= 3 AND ps <> '' AND ps = pt AND NOT {_NAME.format('sw')} AS early FROM c),
w AS (
  SELECT id, source_lang, target_lang, list_concat(list_filter([
    CASE WHEN backend IN ('google', 'mymemory', 'glossary', 'original') THEN {_text(m['backend'])} || backend END,
    {case("src > 0 AND (dst = 0 OR dst < greatest(2, src // 4))", 'short')},
    {case("ja_zh AND kana >= 2 AND kana / greatest(1, dst) > 0.15", 'kana')},
    {case("len(list_filter(regexp_extract_all(s, '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all(t, '[0-9]+'), x))) > 0", 'numbers')},
    {case(f"len(list_filter(regexp_extract_all(s, '{q.SYMBOLS}'), lambda x: NOT contains(t, x))) > 0", 'symbols')},
    {case("en_zh AND len(tw) >= 3 AND NOT " + _NAME.format('tw'), 'english')},
    {case("early", 'same')},
    {case("en_zh AND explained", 'explained')},
    {case("en_zh AND " + units_sql('s', 't'), 'unit')}
  ], lambda x: x IS NOT NULL), list_transform({terms.replace('c.id', 'd.id')}, lambda x: {_text(m['term'])} || x), list_filter([
    {case("NOT early AND len(ts) >= 4 AND ts = tt", 'same')},
    {case("target_lang = 'en' AND kana + han >= 3 AND kana + han > latin", 'cjk')},
    {case("target_lang = 'ja' AND han >= 4 AND kana = 0", 'han')},
    {case("NOT en_zh AND explained", 'explained')}
  ], lambda x: x IS NOT NULL)) AS ws FROM d
)
SELECT id, array_to_string(list_transform(ws, lambda x: {head} || x), '|') AS warnings FROM w"""


def entities_sql() -> str:
    """F8's capitalised runs over documents, each once (names in capitals after
    cue verbs are a unit test's). Letters outside ASCII stand as word characters,
    other signs as none, since this engine's word borders are ASCII."""
    return f"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F\\pL\\pN\\pM]', '~', 'g'), '[^\\x00-\\x7F]', '_', 'g') AS text FROM documents),
e AS (SELECT doc_id, regexp_extract_all(text, '\\b([A-Z][a-z]+(?:[-''][A-Za-z]+)?(?:\\s+[A-Z][a-z]+(?:[-''][A-Za-z]+)?)+)\\b', 1) AS names FROM t),
f AS (SELECT doc_id, list_filter(list_transform(names, lambda x: regexp_replace(x, '\\s+', ' ', 'g')), lambda x: len(string_split(x, ' ')) BETWEEN 2 AND 4
  AND NOT list_contains({_list(q.NAME_STOPS)}, upper(string_split(x, ' ')[1])) AND NOT list_contains({_list(q.NAME_STOPS)}, upper(string_split(x, ' ')[-1]))) AS names FROM e),
g AS (SELECT doc_id, list_transform(names, lambda x: lower(x)) AS low, names FROM f)
SELECT doc_id, array_to_string(list_filter(names, lambda x, i: list_position(low, lower(x)) = i)[1:{q.MOST_HINTS}], '|') AS names FROM g"""


BOUNDED = f"""
WITH n AS (SELECT doc_id, regexp_replace(nfc_normalize(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\p{{Cf}}\\p{{Co}}\\p{{Cs}}]', '', 'g') AS t FROM documents)
SELECT doc_id, md5(CASE WHEN length(t) > {q.MOST_CHARS} THEN substring(t, 1, {q.MOST_CHARS - 1}) || '…' ELSE t END) AS bounded FROM n"""

SIZES = """
WITH s AS (SELECT id, n, CASE WHEN n < 1024 THEN 1 WHEN n < 1048576 THEN 1024 WHEN n < 1073741824 THEN 1048576 ELSE 1073741824 END::BIGINT AS u,
  CASE WHEN n < 1024 THEN 'B' WHEN n < 1048576 THEN 'KB' WHEN n < 1073741824 THEN 'MB' ELSE 'GB' END AS unit FROM sizes)
SELECT id, CASE WHEN n = 0 THEN '0 B' WHEN n >= 10 * u THEN ((2 * n + u) // (2 * u))::VARCHAR || ' ' || unit
    ELSE ((20 * n + u) // (2 * u) // 10)::VARCHAR || '.' || ((20 * n + u) // (2 * u) % 10)::VARCHAR || ' ' || unit END AS size_text,
  CASE WHEN n = 0 THEN '—' WHEN n < 1000 THEN n::VARCHAR || 'ms' ELSE ((n + 50) // 100 // 10)::VARCHAR || '.' || ((n + 50) // 100 % 10)::VARCHAR || 's' END AS duration_text FROM s"""

HEARTS = """
SELECT id, CASE WHEN lost <= 0 THEN t ELSE regexp_replace(t, '□', '♥', '') || repeat('♥', lost - CASE WHEN contains(t, '□') THEN 1 ELSE 0 END) END AS decorated FROM (
  SELECT id, coalesce(translated, '') AS t, len(string_split(coalesce(source, ''), '♥')) - len(string_split(coalesce(translated, ''), '♥')) AS lost FROM pairs) AS x"""
