"""Text functions over relations: names, colours, layout, backends, JSON imports.
Checks of translations are in ``quality``."""

from ..relation import Relation


def _all(pattern: str, column: str) -> str:
    return f"[[regexp_extract_all({column}, '{pattern}', 0)||regexp_extract_all({column}, '{pattern}')]]"


def _n(pattern: str, column: str) -> str:
    return f"[[regexp_count({column}, '{pattern}')||len(regexp_extract_all({column}, '{pattern}'))]]"


def _gsub(column: str, pattern: str, by: str) -> str:
    return f"[[regexp_replace({column}, '{pattern}', '{by}')||regexp_replace({column}, '{pattern}', '{by}', 'g')]]"


def _gone(column: str, chars: str) -> str:
    """Characters of a class: what is gone without its runs."""
    return f"length({column}) - length({_gsub(column, chars + '+', '')})"


_S = "[[STRING||VARCHAR]]"
safe_names = Relation("F17 F18 K10", f"SELECT id, {_gsub('regexp_extract(name, ' + chr(39) + '[^/]+$' + chr(39) + ', 0)', '[^A-Za-z0-9._ -]', '_')} AS safe, lower(regexp_extract(name, '[.][^./]*$', 0)) AS suffix FROM {{names}}")
natural_sort = Relation("T6", f"""
SELECT id, CAST(row_number() OVER (ORDER BY [[array_join(transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+', 0), x -> CASE WHEN x rlike '^[0-9]' THEN lpad(ltrim('0', x), 12, '0') ELSE x END), '')||array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(ltrim(x, '0'), 12, '0') ELSE x END), '')]], id) AS BIGINT) AS place FROM {{names}}""")
extension = Relation("P26", "SELECT id, [[lower(regexp_extract(name, '[.]([^.]+)$', 1))||lower(regexp_extract(name, '[.]([^.]+)$', 1))]] IN ('png', 'jpg', 'jpeg', 'webp') AS is_image FROM {names}")
contains_name = Relation("P28 F29", f"SELECT id, CASE WHEN trim(name) = '' THEN 'batch ' || CAST(id AS {_S}) ELSE name END AS label FROM {{names}} WHERE contains(lower(name), 'page')")
hex_colour = Relation("F19 G17 P25", """
SELECT id, ok, CASE WHEN ok THEN r ELSE -1 END AS r, CASE WHEN ok THEN g ELSE -1 END AS g, CASE WHEN ok THEN b ELSE -1 END AS b, CASE WHEN ok THEN (299 * r + 587 * g + 114 * b) [[div||//]] 1000 ELSE -1 END AS luminance
FROM (SELECT id, [[hex rlike '^#[0-9a-fA-F]{6}$'||regexp_full_match(hex, '#[0-9a-fA-F]{6}')]] AS ok,
  [[CAST(conv(substring(hex, 2, 2), 16, 10) AS BIGINT)||TRY_CAST('0x' || substring(hex, 2, 2) AS BIGINT)]] AS r, [[CAST(conv(substring(hex, 4, 2), 16, 10) AS BIGINT)||TRY_CAST('0x' || substring(hex, 4, 2) AS BIGINT)]] AS g,
  [[CAST(conv(substring(hex, 6, 2), 16, 10) AS BIGINT)||TRY_CAST('0x' || substring(hex, 6, 2) AS BIGINT)]] AS b FROM {colours}) AS c""".replace("{6}", "[0-9a-fA-F]" * 5))
zh_layout = Relation("F15", "SELECT grp, ord, [[array_join(filter(transform(split(text, chr(10)), x -> trim(x)), x -> x <> ''), '')||array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), '')]] AS laid_out FROM {lines}")
group_text = Relation("A9 A18", "SELECT grp, [[listagg(text, chr(10)) WITHIN GROUP (ORDER BY ord)||string_agg(text, chr(10) ORDER BY ord)]] AS block, CAST(max(length(text)) AS BIGINT) AS longest FROM {lines} WHERE trim(text) <> '' GROUP BY grp")
wrap_estimate = Relation("F23", f"""
WITH n AS (SELECT grp, ord, length(text) AS n, {_gone('text', '[ ]')} AS blanks, {_gone('text', '[a-z]')} AS low, {_gone('text', '[A-Z]')} AS up FROM {{lines}}),
u AS (SELECT grp, ord, blanks * 35 + low * 50 + up * 58 + (n - blanks - low - up) * 100 AS units FROM n)
SELECT grp, ord, CAST(coalesce([[array_max(filter(sequence(8, 48), s -> ((units * s + 59999) div 60000) * s * 12 <= 10 * 400))||list_max(list_filter(range(8, 49), lambda s: ((units * s + 59999) // 60000) * s * 12 <= 10 * 400))]], 8) AS BIGINT) AS font_size FROM u""")
first_backend = Relation("W15 A.11", """
WITH r AS (SELECT id, backend, result, row_number() OVER (PARTITION BY id ORDER BY rank) AS rn FROM {backends} WHERE trim(coalesce(result, '')) <> '')
SELECT i.id, coalesce(r.backend, 'original') AS backend, r.result FROM (SELECT DISTINCT id FROM {backends}) AS i LEFT JOIN r ON i.id = r.id AND r.rn = 1""")
unnest_ocr = Relation("S22", """
SELECT id, pos, text, coalesce(score, 0) AS score FROM (
  SELECT id, pos, text, [[try_element_at(scores, pos)||scores[pos]]] AS score FROM (
    SELECT id, scores, [[posexplode(texts) AS (p, text)||unnest(texts) AS text, generate_subscripts(texts, 1) AS p]] FROM {rawocr}) AS e, LATERAL (SELECT CAST(e.p + [[1||0]] AS INT) AS pos) AS q) AS x WHERE trim(text) <> ''""")
device = Relation("F26 F27 F28", """
SELECT id, CASE WHEN lower(name) LIKE '%gpu%' OR lower(name) LIKE 'page%' THEN 'gpu:0' ELSE 'cpu' END AS device, [[lower(name) rlike 'cuda|cudnn|memory|page2'||regexp_matches(lower(name), 'cuda|cudnn|memory|page2')]] AS gpu_error,
  coalesce([[try_cast(regexp_extract(name, '[0-9]+', 0) AS INT)||TRY_CAST(regexp_extract(name, '[0-9]+', 0) AS INT)]], 8000) AS port FROM {names}""")
conjunction = Relation("F24", "SELECT grp, [[upper(min_by(regexp_extract(text, '^[A-Za-z]+', 0), ord))||upper(arg_min(regexp_extract(text, '^[A-Za-z]+', 0), ord))]] IN ('AND', 'BUT', 'OR', 'SO', 'THEN', 'ALSO') AS continues FROM {lines} GROUP BY grp")
tokens_file = Relation("S16", "SELECT id, name, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS token FROM {names}")
path_confined = Relation("S20 P25", "SELECT id, [[startswith(name, 'ch2/')||starts_with(name, 'ch2/')]] AND NOT contains(name, '..') AS confined FROM {names}")

numbers_diff = Relation("J22 U2 U3 F12", """
WITH n AS (SELECT *, [[regexp_extract_all(source, '[0-9]+', 0)||regexp_extract_all(source, '[0-9]+')]] AS a, [[regexp_extract_all(translated, '[0-9]+', 0)||regexp_extract_all(translated, '[0-9]+')]] AS b FROM {pairs})
SELECT id, [[array_join(sort_array(array_except(a, b)), ',')||array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ',')]] AS missing_numbers,
  [[arrays_overlap(array(source_lang, target_lang), array('en', 'zh'))||list_has_any([source_lang, target_lang], ['en', 'zh'])]] AS en_or_zh FROM n""")

QUERIES = {
    "q_safe_names": safe_names, "q_natural_sort": natural_sort, "q_ext_filter": extension, "q_batch_names": contains_name, "q_hex_color": hex_colour,
    "q_numbers_diff": numbers_diff, "q_zh_layout": zh_layout,
    "q_group_text": group_text, "q_wrap_estimate": wrap_estimate, "q_first_backend": first_backend, "q_ocr_unnest": unnest_ocr,
    "q_device": device, "q_conjunction": conjunction, "q_alphabet": tokens_file, "q_path_confined": path_confined,
    "q_safe_names_pages": (safe_names, {"names": "page_names"}), "q_ext_filter_pages": (extension, {"names": "page_names"}),
    "q_hex_color_pages": (hex_colour, {"colours": "page_colours"}), "q_numbers_diff_docs": (numbers_diff, {"pairs": "doc_pairs"}),
    "q_device_pages": (device, {"names": "page_names"}), "q_path_confined_pages": (path_confined, {"names": "page_names"}), "q_ocr_unnest_turns": (unnest_ocr, {"rawocr": "turn_raw"}),
    "q_first_backend_turns": (first_backend, {"backends": "turn_backends"}),
}
