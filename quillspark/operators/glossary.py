"""Glossary operators: search, mapping, changes with their uniqueness rule,
imports. Matching and replacing terms in texts: see ``terms``."""

from ..relation import Relation

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

search = Relation("S1 T1", f"SELECT id, source, target FROM {{terms}} WHERE NOT disabled AND lang = 'en' AND ({_FOLD.format('source')} LIKE '%th%' OR {_FOLD.format('target')} LIKE '%th%')")
mapping = Relation("S2 N5", """
WITH r AS (SELECT source, target, lang, row_number() OVER (PARTITION BY source, lang ORDER BY id DESC) AS rn FROM {terms} WHERE NOT disabled AND target_lang = 'zh') SELECT source, lang, target FROM r WHERE rn = 1""")
count_all = Relation("S5 K7", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN disabled THEN 1 ELSE 0 END) AS BIGINT) AS n_disabled FROM {terms}")
kv_get = Relation("S4", "SELECT value FROM {kv} WHERE key = 'schema'")
kv_upsert = Relation("K2", "SELECT coalesce(n.key, o.key) AS key, coalesce(n.value, o.value) AS value FROM {kv} o FULL OUTER JOIN {kv_new} n ON o.key = n.key")
seed_once = Relation("K7 S8", """
SELECT id, source FROM {terms} WHERE NOT EXISTS (SELECT 1 FROM {kv} WHERE key = 'other-seed') UNION ALL SELECT 100 + id, source FROM {terms} WHERE NOT EXISTS (SELECT 1 FROM {kv} WHERE key = 'seeded')""")
_NEW = "SELECT * FROM (VALUES ('the', 'THE-1', 'en', 'zh'), ('new', 'NEW', 'en', 'zh'), ('los', 'LOS', 'es', 'zh'), ('the', 'THE-3', 'en', 'zh')) AS v(source, target, lang, target_lang)"
create = Relation("K1 S7 D2", f"""
WITH n AS ({_NEW})
SELECT n.source, n.target, CASE WHEN t.id IS NULL THEN 'inserted' WHEN t.disabled THEN 'revived' ELSE 'rejected' END AS outcome
FROM n LEFT JOIN {{terms}} t ON n.source = t.source AND n.target = t.target AND n.lang = t.lang AND n.target_lang = t.target_lang""")
revivable = Relation("S7", f"WITH n AS ({_NEW}) SELECT t.id FROM {{terms}} t WHERE t.disabled AND EXISTS (SELECT 1 FROM n WHERE n.source = t.source AND n.target = t.target AND n.lang = t.lang)")
update = Relation("K3 D2", """
WITH c AS (SELECT count(*) AS n FROM {terms} WHERE source = 'the' AND target = 'THE-2' AND lang = 'en' AND target_lang = 'zh' AND id <> 1)
SELECT t.id, CASE WHEN t.id = 2 THEN 'thingy' ELSE t.source END AS source, CASE WHEN t.id = 1 AND c.n = 0 THEN 'THE-2' ELSE t.target END AS target, t.id = 1 AND c.n > 0 AS conflict FROM {terms} t CROSS JOIN c""")
delete = Relation("K4", "SELECT t.id, t.source FROM {terms} t [[LEFT ANTI||ANTI]] JOIN (SELECT id FROM {terms} WHERE id IN (2, 5)) g ON t.id = g.id")
bulk_update = Relation("K6 K8", "SELECT id, CASE WHEN note = '' THEN 'user' ELSE note END AS note, CAST(NULL AS BIGINT) AS added FROM {terms}")
import_rows = Relation("K5 A26", """
WITH r AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM {part}),
k AS (SELECT r.*, t.id IS NOT NULL AS known FROM r LEFT JOIN (SELECT DISTINCT source, min(id) AS id FROM {terms} GROUP BY source) t ON r.p_name = t.source)
SELECT p_name, p_partkey AS first_row FROM k WHERE rn = 1 AND NOT known""")
import_counts = Relation("K5 A26", """
SELECT CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS imported, CAST(sum(CASE WHEN rn > 1 THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM (SELECT row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM {part}) AS r""")
longest_first = Relation("T2", "SELECT id, source, CAST(row_number() OVER (ORDER BY length(source) DESC, id) AS BIGINT) AS place FROM {terms}")
phrase_hints = Relation("J8 F10", """
SELECT s.id, t.id AS term, t.target FROM {samples} s JOIN {terms} t ON contains(s.text, t.source) WHERE t.lang = 'ja'""")
language_code = Relation("J4", """
SELECT s.id, coalesce(c.code, 'unsupported') AS code FROM (SELECT DISTINCT id, lang FROM {terms}) s LEFT JOIN (SELECT * FROM (VALUES ('zh', 'zh-CN'), ('ja', 'ja'), ('en', 'en')) AS v(lang, code)) c ON s.lang = c.lang""")
cache_keys = Relation("D18 O8", "SELECT source_lang, target_lang, source, min(id) AS computed_by, CAST(count(*) AS BIGINT) AS uses FROM {pairs} GROUP BY source_lang, target_lang, source")

QUERIES = {
    "q_glossary_search": search, "q_glossary_mapping": mapping, "q_seed_count": count_all, "q_kv_get": kv_get, "q_kv_upsert": kv_upsert, "q_seed_once": seed_once, "q_create_or_reject": create,
    "q_revivable": revivable, "q_update_conflict": update, "q_delete": delete, "q_bulk_update": bulk_update, "q_import_dedupe": import_rows, "q_import_counts": import_counts,
    "q_longest_first": longest_first,
    "q_phrase_hints": phrase_hints, "q_provider_language": language_code, "q_cache_keys": cache_keys,
    "q_glossary_search_words": (search, {"terms": "word_terms"}), "q_glossary_mapping_parts": (mapping, {"terms": "part_terms"}), "q_seed_count_parts": (count_all, {"terms": "part_terms"}),
    "q_kv_upsert_events": (kv_upsert, {"kv": "kv_users", "kv_new": "kv_events"}), "q_cache_keys_docs": (cache_keys, {"pairs": "doc_pairs"}),
}
