"""Task, batch and export operators: status roll-ups, manifests, folds of
patches, histories, retries, and task deletion."""

from ..relation import Relation

#: A client asks for all tasks, for as many unknown ids, and for all tasks again. Positions are counted in ranges of ids; only the ranges' sums
#: are counted in one place.
batch_status_all = Relation("J1 P2 P4 N2 A.15", """
WITH u AS (SELECT id, p, id [[div||//]] 4096 AS part FROM (SELECT id, 0 AS p FROM {tasks} UNION ALL SELECT id + 100000000000, 1 FROM {tasks} UNION ALL SELECT id, 2 FROM {tasks}) AS a),
n AS (SELECT p, part, count(*) AS n FROM u GROUP BY p, part),
o AS (SELECT p, part, sum(n) OVER (ORDER BY p, part ROWS UNBOUNDED PRECEDING) - n AS skipped FROM n),
asked AS (SELECT CAST(o.skipped + row_number() OVER (PARTITION BY u.p, u.part ORDER BY u.id) AS BIGINT) AS pos, u.id FROM u JOIN o ON u.p = o.p AND u.part = o.part)
SELECT a.pos, a.id, coalesce(t.status, 'failed') AS status, coalesce(t.progress, 0) AS progress, CASE WHEN t.id IS NULL THEN 'task not found' END AS error,
  coalesce(nullif(t.k, 0), a.pos) AS idx, coalesce(nullif('', ''), 'auto') AS source_lang, coalesce(nullif('zh', ''), 'zh') AS target_lang
FROM asked a LEFT JOIN {tasks} t ON a.id = t.id""")
rollup = Relation("A1 A2 A24", """
SELECT batch, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS completed, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  CAST(count(*) - sum(CASE WHEN status IN ('completed', 'failed') THEN 1 ELSE 0 END) AS BIGINT) AS processing,
  CAST([[bround(avg(progress), 0)||round_even(avg(progress), 0)]] AS BIGINT) AS progress, CAST(floor(avg(progress) + 0.5) AS BIGINT) AS progress_client,
  bool_and(status = 'completed') AS all_done, bool_or(status = 'failed') AS any_failed FROM {tasks} GROUP BY batch""")
batch_label = Relation("A2b", """
SELECT batch, CASE WHEN sum(CASE WHEN status IN ('queued', 'processing') THEN 1 ELSE 0 END) > 0 THEN 'running' WHEN sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) = count(*) THEN 'all failed'
  WHEN sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) > 0 THEN 'partial' ELSE 'done' END AS label FROM {tasks} GROUP BY batch""")
active_ids = Relation("P27 S3", "SELECT id, status FROM {tasks} WHERE status NOT IN ('completed', 'failed')")
task_by_id = Relation("S3 N1", "SELECT id, status, progress, k FROM {tasks}")
manifest = Relation("J2 W2 F18 K12 K13", """
WITH f AS (SELECT page_id, name, [[regexp_replace(name, '[.][^.]*$', '')||regexp_replace(name, '[.][^.]*$', '')]] AS stem, bytes FROM {files}),
t AS (SELECT f.page_id, f.stem, f.bytes, coalesce(t.status, 'missing') AS status FROM f LEFT JOIN {tasks} t ON f.page_id = t.id),
n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY page_id) AS copy, row_number() OVER (ORDER BY page_id) AS idx FROM t WHERE status = 'completed')
SELECT page_id, CAST(idx AS BIGINT) AS idx, lpad(CAST(idx AS [[STRING||VARCHAR]]), 4, '0') || '_' || stem || CASE WHEN copy > 1 THEN '_' || CAST(copy AS [[STRING||VARCHAR]]) ELSE '' END || '_translated.png' AS file_name FROM n""")
manifest_errors = Relation("J2 K12", """
SELECT f.page_id, f.name, CASE WHEN t.id IS NULL THEN 'no such task' WHEN t.status = 'failed' THEN 'task failed' ELSE 'task not finished' END AS error
FROM {files} f LEFT JOIN {tasks} t ON f.page_id = t.id WHERE coalesce(t.status, 'none') <> 'completed'""")
#: All tasks are items, all are updated.
poll_merge_all = Relation("J3 X4", """
WITH items AS (SELECT id, 'item-' || CAST(id AS [[STRING||VARCHAR]]) AS name, 'queued' AS status FROM {tasks}),
updates AS (SELECT id, CASE WHEN status = 'completed' THEN 'page-' || CAST(id AS [[STRING||VARCHAR]]) ELSE 'upload' END AS name, status FROM {tasks})
SELECT i.id, CASE WHEN u.name IS NULL OR u.name = 'upload' THEN i.name ELSE u.name END AS name, coalesce(u.status, i.status) AS status FROM items i LEFT JOIN updates u ON i.id = u.id""")
retry_lineage = Relation("X5 P3", "SELECT id + 1000000 AS id, id AS retry_of, 'queued' AS status, k FROM {tasks} WHERE status = 'failed'")
partial_retry = Relation("X6", """
SELECT id, 'first pass' AS pass, status FROM {tasks} WHERE status <> 'failed'
UNION ALL SELECT id, 'second pass', CASE WHEN progress >= 50 THEN 'completed' ELSE 'failed' END FROM {tasks} WHERE status = 'failed'""")
last_n = Relation("W3 N6 D14", """
WITH r AS (SELECT batch, id, status, row_number() OVER (PARTITION BY batch ORDER BY ts DESC, id DESC) AS rn FROM {tasks})
SELECT batch, id, status, CAST(rn AS BIGINT) AS age FROM r WHERE rn <= CASE status WHEN 'failed' THEN 3 WHEN 'completed' THEN 20 ELSE 100 END""")
progress_steps = Relation("W4 W5 X8", """
WITH s AS (SELECT * FROM (VALUES (1, 'detect', 15), (2, 'ocr', 25), (3, 'inpaint', 15), (4, 'translate', 30), (5, 'render', 15)) AS t(step, name, weight)),
d AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM s),
p AS (SELECT t.id, d.name, CAST(floor((d.done * 100 + d.weight * t.progress) / 100.0) AS BIGINT) AS overall FROM {tasks} t JOIN d ON d.step = t.id % 5 + 1)
SELECT id, name, overall, CASE WHEN overall < 15 THEN 'detect' WHEN overall < 40 THEN 'ocr' WHEN overall < 55 THEN 'inpaint' WHEN overall < 85 THEN 'translate' ELSE 'render' END AS stage FROM p""")
patch_fold = Relation("K9 W16 X2", """
WITH p AS (SELECT id, batch, ts, CASE WHEN id % 3 = 0 THEN status END AS status, CASE WHEN id % 2 = 0 THEN progress END AS progress, CASE WHEN id % 5 = 0 THEN k END AS k FROM {tasks})
SELECT batch, [[max_by(status, struct(ts, id)) FILTER (WHERE status IS NOT NULL)||arg_max(status, (ts, id)) FILTER (WHERE status IS NOT NULL)]] AS status,
  [[max_by(progress, struct(ts, id)) FILTER (WHERE progress IS NOT NULL)||arg_max(progress, (ts, id)) FILTER (WHERE progress IS NOT NULL)]] AS progress,
  [[max_by(k, struct(ts, id)) FILTER (WHERE k IS NOT NULL)||arg_max(k, (ts, id)) FILTER (WHERE k IS NOT NULL)]] AS k FROM p GROUP BY batch""")
cascade_delete = Relation("K16 K4 K11", """
WITH gone AS (SELECT id FROM {tasks} WHERE status = 'failed' AND id % 2 = 0),
children AS (SELECT id, 'result' AS kind FROM {tasks} UNION ALL SELECT id, 'state' FROM {tasks} WHERE k > 5 UNION ALL SELECT id, 'history' FROM {tasks} WHERE progress > 90)
SELECT c.id, c.kind FROM children c [[LEFT ANTI||ANTI]] JOIN gone g ON c.id = g.id""")
gated_delete = Relation("K17", """
WITH d AS (SELECT batch, bool_and(status <> 'processing') AS all_deleted FROM {tasks} GROUP BY batch)
SELECT batch, substring(trim('  batch ' || CAST(batch AS [[STRING||VARCHAR]]) || '  '), 1, 80) AS name FROM d WHERE NOT all_deleted""")
undo = Relation("X9 P3", """
WITH v AS (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY ts, id) AS version, count(*) OVER (PARTITION BY batch) AS n FROM {tasks}) SELECT batch, id, CAST(version AS BIGINT) AS version FROM v WHERE version = greatest(1, n - 1)""")
performance = Relation("A15 A16 D10", """
SELECT batch, CAST(sum(CASE WHEN status = 'failed' THEN k ELSE 0 END) AS BIGINT) AS ocr_ms, CAST(sum(CASE WHEN status = 'completed' THEN k ELSE 0 END) AS BIGINT) AS translate_ms,
  CAST(greatest(0, max(progress) * 10 - sum(k)) AS BIGINT) AS other_ms, bool_or(status = 'failed') AS fallback FROM {tasks} GROUP BY batch""")
ordered_distinct = Relation("A7", "SELECT batch, status, min(id) AS first FROM {tasks} GROUP BY batch, status")
sorted_distinct = Relation("A8", "SELECT batch, [[array_join(sort_array(collect_set(status)), ',')||array_to_string(list_sort(list(DISTINCT status)), ',')]] AS statuses FROM {tasks} GROUP BY batch")
json_meta = Relation("N1 N2 S3", "SELECT id, coalesce(k, -1) AS k, coalesce([[get_json_object(meta, '$.missing')||json_extract_string(meta, '$.missing')]], 'default') AS missing FROM {tasks}")
manifest_json = Relation("K13 N1", """
SELECT batch, '[' || [[array_join(transform(sort_array(collect_list(struct(id, status))), x -> to_json(x)), ',')||array_to_string(list_transform(list_sort(list({'id': id, 'status': status})), lambda x: '{"id":' || x.id || ',"status":"' || x.status || '"}'), ',')]] || ']' AS manifest FROM {tasks} GROUP BY batch""")
map_merge = Relation("U4 P3 N5", """
SELECT id, [[map_zip_with(map('k', k, 'progress', 0L), map('progress', progress), (key, a, b) -> coalesce(b, a))['progress']||map_concat(MAP {'k': k, 'progress': 0::BIGINT}, MAP {'progress': progress})['progress']]] AS right_wins,
  coalesce(k, progress) AS left_wins FROM {tasks}""")
chunk16 = Relation("W11 O7", """
WITH r AS (SELECT id, batch, row_number() OVER (PARTITION BY batch ORDER BY id) AS rn FROM {tasks}) SELECT batch, id, CAST((rn - 1) [[div||//]] 16 AS BIGINT) AS chunk FROM r""")
total_bytes = Relation("A23 P25 S12", """
SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS total, count(*) <= 100 AS count_ok, sum(bytes) <= 500 * 1024 * 1024 AS total_ok, max(bytes) <= 10 * 1024 * 1024 AS each_ok,
  CASE WHEN count(*) > 100 THEN 400 WHEN max(bytes) > 10 * 1024 * 1024 OR sum(bytes) > 500 * 1024 * 1024 THEN 413 ELSE 200 END AS status FROM {files}""")
folder_import = Relation("S15 S15b P26 S14", """
SELECT CASE WHEN [[lower(name) rlike '[.](png|jpg|jpeg|webp|html)$'||regexp_matches(lower(name), '[.](png|jpg|jpeg|webp|html)$')]] THEN CASE WHEN bytes > 4000 THEN 'too large' ELSE 'ok' END ELSE 'invalid' END AS verdict, CAST(count(*) AS BIGINT) AS n
FROM {files} GROUP BY CASE WHEN [[lower(name) rlike '[.](png|jpg|jpeg|webp|html)$'||regexp_matches(lower(name), '[.](png|jpg|jpeg|webp|html)$')]] THEN CASE WHEN bytes > 4000 THEN 'too large' ELSE 'ok' END ELSE 'invalid' END""")

QUERIES = {
    "q_batch_status_all": batch_status_all, "q_poll_merge_all": poll_merge_all, "q_batch_rollup": rollup, "q_batch_label": batch_label, "q_active_ids": active_ids, "q_task_by_id": task_by_id,
    "q_zip_errors": manifest_errors, "q_retry_lineage": retry_lineage, "q_partial_retry": partial_retry, "q_last_n_history": last_n,
    "q_progress_steps": progress_steps, "q_patch_fold": patch_fold, "q_cascade_delete": cascade_delete, "q_gated_delete": gated_delete, "q_undo": undo, "q_perf_rollup": performance,
    "q_ordered_distinct": ordered_distinct, "q_sorted_distinct": sorted_distinct, "q_json_meta": json_meta, "q_manifest_json": manifest_json, "q_map_merge": map_merge,
    "q_chunk16": chunk16, "q_upload_validation": total_bytes, "q_folder_import": folder_import,
}
