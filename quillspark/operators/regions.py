"""Region operators: filters, votes, spatial joins, order, windows.

Confidences and shares are whole thousandths, so results are exact; list
position (``ord``) breaks every tie.
"""

from ..relation import Relation

_THR = """CASE WHEN engine = 'mit48' AND lang NOT IN ('zh', 'en') THEN {a} WHEN lang IN ('zh', 'en') THEN {b} ELSE {c} END"""
_TRANSLATE, _ERASE = _THR.format(a=200, b=550, c=500), _THR.format(a=0, b=250, c=500)
#: Overlap in thousandths of the smaller extent, and gap, along an axis.
_OVX = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0))"
_OVY = "greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_OVRX = f"({_OVX} * 1000 [[div||//]] greatest(1, least(a.x1 - a.x0, b.x1 - b.x0)))"
_OVRY = f"({_OVY} * 1000 [[div||//]] greatest(1, least(a.y1 - a.y0, b.y1 - b.y0)))"
_GAPX = "greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1))"
_GAPY = "greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1))"
_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"
_A, _B = _AREA.format("a"), _AREA.format("b")
_IOU = f"({_OVX} * {_OVY} * 1000 [[div||//]] ({_A} + {_B} - {_OVX} * {_OVY}))"
_MW, _MH = "greatest(a.x1 - a.x0, b.x1 - b.x0)", "greatest(a.y1 - a.y0, b.y1 - b.y0)"
_ADJACENT = f"""CASE WHEN coalesce(a.direction, b.direction) = 'v'
  THEN ({_OVRY} >= 450 AND 2 * {_GAPX} <= 3 * {_MW}) OR ({_OVRX} >= 500 AND 4 * {_GAPY} <= {_MH})
  ELSE ({_OVRX} >= 450 AND 2 * {_GAPY} <= 3 * {_MH}) OR ({_OVRY} >= 500 AND 4 * {_GAPX} <= {_MW}) END"""

_VOTE = """
WITH w AS (SELECT {key}, lang, sum(greatest(50, conf)) AS weight, min(ord) AS first FROM {{regions}} GROUP BY {key}, lang),
t AS (SELECT *, sum(weight) OVER (PARTITION BY {key}) AS total, row_number() OVER (PARTITION BY {key} ORDER BY weight DESC, first) AS rn, count(*) OVER (PARTITION BY {key}) AS n_langs FROM w)
SELECT {key}, lang, CAST(weight * 1000 [[div||//]] total AS BIGINT) AS share, CAST(least(990, greatest(450, weight * 1000 [[div||//]] total + 350)) AS BIGINT) AS confidence, CAST(n_langs AS BIGINT) AS n_langs
FROM t WHERE rn = 1"""
page_vote = Relation("A3 T7", _VOTE.format(key="page"))
consensus = Relation("A5", """
WITH h AS (SELECT page, lang, count(*) AS n, min(ord) AS first FROM {regions} WHERE conf >= 650 GROUP BY page, lang),
t AS (SELECT *, sum(n) OVER (PARTITION BY page) AS total, row_number() OVER (PARTITION BY page ORDER BY n DESC, first) AS rn FROM h)
SELECT page, lang, CAST(n AS BIGINT) AS votes, CAST(total AS BIGINT) AS total FROM t WHERE rn = 1 AND n >= 3 AND n * 10 >= total * 8""")
language_buckets = Relation("A6 O6", """
WITH f AS (SELECT page, lang, min(ord) AS first, count(*) AS n FROM {regions} GROUP BY page, lang)
SELECT page, lang, CAST(row_number() OVER (PARTITION BY page ORDER BY first) AS BIGINT) AS bucket, CAST(n AS BIGINT) AS n FROM f""")
thresholds = Relation("P5 P6", f"SELECT page, ord, conf, {_TRANSLATE} AS translate_from, {_ERASE} AS erase_from FROM {{regions}} WHERE conf >= {_TRANSLATE} AND lang <> 'zh'")
erase_only = Relation("P7 U1", f"""
WITH t AS (SELECT page, ord FROM {{regions}} WHERE conf >= {_TRANSLATE} AND lang <> 'zh')
SELECT r.page, r.ord, r.conf FROM {{regions}} r LEFT ANTI JOIN t ON r.page = t.page AND r.ord = t.ord WHERE conf >= {_ERASE}""".replace("LEFT ANTI", "[[LEFT ANTI||ANTI]]"))
text_plus_erase = Relation("U1", f"""
SELECT page, ord, 'text' AS kind FROM {{regions}} WHERE conf >= {_TRANSLATE} AND lang <> 'zh'
UNION ALL SELECT page, ord, 'erase' FROM {{regions}} WHERE NOT (conf >= {_TRANSLATE} AND lang <> 'zh') AND conf >= {_ERASE}""")
keep_all_if_empty = Relation("P24", """
WITH k AS (SELECT *, (x1 - x0) >= 3 * (y1 - y0) AS keep FROM {regions}),
a AS (SELECT *, bool_or(keep) OVER (PARTITION BY page) AS any_kept FROM k)
SELECT page, ord, keep FROM a WHERE keep OR NOT any_kept""")
box_sanity = Relation("P17 P18 P19 P20 P21", """
SELECT page, ord, (x1 - x0) >= 10 AND (y1 - y0) >= 8 AND 10 * (x1 - x0) <= 9 * 1200 AND 2 * (y1 - y0) <= 900 AND 10 * (x1 - x0) >= 3 * (y1 - y0) AND (x1 - x0) <= 15 * (y1 - y0) AS valid_box,
  10 * (x1 - x0) < 9 * 1200 AND 10 * (y1 - y0) < 9 * 900 AS not_giant, (x1 - x0) * (y1 - y0) > 16 AS big_enough, conf > 600 AS sure, least(x1 - x0, y1 - y0) >= 3 AS thick_enough FROM {regions}""")
drop_flagged = Relation("P8", "SELECT page, ord FROM {regions} WHERE NOT (conf < 100 AND direction = 'v')")
strip_band = Relation("P22 P23", """
SELECT page, ord, ((x1 - x0) >= 8 * (y1 - y0) AND 100 * (y1 - y0) <= 4 * 900) OR (direction = 'h' AND 2 * (x1 - x0) >= 1200 AND 20 * (y1 - y0) <= 900) AS strip,
  CASE WHEN lang IN ('en', 'zh') THEN 2 * (x1 - x0) >= 1200 AND 10 * (y1 - y0) <= 900 ELSE false END AS band FROM {regions}""")
iou_matrix = Relation("J17 G1 G2 G3", f"""
SELECT a.page, a.ord AS a, b.ord AS b, CAST({_IOU} AS BIGINT) AS iou, CAST({_OVX} * {_OVY} * 1000 [[div||//]] greatest(1, least({_A}, {_B})) AS BIGINT) AS overlap,
  CAST({_GAPX} AS BIGINT) AS gap_x, CAST({_GAPY} AS BIGINT) AS gap_y
FROM {{regions}} a JOIN {{regions}} b ON a.page = b.page AND a.ord < b.ord""")
adjacent = Relation("J15 A24", f"""
SELECT a.page, a.ord AS a, b.ord AS b, {_ADJACENT} AS adjacent FROM {{regions}} a JOIN {{regions}} b ON a.page = b.page AND a.ord < b.ord""")
adjacent_any = Relation("J15 A24", f"""
SELECT a.page, a.ord, bool_or({_ADJACENT}) AS has_neighbour, bool_and({_ADJACENT}) AS all_neighbours
FROM {{regions}} a JOIN {{regions}} b ON a.page = b.page AND a.ord <> b.ord GROUP BY a.page, a.ord""")
box_union = Relation("A10", "SELECT page, direction, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(count(*) AS BIGINT) AS n FROM {regions} GROUP BY page, direction")
compact = Relation("A11 G6", """
WITH u AS (SELECT page, direction, (max(x1) - min(x0)) * (max(y1) - min(y0)) AS area, sum((x1 - x0) * (y1 - y0)) AS total FROM {regions} GROUP BY page, direction)
SELECT page, direction, 10 * area <= 22 * total AS compact, area > 3 * total AS sparse, 10 * area <= 16 * total AS balloon_ok FROM u""")
padded = Relation("G7 G8 G10", """
SELECT page, ord, greatest(0, x0 - (x1 - x0) * 35 [[div||//]] 100) AS fx0, greatest(0, y0 - (y1 - y0) * 35 [[div||//]] 100) AS fy0,
  least(1200, x1 + (x1 - x0) * 35 [[div||//]] 100) AS fx1, least(900, y1 + (y1 - y0) * 35 [[div||//]] 100) AS fy1,
  greatest(0, x0 - greatest(4, CAST([[bround((x1 - x0) * 0.22D, 0)||round_even((x1 - x0) * 0.22::DOUBLE, 0)]] AS BIGINT))) AS sx0,
  greatest(0, y0 - greatest(4, CAST([[bround((y1 - y0) * 0.18D, 0)||round_even((y1 - y0) * 0.18::DOUBLE, 0)]] AS BIGINT))) AS sy0,
  greatest(0, x0 - (x1 - x0) [[div||//]] 2) AS vx0, x1 + (x1 - x0) [[div||//]] 2 AS vx1 FROM {regions}""")
contains = Relation("G4 G5", f"""
SELECT a.page, a.ord AS a, b.ord AS b, a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 AS contains,
  least(a.x1 + least(a.x1 - a.x0, a.y1 - a.y0) [[div||//]] 5, b.x1) > greatest(a.x0 - least(a.x1 - a.x0, a.y1 - a.y0) [[div||//]] 5, b.x0)
  AND least(a.y1 + least(a.x1 - a.x0, a.y1 - a.y0) [[div||//]] 5, b.y1) > greatest(a.y0 - least(a.x1 - a.x0, a.y1 - a.y0) [[div||//]] 5, b.y0) AS near_by
FROM {{regions}} a JOIN {{regions}} b ON a.page = b.page AND a.ord <> b.ord""")
nearest = Relation("J9 A.8", """
WITH d AS (SELECT f.page, f.ord AS fragment, m.ord AS main, (f.x0 + f.x1 - m.x0 - m.x1) * (f.x0 + f.x1 - m.x0 - m.x1) + (f.y0 + f.y1 - m.y0 - m.y1) * (f.y0 + f.y1 - m.y0 - m.y1) AS dist,
    CASE WHEN m.direction = 'v' THEN f.y0 + f.y1 >= m.y0 + m.y1 ELSE f.x0 + f.x1 >= m.x0 + m.x1 END AS append
  FROM {regions} f JOIN {regions} m ON f.page = m.page AND f.conf < 300 AND m.conf >= 300),
r AS (SELECT *, row_number() OVER (PARTITION BY page, fragment ORDER BY dist, main) AS rn FROM d)
SELECT page, fragment, main, dist, append FROM r WHERE rn = 1""")
nearest_merged = Relation("J9", """
WITH d AS (SELECT f.page, f.ord AS fragment, m.ord AS main, f.x0, f.y0, f.x1, f.y1,
    row_number() OVER (PARTITION BY f.page, f.ord ORDER BY (f.x0 + f.x1 - m.x0 - m.x1) * (f.x0 + f.x1 - m.x0 - m.x1) + (f.y0 + f.y1 - m.y0 - m.y1) * (f.y0 + f.y1 - m.y0 - m.y1), m.ord) AS rn
  FROM {regions} f JOIN {regions} m ON f.page = m.page AND f.conf < 300 AND m.conf >= 300),
p AS (SELECT page, main AS ord, x0, y0, x1, y1 FROM d WHERE rn = 1 UNION ALL SELECT page, ord, x0, y0, x1, y1 FROM {regions} WHERE conf >= 300)
SELECT page, ord, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(count(*) AS BIGINT) AS parts FROM p GROUP BY page, ord""")
reading_order = Relation("T3 T11 W1", """
SELECT page, direction, ord, CAST(row_number() OVER (PARTITION BY page, direction ORDER BY
  CASE WHEN direction = 'v' THEN -(x0 + x1) ELSE y0 END, CASE WHEN direction = 'v' THEN y0 ELSE x0 END, ord) AS BIGINT) AS place FROM {regions}""")
top_ranked = Relation("T9 T12 W3", """
WITH r AS (SELECT page, ord, conf, row_number() OVER (PARTITION BY page ORDER BY conf DESC, ord) AS rn FROM {regions}) SELECT page, ord, conf, CAST(rn AS BIGINT) AS place FROM r WHERE rn <= 3""")
#: In Spark one order serves all windows, and the best is found as they are grouped.
best_split = Relation("W9 A.7", """
[[WITH c AS (SELECT page, max(x1) OVER (PARTITION BY page ORDER BY x0 + x1, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS left_end,
  min(x0) OVER (PARTITION BY page ORDER BY x0 + x1, ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS right_start,
  row_number() OVER (PARTITION BY page ORDER BY x0 + x1, ord) AS i FROM {regions}),
g AS (SELECT page, max(struct(right_start - left_end AS gutter, -i AS i)) AS g FROM c WHERE right_start - left_end >= 6 GROUP BY page)
SELECT page, CAST(-g.i AS BIGINT) AS cut_after, g.gutter FROM g||WITH p AS (SELECT page, ord, x0, x1, y0, y1, row_number() OVER (PARTITION BY page ORDER BY x0 + x1, ord) AS i, count(*) OVER (PARTITION BY page) AS n FROM {regions}),
c AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS left_end,
  min(x0) OVER (PARTITION BY page ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS right_start FROM p),
g AS (SELECT page, i, right_start - left_end AS gutter, row_number() OVER (PARTITION BY page ORDER BY right_start - left_end DESC, i) AS rn FROM c WHERE i < n)
SELECT page, CAST(i AS BIGINT) AS cut_after, gutter FROM g WHERE rn = 1 AND gutter >= 6]]""")
direction_majority = Relation("A13", """
SELECT page, CAST(sum(CASE WHEN direction = 'v' THEN 1 ELSE 0 END) AS BIGINT) AS vertical, CAST(count(*) AS BIGINT) AS n,
  CASE WHEN sum(CASE WHEN direction = 'v' THEN 1 ELSE 0 END) * 2 > count(*) THEN 'v' WHEN sum(CASE WHEN direction = 'v' THEN 1 ELSE 0 END) * 2 < count(*) THEN 'h'
    WHEN max(y1) - min(y0) > max(x1) - min(x0) THEN 'v' ELSE 'h' END AS direction FROM {regions} GROUP BY page""")
sample_stats = Relation("A14 A19", """
SELECT lang, CAST(round([[median(conf)||median(conf)]] * 10) AS BIGINT) AS median10, CAST(round([[percentile(conf, 0.9)||quantile_cont(conf, 0.9)]] * 10) AS BIGINT) AS p90_10,
  CAST(round(stddev_pop(conf) * 1000) AS BIGINT) AS std1000, CAST(round(coalesce(avg(conf), 0) * 1000) AS BIGINT) AS mean1000 FROM {regions} GROUP BY lang""")
first_non_empty = Relation("A12", """
WITH r AS (SELECT page, ord, CASE WHEN conf >= 500 THEN lang ELSE '' END AS v FROM {regions}),
f AS (SELECT page, v, row_number() OVER (PARTITION BY page ORDER BY ord) AS rn FROM r WHERE v <> '')
SELECT p.page, coalesce(f.v, 'none') AS value FROM (SELECT DISTINCT page FROM r) AS p LEFT JOIN f ON p.page = f.page AND f.rn = 1""")
grouped_or_single = Relation("A17", """
SELECT page, coalesce(CASE WHEN conf >= 300 THEN CAST(ord % 2 AS BIGINT) END, -1 - ord) AS grp, CAST(count(*) AS BIGINT) AS n, max(conf) AS best FROM {regions}
GROUP BY page, coalesce(CASE WHEN conf >= 300 THEN CAST(ord % 2 AS BIGINT) END, -1 - ord)""")
geometry = Relation("G12 G13 G14", """
SELECT page, ord, (x0 + x1) AS cx2, (y0 + y1) AS cy2, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0) * 1000 [[div||//]] greatest(1, y1 - y0) AS aspect, least(x1 - x0, y1 - y0) AS font_size,
  CAST(round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) * 1000) AS BIGINT) AS diagonal, CAST(round((x0 + x1) * 500000.0 / 1200) AS BIGINT) AS yolo_x, CAST(round((y0 + y1) * 500000.0 / 900) AS BIGINT) AS yolo_y,
  x1 > x0 AND y1 > y0 AS valid FROM {regions}""")
rotated = Relation("G11 G9", """
SELECT page, ord, 1200 - 1 - y1 AS rx0, x0 AS ry0, 1200 - 1 - y0 AS rx1, x1 AS ry1, greatest(0, least(x0, 1200 - (x1 - x0))) AS clamped_x, greatest(0, least(y0, 900 - (y1 - y0))) AS clamped_y,
  least(greatest(28, x1 - x0), 1152) AS drag_w FROM {regions}""")
segment_distance = Relation("G14", """
SELECT a.page, a.ord AS a, b.ord AS b, CAST(round(sqrt(greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) * greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1))
  + greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) * greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1))) * 1000) AS BIGINT) AS rect_distance
FROM {regions} a JOIN {regions} b ON a.page = b.page AND a.ord < b.ord""")
resize = Relation("G19", """
SELECT page, ord, CAST(least(1000, 640000 [[div||//]] greatest(1, x1 - x0)) AS BIGINT) AS ratio, (640 - ((x1 - x0) * 640 [[div||//]] greatest(x1 - x0, y1 - y0))) [[div||//]] 2 AS pad_x, (640 - ((y1 - y0) * 640 [[div||//]] greatest(x1 - x0, y1 - y0))) [[div||//]] 2 AS pad_y FROM {regions}""")
tiles = Relation("G20 O13", """
WITH s AS (SELECT page, max(y1) * 12 AS h, 300 + page % 7 * 100 AS w FROM {regions} GROUP BY page),
p AS (SELECT *, greatest(2560 [[div||//]] w, 2) * w AS high FROM s WHERE 2 * h > 5 * 1280 AND h > 3 * w),
n AS (SELECT *, (h + high - 1) [[div||//]] high AS n FROM p)
SELECT page, CAST(i AS BIGINT) AS tile, CAST(CASE WHEN n > 1 THEN i * ((h - high) [[div||//]] greatest(1, n - 1)) ELSE 0 END AS BIGINT) AS top, CAST(high AS BIGINT) AS high FROM (SELECT page, h, high, n, [[explode(sequence(0, CAST(n - 1 AS INT)))||unnest(range(CAST(n AS BIGINT)))]] AS i FROM n) AS t""")
grid_boxes = Relation("M1", """
SELECT page, CAST(r.i AS BIGINT) AS row_no, CAST(c.i AS BIGINT) AS col_no, c.i * w [[div||//]] 3 AS x0, r.i * h [[div||//]] 3 AS y0
FROM (SELECT page, max(x1) AS w, max(y1) AS h FROM {regions} GROUP BY page) AS p, [[(SELECT explode(array(0, 1, 2)) AS i)||(SELECT unnest([0, 1, 2]) AS i)]] AS r, [[(SELECT explode(array(0, 1, 2)) AS i)||(SELECT unnest([0, 1, 2]) AS i)]] AS c""")
confidence_floor = Relation("M7 P21", "SELECT page, ord, greatest(conf, 850) AS floored FROM {regions} WHERE conf >= 200")
precision_recall = Relation("A20", """
WITH m AS (SELECT lang, sum(CASE WHEN conf >= 500 AND direction = 'h' THEN 1 ELSE 0 END) AS hit, sum(CASE WHEN conf >= 500 THEN 1 ELSE 0 END) AS det, sum(CASE WHEN direction = 'h' THEN 1 ELSE 0 END) AS gt FROM {regions} GROUP BY lang),
p AS (SELECT lang, CASE WHEN det = 0 THEN 0.0 ELSE hit * 1.0 / det END AS p, CASE WHEN gt = 0 THEN 1.0 ELSE hit * 1.0 / gt END AS r FROM m)
SELECT lang, CAST(round(p * 1e6) AS BIGINT) AS precision6, CAST(round(r * 1e6) AS BIGINT) AS recall6, CAST(round(CASE WHEN p + r = 0 THEN 0 ELSE 2.0 * CAST(p AS DOUBLE) * CAST(r AS DOUBLE) / CAST(p + r AS DOUBLE) END * 1e4) AS BIGINT) AS hmean4 FROM p""")
average_precision = Relation("A21", """
WITH r AS (SELECT page, ord, direction = 'h' AS hit, row_number() OVER (PARTITION BY page ORDER BY conf DESC, ord) AS k, sum(CASE WHEN direction = 'h' THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY conf DESC, ord ROWS UNBOUNDED PRECEDING) AS hits FROM {regions})
SELECT page, CAST(floor(sum(CASE WHEN hit THEN CAST(hits * 1000000 [[div||//]] k AS BIGINT) ELSE 0 END) / greatest(1, sum(CASE WHEN hit THEN 1 ELSE 0 END))) AS BIGINT) AS ap FROM r GROUP BY page""")
positional = Relation("J20", "SELECT a.page, a.ord, a.lang, b.conf AS other_conf FROM {regions} a JOIN {regions} b ON a.page = b.page AND b.ord = a.ord + 1")
members_only = Relation("J21", "SELECT page, ord FROM {regions} r [[LEFT SEMI||SEMI]] JOIN {terms} t ON r.lang = t.lang")
diagnostics = Relation("P1 W1 D9", """
SELECT doc_id, substring(text, 1, 160) AS preview, CAST([[bround(n_chars / 7.0D * 10000, 0)||round_even(n_chars / 7.0::DOUBLE * 10000, 0)]] AS BIGINT) AS confidence4, lang, length(text) AS n_text,
  CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS idx FROM {documents}""")
smooth = Relation("W8", """
SELECT id, batch, CASE WHEN sum(CASE WHEN status = 'processing' THEN 1 ELSE 0 END) OVER (PARTITION BY batch ORDER BY ts, id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= 2 THEN 1 ELSE 0 END AS smoothed FROM {tasks}""")
gaps = Relation("W6 W7 A.9", """
WITH s AS (SELECT id, batch, ts, status = 'processing' AS active, row_number() OVER (PARTITION BY batch ORDER BY ts, id) AS i FROM {tasks}),
e AS (SELECT *, CASE WHEN active = lag(active) OVER (PARTITION BY batch ORDER BY i) THEN 0 ELSE 1 END AS starts FROM s),
g AS (SELECT *, sum(starts) OVER (PARTITION BY batch ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM e),
r AS (SELECT batch, min(i) AS first, count(*) AS length FROM g WHERE NOT active GROUP BY batch, island),
b AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY length DESC, first) AS rn FROM r)
SELECT batch, CAST(first AS BIGINT) AS first, CAST(length AS BIGINT) AS length FROM b WHERE rn = 1""")

QUERIES = {
    "q_page_language_vote": page_vote, "q_page_consensus": consensus, "q_language_buckets": language_buckets,
    "q_threshold_filter": thresholds, "q_erase_only_anti": erase_only, "q_text_plus_erase": text_plus_erase, "q_keep_all_if_empty": keep_all_if_empty,
    "q_box_sanity": box_sanity, "q_drop_flagged": drop_flagged, "q_strip_band": strip_band, "q_overlap_pairs": iou_matrix,
    "q_adjacent_pairs": adjacent, "q_adjacent_any": adjacent_any, "q_box_union": box_union,
    "q_compact_groups": compact, "q_padded_boxes": padded, "q_contains_pairs": contains, "q_nearest_fragment": nearest, "q_nearest_merged": nearest_merged,
    "q_reading_order": reading_order, "q_top_ranked": top_ranked, "q_best_split": best_split,
    "q_direction_majority": direction_majority, "q_sample_stats": sample_stats, "q_first_non_empty": first_non_empty, "q_grouped_or_single": grouped_or_single,
    "q_geometry": geometry, "q_rotated_clamped": rotated, "q_rect_distance": segment_distance, "q_resize_numbers": resize, "q_tiles": tiles, "q_grid_boxes": grid_boxes,
    "q_confidence_floor": confidence_floor, "q_precision_recall": precision_recall, "q_average_precision": average_precision, "q_positional_zip": positional,
    "q_members_only": members_only, "q_smooth3": smooth, "q_ink_gaps": gaps,
}
