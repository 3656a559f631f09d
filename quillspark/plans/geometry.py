"""Queries over boxes whose Spark form is a DataFrame operator. Their SQL
compares all pairs, or steps through them, and knows nothing of that form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, fragments, ink, rasters, spatial, splits
from ..sources.frames import frame
from ..sources.shared import kept

Query = Callable[[SparkSession, str], DataFrame]


def _of(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(frame(spark, sf_dir, name))


def _kept(boxes: DataFrame) -> DataFrame:
    return spatial.uncovered(boxes, F.col("direction") == "v").select("page", "ord")


def _cells(boxes: DataFrame) -> DataFrame:
    return spatial.overlaps(boxes).select("page", "a", "b", "shared", F.expr("shared * 1000 div total").alias("iou"))


_SHEET = rasters.Layout(1536, 1600)


def _pairs(spark: SparkSession, sf_dir: str, masks: bool) -> DataFrame:
    """Pairs of a group of stacks that are near enough for any rule, and the dark
    lines between them; with ``masks`` of the balloons of even regions."""
    rows = frame(spark, sf_dir, "stacks").select("page", "grp", "turn", "ord", "direction", *rasters.BOX, (F.col("page") * 1000 + F.col("grp")).alias("sheet"))
    if masks:
        balloon = F.when(F.col("ord") % 2 == 0, F.array(F.struct(*((F.col(c) + (-40 if c[1] == "0" else 40)).alias(c) for c in rasters.BOX))))
        rows = rows.withColumn("mask", _SHEET.cut(balloon))
    # written, as pairs and corridors are made of them apart
    rows = kept(rows, "stacks")
    wide = lambda at: {c: at(c) + (-200 if c[1] == "0" else 200) for c in rasters.BOX}
    pairs = spatial.touching(rows, rows, ["sheet"], wide, wide).where("a.ord < b.ord")
    return rasters.separated(pairs, frame(spark, sf_dir, "rules"), same="sheet")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, True).select("a.page", "a.grp", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), "separated", rasters.pair_score(cut=True).alias("score"))


def _groups_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of a group's first turn against those of its second."""
    pairs = _pairs(spark, sf_dir, False).where("a.turn <> b.turn")
    return rasters.groups_separated(pairs.select(F.col("a.page").alias("page"), F.col("a.grp").alias("grp"), "separated"), ["page", "grp"])


def _evaluation(operator: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(frame(spark, sf_dir, "truth"), frame(spark, sf_dir, "found"))


QUERIES: dict[str, Query] = {
    "q_match_ground_truth": _evaluation(evaluation.matches),
    "q_page_quality": _evaluation(evaluation.evaluated),
    "q_dataset_ap": _evaluation(evaluation.average_precision),
    "q_pair_scores": _scores,
    "q_groups_separated": _groups_separated,
    "q_iou_antijoin": _of("regions", _kept),
    "q_strip_antijoin": _of("strip", _kept),
    "q_nms": _of("regions", lambda boxes: spatial.suppressed(boxes.select("page", "ord", *spatial.BOX, "conf", "lang")).select("page", "lang", "ord")),
    "q_region_overlaps": _of("regions", _cells),
    "q_strip_overlaps": _of("strip", _cells),
    "q_region_neighbours": _of("regions", spatial.adjacent_texts),
    "q_strip_neighbours": _of("strip", spatial.adjacent_texts),
    "q_side_by_side": _of("stacks", lambda boxes: splits.side_by_side(boxes, ["page", "grp"]).select("page", "grp", "ord", "part")),
    "q_separated_stacks": _of("stacks", lambda boxes: splits.separated(boxes, ["page", "grp"]).select("page", "grp", "ord", "half")),
    "q_ink_split": lambda spark, sf_dir: ink.split_lines(frame(spark, sf_dir, "ink_lines"), frame(spark, sf_dir, "ink_marks"), ["page", "ord"]),
    "q_fragments_merged": _of("turn_regions", fragments.merged_fragments),
}

_W, _H = "(least(a.x1, b.x1) - greatest(a.x0, b.x0))", "(least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_AREAS = "(a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)"
_MEET = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
#: 1.5 times the height of the highest box is less: no rule fits a pair beyond.
_NEAR = "a.y0 < b.y1 + 90 AND b.y0 < a.y1 + 90"


def _without_covered(boxes: str, same: str) -> str:
    return f"""SELECT page, ord FROM {boxes} a WHERE direction <> 'v' AND NOT EXISTS (
  SELECT 1 FROM {boxes} b WHERE {same}{_MEET} AND b.direction = 'v' AND {_W} * {_H} * 10 > 3 * ({_AREAS} - {_W} * {_H}))"""


def _matrix(boxes: str, same: str) -> str:
    return f"""SELECT a.page, a.ord AS a, b.ord AS b, CAST({_W} * {_H} AS BIGINT) AS shared, CAST({_W} * {_H} * 1000 // ({_AREAS} - {_W} * {_H}) AS BIGINT) AS iou
  FROM {boxes} a JOIN {boxes} b ON {same}a.ord < b.ord AND {_MEET}"""


def _neighbours(boxes: str, same: str) -> str:
    share = {x: f"greatest(0, least(a.{x}1, b.{x}1) - greatest(a.{x}0, b.{x}0))::DOUBLE / greatest(1, least(a.{x}1 - a.{x}0, b.{x}1 - b.{x}0))" for x in "xy"}
    gap = {x: f"greatest(0, greatest(a.{x}0, b.{x}0) - least(a.{x}1, b.{x}1))" for x in "xy"}
    most = {x: f"greatest(a.{x}1 - a.{x}0, b.{x}1 - b.{x}0)" for x in "xy"}
    upright = f"({share['y']} >= 0.45 AND {gap['x']} <= 1.5 * {most['x']}) OR ({share['x']} >= 0.5 AND {gap['y']} <= 0.25 * {most['y']})"
    level = f"({share['x']} >= 0.45 AND {gap['y']} <= 1.5 * {most['y']}) OR ({share['y']} >= 0.5 AND {gap['x']} <= 0.25 * {most['x']})"
    return f"""SELECT a.page, a.ord AS a, b.ord AS b, a.direction FROM {boxes} a JOIN {boxes} b ON {same}a.ord < b.ord AND {_NEAR}
  WHERE CASE WHEN a.direction = 'v' THEN {upright} ELSE {level} END"""


def _list(f: str, side: str, of: str) -> str:
    return f"list_{f}(list_transform({side}, lambda z: {of}))"


def _sides(axis: str) -> dict[str, str]:
    """Terms of a cut after k boxes of the list m."""
    other, left, right = "y" if axis == "x" else "x", "m[1:k]", "m[k + 1:]"
    low, high = (f"{_list('max', left, f'z.{other}1')}", f"{_list('max', right, f'z.{other}1')}")
    begin, start = f"{_list('min', left, f'z.{other}0')}", f"{_list('min', right, f'z.{other}0')}"
    return {
        "gutter": f"({_list('min', right, f'z.{axis}0')} - {_list('max', left, f'z.{axis}1')})",
        "share": f"(greatest(0, least({low}, {high}) - greatest({begin}, {start}))::DOUBLE / greatest(1, least({low} - {begin}, {high} - {start})))",
        "gap": f"((list_aggregate(list_transform({right}, lambda z: z.c), 'median') - list_aggregate(list_transform({left}, lambda z: z.c), 'median')) / 2)",
        "joins": " AND ".join(_list("min", side, "{'y': z.y0, 'x': z.x0, 'c': z.c, 'o': z.ord, 'j': z.j}") + ".j" for side in (left, right)),
        "compact": " AND ".join(f"(len({s}) = 1 OR greatest(1, ({_list('max', s, 'z.x1')} - {_list('min', s, 'z.x0')}) * ({_list('max', s, 'z.y1')} - {_list('min', s, 'z.y0')})) * 10 <= 22 * {_list('sum', s, 'greatest(1, (z.x1 - z.x0) * (z.y1 - z.y0))')})" for s in (left, right)),
        "high": "list_aggregate(list_transform(m, lambda z: greatest(1, z.y1 - z.y0)), 'median')", "wide": "list_aggregate(list_transform(m, lambda z: greatest(1, z.x1 - z.x0)), 'median')",
    }


def _best(first: int, last: str, valid: str, score: str) -> str:
    """The place of the best cut of the list m."""
    return f"(-(list_max(list_filter(list_transform(range({first}, {last}), lambda k: {{'s': {score}, 'k': -k, 'v': {valid}}}), lambda z: z.v)).k))"


_BOX = "{'c': x0 + x1, 'd': y0 + y1, 'ord': ord, 'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1, 'lang': lang, 'way': direction, 'j': upper(regexp_extract(ltrim(text), '^[A-Za-z]+')) IN ('AND', 'BUT', 'OR', 'SO', 'THEN', 'ALSO')}"
_X, _Y = _sides("x"), _sides("y")
_COLUMNS = _best(2, "len(m) - 1", f"{_X['gutter']} >= greatest(6.0, 0.3 * {_X['high']}) AND {_X['share']} >= 0.3 AND {_X['gap']} >= greatest(3.0 * {_X['high']}, 1.5 * {_X['gutter']}) AND NOT ({_X['joins']})",
                 f"{_X['gutter']} + {_X['gap']} * 0.25 + {_X['share']} * {_X['high']}")
_OPEN = "len(m) >= 4 AND len(list_filter(m, lambda z: z.way <> 'h')) = 0 AND len(list_filter(m, lambda z: z.lang IN ('en', 'zh'))) > 0"
_SIDE_BY_SIDE = f"""WITH RECURSIVE g AS (
  SELECT page, grp, part, m, CASE WHEN {_OPEN} THEN {_COLUMNS} END AS cut FROM (SELECT page, grp, '' AS part, list({_BOX} ORDER BY x0 + x1, ord) AS m FROM stacks GROUP BY page, grp) AS s
  UNION ALL
  SELECT page, grp, part, m, CASE WHEN {_OPEN} THEN {_COLUMNS} END FROM (SELECT page, grp, part || h AS part, CASE WHEN h = '0' THEN m[1:cut] ELSE m[cut + 1:] END AS m FROM g, (VALUES ('0'), ('1')) AS v(h) WHERE cut IS NOT NULL) AS s)
SELECT page, grp, unnest(list_transform(m, lambda z: z.ord)) AS ord, part FROM g WHERE cut IS NULL"""
_STACKS = f"""WITH g AS (SELECT page, grp, list({_BOX} ORDER BY x0 + x1, ord) AS m, list({_BOX} ORDER BY y0 + y1, ord) AS n, bool_and(direction = 'h') AS level, bool_and(direction = 'v') AS upright FROM stacks GROUP BY page, grp),
a AS (SELECT *, CASE WHEN len(m) >= 2 AND (level OR upright) THEN {_best(1, 'len(m)', f"{_X['gutter']} >= CASE WHEN upright THEN greatest(2.0, 0.6 * {_X['wide']}) ELSE greatest(2.0, 0.4 * {_X['high']}) END AND {_X['compact']} AND {_X['share']} >= 0.25", f"{_X['gutter']} + {_X['share']} * {_X['high']}")} END AS first FROM g),
b AS (SELECT page, grp, first, upright, m AS across, n AS m FROM a),
c AS (SELECT page, grp, first, across, m, CASE WHEN first IS NULL AND upright AND len(m) >= 2 THEN {_best(1, 'len(m)', f"{_Y['gutter']} >= greatest(2.0, 0.2 * {_Y['wide']}) AND {_Y['compact']} AND {_Y['share']} >= 0.25", f"{_Y['gutter']} + {_Y['share']} * {_Y['wide']}")} END AS second FROM b),
d AS (SELECT page, grp, coalesce(first, second) AS cut, CASE WHEN second IS NULL THEN across ELSE m END AS m FROM c)
SELECT page, grp, m[i].ord AS ord, CASE WHEN cut IS NULL THEN NULL WHEN i <= cut THEN '0' ELSE '1' END AS half FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM d) AS e"""
#: Column by column.
_INK = """WITH l AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM ink_lines), e AS (SELECT * FROM l WHERE w >= 80 AND h >= 8 AND w::DOUBLE / h >= 6 AND len(string_split(trim(text), ' ')) >= 3),
c AS (SELECT page, ord, w, h, unnest(range(w)) AS c FROM e),
d AS (SELECT c.page, c.ord, c.w, c.h, c.c, CASE WHEN count(m.a) > 0 THEN 1 ELSE 0 END AS dark FROM c LEFT JOIN ink_marks m ON m.page = c.page AND m.ord = c.ord AND m.a <= c.c AND c.c < m.b GROUP BY ALL),
s AS (SELECT *, dark + coalesce(lag(dark) OVER q, 0) + coalesce(lead(dark) OVER q, 0) >= 2 AS lit FROM d WINDOW q AS (PARTITION BY page, ord ORDER BY c)),
i AS (SELECT *, c - row_number() OVER (PARTITION BY page, ord, lit ORDER BY c) AS island FROM s),
r AS (SELECT page, ord, w, h, min(c) AS a, max(c) + 1 AS b FROM i WHERE NOT lit GROUP BY page, ord, w, h, island),
g AS (SELECT *, row_number() OVER (PARTITION BY page, ord ORDER BY b - a DESC, a) AS rn FROM r WHERE a >= greatest(4, round_even(h * 0.45::DOUBLE, 0)) AND b <= w - greatest(4, round_even(h * 0.45::DOUBLE, 0))),
x AS (SELECT g.page, g.ord, g.a, g.b, max(CASE WHEN s.c < g.a THEN s.c END) - min(CASE WHEN s.c < g.a THEN s.c END) + 1 AS l, max(CASE WHEN s.c >= g.b THEN s.c END) - min(CASE WHEN s.c >= g.b THEN s.c END) + 1 AS r
  FROM g JOIN s ON s.page = g.page AND s.ord = g.ord AND s.lit WHERE g.rn = 1 AND g.b - g.a >= greatest(8, round_even(g.h * 0.55::DOUBLE, 0)) GROUP BY g.page, g.ord, g.a, g.b, g.h HAVING least(l, r) >= greatest(16, round_even(g.h * 1.4::DOUBLE, 0))),
p AS (SELECT l.*, x.a, x.b, least(3, greatest(1, (x.b - x.a) // 4)) AS pad FROM l LEFT JOIN x USING (page, ord))
SELECT page, ord, NULL AS side, x0, y0, x1, y1 FROM p WHERE a IS NULL UNION ALL SELECT page, ord, 'left', x0, y0, least(x1, x0 + a + pad), y1 FROM p WHERE a IS NOT NULL UNION ALL SELECT page, ord, 'right', greatest(x0, x0 + b - pad), y0, x1, y1 FROM p WHERE a IS NOT NULL"""
#: One fragment of each page at a time.
_MAIN = "{'ord': ord, 'text': text, 'way': direction, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'parts': 1}"
_BEHIND = "CASE WHEN CASE WHEN z.way = 'v' THEN f.y0 + f.y1 >= z.y0 + z.y1 ELSE f.x0 + f.x1 >= z.x0 + z.x1 END THEN z.text || trim(f.text) ELSE trim(f.text) || z.text END"
_FRAGMENTS = f"""WITH RECURSIVE t AS (SELECT *, length(trim(text)) BETWEEN 1 AND 2 AND translate(trim(text), '{fragments.MARKS}', '') = '' AS frag FROM turn_regions),
f AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ord) AS i FROM t WHERE frag),
m AS (SELECT page, list({_MAIN} ORDER BY ord) AS m FROM t WHERE NOT frag GROUP BY page),
s AS (SELECT page, CAST(0 AS BIGINT) AS i, m FROM m
  UNION ALL SELECT f.page, f.i, list_transform(f.m, lambda z, j: CASE WHEN j = list_position(f.d, list_min(f.d)) THEN {{'ord': z.ord, 'text': {_BEHIND}, 'way': z.way, 'x0': least(z.x0, f.x0), 'y0': least(z.y0, f.y0), 'x1': greatest(z.x1, f.x1), 'y1': greatest(z.y1, f.y1), 'parts': z.parts + 1}} ELSE z END)
  FROM (SELECT f.*, s.m, list_transform(s.m, lambda z: (z.x0 + z.x1 - f.x0 - f.x1) * (z.x0 + z.x1 - f.x0 - f.x1) + (z.y0 + z.y1 - f.y0 - f.y1) * (z.y0 + z.y1 - f.y0 - f.y1)) AS d FROM s JOIN f ON f.page = s.page AND f.i = s.i + 1) AS f),
l AS (SELECT page, arg_max(m, i) AS m FROM s GROUP BY page)
SELECT page, z.ord, z.text, z.x0, z.y0, z.x1, z.y1, z.parts FROM (SELECT page, unnest(m) AS z FROM l) AS u
UNION ALL SELECT page, ord, text, x0, y0, x1, y1, 1 FROM t WHERE frag AND page NOT IN (SELECT page FROM m)"""
def _extent(r: str, k: str) -> str:
    return f"({r}.{k}1 - {r}.{k}0)"


def _adjacent_sql() -> str:
    share = {x: f"(greatest(0, least(a.{x}1, b.{x}1) - greatest(a.{x}0, b.{x}0))::DOUBLE / greatest(1, least(a.{x}1 - a.{x}0, b.{x}1 - b.{x}0)))" for x in "xy"}
    gap = {x: f"greatest(0, greatest(a.{x}0, b.{x}0) - least(a.{x}1, b.{x}1))" for x in "xy"}
    most = {x: f"greatest(a.{x}1 - a.{x}0, b.{x}1 - b.{x}0)" for x in "xy"}
    rule = lambda far, near: f"({share[near]} >= 0.45 AND {gap[far]} <= 1.5 * {most[far]}) OR ({share[far]} >= 0.5 AND {gap[near]} <= 0.25 * {most[near]})"
    return f"CASE WHEN a.direction = 'v' THEN {rule('x', 'y')} ELSE {rule('y', 'x')} END"


def _cell(r: str, c: str) -> str:
    """A side of a region's balloon, in cells of the sheet."""
    at = f"({r}.{c} - 40) // 8" if c[1] == "0" else f"({r}.{c} + 47) // 8"
    return f"least({_SHEET.words * 64 if c[0] == 'x' else _SHEET.rows}, greatest(0, {at}))"


_CELLS = {r: f"(({_cell(r, 'x1')} - {_cell(r, 'x0')}) * ({_cell(r, 'y1')} - {_cell(r, 'y0')}))" for r in "ab"}
_MET = " * ".join(f"greatest(0, least({_cell('a', k + '1')}, {_cell('b', k + '1')}) - greatest({_cell('a', k + '0')}, {_cell('b', k + '0')}))" for k in "xy")
_HULL = "((greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)))"
_BOXES = "(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"
_SUM = "(a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)"
_PAD = "(least(a.x1 - a.x0, a.y1 - a.y0) // 5)"
_NEARBY = f"greatest(0, least(a.x1 + {_PAD}, b.x1) - greatest(a.x0 - {_PAD}, b.x0)) * greatest(0, least(a.y1 + {_PAD}, b.y1) - greatest(a.y0 - {_PAD}, b.y0)) * 100 > 15 * greatest(1, least((a.x1 - a.x0 + 2 * {_PAD}) * (a.y1 - a.y0 + 2 * {_PAD}), (b.x1 - b.x0) * (b.y1 - b.y0)))"


def _corridor(k: str, o: str) -> str:
    """A.6 where a and b lie apart along k: None, false, or a look for a rule."""
    low, high, top, bottom = f"least(a.{k}1, b.{k}1)", f"greatest(a.{k}0, b.{k}0)", f"greatest(a.{o}0, b.{o}0)", f"least(a.{o}1, b.{o}1)"
    inside = {k: f"(least({high}, d.{k}1) - greatest({low}, d.{k}0))", o: f"(least({bottom}, d.{o}1) - greatest({top}, d.{o}0))"}
    return f"""CASE WHEN {bottom} - {top} < greatest(8, least({_extent('a', o)}, {_extent('b', o)}) // 4) THEN NULL WHEN {high} - {low} < 3 THEN false
    ELSE EXISTS (SELECT 1 FROM rules d WHERE d.page = a.page AND d.sheet = a.page * 1000 + a.grp AND {inside[k]} > 0 AND {inside[o]} > 0 AND {inside[o]} >= 6 AND {inside[o]} >= 0.45::DOUBLE * ({bottom} - {top}) AND {inside[k]} <= greatest(12, 0.45::DOUBLE * {inside[o]})) END"""


_PAIRS = f"""p AS (SELECT a.page, a.grp, a.ord AS a, b.ord AS b, a.turn <> b.turn AS across,
    CASE WHEN a.x1 <= b.x0 OR b.x1 <= a.x0 THEN {_corridor('x', 'y')} WHEN a.y1 <= b.y0 OR b.y1 <= a.y0 THEN {_corridor('y', 'x')} WHEN {_adjacent_sql()} THEN false END AS separated,
    CASE WHEN a.ord % 2 = 0 AND b.ord % 2 = 0 THEN CASE WHEN least({_CELLS['a']}, {_CELLS['b']}) = 0 OR {_MET} * 1000 // least({_CELLS['a']}, {_CELLS['b']}) < 550 OR {_HULL} * 10 > 16 * list_sum([{_SUM}]) THEN 0 ELSE 2000 + {_MET} * 1000 // least({_CELLS['a']}, {_CELLS['b']}) END
      WHEN {_HULL} * 10 > 16 * list_sum([{_SUM}]) OR NOT ({_adjacent_sql()}) THEN 0 WHEN {_BOXES} * 1000 // least({_SUM}) >= 450 THEN 1000 + {_BOXES} * 1000 // least({_SUM})
      WHEN (a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1) OR (b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1) THEN 1000 WHEN {_NEARBY} THEN 500 ELSE 0 END AS score
  FROM stacks a JOIN stacks b ON a.page = b.page AND a.grp = b.grp AND a.ord < b.ord AND a.x0 - 200 <= b.x1 + 200 AND b.x0 - 200 <= a.x1 + 200 AND a.y0 - 200 <= b.y1 + 200 AND b.y0 - 200 <= a.y1 + 200)"""
#: A pass over the true boxes of every page, one at a time.
_PASS = f"""WITH RECURSIVE g AS (SELECT DISTINCT b.page, b.ord FROM truth a JOIN found b ON a.page = b.page AND a.ignore AND {_MEET} AND {_W} * {_H} * 2 > (b.x1 - b.x0) * (b.y1 - b.y0)),
c AS (SELECT f.* FROM found f ANTI JOIN g ON g.page = f.page AND g.ord = f.ord),
p AS (SELECT a.page, a.ord AS truth, list(b.ord ORDER BY b.ord) AS may FROM truth a JOIN c b ON a.page = b.page AND NOT a.ignore AND {_MEET} AND {_W} * {_H} * 2 > {_AREAS} - {_W} * {_H} GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY truth) AS i FROM p),
s AS (SELECT page, truth, i, may[1] AS found, [may[1]] AS taken FROM n WHERE i = 1
  UNION ALL SELECT page, truth, i, free[1], list_concat(taken, free[1:1]) FROM (SELECT n.page, n.truth, n.i, s.taken, list_filter(n.may, lambda x: NOT list_contains(s.taken, x)) AS free FROM s JOIN n ON n.page = s.page AND n.i = s.i + 1) AS x),
m AS (SELECT page, truth, found FROM s WHERE found IS NOT NULL)"""
_QUALITY = f"""{_PASS}, x AS (SELECT page, sum(t) AS t, sum(f) AS f, sum(m) AS m FROM (SELECT page, CASE WHEN ignore THEN 0 ELSE 1 END AS t, 0 AS f, 0 AS m FROM truth UNION ALL SELECT page, 0, 0, 0 FROM found UNION ALL SELECT page, 0, 1, 0 FROM c UNION ALL SELECT page, 0, 0, 1 FROM m) AS u GROUP BY page)
SELECT page, CAST(m AS BIGINT) AS matched, CAST(t AS BIGINT) AS truth, CAST(f AS BIGINT) AS found, CAST(CASE WHEN t = 0 THEN CASE WHEN f > 0 THEN 0 ELSE 1000000 END WHEN f = 0 THEN 0 ELSE 1000000 * m // f END AS BIGINT) AS precision6,
  CAST(CASE WHEN t = 0 THEN 1000000 ELSE 1000000 * m // t END AS BIGINT) AS recall6, CAST(CASE WHEN t = 0 THEN CASE WHEN f > 0 THEN 0 ELSE 1000000 END ELSE 2000000 * m // (t + f) END AS BIGINT) AS hmean6 FROM x"""
_AP = f"""{_PASS}, r AS (SELECT CASE WHEN m.found IS NULL THEN 0 ELSE 1 END AS hit, row_number() OVER w AS k, sum(CASE WHEN m.found IS NULL THEN 0 ELSE 1 END) OVER w AS h FROM c LEFT JOIN m ON m.page = c.page AND m.found = c.ord WINDOW w AS (ORDER BY c.conf DESC, c.page, c.ord ROWS UNBOUNDED PRECEDING))
SELECT CAST(sum(hit) AS BIGINT) AS matched, (SELECT count(*) FROM truth WHERE NOT ignore) AS truth, count(*) AS found, CAST(sum(CASE WHEN hit = 1 THEN 1000000 * h // k ELSE 0 END) // (SELECT count(*) FROM truth WHERE NOT ignore) AS BIGINT) AS ap6 FROM r"""
_SAME = "a.page = b.page AND "
#: From the best box of each page on, one at a time.
_NMS = """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY page, lang ORDER BY conf DESC, ord) AS i FROM regions WHERE conf > 250),
s AS (SELECT page, lang, ord, i, true AS keep, [{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}] AS k FROM r WHERE i = 1
  UNION ALL SELECT page, lang, ord, i, free, CASE WHEN free THEN list_append(k, {'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}) ELSE k END FROM (
    SELECT r.*, s.k, len(list_filter(s.k, lambda z: greatest(0, least(r.x1, z.x1) - greatest(r.x0, z.x0)) * greatest(0, least(r.y1, z.y1) - greatest(r.y0, z.y0)) * 100
      > 45 * ((r.x1 - r.x0) * (r.y1 - r.y0) + (z.x1 - z.x0) * (z.y1 - z.y0) - greatest(0, least(r.x1, z.x1) - greatest(r.x0, z.x0)) * greatest(0, least(r.y1, z.y1) - greatest(r.y0, z.y0))))) = 0 AS free
    FROM s JOIN r ON r.page = s.page AND r.lang = s.lang AND r.i = s.i + 1) AS x)
SELECT page, lang, ord FROM s WHERE keep"""
#: Query -> (frames, SQL).
ORACLES: dict[str, tuple[tuple[str, ...], str]] = {
    "q_iou_antijoin": (("regions",), _without_covered("regions", _SAME)),
    "q_strip_antijoin": (("strip",), _without_covered("strip", "")),
    "q_region_overlaps": (("regions",), _matrix("regions", _SAME)),
    "q_strip_overlaps": (("strip",), _matrix("strip", "")),
    "q_region_neighbours": (("regions",), _neighbours("regions", _SAME)),
    "q_strip_neighbours": (("strip",), _neighbours("strip", "")),
    "q_side_by_side": (("turn_regions", "stacks"), _SIDE_BY_SIDE),
    "q_separated_stacks": (("turn_regions", "stacks"), _STACKS),
    "q_pair_scores": (("turn_regions", "stacks", "rules"), f"WITH {_PAIRS} SELECT page, grp, a, b, separated, CAST(CASE WHEN separated THEN 0 ELSE score END AS BIGINT) AS score FROM p"),
    "q_groups_separated": (("turn_regions", "stacks", "rules"), f"WITH {_PAIRS} SELECT page, grp, coalesce(bool_and(separated), false) AS separated FROM p WHERE across GROUP BY page, grp"),
    "q_match_ground_truth": (("regions", "truth", "found"), f"{_PASS} SELECT * FROM m"),
    "q_page_quality": (("regions", "truth", "found"), _QUALITY),
    "q_dataset_ap": (("regions", "truth", "found"), _AP),
    "q_nms": (("regions",), _NMS),
    "q_ink_split": (("turn_regions", "ink_marks", "ink_lines"), _INK),
    "q_fragments_merged": (("turn_regions",), _FRAGMENTS),
}
