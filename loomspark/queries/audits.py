"""Audits that fail closed, scores of sequences, and what follows from failed gates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loomspark.functions.scalar import rounded
from loomspark.operators import audits, scores, series
from loomspark.queries import query, read
from loomspark.queries.timelines import E, WRAP

_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def _part(first, n, by=1.0):
    return F.array(*(F.col("e")[first + k] * by for k in range(n)))


def _rounded(rows, *names, places=5):
    return rows.select(*(F.round(c, places).alias(c) if c in names else c for c in rows.columns))


@query(
    f"""WITH {_V}, u AS (SELECT *, list_transform(e[1:16], lambda x: x / sqrt(list_sum(list_transform(e[1:16], lambda y: y * y)))) AS q FROM v),
l AS (SELECT vec_id, label, q, lag(q) OVER (PARTITION BY label ORDER BY vec_id) AS p, count(*) OVER (PARTITION BY label) AS n FROM u)
SELECT vec_id, round(CASE WHEN p IS NOT NULL THEN least(greatest((list_dot_product(q, p) + 1) / 2, 0), 1) WHEN n = 1 THEN 1.0 END, 5) AS score FROM l"""
)
def adjacent_cosines(spark, d):
    """The likeness of each vector with the one before it of the same label."""
    part = F.slice("e", 1, 16)
    size = F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x))
    rows = _vectors(spark, d).select("vec_id", "label", F.transform(part, lambda x: x / size).alias("q"))
    return _rounded(scores.adjacent_cosines(rows, ["label"], "vec_id", "q").select("vec_id", "score"), "score")


@query(
    f"""WITH {_V}, s AS (SELECT label, vec_id, unnest(range(8)) AS k, unnest(e[1:8]) * 100 AS t, unnest(e[9:16]) * 100 AS c, unnest(list_transform(e[17:24], lambda x: x > 0)) AS m FROM v),
d AS (SELECT label, vec_id, k, abs(t - lag(t) OVER w) AS t, abs(c - lag(c) OVER w) AS c, m OR lag(m) OVER w AS live FROM s WINDOW w AS (PARTITION BY label, k ORDER BY vec_id)),
f AS (SELECT label, vec_id, avg(t) AS mt, avg(c) AS mc, avg(t) FILTER (WHERE live) AS ta, avg(c) FILTER (WHERE live) AS ac, avg(abs(t - c)) FILTER (WHERE live) AS gap FROM d WHERE t IS NOT NULL GROUP BY 1, 2)
SELECT label, round(exp(-avg(abs(mc - mt)) / greatest(avg(mt), 0.001)), 5) AS profile, round(CASE WHEN avg(ta) IS NULL THEN 0 ELSE exp(-avg(abs(ac - ta)) / (avg(ta) + 5)) END, 5) AS adherence, round(avg(exp(-gap / 32)), 5) AS similarity FROM f GROUP BY 1"""
)
def motion_likeness(spark, d):
    """How alike two parts of each label's vectors move from one vector to the next."""
    rows = _vectors(spark, d).select("label", "vec_id", _part(0, 8, 100.0).alias("t"), _part(8, 8, 100.0).alias("c"), F.transform(_part(16, 8), lambda x: x > 0).alias("m"))
    return _rounded(scores.motion_likeness(rows, ["label"], "vec_id", "t", "c", "m"), "profile", "adherence", "similarity")


_K = [math.exp(-0.5 * (k / 1.0) ** 2) for k in range(-3, 4)]
_SMOOTH = " + ".join(
    f"{w / sum(_K)!r} * coalesce({'lag' if k < 0 else 'lead'}(m, {abs(k)}) OVER w, {'first' if k < 0 else 'last'}_value(m) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))" for k, w in zip(range(-3, 4), _K, strict=True)
)


@query(
    f"""{E}, s AS (SELECT user_id, i, value - 50 AS dx, 30 * cos(i * 0.7) AS dy FROM e), r AS (SELECT user_id, i, sqrt(dx * dx + dy * dy) >= 20 AS reliable, atan2(dy, dx) AS raw FROM s),
t AS (SELECT user_id, i, coalesce({WRAP.format('raw - lag(raw) OVER (PARTITION BY user_id ORDER BY i)')}, raw) AS turn FROM r WHERE reliable), u AS (SELECT user_id, i, sum(turn) OVER (PARTITION BY user_id ORDER BY i) AS a FROM t),
j AS (SELECT r.user_id, r.i, reliable, a, CASE WHEN a IS NOT NULL THEN r.i END AS known FROM r LEFT JOIN u ON u.user_id = r.user_id AND u.i = r.i),
b AS (SELECT *, last_value(a IGNORE NULLS) OVER p AS a0, last_value(known IGNORE NULLS) OVER p AS t0, first_value(a IGNORE NULLS) OVER n AS a1, first_value(known IGNORE NULLS) OVER n AS t1 FROM j
  WINDOW p AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT user_id, i, reliable, CASE WHEN a0 IS NULL THEN a1 WHEN a1 IS NULL OR t0 = t1 THEN a0 ELSE a0 + (a1 - a0) * (i - t0) / (t1 - t0) END AS f FROM b),
m AS (SELECT user_id, i, reliable, median(f) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM f)
SELECT user_id, CAST(i AS BIGINT) AS i, reliable, round({_SMOOTH}, 4) AS angle FROM m WINDOW w AS (PARTITION BY user_id ORDER BY i)"""
)
def steady_angles(spark, d):
    """The direction of a vector made of each event's value and place, of short ones from those around."""
    rows = series.with_ordinal(read(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    rows = rows.select("user_id", "i", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.col("value") - 50).alias("u"), (30 * F.cos(F.col("i") * 0.7)).alias("v"))
    found = scores.steady_angles(rows, ["user_id"], "i", ["x", "y"], ["u", "v"], 20.0, 2, 1.0)
    return found.select("user_id", F.col("i").cast("long").alias("i"), "reliable", F.round("angle", 4).alias("angle"))


def _product(a, b):
    w1, x1, y1, z1 = (f"{a}[{i}]" for i in range(1, 5))
    w2, x2, y2, z2 = (f"{b}[{i}]" for i in range(1, 5))
    raw = f"[{w1}*{w2} - {x1}*{x2} - {y1}*{y2} - {z1}*{z2}, {w1}*{x2} + {x1}*{w2} + {y1}*{z2} - {z1}*{y2}, {w1}*{y2} - {x1}*{z2} + {y1}*{w2} + {z1}*{x2}, {w1}*{z2} + {x1}*{y2} - {y1}*{x2} + {z1}*{w2}]"
    return f"list_transform([{raw}], lambda q: list_transform(q, lambda x: x / sqrt(q[1]*q[1] + q[2]*q[2] + q[3]*q[3] + q[4]*q[4])))[1]"


@query(
    f"""WITH {_V}, n AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, e[1] AS x, e[2] AS dx, list_transform(e[3:6], lambda y: y / sqrt(list_sum(list_transform(e[3:6], lambda z: z * z)))) AS q, list_transform(e[7:10], lambda y: y / sqrt(list_sum(list_transform(e[7:10], lambda z: z * z)))) AS dq FROM v),
a AS (SELECT label, x AS sx, dx AS ax, q AS sq, [dq[1], -dq[2], -dq[3], -dq[4]] AS back FROM n WHERE i = 4), m AS (SELECT n.label, i, sx + dx - ax AS x, sq, {_product('back', 'dq')} AS turn FROM n JOIN a USING (label) WHERE i >= 5)
SELECT label, i, round(x, 5) AS x, list_transform(q, lambda y: round(y, 5)) AS q FROM n WHERE i < 5 UNION ALL SELECT label, i, round(x, 5), list_transform({_product('sq', 'turn')}, lambda y: round(y, 5)) FROM m"""
)
def rebased_turns(spark, d):
    """Five rows of each label's own motion, then another motion as seen from its last row before."""
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda v: F.transform(v, lambda x: x / size(v))
    rows = _vectors(spark, d).withColumn("i", F.expr("row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1").cast("long"))
    source, donor = (rows.select("label", "i", F.col("e")[k].alias("x"), unit(F.slice("e", at, 4)).alias("q")) for k, at in ((0, 3), (1, 7)))
    found = scores.rebased_turns(source, donor, ["label"], "i", 5, ["x"], ["q"])
    return found.select("label", "i", rounded(F.col("x"), 5).alias("x"), F.transform("q", lambda y: rounded(y, 5)).alias("q"))


_BODIES = {"arm": ([[1.0, 0.5, 0.0], [0.0, -1.0, 2.0], [0.25, 0.25, 0.25]], [0.1, 0.0, -0.1]), "hand": ([[2.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [0.0, 1.0])}


@query(
    f"""WITH {_V} SELECT vec_id, 'arm' AS body, [round(0.1 + e[1] + 0.5 * e[2], 5), round(2 * e[3] - e[2], 5), round((e[1] + e[2] + e[3]) / 4 - 0.1, 5)] AS actions, [true, true, true] AS valid FROM v
UNION ALL SELECT vec_id, 'hand', [round(2 * e[1], 5), round(1 + e[3], 5), 0.0], [true, true, false] FROM v"""
)
def fan_out(spark, d):
    """Each vector's first three numbers as actions of two bodies of three and two joints."""
    found = scores.fan_out(_vectors(spark, d).select("vec_id", F.slice("e", 1, 3).alias("x")), "x", _BODIES)
    return found.select("vec_id", "body", F.transform("actions", lambda x: rounded(x, 5)).alias("actions"), "valid")


@query(
    """SELECT s_suppkey, CAST(c AS INTEGER) AS combination, ['left', 'right', 'both'][c // 2 + 1] AS fold, ['table', 'air'][c % 2 + 1] AS place FROM supplier, range(6) r(c)"""
)
def frozen_product(spark, d):
    """Every supplier with three folds and two places in their order."""
    return scores.frozen_product(read(spark, d, "supplier").select("s_suppkey"), {"fold": ["left", "right", "both"], "place": ["table", "air"]})


_RULES = audits.TrajectoryContract(limits=[(-3.0, 3.0)] * 3, fps=30.0, most_velocity=150.0, least_confidence=0.05, least_visible=1, least_frames=12, least_groups=3, most_error=0.6, least_overlap=0.2, most_joint_deviation=0.5, most_shift_deviation=0.5, least_margin=-0.5)


@query(
    f"""WITH {_V}, f AS (SELECT vec_id % 6 AS run, vec_id AS frame, vec_id % 3 = 0 AS fit, 'g' || label % 4 AS grp, e FROM v),
p AS (SELECT run, frame, unnest(range(4)) AS k, unnest([e[10], e[14], e[18], e[22]]) AS x, unnest([e[11], e[15], e[19], e[23]]) AS y, unnest([e[12], e[16], e[20], e[24]]) AS u, unnest([e[13], e[17], e[21], e[25]]) AS w, unnest([e[26], e[27], e[28], e[29]]) AS c FROM f),
s AS (SELECT run, frame, count_if(abs(c) >= 0.05) AS seen, sqrt(avg((u - x)**2 + (w - y)**2) FILTER (WHERE abs(c) >= 0.05)) AS err FROM p GROUP BY 1, 2),
q AS (SELECT f.run, f.frame, fit, grp, seen, coalesce(err, 'inf'::DOUBLE) AS err, 0.5 + e[31] AS overlap, CASE WHEN err IS NULL THEN '-inf'::DOUBLE ELSE least(0.3 + abs(e[32]), 0.3 + abs(e[33])) - err END AS margin,
  greatest(abs(e[4]), abs(e[5]), abs(e[6])) AS qd, greatest(abs(e[7]), abs(e[8]), abs(e[9])) AS td, greatest(abs(e[1]), abs(e[2]), abs(e[3])) * 5 <= 3 AS inside,
  greatest(abs(e[1] - lag(e[1]) OVER o), abs(e[2] - lag(e[2]) OVER o), abs(e[3] - lag(e[3]) OVER o)) * 5 * 30 / (f.frame - lag(f.frame) OVER o) AS speed FROM f JOIN s ON s.run = f.run AND s.frame = f.frame WINDOW o AS (PARTITION BY f.run ORDER BY f.frame)),
g AS (SELECT run, grp, count(*) AS frames, quantile_cont(err, 0.95) AS p95 FROM q WHERE NOT fit GROUP BY 1, 2),
a AS (SELECT run, count(*) AS frames, CAST(min(seen) AS BIGINT) AS visible_least, CAST(count_if(NOT fit) AS BIGINT) AS heldout_frames, coalesce(list_sort(list(DISTINCT grp) FILTER (WHERE NOT fit)), []) AS heldout_groups, quantile_cont(err, 0.95) FILTER (WHERE NOT fit) AS error_p95,
  quantile_cont(overlap, 0.05) FILTER (WHERE NOT fit) AS overlap_p05, max(qd) AS qd, max(td) AS td, quantile_cont(margin, 0.05) FILTER (WHERE NOT fit) AS margin_p05, bool_and(inside) AS inside, max(speed) AS speed FROM q GROUP BY 1),
h AS (SELECT a.*, list_filter([CASE WHEN run = 5 THEN 'source_video_hash_bound' END, CASE WHEN run = 4 THEN 'exact_asset_hashes_match_registry' END, CASE WHEN NOT inside THEN 'joint_limits_passed' END, CASE WHEN speed > 150 THEN 'joint_velocity_passed' END, CASE WHEN run = 3 THEN 'proper_camera_from_robot_base_se3' END,
  CASE WHEN visible_least < 1 THEN 'visible_keypoint_coverage' END, CASE WHEN heldout_frames < 12 THEN 'heldout_frame_count' END, CASE WHEN len(heldout_groups) < 3 THEN 'heldout_group_count' END, CASE WHEN coalesce(error_p95 > 0.6, true) THEN 'heldout_reprojection_bounded' END, CASE WHEN coalesce(overlap_p05 < 0.2, true) THEN 'heldout_silhouette_iou_bounded' END,
  CASE WHEN qd > 0.5 THEN 'full_q_posterior_observable' END, CASE WHEN td > 0.5 THEN 'metric_base_translation_observable' END, CASE WHEN coalesce(margin_p05 < -0.5, true) THEN 'selected_asset_beats_alternatives' END], lambda z: z IS NOT NULL) AS failed FROM a)
SELECT run, frames, visible_least, heldout_frames, heldout_groups, round(error_p95, 5) AS error_p95, round(overlap_p05, 5) AS overlap_p05, round(qd, 5) AS joint_deviation, round(td, 5) AS shift_deviation, round(margin_p05, 5) AS margin_p05,
  coalesce((SELECT list(round(g.p95, 5) ORDER BY g.grp) FROM g WHERE g.run = h.run), []) AS group_errors, failed, NOT list_has_any(failed, ['joint_limits_passed', 'joint_velocity_passed', 'proper_camera_from_robot_base_se3', 'visible_keypoint_coverage']) AS proposal_passed, len(failed) = 0 AS passed FROM h"""
)
def heldout_trajectory(spark, d):
    """Vectors as frames of six runs with joints, points, deviations and alternatives, two thirds of them held out."""
    e = F.col("e")
    turn = F.when(F.col("vec_id") % 6 == 3, 1.001).otherwise(1.0)
    c, s = F.cos(e[33]) * turn, F.sin(e[33]) * turn
    zero, one = F.lit(0.0), F.lit(1.0)
    point = lambda k: F.struct(e[9 + 4 * k].alias("x"), e[10 + 4 * k].alias("y"), e[11 + 4 * k].alias("u"), e[12 + 4 * k].alias("v"), F.abs(e[25 + k]).alias("confidence"))
    frames = _vectors(spark, d).select(
        (F.col("vec_id") % 6).alias("run"), F.col("vec_id").alias("frame"), (F.col("vec_id") % 3 == 0).alias("fit"), F.concat(F.lit("g"), F.col("label") % 4).alias("group"), _part(0, 3, 5.0).alias("joints"),
        F.transform(_part(3, 3), F.abs).alias("joint_deviation"), F.transform(_part(6, 3), F.abs).alias("shift_deviation"), F.array(c, -s, zero, e[34], s, c, zero, e[35], zero, zero, one, e[36], zero, zero, zero, one).alias("pose"),
        F.array(*map(point, range(4))).alias("points"), (e[30] + 0.5).alias("overlap"), F.array(F.abs(e[31]) + 0.3, F.abs(e[32]) + 0.3).alias("alternatives"),
    )
    assets = F.create_map(F.lit("hand"), F.lit("h1"), F.lit("base"), F.lit("b1"))
    other = F.create_map(F.lit("base"), F.lit("b1"), F.lit("hand"), F.when(F.col("run") == 4, "h2").otherwise("h1"))
    bindings = frames.select("run").distinct().select("run", F.lit("s").alias("source"), F.when(F.col("run") == 5, "t").otherwise("s").alias("expected_source"), assets.alias("assets"), other.alias("expected_assets"))
    found = audits.heldout_trajectory(frames, bindings, ["run"], _RULES).drop("orthogonality").withColumn("visible_least", F.col("visible_least").cast("long"))
    found = found.withColumn("group_errors", F.transform("group_errors", lambda g: F.round(g["error_p95"], 5)))
    return _rounded(found, "error_p95", "overlap_p05", "joint_deviation", "shift_deviation", "margin_p05")


@query(
    f"""WITH {_V}, f AS (SELECT vec_id % 5 AS scene, vec_id AS frame, label % 3 AS grp, list_transform(e[1:12], lambda x: x + 0.15 + (vec_id % 5) * 0.05) AS depths, e FROM v), x AS (SELECT scene, frame, grp, unnest(depths) AS x FROM f),
s AS (SELECT scene, grp, median(x) AS m FROM x WHERE x > 0 GROUP BY 1, 2), p AS (SELECT scene, (max(m) - min(m)) / greatest(abs(median(m)), 1e-12) AS spread FROM s GROUP BY 1), y AS (SELECT scene, count_if(x > 0) / count(*) AS valid FROM x GROUP BY 1),
g AS (SELECT *, frame - lag(frame) OVER (PARTITION BY scene ORDER BY frame) AS gap FROM f), w AS (SELECT scene, count(*) AS samples, max(gap) AS gap, avg(least(abs(e[13]) * 4, 1)) AS coverage, max(abs(e[14])) AS cycle_error FROM g GROUP BY 1),
h AS (SELECT *, list_filter([CASE WHEN gap > 5 THEN 'dense_interleaved_timeline' END, CASE WHEN valid < 0.9 THEN 'valid_positive_depth' END, CASE WHEN coverage < 0.35 THEN 'virtual_view_visible_surface_coverage' END, CASE WHEN cycle_error > 0.4 THEN 'virtual_view_cycle_depth_bounded' END,
  CASE WHEN spread > 0.1 THEN 'same_model_cross_run_scale_stable' END], lambda z: z IS NOT NULL) AS failed FROM w JOIN y USING (scene) JOIN p USING (scene))
SELECT scene, samples, gap, round(30.0 / gap, 5) AS hz, round(valid, 5) AS valid, round(coverage, 5) AS coverage, round(cycle_error, 5) AS cycle_error, round(spread, 5) AS spread, failed, len(failed) = 0 AS passed FROM h"""
)
def derived_views(spark, d):
    """Vectors as depths of five scenes, in three runs of a model each."""
    rows = _vectors(spark, d).withColumn("scene", F.col("vec_id") % 5)
    frames = rows.select("scene", F.col("vec_id").alias("frame"), (F.col("label") % 3).alias("group"), F.transform(F.slice("e", 1, 12), lambda x: x + 0.15 + F.col("scene") * 0.05).alias("depths"))
    views = rows.select("scene", F.least(F.abs(F.col("e")[12]) * 4, F.lit(1.0)).alias("coverage"), F.abs(F.col("e")[13]).alias("cycle_error"))
    found = audits.derived_views(frames, views, ["scene"], 3, 30.0, 5, 0.9, 0.35, 0.4, 0.1)
    return _rounded(found, "hz", "valid", "coverage", "cycle_error", "spread")


_REGISTRY = [("late", "plan earlier", 1), ("dear", "other supplier", 2), ("taxed", "other region", 3)]


@query(
    """WITH g AS (SELECT l_suppkey, l_returnflag || l_linestatus AS grp, avg(l_tax) AS tax, avg(l_extendedprice) AS price, avg(l_discount) AS discount FROM lineitem GROUP BY 1, 2),
f AS (SELECT l_suppkey, grp, unnest([CASE WHEN tax > 0.042 THEN 'taxed' END, CASE WHEN price > 52000 THEN 'dear' END]) AS gate FROM g),
r(gate, repair, priority) AS (VALUES ('late', 'plan earlier', 1), ('dear', 'other supplier', 2), ('taxed', 'other region', 3))
SELECT gate, any_value(repair) AS repair, any_value(priority) AS priority, list_sort(list(DISTINCT l_suppkey)) AS subjects, list_sort(list(DISTINCT grp)) AS groups FROM f JOIN r USING (gate) GROUP BY 1"""
)
def failed_gate_repairs(spark, d):
    """What to do about each gate that a supplier's lines failed, and which suppliers and kinds of lines did."""
    rows = read(spark, d, "lineitem").groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("grp")).agg(F.avg("l_tax").alias("tax"), F.avg("l_extendedprice").alias("price"))
    failures = rows.select("l_suppkey", "grp", F.explode(F.array_compact(F.array(F.when(F.col("tax") > 0.042, "taxed"), F.when(F.col("price") > 52000, "dear")))).alias("gate"))
    return audits.by_failed_gate(failures, spark.createDataFrame(_REGISTRY, "gate string, repair string, priority int"), "gate", "l_suppkey", "grp")


@query(
    """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_name END, 'uuid-' || c_custkey) AS identity, c_custkey % 4 > 0 AS mapped, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS n, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer"""
)
def identities(spark, d):
    """Customers by name or else by another id, with their fields where they have an index."""
    i = F.col("c_custkey")
    rows = read(spark, d, "customer").select("c_custkey", F.when(i % 3 > 0, F.col("c_name")).alias("name"), F.concat(F.lit("uuid-"), i).alias("other"), F.when(i % 4 > 0, F.col("c_nationkey")).alias("n"), "c_mktsegment")
    return audits.identities(rows, "name", "other", "n", "c_mktsegment").select("c_custkey", "identity", "mapped", "n", "c_mktsegment")


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber AS n, CAST(l_linenumber - 1 AS BIGINT) * 10 AS s, CAST(l_linenumber AS BIGINT) * 10 AS e, CASE l_returnflag WHEN 'A' THEN 'grasp' WHEN 'R' THEN 'release' ELSE 'idle' END AS phase, 'part-' || l_partkey AS target FROM lineitem)
SELECT l_orderkey, 'full-clip' AS "constraint", 'left' AS side, 'main' AS target, 0::BIGINT AS start, max(e) AS "end", 'hold' AS phase, 0.8::DOUBLE AS confidence FROM p GROUP BY 1
UNION ALL SELECT l_orderkey, 'right-' || n, 'right', target, s, e, phase, 0.65 FROM p WHERE phase <> 'idle'"""
)
def phase_constraints(spark, d):
    """Lines of an order as phases of ten frames, two of the three flags being contact."""
    n = F.col("l_linenumber").cast("long")
    phase = F.when(F.col("l_returnflag") == "A", "grasp").when(F.col("l_returnflag") == "R", "release").otherwise("idle")
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), ((n - 1) * 10).alias("s"), (n * 10).alias("e"), phase.alias("phase"), F.concat(F.lit("part-"), "l_partkey").alias("target"))
    constant = {"constraint": F.lit("full-clip"), "side": F.lit("left"), "target": F.lit("main"), "phase": F.lit("hold"), "confidence": F.lit(0.8)}
    return audits.phase_constraints(rows, ["l_orderkey"], "n", "s", "e", "phase", "target", ["grasp", "release"], constant)
