"""Poses, windows, lookups, negative examples and scores of recorded motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import pose, scalar
from loomspark.operators import motion
from loomspark.queries import query, read
from loomspark.queries.timelines import WRAP, E, _events

U = ["user_id"]


def _places(array, digits=5):
    return F.transform(array, lambda v: F.round(v, digits) + F.lit(0.0))


# Poses: vectors of embeddings as positions and rotations. The SQL takes each part of a quaternion as a column.
def _q(prefix, first):
    """Columns x, y, z, w of a unit quaternion of four neighbouring components."""
    size = "sqrt(" + " + ".join(f"e[{first + k}]**2" for k in range(4)) + ")"
    return ", ".join(f"e[{first + k}] / {size} AS {prefix}{c}" for k, c in enumerate("xyzw"))


def _turned(q, p):
    """SQL of a point turned by the columns qx, qy, qz, qw, through the rotation matrix."""
    x, y, z, w = (f"{q}{c}" for c in "xyzw")
    rows = [
        (f"1 - 2*({y}*{y} + {z}*{z})", f"2*({x}*{y} - {w}*{z})", f"2*({x}*{z} + {w}*{y})"),
        (f"2*({x}*{y} + {w}*{z})", f"1 - 2*({x}*{x} + {z}*{z})", f"2*({y}*{z} - {w}*{x})"),
        (f"2*({x}*{z} - {w}*{y})", f"2*({y}*{z} + {w}*{x})", f"1 - 2*({x}*{x} + {y}*{y})"),
    ]
    return [" + ".join(f"({m})*({v})" for m, v in zip(row, p, strict=True)) for row in rows]


def _product(a, b):
    """SQL of the Hamilton product as x, y, z, w."""
    ax, ay, az, aw, bx, by, bz, bw = (f"{q}{c}" for q in (a, b) for c in "xyzw")
    return [
        f"{aw}*{bx} + {ax}*{bw} + {ay}*{bz} - {az}*{by}",
        f"{aw}*{by} - {ax}*{bz} + {ay}*{bw} + {az}*{bx}",
        f"{aw}*{bz} + {ax}*{by} - {ay}*{bx} + {az}*{bw}",
        f"{aw}*{bw} - {ax}*{bx} - {ay}*{by} - {az}*{bz}",
    ]


def _angles(q):
    x, y, z, w = (f"{q}{c}" for c in "xyzw")
    return [f"atan2(2*({w}*{x} + {y}*{z}), 1 - 2*({x}*{x} + {y}*{y}))", f"asin(greatest(-1, least(1, 2*({w}*{y} - {z}*{x}))))", f"atan2(2*({w}*{z} + {x}*{y}), 1 - 2*({y}*{y} + {z}*{z}))"]


def _list(parts, digits=5):
    return "[" + ", ".join(f"round({p}, {digits}) + 0.0" for p in parts) + "]"


V = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
Q = f"{V}, q AS (SELECT vec_id, e, {_q('a', 4)}, {_q('r', 12)} FROM v)"


def _vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def _turns(spark, d):
    rows = _vectors(spark, d)
    return rows.withColumn("a", pose.unit(F.slice("e", 4, 4))).withColumn("b", pose.unit(F.slice("e", 12, 4)))


@query(f"{Q} SELECT vec_id, {_list(_product('a', 'r'))} AS product, {_list(['-ax', '-ay', '-az', 'aw'])} AS inverse, {_list(_angles('a'))} AS angles FROM q")
def quaternion_algebra(spark, d):
    inverse = pose.scalar_last(scalar.quaternion_inverse(pose.scalar_first(F.col("a"))))
    angles = scalar.euler_from_quaternion(pose.scalar_first(F.col("a")))
    return _turns(spark, d).select("vec_id", _places(pose.multiply(F.col("a"), F.col("b"))).alias("product"), _places(inverse).alias("inverse"), _places(angles).alias("angles"))


_SLERP = [f"(CASE WHEN c > 0.9995 THEN 0.7 ELSE sin(0.7 * o) / sin(o) END) * a{k} + (CASE WHEN c > 0.9995 THEN 0.3 ELSE sin(0.3 * o) / sin(o) END) * s * r{k}" for k in "xyzw"]


@query(
    f"""{Q}, c AS (SELECT *, ax*rx + ay*ry + az*rz + aw*rw AS c0 FROM q), o AS (SELECT *, abs(c0) AS c, acos(least(abs(c0), 1)) AS o, CASE WHEN c0 < 0 THEN -1 ELSE 1 END AS s FROM c),
m AS (SELECT vec_id, c, {", ".join(f"{x} AS m{i}" for i, x in enumerate(_SLERP))} FROM o)
SELECT vec_id, round(CASE WHEN c > 1 - 1e-12 THEN 0 ELSE 2 * acos(least(c, 1)) END, 5) AS angle, {_list([f"m{i} / sqrt(m0**2 + m1**2 + m2**2 + m3**2)" for i in range(4)])} AS between FROM m"""
)
def quaternion_slerp(spark, d):
    a, b = pose.scalar_first(F.col("a")), pose.scalar_first(F.col("b"))
    return _turns(spark, d).select("vec_id", F.round(scalar.rotation_angle(a, b), 5).alias("angle"), _places(pose.scalar_last(scalar.slerp(a, b, F.lit(0.3)))).alias("between"))


_HALF = "WITH h AS (SELECT vec_id, " + ", ".join(f"cos(5 * e[{i}]::DOUBLE) AS c{i}, sin(5 * e[{i}]::DOUBLE) AS s{i}" for i in (1, 2, 3)) + " FROM (SELECT vec_id, embedding AS e FROM embeddings))"


@query(
    f"""{_HALF}, q AS (SELECT vec_id, s1*c2*c3 - c1*s2*s3 AS x, c1*s2*c3 + s1*c2*s3 AS y, c1*c2*s3 - s1*s2*c3 AS z, c1*c2*c3 + s1*s2*s3 AS w FROM h)
SELECT vec_id, {_list([f"CASE WHEN w < 0 THEN -{c} ELSE {c} END" for c in "xyzw"])} AS turn FROM q"""
)
def matrix_quaternion(spark, d):
    angles = [F.col("e")[i] * 10 for i in range(3)]
    rows = _vectors(spark, d).withColumn("m", scalar.matrix_from_euler(*angles))
    return rows.select("vec_id", _places(pose.from_matrix(F.col("m"))).alias("turn"))


@query(
    f"""{Q}, p AS (SELECT *, {", ".join(f"e[{k}] + {x} AS t{k}" for k, x in zip((1, 2, 3), _turned("a", ["e[9]", "e[10]", "e[11]"]), strict=True))} FROM q)
SELECT vec_id, CASE WHEN vec_id % 3 > 0 THEN {_list(["t1", "t2", "t3"])} END AS shift, CASE WHEN vec_id % 3 > 0 THEN {_list(_product("a", "r"))} END AS turn,
CASE WHEN vec_id % 3 > 0 THEN 0.5 END AS confidence, {_list(["e[17]", "e[18]", "e[19]"])} AS back FROM p"""
)
def pose_compose(spark, d):
    rows = _turns(spark, d)
    left = pose.transform(F.when(F.col("vec_id") % 3 > 0, "hand").otherwise("eye"), F.lit("world"), F.slice("e", 1, 3), F.col("a"), F.lit(0.5))
    right = pose.transform(F.lit("tool"), F.lit("hand"), F.slice("e", 9, 3), F.col("b"), F.lit(0.9))
    rows = rows.withColumn("left", left).withColumn("both", pose.compose(F.col("left"), right))
    back = pose.apply(pose.inverse(F.col("left")), pose.apply(F.col("left"), F.slice("e", 17, 3)))
    return rows.select("vec_id", _places(F.col("both.shift")).alias("shift"), _places(F.col("both.turn")).alias("turn"), F.col("both.confidence").alias("confidence"), _places(back).alias("back"))


_ARM = [f"e[{k}]" for k in (1, 2, 3)], _angles("a"), ["least(greatest(e[8], 0), 1)"]
_ARM_2 = [f"e[{k}]" for k in (9, 10, 11)], _angles("r"), ["least(greatest(e[16], 0), 1)"]


@query(f"{Q} SELECT vec_id, CASE WHEN least(e[8], e[16]) >= -0.000001 AND greatest(e[8], e[16]) <= 1.000001 THEN {_list([x for part in (*_ARM, *_ARM_2) for x in part])} END AS pose FROM q")
def pose_two_arms(spark, d):
    return _vectors(spark, d).select("vec_id", _places(pose.two_arms(F.slice("e", 1, 16))).alias("pose"))


_COV = [" + ".join(f"e[{3 * i + k}]*e[{3 * j + k}]" for k in (1, 2, 3)) + (" - 0.01" if i == j else "") for i in range(3) for j in range(3)]


@query(
    f"""{V}, c AS (SELECT vec_id % 7 AS run, abs(e[10]) AS residual, CASE WHEN vec_id % 3 = 0 THEN 1e-5 ELSE 1.0 END AS scale, {", ".join(f"({c}) * CASE WHEN vec_id % 3 = 0 THEN 1e-5 ELSE 1.0 END AS m{k}" for k, c in enumerate(_COV))} FROM v),
q AS (SELECT *, (m0 + m4 + m8) / 3 AS q FROM c), p AS (SELECT *, sqrt(((m0 - q)**2 + (m4 - q)**2 + (m8 - q)**2 + 2 * (m1**2 + m2**2 + m5**2)) / 6) AS p FROM q),
r AS (SELECT *, least(greatest(((m0 - q) * ((m4 - q) * (m8 - q) - m5**2) - m1 * (m1 * (m8 - q) - m5 * m2) + m2 * (m1 * m5 - (m4 - q) * m2)) / (2 * p**3), -1), 1) AS r FROM p),
s AS (SELECT run, residual, q + 2 * p * cos((acos(r) + 2 * pi()) / 3) >= -1e-10 AS ok FROM r)
SELECT run, round(quantile_cont(residual, 0.95), 5) AS residual, count_if(NOT ok) AS indefinite, bool_and(ok) AND quantile_cont(residual, 0.95) <= 0.3 AS passed FROM s GROUP BY 1"""
)
def force_audit(spark, d):
    rows = _vectors(spark, d)
    cell = lambda i, j: sum((F.col("e")[3 * i + k] * F.col("e")[3 * j + k] for k in range(3)), F.lit(-0.01 if i == j else 0.0))
    scale = F.when(F.col("vec_id") % 3 == 0, 1e-5).otherwise(1.0)
    checked = rows.select(
        (F.col("vec_id") % 7).alias("run"), pose.is_semidefinite(F.array(*(cell(i, j) * scale for i in range(3) for j in range(3)))).alias("ok"), F.abs(F.col("e")[9]).alias("residual")
    )
    found = checked.groupBy("run").agg(F.percentile("residual", 0.95).alias("residual"), F.count_if(~F.col("ok")).alias("indefinite"))
    return found.select("run", F.round("residual", 5).alias("residual"), "indefinite", ((F.col("indefinite") == 0) & (F.col("residual") <= 0.3)).alias("passed"))


_STEP = [f"sqrt({' + '.join(f'(e[{3 * k + c + 3}] - e[{3 * k + c}])**2' for c in (1, 2, 3))})" for k in range(3)]


@query(
    f"""{V}, s AS (SELECT vec_id % 5 AS stem, k, CASE k {" ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(_STEP))} END AS size, e[13 + k] > -0.2 AND e[14 + k] > -0.2 AS seen FROM v, (SELECT unnest(range(3)) AS k)),
c AS (SELECT stem, k, CASE WHEN count_if(seen) >= 2 THEN stddev_pop(size) FILTER (WHERE seen) / avg(size) FILTER (WHERE seen) ELSE 'inf'::DOUBLE END AS cv FROM s GROUP BY 1, 2),
n AS (SELECT vec_id % 5 AS stem, count(*) AS frames, avg(((e[13] > -0.2)::INT + (e[14] > -0.2)::INT + (e[15] > -0.2)::INT + (e[16] > -0.2)::INT) / 4.0) AS share FROM v GROUP BY 1)
SELECT stem, any_value(frames) AS frames, round(any_value(share), 5) AS visible, round(max(cv), 5) AS worst_cv, true AS finite_confidence, any_value(share) >= 0.8 AND max(cv) <= 0.6 AS passed FROM c JOIN n USING (stem) GROUP BY 1"""
)
def centreline_audit(spark, d):
    e = F.col("e")
    nodes = F.array(*(F.struct(F.lit(k).alias("node"), *(e[3 * k + c].alias(a) for c, a in enumerate("xyz")), F.greatest(e[12 + k] + 0.2, F.lit(0.0)).alias("confidence")) for k in range(4)))
    rows = _vectors(spark, d).select((F.col("vec_id") % 5).alias("stem"), "vec_id", F.explode(nodes).alias("p")).select("stem", "vec_id", "p.*")
    found = motion.centreline_audit(rows, ["stem"], "vec_id", "node", ["x", "y", "z"], "confidence", 4, 0.8, 0.6)
    return found.select("stem", "frames", F.round("visible", 5).alias("visible"), F.round("worst_cv", 5).alias("worst_cv"), "finite_confidence", "passed")


@query(
    """WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[])[1:4], lambda x: x * 200) AS e FROM embeddings), n AS (SELECT *, sqrt(e[1]**2 + e[2]**2) AS n, sqrt(e[3]**2 + e[4]**2) AS m FROM v),
s AS (SELECT *, (e[3]*e[1] + e[4]*e[2]) / n AS along, abs(e[3]*e[2] - e[4]*e[1]) / n AS aside FROM n)
SELECT vec_id, round(least(greatest((0.75 * least(greatest(along / n, 0), 1) + 0.25 * exp(-aside / greatest(20, 0.6 * n))) * least(greatest(along / m, 0), 1), 0), 1), 5) AS score,
round(along / n, 4) AS progress, round(aside, 4) AS aside, round(least(greatest(along / m, 0), 1), 5) AS cosine FROM s"""
)
def progress_score(spark, d):
    e = [F.col("e")[i] * 200 for i in range(4)]
    rows = _vectors(spark, d).select("vec_id", motion.progress_score((e[0], e[1]), (e[2], e[3])).alias("s"))
    return rows.select("vec_id", F.round("s.score", 5).alias("score"), F.round("s.progress", 4).alias("progress"), F.round("s.lateral", 4).alias("aside"), F.round("s.cosine", 5).alias("cosine"))


@query(
    f"""{V} SELECT vec_id, round(least({", ".join(f"CASE WHEN greatest(e[{k}], 0) = 0 AND e[{k + 3}] >= greatest(e[{k}], 0) THEN 1.0 ELSE least(1.0, e[{k + 3}] / greatest(greatest(e[{k}], 0), 1e-9)) END" for k in (1, 2, 3))}), 3) AS ratio
FROM v WHERE least(e[1], e[2], e[3]) > 0.001 OR least(e[4], e[5], e[6]) >= 0"""
)
def worst_ratio(spark, d):
    e = F.col("e")
    rows = _vectors(spark, d).filter((F.least(*(e[k] for k in range(3))) > 0.001) | (F.least(*(e[k] for k in range(3, 6))) >= 0))
    return rows.select("vec_id", F.round(motion.worst_ratio([(F.greatest(e[k], F.lit(0.0)), e[k + 3]) for k in range(3)]), 3).alias("ratio"))


# Windows and lookups.
@query(
    f"""{E}, n AS (SELECT user_id, CAST(count(*) AS INTEGER) AS n FROM e GROUP BY 1), s AS (SELECT user_id, n, CAST(unnest(list_distinct([0, n // 3, n // 2, n - 8, n])) AS INTEGER) AS start FROM n)
SELECT user_id, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS INTEGER) AS "window", start, least(9, n - start) AS source_frames, greatest(0, 9 - (n - start)) AS padded_frames FROM s WHERE start BETWEEN 0 AND n - 8"""
)
def explicit_windows(spark, d):
    n = _events(spark, d).groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    starts = F.array(F.lit(0), F.expr("CAST(n DIV 3 AS INT)"), F.expr("CAST(n DIV 2 AS INT)"), F.col("n") - 8, F.col("n"))
    return motion.explicit_windows(n.withColumn("starts", starts), "n", "starts", 9)


@query(
    """WITH n AS (SELECT c_custkey, CAST(c_custkey % 97 + 5 AS INTEGER) AS n FROM customer), k AS (SELECT *, CAST(unnest(range(7)) AS INTEGER) AS latent FROM n)
SELECT c_custkey, n, latent, greatest(0, CAST(round_even(latent * n / 7.0, 0) AS INTEGER) - 1) AS start,
least(n, greatest(CAST(round_even((latent + 1) * n / 7.0, 0) AS INTEGER), CAST(round_even(latent * n / 7.0, 0) AS INTEGER) + 1) + 1) AS "end" FROM k"""
)
def latent_ranges(spark, d):
    n = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 97 + 5).cast("int").alias("n"))
    return motion.latent_ranges(n, "n", 7)


@query(f"{E}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT event_id, CAST(i AS BIGINT) AS i FROM n WHERE i >= n - greatest(3, CAST(ceil(n / 3.0) AS BIGINT))")
def tail_rows(spark, d):
    return motion.tail(_events(spark, d), U, "i").select("event_id", F.col("i").cast("long").alias("i"))


@query(
    f"""{E}, n AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), k AS (SELECT *, CAST(unnest(range(7)) AS INTEGER) AS step FROM n)
SELECT k.user_id, step, event_id FROM k JOIN e ON e.user_id = k.user_id AND e.i = CAST(round_even(step * (n - 1) / 6.0, 0) AS BIGINT)"""
)
def nearest_index(spark, d):
    return motion.nearest_index(_events(spark, d), U, "i", 7).select("user_id", "step", "event_id")


@query(
    """SELECT l_orderkey, list_transform(range(8), lambda i: coalesce(v[i + 1], 0.0)) AS "values", list_transform(range(8), lambda i: i < len(v)) AS mask
FROM (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1 HAVING count(*) <= 8)"""
)
def padded_values(spark, d):
    rows = read(spark, d, "lineitem")
    few = rows.groupBy("l_orderkey").count().filter("count <= 8").select("l_orderkey")
    return motion.padded(rows.join(few, "l_orderkey", "left_semi"), ["l_orderkey"], "l_linenumber", "l_quantity", 8)


@query(
    """WITH x AS (SELECT *, greatest(l_linenumber, l_suppkey % 20) AS s, least(l_linenumber + l_quantity, l_suppkey % 20 + 10) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN t > s THEN CAST(s AS DOUBLE) END AS start, CASE WHEN t > s THEN CAST(t AS DOUBLE) END AS "end" FROM x"""
)
def overlap_extent(spark, d):
    shared = motion.overlap(F.col("l_linenumber").cast("double"), F.col("l_quantity"), (F.col("l_suppkey") % 20).cast("double"), F.lit(10.0))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", shared.alias("s")).select("l_orderkey", "l_linenumber", "s.start", "s.end")


@query(
    f"""{E}, p AS (SELECT event_id, user_id, CAST(i AS DOUBLE) AS s, i + CASE event_type WHEN 'error' THEN 1.5 WHEN 'click' THEN 1.0000001 ELSE 1.0 END AS t FROM e),
g AS (SELECT *, s - lag(t) OVER (PARTITION BY user_id ORDER BY s, t) AS gap FROM p) SELECT event_id, round(gap, 6) AS gap FROM g WHERE abs(gap) > 1e-6"""
)
def contiguity_gaps(spark, d):
    more = F.when(F.col("event_type") == "error", 1.5).when(F.col("event_type") == "click", 1.0000001).otherwise(1.0)
    rows = _events(spark, d).select("event_id", "user_id", F.col("i").cast("double").alias("s"), (F.col("i") + more).alias("t"))
    return motion.contiguity_gaps(rows, U, "s", "t").select("event_id", F.round("gap", 6).alias("gap"))


@query(
    """WITH t AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN '## ' || o_orderpriority WHEN 'O' THEN '- item' ELSE 'text' END AS line FROM orders),
h AS (SELECT *, last_value(CASE WHEN line LIKE '## %' THEN upper(trim(substr(line, 4))) END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS section FROM t),
d AS (SELECT DISTINCT o_custkey, unnest(['1-URGENT', '2-HIGH']) AS section FROM orders)
SELECT o_custkey, section, count(line) FILTER (WHERE line LIKE '- %') AS bullets FROM d LEFT JOIN h USING (o_custkey, section) GROUP BY 1, 2"""
)
def section_counts(spark, d):
    line = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("## "), "o_orderpriority")).when(F.col("o_orderstatus") == "O", "- item").otherwise("text")
    return motion.section_counts(read(spark, d, "orders").withColumn("line", line), "o_custkey", "o_orderkey", "line", ["1-URGENT", "2-HIGH"])


_RUNS = """w AS (SELECT o_custkey, o_orderkey % 2 = 0 AS late, count_if(o_orderkey % 211 = 0) AS unfinished, (epoch(max(o_orderdate)) + 3600) - epoch(min(o_orderdate)) AS wall, CAST(sum(24 * (o_orderkey % 5 + 1)) AS DOUBLE) AS frames, min(o_orderpriority) AS priority FROM orders GROUP BY 1, 2),
t AS (SELECT o_custkey, late, priority, unfinished, CASE WHEN unfinished = 0 THEN CAST(wall AS DOUBLE) END AS wall, frames FROM w)"""


def _runs(spark, d):
    """Figures of two runs of each customer, by odd and even orders, whose times have different offsets."""
    stamp = lambda c, k: F.when(F.col("o_orderkey") % 3 == k, F.concat(F.date_format(c + F.expr("INTERVAL 5 HOUR"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00"))).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    end = F.when(F.col("o_orderkey") % 211 != 0, stamp(F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR"), 1)).otherwise("running")
    rows = read(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 2 == 0).alias("late"), stamp(F.col("o_orderdate"), 0).alias("s"), end.alias("t"), (F.lit(24) * (F.col("o_orderkey") % 5 + 1)).alias("frames"), "o_orderpriority")
    return rows, motion.throughput(rows, ["o_custkey", "late"], "s", "t", "frames", 24.0, 4)


@query(f"WITH {_RUNS} SELECT o_custkey, late, unfinished, wall, round(frames / wall, 8) AS frames_a_second, round(wall / (frames / 24), 4) AS realtime_factor, round(wall * 4 / 3600, 4) AS worker_hours FROM t")
def throughput(spark, d):
    _, found = _runs(spark, d)
    return found.select("o_custkey", "late", "unfinished", "wall", F.round("frames_a_second", 8).alias("frames_a_second"), F.round("realtime_factor", 4).alias("realtime_factor"), F.round("worker_hours", 4).alias("worker_hours"))


@query(
    f"""WITH {_RUNS}, j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.frames AS f, b.frames AS g, a.wall AS x, b.wall AS y, CASE WHEN a.o_custkey IS NULL OR b.o_custkey IS NULL THEN ['missing'] ELSE
  list_filter([CASE WHEN a.priority IS DISTINCT FROM b.priority THEN 'priority' END, CASE WHEN a.unfinished + b.unfinished > 0 THEN 'status' END], lambda z: z IS NOT NULL) END AS mismatches
FROM (SELECT * FROM t WHERE NOT late) a FULL JOIN (SELECT * FROM t WHERE late) b ON a.o_custkey = b.o_custkey)
SELECT o_custkey, mismatches, CASE WHEN len(mismatches) = 0 THEN round(x / y, 6) END AS speedup, CASE WHEN len(mismatches) = 0 THEN round((g / y) / (f / x), 6) END AS rate_gain, CASE WHEN len(mismatches) = 0 THEN round(1 - y / x, 6) END AS hours_saved FROM j"""
)
def run_comparison(spark, d):
    """Odd orders of each customer as a run against the even ones, where both are complete and begin with the same priority."""
    rows, figures = _runs(spark, d)
    config = rows.groupBy("o_custkey", "late").agg(F.min("o_orderpriority").alias("priority"))
    runs = figures.join(config, ["o_custkey", "late"]).withColumn("status", F.when(F.col("unfinished") == 0, "completed").otherwise("running"))
    found = motion.compare_runs(runs.filter(~F.col("late")), runs.filter("late"), "o_custkey", ["priority"])
    return found.select("o_custkey", "mismatches", *(F.round(c, 6).alias(c) for c in ("speedup", "rate_gain", "hours_saved")))


@query(
    f"""{E}, s AS (SELECT user_id, i, sqrt((value - lag(value) OVER w)**2 + 0.25) AS step FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)), m AS (SELECT user_id, max(step) AS m FROM s GROUP BY 1)
SELECT user_id, round(coalesce(m, 0), 5) AS step, CAST(min(i) FILTER (WHERE step = m) AS BIGINT) AS at, coalesce(m, 0) <= 90 AS passed FROM s JOIN m USING (user_id) GROUP BY user_id, m"""
)
def greatest_step(spark, d):
    rows = _events(spark, d).withColumn("y", F.col("i") * 0.5)
    return motion.greatest_step(rows, U, "i", "value", "y", 90.0).select("user_id", F.round("step", 5).alias("step"), F.col("at").cast("long").alias("at"), "passed")


@query(
    f"""{E} SELECT user_id, round(median(abs(value)) FILTER (WHERE i < 5), 5) AS baseline, round(max(abs(value)), 5) AS largest, round(arg_max(abs(value), i), 5) AS terminal,
max(abs(value)) <= median(abs(value)) FILTER (WHERE i < 5) + 20 AS passed FROM e GROUP BY 1"""
)
def hold_baseline(spark, d):
    found = motion.hold_baseline(_events(spark, d).withColumn("value", F.abs("value")), U, "i", "value", 5, 20.0)
    return found.select("user_id", *(F.round(c, 5).alias(c) for c in ("baseline", "largest", "terminal")), "passed")


@query(
    """WITH h AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS BIGINT) AS a, CAST(l_suppkey + l_quantity AS BIGINT) AS b, l_partkey % 60 + 20 AS size, l_linenumber % 6 AS k FROM lineitem),
r AS (SELECT *, CASE k WHEN 0 THEN a WHEN 1 THEN a WHEN 2 THEN greatest(0, size - a) END AS s, CASE k WHEN 0 THEN b WHEN 1 THEN size - 1 WHEN 2 THEN size - 1 END AS t FROM h)
SELECT l_orderkey, l_linenumber, CASE WHEN s < size AND t >= s AND NOT (k = 2 AND a = 0) THEN s END AS first, CASE WHEN s < size AND t >= s AND NOT (k = 2 AND a = 0) THEN least(t, size - 1) END AS last FROM r"""
)
def byte_range_headers(spark, d):
    a, b = F.col("l_suppkey").cast("string"), (F.col("l_suppkey") + F.col("l_quantity")).cast("long").cast("string")
    k = F.col("l_linenumber") % 6
    header = F.when(k == 0, F.concat(F.lit("bytes="), a, F.lit("-"), b)).when(k == 1, F.concat(F.lit(" bytes="), a, F.lit("-"))).when(k == 2, F.concat(F.lit("bytes=-"), a)).when(k == 3, "bytes=-").when(k == 4, "bytes=x-9")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", motion.byte_range(header, (F.col("l_partkey") % 60 + 20).cast("long")).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "r.first", "r.last")


@query(f"{E}, t AS (SELECT *, coalesce({WRAP.format('value - lag(value) OVER (PARTITION BY user_id ORDER BY i)')}, value) AS turn FROM e) SELECT event_id, round(sum(turn) OVER (PARTITION BY user_id ORDER BY i), 4) AS unwrapped FROM t")
def unwrapped_angle(spark, d):
    return motion.unwrapped(_events(spark, d), U, "i", "value").select("event_id", F.round("unwrapped", 4).alias("unwrapped"))


@query(
    """SELECT user_id, event_type, round(CASE event_type WHEN 'click' THEN sum(value) WHEN 'view' THEN max(value) ELSE arg_max(value, (ts, event_id)) END, 4) AS value FROM events GROUP BY 1, 2"""
)
def folded_state(spark, d):
    rows = read(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    found = motion.folded(rows, U, "event_type", "at", "value", {"click": F.sum("value"), "view": F.max("value")})
    return found.withColumn("value", F.round("value", 4))


@query(
    f"""{E}, w AS (SELECT DISTINCT user_id, CAST(unnest([4, 7, 10]) AS BIGINT) AS frame FROM e)
SELECT w.user_id, frame, CAST(i AS BIGINT) AS position FROM w LEFT JOIN e ON e.user_id = w.user_id AND 2 * e.i = frame"""
)
def frame_positions(spark, d):
    frames = _events(spark, d).withColumn("frame", (F.col("i") * 2).cast("long")).withColumn("i", F.col("i").cast("long"))
    found = motion.positions_of(frames, U, "i", "frame", 4, 10, 3)
    return found.withColumn("frame", F.col("frame").cast("long"))


@query(
    """SELECT o_custkey, string_agg('Phase ' || n || ': ' || lower(o_orderpriority) || ' for ' || CAST(o_orderkey % 9 + 1 AS VARCHAR) || ' s.', ' ' ORDER BY n) AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) GROUP BY 1"""
)
def phase_prompt(spark, d):
    orders = read(spark, d, "orders")
    phases = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")))
    held = orders.groupBy("o_custkey").agg(phases.alias("p"))
    one = lambda p, i: F.concat(F.lit("Phase "), (i + 1).cast("string"), F.lit(": "), F.lower(p["o_orderpriority"]), F.lit(" for "), (p["o_orderkey"] % 9 + 1).cast("string"), F.lit(" s."))
    return held.select("o_custkey", F.array_join(F.transform("p", one), " ").alias("prompt"))


# Negative examples.
_OWN = "OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_U = lambda k: f"((CAST('0x' || substr(md5('9:' || event_id), {k}, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0)"


@query(
    f"""{E}, s AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, epoch_us(ts) AS us FROM e)
SELECT event_id, round(CASE WHEN i < least(3, n - 1) OR lag(value, 3) OVER w IS NULL THEN first_value(value) {_OWN} ELSE lag(value, 3) OVER w END, 5) AS shifted,
CAST((us - min(us) OVER (PARTITION BY user_id)) * 1.5 AS DOUBLE) AS micros,
round(CASE WHEN i = n - 1 THEN 111.0 ELSE value END, 5) AS beyond, round(value + sqrt(-2 * ln({_U(1)})) * cos(2 * 3.141592653589793 * {_U(13)}) * 0.05, 5) AS noisy
FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)"""
)
def corrupted_series(spark, d):
    rows = _events(spark, d).withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("shifted", F.col("value")).withColumn("beyond", F.col("value"))
    rows = motion.over_limit(motion.stretched(motion.shifted(rows, U, "i", "shifted", 3), U, "micros", 1.5), U, "i", "beyond", F.lit(1.0), F.lit(101.0))
    rows = rows.withColumn("micros", F.col("micros") - F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(motion.Window.partitionBy("user_id")))
    noisy = F.col("value") + motion.seeded_noise(F.col("event_id"), "9", 0.05)
    return rows.select("event_id", F.round("shifted", 5).alias("shifted"), "micros", F.round("beyond", 5).alias("beyond"), F.round(noisy, 5).alias("noisy"))


@query(
    f"""{E}, a AS (SELECT user_id, value AS v, value / 10 AS w FROM e WHERE i = 2), s AS (SELECT user_id, i, value AS x, value / 10 AS angle, value AS grip FROM e WHERE i < 3),
m AS (SELECT d.user_id - 1 AS user_id, d.i, b.v + d.value - c.v AS x, b.w + {WRAP.format("d.value / 10 - c.w")} AS turned, d.value AS grip FROM e d JOIN a c ON c.user_id = d.user_id JOIN a b ON b.user_id = d.user_id - 1 WHERE d.i >= 3)
SELECT user_id, CAST(i AS BIGINT) AS i, round(x, 5) AS x, round(angle, 5) AS angle, round(grip, 5) AS grip FROM s
UNION ALL SELECT user_id, CAST(i AS BIGINT), round(x, 5), round({WRAP.format("turned")}, 5), round(grip, 5) FROM m"""
)
def rebased_future(spark, d):
    rows = _events(spark, d).select("user_id", "i", F.col("value").alias("x"), (F.col("value") / 10).alias("angle"), F.col("value").alias("grip"))
    found = motion.rebased(rows, rows.withColumn("user_id", F.col("user_id") - 1), U, "i", 3, ["x"], ["angle"], ["grip"])
    return found.select("user_id", F.col("i").cast("long").alias("i"), *(F.round(c, 5).alias(c) for c in ("x", "angle", "grip")))
