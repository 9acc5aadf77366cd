"""Rotations, robust fits, assignments, masks and JSON on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import scalar
from loomspark.operators import fitting, resampling, robust, selection
from loomspark.queries import query, read

R = "e[1]::DOUBLE AS r, e[2]::DOUBLE AS p, e[3]::DOUBLE AS y"


@query(
    f"""WITH a AS (SELECT vec_id, {R} FROM (SELECT vec_id, embedding AS e FROM embeddings)),
m AS (SELECT vec_id, [cos(y)*cos(p), cos(y)*sin(p)*sin(r)-sin(y)*cos(r), cos(y)*sin(p)*cos(r)+sin(y)*sin(r), sin(y)*cos(p), sin(y)*sin(p)*sin(r)+cos(y)*cos(r), sin(y)*sin(p)*cos(r)-cos(y)*sin(r), -sin(p), cos(p)*sin(r), cos(p)*cos(r)] AS m FROM a)
SELECT vec_id, list_transform(m, lambda x: round(x, 6)) AS matrix, round(acos(greatest(-1, least(1, (m[1] + m[5] + m[9] - 1) / 2))), 4) AS angle, true AS rigid FROM m"""
)
def rotation_matrices(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = read(spark, d, "embeddings").select("vec_id", scalar.matrix_from_euler(e(0), e(1), e(2)).alias("m"))
    still = F.array(*(F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)))
    rigid = (scalar.orthonormal_error(F.col("m")) < 1e-9) & (F.abs(scalar.determinant(F.col("m")) - 1) < 1e-9)
    return rows.select("vec_id", F.transform("m", lambda x: F.round(x, 6)).alias("matrix"), F.round(scalar.matrix_angle(F.col("m"), still), 4).alias("angle"), rigid.alias("rigid"))


@query(
    """SELECT vec_id, round(CASE WHEN embedding[3] > 0 THEN embedding[1]::DOUBLE / embedding[3]::DOUBLE * 600 + 320 END, 3) AS u, round(CASE WHEN embedding[3] > 0 THEN embedding[2]::DOUBLE / embedding[3]::DOUBLE * 600 + 240 END, 3) AS v FROM embeddings"""
)
def pinhole(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = read(spark, d, "embeddings").select("vec_id", scalar.project(e(0), e(1), e(2), 600.0, 600.0, 320.0, 240.0).alias("p"))
    return rows.select("vec_id", F.round("p.u", 3).alias("u"), F.round("p.v", 3).alias("v"))


@query(
    """WITH RECURSIVE p AS (SELECT l_linestatus, l_orderkey % 50 AS part, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
h AS (SELECT 1 AS round, l_linestatus, part, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, min(x) = max(x) AS done, count(*) AS n FROM p GROUP BY l_linestatus, part
UNION ALL SELECT round + 1, l_linestatus, part, new, my - new * mx, abs(new - slope) < 1e-10, n FROM (
  SELECT round, l_linestatus, part, slope, n, sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) AS new FROM (
    SELECT *, least(1, 1.345 * greatest(1.4826 * median(gap) OVER (PARTITION BY l_linestatus, part), 1e-9) / greatest(gap, 1e-12)) AS w FROM (
      SELECT h.round, h.l_linestatus, h.part, h.slope, h.n, x, y, abs(y - intercept - slope * x) AS gap FROM h JOIN p ON h.l_linestatus = p.l_linestatus AND h.part = p.part WHERE NOT done AND round < 20))
  GROUP BY round, l_linestatus, part, slope, n))
SELECT l_linestatus, part, round(arg_max(slope, round), 6) AS slope, round(arg_max(intercept, round), 6) AS intercept, any_value(n) AS n FROM h GROUP BY 1, 2"""
)
def huber_fit(spark, d):
    """A robust line of price over quantity for each line status, by part of the order keys."""
    rows = read(spark, d, "lineitem").select("l_linestatus", (F.col("l_orderkey") % 50).alias("part"), "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    found = robust.huber_line(rows, ["l_linestatus", "part"], "l_quantity", "price")
    return found.select("l_linestatus", "part", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


@query(
    """WITH n AS (SELECT user_id, event_type, value, row_number() OVER w - 1 AS number, count(*) OVER (PARTITION BY user_id, event_type) AS units FROM events
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY substr(md5(CAST(event_id AS VARCHAR)), 1, 2), event_id)),
d AS (SELECT user_id, event_type, round, CAST('0x' || substr(md5('5:' || round || ':' || number || ':' || user_id || ':' || event_type), 1, 13) AS BIGINT) % units AS picked FROM n, range(100) r(round)),
m AS (SELECT d.user_id, round, median(value) AS m FROM d JOIN n ON n.user_id = d.user_id AND n.event_type = d.event_type AND number = picked GROUP BY 1, 2),
s AS (SELECT user_id, stddev_samp(m) AS s FROM m GROUP BY 1), w AS (SELECT user_id, median(value) AS median FROM events GROUP BY 1)
SELECT user_id, round(median, 6) AS median, round(s / median, 6) AS relative FROM w JOIN s USING (user_id)"""
)
def stratified_scale(spark, d):
    """The median value of each user and how much it varies over resamples inside every kind of event."""
    found = resampling.resampled_scale(read(spark, d, "events"), ["user_id"], "event_type", "event_id", "value", 100, 5)
    return found.select("user_id", F.round("median", 6).alias("median"), F.round("relative", 6).alias("relative"))


@query(
    """WITH o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders),
g AS (SELECT o_custkey, n // 4 AS block, list(o_totalprice ORDER BY n) AS x, count(*) AS size FROM o GROUP BY 1, 2),
i AS (SELECT unnest(range(1, 5)) AS i), p AS (
SELECT 1 AS size, [1] AS p UNION ALL SELECT 2, [a.i, b.i] FROM i a, i b WHERE greatest(a.i, b.i) <= 2 AND a.i <> b.i
UNION ALL SELECT 3, [a.i, b.i, c.i] FROM i a, i b, i c WHERE greatest(a.i, b.i, c.i) <= 3 AND len(list_distinct([a.i, b.i, c.i])) = 3
UNION ALL SELECT 4, [a.i, b.i, c.i, d.i] FROM i a, i b, i c, i d WHERE len(list_distinct([a.i, b.i, c.i, d.i])) = 4),
c AS (SELECT o_custkey, block, p.p, list_reduce(list_prepend(0.0::DOUBLE, list_transform(p.p, lambda b, a: abs(x[a] - x[b] * CASE WHEN a = b THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) / 1000)), lambda t, v: t + v) AS cost FROM g JOIN p USING (size)),
b AS (SELECT o_custkey, block, arg_min(p, [cost, p[1], p[2], p[3], p[4]]) AS p, min(cost) AS least, min(cost) FILTER (p = list_sort(p)) AS straight FROM c GROUP BY 1, 2)
SELECT o_custkey, CAST(block AS BIGINT) AS block, list_transform(p, lambda v: CAST(v - 1 AS INTEGER)) AS pairing, round(least, 6) AS least, round(straight, 6) AS straight, straight - least > 1 AS swapped FROM b"""
)
def identity_swaps(spark, d):
    """Each four orders of a customer in a row: would their dates and prices fit better the other way round."""
    rows = read(spark, d, "orders").withColumn("n", F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")).withColumn("block", F.expr("CAST((n - 1) DIV 4 AS BIGINT)")).withColumn("n", F.expr("(n - 1) % 4 + 1"))
    pairs = rows.select("o_custkey", "block", F.col("n").alias("a"), F.col("o_totalprice").alias("pa")).join(rows.select("o_custkey", "block", F.col("n").alias("b"), F.col("o_totalprice").alias("pb")), ["o_custkey", "block"])
    full = pairs.withColumn("cost", F.abs(F.col("pa") - F.col("pb") * F.when(F.col("a") == F.col("b"), 1.1).otherwise(1.0)) / 1000)
    return fitting.best_permutation(full, ["o_custkey", "block"], "a", "b", "cost", 1.0, 4).withColumn("least", F.round("least", 6)).withColumn("straight", F.round("straight", 6))


@query(
    """SELECT a.s_nationkey, round(min(sqrt(pow((a.s_acctbal - b.s_acctbal) / 1000, 2) + pow(a.s_suppkey % 10 - b.s_suppkey % 10, 2))), 5) AS distance, count(*) AS pairs
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY 1"""
)
def least_pair_distance(spark, d):
    rows = read(spark, d, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_suppkey") % 10).cast("double").alias("y"))
    return fitting.least_distance(rows, ["s_nationkey"], "s_suppkey", ["x", "y"]).withColumn("distance", F.round("distance", 5))


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events WHERE event_id IS NOT NULL)
SELECT user_id, CAST(bin AS INTEGER) AS bin, i FROM (SELECT user_id, least(floor(i / 10.0), 4) AS bin, i, row_number() OVER (PARTITION BY user_id, least(floor(i / 10.0), 4) ORDER BY value DESC, i) AS n FROM e) WHERE n = 1"""
)
def diverse_bins(spark, d):
    rows = read(spark, d, "events").withColumn("i", F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1").cast("long"))
    return selection.blocked_bins(rows, "user_id", "i", "value", 0, 50, 5).select("user_id", "bin", "i")


@query("SELECT event_id, CAST(json(props) AS VARCHAR) AS found, sha256(CAST(json(props) AS VARCHAR)) AS digest FROM events")
def first_json(spark, d):
    """The JSON object that follows some prose, and the digest of its canonical form."""
    text = F.concat(F.lit("Answer {not json:\n```json\n"), F.col("props"), F.lit("\n```"))
    rows = read(spark, d, "events").select("event_id", fitting.first_json_object(text).alias("found"))
    return rows.select("event_id", "found", fitting.canonical_digest(F.col("found")).alias("digest"))


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n, CAST(64 AS BIGINT) AS bits, CAST(8 AS BIGINT) AS bytes FROM embeddings")
def mask_round_trip(spark, d):
    """Sign masks packed into bytes and unpacked again."""
    masks = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0).alias("mask"))
    packed = fitting.packed_masks(masks, ["vec_id"], "mask")
    sizes = packed.select("vec_id", "bits", F.octet_length("packed").cast("long").alias("bytes"))
    back = fitting.unpacked_masks(packed, ["vec_id"]).select("vec_id", F.size(F.filter("mask", lambda x: x)).cast("long").alias("n"))
    return back.join(sizes, "vec_id")
