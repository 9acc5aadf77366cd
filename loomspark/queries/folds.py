"""Order-dependent folds, fills, seams and geometry on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions.scalar import rounded
from loomspark.operators import gates, joins, sequences, series
from loomspark.queries import query, read
from loomspark.queries.timelines import E, _events


def _arrays(spark, d):
    return sequences.as_array(_events(spark, d), ["user_id"], "i", "value")


A = "WITH a AS (SELECT user_id, list(value ORDER BY ts, event_id) AS xs FROM events GROUP BY 1)"


@query(
    f"""{A} SELECT user_id, list_transform(list_reduce(list_prepend([0.0::DOUBLE], list_transform(xs, lambda x: [(x - 45) / 10])), lambda path, s: list_concat(path, [greatest(-5, least(5, path[-1] + s[1]))]))[2:], lambda x: round(x, 4)) AS path FROM a"""
)
def clamped_walk(spark, d):
    """A walk whose place is clamped after every step."""
    steps = F.transform("xs", lambda x: (x - 45) / 10)
    return _arrays(spark, d).select("user_id", F.transform(sequences.clamped_walk(steps, 0.0, -5.0, 5.0), lambda x: rounded(x, 4)).alias("path"))


FOLLOW = "list_reduce(list_transform({0}, lambda x: [x]), lambda path, x: list_concat(path, [path[-1] + greatest(-10, least(10, x[1] - path[-1]))]))"


@query(
    f"""{A}, f AS (SELECT user_id, {FOLLOW.format('xs')} AS f, list_reverse({FOLLOW.format('list_reverse(xs)')}) AS b FROM a)
SELECT user_id, list_transform(list_zip(f, b), lambda p: round((p[1] + p[2]) / 2, 4)) AS path FROM f"""
)
def rate_limiter(spark, d):
    """The values followed with steps of at most 10, forwards and backwards."""
    return _arrays(spark, d).select("user_id", F.transform(sequences.rate_limited(F.col("xs"), 10.0), lambda x: rounded(x, 4)).alias("path"))


@query(f"{A} SELECT user_id, round(list_avg(list_reverse_sort(xs)[1:greatest(1, len(xs) // 20)]), 5) AS tail FROM a")
def tail_mean(spark, d):
    return _arrays(spark, d).select("user_id", F.round(sequences.tail_mean(F.col("xs")), 5).alias("tail"))


@query(
    f"""{E}, p AS (SELECT user_id, i, value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY i) AS y FROM e)
SELECT user_id, round(corr(x, y), 5) AS lag_correlation FROM p WHERE y IS NOT NULL GROUP BY 1"""
)
def pearson_lag(spark, d):
    xs = _arrays(spark, d)
    n = F.size("xs") - 1
    return xs.select("user_id", F.round(sequences.pearson(F.slice("xs", 1, n), F.slice("xs", 2, n)), 5).alias("lag_correlation"))


@query(
    """WITH n AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(list_max(list_transform(list_zip(a, b), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS most FROM n WHERE b IS NOT NULL"""
)
def largest_difference(spark, d):
    rows = read(spark, d, "embeddings").withColumn("b", F.expr("lead(embedding) OVER (PARTITION BY label ORDER BY vec_id)")).filter("b IS NOT NULL")
    return rows.select("vec_id", F.round(sequences.largest_difference(F.col("embedding"), F.col("b")), 6).alias("most"))


@query(
    f"""{E}, f AS (SELECT *, value > 50 AS f FROM e)
SELECT event_id, coalesce(CAST(lag(f) OVER w AS INTEGER) + CAST(f AS INTEGER) + CAST(lead(f) OVER w AS INTEGER) >= 2, f) AS voted FROM f WINDOW w AS (PARTITION BY user_id ORDER BY i)"""
)
def majority_vote(spark, d):
    rows = _events(spark, d).withColumn("f", F.col("value") > 50)
    return sequences.majority_of_three(rows, ["user_id"], "i", "f").select("event_id", "voted")


@query(
    f"""{E}, k AS (SELECT user_id, i, value FROM e WHERE event_type = 'purchase')
SELECT e.event_id, (SELECT arg_min(k.value, (abs(k.i - e.i), k.i)) FROM k WHERE k.user_id = e.user_id AND abs(k.i - e.i) <= 3) AS filled FROM e"""
)
def nearest_fill(spark, d):
    rows = _events(spark, d).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return sequences.nearest_fill(rows, ["user_id"], "i", "v", most=3).select("event_id", "filled")


@query(
    f"""{E}, s AS (SELECT user_id, i, abs(value - lag(value) OVER w) AS jump, abs(value - lag(value, 2) OVER w) AS motion FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, arg_min(i, (jump + 0.75 * motion, i)) AS seam, round(min(jump + 0.75 * motion), 5) AS cost FROM s WHERE i BETWEEN 5 AND 40 GROUP BY 1"""
)
def seam_choice(spark, d):
    lag = lambda k: F.expr(f"lag(value, {k}) OVER (PARTITION BY user_id ORDER BY i)")
    rows = _events(spark, d).withColumn("jump", F.abs(F.col("value") - lag(1))).withColumn("motion", F.abs(F.col("value") - lag(2)))
    found = sequences.seam(rows, ["user_id"], "i", "jump", "motion", low=F.lit(5), high=F.lit(40))
    return found.select("user_id", F.col("seam").cast("long").alias("seam"), F.round("cost", 5).alias("cost"))


@query(
    """WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1) SELECT event_id, round(value / greatest(m, 1e-9), 5) AS ratio FROM events JOIN m USING (user_id) WHERE value / greatest(m, 1e-9) > 1.8"""
)
def global_outliers(spark, d):
    return sequences.global_outliers(read(spark, d, "events"), ["user_id"], "value", 1.8).select("event_id", F.round("ratio", 5).alias("ratio"))


@query(
    f"""{E}, s AS (SELECT *, greatest(0.05, (value / 100 + hour(ts) / 24.0) / 2) AS s FROM e)
SELECT event_id, round(coalesce(sum(s) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(s) OVER (PARTITION BY user_id), 5) AS progress FROM s"""
)
def cumulative_progress(spark, d):
    rows = _events(spark, d).withColumn("a", F.col("value") / 100).withColumn("b", F.hour("ts") / F.lit(24.0))
    return sequences.cumulative_progress(rows, ["user_id"], "i", ["a", "b"]).select("event_id", F.round("progress", 5).alias("progress"))


@query(
    f"""{E}, n AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), f AS (SELECT user_id, i FROM e WHERE value > 80),
g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) <= 2 THEN 0 ELSE 1 END AS new FROM f), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS run FROM g),
p AS (SELECT user_id, greatest(min(i) - 3, 0) AS s, least(max(i) + 4, n) AS t FROM r JOIN n USING (user_id) GROUP BY user_id, run, n),
x AS (SELECT *, CASE WHEN s < max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM p), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, t) AS run FROM x)
SELECT user_id, min(s) AS start, max(t) AS "end", count(*) AS merged FROM y GROUP BY user_id, run"""
)
def padded_groups(spark, d):
    rows = _events(spark, d).withColumn("i", F.col("i").cast("long")).withColumn("n", F.expr("count(*) OVER (PARTITION BY user_id)"))
    return sequences.grouped_with_padding(rows.filter("value > 80"), ["user_id"], "i", 2, 3, F.col("n"))


@query(
    """WITH c AS (SELECT s_nationkey AS k, s_suppkey AS o, s_acctbal / 1000 AS cx, (s_suppkey % 10) * 1.0 AS cy FROM supplier),
g AS (SELECT *, lead(cx) OVER (PARTITION BY k ORDER BY o) AS nx, lead(cy) OVER (PARTITION BY k ORDER BY o) AS ny FROM c),
t AS (SELECT c_custkey, c_acctbal / 1000 AS x, (c_custkey % 10) * 1.0 AS y, g.*, CASE WHEN (nx - cx) * (nx - cx) + (ny - cy) * (ny - cy) > 0
  THEN greatest(0, least(1, ((c_acctbal / 1000 - cx) * (nx - cx) + ((c_custkey % 10) - cy) * (ny - cy)) / ((nx - cx) * (nx - cx) + (ny - cy) * (ny - cy)))) ELSE 0 END AS u FROM customer JOIN g ON c_nationkey = k WHERE nx IS NOT NULL)
SELECT c_custkey, round(min(sqrt((x - cx - u * (nx - cx)) * (x - cx - u * (nx - cx)) + (y - cy - u * (ny - cy)) * (y - cy - u * (ny - cy)))), 5) AS distance FROM t GROUP BY 1"""
)
def polyline_distance(spark, d):
    customers, suppliers = read(spark, d, "customer", "supplier")
    points = customers.select(F.col("c_nationkey").alias("k"), "c_custkey", (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 10).cast("double").alias("y"))
    corners = suppliers.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("o"), (F.col("s_acctbal") / 1000).alias("cx"), (F.col("s_suppkey") % 10).cast("double").alias("cy"))
    return sequences.closest_on_polyline(points, corners, ["k"], "c_custkey", "o").select("c_custkey", F.round("distance", 5).alias("distance"))


@query(
    """WITH p AS (SELECT l_orderkey, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) AS s, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN c > s THEN 'swapped' ELSE 'identity' END AS pairing FROM p"""
)
def pair_assignment(spark, d):
    side = lambda odd: F.sum(F.when(F.col("l_linenumber") % 2 == odd, F.col("l_quantity")).otherwise(0.0))
    found = read(spark, d, "lineitem").groupBy("l_orderkey").agg(side(0).alias("s"), side(1).alias("c"))
    return found.select("l_orderkey", sequences.two_way_assignment(F.col("s"), F.col("c")).alias("pairing"))


@query(
    """SELECT lang, count_if(n_chars > 300 AND quality = 1) AS tp, count_if(n_chars > 300 AND quality = 0) AS fp, count_if(NOT n_chars > 300 AND quality = 1) AS fn,
  round(count_if(n_chars > 300 AND quality = 1) / nullif(count_if(n_chars > 300), 0), 6) AS precision, round(count_if(n_chars > 300 AND quality = 1) / nullif(count_if(quality = 1), 0), 6) AS recall
FROM documents JOIN labels USING (doc_id) GROUP BY 1"""
)
def precision_recall(spark, d):
    docs, labels = read(spark, d, "documents", "labels")
    found = sequences.precision_recall(docs.join(labels, "doc_id"), ["lang"], F.col("n_chars") > 300, F.col("quality") == 1)
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(
    """WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, length(text) > 200 AS long FROM conversations WHERE turn % 2 = 0),
b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, length(text) > 200 AS long FROM conversations WHERE turn % 2 = 1)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.i, b.i) AS i, a.role IS NOT DISTINCT FROM b.role AND a.long IS NOT DISTINCT FROM b.long AS same FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.i = b.i"""
)
def paired_by_ordinal(spark, d):
    rows = read(spark, d, "conversations").withColumn("long", F.length("text") > 200)
    found = joins.paired_by_ordinal(rows.filter("turn % 2 = 0"), rows.filter("turn % 2 = 1"), ["conv_id"], "turn", ["role", "long"])
    return found.select("conv_id", F.col("i").cast("long").alias("i"), "same")


@query(
    """SELECT p_partkey, coalesce(p_size >= 5 AND p_size <= 45, false) AND coalesce(p_retailprice <= 1800, false) AND coalesce(length(p_name) >= 8, false) AS passed FROM part"""
)
def band_gates(spark, d):
    rows = read(spark, d, "part").withColumn("name_length", F.length("p_name"))
    ok = gates.band_gates({"p_size": (5, 45), "p_retailprice": (None, 1800), "name_length": (8, None)})
    return rows.select("p_partkey", ok.alias("passed"))


@query(
    f"""{E}, g AS (SELECT user_id, i, CASE WHEN event_type = 'click' THEN value END AS v FROM e), f AS (SELECT *, count(v) OVER (PARTITION BY user_id ORDER BY i) AS block FROM g),
b AS (SELECT user_id, block, count(*) FILTER (WHERE v IS NULL) AS n FROM f GROUP BY ALL) SELECT user_id, max(n) AS longest FROM b GROUP BY 1"""
)
def longest_gap(spark, d):
    rows = _events(spark, d)
    return series.longest_run(rows, ["user_id"], "i", F.col("event_type") != "click")
