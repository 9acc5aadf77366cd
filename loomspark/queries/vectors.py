"""Vectors, bit masks, tokens, text and nested values."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import scalar
from loomspark.queries import query, read

V = "CAST(embedding AS DOUBLE[])"


@query(
    """WITH x AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(x, 6) AS x, CASE WHEN x < -0.2 - dim / 1000.0 THEN 'below' ELSE 'above' END AS side FROM x WHERE x < -0.2 - dim / 1000.0 OR x > 0.2 + dim / 1000.0"""
)
def joint_limit_violation(spark, d):
    long = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    low, high = F.lit(-0.2) - F.col("dim") / 1000.0, F.lit(0.2) + F.col("dim") / 1000.0
    found = long.filter((F.col("x") < low) | (F.col("x") > high))
    return found.select("vec_id", "dim", F.round("x", 6).alias("x"), F.when(F.col("x") < low, "below").otherwise("above").alias("side"))


@query(
    """WITH x AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT dim, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM x GROUP BY 1)
SELECT vec_id, CAST(count_if(x < lo OR x > hi) AS BIGINT) AS outside, round(count_if(x < lo OR x > hi) / 64.0, 6) AS share FROM x JOIN s USING (dim) GROUP BY 1"""
)
def range_audit(spark, d):
    from loomspark.operators.aggregation import vector_stats

    rows = read(spark, d, "embeddings")
    long = rows.select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    out = F.count_if((F.col("x").cast("double") < F.col("p01")) | (F.col("x").cast("double") > F.col("p99")))
    found = long.join(vector_stats(rows, "embedding").select("dim", "p01", "p99"), "dim").groupBy("vec_id").agg(out.alias("outside"), F.count("*").alias("n"))
    return found.select("vec_id", "outside", F.round(F.col("outside") / F.col("n"), 6).alias("share"))


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform({V}, lambda x: x * x))), 5) AS norm, abs(sqrt(list_sum(list_transform({V}, lambda x: x * x))) - 1) <= 0.001 AS unit FROM embeddings")
def unit_norm_check(spark, d):
    size = scalar.norm(F.col("embedding"))
    return read(spark, d, "embeddings").select("vec_id", F.round(size, 5).alias("norm"), (F.abs(size - 1) <= 0.001).alias("unit"))


@query(
    f"""WITH q AS (SELECT label, arg_min({V}, vec_id) AS q, min(vec_id) AS qid FROM embeddings GROUP BY 1),
s AS (SELECT label, vec_id, qid, greatest(0, least(1, list_dot_product({V}, q) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product({V}, {V}))))) AS s FROM embeddings JOIN q USING (label) WHERE vec_id <> qid)
SELECT label, vec_id, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS n FROM s) WHERE n <= 3"""
)
def cosine_top(spark, d):
    rows = read(spark, d, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"), F.min("vec_id").alias("qid"))
    scored = rows.join(first, "label").filter("vec_id <> qid").withColumn("s", scalar.cosine_score(F.col("embedding"), F.col("q")))
    from loomspark.operators.selection import cap_per_group

    return cap_per_group(scored, ["label"], [F.round("s", 9).desc(), F.col("vec_id")], 3).select("label", "vec_id", F.round("s", 5).alias("score"))


@query(
    """WITH w AS (SELECT vec_id, label, list_reduce(list_transform(embedding[1:32], lambda x: CASE WHEN x > 0 THEN 1::BIGINT ELSE 0::BIGINT END), lambda a, b: a * 2 + b) AS w FROM embeddings),
n AS (SELECT *, lead(w) OVER (PARTITION BY label ORDER BY vec_id) AS x FROM w)
SELECT vec_id, round(CASE WHEN bit_count(w | x) = 0 THEN 1 ELSE bit_count(w & x) / bit_count(w | x) END, 6) AS iou, CAST(bit_count(xor(w, x)) AS INTEGER) AS hamming FROM n WHERE x IS NOT NULL"""
)
def pairwise_iou(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", "label", scalar.sign_word(F.col("embedding"), 32).alias("w"))
    pairs = rows.withColumn("x", F.expr("lead(w) OVER (PARTITION BY label ORDER BY vec_id)")).filter("x IS NOT NULL")
    return pairs.select("vec_id", F.round(scalar.bit_iou(F.col("w"), F.col("x")), 6).alias("iou"), scalar.hamming(F.col("w"), F.col("x")).alias("hamming"))


@query("SELECT vec_id, list_transform(embedding, lambda x: least(CAST(floor((least(greatest(x::DOUBLE, -0.5), 0.5) + 0.5) / 1.0 * 256) AS INTEGER), 255)) AS tokens FROM embeddings")
def token_bins(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: scalar.bin_index(x.cast("double"), -0.5, 0.5, 256)).alias("tokens"))


@query(
    """WITH f AS (SELECT event_id, [value / 100, hour(ts) / 24.0] AS c, [CAST(event_type = 'click' AS DOUBLE), CAST(event_type = 'purchase' AS DOUBLE), CAST(event_type = 'error' AS DOUBLE)] AS h FROM events)
SELECT event_id, list_transform(list_concat(c, h, list_transform(h, lambda x: c[1] * x), list_transform(h, lambda x: c[2] * x)), lambda x: round(x, 6)) AS features FROM f"""
)
def one_hot_interactions(spark, d):
    context = F.array(F.col("value") / 100, F.hour("ts") / F.lit(24.0))
    found = scalar.with_interactions(context, scalar.one_hot(F.col("event_type"), ["click", "purchase", "error"]))
    return read(spark, d, "events").select("event_id", F.transform(found, lambda x: F.round(x, 6)).alias("features"))


@query(
    """WITH t AS (SELECT event_id, '[robot' || CAST(user_id % 7 AS VARCHAR) || '] ' || event_type || ': ' || props AS line FROM events)
SELECT event_id, regexp_extract(line, '^\\[([a-z0-9]+)\\] ([a-z_]+): (.*)$', 1) AS embodiment, regexp_extract(line, '^\\[([a-z0-9]+)\\] ([a-z_]+): (.*)$', 2) AS task, length(regexp_extract(line, '^\\[([a-z0-9]+)\\] ([a-z_]+): (.*)$', 3)) AS n FROM t"""
)
def task_regex(spark, d):
    pattern = r"^\[([a-z0-9]+)\] ([a-z_]+): (.*)$"
    line = F.concat(F.lit("[robot"), (F.col("user_id") % 7).cast("string"), F.lit("] "), F.col("event_type"), F.lit(": "), F.col("props"))
    part = lambda i: F.regexp_extract("line", pattern, i)
    rows = read(spark, d, "events").withColumn("line", line)
    return rows.select("event_id", part(1).alias("embodiment"), part(2).alias("task"), F.length(part(3)).cast("long").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none.deep') AS deep FROM events")
def json_path(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none.deep").alias("deep"))


@query("SELECT doc_id, sha256(text) AS digest, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n, regexp_full_match(source || '.' || lang, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') AS safe FROM documents")
def text_normalise(spark, d):
    return read(spark, d, "documents").select(
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        F.length(scalar.squeeze_space(F.col("text"))).cast("long").alias("n"),
        scalar.safe_id(F.concat_ws(".", "source", "lang")).alias("safe"),
    )


@query(
    """SELECT p_partkey, round(exp(-0.5 * greatest(0, p_size / 10.0 - 2)), 6) AS decay, round(least(greatest(p_size / 50.0, 0), 1) * least(greatest(p_size / 50.0, 0), 1) * (3 - 2 * least(greatest(p_size / 50.0, 0), 1)), 6) AS eased,
  CASE WHEN p_size / 50.0 < 0.12 THEN 'rest' WHEN p_size / 50.0 < 0.25 THEN 'reach' WHEN p_size / 50.0 < 0.38 THEN 'grasp' WHEN p_size / 50.0 < 0.72 THEN 'move' WHEN p_size / 50.0 < 0.86 THEN 'place' ELSE 'leave' END AS phase,
  round_even(p_size / 4.0, 0) AS half_even FROM part"""
)
def scalar_scores(spark, d):
    share = F.col("p_size") / 50.0
    return read(spark, d, "part").select(
        "p_partkey",
        F.round(scalar.decay_score(F.col("p_size") / 10.0, F.lit(2.0), 0.5), 6).alias("decay"),
        F.round(scalar.smoothstep(share), 6).alias("eased"),
        scalar.strength_of_progress(share, [0.12, 0.25, 0.38, 0.72, 0.86], ["rest", "reach", "grasp", "move", "place", "leave"]).alias("phase"),
        scalar.half_even(F.col("p_size") / 4.0).alias("half_even"),
    )


@query(
    """WITH b AS (SELECT s_suppkey, s_nationkey, s_acctbal / 100 AS x, s_suppkey % 10 AS y FROM supplier)
SELECT a.s_suppkey, CAST(count_if(b.s_suppkey <> a.s_suppkey AND a.x < b.x + 8 AND b.x < a.x + 8 AND a.y < b.y + 3 AND b.y < a.y + 3) AS BIGINT) AS overlaps FROM b a JOIN b ON a.s_nationkey = b.s_nationkey GROUP BY 1"""
)
def box_overlap(spark, d):
    """Boxes of suppliers of one nation that share an area; boxes are 8 wide, so a box meets only its own and the next bins' boxes."""
    rows = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 10).alias("y")).withColumn("bin", F.floor(F.col("x") / 8))
    near = rows.select(*(F.col(c).alias(f"o_{c}") for c in ("s_suppkey", "s_nationkey", "x", "y")), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    meet = scalar.boxes_overlap(F.col("x"), F.col("y"), F.lit(8), F.lit(3), F.col("o_x"), F.col("o_y"), F.lit(8), F.lit(3)) & (F.col("s_suppkey") != F.col("o_s_suppkey"))
    pairs = rows.join(near, (rows["s_nationkey"] == near["o_s_nationkey"]) & (rows["bin"] == near["bin"]))
    return pairs.groupBy("s_suppkey").agg(F.count_if(meet).alias("overlaps"))


@query(
    """SELECT vec_id, list_transform(range(1, 8), lambda i: round(least(greatest(embedding[i]::DOUBLE, -0.1), 0.1 + i / 100.0), 6)) AS clamped FROM embeddings"""
)
def clamp_limits(spark, d):
    lows = F.array(*(F.lit(-0.1) for _ in range(7)))
    highs = F.array(*(F.lit(0.1 + i / 100.0) for i in range(1, 8)))
    values = F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double"))
    return read(spark, d, "embeddings").select("vec_id", F.transform(scalar.clamp_vector(values, lows, highs), lambda x: scalar.rounded(x, 6)).alias("clamped"))
