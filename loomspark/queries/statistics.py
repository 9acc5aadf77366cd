"""Means in levels, limits, tests, bootstraps and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import scalar
from loomspark.operators import aggregation, learning, resampling
from loomspark.operators.quantiles import quantiles
from loomspark.queries import query, read


@query(
    """WITH a AS (SELECT c_mktsegment, c_custkey, o_orderkey, avg(l_quantity) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
b AS (SELECT c_mktsegment, c_custkey, avg(m) AS m FROM a GROUP BY ALL) SELECT c_mktsegment, round(avg(m), 6) AS mean FROM b GROUP BY 1"""
)
def two_level_mean(spark, d):
    lines, orders, customers = read(spark, d, "lineitem", "orders", "customer")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    levels = [["c_mktsegment", "c_custkey", "o_orderkey"], ["c_mktsegment", "c_custkey"], ["c_mktsegment"]]
    return aggregation.mean_in_levels(rows.select(*levels[0], "l_quantity"), levels, "l_quantity").withColumn("mean", F.round("mean", 6))


@query(
    """WITH a AS (SELECT o_orderstatus, l_orderkey, avg(l_discount) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_orderstatus, round(avg(m), 6) AS mean FROM a GROUP BY 1"""
)
def clip_episode_mean(spark, d):
    lines, orders = read(spark, d, "lineitem", "orders")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderstatus", "l_orderkey", "l_discount")
    return aggregation.mean_in_levels(rows, [["o_orderstatus", "l_orderkey"], ["o_orderstatus"]], "l_discount").withColumn("mean", F.round("mean", 6))


@query(
    """WITH x AS (SELECT unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT CAST(dim AS INTEGER) AS dim, count(*) AS n, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
  round(quantile_cont(x, 0.01), 6) AS p01, round(quantile_cont(x, 0.99), 6) AS p99 FROM x GROUP BY 1"""
)
def vector_stats(spark, d):
    found = aggregation.vector_stats(read(spark, d, "embeddings"), "embedding")
    return found.select("dim", "n", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "p01", "p99")))


@query(
    """WITH p AS (SELECT l_suppkey AS k, exp(-abs(avg(l_discount) - 0.05) * 400) AS p FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS n, count(*) OVER () AS m FROM p), t AS (SELECT *, CAST(p <= 0.05 / (m - n + 1) AS INTEGER) AS ok FROM r)
SELECT k, n AS rank, min(ok) OVER (ORDER BY n) = 1 AS rejected FROM t"""
)
def holm_step_down(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.exp(-F.abs(F.avg("l_discount") - 0.05) * 400).alias("p"))
    return aggregation.holm(rows, "k", "p", 0.05).select("k", "rank", "rejected")


@query(
    """WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), g AS (SELECT e.event_type, med, median(abs(value - med)) AS mad FROM events e JOIN m USING (event_type) GROUP BY ALL)
SELECT event_type, round(med, 6) AS median, round(mad, 6) AS mad, round(med - greatest(1.0, 3 * mad), 6) AS low, round(med + greatest(1.0, 3 * mad), 6) AS high FROM g"""
)
def robust_limit(spark, d):
    found = aggregation.robust_limits(read(spark, d, "events"), ["event_type"], "value", 3.0, 1.0)
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("median", "mad", "low", "high")))


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_disc(value, 0.95), 6) AS p95_rank FROM events GROUP BY 1")
def percentile_pair(spark, d):
    found = quantiles(read(spark, d, "events"), ["event_type"], "value", {"p05": 0.05}, {"p95_rank": 0.95})
    return found.select("event_type", F.round("p05", 6).alias("p05"), F.round("p95_rank", 6).alias("p95_rank"))


@query(
    """SELECT s.name, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95, round(count_if(value > 60) / count(*), 6) AS violations
FROM events JOIN (VALUES ('all', 1, 31), ('early', 1, 15), ('middle', 10, 20)) s(name, a, b) ON day(ts) BETWEEN a AND b GROUP BY 1"""
)
def section_violation(spark, d):
    sections = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in (("all", 1, 31), ("early", 1, 15), ("middle", 10, 20))))
    rows = read(spark, d, "events").withColumn("s", F.explode(F.filter(sections, lambda s: F.dayofmonth("ts").between(s["a"], s["b"]))))
    rows = rows.select(F.col("s.name").alias("name"), "value")
    sums = rows.groupBy("name").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.count_if(F.col("value") > 60) / F.count("*"), 6).alias("violations"))
    found = quantiles(rows, ["name"], "value", {"p05": 0.05, "p95": 0.95})
    return sums.join(found, "name").select("name", "n", "mean", F.round("p05", 6).alias("p05"), F.round("p95", 6).alias("p95"), "violations")


@query(
    """WITH b AS (SELECT event_type, least(CAST(floor(least(greatest(value, 0), 100) / 100 * 16) AS INTEGER), 15) AS bin FROM events),
p AS (SELECT bin, (count(*) + 1.0) / ((SELECT count(*) FROM events) + 16.0) AS p FROM b GROUP BY 1)
SELECT event_type, round(avg(-ln(p)), 6) AS surprisal, count(*) AS n FROM b JOIN p USING (bin) GROUP BY 1"""
)
def palette_surprisal(spark, d):
    rows = read(spark, d, "events").withColumn("bin", scalar.bin_index(F.col("value"), 0.0, 100.0, 16))
    return aggregation.surprisal(rows, ["event_type"], "bin", 1.0, 16).withColumn("surprisal", F.round("surprisal", 6))


@query(
    """SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, min(value) AS min, max(value) AS max FROM events GROUP BY 1"""
)
def six_numbers(spark, d):
    found = aggregation.six_numbers(read(spark, d, "events"), ["event_type"], "value")
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p10", "p90")), "min", "max")


@query(
    """WITH a AS (SELECT doc_id, 1 AS rater, CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END AS size, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS tongue FROM documents),
b AS (SELECT doc_id, 2 AS rater, CASE WHEN length(text) - length(replace(text, ' ', '')) > 200 THEN 'long' ELSE 'short' END AS size, CASE WHEN text LIKE '% the %' THEN 'en' ELSE 'other' END AS tongue FROM documents WHERE doc_id % 3 > 0)
SELECT doc_id, count(DISTINCT size) = 1 AS size_agrees, count(DISTINCT tongue) = 1 AS tongue_agrees, NOT (count(DISTINCT size) = 1 AND count(DISTINCT tongue) = 1) AS needs_review
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 HAVING count(DISTINCT rater) = 2"""
)
def ab_agreement(spark, d):
    docs = read(spark, d, "documents")
    long = lambda ok: F.when(ok, "long").otherwise("short").alias("size")
    tongue = lambda ok: F.when(ok, "en").otherwise("other").alias("tongue")
    a = docs.select("doc_id", F.lit(1).alias("rater"), long(F.col("n_chars") > 1500), tongue(F.col("lang") == "en"))
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    b = docs.filter("doc_id % 3 > 0").select("doc_id", F.lit(2).alias("rater"), long(spaces > 200), tongue(F.col("text").like("% the %")))
    return aggregation.agreement(a.union(b), "doc_id", "rater", ["size", "tongue"], 2)


@query(
    """SELECT user_id, t.event_type, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('click'), ('purchase'), ('error'), ('never')) t(event_type)
LEFT JOIN events e USING (user_id, event_type) GROUP BY ALL"""
)
def counts_over_domain(spark, d):
    return aggregation.counts_over_domain(read(spark, d, "events"), "event_type", ["click", "purchase", "error", "never"], ["user_id"])


@query(
    """SELECT l_returnflag, round((sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)), 4) AS slope
FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y, 1 + l_tax AS w FROM lineitem) GROUP BY 1"""
)
def weighted_line(spark, d):
    rows = read(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (1 + F.col("l_tax")).alias("w"))
    return learning.weighted_line(rows, ["l_returnflag"], "x", "y", "w").select("l_returnflag", F.round("slope", 4).alias("slope"))


def _moment(a, b):
    """A sum over the other flags of products of standardised features, or of one and the target."""
    return f"(p_{min(a, b)}{max(a, b)} - s_{a} * s_{b} / n) / sd_{a}" + (f" / sd_{b}" if b < 3 else "") + (" + 1" if a == b else "")


def _minor(columns):
    """The determinant of three columns of three names each."""
    (a, b, c), (d, e, f), (g, h, i) = columns
    return f"({a} * ({e} * {i} - {f} * {h}) - {d} * ({b} * {i} - {c} * {h}) + {g} * ({b} * {f} - {c} * {e}))"


_X = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
_PAIRS = [(a, b) for a in range(3) for b in range(a, 4)]
_G = [[f"g_{min(a, b)}{max(a, b)}" for a in range(3)] for b in range(4)]
_SOLVED = ", ".join(f"{_minor([_G[3] if j == k else _G[j] for j in range(3)])} / {_minor(_G[:3])} / sd_{k} AS c_{k + 1}" for k in range(3))


@query(
    f"""WITH t AS (SELECT l_returnflag, count(*)::DOUBLE AS n, {', '.join(f'sum({x}) AS s_{i}' for i, x in enumerate(_X))}, {', '.join(f'sum({_X[a]} * {_X[b]}) AS p_{a}{b}' for a, b in _PAIRS)} FROM lineitem GROUP BY 1),
o AS (SELECT a.l_returnflag, sum(b.n) AS n, {', '.join(f'sum(b.s_{i}) AS s_{i}' for i in range(4))}, {', '.join(f'sum(b.p_{a}{b}) AS p_{a}{b}' for a, b in _PAIRS)} FROM t a JOIN t b ON a.l_returnflag <> b.l_returnflag GROUP BY 1),
d AS (SELECT *, {', '.join(f'greatest(sqrt(greatest(p_{i}{i} / n - (s_{i} / n) * (s_{i} / n), 0)), 0.00000001) AS sd_{i}' for i in range(3))} FROM o),
g AS (SELECT *, {', '.join(f'{_moment(a, b)} AS g_{a}{b}' for a, b in _PAIRS)} FROM d), c AS (SELECT *, {_SOLVED} FROM g),
f AS (SELECT l_returnflag, s_3 / n - c_1 * s_0 / n - c_2 * s_1 / n - c_3 * s_2 / n AS c_0, c_1, c_2, c_3 FROM c)
SELECT l_returnflag, round(avg(abs(c_0 + c_1 * l_quantity + c_2 * l_discount + c_3 * l_tax - l_extendedprice)), 4) AS mean_error, [round(any_value(c_0), 4), round(any_value(c_1), 4), round(any_value(c_2), 4), round(any_value(c_3), 4)] AS coefficients FROM lineitem JOIN f USING (l_returnflag) GROUP BY 1"""
)
def ridge_logo(spark, d):
    """Price by quantity, discount and tax, fitted without each return flag and tried on it: coefficients and mean absolute error."""
    features = ["l_quantity", "l_discount", "l_tax"]
    rows = read(spark, d, "lineitem").select("l_returnflag", *features, "l_extendedprice")
    fits = learning.leave_one_group_out(rows, "l_returnflag", features, "l_extendedprice", 1.0)
    tried = rows.join(F.broadcast(fits), "l_returnflag")
    error = F.abs(learning.predict("coefficients", features) - F.col("l_extendedprice"))
    # Number by number: a group's first array would have Spark sort all rows by group.
    each = [F.first(F.element_at("coefficients", i + 1)).alias(f"_{i}") for i in range(len(features) + 1)]
    found = tried.groupBy("l_returnflag").agg(F.round(F.avg(error), 4).alias("mean_error"), *each)
    return found.select("l_returnflag", "mean_error", F.array(*(F.round(f"_{i}", 4) for i in range(len(each)))).alias("coefficients"))


def _gains(spark, d):
    return read(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("arm"), "l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_discount") - F.col("l_tax")).alias("gain"))


_BOUNDS = """n AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY substr(md5(unit), 1, 2), unit) - 1 AS number, count(*) OVER (PARTITION BY arm) AS units FROM u),
d AS (SELECT arm, round, CAST('0x' || substr(md5('42:' || round || ':' || number || ':' || arm), 1, 13) AS BIGINT) % units AS picked FROM n, range(500) r(round)),
m AS (SELECT d.arm, round, avg(gain) AS mean FROM d JOIN n ON n.arm = d.arm AND number = picked GROUP BY 1, 2),
b AS (SELECT arm, list_sort(list(mean))[25] AS lower, (count_if(mean <= 0) + 1) / 501 AS p, count_if(mean > 0) / 500 AS above FROM m GROUP BY 1),
w AS (SELECT arm, count(*) AS n, avg(gain) AS mean FROM u GROUP BY 1),
r AS (SELECT arm, n, round(mean, 9) AS mean, CASE WHEN n > 1 THEN round(lower, 9) END AS lower, CASE WHEN n > 1 THEN round(p, 9) END AS p, CASE WHEN n > 1 THEN round(above, 9) END AS above FROM w JOIN b USING (arm))"""
_TRIALS = "SELECT l_suppkey % 5 AS arm, CAST(l_suppkey AS VARCHAR) AS unit, avg(l_discount - l_tax) AS gain FROM lineitem GROUP BY 1, 2"
_CLUSTERS = f"SELECT arm, CAST(CAST(unit AS BIGINT) % 17 AS VARCHAR) AS unit, avg(gain) AS gain FROM ({_TRIALS}) GROUP BY 1, 2"


def _bounds(rows, unit):
    found = resampling.bootstrap_bounds(rows, ["arm"], unit, "gain", 500, 0.95, 42)
    return found.select("arm", "n", *(F.round(c, 9).alias(c) for c in ("mean", "lower", "p", "above")))


@query(f"WITH u AS ({_TRIALS}), {_BOUNDS} SELECT * FROM r")
def bootstrap_pair(spark, d):
    """Lower bound of the mean gain per arm, trials being suppliers."""
    return _bounds(_gains(spark, d), "l_suppkey")


@query(f"WITH u AS ({_CLUSTERS}), {_BOUNDS} SELECT * FROM r")
def bootstrap_cluster(spark, d):
    """The same over clusters of suppliers, gains averaged in each supplier and then in each cluster."""
    rows = _gains(spark, d).groupBy("arm", "l_suppkey").agg(F.avg("gain").alias("gain")).withColumn("cluster", F.col("l_suppkey") % 17)
    return _bounds(rows, "cluster")


@query(f"WITH u AS ({_TRIALS}), {_BOUNDS} SELECT a.arm, n, mean, lower, p, above, coalesce(n >= 10 AND mean >= 0.005 AND lower > 0, false) AS passed FROM range(7) a(arm) LEFT JOIN r ON r.arm = a.arm")
def promotion_matrix(spark, d):
    """Every arm and two that nobody measured against the least number, mean and bound."""
    required = spark.range(7).select(F.col("id").alias("arm"))
    return aggregation.promotion_matrix(_bounds(_gains(spark, d), "l_suppkey"), required, ["arm"], 10, 0.005)


@query(
    """WITH o AS (SELECT o_orderpriority AS arm, 'g' || CAST(o_orderkey % 12 AS VARCHAR) AS unit, o_orderdate >= '1998-04-01' AS late, o_totalprice / 100000 * CASE WHEN o_orderpriority < '3' AND o_orderdate >= '1998-04-01' THEN 1.5 ELSE 1 END AS q, o_totalprice FROM orders),
s AS (SELECT arm, unit, late, avg(q) AS q, count(*)::DOUBLE AS c, min(o_totalprice) < 30000 AS ok FROM o GROUP BY 1, 2, 3),
u AS (SELECT x.arm, x.unit, y.q - x.q AS gain, x.q AS q0, y.q AS q1, x.c AS c0, y.c AS c1, y.ok FROM s x JOIN s y ON x.arm = y.arm AND x.unit = y.unit AND NOT x.late AND y.late), """
    + _BOUNDS
    + """, t AS (SELECT arm, count(*) AS groups, bool_and(ok) AS all_eligible, min(gain) >= -0.4 AS no_regression, avg(q0) AS q0, avg(q1) AS q1, avg(c0) AS c0, avg(c1) AS c1 FROM u GROUP BY 1),
v AS (SELECT t.*, above AS probability, c1 <= c0 * 1.1 AS cheap FROM t JOIN b USING (arm)),
x AS (SELECT *, list_filter([CASE WHEN NOT all_eligible THEN 'physical_or_adversarial_gate_failed' END, CASE WHEN NOT no_regression THEN 'quality_regression' END,
  CASE WHEN probability < 0.95 THEN 'improvement_not_statistically_supported' END, CASE WHEN NOT cheap THEN 'cost_regression' END], lambda z: z IS NOT NULL) AS reasons FROM v)
SELECT arm, groups, len(reasons) = 0 AS promoted, CASE WHEN len(reasons) = 0 THEN 'new' END AS selected, reasons, all_eligible, no_regression, round(probability, 9) AS probability,
  round(q0, 9) AS incumbent_quality, round(q1, 9) AS challenger_quality, round(c0, 9) AS incumbent_cost, round(c1, 9) AS challenger_cost, cheap FROM x"""
)
def continual_promotion(spark, d):
    """Whether the orders after 1998-03 replace those before, by priority over twelve groups of orders, and every reason why not."""
    late = F.col("o_orderdate") >= "1998-04-01"
    quality = F.col("o_totalprice") / 100000 * F.when((F.col("o_orderpriority") < "3") & late, 1.5).otherwise(1.0)
    rows = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.concat(F.lit("g"), F.col("o_orderkey") % 12).alias("group"), late.alias("late"))
    rows = rows.agg(F.avg(quality).alias("quality"), F.count("*").cast("double").alias("cost"), (F.min("o_totalprice") < 30000).alias("eligible"), F.max(F.when(late, "new").otherwise("old")).alias("candidate"))
    found = resampling.decide_promotion(rows.filter(~F.col("late")), rows.filter("late"), ["arm"], most_regression=0.4, rounds=500, seed=42)
    rounded = ("probability", "incumbent_quality", "challenger_quality", "incumbent_cost", "challenger_cost")
    return found.select(*(F.round(c, 9).alias(c) if c in rounded else c for c in found.columns))


@query(
    """WITH l AS (SELECT l_returnflag AS model, CAST(l_suppkey AS VARCHAR) AS trial, CAST(l_suppkey % 40 AS VARCHAR) AS unit, l_discount, l_tax FROM lineitem),
t AS (SELECT model, metric, trial, unit, avg(v) AS v FROM (SELECT model, trial, unit, 'discount' AS metric, l_discount AS v FROM l UNION ALL SELECT model, trial, unit, 'tax', l_tax FROM l) GROUP BY ALL),
g AS (SELECT model, metric, unit, avg(v) AS v, count(*) AS trials FROM t GROUP BY ALL),
u AS (SELECT b.model || ':' || b.metric AS arm, b.model, b.metric, b.unit, CASE b.metric WHEN 'discount' THEN c.v - b.v ELSE b.v - c.v END AS gain, c.trials FROM g b JOIN g c USING (metric, unit) WHERE b.model <> 'N' AND c.model = 'N'), """
    + _BOUNDS
    + """, f AS (SELECT arm, any_value(model) AS baseline, any_value(metric) AS metric, CAST(sum(trials) AS BIGINT) AS raw_trials FROM u GROUP BY 1),
z AS (SELECT baseline, metric, metric = 'discount' AS higher, n, raw_trials, mean, lower, p, coalesce(lower > 0, false) AS positive, n >= 20 AS eligible FROM f JOIN r USING (arm))
SELECT *, min(positive) OVER w AS all_positive, min(eligible) OVER w AND min(positive) OVER w AS passed FROM z WINDOW w AS (PARTITION BY baseline)"""
)
def model_comparison(spark, d):
    """The lines of one return flag against those of the others, suppliers being trials of forty independent units."""
    metrics = F.explode(F.array(F.struct(F.lit("discount").alias("metric"), F.col("l_discount").alias("value")), F.struct(F.lit("tax").alias("metric"), F.col("l_tax").alias("value")))).alias("m")
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_suppkey").alias("trial"), (F.col("l_suppkey") % 40).alias("unit"), F.lit(0).alias("seed"), metrics)
    found = resampling.compare_models(rows.select("model", "trial", "unit", "seed", "m.metric", "m.value"), "N", {"discount": True, "tax": False}, rounds=500, seed=42)
    return found.select(*(F.round(c, 9).alias(c) if c in ("mean", "lower", "p") else c for c in found.columns))
