"""Time series of events: deltas, smoothing, as-of lookups, runs, intervals."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loomspark.functions import scalar
from loomspark.operators import joins, series
from loomspark.queries import query, read

E = "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"
WRAP = "({0}) + pi() - 2 * pi() * floor((({0}) + pi()) / (2 * pi())) - pi()"


def _events(spark, d):
    return series.with_ordinal(read(spark, d, "events"), ["user_id"], ["ts", "event_id"])


def _rounded(df, *names):
    return df.select(*(F.round(c, 5).alias(c) if c in names else c for c in df.columns))


@query(f"{E} SELECT event_id, round({WRAP.format('value - lag(value) OVER (PARTITION BY user_id ORDER BY i)')}, 5) AS delta FROM e")
def delta_wrap(spark, d):
    return _rounded(series.wrapped_delta(_events(spark, d), ["user_id"], "i", "value").select("event_id", "delta"), "delta")


@query(f"{E} SELECT event_id, round({WRAP.format('0.25 + sum(value) OVER (PARTITION BY user_id ORDER BY i)')}, 4) AS state FROM e")
def integrate_wrap(spark, d):
    found = series.integrate_wrapped(_events(spark, d), ["user_id"], "i", "value", F.lit(0.25))
    return found.select("event_id", F.round("state", 4).alias("state"))


@query(f"{E} SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 5) AS median FROM e")
def median_filter(spark, d):
    return _rounded(series.centred_median(_events(spark, d), ["user_id"], "i", "value", 3).select("event_id", "median"), "median")


@query(
    f"""{E}, m AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v FROM e)
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN median(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 5) AS median FROM m"""
)
def median_keeping_gaps(spark, d):
    rows = _events(spark, d).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return _rounded(series.centred_median(rows, ["user_id"], "i", "v", 2, keep_gaps=True).select("event_id", "median"), "median")


_K = [math.exp(-0.5 * (k / 1.0) ** 2) for k in range(-3, 4)]
_TERMS = " + ".join(
    f"{w / sum(_K)!r} * coalesce({'lag' if k < 0 else 'lead'}(value, {abs(k)}) OVER w, {'first' if k < 0 else 'last'}_value(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    for k, w in zip(range(-3, 4), _K, strict=True)
)


@query(f"{E} SELECT event_id, round({_TERMS}, 5) AS smooth FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)")
def gauss_smooth(spark, d):
    return _rounded(series.gaussian(_events(spark, d), ["user_id"], "i", "value", 1.0).select("event_id", "smooth"), "smooth")


@query(
    f"""{E} SELECT event_id, round(value / greatest(list_median(list_concat(
  coalesce(list(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []), coalesce(list(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), []))), 0.1), 5) AS ratio FROM e"""
)
def local_ratio(spark, d):
    return _rounded(series.local_ratio(_events(spark, d), ["user_id"], "i", "value", 6, 0.1, False).select("event_id", "ratio"), "ratio")


@query(f"{E} SELECT event_id, abs(value - median(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) > 30 AS outlier FROM e")
def median_outliers(spark, d):
    return series.median_outliers(_events(spark, d), ["user_id"], "i", "value", 4, 30.0).select("event_id", "outlier")


#: Greedy choice over the list r of [place, score] by score: a place is kept if none kept is nearer than {0}.
KEPT = "list_reduce(list_transform(r, lambda x: [x]), lambda kept, x: CASE WHEN list_min(list_transform(kept, lambda k: abs(k[1] - x[1][1]))) >= {0} THEN list_concat(kept, x) ELSE kept END)"


@query(
    f"""{E}, s AS (SELECT user_id, i, value / greatest(median(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 0.000001) AS ratio FROM e),
g AS (SELECT user_id, list([i::DOUBLE, ratio] ORDER BY ratio DESC, i) AS r FROM s WHERE ratio > 2 GROUP BY 1), k AS (SELECT user_id, unnest({KEPT.format(5)}) AS x FROM g)
SELECT user_id, CAST(x[1] AS BIGINT) AS i, round(x[2], 5) AS ratio FROM k"""
)
def spike_nms(spark, d):
    """Events above twice the median around them, the strongest of those within five rows of each other."""
    found = series.local_ratio(_events(spark, d), ["user_id"], "i", "value", 12, 1e-6, True).filter("ratio > 2")
    kept = series.non_maximum_suppression(found.select("user_id", F.col("i").cast("long").alias("i"), "ratio"), "user_id", "i", "ratio", 5)
    return _rounded(kept, "ratio")


@query(
    f"""{E}, d AS (SELECT user_id, i, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY i)) AS step, count(*) OVER (PARTITION BY user_id) - i AS n FROM e),
s AS (SELECT user_id, i, n, round(sum(step) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING), 6) AS score FROM d),
g AS (SELECT user_id, list([i::DOUBLE, score] ORDER BY score DESC, i) AS r FROM s WHERE n >= 10 GROUP BY 1), k AS (SELECT user_id, {KEPT.format(10)} AS x FROM g),
t AS (SELECT user_id, unnest(x[1:2]) AS x, unnest(range(1, least(len(x), 2) + 1)) AS place FROM k)
SELECT user_id, CAST(x[1] AS BIGINT) AS i, x[2] AS score, CAST(place AS INTEGER) AS place FROM t"""
)
def motion_topk(spark, d):
    """The two windows of ten events of each user with the largest steps, at least ten apart."""
    rows = _events(spark, d)
    step = F.abs(F.col("value") - F.expr("lag(value) OVER (PARTITION BY user_id ORDER BY i)"))
    total = F.expr("sum(step) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING)")
    scored = rows.withColumn("step", step).withColumn("score", F.round(total, 6)).withColumn("left", F.expr("count(*) OVER (PARTITION BY user_id)") - F.col("i"))
    scored = scored.filter("left >= 10").select("user_id", F.col("i").cast("long").alias("i"), "score")
    kept = series.non_maximum_suppression(scored, "user_id", "i", "score", 10)
    rank = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY score DESC, i)")
    return kept.withColumn("place", rank).filter("place <= 2")


ISLANDS = """WITH d AS (SELECT DISTINCT user_id, day(ts) AS pos FROM events), g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS run FROM d),
i AS (SELECT user_id, min(pos) AS first, max(pos) AS last, count(*) AS length FROM g GROUP BY user_id, run)"""


def _islands(spark, d):
    days = read(spark, d, "events").select("user_id", F.dayofmonth("ts").cast("long").alias("at"))
    return series.islands(days, ["user_id"], "at")


@query(ISLANDS + " SELECT user_id, first, last, length FROM i")
def islands(spark, d):
    return _islands(spark, d)


MERGED = ISLANDS + """, x AS (SELECT *, CASE WHEN first - 1 < max(last + 1) OVER (PARTITION BY user_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM i),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY first, last) AS run FROM x), z AS (SELECT user_id, min(first) AS s, max(last + 1) AS e, count(*) AS merged FROM y GROUP BY user_id, run)"""


@query(MERGED + " SELECT user_id, s, e, merged FROM z")
def interval_merge(spark, d):
    runs = _islands(spark, d).select("user_id", F.col("first").alias("s"), (F.col("last") + 1).alias("e"))
    return series.merge_intervals(runs, ["user_id"], "s", "e", 1)


@query(ISLANDS + " SELECT user_id, CAST(sum(length) AS BIGINT) AS covered FROM i GROUP BY 1")
def covered_length(spark, d):
    runs = _islands(spark, d).select("user_id", F.col("first").alias("s"), (F.col("last") + 1).alias("e"))
    doubled = runs.union(runs.filter("e - s > 2").select("user_id", F.col("s") + 1, F.col("e")))
    return series.covered(doubled, ["user_id"], "s", "e")


HYST = E + """, s AS (SELECT *, CASE WHEN value >= 60 THEN 0 WHEN value <= 20 THEN 1 END AS sw FROM e),
a AS (SELECT *, coalesce(last_value(sw IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS active FROM s)"""


@query(HYST + " SELECT event_id, active FROM a")
def hysteresis(spark, d):
    return series.hysteresis(_events(spark, d), ["user_id"], "i", "value", 20.0, 60.0).select("event_id", "active")


@query(
    HYST
    + """, r AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM a WHERE active),
q AS (SELECT user_id, min(i) AS s, max(i) + 1 AS e FROM r GROUP BY user_id, run),
x AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY user_id ORDER BY s) <= 1 THEN 0 ELSE 1 END AS new FROM q), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s) AS run FROM x)
SELECT user_id, min(s) AS start, max(e) AS "end" FROM y GROUP BY user_id, run HAVING max(e) - min(s) >= 3"""
)
def hysteresis_intervals(spark, d):
    rows = series.hysteresis(_events(spark, d), ["user_id"], "i", "value", 20.0, 60.0).withColumn("i", F.col("i").cast("long"))
    return series.active_intervals(rows, ["user_id"], "i", "active", 3, 1)


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations), g AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, role ORDER BY i) AS run FROM e)
SELECT conv_id, role, min(i) AS start, max(i) + 1 AS "end" FROM g GROUP BY conv_id, role, run"""
)
def run_length_phase(spark, d):
    found = series.phases(read(spark, d, "conversations"), ["conv_id"], "turn", ["role"])
    return found.select("conv_id", "role", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    f"""{E}, b AS (SELECT *, count(*) FILTER (WHERE NOT (value > 50)) OVER (PARTITION BY user_id ORDER BY i) AS block FROM e), c AS (SELECT user_id, block, count(*) FILTER (WHERE value > 50) AS n FROM b GROUP BY ALL)
SELECT user_id, max(n) AS longest FROM c GROUP BY 1"""
)
def longest_run(spark, d):
    return series.longest_run(_events(spark, d), ["user_id"], "i", F.col("value") > 50)


@query(
    f"""{E}, r AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS hit FROM e)
SELECT event_id, hit - i AS lag, hit IS NOT NULL AS responded FROM r WHERE event_type = 'error'"""
)
def response_lag(spark, d):
    found = series.response_lag(_events(spark, d), ["user_id"], "i", F.col("event_type") == "error", F.col("event_type") == "purchase", 5)
    return found.select("event_id", F.col("lag").cast("long").alias("lag"), "responded")


@query(
    f"""{E}, p AS (SELECT *, value - lag(value) OVER w AS step, lag(value < 30) OVER w AS was FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT event_id, CASE WHEN value < 30 AND NOT coalesce(was, false) THEN 'grasp' WHEN value < 30 AND step > 0 THEN 'lift' WHEN value < 30 THEN 'hold' WHEN coalesce(was, false) THEN 'release' ELSE 'free' END AS phase FROM p"""
)
def phase_infer(spark, d):
    rows = _events(spark, d).withColumn("step", F.expr("value - lag(value) OVER (PARTITION BY user_id ORDER BY i)")).withColumn("was", F.expr("coalesce(lag(value < 30) OVER (PARTITION BY user_id ORDER BY i), false)"))
    near = F.col("value") < 30
    from loomspark.operators.gates import first_reason

    phase = first_reason([(near & ~F.col("was"), "grasp"), (near & (F.col("step") > 0), "lift"), (near, "hold"), (F.col("was"), "release")], "free")
    return rows.select("event_id", phase.alias("phase"))


@query(f"{E}, s AS (SELECT user_id, abs(value - 2 * lag(value) OVER w + lag(value, 2) OVER w) AS x FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, round(coalesce(avg(x), 0), 4) AS jerk FROM s GROUP BY 1")
def jerk(spark, d):
    return series.jerk(_events(spark, d), ["user_id"], "i", "value").withColumn("jerk", F.round("jerk", 4))


K = """WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
k AS (SELECT user_id, epoch_us(ts) AS t, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL)"""


def _click_and_purchase(spark, d):
    rows = read(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.filter("event_type = 'click'").select("event_id", "user_id", "t"), rows.filter("event_type = 'purchase'").select("user_id", "t", "value")


@query(
    K
    + """, j AS (SELECT p.*, (SELECT max(k.t) FROM k WHERE k.user_id = p.user_id AND k.t <= p.t) AS b, (SELECT min(k.t) FROM k WHERE k.user_id = p.user_id AND k.t >= p.t) AS a FROM p)
SELECT event_id, round(CASE WHEN kb.t = j.t THEN kb.v WHEN kb.t IS NOT NULL AND ka.t IS NOT NULL THEN kb.v + (ka.v - kb.v) * (j.t - kb.t) / (ka.t - kb.t)
  WHEN j.t - kb.t <= 86400000000 THEN kb.v WHEN ka.t - j.t <= 86400000000 THEN ka.v END, 5) AS value
FROM j LEFT JOIN k kb ON kb.user_id = j.user_id AND kb.t = b LEFT JOIN k ka ON ka.user_id = j.user_id AND ka.t = a"""
)
def asof_interp(spark, d):
    points, knots = _click_and_purchase(spark, d)
    return series.as_of(points, knots, ["user_id"], "t", "value", 86_400_000_000).select("event_id", F.round("value", 5).alias("value"))


@query(
    K
    + """ SELECT event_id, (SELECT arg_min(k.t, (abs(k.t - p.t), k.t)) FROM k WHERE k.user_id = p.user_id) AS near FROM p"""
)
def nearest_ts(spark, d):
    points, knots = _click_and_purchase(spark, d)
    return series.nearest(points, knots, ["user_id"], "t", "near").select("event_id", "near")


@query(
    """WITH e AS (SELECT user_id, epoch_us(ts) / 3.6e9 AS t, value AS v FROM events), k AS (SELECT user_id, t, max(v) AS v FROM e GROUP BY ALL),
r AS (SELECT user_id, min(t) AS lo, CAST(floor((max(t) - min(t)) / 6.0 + 1e-9) AS BIGINT) AS n FROM k GROUP BY 1), g AS (SELECT user_id, lo + i * 6.0 AS t, i AS k FROM r, unnest(range(0, n + 1)) u(i))
SELECT g.user_id, CAST(g.k AS BIGINT) AS k, round(CASE WHEN b.t = g.t THEN b.v ELSE b.v + (a.v - b.v) * (g.t - b.t) / (a.t - b.t) END, 3) AS value
FROM g ASOF JOIN k b ON b.user_id = g.user_id AND b.t <= g.t ASOF LEFT JOIN k a ON a.user_id = g.user_id AND a.t >= g.t"""
)
def resample_linear(spark, d):
    rows = read(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("t"), "value")
    return series.resample(rows, ["user_id"], "t", "value", 6.0).select("user_id", F.col("k").cast("long").alias("k"), F.round("value", 3).alias("value"))


@query(
    f"""{E}, m AS (SELECT *, CASE WHEN event_type IN ('click', 'purchase') THEN value END AS v FROM e),
b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bi,
  last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bv,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ai,
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS av FROM m)
SELECT event_id, round(CASE WHEN bi IS NULL OR ai IS NULL THEN coalesce(bv, av) WHEN ai = bi THEN bv ELSE bv + (av - bv) * (i - bi) / (ai - bi) END, 5) AS filled FROM b"""
)
def gap_fill(spark, d):
    rows = _events(spark, d).withColumn("v", F.when(F.col("event_type").isin("click", "purchase"), F.col("value")))
    return _rounded(series.fill_linear(rows, ["user_id"], "i", "v").select("event_id", "filled"), "filled")


@query(
    """WITH a AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE event_type = 'purchase'),
p AS (SELECT a.user_id, b.t - a.t AS off FROM a JOIN b USING (user_id, i)), m AS (SELECT user_id, median(off) AS med, count(*) AS n FROM p GROUP BY 1)
SELECT user_id, n AS pairs, round(med, 3) AS offset, round(quantile_disc(abs(off - med), 0.95), 3) AS p95, round(max(abs(off - med)), 3) AS most FROM p JOIN m USING (user_id) GROUP BY ALL"""
)
def stream_alignment(spark, d):
    rows = read(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    found = series.alignment(rows.filter("event_type = 'click'"), rows.filter("event_type = 'purchase'"), ["user_id"], "t")
    return found.select("user_id", "pairs", *(F.round(c, 3).alias(c) for c in ("offset", "p95", "most")))


@query(
    """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, day(ts) * 24 + hour(ts) AS s, day(ts) * 24 + hour(ts) + 30 AS e FROM events)
SELECT user_id, n, s AS lower, least(e, coalesce(lead(s) OVER w - 1, e), coalesce(lag(e) OVER w + 1, e)) AS upper FROM r WINDOW w AS (PARTITION BY user_id ORDER BY n)"""
)
def takeover_range(spark, d):
    hour = (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("long")
    rows = read(spark, d, "events").select("user_id", F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)").alias("n"), hour.alias("s"), (hour + 30).alias("e"))
    return joins.takeover(rows, ["user_id"], "n", "s", "e").select("user_id", "n", "lower", "upper")


@query(
    """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS shot, day(ts) * 24 + hour(ts) AS a, day(ts) * 24 + hour(ts) + 12 AS b FROM events WHERE event_type = 'purchase')
SELECT e.event_id, s.shot FROM events e JOIN s ON s.user_id = e.user_id AND day(e.ts) * 24 + hour(e.ts) BETWEEN a AND b WHERE e.event_type = 'error'"""
)
def interval_containment(spark, d):
    hour = (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("long")
    events = read(spark, d, "events").withColumn("at", hour)
    shots = events.filter("event_type = 'purchase'").select("user_id", F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)").alias("shot"), F.col("at").alias("a"), (F.col("at") + 12).alias("b"))
    return joins.range_join(events.filter("event_type = 'error'").select("event_id", "user_id", "at"), shots, ["user_id"], "at", "a", "b", 24).select("event_id", "shot")


@query(
    f"""{E}, r AS (SELECT user_id, i, count(*) OVER (PARTITION BY user_id) - 1 AS last FROM e)
SELECT user_id, i, round(CASE WHEN i < 2 OR i > last - 1 THEN 0 ELSE least(1, (i - 1) / 5.0, (last - i) / 5.0) END, 6) AS ramp, round(0.5 - 0.5 * cos(pi() * least(greatest((i + 0.5) / 8, 0), 1)), 6) AS fade,
  round(CASE WHEN i < 2 OR i > last - 1 THEN 0 ELSE least(1, (i - 2) / 4.0, (last - 1 - i) / 4.0) END, 6) AS trapezoid FROM r"""
)
def interval_weights(spark, d):
    rows = _events(spark, d).withColumn("last", F.expr("count(*) OVER (PARTITION BY user_id)") - 1)
    i, end = F.col("i"), F.col("last") - 1
    return rows.select(
        "user_id",
        F.col("i").cast("long").alias("i"),
        F.round(scalar.ramp_weight(i, F.lit(2), end, 4), 6).alias("ramp"),
        F.round(scalar.raised_cosine(i, F.lit(0), 8), 6).alias("fade"),
        F.round(scalar.trapezoid_weight(i, F.lit(2), end, 4.0), 6).alias("trapezoid"),
    )
