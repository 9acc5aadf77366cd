"""Routing, ranking, caps and windows over frame numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import framing, selection
from loomspark.queries import query, read

OK = "l_discount <= 0.05 AND l_tax <= 0.06 AND l_returnflag <> 'R'"
ROUTES = f"""
SELECT l_orderkey, list_sort(list(l_linenumber)) AS candidates, coalesce(list_sort(list(l_linenumber) FILTER (WHERE {OK})), []) AS accepted,
       arg_min(l_linenumber, (l_extendedprice, l_linenumber)) FILTER (WHERE {OK}) AS oracle, min(l_extendedprice) FILTER (WHERE {OK}) AS oracle_latency
FROM lineitem GROUP BY 1"""
PLACE = "l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"


@query(ROUTES)
def route_oracle(spark, d):
    return selection.route_rollup(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.expr(OK), "l_extendedprice")


@query(
    f"""WITH r AS ({ROUTES}) SELECT CASE WHEN oracle IS NULL THEN 'unlabelled' ELSE 'labelled' END AS kind, count(*) AS requests,
  CAST(sum(len(candidates)) AS BIGINT) AS candidates, CAST(sum(len(accepted)) AS BIGINT) AS accepted FROM r GROUP BY 1"""
)
def route_standard_export(spark, d):
    found = selection.route_rollup(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.expr(OK), "l_extendedprice")
    kind = F.when(F.col("oracle").isNull(), "unlabelled").otherwise("labelled").alias("kind")
    return found.groupBy(kind).agg(F.count("*").alias("requests"), F.sum(F.size("candidates")).alias("candidates"), F.sum(F.size("accepted")).alias("accepted"))


@query(
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {PLACE}) AS i, {OK} AS ok FROM lineitem),
f AS (SELECT *, min(i) FILTER (WHERE ok) OVER (PARTITION BY l_orderkey) AS hit FROM n)
SELECT l_orderkey, count(*) AS attempts, round(sum(l_quantity), 2) AS spent, bool_or(ok) AS accepted FROM f WHERE hit IS NULL OR i <= hit GROUP BY 1"""
)
def logo_replay(spark, d):
    order = [F.col(c.strip()) for c in PLACE.split(",")]
    found = selection.replay(read(spark, d, "lineitem"), "l_orderkey", order, F.expr(OK), "l_quantity")
    return found.withColumn("spent", F.round("spent", 2))


LINES = f"WITH n AS (SELECT l_orderkey, l_extendedprice, {OK} AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY {PLACE}) AS i FROM lineitem)"


def _numbered(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", F.expr(OK).alias("ok"), F.expr(f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {PLACE})").alias("i"))


@query(
    LINES
    + """, b AS (SELECT l_orderkey, arg_min(i, (-l_extendedprice, i)) AS chosen, max(l_extendedprice) AS best FROM n WHERE ok GROUP BY 1)
SELECT l_orderkey, chosen, i AS rejected, round(best - l_extendedprice, 2) AS gap FROM n JOIN b USING (l_orderkey) WHERE i <> chosen"""
)
def pref_pairs(spark, d):
    found = selection.preference_pairs(_numbered(spark, d), "l_orderkey", "l_extendedprice", "i", F.col("ok"))
    return found.select("l_orderkey", "chosen", "rejected", F.round("gap", 2).alias("gap"))


@query(
    """SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size <= 25) DESC, length(p_name) DESC, p_retailprice DESC, p_partkey DESC) AS n FROM part) WHERE n = 1"""
)
def lexi_argmax(spark, d):
    order = [(F.col("p_size") <= 25).desc(), F.length("p_name").desc(), F.col("p_retailprice").desc(), F.col("p_partkey").desc()]
    return selection.best_per_group(read(spark, d, "part"), ["p_brand"], order).select("p_brand", "p_partkey")


@query(
    """WITH r AS (SELECT *, p_size <= 3 AS ok, bool_or(p_size <= 3) OVER (PARTITION BY p_type) AS found FROM part)
SELECT p_type, p_partkey, CASE WHEN found THEN 'eligible' ELSE 'fallback' END AS chosen_as FROM (
  SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY ok DESC, CASE WHEN found THEN p_retailprice ELSE -p_retailprice END, p_partkey) AS n FROM r) WHERE n = 1"""
)
def candidate_fallback(spark, d):
    found = selection.best_with_fallback(
        read(spark, d, "part"), ["p_type"], F.col("p_size") <= 3, [F.col("p_retailprice"), F.col("p_partkey")], [F.col("p_retailprice").desc(), F.col("p_partkey")]
    )
    return found.select("p_type", "p_partkey", "chosen_as")


@query(
    """SELECT o_custkey, o_orderkey, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n <= 3"""
)
def cap_per_group(spark, d):
    return selection.cap_per_group(read(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@query(
    """WITH s AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS priority, n_nationkey % 4 = 0 AS done FROM nation),
e AS (SELECT n_nationkey AS k, n_nationkey - 3 AS needed FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT n_nationkey, CAST(n_nationkey / 2 AS INTEGER) FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey > 0),
o AS (SELECT e.k, count(*) FILTER (WHERE NOT coalesce(s.done, false)) AS n FROM e LEFT JOIN s ON s.k = e.needed GROUP BY 1),
u AS (SELECT needed AS k, count(DISTINCT k) AS n FROM e GROUP BY 1)
SELECT s.k, coalesce(o.n, 0) AS open_needs, coalesce(u.n, 0) AS unblocks,
  row_number() OVER (ORDER BY coalesce(o.n, 0), coalesce(u.n, 0) DESC, priority DESC, s.k) AS place FROM s LEFT JOIN o ON o.k = s.k LEFT JOIN u ON u.k = s.k"""
)
def dag_rank(spark, d):
    nodes = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("priority"), (F.col("n_nationkey") % 4 == 0).alias("done"))
    needs = nodes.filter("k % 3 = 1").select("k", (F.col("k") - 3).alias("needed")).union(nodes.filter("k % 2 = 0 AND k > 0").select("k", (F.col("k") / 2).cast("int")))
    return selection.dag_rank(nodes, needs, "k", "needed", "priority", F.col("done")).select("k", "open_needs", "unblocks", "place")


@query("SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS shard FROM orders")
def ntile_shards(spark, d):
    return framing.contiguous_shards(read(spark, d, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")], 7).select("o_orderkey", "shard")


@query(
    """SELECT user_id, k AS shard, CAST(5 + k * (n // 3) + least(k, n % 3) AS BIGINT) AS start, CAST(n // 3 + CASE WHEN k < n % 3 THEN 1 ELSE 0 END AS BIGINT) AS count
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), range(3) r(k)"""
)
def shard_plans(spark, d):
    totals = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return totals.select("user_id", F.explode(framing.shard_plan(F.col("n"), 3, F.lit(5))).alias("p")).select("user_id", F.col("p.shard").cast("long").alias("shard"), "p.start", "p.count")


@query(
    """WITH s AS (SELECT doc_id, n_chars, greatest(CAST(ceil(n_chars / 4.0) AS BIGINT), 1) AS span FROM documents)
SELECT doc_id, CAST(f AS BIGINT) AS first, least(f + span - 1, n_chars - 1) AS last FROM s, unnest(range(0, n_chars, span)) u(f)"""
)
def byte_ranges(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.explode(framing.byte_ranges(F.col("n_chars"), 4)).alias("r"))
    return rows.select("doc_id", "r.first", "r.last")


LENGTHS = "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)"


def _hop(rule):
    def run(spark, d):
        counts = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
        return framing.hopping(counts, "n", 24, 8, rule).select("user_id", F.col("window_no").cast("long").alias("window_no"), "start", "frames")

    return run


HOPS = {
    "terminal": "SELECT DISTINCT user_id, n, unnest(CASE WHEN n < 24 THEN [] ELSE list_append(range(0, n - 23, 16), n - 24) END) AS start FROM c",
    "clamped": "SELECT DISTINCT user_id, n, unnest(CASE WHEN n < 24 THEN [0] ELSE list_append(range(0, n - 23, 16), n - 24) END) AS start FROM c",
    "short_tail": "SELECT user_id, n, s AS start FROM c, unnest(range(0, n, 16)) u(s) WHERE s = 0 OR s + 8 < n",
    "merge_last_two": "SELECT DISTINCT user_id, n, unnest(CASE WHEN n <= 24 THEN [0] ELSE list_append(list_filter(range(0, n, 16), lambda s: s = 0 OR s + 16 <= n - 24), n - 24) END) AS start FROM c",
    "drop_short": "SELECT user_id, n, s AS start FROM c, unnest(range(0, n, 16)) u(s) WHERE n - s >= 2",
}
for _rule, _sql in HOPS.items():
    _f = _hop(_rule)
    _f.__name__ = f"hop_windows_{_rule}"
    query(f"{LENGTHS}, w AS ({_sql}) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS window_no, CAST(start AS BIGINT) AS start, least(24, n - start) AS frames FROM w")(_f)


@query(
    """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) AS run FROM e),
p AS (SELECT user_id, event_type, min(i) AS a, max(i) + 1 AS b FROM g GROUP BY user_id, event_type, run),
c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), w AS (SELECT user_id, n, s AS start FROM c, unnest(range(0, n, 16)) u(s) WHERE s = 0 OR s + 8 < n)
SELECT w.user_id, CAST(start AS BIGINT) AS start, list(event_type ORDER BY a) AS phases FROM w JOIN p ON p.user_id = w.user_id AND a < start + least(24, n - start) AND b > start GROUP BY w.user_id, start"""
)
def window_phase_overlap(spark, d):
    from loomspark.operators import series

    events = read(spark, d, "events")
    numbered = series.with_ordinal(events, ["user_id"], ["ts", "event_id"])
    runs = series.phases(numbered, ["user_id"], "i", ["event_type"])
    windows = framing.hopping(events.groupBy("user_id").agg(F.count("*").alias("n")), "n", 24, 8, "short_tail")
    return framing.windows_with_phases(windows, runs, ["user_id"], "event_type").select("user_id", "start", "phases")


@query(
    """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT user_id, n, k, CAST(round_even(k * (n - 1) / 4.0, 0) AS BIGINT) AS rank FROM c, range(5) t(k))
SELECT user_id, list(DISTINCT rank ORDER BY rank) AS ranks FROM r GROUP BY 1"""
)
def evenly_spaced(spark, d):
    counts = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", framing.evenly_spaced(F.col("n"), 5).alias("ranks"))
