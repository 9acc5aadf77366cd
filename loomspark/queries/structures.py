"""Graphs, ordered folds, packed tracks, contracts and models of several targets on the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import contracts, folding, graphs, learning, tracks
from loomspark.queries import query, read
from loomspark.queries.statistics import _PAIRS, _SOLVED, _X, _moment

_EDGES = """WITH RECURSIVE l AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS b, l_quantity AS cost FROM lineitem),
e AS (SELECT a AS u, b AS v, min(cost) AS cost FROM (SELECT a, b, cost FROM l WHERE cost >= 46 UNION ALL SELECT b, a, cost FROM l WHERE cost >= 46) WHERE a <> b GROUP BY 1, 2)"""


def _edges(spark, d):
    """Parts that follow each other in an order, where the first of them is ordered in large numbers."""
    after = F.expr("lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)")
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), after.alias("b"), F.col("l_quantity").alias("cost")).filter("cost >= 46 AND b IS NOT NULL")


_PATHS = _EDGES + """, p(node, distance) USING KEY (node) AS (SELECT min(u), 0::DOUBLE FROM e UNION
SELECT e.v, min(p.distance + e.cost) FROM p JOIN e ON p.node = e.u LEFT JOIN recurring.p AS r ON r.node = e.v WHERE r.distance IS NULL OR p.distance + e.cost < r.distance GROUP BY e.v)"""


def _paths(spark, d):
    edges = _edges(spark, d)
    start = edges.filter("a <> b").agg(F.least(F.min("a"), F.min("b")).alias("start"))
    return graphs.cheapest_paths(edges, start, "a", "b", "cost", "start")


@query(_PATHS + " SELECT (SELECT min(u) FROM e) AS source, node, distance FROM p")
def cheapest_paths(spark, d):
    """Distances from the first part to all that it reaches."""
    return _paths(spark, d)


@query(_PATHS + " SELECT (SELECT min(u) FROM e) AS source, node, distance FROM p ORDER BY distance DESC, node LIMIT 1")
def farthest_node(spark, d):
    return graphs.farthest(_paths(spark, d))


_ROOTS = _EDGES + """, r(node, root) USING KEY (node) AS (SELECT p_partkey, p_partkey FROM part UNION
SELECT e.v, min(r.root) FROM r JOIN e ON r.node = e.u JOIN recurring.r AS o ON o.node = e.v WHERE r.root < o.root GROUP BY e.v)"""


@query(_ROOTS + " SELECT node, root FROM r")
def part_components(spark, d):
    """The smallest part that each part is connected with."""
    return graphs.components(_edges(spark, d), read(spark, d, "part"), "a", "b", "p_partkey")


@query(_ROOTS + ", s AS (SELECT root FROM r GROUP BY 1 ORDER BY count(*) DESC, root LIMIT 1) SELECT node, root FROM r JOIN s USING (root)")
def largest_component(spark, d):
    return graphs.largest_component(part_components(spark, d))


@query(
    """SELECT user_id, event_type, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, b: CASE event_type WHEN 'click' THEN a * 0.7 + b WHEN 'view' THEN b - a ELSE b END), 6) AS value, count(*) AS n FROM events GROUP BY 1, 2"""
)
def ordered_fold(spark, d):
    """Clicks that decay, views as alternating differences, of all others the last."""
    reducers = {"click": lambda old, new: old * 0.7 + new, "view": lambda old, new: new - old}
    found = folding.ordered_fold(read(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"], "value", reducers)
    return found.withColumn("value", F.round("value", 6))


def _hex(sign):
    bits = lambda byte: " + ".join(f"CASE WHEN embedding[{8 * byte + k + 1}] {sign} 0 THEN {1 << k} ELSE 0 END" for k in range(8))
    return " || ".join(f"printf('%02X', {bits(byte)})" for byte in range(8))


_TRACK = f"""WITH t AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, {_hex('>')} AS packed, {_hex('<')} AS other FROM embeddings)"""


def _track(spark, d, positive=True):
    rows = read(spark, d, "embeddings").withColumn("frame", F.expr("row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1"))
    mask = F.transform("embedding", (lambda x: x > 0) if positive else (lambda x: x < 0))
    return rows.select("label", "frame", tracks.packed_bits(mask).alias("packed"), F.lit(64).alias("bits"))


@query(_TRACK + " SELECT label, frame - 3 AS frame, frame AS parent_frame, packed FROM t WHERE frame >= 3 AND frame < 20")
def track_slices(spark, d):
    """Frames 3 to 19 of the packed signs of each label's vectors."""
    found = tracks.slice_tracks(_track(spark, d), "label", "frame", 3, 20)
    long = lambda c: F.col(c).cast("long").alias(c)
    return found.select("label", long("frame"), long("parent_frame"), F.hex("packed").alias("packed"))


@query(_TRACK + " SELECT label, frame, CASE WHEN label % 2 = 0 THEN packed ELSE other END AS packed, label % 2 AS part FROM t WHERE frame < 20 AND label <= 4")
def track_merge(spark, d):
    """Some labels of a track of positive signs and some of one of negative signs, as one track."""
    one, other = (tracks.slice_tracks(_track(spark, d, positive), "label", "frame", 0, 20) for positive in (True, False))
    found = tracks.merge_tracks([(one, [0, 2, 4]), (other, [1, 3])], "label", "frame", "bits")
    return found.select("label", F.col("frame").cast("long").alias("frame"), F.hex("packed").alias("packed"), "part")


@query(
    """WITH o AS (SELECT o_custkey, 'c' || o_custkey || '/' || CASE o_orderpriority WHEN '1-URGENT' THEN 'metadata_' || (o_orderkey % 3) || '.json' WHEN '2-HIGH' THEN 'trajectory.h5' WHEN '3-MEDIUM' THEN 'recordings/SVO/' || (o_orderkey % 100) || '.svo' ELSE 'recordings/MP4/' || o_orderkey || '.mp4' END AS path FROM orders),
k AS (SELECT *, CASE WHEN path LIKE '%.json' THEN 'metadata' WHEN path LIKE '%.h5' THEN 'trajectory' WHEN path LIKE '%.svo' THEN 'camera' END AS kind FROM o), n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, path) AS copies FROM k WHERE kind IS NOT NULL),
c AS (SELECT *, max(copies) OVER w AS most, count_if(kind = 'metadata') OVER w AS m, count_if(kind = 'trajectory') OVER w AS t, count_if(kind = 'camera') OVER w AS s FROM n WINDOW w AS (PARTITION BY o_custkey))
SELECT o_custkey, path, kind, CASE WHEN most > 1 THEN 'a path occurs twice' WHEN m <> 1 THEN '1 metadata needed, found ' || m WHEN t <> 1 THEN '1 trajectory needed, found ' || t WHEN s <> 3 THEN '3 camera needed, found ' || s END AS fault FROM c"""
)
def path_contract(spark, d):
    """Files of each customer, of which there have to be one of metadata, one trajectory and three recordings."""
    i, name = F.col("o_orderkey"), F.col("o_orderpriority")
    file = F.when(name == "1-URGENT", F.concat(F.lit("metadata_"), i % 3, F.lit(".json"))).when(name == "2-HIGH", "trajectory.h5").when(name == "3-MEDIUM", F.concat(F.lit("recordings/SVO/"), i % 100, F.lit(".svo"))).otherwise(F.concat(F.lit("recordings/MP4/"), i, F.lit(".mp4")))
    rows = read(spark, d, "orders").select("o_custkey", F.concat(F.lit("c"), "o_custkey", F.lit("/"), file).alias("path"))
    kinds = {"metadata": (r"c\d+/metadata_\d+\.json", 1), "trajectory": (r"c\d+/trajectory\.h5", 1), "camera": (r"c\d+/recordings/SVO/\d+\.svo", 3)}
    return contracts.by_pattern(rows, ["o_custkey"], "path", kinds)


@query(
    """SELECT vec_id, CASE WHEN ok THEN ['qx', 'qy', 'qz', 'qw'] ELSE old END AS labels, old AS old_labels, ok AS relabelled FROM (SELECT vec_id, CASE WHEN label % 2 = 0 THEN ['c0', 'c1', 'c2', 'c3'] ELSE ['a', 'b', 'c', 'd'] END AS old,
label % 2 = 0 AND abs(sqrt(e[1]**2 + e[2]**2 + e[3]**2 + e[4]**2) - 0.25) <= 0.1 AS ok FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""
)
def channel_relabel(spark, d):
    """Four channels of even labels called a quaternion where their norm is near a quarter."""
    names = lambda *xs: F.array(*map(F.lit, xs))
    rows = read(spark, d, "embeddings").withColumn("labels", F.when(F.col("label") % 2 == 0, names("c0", "c1", "c2", "c3")).otherwise(names("a", "b", "c", "d")))
    norm = F.sqrt(sum((F.pow(F.col("embedding")[k].cast("double"), 2) for k in range(4)), F.lit(0.0)))
    found = contracts.relabelled(rows, "labels", F.abs(norm - 0.25) <= 0.1, ["c0", "c1", "c2", "c3"], ["qx", "qy", "qz", "qw"])
    return found.select("vec_id", "labels", "old_labels", "relabelled")


def _fit(source, group, xs, others=False):
    """The tables t to f: sums by group, over the other groups if wanted, and the ridge fit of the last of ``xs`` on the first three."""
    t = f"t AS (SELECT {group}, count(*)::DOUBLE AS n, {', '.join(f'sum({x}) AS s_{i}' for i, x in enumerate(xs))}, {', '.join(f'sum({xs[a]} * {xs[b]}) AS p_{a}{b}' for a, b in _PAIRS)} FROM {source} GROUP BY 1)"
    o = f"o AS (SELECT a.{group}, sum(b.n) AS n, {', '.join(f'sum(b.s_{i}) AS s_{i}' for i in range(4))}, {', '.join(f'sum(b.p_{a}{b}) AS p_{a}{b}' for a, b in _PAIRS)} FROM t a JOIN t b ON a.{group} <> b.{group} GROUP BY 1)" if others else "o AS (SELECT * FROM t)"
    deviations = ", ".join(f"greatest(sqrt(greatest(p_{i}{i} / n - (s_{i} / n) * (s_{i} / n), 0)), 0.00000001) AS sd_{i}" for i in range(3))
    return f"""{t}, {o}, d AS (SELECT *, {deviations} FROM o), g AS (SELECT *, {', '.join(f'{_moment(a, b)} AS g_{a}{b}' for a, b in _PAIRS)} FROM d), c AS (SELECT *, {_SOLVED} FROM g),
f AS (SELECT {group}, s_3 / n - c_1 * s_0 / n - c_2 * s_1 / n - c_3 * s_2 / n AS c_0, c_1, c_2, c_3 FROM c)"""


_ONE = "SELECT l_linestatus, '{1}' AS target, [round(c_0, 4), round(c_1, 4), round(c_2, 4), round(c_3, 4)] AS coefficients FROM f"


@query(
    " UNION ALL ".join(
        f"SELECT * FROM (WITH {_fit('lineitem', 'l_linestatus', [*_X[:3], sql])} {_ONE.format(0, name)})" for name, sql in (("l_extendedprice", "l_extendedprice"), ("revenue", "(l_extendedprice * (1 - l_discount))"))
    )
)
def ridge_targets(spark, d):
    """Price and revenue by quantity, discount and tax for each line status, two fits from one set of sums."""
    rows = read(spark, d, "lineitem").withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    found = learning.ridge_many(rows, ["l_linestatus"], _X[:3], ["l_extendedprice", "revenue"], 1.0)
    return found.withColumn("coefficients", F.transform("coefficients", lambda x: F.round(x, 4)))


@query(
    f"""WITH r AS (SELECT l_returnflag, l_suppkey, l_linenumber, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax, avg(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2, 3),
{_fit('r', 'l_returnflag', _X, True)},
p AS (SELECT r.*, l_discount > 0.05 AS ok, l_extendedprice * (1 - l_discount) AS utility, c_0 + c_1 * l_quantity + c_2 * l_discount + c_3 * l_tax AS predicted FROM r JOIN f USING (l_returnflag)),
n AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY predicted DESC, l_linenumber) AS place FROM p),
z AS (SELECT l_returnflag, l_suppkey, arg_min(l_linenumber, place) AS first, arg_min(ok, place) AS first_passed, arg_min(l_linenumber, place) FILTER (WHERE ok) AS selected, arg_min(predicted, place) FILTER (WHERE ok) AS predicted, arg_min(utility, place) FILTER (WHERE ok) AS selected_utility,
  coalesce(min(place) FILTER (WHERE ok), count(*)) AS evaluated, arg_min(l_linenumber, (-utility, l_linenumber)) FILTER (WHERE ok) AS oracle, max(utility) FILTER (WHERE ok) AS oracle_utility FROM n GROUP BY 1, 2)
SELECT l_returnflag, l_suppkey, first, first_passed, selected, round(predicted, 3) AS predicted, round(selected_utility, 3) AS selected_utility, evaluated, oracle, round(oracle_utility, 3) AS oracle_utility, round(oracle_utility - selected_utility, 3) AS regret, selected = oracle AS exact FROM z"""
)
def fold_regret(spark, d):
    """Line numbers of each supplier chosen by a model of the other return flags, against the best that passes."""
    means = [F.avg(c).alias(c) for c in _X]
    rows = read(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey", "l_linenumber").agg(*means)
    rows = rows.withColumn("ok", F.col("l_discount") > 0.05).withColumn("utility", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    found = learning.fold_regret(rows, "l_returnflag", ["l_suppkey"], "l_linenumber", _X[:3], "l_extendedprice", "utility", "ok", 1.0)
    return found.select(*(F.round(c, 3).alias(c) if c in ("predicted", "selected_utility", "oracle_utility", "regret") else c for c in found.columns))
