"""Operators on small literal tables with known results."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomspark.functions import scalar
from loomspark.operators import aggregation, framing, gates, joins, learning, ledger, ranking, selection, series, splits


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_route_rollup_keeps_requests_without_an_accepted_candidate(spark):
    rows = [("r1", "fast_unverified", 5.0, False), ("r1", "slower_verified", 20.0, True), ("r2", "rejected", 1.0, None)]
    got = {r.request: r for r in selection.route_rollup(spark.createDataFrame(rows, "request string, name string, seconds double, ok boolean"), "request", "name", F.col("ok"), "seconds").collect()}
    assert (got["r1"].oracle, got["r1"].oracle_latency, got["r1"].candidates) == ("slower_verified", 20.0, ["fast_unverified", "slower_verified"])
    assert (got["r2"].oracle, got["r2"].accepted) == (None, [])


def test_holm_stops_after_the_first_that_holds(spark):
    rows = spark.createDataFrame([("strong", 0.001), ("borderline", 0.03), ("weak", 0.04)], "name string, p double")
    got = {r.name: r.rejected for r in aggregation.holm(rows, "name", "p", 0.05).collect()}
    assert got == {"strong": True, "borderline": False, "weak": False}
    single = {r.name: r.rejected for r in aggregation.holm(rows.filter("p < 0.035"), "name", "p", 0.05).collect()}
    assert single == {"strong": True, "borderline": True}


def test_means_in_levels(spark):
    rows = spark.createDataFrame([("c", "a", 1.0), ("c", "a", 1.2), ("c", "b", 1.4)], "method string, unit string, error double")
    got = aggregation.mean_in_levels(rows, [["method", "unit"], ["method"]], "error").first()
    assert got["mean"] == pytest.approx(1.25)


def test_gates_fail_closed(spark):
    rows = spark.createDataFrame([(1, "a", 0.9), (1, "b", None), (2, "a", 0.9), (2, "b", 0.6), (2, "c", 0.0), (3, "c", 1.0)], "id int, gate string, score double")
    got = {r.id: r for r in gates.gate_report(rows, ["id"], "gate", "score", {"a": 0.8, "b": 0.5}).collect()}
    assert (got[1].failed_gates, got[1].pass_count, got[1].worst_margin) == (["b"], 1, -1.0)
    assert (got[2].failed_gates, got[2].pass_count) == ([], 2) and got[2].worst_margin == pytest.approx(0.1)
    assert got[3].failed_gates == ["a", "b"]


def test_review_has_three_states(spark):
    rows = spark.createDataFrame([(1, True), (2, None), (3, False)], "id int, human boolean")
    shown, promoted = gates.review_state(F.lit(True), F.col("human"))
    got = {r.id: (r.shown, r.promoted) for r in rows.select("id", shown.alias("shown"), promoted.alias("promoted")).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False)}


def test_difference_of_tables(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1)], "k int, f string, g int")
    b = spark.createDataFrame([(1, "z", None), (3, "w", 2)], "k int, f string, g int")
    got = sorted((r.k, r.field, r.left, r.right) for r in gates.difference(a, b, ["k"], ["f", "g"]).collect())
    assert got == [(1, "f", "x", "z"), (2, "f", "y", None), (2, "g", "1", None), (3, "f", None, "w"), (3, "g", None, "2")]


def test_hopping_tails(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 56, 57, 116, 660)], "n long")

    def starts(window, overlap, rule, n):
        found = framing.hopping(rows.filter(F.col("n") == n), "n", window, overlap, rule).orderBy("start").collect()
        return [(r.start, r.frames) for r in found]

    assert [s for s, _ in starts(57, 9, "terminal", 57)] == [0]
    assert [s for s, _ in starts(57, 9, "terminal", 116)] == [0, 48, 59]
    assert starts(57, 9, "terminal", 56) == starts(57, 9, "terminal", 0) == []
    assert starts(57, 9, "clamped", 56) == [(0, 56)]
    assert [s for s, _ in starts(80, 16, "merge_last_two", 660)] == [*range(0, 513, 64), 580]
    short = starts(124, 22, "short_tail", 660)
    assert [s for s, _ in short] == [0, 102, 204, 306, 408, 510, 612] and short[-1][1] == 48
    assert one(spark, framing.padded_model_length(F.lit(48))) == 56
    assert starts(57, 9, "drop_short", 57) == [(0, 57), (48, 9)]


def test_shards_and_ranks(spark):
    plan = one(spark, framing.shard_plan(F.lit(10), 3, F.lit(5)))
    assert [(p.start, p["count"]) for p in plan] == [(5, 4), (9, 3), (12, 3)]
    assert [(r.first, r.last) for r in one(spark, framing.byte_ranges(F.lit(10), 4))] == [(0, 2), (3, 5), (6, 8), (9, 9)]
    assert one(spark, framing.evenly_spaced(F.lit(10), 3)) == [0, 4, 9] and one(spark, framing.evenly_spaced(F.lit(10), 1)) == [5]


def test_islands_and_merges(spark):
    rows = spark.createDataFrame([(1, x) for x in (645, 228, 227, 498, 498)], "k int, f long")
    got = sorted((r.first, r.last) for r in series.islands(rows, ["k"], "f").collect())
    assert got == [(227, 228), (498, 498), (645, 645)]
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 12, 14), (1, 1, 2)], "k int, s int, e int")
    assert sorted((r.s, r.e) for r in series.merge_intervals(spans, ["k"], "s", "e").collect()) == [(0, 5), (5, 8), (12, 14)]
    assert sorted((r.s, r.e) for r in series.merge_intervals(spans, ["k"], "s", "e", 1).collect()) == [(0, 8), (12, 14)]


def test_half_open_overlap(spark):
    meets = lambda a, b: one(spark, scalar.intervals_overlap(F.lit(a), F.lit(b), F.lit(259), F.lit(297)))
    assert (meets(284, 289), meets(297, 302), meets(250, 259)) == (True, False, False)


def test_hysteresis_intervals(spark):
    values = [40.0] * 50
    values[4:7], values[12:22], values[25:35] = [2.0] * 3, [3.0] * 10, [4.0] * 10
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i long, v double")
    marked = series.hysteresis(rows, ["k"], "i", "v", 8.0, 18.0)
    assert [(r.start, r.end) for r in series.active_intervals(marked, ["k"], "i", "active", 6, 4).collect()] == [(12, 35)]


def test_wrapped_steps_add_up_again(spark):
    angles = [3.13, -3.13, -3.0, 3.0, 0.5]
    rows = spark.createDataFrame([(1, i, a) for i, a in enumerate(angles)], "k int, i int, a double")
    steps = series.wrapped_delta(rows, ["k"], "i", "a")
    got = [r.state for r in series.integrate_wrapped(steps, ["k"], "i", "delta", F.lit(3.13)).orderBy("i").collect()]
    assert got == pytest.approx(angles)


def test_as_of_lines_and_carry(spark):
    knots = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 20.0)], "k int, t double, v double")
    points = spark.createDataFrame([(1, -3.0), (1, 0.0), (1, 5.0), (1, 12.0), (1, 30.0), (2, 1.0)], "k int, t double")
    got = {(r.k, r.t): r.v for r in series.as_of(points, knots, ["k"], "t", "v", 5.0).collect()}
    assert got == {(1, -3.0): 0.0, (1, 0.0): 0.0, (1, 5.0): 10.0, (1, 12.0): 20.0, (1, 30.0): None, (2, 1.0): None}
    near = {(r.k, r.t): r.n for r in series.nearest(points, knots, ["k"], "t", "n").collect()}
    assert near[1, 5.0] == 0.0 and near[1, 12.0] == 10.0 and near[2, 1.0] is None


def test_smoothing_and_gaps(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, None, 3.0, None, None, 9.0, None])], "k int, i int, v double")
    assert [r.filled for r in series.fill_linear(rows, ["k"], "i", "v").orderBy("i").collect()] == [1.0, 2.0, 3.0, 5.0, 7.0, 9.0, 9.0]
    flat = spark.createDataFrame([(1, i, 2.0) for i in range(9)], "k int, i int, v double")
    assert [r.smooth for r in series.gaussian(flat, ["k"], "i", "v", 1.2).collect()] == pytest.approx([2.0] * 9)


def test_suppression_keeps_the_strongest(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 3, 5.0), (1, 5, 4.0), (1, 9, 5.0)], "k int, i long, s double")
    assert sorted(r.i for r in series.non_maximum_suppression(rows, "k", "i", "s", 4).collect()) == [3, 9]


def test_suppression_like_one_choice_after_another(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.randrange(60), rnd.choice([None, math.nan, 1.0, 2.0, 2.0, 3.5, 7.0])) for k in range(12) for _ in range(rnd.choice([1, 8, 60]))]
    rows += [(20, i, float(i)) for i in range(40)] + [(21, i, -float(i)) for i in range(40)] + [(22, 5, 1.0)] * 3
    got = series.non_maximum_suppression(spark.createDataFrame(rows, "k int, i long, s double"), "k", "i", "s", 4)
    want = []
    for k in {r[0] for r in rows}:
        taken = []
        for worth, i in sorted((-(math.inf * -1 if s is None or math.isnan(s) else s), i) for q, i, s in rows if q == k):
            if all(abs(i - j) >= 4 for j in taken):
                taken.append(i)
        want += [(k, i) for i in taken]
    assert sorted((r.k, r.i) for r in got.collect()) == sorted(want)


def test_promotion_needs_number_mean_and_bound(spark):
    bounds = spark.createDataFrame([("a", 10, 0.5, 0.1), ("b", 9, 0.5, 0.1), ("c", 10, 0.4, 0.1), ("d", 10, 0.5, 0.0), ("e", 10, 0.5, None)], "k string, n long, mean double, lower double")
    required = spark.createDataFrame([(k,) for k in "abcdef"], "k string")
    got = {r.k: r.passed for r in aggregation.promotion_matrix(bounds, required, ["k"], 10, 0.5).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": False, "f": False}


def test_ranks_of_a_whole_table(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([None, 1.0, 2.0, 2.0, 5.0, rnd.random(), math.nan])) for i in range(301)]
    frame = spark.createDataFrame(rows, "i int, x double").repartition(5)
    order = sorted(rows, key=lambda r: (r[1] is not None, math.inf if r[1] is None or math.isnan(r[1]) else r[1], r[0]))
    for bins in (1, 7, 200):
        got = ranking.ranked(frame, [F.col("x"), F.col("i")], "place", "n", bins).collect()
        assert [r.i for r in sorted(got, key=lambda r: r.place)] == [i for i, _ in order]
        assert sorted(r.place for r in got) == list(range(1, 302)) and {r.n for r in got} == {301}
    assert ranking.ranked(frame.limit(0), [F.col("x"), F.col("i")]).count() == 0
    for n, shards in ((301, 7), (3, 7), (14, 7)):
        few = frame.filter(f"i < {n}")
        cut = {r.i: r.shard for r in framing.contiguous_shards(few, [F.col("i")], shards).collect()}
        assert cut == {r.i: r.shard for r in framing.contiguous_shards(few.withColumn("k", F.lit(1)), [F.col("i")], shards, ["k"]).collect()}
    tests = spark.createDataFrame([(i, p) for i, p in enumerate([0.001, 0.01, 0.02, 0.9, 0.0005, None, 0.013])], "i int, p double")
    for some in (tests, tests.filter("p < 0.002"), tests.limit(0)):
        whole = {r.i: (r.rank, r.m, r.rejected) for r in aggregation.holm(some, "i", "p", 0.05).collect()}
        assert whole == {r.i: (r.rank, r.m, r.rejected) for r in aggregation.holm(some.withColumn("k", F.lit(1)), "i", "p", 0.05, ["k"]).collect()}


def test_donor_of_another_group(spark):
    rows = [(1, i, g) for i, g in enumerate("aabca")] + [(2, 0, "x"), (2, 1, "x")]
    got = {(r.k, r.i): r.donor for r in joins.next_of_another_group(spark.createDataFrame(rows, "k int, i int, g string"), ["k"], "i", "g").collect()}
    assert got == {(1, 0): 2, (1, 1): 2, (1, 2): 3, (1, 3): 4, (1, 4): 2, (2, 0): None, (2, 1): None}


def test_no_window_reads_the_rows_ahead_once_for_each_row(spark):
    from loomspark.operators import sequences

    rows = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    found = [joins.next_of_another_group(rows, ["k"], "i", "g"), series.as_of(rows, rows, ["k"], "i", "v", 0.0), series.nearest(rows, rows, ["k"], "i", "n"), series.fill_linear(rows, ["k"], "i", "v"), sequences.nearest_fill(rows, ["k"], "i", "v")]
    for df in found:
        assert not re.search(r"RowFrame, [^,]*(?<!unboundedpreceding\$\(\)), unboundedfollowing", df._jdf.queryExecution().executedPlan().toString())


def test_ledger(spark):
    rows = spark.createDataFrame([("t1", 1, "PARTIAL", []), ("t2", 2, "WORKING", ["t1", "t9"])], "id string, n int, status string, gone array<string>")
    assert [r.id for r in ledger.active(rows, "id", "gone").collect()] == ["t2"]
    counts = {r.status: (r.history, r.active) for r in ledger.status_counts(rows, "id", "gone", "status", ["PARTIAL", "WORKING", "FAILED"]).collect()}
    assert counts == {"PARTIAL": (1, 0), "WORKING": (1, 1), "FAILED": (0, 0)}
    assert [(r.by, r.wanted) for r in ledger.unknown_references(rows, "id", "gone", "n").collect()] == [("t2", "t9")]


def test_hash_split_keeps_groups_whole(spark):
    rows = spark.range(2000).withColumn("g", (F.col("id") % 40).cast("string")).withColumn("split", splits.hash_split(F.col("g"), 3, 0.2, 0.2))
    assert splits.leaks(rows, "g", "split").count() == 0
    assert {r.split for r in rows.select("split").distinct().collect()} == {"train", "validation", "test"}


def test_rotations(spark):
    half = math.sqrt(0.5)
    a, b = F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))), F.array(*map(F.lit, (half, 0.0, 0.0, half)))
    assert one(spark, scalar.rotation_angle(a, b)) == pytest.approx(math.pi / 2)
    assert one(spark, scalar.rotation_angle(a, scalar.slerp(a, b, F.lit(0.5)))) == pytest.approx(math.pi / 4)
    assert one(spark, scalar.quaternion_multiply(b, scalar.quaternion_inverse(b))) == pytest.approx([1, 0, 0, 0], abs=1e-12)
    assert one(spark, scalar.euler_from_quaternion(b)) == pytest.approx([0, 0, math.pi / 2])


def test_ridge_without_a_group(spark):
    rnd = random.Random(1)
    rows = [(g, x, y, 3 + 2 * x - y) for g in "abc" for x, y in ((rnd.random(), rnd.random()) for _ in range(30))]
    got = learning.leave_one_group_out(spark.createDataFrame(rows, "g string, x double, y double, t double"), "g", ["x", "y"], "t", 1e-9)
    for r in got.collect():
        assert r.coefficients == pytest.approx([3, 2, -1], abs=1e-5)
    alone = learning.leave_one_group_out(spark.createDataFrame(rows[:30], "g string, x double, y double, t double"), "g", ["x", "y"], "t", 1.0).first()
    assert alone.coefficients is None


def test_replay_and_preferences(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, False), (1, 2, 3.0, True), (1, 3, 9.0, True), (2, 1, 1.0, False)], "g int, i int, c double, ok boolean")
    got = {r.g: (r.attempts, r.spent, r.accepted) for r in selection.replay(rows, "g", [F.col("i")], F.col("ok"), "c").collect()}
    assert got == {1: (2, 5.0, True), 2: (1, 1.0, False)}
    pairs = sorted((r.g, r.chosen, r.rejected, r.gap) for r in selection.preference_pairs(rows, "g", "c", "i", F.col("ok")).collect())
    assert pairs == [(1, 3, 1, 7.0), (1, 3, 2, 6.0)]


def test_folds_over_arrays(spark):
    from loomspark.operators import sequences

    xs = F.array(*(F.lit(float(x)) for x in (3, 3, -9, 1)))
    assert one(spark, sequences.clamped_walk(xs, 0.0, -5.0, 5.0)) == [3.0, 5.0, -4.0, -3.0]
    assert one(spark, sequences.rate_limited(F.array(*(F.lit(float(x)) for x in (0, 10, 10))), 4.0)) == [3.0, 7.0, 9.0]
    assert one(spark, sequences.tail_mean(xs)) == 3.0
    assert one(spark, sequences.pearson(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0)))) == 1.0
    assert one(spark, sequences.pearson(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_suppression_of_one_long_entity(spark):
    n = 1_000_000
    rows = spark.range(n).selectExpr("1 AS k", "id AS i", "CAST(id AS DOUBLE) AS s")  # one piece: each row is beaten by the next
    got = series.non_maximum_suppression(rows, "k", "i", "s", 4).agg(F.count("*").alias("n"), F.min("i").alias("low"), F.max("i").alias("high")).first()
    assert (got.n, got.low, got.high) == (n // 4, 3, n - 1)


def test_ranges_split_rows_that_are_equal_in_the_first_column(spark):
    rows = spark.range(20_000).selectExpr("CAST(1 AS DOUBLE) AS x", "(id * 7919) % 20000 AS i")
    got = ranking.ranked(rows, [F.col("x"), F.col("i").desc()], "place", "n", 8)
    assert got.filter("place <> 20000 - i OR n <> 20000").count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("== Physical Plan ==")[0]
    spread = spark.range(20_000).selectExpr("1 AS x", "id AS i").repartitionByRange(8, "x", "i").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in spread) < 5000


def test_rules_of_records(spark):
    rows = [("a.1", "2024-01-01T00:00:00Z", "done", "WORKING", ["e"]), ("A", "2024-01-01T00:00:00", " ", "WORKING", []), ("b", "2024-13-01T00:00:00Z", None, "PARTIAL", []), (None, None, "x", None, None), ("c", "2024-01-01T00:00:00.5+05:30", "x", "WORKING", None)]
    frame = spark.createDataFrame(rows, "record_id string, recorded_at string, summary string, status string, evidence array<string>")
    got = {r.record_id: list(r.broken) for r in gates.violations(frame, ledger.record_rules({"WORKING": ["evidence"]})).collect()}
    assert got == {"A": ["id", "time", "summary", "WORKING_evidence"], "b": ["time", "summary"], None: ["id", "time", "WORKING_evidence"], "c": ["WORKING_evidence"]}
