"""Resampling by counters against the same draws in Python, promotion and comparison of models on literal rows."""

import hashlib
import math
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import md5
from loomspark.operators import resampling
from loomspark.queries import QUERIES


def numbers(units):
    """Units in the order of their numbers."""
    return sorted(units, key=lambda u: (hashlib.md5(str(u).encode()).hexdigest()[:2], u))


def draws(seed, turn, n, *group):
    return [int(hashlib.md5(":".join(map(str, [seed, turn, j, *group])).encode()).hexdigest()[:13], 16) % n for j in range(n)]


def test_units_are_numbered_without_gaps(spark):
    rows = [("a", f"u{i}") for i in range(700)] + [("b", "x"), (None, "y"), (None, "z")]
    got = resampling.dense_number(spark.createDataFrame(rows, "k string, unit string"), ["k"], "unit").collect()
    for k in ("a", "b", None):
        own = sorted((r.number, r.unit, r.total) for r in got if r.k == k)
        units = [u for key, u in rows if key == k]
        assert [u for _, u, _ in own] == numbers(units) and [n for n, _, _ in own] == list(range(len(units))) and {t for _, _, t in own} == {len(units)}


def test_bounds_are_those_of_the_same_draws(spark):
    values = {f"t{i}": ((i * 37) % 11 - 4) / 8 for i in range(9)}
    rows = [("a", u, v + 0.5) for u, v in values.items()] + [("a", u, v - 0.5) for u, v in values.items()] + [("b", "t0", 1.0), ("a", "t1", None), ("c", "t2", None), (None, "p", 0.1), (None, "q", 0.1)]
    got = {r.arm: r for r in resampling.bootstrap_bounds(spark.createDataFrame(rows, "arm string, trial string, gain double"), ["arm"], "trial", "gain", 200, 0.9, 42).collect()}
    held = [values[u] for u in numbers(values)]
    means = sorted(statistics.fmean(held[i] for i in draws(42, turn, 9, "a")) for turn in range(200))
    assert got["a"].lower == pytest.approx(means[max(0, int((1 - 0.9) * 200) - 1)]) and (got["a"].n, got["a"].p) == (9, pytest.approx((sum(m <= 1e-12 for m in means) + 1) / 201))
    assert got["a"].mean == pytest.approx(statistics.fmean(held)) and got["a"].above == pytest.approx(sum(m > 1e-12 for m in means) / 200)
    assert (got["b"].n, got["b"].mean, got["b"].lower, got["b"].p) == (1, 1.0, None, None) and "c" not in got
    assert got[None].n == 2 and got[None].lower == pytest.approx(0.1)
    with pytest.raises(ValueError):
        resampling.bootstrap_bounds(spark.range(0), [], "id", "id", 0, 0.5, 1)


def test_resampled_scale(spark):
    rows = [("one", s, 4.0 if s == "a" else 6.0) for s in "aaabb"] + [("none", "a", 0.0)] * 3
    rows += [("spread", "a", float(v)) for v in range(1, 100)] + [("spread", "a", None)]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, s string, v double, id long")
    got = {r.k: (r.median, r.relative) for r in resampling.resampled_scale(frame, ["k"], "s", "id", "v", 400, 7).collect()}
    # Strata keep their sizes, so three fours and two sixes have no other median; a median of 0 has no relative deviation.
    assert got["one"] == (4.0, 0.0) and got["none"] == (0.0, None)
    # The median of n uniform values deviates by about range / (2 * sqrt(n)).
    assert got["spread"][0] == 50.0 and got["spread"][1] == pytest.approx(99 / (2 * 99**0.5) / 50, rel=0.2)


def test_digests_of_many_texts_are_those_of_the_library():
    texts = [b"", b"b\0c\0", *(b"x" * n for n in (54, 55, 56, 63, 64, 119, 120, 300)), *(b"5:%d:%d:purchase" % (i % 7, i) for i in range(200))]
    for some in (texts, texts[:1], texts[-9:]):
        got = md5.first_bits(np.array([x + md5.END for x in some]))
        assert got.tolist() == [int(hashlib.md5(x).hexdigest()[:13], 16) for x in some]


def middle(values):
    """The median, what is no number counting as the largest value."""
    held = sorted(values, key=lambda v: (math.isnan(v), v))
    return held[(len(held) - 1) // 2] * 0.5 + held[len(held) // 2] * 0.5


def test_scales_are_those_of_the_same_draws_in_groups_of_any_size(spark):
    rows = [(k, s, i, float((i * 37 + n) % 101) - 20) for n, (k, s) in enumerate([(1, "a"), (1, "bb"), (1, None), (2, "a"), (None, "a"), (2**60 + 1, "é" * 30)]) for i in range(7 * n + 1)]
    rows += [(2, "a", None, 5.0), (3, "a", 1, None), (4, "a", 1, 2.0), (5, "a", 1, math.nan), (5, "a", 2, math.nan), (5, "a", 3, 1.0), (6, "a", 1, math.inf), (6, "b", 1, 3.0)]
    frame = spark.createDataFrame(rows, "k long, s string, id long, v double")
    want = {}
    for k in {r[0] for r in rows if r[3] is not None}:
        strata = {s: sorted(((u is None, hashlib.md5(str(u).encode()).hexdigest()[:2], u, v) for q, p, u, v in rows if q == k and p == s and v is not None), key=lambda x: x[:3]) for s in {r[1] for r in rows if r[0] == k}}
        medians = [middle([held[i][3] for s, held in strata.items() for i in draws(5, turn, len(held), *(x for x in (k, s) if x is not None))]) for turn in range(12)]
        own = middle([x[3] for held in strata.values() for x in held])
        want[k] = (own, statistics.stdev(medians) / own if all(map(math.isfinite, [own, *medians])) else math.nan)
    for few in (resampling.FEW, 20, 0):
        got = {r.k: (r.median, r.relative) for r in resampling.resampled_scale(frame, ["k"], "s", "id", "v", 12, 5, few).collect()}
        assert got.keys() == want.keys()
        for k, pair in want.items():
            assert got[k] == pytest.approx(pair, nan_ok=True), (few, k)
    assert [r.relative for r in resampling.resampled_scale(frame, ["k"], "s", "id", "v", 1, 5).collect()] == [None] * len(want)
    with pytest.raises(ValueError):
        resampling.resampled_scale(frame, ["k"], "s", "id", "v", 0, 5)


def test_scales_of_small_groups_move_no_draws(spark):
    rows = spark.range(60).select((F.col("id") % 3).alias("k"), (F.col("id") % 2).alias("s"), "id", F.col("id").cast("double").alias("v"))
    plan = resampling.resampled_scale(rows, ["k"], "s", "id", "v", 50, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "percentile" not in plan and "REPARTITION_BY_NUM" in plan


def evaluations(spark, rows):
    return spark.createDataFrame(rows, "suite string, `group` string, candidate string, quality double, cost double, eligible boolean")


def test_promotion_gives_every_reason(spark):
    side = lambda suite, name, quality, n=6, cost=1.0, eligible=True: [(suite, f"scene-{i}", name, quality, cost, eligible) for i in range(n)]
    old = side("good", "old", 0.5) + side("few", "old", 0.5, 1) + side("gates", "old", 0.5, 2) + side("same", "old", 0.5) + side("dear", "old", 0.5) + side("bad", "old", 0.5)
    new = side("good", "new", 0.7) + side("few", "new", 0.8, 1) + side("gates", "new", 0.9, 2, eligible=None) + side("same", "new", 0.5) + side("dear", "new", 0.7, cost=1.2)
    new += side("bad", "new", 0.9)[:5] + [("bad", "scene-5", "new", 0.4, 9.0, False)]
    got = {r.suite: r for r in resampling.decide_promotion(evaluations(spark, old), evaluations(spark, new), ["suite"], rounds=200).collect()}
    assert got["good"].promoted and got["good"].selected == "new" and got["good"].reasons == [] and got["good"].probability == 1.0
    assert got["few"].reasons == ["insufficient_independent_groups"] and not got["few"].promoted and got["few"].probability is None
    assert got["gates"].reasons == ["physical_or_adversarial_gate_failed"]
    assert got["same"].reasons == ["improvement_not_statistically_supported"] and got["same"].probability == 0.0
    assert got["dear"].reasons == ["cost_regression"] and got["dear"].selected is None
    assert got["bad"].reasons[:2] == ["physical_or_adversarial_gate_failed", "quality_regression"] and got["bad"].reasons[-1] == "cost_regression"
    one = {r.suite: r for r in resampling.decide_promotion(evaluations(spark, side("few", "old", 0.5, 1)), evaluations(spark, side("few", "new", 0.8, 1)), ["suite"], least_groups=1, rounds=50).collect()}
    assert one["few"].promoted


@pytest.mark.parametrize("new", [[("s", "a", "new", 1.0, 1.0, True)], [("s", "a", "new", 1.0, 1.0, True)] * 2 + [("s", "b", "new", 1.0, 1.0, True)], [("s", "a", "new", 1.0, 1.0, True), ("s", "b", "other", 1.0, 1.0, True)], [("s", "a", "new", None, 1.0, True), ("s", "b", "new", 1.0, 1.0, True)], [("s", g, "new", 1.0, 1.0, True) for g in "abc"]])
def test_groups_that_do_not_match_raise(spark, new):
    old = [("s", g, "old", 1.0, 1.0, True) for g in "ab"]
    with pytest.raises(Exception, match="groups must be unique"):
        resampling.decide_promotion(evaluations(spark, old), evaluations(spark, new), ["suite"], rounds=10).collect()


def records(spark, rows):
    return spark.createDataFrame(rows, "model string, trial string, unit string, seed int, metric string, value double")


def test_models_are_compared_by_independent_units(spark):
    rows = [(m, t, t, s, metric, base + s / 100 + 0.001 * i) for m, base in (("base", 0.5), ("candidate", 0.7)) for i, t in enumerate(("a", "b", "c")) for s in (1, 2) for metric in ("ssim", "margin", "error")]
    got = {(r.baseline, r.metric): r for r in resampling.compare_models(records(spark, rows), "candidate", {"ssim": True, "error": False}, least_units=20, rounds=100).collect()}
    assert got.keys() == {("base", "ssim"), ("base", "error")}
    ssim, error = got["base", "ssim"], got["base", "error"]
    assert (ssim.n, ssim.raw_trials, ssim.positive, ssim.eligible, ssim.all_positive, ssim.passed) == (3, 3, True, False, False, False)
    assert ssim.mean == pytest.approx(0.2) and ssim.lower == pytest.approx(0.2) and error.mean == pytest.approx(-0.2) and not error.positive
    only = resampling.compare_models(records(spark, rows), "candidate", {"ssim": True}, least_units=3, rounds=100).collect()
    assert [r.passed for r in only] == [True]
    clips = [(m, t, "physical-episode", 1, "ssim", v) for m, v in (("base", 0.5), ("candidate", 0.7)) for t in ("clip-a", "clip-b")]
    row = resampling.compare_models(records(spark, clips), "candidate", {"ssim": True}, rounds=100).first()
    assert (row.n, row.raw_trials, row.lower, row.passed) == (1, 2, None, False)


@pytest.mark.parametrize("more", [[("base", "c", "c", 1, "ssim", 0.5)], [("candidate", "c", "c", 1, "ssim", 0.5)], [("base", "a", "a", 2, "ssim", 0.5)], [("base", "a", "other", 1, "ssim", 0.5)], [("base", "a", "a", 1, "ssim", None)]])
def test_models_that_do_not_match_raise(spark, more):
    rows = [(m, t, t, 1, "ssim", 0.5) for m in ("base", "candidate") for t in ("a", "b")]
    with pytest.raises(Exception, match="must match"):
        resampling.compare_models(records(spark, rows + more), "candidate", {"ssim": True}, rounds=10).collect()


def test_no_task_holds_draws(spark):
    units = spark.range(50).select((F.col("id") % 2).alias("arm"), "id", F.col("id").cast("double").alias("gain"))
    found = resampling.draws(units, ["arm"], "id", "gain", 20, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ShuffledHashJoin" in plan
    assert {(r.arm, r.round): r["count"] for r in found.groupBy("arm", "round").count().collect()} == {(a, r): 25 for a in range(2) for r in range(20)}


@pytest.mark.parametrize("name", ["promotion_matrix", "bootstrap_pair"])
def test_bounds_hold_no_count_for_each_draw(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keyed = re.findall(r"Aggregate\(keys=\[([^\]]*)\]", plan)
    assert any("round#" in k for k in keyed) and not any("round#" in k and ("_number#" in k or "_picked#" in k) for k in keyed)
