"""Exact quantiles by refined bins against sorted values, and what is built on them."""

import math
import random

import numpy as np
import pytest

from loomspark.operators import aggregation, quantiles


def groups(seed):
    rnd = random.Random(seed)
    return {
        "normal": [rnd.gauss(0, 1) for _ in range(3000)],
        "sizes": [rnd.choice([-1, 1]) * 2.0 ** rnd.uniform(-1000, 1000) for _ in range(900)],
        "ties": [rnd.choice([0.0, 1.0, 1.0, 5.0]) for _ in range(2000)],
        "near": [1.0 + i * 2.0**-52 for i in range(1000)],
        "one": [7.5],
        "two": [-1.0, 2.0],
        "powers": [2.0**-i for i in range(1000)],
        "wide": [1.7e308, -1.7e308, 1.0, 2.0, 3.0],
        None: [float(i) for i in range(50)],
    }


@pytest.mark.parametrize(("few", "bins"), [(4096, 4096), (1, 7), (20, 64)])
def test_against_sorted_values(spark, monkeypatch, few, bins):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", bins)
    held = groups(few)
    rows = [(k, v) for k, vs in held.items() for v in vs] + [("one", None), ("one", math.nan), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r for r in quantiles.quantiles(frame, ["k"], "v", {"p01": 0.01, "median": 0.5, "top": 1.0}, {"r95": 0.95, "least": 0.0}).collect()}
    assert got.keys() == held.keys()
    for k, vs in held.items():
        order = sorted(vs)
        assert got[k].n == len(vs) and got[k].top == order[-1] and got[k].least == order[0]
        assert got[k].r95 == order[max(0, math.ceil(0.95 * len(vs)) - 1)]
        assert got[k].p01 == pytest.approx(np.quantile(vs, 0.01), rel=1e-12) and got[k].median == pytest.approx(np.median(vs), rel=1e-12)
    plan = quantiles.quantiles(frame, ["k"], "v", {"median": 0.5})._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_a_whole_table_and_none(spark):
    frame = spark.range(10_001).selectExpr("CAST(id AS DOUBLE) AS v")
    assert quantiles.quantiles(frame, [], "v", {"median": 0.5}).first().median == 5000.0
    assert quantiles.quantiles(frame.limit(0), [], "v", {"median": 0.5}).count() == 0
    rows = spark.createDataFrame([("a", math.inf), ("a", -math.inf), ("a", 1.0)], "k string, v double")
    assert tuple(quantiles.quantiles(rows, ["k"], "v", {"m": 0.5}, {"top": 1.0, "low": 0.0}).first())[2:] == (1.0, math.inf, -math.inf)
    with pytest.raises(ValueError):
        quantiles.quantiles(frame, [], "v", {"x": 1.5})


def test_statistics_on_quantiles(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.gauss(k, 2)) for k in range(3) for _ in range(400)]
    frame = spark.createDataFrame(rows, "k int, v double")
    for r in aggregation.robust_limits(frame, ["k"], "v", 3.0, 0.1).collect():
        own = np.array([v for k, v in rows if k == r.k])
        mad = np.median(abs(own - np.median(own)))
        assert (r.median, r.mad, r.high) == pytest.approx((np.median(own), mad, np.median(own) + 3 * mad))
    for r in aggregation.six_numbers(frame, ["k"], "v").collect():
        own = [v for k, v in rows if k == r.k]
        assert (r.mean, r.median, r.p10, r.p90, r.min, r.max) == pytest.approx((np.mean(own), np.median(own), np.quantile(own, 0.1), np.quantile(own, 0.9), min(own), max(own)))
    vectors = spark.createDataFrame([([float(i), float(-i), None],) for i in range(101)], "e array<double>")
    got = {r.dim: r for r in aggregation.vector_stats(vectors, "e").collect()}
    assert (got[0].n, got[0].p01, got[0].p99, got[1].min, got[1].mean) == (101, 1.0, 99.0, -100.0, -50.0)
    assert (got[2].n, got[2].p01, got[2].max) == (0, None, None)
