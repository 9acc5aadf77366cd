"""Robust fits, assignments, masks, JSON and the store of states."""

import hashlib
import itertools
import json

import pytest
from pyspark.sql import functions as F

from loomspark.functions import scalar
from loomspark.operators import fitting
from loomspark.queries import fits
from loomspark.sources import commits, states


def test_best_permutation(spark):
    rows = [(1, a, b, 0.0 if (a, b) in ((0, 1), (1, 0), (2, 2)) else 5.0) for a in range(3) for b in range(3)]
    got = fitting.best_permutation(spark.createDataFrame(rows, "g int, a int, b int, c double"), ["g"], "a", "b", "c", 1.0).first()
    assert (got.pairing, got.least, got.straight, got.swapped) == ([1, 0, 2], 0.0, 10.0, True)


def test_best_permutation_of_a_group_over_the_bound(spark):
    rows = [(1, a, b, 1.0) for a in range(3) for b in range(3)]
    with pytest.raises(Exception, match="larger than the bound of 2"):
        fitting.best_permutation(spark.createDataFrame(rows, "g int, a int, b int, c double"), ["g"], "a", "b", "c", 1.0, 2).collect()


def test_identity_swaps_looks_at_every_order(spark, tmp_path):
    prices = [1000.0, 9000.0, 1000.0, 9000.0, 5000.0, 5000.0, 90000.0, 1000.0, 7000.0]
    rows = [(1, i, f"1995-01-{i + 1:02d}", p) for i, p in enumerate(prices)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderdate string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = fits.identity_swaps(spark, str(tmp_path)).orderBy("block").collect()
    assert [(r.o_custkey, r.block, len(r.pairing)) for r in got] == [(1, 0, 4), (1, 1, 4), (1, 2, 1)]
    for r in got:
        own = prices[4 * r.block : 4 * r.block + 4]
        cost = lambda p: sum(abs(own[a] - own[b] * (1.1 if a == b else 1.0)) / 1000 for a, b in enumerate(p))  # noqa: B023, E731
        assert r.least == pytest.approx(min(map(cost, itertools.permutations(range(len(own))))), abs=1e-5)
        assert r.straight == pytest.approx(cost(range(len(own))), abs=1e-5)


def test_json(spark):
    rows = spark.createDataFrame([("x {no {\"b\": 1, \"a\": [2]} y",), ("none",), (None,)], "t string").select(fitting.first_json_object(F.col("t")).alias("j"))
    got = [tuple(r) for r in rows.select("j", fitting.canonical_digest(F.col("j")).alias("d")).collect()]
    want = json.dumps({"a": [2], "b": 1}, separators=(",", ":"))
    assert got == [(want, hashlib.sha256(want.encode()).hexdigest()), (None, None), (None, None)]


def test_masks(spark):
    masks = [[True] * 9, [], [False, True, False]]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "id long, mask array<boolean>")
    packed = fitting.packed_masks(rows, ["id"], "mask")
    assert {r.id: bytes(r.packed) for r in packed.collect()} == {0: b"\xff\x01", 1: b"", 2: b"\x02"}
    assert {r.id: r["mask"] for r in fitting.unpacked_masks(packed, ["id"]).collect()} == dict(enumerate(masks))


def test_states(spark, tmp_path):
    path, frame = f"{tmp_path}/s", lambda rows: spark.createDataFrame(rows, "thread string, number long, state string")
    states.append_states(frame([("a", 1, "{}"), ("b", 1, "{}")]), path)
    states.append_states(frame([("a", 2, '{"x": 1}')]), path)
    with pytest.raises(ValueError, match="exist"):
        states.append_states(frame([("a", 2, "{}")]), path)
    assert {r.thread: r.number for r in states.latest_states(spark, path).collect()} == {"a": 2, "b": 1}
    frame([("c", 1, "{}")]).withColumn("state_sha256", F.lit("0")).write.parquet(f"{path}/data/other")
    assert states.read_states(spark, path).count() == 3  # what isn't committed isn't read
    assert commits.create_if_absent(spark, f"{path}/commits/{3:012d}.txt", "data/other")
    with pytest.raises(ValueError, match="changed"):
        states.read_states(spark, path)


def test_rotation_matrices(spark):
    m = scalar.matrix_from_euler(F.lit(0.3), F.lit(-0.2), F.lit(1.0))
    got = spark.range(1).select(scalar.orthonormal_error(m).alias("e"), scalar.determinant(m).alias("d"), scalar.matrix_angle(m, m).alias("a"), scalar.project(F.lit(1.0), F.lit(1.0), F.lit(-1.0), 1.0, 1.0, 0.0, 0.0).alias("p")).first()
    assert got.e < 1e-12 and got.d == pytest.approx(1.0) and got.a == 0.0 and got.p is None
