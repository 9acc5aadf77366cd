"""Poses and recorded motion on literal rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import pose
from loomspark.operators import motion


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def numbers(*values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_only_rotations_become_quaternions(spark):
    assert one(spark, pose.from_matrix(numbers(1, 0, 0, 0, 1, 0, 0, 0, 1))) == [0, 0, 0, 1]
    assert one(spark, pose.from_matrix(numbers(1, 0, 0, 0, -1, 0, 0, 0, -1))) == [1, 0, 0, 0]
    assert one(spark, pose.from_matrix(numbers(0, -1, 0, 1, 0, 0, 0, 0, 1))) == pytest.approx([0, 0, math.sqrt(0.5), math.sqrt(0.5)])
    assert one(spark, pose.from_matrix(numbers(-1, 0, 0, 0, 1, 0, 0, 0, 1))) is None
    assert one(spark, pose.from_matrix(numbers(1, 0.1, 0, 0, 1, 0, 0, 0, 1))) is None
    assert one(spark, pose.unit(numbers(0, 0, 0, 0))) is None


def test_transforms_meet_in_one_frame(spark):
    quarter = numbers(0, 0, math.sqrt(0.5), math.sqrt(0.5))
    left = pose.transform(F.lit("hand"), F.lit("world"), numbers(1, 2, 3), quarter, F.lit(0.5))
    right = pose.transform(F.lit("tool"), F.lit("hand"), numbers(1, 0, 0), numbers(0, 0, 0, 1), F.lit(0.75))
    both = one(spark, pose.compose(left, right))
    assert (both.source, both.target, both.confidence) == ("tool", "world", 0.5) and both["shift"] == pytest.approx([1, 3, 3])
    assert one(spark, pose.compose(right, left)) is None
    assert one(spark, pose.apply(pose.inverse(left), pose.apply(left, numbers(4, 5, 6)))) == pytest.approx([4, 5, 6])


def test_two_arms_and_their_grippers(spark):
    arm = [1, 2, 3, 0, 0, 0, 2]
    assert one(spark, pose.two_arms(numbers(*arm, 1.0000005, *arm, 0.25))) == [1, 2, 3, 0, 0, 0, 1, 1, 2, 3, 0, 0, 0, 0.25]
    assert one(spark, pose.two_arms(numbers(*arm, 1.1, *arm, 0.25))) is None
    assert one(spark, pose.two_arms(numbers(1, 2, 3, 0, 0, 0, 0, 1, *arm, 0.25))) is None


def test_semidefinite(spark):
    assert one(spark, pose.is_semidefinite(numbers(2, 1, 0, 1, 2, 0, 0, 0, 0)))
    assert not one(spark, pose.is_semidefinite(numbers(1, 2, 0, 2, 1, 0, 0, 0, 1)))
    assert not one(spark, pose.is_semidefinite(numbers(1, 0.5, 0, 0, 1, 0, 0, 0, 1)))
    assert not one(spark, pose.is_semidefinite(numbers(1e-5, 3e-5, 0, 3e-5, 1e-5, 0, 0, 0, 1e-5)))
    assert not one(spark, pose.is_semidefinite(numbers(1, 0, 0, 0, math.nan, 0, 0, 0, 1)))
    assert not one(spark, pose.is_semidefinite(F.array(F.lit(1.0), F.lit(None).cast("double"))))


@pytest.mark.parametrize("scale", [1e-6, 1e-4, 1.0, 1e3])
def test_semidefinite_like_eigenvalues(spark, scale):
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(300):
        q, _ = np.linalg.qr(rnd.normal(size=(3, 3)))
        values = scale * rnd.uniform(0, 1, 3) * rnd.choice([0, 1, 1], 3)
        if i % 2:
            values[i % 3] = -max(2e-10, scale * rnd.uniform(1e-6, 1))
        m = q @ np.diag(values) @ q.T
        m = (m + m.T) / 2
        rows.append((i, m.ravel().tolist(), bool(np.linalg.eigvalsh(m)[0] >= -1e-10)))
    frame = spark.createDataFrame(rows, "i int, m array<double>, want boolean")
    assert frame.filter(pose.is_semidefinite(F.col("m")) != F.col("want")).count() == 0


def test_centrelines(spark):
    line = lambda stem, frame, confidence=1.0, size=0.1: [(stem, frame, k, 0.0, size * k, 1.0, confidence) for k in range(4)]
    rows = [r for f in range(3) for r in line("good", f)]
    rows += line("once", 0) + [r for f in (1, 2) for r in line("once", f, 0.0)]
    rows += [r for f in range(3) for r in line("never", f, 0.0)] + [r for f in range(3) for r in line("odd", f)[:3] + [("odd", f, 3, None, 0.3, 1.0, 1.0)]]
    rows += [r for f in range(3) for r in line("grows", f, 1.0, 0.1 + 0.1 * f)] + [r for f in range(3) for r in line("short", f)[:3]]
    rows += [r for f in range(3) for r in line("below", f)[:3] + [("below", f, 3, 0.0, 0.3, 1.0, -1.0 if f else 1.0)]] + [r for f in range(2) for r in line("flat", f, 1.0, 0.0)]
    frame = spark.createDataFrame(rows, "stem string, frame int, node int, x double, y double, z double, c double")
    got = {r.stem: r for r in motion.centreline_audit(frame, ["stem"], "frame", "node", ["x", "y", "z"], "c", 4, 0.0).collect()}
    assert got["good"].passed and got["good"].worst_cv == pytest.approx(0, abs=1e-9) and (got["good"].frames, got["good"].visible) == (3, 1.0)
    for stem in ("once", "never", "odd", "short", "flat", "below"):
        assert not got[stem].passed and got[stem].worst_cv == math.inf
    assert not got["grows"].passed and got["grows"].worst_cv == pytest.approx(np.std([1, 2, 3]) / 2)
    assert got["once"].visible == pytest.approx(1 / 3) and got["short"].visible == 0.75 and not got["below"].finite_confidence
    assert not motion.centreline_audit(frame, ["stem"], "frame", "node", ["x", "y", "z"], "c", 4, 1.01).filter("passed").collect()


def test_times_are_compared_as_times(spark):
    rows = [("a", "2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z", 60), ("a", "2024-01-01T00:30:00+02:00", "2024-01-01T00:40:00+02:00", 30), ("b", "2024-01-01T00:00:00Z", "x", 9), ("b", "2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z", 9), ("c", "2024-01-01T00:00:00Z", None, 9)]
    frame = spark.createDataFrame(rows, "k string, s string, t string, frames int")
    got = {r.k: r for r in motion.throughput(frame, ["k"], "s", "t", "frames", 24.0, 2).collect()}
    assert (got["a"].wall, got["a"].unfinished, got["a"].frames_a_second, got["a"].worker_hours) == (9000.0, 0, 0.01, 5.0)
    assert (got["b"].wall, got["b"].unfinished, got["b"].frames_a_second) == (None, 1, None) and got["c"].unfinished == 1


def test_only_like_runs_are_compared(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, sha string, seed int, status string, wall double, frames_a_second double, worker_hours double")
    old = frame([("a", "x", 1, "completed", 400.0, 1.0, 4.0), ("b", "x", None, "completed", 4.0, 1.0, 4.0), ("c", "x", 1, None, 4.0, 1.0, 4.0), ("d", "x", 1, "completed", 4.0, 1.0, 4.0)])
    new = frame([("a", "x", 1, "completed", 100.0, 4.0, 1.0), ("b", "y", None, "completed", 4.0, 1.0, 4.0), ("c", "x", 2, "completed", 4.0, 1.0, 4.0), ("e", "x", 1, "completed", 4.0, 1.0, 4.0)])
    got = {r.k: tuple(r)[1:] for r in motion.compare_runs(old, new, "k", ["sha", "seed"]).collect()}
    assert got == {"a": ([], 4.0, 4.0, 0.75), "b": (["sha"], None, None, None), "c": (["seed", "status"], None, None, None), "d": (["missing"], None, None, None), "e": (["missing"], None, None, None)}


@pytest.mark.parametrize(
    ("header", "want"),
    [("bytes=0-9", (0, 9)), (" bytes=90-", (90, 99)), ("bytes=-5", (95, 99)), ("bytes=-500", (0, 99)), ("bytes=50-500", (50, 99)), ("bytes=-", None), ("bytes=9-3", None), ("bytes=100-", None), ("bytes=-0", None), ("items=0-9", None), (None, None)],
)
def test_byte_ranges(spark, header, want):
    got = one(spark, motion.byte_range(F.lit(header).cast("string"), F.lit(100).cast("long")))
    assert (got and tuple(got)) == want


def test_windows_and_their_starts(spark):
    rows = spark.createDataFrame([("a", 20, [12, 0, 5]), ("b", 20, [0, 0]), ("c", 20, [13]), ("d", 20, [])], "id string, n int, starts array<int>")
    got = motion.explicit_windows(rows, "n", "starts", 9).filter("id = 'a'").orderBy("window").collect()
    assert [(r.start, r.source_frames, r.padded_frames) for r in got] == [(0, 9, 0), (5, 9, 0), (12, 8, 1)]
    assert sorted(r.id for r in motion.bad_starts(rows, "n", "starts", 9).collect()) == ["b", "c", "d"]


def test_padding_and_its_bound(spark):
    rows = spark.createDataFrame([(1, 2, 5.0), (1, 1, 4.0)], "k int, at int, v double")
    assert tuple(motion.padded(rows, ["k"], "at", "v", 3).first()) == (1, [4.0, 5.0, 0.0], [True, True, False])
    with pytest.raises(Exception, match="more than 1 values"):
        motion.padded(rows, ["k"], "at", "v", 1).collect()


def test_standing_still_scores_nothing(spark):
    got = one(spark, motion.progress_score((F.lit(10.0), F.lit(0.0)), (F.lit(0.0), F.lit(0.0))))
    assert tuple(got) == (0.0, 0.0, math.inf, 0.0)
    assert one(spark, motion.progress_score((F.lit(10.0), F.lit(0.0)), (F.lit(10.0), F.lit(0.0)))).score == pytest.approx(1)


def test_series_are_shifted_and_held(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(4)] + [("b", 0, 7.0)], "k string, i int, v double")
    got = motion.shifted(rows, ["k"], "i", "v", 2).orderBy("k", "i").collect()
    assert [r.v for r in got] == [0.0, 0.0, 0.0, 1.0, 7.0]
    noise = [one(spark, motion.seeded_noise(F.lit(k), seed, 1.0)) for k, seed in ((1, "s"), (1, "s"), (2, "s"), (1, "t"))]
    assert noise[0] == noise[1] and len(set(noise)) == 3
