"""Graphs, folds, packed tracks, contracts and models of several targets on literal and random rows."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import contracts, folding, graphs, learning, tracks
from loomspark.sources import commits


def random_graph(seed, n, m):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n), float(rnd.choice([0, 1, 2, 5, 9]))) for _ in range(m)]


def dijkstra(edges, start, directed):
    near = {}
    for a, b, c in edges:
        near.setdefault(a, []).append((b, c))
        if not directed:
            near.setdefault(b, []).append((a, c))
    best, heap = {}, [(0.0, start)]
    while heap:
        d, node = heapq.heappop(heap)
        if node not in best:
            best[node] = d
            for other, c in near.get(node, []):
                heapq.heappush(heap, (d + c, other))
    return best


@pytest.mark.parametrize(("seed", "directed"), [(1, False), (2, True)])
def test_cheapest_paths(spark, seed, directed):
    edges = random_graph(seed, 60, 75)
    frame = spark.createDataFrame(edges + edges[:3], "a int, b int, cost double")
    starts = spark.createDataFrame([(0,), (7,), (999,), (7,)], "s int")
    found = graphs.cheapest_paths(frame, starts, "a", "b", "cost", "s", directed)
    got = {}
    for r in found.collect():
        got.setdefault(r.source, {})[r.node] = r.distance
    want = {s: dijkstra(edges, s, directed) for s in (0, 7, 999)}
    assert got == want
    far = {r.source: (r.distance, r.node) for r in graphs.farthest(found).collect()}
    assert far == {s: max((d, -n) for n, d in w.items()) and min(((-d, n) for n, d in w.items())) and (max(w.values()), min(n for n, d in w.items() if d == max(w.values()))) for s, w in want.items()}


def test_long_chains_and_wrong_costs(spark):
    chain = spark.range(40).selectExpr("id AS a", "id + 1 AS b", "1.0 AS cost")
    found = graphs.cheapest_paths(chain, spark.createDataFrame([(0,)], "s long"), "a", "b", "cost", "s")
    assert {r.node: r.distance for r in found.collect()} == {i: float(i) for i in range(41)}
    roots = graphs.components(chain, spark.range(43), "a", "b", "id")
    assert {r.node: r.root for r in roots.collect()} == {**dict.fromkeys(range(41), 0), 41: 41, 42: 42}
    assert sorted(r.node for r in graphs.largest_component(roots).collect()) == list(range(41))
    for wrong in (-1.0, None):
        with pytest.raises(Exception, match="cost is null or negative"):
            graphs.cheapest_paths(spark.createDataFrame([(1, 2, wrong)], "a int, b int, cost double"), spark.createDataFrame([(1,)], "s int"), "a", "b", "cost", "s")
    with pytest.raises(RuntimeError):
        graphs.cheapest_paths(chain, spark.createDataFrame([(0,)], "s long"), "a", "b", "cost", "s", most_rounds=3)


def test_components_of_random_graphs(spark):
    edges = random_graph(3, 90, 60)
    root = list(range(90))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, _ in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = graphs.components(spark.createDataFrame(edges, "a int, b int, cost double"), spark.range(90), "a", "b", "id")
    assert {r.node: r.root for r in got.collect()} == {i: top(i) for i in range(90)}
    assert graphs.components(spark.createDataFrame([], "a int, b int"), spark.range(0), "a", "b", "id").count() == 0


def test_updates_fold_in_their_order(spark):
    rnd = random.Random(8)
    rows = [(k, name, i, rnd.choice([None, 1.5, -2.0, 4.0])) for k in ("x", None, "y") for name in ("minus", "last", None, "text") for i in range(rnd.choice([1, 7, 3000]))]
    rnd.shuffle(rows)
    reducers = {"minus": lambda old, new: (old or 0.0) - (new or 0.0), "text": lambda old, new: (old or 0.0) / 2 + (new or 1.0)}
    got = {(r.k, r["name"]): (r.v, r.n) for r in folding.ordered_fold(spark.createDataFrame(rows, "k string, name string, i int, v double"), ["k"], "name", ["i"], "v", reducers).collect()}
    want = {}
    for k, name, _, v in sorted(rows, key=lambda r: r[2]):
        if (k, name) in want:
            old, n = want[k, name]
            want[k, name] = (reducers[name](old, v) if name in reducers else v, n + 1)
        else:
            want[k, name] = (v, 1)
    assert got == want
    assert folding.ordered_fold(spark.createDataFrame([], "k string, name string, i int, v double"), ["k"], "name", ["i"], "v", {}).count() == 0


def track(spark, names, frames=5, bits=13, seed=1):
    rnd = np.random.default_rng(seed)
    masks = {(n, f): rnd.integers(0, 2, bits).astype(bool) for n in names for f in range(frames)}
    rows = spark.createDataFrame([(n, f, m.tolist()) for (n, f), m in masks.items()], "instance string, frame int, mask array<boolean>")
    return rows.select("instance", "frame", tracks.packed_bits(F.col("mask")).alias("packed"), F.size("mask").alias("bits")), {k: np.packbits(m, bitorder="little").tobytes() for k, m in masks.items()}


def test_tracks_are_sliced_byte_for_byte(spark):
    rows, packed = track(spark, ["a", "b"])
    got = tracks.slice_tracks(rows, "instance", "frame", 1, 4).collect()
    assert {(r.instance, r.frame): bytes(r.packed) for r in got} == {(n, f - 1): p for (n, f), p in packed.items() if 1 <= f < 4}
    assert sorted({(r.frame, r.parent_frame) for r in got}) == [(0, 1), (1, 2), (2, 3)]
    with pytest.raises(Exception, match="exceeds an instance with 5 frames"):
        tracks.slice_tracks(rows, "instance", "frame", 3, 6).collect()
    for start, end in ((2, 2), (-1, 3)):
        with pytest.raises(ValueError):
            tracks.slice_tracks(rows, "instance", "frame", start, end)
    empty = spark.createDataFrame([([],), ([True] * 8,), ([None, True],)], "mask array<boolean>").select(tracks.packed_bits(F.col("mask")).alias("p")).collect()
    assert [bytes(r.p) for r in empty] == [b"", b"\xff", b"\x02"]


def test_tracks_are_merged_if_they_are_alike(spark):
    (one, a), (other, b) = track(spark, ["a", "b"]), track(spark, ["c", "d", "a"], seed=2)
    got = tracks.merge_tracks([(one, ["a"]), (other, ["d", "c"])], "instance", "frame", "bits").collect()
    want = {("a", f): (0, a["a", f]) for f in range(5)} | {(n, f): (1, b[n, f]) for n in "cd" for f in range(5)}
    assert {(r.instance, r.frame): (r.part, bytes(r.packed)) for r in got} == want
    for parts, what in (([(one, ["a"]), (other, ["a"])], "missing or named twice"), ([(one, ["a", "x"])], "missing"), ([(one, ["a"]), (track(spark, ["z"], 4)[0], ["z"])], "differ"), ([(one, ["a"]), (track(spark, ["z"], 5, 14)[0], ["z"])], "differ"), ([(one.unionByName(one.limit(1)), ["a", "b"])], "twice"), ([(one.filter("frame <> 2"), ["a"])], "gaps")):
        with pytest.raises(Exception, match=what):
            tracks.merge_tracks(parts, "instance", "frame", "bits").collect()


KINDS = {"meta": (r"metadata_\w+\.json", 1), "pose": (r"trajectory\.h5", 1), "camera": (r"recordings/SVO/\d+\.svo", 3)}


def test_groups_need_exact_numbers_of_each_kind(spark):
    svo = [f"recordings/SVO/{i}.svo" for i in (1, 2, 3)]
    groups = {
        "good": ["metadata_x.json", "trajectory.h5", *svo, "recordings/MP4/1.mp4", "other"],
        "few": ["metadata_x.json", "trajectory.h5", *svo[:2]],
        "many": ["metadata_x.json", "metadata_y.json", "trajectory.h5", *svo],
        "twice": ["metadata_x.json", "trajectory.h5", *svo, svo[0]],
        "none": ["trajectory.h5.part"],
    }
    rows = spark.createDataFrame([(g, p) for g, ps in groups.items() for p in ps], "g string, path string")
    got = {}
    for r in contracts.by_pattern(rows, ["g"], "path", KINDS).collect():
        got.setdefault((r.g, r.fault), []).append((r.path, r.kind))
    assert got.keys() == {("good", None), ("few", "3 camera needed, found 2"), ("many", "1 meta needed, found 2"), ("twice", "a path occurs twice")}
    assert sorted(got["good", None]) == sorted([("metadata_x.json", "meta"), ("trajectory.h5", "pose"), *((p, "camera") for p in svo)])


def test_a_broken_contract_stops_the_write_that_finds_it(spark, tmp_path):
    folder = f"{tmp_path}/t"
    svo = [(f"g{n}", p) for n in range(3) for p in ["metadata_x.json", "trajectory.h5", *(f"recordings/SVO/{i}.svo" for i in (1, 2, 3))]]
    checked = lambda rows: contracts.by_pattern(spark.createDataFrame(rows, "g string, path string"), ["g"], "path", KINDS)
    with pytest.raises(ValueError, match="4 of 14 rows break"):
        contracts.append_observed(checked(svo[:-1]), folder, ["g", "path"], F.col("fault").isNotNull())
    assert commits.commits(spark, folder) == []
    assert contracts.append_observed(checked(svo), folder, ["g", "path"], F.col("fault").isNotNull()) == 1
    assert commits.read_committed(spark, folder, checked(svo).schema).count() == 15


def test_channels_are_relabelled_with_evidence(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], 1.0), (2, ["a", "b"], 2.0), (3, ["a", "c"], 1.0), (4, ["a", "b"], None), (5, None, 1.0)], "id int, names array<string>, norm double")
    got = {r.id: (r["names"], r.old_labels, r.relabelled) for r in contracts.relabelled(rows, "names", F.abs(F.col("norm") - 1) < 1e-3, ["a", "b"], ["x", "y"]).collect()}
    assert got == {1: (["x", "y"], ["a", "b"], True), 2: (["a", "b"], ["a", "b"], False), 3: (["a", "c"], ["a", "c"], False), 4: (["a", "b"], ["a", "b"], False), 5: (None, None, False)}
    with pytest.raises(ValueError):
        contracts.relabelled(rows, "names", F.lit(True), ["a"], ["x", "y"])


def test_many_targets_are_fitted_as_each_alone(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(200, 3)) * [1, 10, 0] + [0, 5, 2]
    y = np.stack([x @ [1, 2, 0] + 3, x @ [0, -1, 0] + rnd.normal(size=200)], 1)
    rows = [(i % 2, *map(float, x[i]), *map(float, y[i])) for i in range(200)] + [(0, None, 1.0, 2.0, 9.0, 9.0), (7, 1.0, 1.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "g int, a double, b double, c double, y double, z double")
    got = {(r.g, r.target): r.coefficients for r in learning.ridge_many(frame, ["g"], ["a", "b", "c"], ["y", "z"], 0.5, 2).collect()}
    assert got.keys() == {(g, t) for g in (0, 1) for t in ("y", "z")}
    for g in (0, 1):
        own = x[g::2]
        mean, scale = own.mean(0), np.where(own.std(0) < 1e-8, 1.0, own.std(0))
        s = (own - mean) / scale
        for j, t in enumerate("yz"):
            v = y[g::2, j]
            slopes = np.linalg.solve(s.T @ s + 0.5 * np.eye(3), s.T @ (v - v.mean())) / scale
            assert got[g, t] == pytest.approx([v.mean() - mean @ slopes, *slopes], abs=1e-6)


def test_regret_of_choosing_by_a_model(spark):
    rows = []
    for fold in "abc":
        for case in (1, 2):
            for item, (x, utility, ok) in {"best": (3.0, 9.0, False), "good": (2.0, 5.0, True), "fair": (1.0, 7.0, True), "bad": (0.0, 1.0, None)}.items():
                rows.append((fold, case, item, x, 2 * x + 1, utility, ok if case == 1 or fold != "a" else False))
    frame = spark.createDataFrame(rows, "fold string, `case` int, item string, x double, y double, utility double, ok boolean")
    got = {(r.fold, r.case): r for r in learning.fold_regret(frame, "fold", ["case"], "item", ["x"], "y", "utility", "ok", 1e-6).collect()}
    r = got["b", 1]
    assert (r.first, r.first_passed, r.selected, r.evaluated, r.oracle, r.oracle_utility, r.regret, r.exact) == ("best", False, "good", 2, "fair", 7.0, 2.0, False)
    assert r.predicted == pytest.approx(5.0, abs=1e-3)
    none = got["a", 2]
    assert (none.first, none.selected, none.evaluated, none.oracle, none.regret, none.exact) == ("best", None, 4, None, None, None) and not math.isnan(got["c", 2].regret)


def test_rows_meet_the_fits_of_their_group_where_they_are(spark, tmp_path):
    from loomspark.queries import QUERIES

    rows = spark.range(40).select(*((F.col("id") % k).cast("double").alias(c) for k, c in ((7, "l_quantity"), (5, "l_discount"), (3, "l_tax"), (11, "l_extendedprice"))), F.concat(F.lit("g"), F.col("id") % 2).alias("l_returnflag"), (F.col("id") % 4).alias("l_suppkey"), (F.col("id") % 8).alias("l_linenumber"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("ridge_logo", "fold_regret"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert name == "fold_regret" or "SortAggregate" not in plan


def test_points_meet_the_segments_of_their_cell(spark):
    from loomspark.operators import sequences

    rng = random.Random(3)
    corners = [(k, i, rng.uniform(-1, 9), rng.uniform(0, 9)) for k in range(2) for i in range(60)] + [(2, 0, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    points = [(k, i, rng.uniform(-1, 9), float(rng.randrange(10))) for k in range(2) for i in range(200)] + [(2, 0, 4.0, 5.0), (0, 999, 60.0, 60.0)]
    p, c = spark.createDataFrame(points, "k int, p int, x double, y double"), spark.createDataFrame(corners, "k int, o int, cx double, cy double")
    found = sequences.closest_on_polyline(p, c, ["k"], "p", "o")
    assert "closest" in str(found.inputFiles())
    got = {(r.k, r.p): r.distance for r in found.collect()}

    def far(x, y, a, b):
        dx, dy = b[2] - a[2], b[3] - a[3]
        t = min(1, max(0, ((x - a[2]) * dx + (y - a[3]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(x - a[2] - t * dx, y - a[3] - t * dy)

    lines = {k: [r for r in corners if r[0] == k] for k in range(3)}
    want = {(k, i): min(far(x, y, a, b) for a, b in zip(lines[k], lines[k][1:])) for k, i, x, y in points}
    assert got.keys() == want.keys() and all(math.isclose(got[q], want[q], abs_tol=1e-9) for q in want)
