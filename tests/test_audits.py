"""Audits that fail closed, scores of sequences and robust lines on literal rows and against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import audits, quantiles, robust, scores

CONTRACT = audits.TrajectoryContract(limits=[(-1.0, 1.0), (0.0, 2.0)], fps=10.0, most_velocity=3.0, least_frames=3, least_groups=2)
POSE = [float(x) for x in (1, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1)]
SCHEMA = "k string, frame int, fit boolean, `group` string, joints array<double>, joint_deviation array<double>, shift_deviation array<double>, pose array<double>, points array<struct<x: double, y: double, u: double, v: double, confidence: double>>, overlap double, alternatives array<double>"


def frames(k, **changes):
    """Six good frames, two of which were fitted; changes set a field of some frames."""
    rows = []
    for i in range(6):
        points = [(float(p), 0.0, p + 0.5 * (i % 3), 0.0, 0.9) for p in range(4)] + [(0.0, 0.0, 99.0, 0.0, 0.1)]
        row = {"k": k, "frame": 2 * i, "fit": i < 2, "group": "ab"[i % 2], "joints": [0.1 * i, 1.0], "joint_deviation": [0.01, 0.02], "shift_deviation": [0.001] * 3, "pose": POSE, "points": points, "overlap": 0.9, "alternatives": [4.0, 3.0]}
        for name, change in changes.items():
            row[name] = change(i, row[name])
        rows.append(tuple(row.values()))
    return rows


CASES = {
    "good": {},
    "nan": {"joints": lambda i, x: [math.nan, 1.0] if i == 3 else x},
    "limit": {"joints": lambda i, x: [x[0] * 3, 1.0]},
    "fast": {"joints": lambda i, x: [0.9 if i == 4 else 0.0, 1.0]},
    "twist": {"pose": lambda i, x: [1.01, *POSE[1:]] if i == 5 else x},
    "mirror": {"pose": lambda i, x: [-1.0, *POSE[1:]]},
    "hidden": {"points": lambda i, x: x[:3] if i == 0 else x},
    "blind": {"points": lambda i, x: [] if i == 3 else x},
    "fitted": {"fit": lambda i, x: True},
    "one group": {"group": lambda i, x: "a" if i else " "},
    "off": {"points": lambda i, x: [(a, b, u + 20.0, v, c) for a, b, u, v, c in x]},
    "thin": {"overlap": lambda i, x: 0.1 if i == 4 else x},
    "unsure": {"joint_deviation": lambda i, x: [0.01, None] if i == 1 else x, "shift_deviation": lambda i, x: [0.02] * 3},
    "other": {"alternatives": lambda i, x: [5.0, 0.2]},
    "alone": {"alternatives": lambda i, x: []},
    "twice": {"frame": lambda i, x: 2 * max(i, 1)},
    "nulls": {name: (lambda i, x: None) for name in ("fit", "group", "joints", "joint_deviation", "shift_deviation", "pose", "points", "overlap", "alternatives")},
}
WANT = {
    "good": [], "nan": ["complete_finite_q", "joint_limits_passed", "joint_velocity_passed"], "limit": ["joint_limits_passed"], "fast": ["joint_velocity_passed"],
    "twist": ["proper_camera_from_robot_base_se3"], "mirror": ["proper_camera_from_robot_base_se3"], "hidden": ["visible_keypoint_coverage"],
    "blind": ["visible_keypoint_coverage", "heldout_reprojection_bounded", "selected_asset_beats_alternatives"],
    "fitted": ["heldout_frame_count", "heldout_group_count", "heldout_reprojection_bounded", "heldout_silhouette_iou_bounded", "selected_asset_beats_alternatives"],
    "one group": ["heldout_group_count"], "off": ["heldout_reprojection_bounded", "selected_asset_beats_alternatives"], "thin": ["heldout_silhouette_iou_bounded"], "unsure": ["full_q_posterior_observable", "metric_base_translation_observable"],
    "other": ["selected_asset_beats_alternatives"], "alone": ["selected_asset_beats_alternatives"], "twice": ["joint_velocity_passed"],
    "nulls": ["complete_finite_q", "joint_limits_passed", "joint_velocity_passed", "proper_camera_from_robot_base_se3", "visible_keypoint_coverage", "heldout_group_count", "heldout_reprojection_bounded", "heldout_silhouette_iou_bounded", "full_q_posterior_observable", "metric_base_translation_observable", "selected_asset_beats_alternatives"],
}


def test_a_trajectory_fails_at_the_gates_it_breaks(spark):
    rows = [r for k, changes in CASES.items() for r in frames(k, **changes)] + frames("unbound") + frames("forged")
    bindings = [(k, "s", "t" if k == "forged" else "s", {"a": "1", "b": "2"}, {"b": "2", "a": "3" if k == "forged" else "1"}) for k in [*CASES, "forged"]]
    bound = spark.createDataFrame(bindings, "k string, source string, expected_source string, assets map<string, string>, expected_assets map<string, string>")
    got = {r.k: r for r in audits.heldout_trajectory(spark.createDataFrame(rows, SCHEMA), bound, ["k"], CONTRACT).collect()}
    assert {k: list(got[k].failed) for k in WANT} == WANT
    assert got["unbound"].failed == got["forged"].failed == ["source_video_hash_bound", "exact_asset_hashes_match_registry"]
    for k, r in got.items():
        assert r.passed == (not r.failed) and r.proposal_passed == (not set(r.failed) & set(audits.PROPOSAL))
    good = got["good"]
    errors = [0.5 * (i % 3) for i in range(2, 6)]
    assert (good.frames, good.visible_least, good.heldout_frames, good.heldout_groups) == (6, 4, 4, ["a", "b"])
    assert good.error_p95 == pytest.approx(np.percentile(errors, 95)) and good.margin_p05 == pytest.approx(np.percentile(3.0 - np.array(errors), 5))
    assert [(g.group, g.frames, g.error_p95) for g in good.group_errors] == [("a", 2, pytest.approx(np.percentile([errors[0], errors[2]], 95))), ("b", 2, pytest.approx(np.percentile([errors[1], errors[3]], 95)))]
    assert got["blind"].error_p95 == math.inf and got["fitted"].error_p95 is None and got["fitted"].group_errors == []


def test_derived_views_fail_closed(spark):
    base = [("good", 2 * i, i % 2, [1.0, 1.0 + 0.01 * (i % 2), 3.0]) for i in range(8)]
    rows = base + [("gap", f + 9 * (f > 6), g, x) for _, f, g, x in base] + [("holes", f, g, [x[0], -1.0, math.nan, None]) for _, f, g, x in base] + [("scale", f, g, [v * (1 + g) for v in x]) for _, f, g, x in base]
    rows += [("runs", f, 0, x) for _, f, _, x in base] + [("views", *r[1:]) for r in base] + [("odd", *r[1:]) for r in base] + [("twice", max(f, 2), g, x) for _, f, g, x in base]
    views = [(k, c, e) for k in ("good", "gap", "holes", "scale", "runs", "twice") for c, e in ((0.9, 0.1), (0.7, 0.2))] + [("odd", 0.9, None), ("odd", 0.9, 0.1)]
    got = {r.k: r for r in audits.derived_views(spark.createDataFrame(rows, "k string, frame int, `group` int, depths array<double>"), spark.createDataFrame(views, "k string, coverage double, cycle_error double"), ["k"], 2, 30.0, 2, 0.9, 0.75, 0.25, 0.05).collect()}
    good = got["good"]
    assert good.passed and (good.samples, good.gap, good.hz, good.valid, good.coverage, good.cycle_error) == (8, 2, 15.0, 1.0, 0.8, 0.2) and good.spread == pytest.approx(0.01 / 1.005)
    want = {"gap": "dense_interleaved_timeline", "holes": "valid_positive_depth", "scale": "same_model_cross_run_scale_stable", "runs": "group_coordinate_frames_are_explicit", "twice": "dense_interleaved_timeline"}
    assert {k: list(got[k].failed) for k in want} == {k: [v] for k, v in want.items()}
    assert got["views"].failed == got["odd"].failed == ["virtual_view_visible_surface_coverage", "virtual_view_cycle_depth_bounded"]


def test_failed_gates_need_a_registered_repair(spark):
    rows = spark.createDataFrame([("a1", "g2", "slip"), ("a2", "g1", "slip"), ("a1", "g2", "slip"), (None, "g3", "slip"), ("a3", "g1", None), ("a1", "g1", "jerk")], "architecture string, `group` string, gate string")
    registry = spark.createDataFrame([("slip", "grip"), ("jerk", "smooth"), ("late", "plan")], "gate string, repair string")
    got = {r.gate: (r.repair, r.subjects, r.groups) for r in audits.by_failed_gate(rows, registry, "gate", "architecture", "group").collect()}
    assert got == {"slip": ("grip", ["a1", "a2"], ["g1", "g2", "g3"]), "jerk": ("smooth", ["a1"], ["g1"])}
    with pytest.raises(Exception, match="nothing is registered for the gate jerk"):
        audits.by_failed_gate(rows, registry.filter("gate <> 'jerk'"), "gate", "architecture", "group").collect()


def test_identities_and_phases(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a string, b string, i int, prefix string")
    got = [tuple(r)[3:] for r in audits.identities(frame([("x", "y", 3, "p"), (None, "y", None, "p")]), "a", "b", "i", "prefix").collect()]
    assert got == [("p", "x", True), (None, "y", False)]
    for row in ((None, None, 1, ""), ("", "y", 1, ""), ("x", "y", -1, "")):
        with pytest.raises(Exception, match="no name|negative"):
            audits.identities(frame([row]), "a", "b", "i").collect()
    phases = lambda target: spark.createDataFrame([("c", "p1", 0, 20, "reach", None), ("c", "p2", 20, 60, "grasp", target), ("c", "p3", 60, 80, "leave", None)], "k string, name string, s int, e int, phase string, target string")
    constant = {"constraint": F.lit("whole"), "side": F.lit("left"), "target": F.lit("vase"), "phase": F.lit("hold"), "confidence": F.lit(0.8)}
    run = lambda target: sorted(map(tuple, audits.phase_constraints(phases(target), ["k"], "name", "s", "e", "phase", "target", ["grasp"], constant).collect()))
    assert run("rose") == [("c", "right-p2", "right", "rose", 20, 60, "grasp", 0.65), ("c", "whole", "left", "vase", 0, 80, "hold", 0.8)]
    with pytest.raises(Exception, match="has no target: p2"):
        run(None)


def test_likeness_of_motion(spark):
    rnd = np.random.default_rng(5)
    t, c, m = rnd.normal(size=(7, 4)) * 50, rnd.normal(size=(7, 4)) * 50, rnd.integers(0, 2, (7, 4)).astype(bool)
    m[3:5] = False
    rows = [("a", i, t[i].tolist(), c[i].tolist(), m[i].tolist()) for i in range(7)] + [("same", i, t[i].tolist(), t[i].tolist(), [True] * 4) for i in range(3)] + [("off", i, t[i].tolist(), c[i].tolist(), [False] * 4) for i in range(3)] + [("one", 0, [1.0], [1.0], [True])]
    got = {r.k: r for r in scores.motion_likeness(spark.createDataFrame(rows, "k string, i int, t array<double>, c array<double>, m array<boolean>"), ["k"], "i", "t", "c", "m").collect()}
    dt, dc, on = abs(np.diff(t, axis=0)), abs(np.diff(c, axis=0)), m[1:] | m[:-1]
    assert got["a"].profile == pytest.approx(math.exp(-abs(dc.mean(1) - dt.mean(1)).mean() / dt.mean(1).mean()))
    steps = [(dt[i][on[i]].mean(), dc[i][on[i]].mean(), abs(dt[i] - dc[i])[on[i]].mean()) for i in range(6) if on[i].any()]
    assert len(steps) == 5
    a, b, gap = map(np.array, zip(*steps, strict=True))
    assert got["a"].adherence == pytest.approx(math.exp(-abs(a - b).mean() / (a.mean() + 5))) and got["a"].similarity == pytest.approx(np.exp(-gap / 32).mean())
    assert tuple(got["same"])[1:] == (1.0, 1.0, 1.0) and got["off"].adherence == 0.0 and got["off"].similarity is None
    assert tuple(got["one"])[1:] == (None, 0.0, None)
    unit = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0])]
    found = scores.adjacent_cosines(spark.createDataFrame([("s", *r) for r in unit] + [("one", 1, [1.0, 0.0])], "k string, i int, v array<double>"), ["k"], "i", "v")
    assert {(r.k, r.i): r.score for r in found.collect()} == {("s", 1): None, ("s", 2): 0.5, ("s", 3): 0.0, ("one", 1): 1.0}


def test_steady_angles(spark):
    rnd = np.random.default_rng(6)
    n = 40
    angle, length = np.cumsum(rnd.normal(size=n) * 0.6) + 3, np.where(rnd.random(n) < 0.3, 0.5, 3.0)
    u, v = np.cos(angle) * length, np.sin(angle) * length
    rows = [("a", i, 0.0, 0.0, float(u[i]), float(v[i])) for i in range(n)] + [("none", i, 0.0, 0.0, 0.1, 0.1) for i in range(3)]
    frame = spark.createDataFrame(rows, "k string, i int, x double, y double, u double, v double")
    got = {(r.k, r.i): r for r in scores.steady_angles(frame, ["k"], "i", ["x", "y"], ["u", "v"], 1.0, 1, 0.8).collect()}
    good = length >= 1
    filled = np.interp(np.arange(n), np.flatnonzero(good), np.unwrap(np.arctan2(v, u)[good]))
    middle = np.array([np.median(filled[max(0, i - 1) : i + 2]) for i in range(n)])
    radius = max(1, round(3 * 0.8))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / 0.8) ** 2)
    want = np.convolve(np.pad(middle, radius, "edge"), kernel / kernel.sum(), "valid")
    assert [got["a", i].angle for i in range(n)] == pytest.approx(want.tolist()) and [got["a", i].reliable for i in range(n)] == good.tolist()
    assert all(got["none", i].angle is None for i in range(3))
    with pytest.raises(ValueError):
        scores.steady_angles(frame, ["k"], "i", ["x", "y"], ["u", "v"], 0.0, 1, 0.8)


def test_bodies_turns_and_choices(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id int, x array<double>")
    got = {r.body: (r.actions, r.valid) for r in scores.fan_out(rows, "x", {"a": ([[1.0, 1.0], [0.0, 2.0]], [0.5, 0.0]), "b": ([[3.0, 0.0]], [0.0])}).collect()}
    assert got == {"a": ([3.5, 4.0], [True, True]), "b": ([3.0, 0.0], [True, False])}
    for bodies in ({"a": ([[1.0]], [0.0])}, {"a": ([[1.0]], [0.0]), "b": ([], [])}):
        with pytest.raises(ValueError):
            scores.fan_out(rows, "x", bodies)
    product = scores.frozen_product(rows.select("id"), {"p": ["x", "y", "z"], "q": ["1", "2"]}).orderBy("combination").collect()
    assert [(r.combination, r.p + r.q) for r in product] == [(0, "x1"), (1, "x2"), (2, "y1"), (3, "y2"), (4, "z1"), (5, "z2")]
    quarter = [math.sqrt(0.5), 0.0, 0.0, math.sqrt(0.5)]
    half = [0.0, 0.0, 0.0, 1.0]
    source = spark.createDataFrame([("a", 0, 1.0, [1.0, 0.0, 0.0, 0.0]), ("a", 1, 2.0, quarter), ("a", 2, 9.0, half)], "k string, i int, x double, q array<double>")
    donor = spark.createDataFrame([("a", 0, 0.0, half), ("a", 1, 5.0, [1.0, 0.0, 0.0, 0.0]), ("a", 2, 7.0, quarter)], "k string, i int, x double, q array<double>")
    moved = {r.i: (r.x, r.q) for r in scores.rebased_turns(source, donor, ["k"], "i", 2, ["x"], ["q"]).collect()}
    assert moved[0] == (1.0, [1.0, 0.0, 0.0, 0.0]) and moved[1] == (2.0, quarter) and moved[2][0] == 4.0 and moved[2][1] == pytest.approx(half)


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_robust_lines_like_one_group_after_another(spark, monkeypatch, small):
    monkeypatch.setattr(robust, "SMALL", small)
    monkeypatch.setattr(quantiles, "FEW", 10)
    rnd = np.random.default_rng(2)
    rows = [("a", float(x), 2.0 * x + 1) for x in range(20)] + [("a", 5.0, 500.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", None, 1.0), (None, 0.0, 1.0), (None, 1.0, 3.0)]
    x = rnd.uniform(0, 50, 60)
    y = 3 * x - 7 + rnd.standard_t(1.5, 60) * 4
    rows += [("noisy", float(p), float(q)) for p, q in zip(x, y, strict=True)]
    rounds = 4 if small == 0 else 20
    got = {r.g: r for r in robust.huber_line(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y", most_rounds=rounds).collect()}

    def fit(a, b):
        slope, weight = None, np.ones(len(a))
        for _ in range(rounds):
            mx, my = np.average(a, weights=weight), np.average(b, weights=weight)
            new = (weight * (a - mx) * (b - my)).sum() / (weight * (a - mx) ** 2).sum()
            done, slope, intercept = slope is not None and abs(new - slope) < 1e-10, new, my - new * mx
            if done:
                break
            gap = abs(b - intercept - slope * a)
            weight = np.minimum(1, 1.345 * max(1.4826 * np.median(gap), 1e-9) / np.maximum(gap, 1e-12))
        return slope, intercept

    for g in ("a", "noisy", None):
        own = np.array([(p, q) for k, p, q in rows if k == g])
        assert (got[g].slope, got[g].intercept) == pytest.approx(fit(own[:, 0], own[:, 1]), abs=1e-7) and got[g].n == len(own)
    assert (got["b"].slope, got["b"].intercept, got["b"].n) == (None, None, 2) and "c" not in got
