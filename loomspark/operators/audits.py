"""Audits that fail closed: held-out trajectories, derived views, and what follows from the gates that failed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.quantiles import quantiles


def _finite(x: Column) -> Column:
    return F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))


def _same(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return same


def _named(rows: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    return rows.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *more)


def _failed(gates: Mapping[str, Column]) -> Column:
    """Names of the gates that aren't passed, in their order; null isn't."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates.items())))


@dataclass(frozen=True)
class TrajectoryContract:
    """Limits of each joint and the bounds of the gates."""

    limits: Sequence[tuple[float, float]]
    fps: float
    most_velocity: float
    least_confidence: float = 0.2
    least_visible: int = 4
    least_frames: int = 10
    least_groups: int = 2
    most_error: float = 6.0
    least_overlap: float = 0.75
    most_joint_deviation: float = 0.05
    most_shift_deviation: float = 0.01
    least_margin: float = 1.0


#: Names of gates, here and below, are those of the reports that they stand in.
PROPOSAL = ("complete_finite_q", "joint_limits_passed", "joint_velocity_passed", "proper_camera_from_robot_base_se3", "visible_keypoint_coverage")


def heldout_trajectory(frames: DataFrame, bindings: DataFrame, keys: Sequence[str], c: TrajectoryContract) -> DataFrame:
    """One row for each trajectory with its measures on held-out frames, the gates that failed and whether it passed.

    ``frames`` has, for each frame: frame (a number), fit (used in the fit, so
    not held out), group, joints, joint_deviation, shift_deviation, pose (4 x 4,
    row by row), points (structs of x, y as observed, u, v as rendered, and
    confidence), overlap, and alternatives (errors of other assets). ``bindings``
    has, for each trajectory: source, expected_source, assets and
    expected_assets (maps of digests); one without bindings fails.

    A frame's error is the root of the mean squared distance of its visible
    points (finite, confident enough), infinite without any. Held-out frames are
    those whose fit isn't true. Quantiles are exact. The fourteen gates fail on
    nulls, on what isn't finite, and where there is nothing to measure. Returns
    ``keys``, frames, visible_least, heldout_frames, heldout_groups, error_p95,
    overlap_p05, joint_deviation, shift_deviation, margin_p05, orthogonality,
    group_errors (group, frames, error_p95), failed, proposal_passed and passed.
    """
    n = len(c.limits)
    own = Window.partitionBy(*keys).orderBy("frame")
    seen = F.filter("points", lambda p: _finite(p["x"]) & _finite(p["y"]) & _finite(p["u"]) & _finite(p["v"]) & _finite(p["confidence"]) & (p["confidence"] >= c.least_confidence))
    squares = F.aggregate("_seen", F.lit(0.0), lambda s, p: s + F.pow(p["u"] - p["x"], 2) + F.pow(p["v"] - p["y"], 2))
    error = F.when(F.size("_seen") > 0, F.sqrt(squares / F.size("_seen"))).otherwise(float("inf"))
    inside = F.lit(True)
    speeds = []
    for i, (low, high) in enumerate(c.limits):
        q = F.col("joints")[i].cast("double")
        inside = inside & q.between(low, high)
        speeds.append(F.abs(q - F.lag(F.col("joints")[i].cast("double")).over(own)))
    complete = F.forall(F.array(*speeds), lambda x: x.isNotNull())
    speed = F.try_divide(F.when(complete, F.greatest(*speeds, F.lit(0.0))) * c.fps, F.col("frame") - F.lag("frame").over(own))
    m = lambda i, j: F.col("pose")[4 * i + j]
    gram = [[sum((m(k, i) * m(k, j) for k in range(3)), F.lit(0.0)) - (1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
    orthogonality = F.sqrt(sum((F.pow(g, 2) for row in gram for g in row), F.lit(0.0)))
    det = m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))
    bottom = F.greatest(F.abs(m(3, 0)), F.abs(m(3, 1)), F.abs(m(3, 2)), F.abs(m(3, 3) - 1))
    every = lambda a, size=None: F.coalesce(F.forall(a, _finite) & (F.size(a) == size if size else F.size(a) > 0), F.lit(False))
    rows = frames.withColumn("_seen", F.coalesce(seen, F.array().cast(frames.schema["points"].dataType))).withColumn("_error", error)
    rows = rows.select(
        *keys, "frame", "_error", F.size("_seen").alias("_visible"), (~F.coalesce(F.col("fit"), F.lit(False))).alias("_held"), F.trim(F.coalesce(F.col("group").cast("string"), F.lit(""))).alias("_group"),
        every("joints", n).alias("_finite"), F.coalesce(inside, F.lit(False)).alias("_inside"), speed.alias("_speed"), F.lag("frame").over(own).isNull().alias("_first"),
        (every("pose", 16) & (bottom <= 1e-6) & (orthogonality <= 1e-3) & (F.abs(det - 1) <= 1e-3)).alias("_se3"), orthogonality.alias("_orthogonality"), F.col("overlap").cast("double").alias("_overlap"),
        F.when(every("joint_deviation", n), F.array_max("joint_deviation")).otherwise(float("inf")).alias("_qd"), F.when(every("shift_deviation", 3), F.array_max("shift_deviation")).otherwise(float("inf")).alias("_td"),
        F.when(F.size("alternatives") > 0, F.when(F.col("_error") < float("inf"), F.array_min("alternatives") - F.col("_error")).otherwise(float("-inf"))).otherwise(float("-inf")).alias("_margin"),
    )
    held = rows.filter("_held")
    none, least = F.lit(None).cast("string"), F.lit(float("-inf"))
    measure = lambda name, group, x: F.struct(F.lit(name).alias("m"), group.alias("g"), x.alias("x"))
    measures = F.array(measure("error", none, F.col("_error")), measure("overlap", none, F.coalesce("_overlap", least)), measure("margin", none, F.coalesce("_margin", least)), measure("group", F.col("_group"), F.col("_error")))
    long = held.select(*keys, F.explode(measures).alias("e")).select(*keys, F.col("e.m").alias("_m"), F.col("e.g").alias("_g"), F.col("e.x").alias("_x")).filter("_m <> 'group' OR _g <> ''")
    ranks = quantiles(long, [*keys, "_m", "_g"], "_x", {"_low": 0.05, "_high": 0.95})
    at = lambda name, column: F.max(F.when(F.col("_m") == name, F.col(column)))
    group_rows = F.array_sort(F.collect_list(F.when(F.col("_m") == "group", F.struct(F.col("_g").alias("group"), F.col("n").alias("frames"), F.col("_high").alias("error_p95")))))
    summed = ranks.groupBy(*keys).agg(at("error", "_high").alias("error_p95"), at("overlap", "_low").alias("overlap_p05"), at("margin", "_low").alias("margin_p05"), group_rows.alias("group_errors"))
    whole = rows.groupBy(*keys).agg(
        F.count("*").alias("frames"), F.count_distinct("frame").alias("_distinct"), F.min("_visible").alias("visible_least"), F.count_if("_held").alias("heldout_frames"), F.array_sort(F.collect_set(F.when(F.col("_held") & (F.col("_group") != ""), F.col("_group")))).alias("heldout_groups"),
        F.max("_qd").alias("joint_deviation"), F.max("_td").alias("shift_deviation"), F.max("_orthogonality").alias("orthogonality"), F.min("_finite").alias("_finite"), F.min("_inside").alias("_inside"), F.min("_se3").alias("_se3"),
        F.max("_speed").alias("_speed"), F.count_if(F.col("_speed").isNull() & ~F.col("_first")).alias("_still"),
    )
    bound = _named(bindings, keys, "source", "expected_source", F.array_sort(F.map_entries("assets")).alias("_assets"), F.array_sort(F.map_entries("expected_assets")).alias("_expected"))
    found = whole.join(_named(summed, keys, "error_p95", "overlap_p05", "margin_p05", "group_errors"), _same(keys), "left").drop(*(f"_k{i}" for i in range(len(keys)))).join(bound, _same(keys), "left")
    gates = {
        "source_video_hash_bound": F.col("source") == F.col("expected_source"),
        "exact_asset_hashes_match_registry": F.col("_assets") == F.col("_expected"),
        "complete_finite_q": F.col("_finite"),
        "joint_limits_passed": F.col("_finite") & F.col("_inside"),
        "joint_velocity_passed": (F.col("frames") > 1) & (F.col("frames") == F.col("_distinct")) & (F.col("_still") == 0) & (F.col("_speed") <= c.most_velocity),
        "proper_camera_from_robot_base_se3": F.col("_se3"),
        "visible_keypoint_coverage": F.col("visible_least") >= c.least_visible,
        "heldout_frame_count": F.col("heldout_frames") >= c.least_frames,
        "heldout_group_count": F.size("heldout_groups") >= c.least_groups,
        "heldout_reprojection_bounded": F.col("error_p95") <= c.most_error,
        "heldout_silhouette_iou_bounded": F.col("overlap_p05") >= c.least_overlap,
        "full_q_posterior_observable": F.col("joint_deviation") <= c.most_joint_deviation,
        "metric_base_translation_observable": F.col("shift_deviation") <= c.most_shift_deviation,
        "selected_asset_beats_alternatives": F.col("margin_p05") >= c.least_margin,
    }
    found = found.withColumn("failed", _failed(gates))
    proposal = ~F.arrays_overlap("failed", F.array(*map(F.lit, PROPOSAL)))
    return found.select(
        *keys, "frames", "visible_least", "heldout_frames", "heldout_groups", "error_p95", "overlap_p05", "joint_deviation", "shift_deviation", "margin_p05", "orthogonality",
        F.coalesce("group_errors", F.array().cast("array<struct<group: string, frames: bigint, error_p95: double>>")).alias("group_errors"), "failed", proposal.alias("proposal_passed"), (F.size("failed") == 0).alias("passed"),
    )


def derived_views(frames: DataFrame, views: DataFrame, keys: Sequence[str], groups: int, fps: float, most_gap: int, least_valid: float, least_coverage: float, most_cycle: float, most_spread: float) -> DataFrame:
    """Whether depths that a model derived are dense, valid, seen by other views and of one scale over its runs.

    ``frames`` has frame, group (the model's run, a name) and depths; ``views``
    has coverage and cycle_error. A depth is valid if it is finite and above 0;
    a run's scale is the exact median of its valid depths, the spread of scales
    (largest - least) / median of all. Returns ``keys``, samples, gap (the largest between frames), hz,
    valid (share of all depths), coverage, cycle_error, spread, failed (of six
    gates) and passed. Nulls, missing views, repeated frames and other than ``groups`` runs fail.
    """
    own = Window.partitionBy(*keys).orderBy("frame")
    rows = frames.withColumn("_gap", F.col("frame") - F.lag("frame").over(own))
    valid = F.size(F.filter("depths", lambda x: _finite(x) & (x > 0)))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("samples"), F.max("_gap").alias("gap"), F.min("_gap").alias("_least"), (F.sum(valid) / F.sum(F.size("depths"))).alias("valid"), F.count_distinct("group").alias("_groups"), F.count_if(F.col("group").isNull() | F.col("frame").isNull()).alias("_nameless"))
    long = frames.select(*keys, "group", F.explode("depths").alias("_x")).filter(_finite(F.col("_x")) & (F.col("_x") > 0))
    scales = quantiles(long, [*keys, "group"], "_x", {"_scale": 0.5})
    spread = quantiles(scales, keys, "_scale", {"_low": 0.0, "_middle": 0.5, "_high": 1.0}).withColumn("spread", (F.col("_high") - F.col("_low")) / F.greatest(F.abs("_middle"), F.lit(1e-12)))
    seen = views.groupBy(*keys).agg(F.avg("coverage").alias("coverage"), F.max("cycle_error").alias("cycle_error"), F.count_if(~_finite(F.col("coverage")) | ~_finite(F.col("cycle_error"))).alias("_odd"))
    found = whole.join(_named(spread, keys, "spread"), _same(keys), "left").drop(*(f"_k{i}" for i in range(len(keys)))).join(_named(seen, keys, "coverage", "cycle_error", "_odd"), _same(keys), "left")
    gates = {
        "dense_interleaved_timeline": (F.col("gap") <= most_gap) & (F.col("_least") > 0) & (F.col("_nameless") == 0),
        "valid_positive_depth": F.col("valid") >= least_valid,
        "virtual_view_visible_surface_coverage": (F.col("_odd") == 0) & (F.col("coverage") >= least_coverage),
        "virtual_view_cycle_depth_bounded": (F.col("_odd") == 0) & (F.col("cycle_error") <= most_cycle),
        "same_model_cross_run_scale_stable": F.col("spread") <= most_spread,
        "group_coordinate_frames_are_explicit": F.col("_groups") == groups,
    }
    found = found.withColumn("failed", _failed(gates))
    return found.select(*keys, "samples", "gap", F.try_divide(F.lit(float(fps)), F.col("gap")).alias("hz"), "valid", "coverage", "cycle_error", "spread", "failed", (F.size("failed") == 0).alias("passed"))


def by_failed_gate(failures: DataFrame, registry: DataFrame, gate: str, subject: str, group: str) -> DataFrame:
    """What the registry has against each gate that failed, with the subjects and groups that failed it, each once and sorted.

    A gate that failed and isn't in the registry raises when the result is read; one that
    nobody failed has no row. Null subjects and groups are left out.
    """
    found = failures.filter(F.col(gate).isNotNull()).groupBy(gate).agg(F.array_sort(F.collect_set(subject)).alias("subjects"), F.array_sort(F.collect_set(group)).alias("groups"))
    joined = found.join(registry.withColumn("_known", F.lit(True)), gate, "left")
    known = F.when(F.col("_known"), F.col(gate)).otherwise(F.raise_error(F.concat(F.lit("nothing is registered for the gate "), F.col(gate))).cast("string"))
    return joined.select(known.alias(gate), *(c for c in registry.columns if c != gate), "subjects", "groups")


def identities(rows: DataFrame, first: str, second: str, index: str, *only_mapped: str) -> DataFrame:
    """``rows`` with ``identity``, the first name or else the second, and whether it is ``mapped`` to an index.

    A name is a text that isn't empty; an empty first name doesn't give way to
    the second. A row without a name and one with a negative index raise when
    they are read. Columns of ``only_mapped`` are null where there is no index.
    """
    name = F.coalesce(F.col(first), F.col(second))
    checked = F.when(F.coalesce(name, F.lit("")) == "", F.raise_error(F.lit("a row has no name")).cast("string")).when(F.col(index) < 0, F.raise_error(F.lit("an index is negative")).cast("string")).otherwise(name)
    mapped = F.col(index).isNotNull()
    return rows.withColumn("identity", checked).withColumn("mapped", mapped).withColumns({c: F.when(mapped, F.col(c)) for c in only_mapped})


def phase_constraints(phases: DataFrame, keys: Sequence[str], name: str, start: str, end: str, phase: str, target: str, contact: Sequence[str], constant: Mapping[str, Column]) -> DataFrame:
    """One constraint over the whole of each case, and one for each phase of contact.

    ``constant`` gives constraint, side, target, phase and confidence of the
    first; the others are named by their phase, are of the side right and have
    the confidence 0.65. A phase of contact without a target raises when it is
    read. Returns ``keys``, constraint, side, target, start, end, phase, confidence.
    """
    whole = phases.groupBy(*keys).agg(F.max(F.struct(start, end))[end].alias("end"))
    first = whole.select(*keys, constant["constraint"].alias("constraint"), constant["side"].alias("side"), constant["target"].alias("target"), F.lit(0).cast("long").alias("start"), F.col("end").cast("long").alias("end"), constant["phase"].alias("phase"), constant["confidence"].cast("double").alias("confidence"))
    named = F.coalesce(F.col(target).cast("string"), F.raise_error(F.concat(F.lit("a phase of contact has no target: "), F.col(name).cast("string"))).cast("string"))
    held = phases.filter(F.col(phase).isin(list(contact))).select(*keys, F.concat(F.lit("right-"), F.col(name).cast("string")).alias("constraint"), F.lit("right").alias("side"), named.alias("target"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.col(phase).alias("phase"), F.lit(0.65).alias("confidence"))
    return first.unionByName(held)
