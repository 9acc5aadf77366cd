"""Scores of recorded sequences: likeness of neighbours, of motion, steady directions, and actions of several bodies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.scalar import quaternion_inverse, quaternion_multiply
from loomspark.operators import motion, series


def unit(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def adjacent_cosines(rows: DataFrame, keys: Sequence[str], at: str, vector: str) -> DataFrame:
    """``rows`` with ``score``: the cosine with the row before, from -1..1 to 0..1, of vectors of length one.

    The first row has none, but that of a series of one row is 1.
    """
    own = Window.partitionBy(*keys)
    before = F.lag(vector).over(own.orderBy(at))
    dot = F.aggregate(F.zip_with(F.col(vector), before, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    alone = F.when(F.count("*").over(own) == 1, 1.0)
    return rows.withColumn("score", F.when(before.isNotNull(), unit((dot + 1) / 2)).otherwise(alone))


def _mean(values: Column) -> Column:
    """The mean of an array's elements that aren't null; null if there are none."""
    some = F.array_compact(values)
    return F.try_divide(F.aggregate(some, F.lit(0.0), lambda s, x: s + x), F.size(some))


def motion_likeness(rows: DataFrame, keys: Sequence[str], at: str, target: str, candidate: str, mask: str) -> DataFrame:
    """How alike two sequences of arrays move, from their absolute changes from row to row.

    ``mask`` says of each place whether it is active; a place counts in a step
    if it is before or after it. Returns ``keys`` and

    * profile: exp(-error / scale) over all places, error being the mean difference of the steps' mean changes and scale the target's mean change, 0.001 at least;
    * adherence: the same over active places and the steps that have some, scale being the target's mean change plus 5; 0 without such a step;
    * similarity: the mean over those steps of exp(-d / 32), d the mean difference of the changes of active places; null without one.

    A series of one row has the profile null. Arrays of a series have one length; null elements don't count.
    """
    own = Window.partitionBy(*keys).orderBy(at)
    change = lambda c: F.zip_with(F.col(c), F.lag(c).over(own), lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    active = F.zip_with(F.col(mask), F.lag(mask).over(own), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
    steps = rows.select(*keys, change(target).alias("_t"), change(candidate).alias("_c"), active.alias("_on")).filter("_t IS NOT NULL AND _c IS NOT NULL")
    inside = lambda values: _mean(F.zip_with(values, F.col("_on"), lambda x, on: F.when(on, x)))
    apart = F.zip_with("_t", "_c", lambda a, b: F.abs(a - b))
    steps = steps.select(*keys, _mean(F.col("_t")).alias("_mt"), _mean(F.col("_c")).alias("_mc"), inside(F.col("_t")).alias("_at"), inside(F.col("_c")).alias("_ac"), inside(apart).alias("_d"))
    found = steps.groupBy(*keys).agg(
        F.avg(F.abs(F.col("_mc") - F.col("_mt"))).alias("_e"), F.avg("_mt").alias("_s"), F.avg(F.abs(F.col("_ac") - F.col("_at"))).alias("_ae"), F.avg("_at").alias("_as"), F.avg(F.exp(-F.col("_d") / 32)).alias("similarity")
    )
    every = rows.select(*keys).distinct()
    named = found.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_e", "_s", "_ae", "_as", "similarity")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    profile = unit(F.exp(-F.col("_e") / F.greatest("_s", F.lit(1e-3))))
    adherence = F.when(F.col("_as").isNull(), 0.0).otherwise(F.exp(-F.col("_ae") / (F.col("_as") + 5)))
    return every.join(named, same, "left").select(*keys, profile.alias("profile"), adherence.alias("adherence"), "similarity")


def steady_angles(rows: DataFrame, keys: Sequence[str], at: str, start: Sequence[str], end: Sequence[str], least_length: float, radius: int, sigma: float) -> DataFrame:
    """``keys``, ``at``, reliable and angle: the direction from start to end, of short pieces from those around.

    A piece shorter than ``least_length`` tells nothing of its direction. The
    angles of the others are unwrapped, interpolated in between and held beyond,
    then go through a median over ``radius`` rows on either side (none for 0) and
    a Gaussian of ``sigma``. A series without a reliable piece has nulls.
    """
    if least_length <= 0:
        raise ValueError("the least length is positive")
    dx, dy = F.col(end[0]) - F.col(start[0]), F.col(end[1]) - F.col(start[1])
    sized = rows.select(*keys, at, (F.sqrt(dx * dx + dy * dy) >= least_length).alias("reliable"), F.atan2(dy, dx).alias("_raw"))
    known = motion.unwrapped(sized.filter("reliable"), keys, at, "_raw").select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(at).alias("_at"), "unwrapped")
    same = F.col(at) == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = sized.join(known, same, "left").select(*keys, at, F.coalesce("reliable", F.lit(False)).alias("reliable"), "unwrapped")
    filled = series.fill_linear(joined, keys, at, "unwrapped", "_filled")
    robust = series.centred_median(filled, keys, at, "_filled", radius, "_robust") if radius else filled.withColumn("_robust", F.col("_filled"))
    return series.gaussian(robust, keys, at, "_robust", sigma, "angle").select(*keys, at, "reliable", "angle")


def rebased_turns(source: DataFrame, donor: DataFrame, keys: Sequence[str], at: str, history: int, positions: Sequence[str], turns: Sequence[str]) -> DataFrame:
    """The source's history, then the donor's movement since its own last row of history, from where the source stood.

    ``turns`` are quaternions (w, x, y, z): the donor's turn since then, seen
    from the donor, follows the source's. A case that lacks that row in either has its history alone.
    """
    names = [*positions, *turns]
    anchor = lambda df, mark: df.filter(F.col(at) == history - 1).select(*keys, *(F.col(c).alias(mark + c) for c in names))
    moved = donor.filter(F.col(at) >= history).join(anchor(donor, "_d_"), list(keys)).join(anchor(source, "_s_"), list(keys))
    out = [(F.col(f"_s_{c}") + F.col(c) - F.col(f"_d_{c}")).alias(c) for c in positions]
    out += [quaternion_multiply(F.col(f"_s_{c}"), quaternion_multiply(quaternion_inverse(F.col(f"_d_{c}")), F.col(c))).alias(c) for c in turns]
    return source.filter(F.col(at) < history).select(*keys, at, *names).unionByName(moved.select(*keys, at, *out))


def fan_out(rows: DataFrame, vector: str, bodies: dict[str, tuple[list[list[float]], list[float]]]) -> DataFrame:
    """Every row once for each body, its vector turned into the body's actions, all of one width.

    ``bodies`` gives a name, a matrix (a row of weights for each action) and
    offsets: action = offset + weights . vector. ``actions`` is padded with 0 to
    the widest body's number and ``valid`` says which places are its own. There
    are two bodies at least; every row of weights is as long as the vector, else its action is null.
    """
    if len(bodies) < 2:
        raise ValueError("there are two bodies at least")
    if any(len(weights) != len(offsets) or not offsets for weights, offsets in bodies.values()):
        raise ValueError("a body has an offset for each of its actions")
    width = max(len(offsets) for _, offsets in bodies.values())
    numbers = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    each = []
    for name, (weights, offsets) in bodies.items():
        dots = [F.lit(float(o)) + F.aggregate(F.zip_with(F.col(vector), numbers(w), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) for w, o in zip(weights, offsets, strict=True)]
        padded = F.array(*dots, *([F.lit(0.0)] * (width - len(dots))))
        each.append(F.struct(F.lit(name).alias("body"), padded.alias("actions"), F.array(*(F.lit(i < len(dots)) for i in range(width))).alias("valid")))
    return rows.select("*", F.explode(F.array(*each)).alias("_b")).select(*rows.columns, "_b.body", "_b.actions", "_b.valid")


def frozen_product(rows: DataFrame, choices: dict[str, Sequence[str]]) -> DataFrame:
    """Every row with every combination of the choices, numbered from 0 in their order, the last choice varying fastest."""
    n = math.prod(len(v) for v in choices.values())
    out = rows.withColumn("combination", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else rows.limit(0).withColumn("combination", F.lit(0))
    step = n
    for name, values in choices.items():
        step //= max(1, len(values))
        out = out.withColumn(name, F.get(F.array(*map(F.lit, values)), (F.floor(F.col("combination") / max(1, step)) % max(1, len(values))).cast("int")))
    return out
