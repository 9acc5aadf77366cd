"""Resampling with counters: every draw is a hash of the seed, the round and its place, so it can be repeated anywhere.

Units of a group are numbered; draw ``j`` of round ``i`` takes the unit whose
number is the hash of (seed, i, j, group) modulo the group's units. Rounds and draws
are rows, so a group of any size is spread over all tasks and no sample is ever
in one place. Scales draw in the task that has the group's values if they are few.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from loomspark.functions import md5
from loomspark.operators.quantiles import quantiles
from loomspark.sources.folders import stored

#: The most values of a group whose resamples are drawn in the task that has them, and about how many draws it makes at once.
FEW, AT_ONCE = 1 << 16, 1 << 13


def _part(unit: str) -> Column:
    return F.coalesce(F.substring(F.md5(F.col(unit).cast("string").cast("binary")), 1, 2), F.lit("~"))


def dense_number(rows: DataFrame, keys: Sequence[str], unit: str, number: str = "number", total: str = "total") -> DataFrame:
    """``rows``, one for each unit of a group, with the unit's number from 0 and the group's units.

    Units are numbered in 256 parts by the first two digits of their name's MD5 and by name inside a
    part, and parts start behind those before them, so no task holds a group. Units without a name come last.
    """
    dealt = rows.withColumn("_part", _part(unit))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*keys)
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias(total))
    inner = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(unit)))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return inner.join(starts, same).select(*rows.columns, (F.col("_before") + F.col("_row") - 1).alias(number), total)


def draw(seed: int, turn: Column, place: Column, among: Column, *group: str) -> Column:
    """A number from 0 below ``among``: 52 bits of the MD5 of seed, round, place and the group's keys that aren't null, joined by colons."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), turn, place, *(F.col(k).cast("string") for k in group)).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), among)


def draws(units: DataFrame, keys: Sequence[str], unit: str, value: str, rounds: int, seed: int) -> DataFrame:
    """``keys``, round, _number and value: in every round as many draws as the group has units, with replacement.

    Units are dealt over all tasks before each is multiplied by the rounds; they
    are small, and Spark would else leave them to few tasks. A draw meets its
    unit's value by a hash of the units alone, so no task holds draws.
    """
    held = dense_number(units.select(*keys, unit, F.col(value).cast("double").alias("_value")), keys, unit, "_number", "_units")
    named = held.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_number"), "_value")
    dealt = held.select(*keys, "_number", "_units").repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_number")
    drawn = dealt.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    drawn = drawn.select(*keys, "round", draw(seed, F.col("round"), F.col("_number"), F.col("_units"), *keys).alias("_picked"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return drawn.join(named.hint("shuffle_hash"), same & (F.col("_picked") == F.col("_number"))).select(*keys, "round", "_number", F.col("_value").alias("value"))


def resampled(units: DataFrame, keys: Sequence[str], unit: str, value: str, rounds: int, seed: int) -> DataFrame:
    """``keys``, round, value and n: of every round as many values as the group has units, drawn with replacement and counted."""
    found = draws(units, keys, unit, value, rounds, seed).groupBy(*keys, "round", "_number").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    return found.select(*keys, "round", "value", "n")


def bootstrap_bounds(rows: DataFrame, keys: Sequence[str], unit: str, gain: str, rounds: int, confidence: float, seed: int) -> DataFrame:
    """Lower bound of the mean gain per group, by resampling its units.

    Gains of one unit are averaged first. Returns ``keys``, n (units), mean,
    lower (the nearest-rank lower bound of the resampled means), p (the share of
    those that aren't above 0, with one added to both counts) and above (the
    share of those above 0). A group of one unit has no bound, p or share. Null
    gains don't count, a unit without any other is none; null units are one unit.
    """
    if rounds < 1 or not 0 < confidence < 1:
        raise ValueError("there is a round at least, and the confidence is between 0 and 1")
    means = rows.withColumn("_unit", F.coalesce(F.col(unit).cast("string"), F.lit(""))).groupBy(*keys, "_unit").agg(F.avg(gain).alias("_gain")).filter("_gain IS NOT NULL")
    sums = draws(means, keys, "_unit", "_gain", rounds, seed).groupBy(*keys, "round").agg(F.avg("value").alias("_mean"))
    place = max(0, int((1 - confidence) * rounds) - 1)
    found = sums.groupBy(*keys).agg(
        F.element_at(F.array_sort(F.collect_list("_mean")), place + 1).alias("lower"),
        ((F.count_if(F.col("_mean") <= 0) + 1) / F.lit(rounds + 1)).alias("p"),
        (F.count_if(F.col("_mean") > 0) / F.lit(rounds)).alias("above"),
    )
    whole = means.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_gain").alias("mean"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        whole = whole.withColumnRenamed(k, f"_k{i}")
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    several = F.col("n") > 1
    return found.join(whole, same).select(*keys, "n", "mean", *(F.when(several, F.col(c)).alias(c) for c in ("lower", "p", "above")))


def _same(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return same


def _renamed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    for i, k in enumerate(keys):
        rows = rows.withColumnRenamed(k, f"_k{i}")
    return rows


def _medians(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact medians of groups of any size; what is no number counts as the largest value."""
    number = F.col(value).cast("double")
    odd = F.isnan(number)
    found = quantiles(rows.withColumn("_x", F.when(odd, F.lit(float("inf"))).otherwise(number)), keys, "_x", {name: 0.5})
    found = found.join(_renamed(rows.groupBy(*keys).agg(F.count_if(odd).alias("_odd")), keys), _same(keys))
    return found.select(*keys, F.when(F.ceil((F.col("n") - 1) / 2) >= F.col("n") - F.col("_odd"), F.lit(float("nan"))).otherwise(F.col(name)).alias(name))


def _middle(values: np.ndarray) -> np.ndarray:
    """The median of each row, what is no number counting as the largest value."""
    n = values.shape[1]
    low, high = (n - 1) // 2, n // 2
    values = np.partition(values, [low, high], axis=1)
    return values[:, low] * 0.5 + values[:, high] * 0.5


def _drawn_scale(names: np.ndarray, tails: pa.Array, values: np.ndarray, rounds: int, seed: int) -> tuple[float, float | None]:
    """The median of a group's values and the sample deviation of the medians of its resamples.

    Values are in the order of their numbers, stratum by stratum; ``tails`` is what follows a draw's place in its hash.
    """
    strata = tails.dictionary_encode()
    codes = strata.indices.to_numpy()
    sizes = np.bincount(codes)
    bodies = np.concatenate([np.strings.add(names[:n], tail.encode() + md5.END) for n, tail in zip(sizes, strata.dictionary.to_pylist(), strict=True)])
    among, before = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
    medians = []
    for turns in np.array_split(np.arange(rounds), -(-rounds * len(values) // max(AT_ONCE, len(values)))):
        heads = np.array([f"{seed}:{turn}:".encode() for turn in turns])
        bits = md5.first_bits(np.strings.add(heads[:, None], bodies).ravel()).reshape(len(turns), -1)
        medians.append(_middle(values[before + bits % among]))
    medians = np.concatenate(medians)
    with np.errstate(invalid="ignore"):
        return _middle(values[None])[0], np.std(medians - medians[0], ddof=1) if rounds > 1 else None


def resampled_scale(rows: DataFrame, keys: Sequence[str], stratum: str, unit: str, value: str, rounds: int, seed: int, few: int = FEW) -> DataFrame:
    """Median of a group and the sample deviation of medians over resamples inside every stratum, relative to it.

    ``unit`` tells the rows of a stratum apart; null values don't count. A median of 0 has no
    relative deviation. A group of up to ``few`` values is drawn in the task that has them, so its
    draws aren't moved. Those of a larger group are rows, stored once, and their medians are found
    by bins, so no task holds them.
    """
    if rounds < 1:
        raise ValueError("there is a round at least")
    some = rows.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, stratum, unit]), F.col(value).cast("double").alias("_value"))
    large = _renamed(some.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > few), keys)
    none = large.isEmpty()
    small = some if none else some.join(large, _same(keys), "left_anti")

    def scales(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.arange(few).astype(f"S{len(str(few))}")
        for batch in batches:
            tails, values = batch.column("_tails"), batch.column("_values")
            found = [_drawn_scale(names, tails[i].values, values[i].values.to_numpy(), rounds, seed) if len(values[i].values) else (None, None) for i in range(len(batch))]
            columns = [*batch.columns[: len(keys)], *(pa.array([f[j] for f in found], pa.float64()) for j in range(2))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "median", "_s"])

    # The tasks are as many as the session asks for: the values are small, and Spark would else leave them to few.
    dealt = small.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    tail = F.concat_ws(":", F.lit(""), *(F.col(k).cast("string") for k in [*keys, stratum]))
    held = dealt.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(tail.alias("tail"), _part(unit).alias("part"), F.col(unit).alias("unit"), F.col("_value").alias("value")))).alias("_r"))
    schema = StructType([*some.select(*keys).schema.fields]).add("median", DoubleType()).add("_s", DoubleType())
    found = held.select(*keys, F.col("_r.tail").alias("_tails"), F.col("_r.value").alias("_values")).mapInArrow(scales, schema)
    if not none:
        many = some.join(large, _same(keys), "left_semi")
        drawn = stored(draws(many, [*keys, stratum], unit, "_value", rounds, seed).select(*keys, "round", "value"), "draws")
        spread = _medians(drawn, [*keys, "round"], "value", "_m").groupBy(*keys).agg(F.stddev_samp("_m").alias("_s"))
        found = found.unionByName(_medians(many, keys, "_value", "median").join(_renamed(spread, keys), _same(keys)).select(*keys, "median", "_s"))
    return found.select(*keys, "median", F.when(F.col("median") != 0, F.col("_s") / F.col("median")).alias("relative"))


def decide_promotion(
    incumbent: DataFrame, challenger: DataFrame, keys: Sequence[str], *, group: str = "group", candidate: str = "candidate", quality: str = "quality", cost: str = "cost", eligible: str = "eligible",
    least_groups: int = 2, most_regression: float = 0.0, least_probability: float = 0.95, most_dearer: float = 0.1, rounds: int = 2000, seed: int = 0,
) -> DataFrame:
    """Whether a challenger takes an incumbent's place, per ``keys``, with every reason against it.

    Both have one row for each independent group. It is promoted if there are
    ``least_groups``, all its groups are eligible (null isn't), none is worse by
    more than ``most_regression``, the resampled mean of its gains is above 0
    with ``least_probability``, and its mean cost exceeds the incumbent's by no
    more than the share ``most_dearer``. Reasons are, in this order,
    insufficient_independent_groups (then alone, and nothing else is judged),
    physical_or_adversarial_gate_failed, quality_regression,
    improvement_not_statistically_supported, cost_regression.

    A group that occurs twice on a side or only on one, several candidates among
    the challengers, and null qualities or costs break the contract and raise
    when the result is read.
    """
    side = lambda df, i: df.select(*keys, F.col(group).cast("string").alias("_group"), F.struct(F.col(quality).cast("double").alias("quality"), F.col(cost).cast("double").alias("cost"), F.col(candidate).alias("candidate"), F.coalesce(F.col(eligible), F.lit(False)).alias("eligible") if i else F.lit(True).alias("eligible")).alias("_side"), F.lit(i).alias("_i"))
    one = lambda i, f: F.max(F.when(F.col("_i") == i, F.col(f"_side.{f}")))
    groups = side(incumbent, 0).unionByName(side(challenger, 1)).groupBy(*keys, "_group").agg(
        F.count_if(F.col("_i") == 0).alias("_old"), F.count_if(F.col("_i") == 1).alias("_new"), F.count_if(F.col("_side.quality").isNull() | F.col("_side.cost").isNull()).alias("_lacking"),
        one(0, "quality").alias("_q0"), one(1, "quality").alias("_q1"), one(0, "cost").alias("_c0"), one(1, "cost").alias("_c1"), one(1, "candidate").alias("_candidate"), F.min(F.col("_side.eligible")).alias("_eligible"),
    )
    groups = groups.withColumn("_gain", F.col("_q1") - F.col("_q0"))
    broken = (F.max("_old") > 1) | (F.max("_new") > 1) | (F.min("_old") < 1) | (F.min("_new") < 1) | (F.max("_lacking") > 0) | (F.min("_candidate") != F.max("_candidate"))
    whole = groups.groupBy(*keys).agg(
        F.count("*").alias("groups"), broken.alias("_broken"), F.max("_candidate").alias("_candidate"), F.min("_eligible").alias("all_eligible"), (F.min("_gain") >= -most_regression).alias("no_regression"),
        F.avg("_q0").alias("incumbent_quality"), F.avg("_q1").alias("challenger_quality"), F.avg("_c0").alias("incumbent_cost"), F.avg("_c1").alias("challenger_cost"),
    )
    bounds = bootstrap_bounds(groups, keys, "_group", "_gain", rounds, 0.95, seed)
    same = F.lit(True)
    for i, k in enumerate(keys):
        bounds = bounds.withColumnRenamed(k, f"_k{i}")
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    found = whole.join(bounds.drop("n", "mean", "lower", "p"), same, "left")
    # One group has no bound, but its only resample is itself.
    found = found.withColumn("probability", F.coalesce("above", (F.col("challenger_quality") > F.col("incumbent_quality")).cast("double")))
    found = found.withColumn("cheap", F.col("challenger_cost") <= F.col("incumbent_cost") * (1 + most_dearer))
    few = F.col("groups") < least_groups
    against = F.array_compact(F.array(
        F.when(~F.col("all_eligible"), F.lit("physical_or_adversarial_gate_failed")), F.when(~F.col("no_regression"), F.lit("quality_regression")),
        F.when(F.col("probability") < least_probability, F.lit("improvement_not_statistically_supported")), F.when(~F.col("cheap"), F.lit("cost_regression")),
    ))
    reasons = F.when(F.col("_broken"), F.raise_error(F.lit("groups must be unique, the same on both sides, complete and of one challenger")).cast("array<string>"))
    found = found.withColumn("reasons", reasons.when(few, F.array(F.lit("insufficient_independent_groups"))).otherwise(against))
    promoted = F.size("reasons") == 0
    judged = ["all_eligible", "no_regression", "probability", "incumbent_quality", "challenger_quality", "incumbent_cost", "challenger_cost", "cheap"]
    return found.select(*keys, "groups", promoted.alias("promoted"), F.when(promoted, F.col("_candidate")).alias("selected"), "reasons", *(F.when(~few, F.col(c)).alias(c) for c in judged))


def compare_models(
    records: DataFrame, candidate: str, directions: dict[str, bool], *, model: str = "model", trial: str = "trial", unit: str = "unit", seed_column: str = "seed", metric: str = "metric", value: str = "value",
    least_units: int = 20, rounds: int = 5000, confidence: float = 0.95, seed: int = 0,
) -> DataFrame:
    """The candidate against every other model in every metric of ``directions`` (True: higher is better).

    Values are averaged over the seeds of a trial, then over the trials of an
    independent unit, and units are paired. Returns baseline, metric, higher, n
    (paired units), raw_trials, mean and lower of the oriented gain, p, positive
    (the lower bound is above 0), eligible (``least_units`` units), all_positive
    (over the metrics of a baseline) and passed (eligible and all positive).

    A model that lacks a unit that the candidate has in a metric, or has another,
    a trial without all the seeds that its model has elsewhere, a trial in two
    units, and null values raise when the result is read; a baseline without any
    record of a metric has no row for it.
    """
    wanted = F.create_map(*(F.lit(x) for pair in directions.items() for x in pair))
    rows = records.select(F.col(model).alias("_model"), F.col(trial).cast("string").alias("_trial"), F.col(unit).cast("string").alias("_unit"), F.col(seed_column).alias("_seed"), F.col(metric).alias("_metric"), F.col(value).cast("double").alias("_value"))
    rows = rows.filter(F.col("_metric").isin(list(directions)))
    trials = rows.groupBy("_model", "_metric", "_trial").agg(F.avg("_value").alias("_value"), F.min("_unit").alias("_unit"), F.array_sort(F.collect_set("_seed")).alias("_seeds"), ((F.min("_unit") != F.max("_unit")) | (F.count("_value") < F.count("*"))).alias("_odd"))
    units = trials.groupBy("_model", "_metric", "_unit").agg(F.avg("_value").alias("_value"), F.count("*").alias("_trials"), F.max("_odd").alias("_odd"), F.min("_seeds").alias("_least"), F.max("_seeds").alias("_most"))
    seeds = units.groupBy("_model").agg((F.max("_odd") | (F.min("_least") != F.max("_most"))).alias("_odd"))
    own = units.filter(F.col("_model") == candidate).select("_metric", "_unit", F.col("_value").alias("_own"), F.col("_trials").alias("_own_trials"))
    baselines = units.filter(F.col("_model") != candidate).select("_model", "_metric").distinct()
    expected = baselines.join(own, "_metric").select("_model", "_metric", "_unit", "_own", "_own_trials")
    paired = expected.join(units.filter(F.col("_model") != candidate).drop("_odd"), ["_model", "_metric", "_unit"], "full")
    sign = F.when(wanted[F.col("_metric")], 1.0).otherwise(-1.0)
    paired = paired.withColumn("_gain", sign * (F.col("_own") - F.col("_value")))
    counted = paired.groupBy("_model", "_metric").agg(F.sum("_own_trials").alias("raw_trials"), F.max(F.col("_own").isNull() | F.col("_value").isNull()).alias("_unpaired"))
    bounds = bootstrap_bounds(paired, ["_model", "_metric"], "_unit", "_gain", rounds, confidence, seed)
    odd = seeds.filter("_odd").agg(F.count("*").alias("_broken"))
    found = bounds.join(counted, ["_model", "_metric"]).crossJoin(F.broadcast(odd))  # one row
    whole = F.when((F.col("_broken") > 0) | F.col("_unpaired"), F.raise_error(F.lit("units, trials and seeds of the models must match, without nulls")).cast("long")).otherwise(F.col("n"))
    found = found.withColumn("n", whole).withColumn("positive", F.coalesce(F.col("lower") > 0, F.lit(False))).withColumn("eligible", F.col("n") >= least_units)
    every = F.min("positive").over(Window.partitionBy("_model"))
    found = found.withColumn("all_positive", every).withColumn("passed", F.min("eligible").over(Window.partitionBy("_model")) & F.col("all_positive"))
    return found.select(F.col("_model").alias("baseline"), F.col("_metric").alias("metric"), wanted[F.col("_metric")].alias("higher"), "n", "raw_trials", "mean", "lower", "p", "positive", "eligible", "all_positive", "passed")
