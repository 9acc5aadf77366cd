"""Robust lines of all groups at once, in rounds: weights, sums and a median for each group, until a group settles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.quantiles import quantiles
from loomspark.sources.folders import stored

#: Points of a group whose median may be taken from its different values in memory; larger ones go by refined bins.
SMALL = 1_000_000


def _same(keys: Sequence[str], prefix: str) -> Column:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return same


def _named(rows: DataFrame, keys: Sequence[str], prefix: str, *more: Column | str) -> DataFrame:
    return rows.select(*(F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)), *more)


def huber_line(rows: DataFrame, keys: Sequence[str], x: str, y: str, delta: float = 1.345, most_rounds: int = 20) -> DataFrame:
    """``keys``, slope, intercept and n: a line for each group by reweighted least squares with Huber weights.

    The first line has equal weights. A round weighs each point by its distance
    to the line before, measured by 1.4826 times the median distance, and fits
    again; a group is done when its slope moves by less than 1e-10, or after
    ``most_rounds`` fits. Points with a null don't count. A group whose points
    have fewer than two different x has nulls, one without points no row.

    A round is one job over the points of the groups that are left; what is kept
    between is a row for each group.
    """
    points = stored(rows.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"]), "points")
    whole = points.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), (F.min("_x") < F.max("_x")).alias("_fits"))
    slope = F.try_divide(F.covar_pop("_x", "_y"), F.var_pop("_x"))
    first = points.groupBy(*keys).agg(slope.alias("slope"))
    held = whole.join(_named(first, keys, "_f", "slope"), _same(keys, "_f")).select(*keys, "n", "_mx", "_my", F.when(F.col("_fits"), F.col("slope")).alias("slope"), (~F.col("_fits")).alias("_done"))
    held = held.withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    held = stored(held, "lines")
    largest = held.agg(F.max("n")).first()[0] or 0
    for _ in range(most_rounds - 1):
        left = held.filter("NOT _done")
        if left.isEmpty():
            break
        line = _named(left, keys, "_l", "slope", "intercept", "_mx", "_my")
        gaps = points.join(line, _same(keys, "_l")).withColumn("_gap", F.abs(F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x")))
        medians = gaps.groupBy(*keys).agg(F.percentile("_gap", F.lit(0.5)).alias("_median")) if largest <= SMALL else quantiles(gaps, keys, "_gap", {"_median": 0.5})
        scale = F.greatest(1.4826 * F.col("_median"), F.lit(1e-9))
        weight = F.least(F.lit(1.0), delta * scale / F.greatest("_gap", F.lit(1e-12)))
        weighed = gaps.join(_named(medians, keys, "_g", "_median"), _same(keys, "_g")).withColumn("_w", weight)
        u, v, w = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my"), F.col("_w")  # near their means, so that sums of products stay exact
        sums = weighed.groupBy(*keys).agg(F.sum(w).alias("_s"), F.sum(w * u).alias("_su"), F.sum(w * v).alias("_sv"), F.sum(w * u * u).alias("_suu"), F.sum(w * u * v).alias("_suv"))
        new = (F.col("_suv") - F.col("_su") * F.col("_sv") / F.col("_s")) / (F.col("_suu") - F.col("_su") * F.col("_su") / F.col("_s"))
        moved = _named(sums.withColumn("_new", new), keys, "_n", "_new", (F.col("_sv") / F.col("_s")).alias("_cv"), (F.col("_su") / F.col("_s")).alias("_cu"))
        fitted = left.join(moved, _same(keys, "_n")).select(
            *keys, "n", "_mx", "_my", F.col("_new").alias("slope"), (F.abs(F.col("_new") - F.col("slope")) < 1e-10).alias("_done"), (F.col("_my") + F.col("_cv") - F.col("_new") * (F.col("_mx") + F.col("_cu"))).alias("intercept")
        )
        held = stored(fitted.unionByName(held.filter("_done")), "lines")
    return held.select(*keys, "slope", "intercept", "n")
