"""Grouped statistics: means in levels, step-down tests, robust limits, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.quantiles import quantiles
from loomspark.operators.ranking import ranked


def mean_in_levels(rows: DataFrame, levels: Sequence[Sequence[str]], value: str, name: str = "mean") -> DataFrame:
    """A mean of means: the value is averaged per first level, these per second, and so on. Not a flat mean."""
    out = rows
    for keys in levels:
        out = out.groupBy(*keys).agg(F.avg(value).alias("_mean")).withColumnRenamed("_mean", value)
    return out.withColumnRenamed(value, name)


def vector_stats(rows: DataFrame, vector: str, percentiles: Sequence[float] = (0.01, 0.99)) -> DataFrame:
    """Per dimension (from 0): count, min, max, mean, population deviation and linear percentiles."""
    long = rows.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    sums = long.groupBy("dim").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    ranks = quantiles(long, ["dim"], "x", {f"p{round(100 * p):02d}": p for p in percentiles})
    return sums.join(ranks.drop("n"), "dim", "left")


def nearest_rank(value: str, share: float) -> Column:
    """The smallest value that this share of all values doesn't exceed."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def counts_over_domain(rows: DataFrame, column: str, domain: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per value of the domain with its number, 0 where there is none."""
    counted = rows.groupBy(*keys).agg(*(F.count_if(F.col(column) == v).alias(f"_{i}") for i, v in enumerate(domain)))
    pairs = F.array(*(F.struct(F.lit(v).alias(column), F.col(f"_{i}").alias("n")) for i, v in enumerate(domain)))
    return counted.select(*keys, F.explode(pairs).alias("p")).select(*keys, f"p.{column}", "p.n")


def holm(rows: DataFrame, name: str, p: str, alpha: float, keys: Sequence[str] = ()) -> DataFrame:
    """Holm's step-down test: thresholds alpha / (m - rank + 1), and nothing is rejected after the first that isn't.

    A null p counts in m, ranks first and isn't tested. Without keys the whole table is ranked bin by bin, and one row tells where rejection ends.
    """
    limit = F.lit(alpha) / (F.col("m") - F.col("rank") + 1)
    if not keys:
        tested = ranked(rows, [F.col(p), F.col(name)], "rank", "m").withColumn("threshold", limit)
        end = tested.filter(F.col(p) > F.col("threshold")).agg(F.min("rank").alias("_end"))
        return tested.crossJoin(F.broadcast(end)).withColumn("rejected", F.when(F.col(p).isNotNull(), F.coalesce(F.col("rank") < F.col("_end"), F.lit(True)))).drop("_end")
    own = Window.partitionBy(*keys)
    order = own.orderBy(p, name)
    tested = rows.withColumn("rank", F.row_number().over(order)).withColumn("m", F.count("*").over(own)).withColumn("threshold", limit)
    tested = tested.withColumn("_ok", (F.col(p) <= F.col("threshold")).cast("int"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tested.withColumn("rejected", F.min("_ok").over(upto) == 1).drop("_ok")


def robust_limits(rows: DataFrame, keys: Sequence[str], value: str, factor: float, least_margin: float) -> DataFrame:
    """Median, median absolute deviation and the limits median -/+ max(least_margin, factor * mad)."""
    middle = quantiles(rows, keys, value, {"median": 0.5}).drop("n")
    gaps = rows.join(middle, list(keys)).withColumn("_gap", F.abs(F.col(value) - F.col("median")))
    found = quantiles(gaps, [*keys, "median"], "_gap", {"mad": 0.5}).drop("n")
    margin = F.greatest(F.lit(float(least_margin)), F.lit(float(factor)) * F.col("mad"))
    return found.withColumn("low", F.col("median") - margin).withColumn("high", F.col("median") + margin)


def six_numbers(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median, 10th and 90th percentile, least and largest of each group."""
    sums = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    ranks = quantiles(rows, keys, value, {"median": 0.5, "p10": 0.1, "p90": 0.9}).drop("n")
    return sums.join(ranks, list(keys), "left").select(*keys, "mean", "median", "p10", "p90", "min", "max")


def surprisal(rows: DataFrame, keys: Sequence[str], bin_column: str, pseudocount: float, bins: int) -> DataFrame:
    """Mean of -ln p over the rows of each group, p being the share of the row's bin among all rows, with a pseudocount."""
    total = rows.groupBy().agg(F.count("*").alias("_all"))
    shares = rows.groupBy(bin_column).agg(F.count("*").alias("_n")).join(F.broadcast(total))  # one row
    shares = shares.withColumn("p", (F.col("_n") + pseudocount) / (F.col("_all") + F.lit(pseudocount * bins)))
    return rows.join(shares, bin_column).groupBy(*keys).agg(F.avg(-F.log("p")).alias("surprisal"), F.count("*").alias("n"))


def agreement(rows: DataFrame, key: str, rater: str, fields: Sequence[str], raters: int) -> DataFrame:
    """Items that all raters have seen, with whether they agree in each field and whether any needs review."""
    found = rows.groupBy(key).agg(
        F.count_distinct(rater).alias("_raters"), *((F.count_distinct(F.coalesce(f, F.lit("?"))) == 1).alias(f"{f}_agrees") for f in fields)
    )
    agrees = F.lit(True)
    for f in fields:
        agrees = agrees & F.col(f"{f}_agrees")
    return found.filter(F.col("_raters") == raters).drop("_raters").withColumn("needs_review", ~agrees)


def promotion_matrix(bounds: DataFrame, required: DataFrame, keys: Sequence[str], least_n: int, least_mean: float) -> DataFrame:
    """Required cells with whether each has enough units, a large enough mean and a lower bound above 0; missing cells fail."""
    joined = required.join(bounds, list(keys), "left")
    ok = (F.col("n") >= least_n) & (F.col("mean") >= least_mean) & (F.col("lower") > 0)
    return joined.withColumn("passed", F.coalesce(ok, F.lit(False)))
