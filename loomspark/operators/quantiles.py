"""Exact quantiles of groups of any size: only the histogram bin that holds a wanted rank is looked into.

The first histogram of a group has bins of equal ratio, sixteen to an octave
on either side of zero, so it suits values of all sizes. A bin is a count, a
least and a largest value. What a rank needs further is the bin that holds it;
that is cut into ``BINS`` parts of equal width, the part that holds the rank is
cut again, and so on until it is one value or has ``FEW`` values, which are
sorted. No round holds more than a histogram for each group, and each reads
only values of the bins before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources.folders import stored

BINS, FEW = 4096, 4096


def _coarse(x: Column) -> Column:
    """The number of the bin of equal ratio that ``x`` falls into; it never falls where ``x`` rises."""
    size = F.log2(F.abs(x)) + 1100
    return F.floor(F.when(x == 0, 0.0).otherwise(F.signum(x) * F.least(F.greatest(size, F.lit(1.0)), F.lit(3000.0))) * 16)


def _same(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return same


def _picked(bins: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of each rank the bin that holds it; the rank goes on counting inside that bin."""
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_rank").orderBy(order))
    held = bins.withColumn("_upto", upto).filter((F.col("_inner") < F.col("_upto")) & (F.col("_inner") >= F.col("_upto") - F.col("_n")))
    return held.select(*keys, "_rank", (F.col("_inner") - F.col("_upto") + F.col("_n")).alias("_inner"), "_n", "_low", "_high")


def values_at(ranks: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, histogram: DataFrame) -> DataFrame:
    """``keys``, _rank and x: the value at each rank (from 0) of ``ranks``."""
    found = stored(_picked(ranks.withColumn("_inner", F.col("_rank")).join(histogram.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_bin", "_n", "_low", "_high"), _same(keys)), keys, "_bin"), "ranks")
    numbers = rows.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL AND NOT isnan(_x)")
    many = (F.col("_n") > FEW) & (F.col("_low") < F.col("_high"))
    while not found.filter(many).isEmpty():
        inside = _inside(numbers, found.filter(many), keys)
        part = F.least(F.floor((F.col("_x") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * BINS), F.lit(BINS - 1))
        bins = inside.groupBy(*keys, "_rank", "_inner", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        found = stored(_picked(bins, keys, "_part").unionByName(found.filter(~many)), "ranks")
    one = found.filter("_low = _high").select(*keys, "_rank", F.col("_low").alias("x"))
    few = _inside(numbers, found.filter("_low < _high"), keys).groupBy(*keys, "_rank", "_inner").agg(F.array_sort(F.collect_list("_x")).alias("_all"))
    return one.unionByName(few.select(*keys, "_rank", F.get("_all", F.col("_inner").cast("int")).alias("x")))


def _inside(numbers: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values of the bins that are looked into, once for each rank."""
    bins = found.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_rank", "_inner", "_low", "_high")
    return numbers.join(bins, _same(keys) & F.col("_x").between(F.col("_low"), F.col("_high")))


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], nearest: Mapping[str, float] | None = None) -> DataFrame:
    """Exact quantiles of each group, one column for each of ``shares`` (interpolated) and of ``nearest`` (by nearest rank).

    A share p stands for the place p (n - 1) between sorted values, or for the
    least value that p of all values don't exceed. Returns ``keys``, n and the
    columns. Nulls and what is no number don't count; a group without any other
    value has no row. Infinite values count as such.
    """
    nearest = nearest or {}
    if not all(0 <= p <= 1 for p in [*shares.values(), *nearest.values()]):
        raise ValueError("a share is from 0 to 1")
    numbers = rows.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL AND NOT isnan(_x)")
    bins = numbers.groupBy(*keys, _coarse(F.col("_x")).alias("_bin")).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    histogram = stored(bins, "histogram")
    sizes = histogram.groupBy(*keys).agg(F.sum("_n").alias("n")).filter("n > 0")
    low = {name: F.floor(F.lit(p) * (F.col("n") - 1)) for name, p in shares.items()}
    high = {name: F.ceil(F.lit(p) * (F.col("n") - 1)) for name, p in shares.items()}
    rank = {name: F.greatest(F.ceil(F.lit(p) * F.col("n")) - 1, F.lit(0)) for name, p in nearest.items()}
    wanted = F.array_distinct(F.array(*low.values(), *high.values(), *rank.values()))
    ranks = sizes.select(*keys, F.explode(wanted).alias("_rank")).withColumn("_rank", F.col("_rank").cast("long"))
    found = values_at(ranks, rows, keys, value, histogram)
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "x"))).alias("_x"))
    joined = sizes.join(by_rank.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_x"), _same(keys))
    at = lambda place: F.col("_x")[place.cast("long")]
    columns = []
    for name, p in shares.items():
        part = F.lit(p) * (F.col("n") - 1) - low[name]
        columns.append(F.when(part == 0, at(low[name])).otherwise(at(low[name]) * (1 - part) + at(high[name]) * part).alias(name))
    columns += [at(place).alias(name) for name, place in rank.items()]
    return joined.select(*keys, "n", *columns)
