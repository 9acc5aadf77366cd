"""Ranks over a whole table that no task has to hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources.folders import stored


def ranked(rows: DataFrame, order: Sequence[Column], rank: str = "rank", total: str = "total", bins: int | None = None) -> DataFrame:
    """``rows`` with their place from 1 in ``order`` and the number of all rows.

    Spark deals the rows into ranges of all of ``order``, so rows that are equal
    in the first of it only don't have to share a range, and they are stored
    once as they are dealt. Each range is ranked by itself and starts behind
    those before it; one count for each range is all that is broadcast. There
    are ``bins`` ranges, or as many as the session has shuffle partitions.
    Ascending, nulls come first and what isn't a number last. Rows that are
    equal in all of ``order`` go in any order.
    """
    dealt = rows.repartitionByRange(bins, *order) if bins else rows.repartitionByRange(*order)
    held = stored(dealt.withColumn("_bin", F.spark_partition_id()), "ranked")
    sizes = held.groupBy("_bin").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias(total))
    own = F.row_number().over(Window.partitionBy("_bin").orderBy(*order))
    found = held.withColumn(rank, own).join(F.broadcast(starts), "_bin")
    return found.select(*rows.columns, (F.col(rank) + F.col("_before")).alias(rank), total)
