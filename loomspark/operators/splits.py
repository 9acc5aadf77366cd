"""Splits that keep groups whole, and the checks that they did."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.scalar import hash_unit


def hash_split(key: Column, seed: int, validation: float, test: float) -> Column:
    """train, validation or test by the hash of seed and key; a group's rows share a key and so a split."""
    u = hash_unit(F.concat_ws(":", F.lit(str(seed)), key))
    return F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train")


def leaks(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that are in more than one split, with the splits."""
    found = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return found.filter(F.size("splits") > 1)


def leave_one_out(rows: DataFrame, group: str) -> DataFrame:
    """Sizes of the folds in which each group is the test set and all others are the training set."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("test_rows"))
    total = sizes.groupBy().agg(F.sum("test_rows").alias("_all"))
    return sizes.join(F.broadcast(total)).select(group, "test_rows", (F.col("_all") - F.col("test_rows")).alias("train_rows"))  # one row


def diversity(rows: DataFrame, split: str, columns: Sequence[str]) -> DataFrame:
    """Rows and distinct values of some columns in each split."""
    return rows.groupBy(split).agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(f"n_{c}") for c in columns))


def repeated_content(rows: DataFrame, content: Column, key: str, allowed: Column) -> DataFrame:
    """Contents that more than one row has though not all of those rows may share one: hash, keys and number."""
    hashed = rows.withColumn("content_sha256", F.sha2(content.cast("binary"), 256)).withColumn("_ok", F.coalesce(allowed, F.lit(False)))
    found = hashed.groupBy("content_sha256").agg(F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.bool_and("_ok").alias("_ok"))
    return found.filter((F.col("n") > 1) & ~F.col("_ok")).drop("_ok")


def cells_missing(rows: DataFrame, unit: str, kind: str, required: Sequence[str]) -> DataFrame:
    """Units that lack one of the required kinds or have one twice."""
    counts = rows.groupBy(unit).agg(*(F.count_if(F.col(kind) == k).alias(f"_{i}") for i, k in enumerate(required)))
    lacks = F.array_compact(F.array(*(F.when(F.col(f"_{i}") == 0, F.lit(k)) for i, k in enumerate(required))))
    twice = F.array_compact(F.array(*(F.when(F.col(f"_{i}") > 1, F.lit(k)) for i, k in enumerate(required))))
    return counts.select(unit, lacks.alias("missing"), twice.alias("repeated")).filter((F.size("missing") > 0) | (F.size("repeated") > 0))
