"""Joins with contracts: lineage, foreign keys, donors, ranges, ordinals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_lineage(rows: DataFrame, lineage: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Rows with the lineage's columns, which replace columns of their names.

    ``has_lineage`` is false where no lineage row has the key; with ``strict``
    such a row fails the query that reads it.
    """
    added = [c for c in lineage.columns if c not in keys]
    kept = rows.drop(*added)
    joined = kept.join(lineage.withColumn("has_lineage", F.lit(True)), list(keys), "left")
    found = F.coalesce("has_lineage", F.lit(False))
    if strict:
        found = F.when(found, found).otherwise(F.raise_error("a row has no lineage").cast("boolean"))
    return joined.withColumn("has_lineage", found)


def unreferenced(parents: DataFrame, key: str, *references: tuple[DataFrame, str]) -> DataFrame:
    """Parents that no reference names."""
    out = parents
    for child, column in references:
        out = out.join(child.select(F.col(column).alias(key)).distinct(), key, "left_anti")
    return out


def foreign_key_report(rows: DataFrame, parents: DataFrame, key: str, parent_key: str, kind: Column) -> DataFrame:
    """Each row's state: ok, missing (no such parent) or wrong_kind (the parent isn't of the kind)."""
    p = parents.select(F.col(parent_key).alias("_key"), F.coalesce(kind, F.lit(False)).alias("_kind"))
    joined = rows.join(p, rows[key] == p["_key"], "left")
    state = F.when(F.col("_key").isNull(), "missing").when(~F.col("_kind"), "wrong_kind").otherwise("ok")
    return joined.withColumn("state", state).drop("_key", "_kind")


def next_of_another_group(rows: DataFrame, keys: Sequence[str], order: str, group: str, name: str = "donor") -> DataFrame:
    """Each row with the next row, cyclically in order, that is of another group; null if all are of one group.

    Rows in order fall into runs of one group. The next row of another group is
    the first of the next run, and after the last run the first row of all
    unless that is of the same group, in which case the first of the second
    run. Windows do it, no row meets another, and each of them passes over a
    key's rows once: the next run is looked for from the last run backwards, as
    Spark reads a frame that ends with the rows once for each row.
    """
    own = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(group).eqNullSafe(F.lag(group).over(own)) & F.lag(F.lit(1)).over(own).isNotNull(), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(own))
    head = F.when(F.col("_new") == 1, F.struct(F.col(order).alias("o"), F.col(group).alias("g")))
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_run")).rangeBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    firsts = runs.withColumn("_head", head).withColumn("_next", F.last("_head", ignorenulls=True).over(ahead))
    firsts = firsts.withColumn("_one", F.min(F.when(F.col("_run") == 1, F.col("_head"))).over(whole)).withColumn(
        "_two", F.min(F.when(F.col("_run") == 2, F.col("_head"))).over(whole)
    )
    wrapped = F.when(~F.col("_one.g").eqNullSafe(F.col(group)), F.col("_one.o")).otherwise(F.col("_two.o"))
    donor = F.when(F.col("_next").isNotNull(), F.col("_next.o")).otherwise(wrapped)
    return firsts.withColumn(name, donor).drop("_new", "_run", "_head", "_next", "_one", "_two")


def range_join(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Rows with each range of their entity that holds their place, ends included.

    Ranges are dealt into buckets of ``width`` places, so the join is one of
    equal buckets, and a long range is in several.
    """
    dealt = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    own = rows.withColumn("_bucket", F.floor(F.col(at) / width))
    return own.join(dealt, [*keys, "_bucket"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def paired_by_ordinal(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """Two sequences side by side by position, null where one is shorter; ``same`` is whether all fields agree."""
    own = Window.partitionBy(*keys).orderBy(order)
    a = left.withColumn("i", F.row_number().over(own) - 1).select(*keys, "i", *(F.col(f).alias(f"left_{f}") for f in fields))
    b = right.withColumn("i", F.row_number().over(own) - 1).select(*keys, "i", *(F.col(f).alias(f"right_{f}") for f in fields))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"left_{f}").eqNullSafe(F.col(f"right_{f}"))
    return a.join(b, [*keys, "i"], "full").withColumn("same", same)


def takeover(rows: DataFrame, keys: Sequence[str], order: str, start: str, end: str) -> DataFrame:
    """The places in which a route may hand over: from its start to before the next one's start and right after the end before."""
    own = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("lower", F.col(start)).withColumn(
        "upper", F.least(F.col(end), F.lead(start).over(own) - 1, F.lag(end).over(own) + 1)
    )
