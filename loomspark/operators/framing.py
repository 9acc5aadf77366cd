"""Fixed windows over frame numbers: five rules for the tail, shards, and evenly spaced choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.ranking import ranked

RULES = ("terminal", "clamped", "short_tail", "merge_last_two", "drop_short")


def _array_of(step: int, last: Column) -> Column:
    """0, step, 2 step and so on up to ``last``; none if that is negative."""
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long")))


def hopping(rows: DataFrame, length: str, window: int, overlap: int, rule: str) -> DataFrame:
    """One row per window of each entity: ``start``, ``frames`` (how many of them exist) and ``window_no``.

    terminal: a last window is added that ends with the entity; shorter
    entities have none. clamped: like that, and a shorter entity has one.
    short_tail: the last window is cut off. merge_last_two: from the place
    where the step after next would overshoot, the last full window follows;
    a shorter entity has one. drop_short: windows with fewer than two frames
    are left out.
    """
    if rule not in RULES or not 0 <= overlap < window:
        raise ValueError(f"no rule {rule} for windows of {window} with an overlap of {overlap}")
    step, n = window - overlap, F.col(length).cast("long")
    final = n - window
    if rule in ("terminal", "clamped"):
        full = _array_of(step, final)
        starts = F.when(final < 0, F.array(F.lit(0).cast("long")) if rule == "clamped" else full).otherwise(F.array_union(full, F.array(final)))
        starts = F.when(n <= 0, F.array().cast("array<bigint>")).otherwise(starts)
    elif rule == "short_tail":
        reached = F.filter(_array_of(step, n - 1), lambda s: (s == 0) | (s + overlap < n))
        starts = reached
    elif rule == "merge_last_two":
        some = F.filter(_array_of(step, n - 1), lambda s: (s == 0) | (s + step <= final))
        starts = F.when(n <= 0, some).when(final <= 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_union(some, F.array(final)))
    else:
        starts = F.filter(_array_of(step, n - 2), lambda s: n - s >= 2)
    return (
        rows.withColumn("_starts", F.array_sort(starts))
        .select(*rows.columns, F.posexplode("_starts").alias("window_no", "start"))
        .withColumn("frames", F.least(F.lit(window).cast("long"), n - F.col("start")))
    )


def padded_model_length(frames: Column, block: int = 17, extra: int = 5) -> Column:
    """The least ``block * k + extra`` that holds so many frames."""
    return F.ceil(F.greatest(frames - extra, F.lit(0)) / block) * block + extra


def windows_with_phases(windows: DataFrame, phases: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Each window (start, frames) with the labels of all phases (start, end) that it overlaps, in order of their starts."""
    p = phases.select(*keys, F.col("start").alias("_from"), F.col("end").alias("_to"), label)
    meet = (F.col("_from") < F.col("start") + F.col("frames")) & (F.col("_to") > F.col("start"))
    joined = windows.join(p, list(keys)).filter(meet)
    found = joined.groupBy(*keys, "window_no", "start", "frames").agg(F.array_sort(F.collect_list(F.struct("_from", label))).alias("_p"))
    return found.withColumn("phases", F.transform("_p", lambda x: x[label])).drop("_p")


def contiguous_shards(rows: DataFrame, order: Sequence[Column], shards: int, keys: Sequence[str] = ()) -> DataFrame:
    """Cuts the ordered rows into shards of equal size, the first ones with one row more.

    Without keys the whole table is ranked bin by bin, by the first of ``order``, a number or a time.
    """
    if keys:
        return rows.withColumn("shard", F.ntile(shards).over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    found = ranked(rows, order, "_rank", "_total").withColumn("_i", F.col("_rank") - 1)
    size, more = F.expr(f"_total DIV {shards}"), F.col("_total") % shards
    wide = more * (size + 1)
    shard = F.when(F.col("_i") < wide, F.floor(F.col("_i") / (size + 1))).otherwise(more + F.floor((F.col("_i") - wide) / F.greatest(size, F.lit(1))))
    return found.select(*rows.columns, shard.cast("int").alias("shard"))


def shard_plan(total: Column, shards: int, start: Column | None = None) -> Column:
    """An array of (shard, start, count): the first ``total % shards`` shards have one more."""
    first = start if start is not None else F.lit(0)
    size, more = F.floor(total / shards).cast("long"), (total % shards).cast("long")
    return F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda k: F.struct(
            k.alias("shard"),
            (first + k * size + F.least(k.cast("long"), more)).cast("long").alias("start"),
            (size + F.when(k < more, 1).otherwise(0)).cast("long").alias("count"),
        ),
    )


def byte_ranges(size: Column, connections: int) -> Column:
    """Closed ranges that cover [0, size) in at most so many steps of one span."""
    span = F.greatest(F.ceil(size / connections), F.lit(1)).cast("long")
    return F.transform(_array_range(size, span), lambda s: F.struct(s.alias("first"), F.least(s + span - 1, size.cast("long") - 1).alias("last")))


def _array_range(size: Column, span: Column) -> Column:
    return F.when(size <= 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("long"), size.cast("long") - 1, span))


def evenly_spaced(n: Column, k: int) -> Column:
    """``k`` ranks out of n, ends included, halves rounded to even; one of them is the middle; no rank twice."""
    if k == 1:
        return F.array(F.floor(n / 2).cast("long"))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / F.lit(k - 1)).cast("long")))
