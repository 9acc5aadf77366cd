"""Packed tracks: one packed mask for each frame of each instance; slices that start to count anew, and merges of instances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packed_bits(mask: Column) -> Column:
    """An array of booleans as bytes, eight to each, the first the lowest bit; null elements are not set."""
    size = F.size(mask)
    bit = lambda at, k: F.when(F.coalesce(F.get(mask, at * 8 + k), F.lit(False)), 1 << k).otherwise(0)
    byte = lambda at: F.lpad(F.hex(sum((bit(at, k) for k in range(8)), F.lit(0))), 2, "0")
    whole = F.transform(F.sequence(F.lit(0), F.ceil(size / 8).cast("int") - 1), byte)
    return F.when(size == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(whole, "")))


def slice_tracks(tracks: DataFrame, instance: str, frame: str, start: int, end: int) -> DataFrame:
    """The frames from ``start`` up to ``end`` (excluded) of every instance, counted from 0; ``parent_frame`` is the frame before.

    A range that is empty or begins below 0 raises, and so does reading an
    instance that lacks a frame of the range. Masks stay byte for byte.
    """
    if start < 0 or end <= start:
        raise ValueError("the range of frames is empty or negative")
    own = Window.partitionBy(instance)
    inside = (F.col(frame) >= start) & (F.col(frame) < end)
    seen = F.count(F.when(inside, 1)).over(own)
    whole = F.when(seen == end - start, F.col(frame)).otherwise(F.raise_error(F.concat(F.lit(f"the range to frame {end} exceeds an instance with "), F.count("*").over(own).cast("string"), F.lit(" frames"))).cast("int"))
    return tracks.withColumn("_whole", whole).filter(inside & F.col("_whole").isNotNull()).withColumn("parent_frame", F.col(frame)).withColumn(frame, F.col(frame) - start).drop("_whole")


def merge_tracks(parts: Sequence[tuple[DataFrame, Sequence[str]]], instance: str, frame: str, bits: str) -> DataFrame:
    """The named instances of several tracks as one track, with the ordinal of the track each is from.

    All instances need the same frames and the same number of bits; an instance
    that is in two parts, or twice in one, or in none although it is named,
    frames that differ and sizes that differ raise when the result is read.
    """
    rows = None
    for i, (track, names) in enumerate(parts):
        some = track.filter(F.col(instance).isin(list(names))).withColumn("part", F.lit(i))
        rows = some if rows is None else rows.unionByName(some)
    wanted = sum(len(names) for _, names in parts)
    facts = rows.groupBy(instance).agg(F.count("*").alias("_n"), F.count_distinct(frame).alias("_frames"), F.min(frame).alias("_low"), F.max(frame).alias("_high"), F.count_distinct("part").alias("_parts"), F.min(bits).alias("_least"), F.max(bits).alias("_most"))
    low_high = F.struct("_frames", "_low", "_high", "_least", "_most")
    whole = facts.agg(
        F.count("*").alias("_instances"), F.max((F.col("_n") != F.col("_frames")) | (F.col("_parts") > 1) | (F.col("_least") != F.col("_most")) | (F.col("_frames") != F.col("_high") - F.col("_low") + 1)).alias("_odd"), (F.min(low_high) != F.max(low_high)).alias("_unlike")
    )
    fault = F.when(F.col("_instances") != wanted, F.lit("an instance is missing or named twice")).when(F.col("_odd"), F.lit("an instance occurs twice, has gaps or masks of several sizes")).when(F.col("_unlike"), F.lit("frames or sizes of the instances differ"))
    checked = whole.select(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True).alias("_whole"))
    return rows.crossJoin(F.broadcast(checked)).filter("_whole").drop("_whole")  # one row
