"""Merging of overlapping series at seams: a left one, an anchor of which a stable core has to stay, and a right one."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(keys: Sequence[str], prefix: str) -> Column:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return same


def _named(rows: DataFrame, keys: Sequence[str], prefix: str, *more: Column) -> DataFrame:
    return rows.select(*(F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)), *more)


def seam_costs(current: DataFrame, following: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """``keys``, ``at`` and cost of every seam between two overlapping series: the step from the value before it to the one that follows there.

    Seams are the places of the overlap but for its first.
    """
    other = _named(following, keys, "_f", F.col(at).alias("_fat"), F.col(value).alias("_fvalue"))
    both = current.join(other, _same(keys, "_f") & (F.col(at) == F.col("_fat")))
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(at))
    return both.select(*keys, at, F.abs(before - F.col("_fvalue")).alias("cost")).filter("cost IS NOT NULL")


def anchored_seams(entries: DataFrame, exits: DataFrame, keys: Sequence[str], at: str, cost: str, least: int, blend: int = 0) -> DataFrame:
    """Where to enter an anchor and where to leave it again, so that ``least`` of its places stay untouched.

    The entry is the cheapest of ``entries``; the exit the cheapest of those of
    ``exits`` that lie ``least`` + 2 ``blend`` or more behind it; earlier places
    win ties. Returns ``keys``, entry, entry_cost, exit, exit_cost, retained_start,
    retained_end (excluded) and retained. Where no exit is left the last five are
    null; a case without entries has no row.
    """
    if least < 1 or blend < 0:
        raise ValueError("least is positive, blend isn't negative")
    best = lambda name: F.min(F.struct(F.col(cost).alias("cost"), F.col(at).alias("at"))).alias(name)
    first = entries.groupBy(*keys).agg(best("_in"))
    later = exits.join(_named(first, keys, "_e", F.col("_in.at").alias("_entry")), _same(keys, "_e")).filter(F.col(at) >= F.col("_entry") + least + 2 * blend)
    last = _named(later.groupBy(*keys).agg(best("_out")), keys, "_k", F.col("_out"))
    found = first.join(last, _same(keys, "_k"), "left")
    start, end = F.when(F.col("_out").isNotNull(), F.col("_in.at") + blend), F.col("_out.at") - blend
    return found.select(*keys, F.col("_in.at").alias("entry"), F.col("_in.cost").alias("entry_cost"), F.col("_out.at").alias("exit"), F.col("_out.cost").alias("exit_cost"), start.alias("retained_start"), end.alias("retained_end"), (end - start).alias("retained"))


def merge_anchored(left: DataFrame, anchor: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, least: int, blend: int = 0) -> tuple[DataFrame, DataFrame]:
    """The seams of each case, and its merged series: ``keys``, ``at``, ``value`` and which series each value is of.

    Up to ``blend`` places on both sides of a seam, within the overlap, mix the
    two series by a raised cosine. Between retained_start and retained_end the
    values are the anchor's. Cases without an exit have no merged series. Each
    series has a value at every place from its first to its last.
    """
    seams = anchored_seams(seam_costs(left, anchor, keys, at, value), seam_costs(anchor, right, keys, at, value), keys, at, "cost", least, blend)
    sides = {"left": left, "anchor": anchor, "right": right}
    rows = None
    for name, side in sides.items():
        some = side.select(*keys, at, F.lit(name).alias("_side"), F.col(value).cast("double").alias("_value"))
        rows = some if rows is None else rows.unionByName(some)
    of = lambda name: F.max(F.when(F.col("_side") == name, F.col("_value"))).alias(f"_{name}")
    places = rows.groupBy(*keys, at).agg(*(of(n) for n in sides))
    ends = rows.groupBy(*keys).agg(*(f(F.when(F.col("_side") == n, F.col(at))).alias(f"_{e}_{n}") for n in sides for e, f in (("first", F.min), ("last", F.max))))
    cases = seams.filter("exit IS NOT NULL").join(_named(ends, keys, "_n", *(F.col(f"_{e}_{n}") for n in sides for e in ("first", "last"))), _same(keys, "_n"))
    bounds = cases.select(
        *(F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)),
        F.greatest("_first_anchor", F.col("entry") - blend).alias("_in_from"), F.least(F.least("_last_left", "_last_anchor") + 1, F.col("entry") + blend).alias("_in_to"),
        F.greatest(F.greatest("_first_right", F.col("entry") + least + 2 * blend - 1), F.col("exit") - blend).alias("_out_from"), F.least(F.least("_last_anchor", "_last_right") + 1, F.col("exit") + blend).alias("_out_to"),
        "_first_left", "_last_right",
    )
    here = F.col(at)

    def mixed(first: str, second: str, start: str, stop: str) -> Column:
        progress = (here - F.col(start) + 1) / (F.col(stop) - F.col(start) + 1)
        alpha = 0.5 - 0.5 * F.cos(math.pi * progress)
        return F.col(first) * (1 - alpha) + F.col(second) * alpha

    joined = places.join(bounds, _same(keys, "_c")).filter((here >= F.col("_first_left")) & (here <= F.col("_last_right")))
    merged = F.when(here < F.col("_in_from"), F.col("_left")).when(here < F.col("_in_to"), mixed("_left", "_anchor", "_in_from", "_in_to"))
    merged = merged.when(here < F.col("_out_from"), F.col("_anchor")).when(here < F.col("_out_to"), mixed("_anchor", "_right", "_out_from", "_out_to")).otherwise(F.col("_right"))
    part = F.when(here < F.col("_in_from"), "left").when(here < F.col("_in_to"), "entry").when(here < F.col("_out_from"), "anchor").when(here < F.col("_out_to"), "exit").otherwise("right")
    return seams, joined.select(*keys, at, merged.alias(value), part.alias("part"))
