"""Ordered rows of an entity: smoothing, filling, as-of lookups, runs and intervals, all by windows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.scalar import lerp, wrap_angle


def _by(keys: Sequence[str], at: str | Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*([at] if isinstance(at, str) else at))


def with_ordinal(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "i") -> DataFrame:
    """Numbers the rows of each entity from 0."""
    return rows.withColumn(name, F.row_number().over(_by(keys, order)) - 1)


def wrapped_delta(rows: DataFrame, keys: Sequence[str], at: str, angle: str, name: str = "delta") -> DataFrame:
    """The step from the row before, as an angle; null in the first row."""
    return rows.withColumn(name, wrap_angle(F.col(angle) - F.lag(angle).over(_by(keys, at))))


def integrate_wrapped(rows: DataFrame, keys: Sequence[str], at: str, delta: str, start: Column, name: str = "state") -> DataFrame:
    """Sums steps from a start, as an angle; null steps count as none."""
    upto = _by(keys, at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, wrap_angle(start + F.sum(F.coalesce(F.col(delta), F.lit(0.0))).over(upto)))


def centred_median(rows: DataFrame, keys: Sequence[str], at: str, value: str, radius: int, name: str = "median", keep_gaps: bool = False) -> DataFrame:
    """Median of up to ``radius`` rows on either side and the row itself, fewer at the ends; with ``keep_gaps`` a null stays null."""
    around = _by(keys, at).rowsBetween(-radius, radius)
    found = F.percentile(value, F.lit(0.5)).over(around)
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), found) if keep_gaps else found)


def gaussian(rows: DataFrame, keys: Sequence[str], at: str, value: str, sigma: float, name: str = "smooth") -> DataFrame:
    """Gaussian smoothing over round(3 sigma) rows on either side; ends go on with their last value."""
    radius = max(1, round(3 * sigma))
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    order = _by(keys, at)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = rows.withColumn("_first", F.first(value).over(whole)).withColumn("_last", F.last(value).over(whole))
    ends = ends.withColumn("_place", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    total = F.lit(0.0)
    for k, weight in zip(range(-radius, radius + 1), kernel, strict=True):
        if k == 0:
            near = F.col(value)
        elif k < 0:
            near = F.when(F.col("_place") + k < 1, F.col("_first")).otherwise(F.lag(value, -k).over(order))
        else:
            near = F.when(F.col("_place") + k > F.col("_n"), F.col("_last")).otherwise(F.lead(value, k).over(order))
        total = total + near * F.lit(weight / sum(kernel))
    return ends.withColumn(name, total).drop("_first", "_last", "_place", "_n")


def local_ratio(rows: DataFrame, keys: Sequence[str], at: str, value: str, radius: int, floor: float, with_self: bool, name: str = "ratio") -> DataFrame:
    """The value over the median of its neighbours, with or without itself, and over ``floor`` at least."""
    order = _by(keys, at)
    if with_self:
        middle = F.percentile(value, F.lit(0.5)).over(order.rowsBetween(-radius, radius))
    else:
        sides = F.concat(F.collect_list(value).over(order.rowsBetween(-radius, -1)), F.collect_list(value).over(order.rowsBetween(1, radius)))
        held = F.array_sort(sides)
        n = F.size(held)
        middle = F.when(n == 0, F.lit(None).cast("double")).otherwise((F.element_at(held, F.floor((n + 1) / 2).cast("int")) + F.element_at(held, F.floor(n / 2).cast("int") + 1)) / 2)
    return rows.withColumn(name, F.col(value) / F.greatest(middle, F.lit(floor)))


def median_outliers(rows: DataFrame, keys: Sequence[str], at: str, value: str, radius: int, threshold: float) -> DataFrame:
    """Marks rows further than ``threshold`` from the median around them."""
    found = centred_median(rows, keys, at, value, radius, "_median")
    return found.withColumn("outlier", F.abs(F.col(value) - F.col("_median")) > threshold).drop("_median")


def non_maximum_suppression(rows: DataFrame, key: str, at: str, score: str, separation: int) -> DataFrame:
    """Greedily keeps the highest score, drops what is closer than ``separation``, and goes on; ties go to the earlier row.

    ``at`` holds whole numbers; scores that are null or no number come last. The
    highest row within ``separation`` is kept whatever else is, and what is left
    on one side of it is no matter to the other side. So windows settle these
    rows and cut each entity at them; only what lies between two of them is
    chosen one row after another, as the sorted rows of a partition stream past.
    """
    if separation < 1:
        raise ValueError("the separation is a positive number")
    place, worth = F.col(at).cast("long"), F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    first = F.row_number().over(Window.partitionBy(key, at).orderBy(F.desc("_worth")))
    found = rows.withColumn("_worth", worth).withColumn("_first", first).filter(F.col("_first") == 1).withColumn("_place", place)
    order = Window.partitionBy(key).orderBy("_place")
    around = order.rangeBetween(1 - separation, separation - 1)
    rank = F.struct("_worth", -F.col("_place"))
    found = found.withColumn("_peak", F.max(rank).over(around) == rank)
    found = found.withColumn("_near", F.max("_peak").over(around)).filter(F.col("_peak") | ~F.col("_near"))
    found = found.withColumn("_starts", F.col("_peak") | F.lag("_place").over(order).isNull())
    held = found.sortWithinPartitions(key, "_place").select(*rows.columns, "_place", "_worth", "_starts")
    names = rows.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("_starts").to_numpy(zero_copy_only=False))
            if len(starts) and (starts[-1] or open_):
                yield _chosen(pa.concat_batches([*open_, batch.slice(0, starts[-1])]), names, separation)
                open_, batch = [], batch.slice(starts[-1])
            open_.append(batch)
        if open_:
            yield _chosen(pa.concat_batches(open_), names, separation)

    return held.mapInArrow(step, rows.schema)


def _chosen(rows: pa.RecordBatch, names: Sequence[str], separation: int) -> pa.RecordBatch:
    """The rows that are kept of whole pieces; of a piece, at most one kept row lies in ``separation`` neighbouring places."""
    places, worth = rows.column("_place").to_numpy(), rows.column("_worth").to_numpy()
    starts = np.flatnonzero(rows.column("_starts").to_numpy(zero_copy_only=False))
    sizes = np.diff(starts, append=len(places))
    keep = np.zeros(len(places), bool)
    keep[starts[sizes == 1]] = True
    for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        taken: dict[int, int] = {}
        own = places[start : start + size]
        for i in np.lexsort((own, -worth[start : start + size])).tolist():
            here = int(own[i])
            cell = here // separation
            if all(abs(here - taken.get(c, here + separation)) >= separation for c in (cell - 1, cell, cell + 1)):
                taken[cell] = here
                keep[start + i] = True
    return rows.select(list(names)).take(pa.array(np.flatnonzero(keep)))


def islands(rows: DataFrame, keys: Sequence[str], at: str, gap: int = 1) -> DataFrame:
    """Runs of whole numbers with steps of at most ``gap``: keys, first, last and length of each."""
    distinct = rows.select(*keys, at).distinct()
    order = _by(keys, at)
    new = F.when(F.col(at) - F.lag(at).over(order) <= gap, 0).otherwise(1)
    runs = distinct.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(*keys, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("length")).drop("_run")


def merge_intervals(rows: DataFrame, keys: Sequence[str], start: str, end: str, reach: int = 0) -> DataFrame:
    """Joins intervals of an entity that overlap once both sides reach out by ``reach``: a start before an earlier end."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) - reach < before + reach, 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("_run")


def hysteresis(rows: DataFrame, keys: Sequence[str], at: str, value: str, on: float, off: float) -> DataFrame:
    """``active``: on from a value at or below ``on`` until one at or above ``off`` or that isn't a number."""
    bad = F.col(value).isNull() | F.isnan(value)
    switch = F.when(bad | (F.col(value) >= off), False).when(F.col(value) <= on, True)
    upto = _by(keys, at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("active", F.coalesce(F.last(switch, ignorenulls=True).over(upto), F.lit(False)))


def active_intervals(rows: DataFrame, keys: Sequence[str], at: str, active: str, least: int, bridge: int) -> DataFrame:
    """Half-open runs of active rows: those up to ``bridge`` apart are joined, then those shorter than ``least`` are dropped."""
    runs = islands(rows.filter(active), keys, at).select(*keys, F.col("first").alias("start"), (F.col("last") + 1).alias("end"))
    order = Window.partitionBy(*keys).orderBy("start")
    new = F.when(F.col("start") - F.lag("end").over(order) <= bridge, 0).otherwise(1)
    joined = runs.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    found = joined.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")
    return found.filter(F.col("end") - F.col("start") >= least)


def phases(rows: DataFrame, keys: Sequence[str], at: str, labels: Sequence[str]) -> DataFrame:
    """Maximal runs of rows with equal labels: keys, labels, start, end (exclusive) and run, by the rows' ordinals."""
    numbered = with_ordinal(rows, keys, [at], "_i")
    order = _by(keys, "_i")
    same = F.lit(True)
    for label in labels:
        same = same & F.col(label).eqNullSafe(F.lag(label).over(order))
    new = F.when((F.col("_i") > 0) & same, 0).otherwise(1)
    runs = numbered.withColumn("_new", new).withColumn("run", F.sum("_new").over(order))
    return runs.groupBy(*keys, "run", *labels).agg(F.min("_i").alias("start"), (F.max("_i") + 1).alias("end"))


def longest_run(rows: DataFrame, keys: Sequence[str], at: str, flag: Column) -> DataFrame:
    """The length of the longest run of rows where the flag holds, 0 if it never does."""
    marked = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    order = _by(keys, at)
    block = marked.withColumn("_block", F.sum(F.when(~F.col("_flag"), 1).otherwise(0)).over(order))
    sizes = block.groupBy(*keys, "_block").agg(F.count_if("_flag").alias("_n"))
    return sizes.groupBy(*keys).agg(F.max("_n").alias("longest"))


def response_lag(rows: DataFrame, keys: Sequence[str], at: str, driver: Column, response: Column, within: int) -> DataFrame:
    """Driver rows with the distance in rows to the first response among the next ``within`` (the row itself is 0), null if none."""
    numbered = with_ordinal(rows, keys, [at], "_i")
    ahead = _by(keys, "_i").rowsBetween(0, within)
    first = F.min(F.when(F.coalesce(response, F.lit(False)), F.col("_i"))).over(ahead)
    marked = numbered.withColumn("lag", first - F.col("_i")).withColumn("responded", F.col("lag").isNotNull())
    return marked.filter(F.coalesce(driver, F.lit(False))).drop("_i")


def jerk(rows: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Mean of the absolute second differences of each entity, 0 for fewer than three rows."""
    order = _by(keys, at)
    second = F.abs(F.col(value) - 2 * F.lag(value, 1).over(order) + F.lag(value, 2).over(order))
    return rows.withColumn("_second", second).groupBy(*keys).agg(F.coalesce(F.avg("_second"), F.lit(0.0)).alias("jerk"))


def as_of(points: DataFrame, knots: DataFrame, keys: Sequence[str], at: str, value: str, most_carry: float) -> DataFrame:
    """The points with the knots' value at their place: an exact knot, else between two by a line, else the nearest within ``most_carry``.

    Both sides go through one sort per entity, so no pair of rows is made that
    isn't needed. Of knots at one place the largest value counts.
    """
    own = knots.groupBy(*keys, at).agg(F.max(value).alias(value))
    both = points.withColumn("_knot", F.lit(None).cast("double")).withColumn("_is", F.lit(1)).unionByName(
        own.select(*keys, at, F.col(value).cast("double").alias("_knot"), F.lit(0).alias("_is")), allowMissingColumns=True
    )
    place = F.when(F.col("_is") == 0, F.struct(F.col(at).alias("t"), F.col("_knot").alias("v")))
    order = Window.partitionBy(*keys).orderBy(at, "_is")
    back = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("_is")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_b", F.last(place, ignorenulls=True).over(back)).withColumn("_a", F.last(place, ignorenulls=True).over(ahead)).filter("_is = 1")
    t = F.col(at)
    got = (
        F.when(F.col("_b.t") == t, F.col("_b.v"))
        .when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), lerp(F.col("_b.t"), F.col("_b.v"), F.col("_a.t"), F.col("_a.v"), t))
        .when(F.col("_b").isNotNull() & (t - F.col("_b.t") <= most_carry), F.col("_b.v"))
        .when(F.col("_a").isNotNull() & (F.col("_a.t") - t <= most_carry), F.col("_a.v"))
    )
    return found.withColumn(value, got).drop("_knot", "_is", "_a", "_b")


def nearest(points: DataFrame, knots: DataFrame, keys: Sequence[str], at: str, name: str) -> DataFrame:
    """The points with the place of the nearest knot, the earlier one on ties; null if the entity has none."""
    own = knots.select(*keys, at).distinct()
    both = points.withColumn("_is", F.lit(1)).unionByName(own.withColumn("_is", F.lit(0)), allowMissingColumns=True)
    place = F.when(F.col("_is") == 0, F.col(at))
    order = Window.partitionBy(*keys).orderBy(at, "_is")
    back = F.last(place, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.last(place, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("_is")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_b", back).withColumn("_a", ahead).filter("_is = 1")
    later = F.col("_b").isNull() | (F.col("_a") - F.col(at) < F.col(at) - F.col("_b"))
    return found.withColumn(name, F.when(later, F.col("_a")).otherwise(F.col("_b"))).drop("_is", "_a", "_b")


def resample(rows: DataFrame, keys: Sequence[str], at: str, value: str, step: float) -> DataFrame:
    """A regular grid from each entity's first place on, at multiples of ``step``, up to its last, with values on lines between rows."""
    ends = rows.groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    count = F.floor((F.col("_hi") - F.col("_lo")) / step + 1e-9).cast("int")
    grid = ends.select(*keys, "_lo", F.explode(F.sequence(F.lit(0), count)).alias("k"))
    grid = grid.select(*keys, (F.col("_lo") + F.col("k") * F.lit(step)).alias(at), "k")
    return as_of(grid, rows.select(*keys, at, value), keys, at, value, 0.0)


def fill_linear(rows: DataFrame, keys: Sequence[str], at: str, value: str, name: str = "filled", hold_ends: bool = True) -> DataFrame:
    """Nulls filled on the line between the known rows around; beyond the first and last known row held, or left null."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).cast("double").alias("v")))
    order = _by(keys, at)
    back = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.last(known, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = rows.withColumn("_b", back).withColumn("_a", ahead)
    inner = lerp(F.col("_b.t"), F.col("_b.v"), F.col("_a.t"), F.col("_a.v"), F.col(at))
    filled = F.when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), inner)
    if hold_ends:
        filled = filled.otherwise(F.coalesce(F.col("_b.v"), F.col("_a.v")))
    return both.withColumn(name, filled).drop("_a", "_b")


def alignment(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Two streams paired by ordinal: pairs, median offset, and nearest-rank 95th and largest distance of offsets from it."""
    a = with_ordinal(left.select(*keys, at), keys, [at]).withColumnRenamed(at, "_l")
    b = with_ordinal(right.select(*keys, at), keys, [at]).withColumnRenamed(at, "_r")
    pairs = a.join(b, [*keys, "i"]).withColumn("_off", F.col("_r") - F.col("_l"))
    middle = pairs.groupBy(*keys).agg(F.percentile("_off", F.lit(0.5)).alias("offset"), F.count("*").alias("pairs"))
    gaps = pairs.join(middle, list(keys)).withColumn("_gap", F.abs(F.col("_off") - F.col("offset")))
    return gaps.groupBy(*keys, "pairs", "offset").agg(
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY _gap)").alias("p95"), F.max("_gap").alias("most")
    )


def covered(rows: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """How many places the union of half-open intervals covers."""
    return merge_intervals(rows, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))
