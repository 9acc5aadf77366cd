"""Order-dependent folds over the arrays of an entity, and geometry between its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.scalar import clamp, dot, norm
from loomspark.sources.folders import stored


def as_array(rows: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "xs") -> DataFrame:
    """Each entity's values in order, one row per entity; entities are meant to fit in a row."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(held, lambda p: p["v"]).alias(name))


def clamped_walk(steps: Column, start: float, low: float, high: float) -> Column:
    """Positions after each step, every one clamped before the next step is added."""
    first = F.array(F.lit(float(start)))
    walked = F.aggregate(steps, first, lambda path, s: F.concat(path, F.array(clamp(F.element_at(path, -1) + s, low, high))))
    return F.slice(walked, 2, F.greatest(F.size(walked) - 1, F.lit(1)))


def rate_limited(values: Column, most: float) -> Column:
    """Follows the values with steps of at most ``most``, forwards and backwards, and averages both."""

    def follow(xs: Column) -> Column:
        first = F.slice(xs, 1, 1)
        rest = F.slice(xs, 2, F.greatest(F.size(xs), F.lit(1)))
        return F.aggregate(rest, first, lambda path, x: F.concat(path, F.array(F.element_at(path, -1) + clamp(x - F.element_at(path, -1), -most, most))))

    return F.zip_with(follow(values), F.reverse(follow(F.reverse(values))), lambda a, b: (a + b) / 2)


def tail_mean(values: Column, share: int = 20) -> Column:
    """Mean of the largest max(1, n // share) values, null for none."""
    n = F.greatest(F.lit(1), F.floor(F.size(values) / share).cast("int"))
    top = F.slice(F.sort_array(values, asc=False), 1, n)
    return F.when(F.size(values) > 0, F.aggregate(top, F.lit(0.0), lambda t, x: t + x) / n)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of one length; if either is constant, 1 for equal arrays and 0 otherwise."""
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x) / F.size(xs)
    x, y = F.transform(a, lambda v: v - mean(a)), F.transform(b, lambda v: v - mean(b))
    spread = norm(x) * norm(y)
    return F.when(spread < 1e-12, F.when(a == b, 1.0).otherwise(0.0)).otherwise(clamp(dot(x, y) / spread, -1.0, 1.0))


def largest_difference(a: Column, b: Column) -> Column:
    """The largest absolute difference of two arrays of one length, null if the lengths differ."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.array_max(gaps))


def majority_of_three(rows: DataFrame, keys: Sequence[str], at: str, flag: str, name: str = "voted") -> DataFrame:
    """What at least two of the row and its two neighbours say; the first and last row keep what they say."""
    order = Window.partitionBy(*keys).orderBy(at)
    votes = F.lag(flag).over(order).cast("int") + F.col(flag).cast("int") + F.lead(flag).over(order).cast("int")
    return rows.withColumn(name, F.coalesce(votes >= 2, F.col(flag)))


def nearest_fill(rows: DataFrame, keys: Sequence[str], at: str, value: str, name: str = "filled", most: float | None = None) -> DataFrame:
    """Nulls taken from the nearest known row, the earlier one on ties, and within ``most`` if given."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    order = Window.partitionBy(*keys).orderBy(at)
    both = rows.withColumn("_b", F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    both = both.withColumn("_a", F.last(known, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before, after = F.col(at) - F.col("_b.t"), F.col("_a.t") - F.col(at)
    later = F.col("_b").isNull() | (F.col("_a").isNotNull() & (after < before))
    gap, picked = F.when(later, after).otherwise(before), F.when(later, F.col("_a.v")).otherwise(F.col("_b.v"))
    return both.withColumn(name, picked if most is None else F.when(gap <= most, picked)).drop("_a", "_b")


def seam(rows: DataFrame, keys: Sequence[str], at: str, jump: str, motion: str, weight: float = 0.75, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """The place of least jump + weight * motion within bounds, the earlier one on ties."""
    some = rows
    if low is not None:
        some = some.filter(F.col(at) >= low)
    if high is not None:
        some = some.filter(F.col(at) <= high)
    cost = F.col(jump) + F.lit(weight) * F.col(motion)
    return some.groupBy(*keys).agg(F.min(F.struct(cost.alias("cost"), F.col(at).alias("seam"))).alias("_s")).select(*keys, "_s.seam", "_s.cost")


def global_outliers(rows: DataFrame, keys: Sequence[str], value: str, ratio: float, floor: float = 1e-9) -> DataFrame:
    """Rows above ``ratio`` times the median of their whole entity."""
    middle = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    found = rows.join(middle, list(keys)).withColumn("ratio", F.col(value) / F.greatest(F.col("_m"), F.lit(floor)))
    return found.filter(F.col("ratio") > ratio).drop("_m")


def cumulative_progress(rows: DataFrame, keys: Sequence[str], at: str, weights: Sequence[str], floor: float = 0.05) -> DataFrame:
    """Running share of max(floor, mean of the weights) before each row, from 0 to below 1."""
    step = F.greatest(F.lit(floor), sum((F.col(w) for w in weights), F.lit(0.0)) / len(weights))
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_step", step)
    return out.withColumn("progress", F.coalesce(F.sum("_step").over(order), F.lit(0.0)) / F.sum("_step").over(whole)).drop("_step")


def grouped_with_padding(rows: DataFrame, keys: Sequence[str], at: str, gap: int, pad: int, length: Column) -> DataFrame:
    """Places up to ``gap`` apart as half-open intervals, padded on both sides, cut to [0, length), joined where they meet."""
    from loomspark.operators.series import islands, merge_intervals

    runs = islands(rows, keys, at, gap)
    ends = rows.groupBy(*keys).agg(F.max(length).alias("_n"))
    padded = runs.join(ends, list(keys)).select(
        *keys, F.greatest(F.col("first") - pad, F.lit(0)).alias("start"), F.least(F.col("last") + 1 + pad, F.col("_n")).alias("end")
    )
    return merge_intervals(padded, keys, "start", "end")


def closest_on_polyline(points: DataFrame, corners: DataFrame, keys: Sequence[str], point: str, order: str) -> DataFrame:
    """For each point (x, y) the least distance to the line through its entity's corners (cx, cy).

    An entity's area is cut into square cells, about a quarter as many as it has
    points and at most 512 on a side. A segment is in every cell that it passes
    within a cell's width, so a distance found in a point's cell that isn't above
    that width is the least. Points without one meet all segments of their line.
    """
    own = Window.partitionBy(*keys).orderBy(order)
    segments = corners.withColumn("nx", F.lead("cx").over(own)).withColumn("ny", F.lead("cy").over(own)).filter(F.col("nx").isNotNull())
    dx, dy = F.col("nx") - F.col("cx"), F.col("ny") - F.col("cy")
    size = dx * dx + dy * dy
    t = F.when(size > 0, clamp(((F.col("x") - F.col("cx")) * dx + (F.col("y") - F.col("cy")) * dy) / size, 0.0, 1.0)).otherwise(0.0)
    gap = F.hypot(F.col("x") - F.col("cx") - t * dx, F.col("y") - F.col("cy") - t * dy)
    every = points.select(*keys, "x", "y", F.lit(1).alias("_p")).unionByName(corners.select(*keys, F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(0).alias("_p")))
    side = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) / clamp(F.floor(F.sqrt(F.sum("_p")) / 2), 1, 512)
    grid = every.groupBy(*keys).agg(F.min("x").alias("_x"), F.min("y").alias("_y"), F.when(side > 0, side).otherwise(1.0).alias("_side"))
    at = lambda c, low: (F.col(c) - F.col(low)) / F.col("_side")
    low, high = F.least("_ax", "_bx"), F.greatest("_ax", "_bx")
    placed = segments.select(*keys, "cx", "cy", "nx", "ny").distinct().join(grid, list(keys)).select("*", at("cx", "_x").alias("_ax"), at("cy", "_y").alias("_ay"), at("nx", "_x").alias("_bx"), at("ny", "_y").alias("_by"))
    dealt = placed.withColumn("_i", F.explode(F.sequence(F.floor(low) - 1, F.floor(high) + 1)))
    along = lambda x: F.when(F.col("_ax") == F.col("_bx"), x[1]).otherwise(clamp((x[0] - F.col("_ax")) / F.nullif(F.col("_bx") - F.col("_ax"), F.lit(0.0)), 0.0, 1.0))
    one, two = along((F.greatest(low, F.col("_i") - 1), 0.0)), along((F.least(high, F.col("_i") + 2), 1.0))
    rise = F.col("_by") - F.col("_ay")
    ends = dealt.withColumn("_r", F.col("_ay") + one * rise).withColumn("_s", F.col("_ay") + two * rise)
    cells = ends.withColumn("_j", F.explode(F.sequence(F.floor(F.least("_r", "_s") - 1e-6) - 1, F.floor(F.greatest("_r", "_s") + 1e-6) + 1))).select(*keys, "_i", "_j", "cx", "cy", "nx", "ny")
    own_cell = points.join(F.broadcast(grid), list(keys)).withColumn("_i", F.floor(at("x", "_x"))).withColumn("_j", F.floor(at("y", "_y")))
    near = own_cell.join(cells.hint("merge"), [*keys, "_i", "_j"]).withColumn("_gap", gap).groupBy(*keys, point).agg(F.min("_gap").alias("distance"), F.first("_side").alias("_side"))
    found = stored(near.filter(F.col("distance") <= F.col("_side")).select(*keys, point, "distance"), "closest")
    rest = points.join(found.hint("merge"), [*keys, point], "left_anti").join(segments, list(keys)).withColumn("_gap", gap).groupBy(*keys, point).agg(F.min("_gap").alias("distance"))
    return found.unionByName(rest).groupBy(*keys, point).agg(F.min("distance").alias("distance"))


def two_way_assignment(straight: Column, crossed: Column) -> Column:
    """Which of two pairings scores more, the straight one on ties."""
    return F.when(crossed > straight, "swapped").otherwise("identity")


def precision_recall(rows: DataFrame, keys: Sequence[str], predicted: Column, actual: Column) -> DataFrame:
    """True and false positives, false negatives and the ratios, null where nothing is counted."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    out = rows.groupBy(*keys).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
