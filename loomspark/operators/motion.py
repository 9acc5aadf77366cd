"""Windows, lookups, negative examples and scores of recorded motion; a series is all rows with the same keys in the order of ``at`` (0, 1, 2 ...)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.scalar import wrap_angle


def explicit_windows(series: DataFrame, count: str, starts: str, clip: int) -> DataFrame:
    """One row per wanted start, in order: ``window``, start, source_frames and padded_frames.

    A clip of ``clip`` frames gives ``clip - 1``. Null starts, repeated ones and
    those outside the series give no window; see :func:`bad_starts`.
    """
    good = F.array_sort(F.filter(F.array_distinct(F.col(starts)), lambda s: (s >= 0) & (s <= F.col(count) - (clip - 1))))
    rows = series.select(*(c for c in series.columns if c != starts), F.posexplode(good).alias("window", "start"))
    left = F.col(count) - F.col("start")
    return rows.withColumn("source_frames", F.least(F.lit(clip), left)).withColumn("padded_frames", F.greatest(F.lit(0), F.lit(clip) - left))


def bad_starts(series: DataFrame, count: str, starts: str, clip: int) -> DataFrame:
    """Series whose starts repeat, are none, or lie outside."""
    outside = F.exists(starts, lambda s: s.isNull() | (s < 0) | (s > F.col(count) - (clip - 1)))
    return series.filter((F.size(starts) == 0) | (F.size(F.array_distinct(F.col(starts))) < F.size(starts)) | outside)


def latent_ranges(series: DataFrame, frames: str, latents: int, radius: int = 1) -> DataFrame:
    """``latent``, start and end of the source frames behind each latent step, edges rounded half to even and widened by ``radius``."""
    edge = lambda k: F.bround(k * F.col(frames) / latents).cast("int")
    rows = series.withColumn("latent", F.explode(F.sequence(F.lit(0), F.lit(latents - 1))))
    start, end = edge(F.col("latent")), edge(F.col("latent") + 1)
    return rows.withColumn("start", F.greatest(F.lit(0), start - radius)).withColumn("end", F.least(F.col(frames).cast("int"), F.greatest(end, start + 1) + radius))


def tail(rows: DataFrame, keys: Sequence[str], at: str, least: int = 3, share: int = 3) -> DataFrame:
    """The last third of each series, rounded up and at least three rows."""
    size = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("_n", size).filter(F.col(at) >= F.col("_n") - F.greatest(F.lit(least), F.ceil(F.col("_n") / share))).drop("_n")


def nearest_index(rows: DataFrame, keys: Sequence[str], at: str, count: int) -> DataFrame:
    """``count`` evenly spaced rows of each series as ``step``, places rounded half to even; rows may come twice."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    place = F.lit(0) if count == 1 else F.bround(F.col("step") * (F.col("_n") - 1) / (count - 1))
    wanted = sizes.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn(at, place.cast("int"))
    return wanted.drop("_n").join(rows, [*keys, at])


def padded(rows: DataFrame, keys: Sequence[str], order: str, value: str, width: int) -> DataFrame:
    """The values of a series as one array of ``width``, 0 behind its end, and the mask of those that it has. A longer series raises."""
    held = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r[value]).alias("_held"))
    size = F.size("_held")
    checked = F.when(size <= width, F.col("_held")).otherwise(F.raise_error(F.lit(f"more than {width} values")))
    return held.select(
        *keys,
        F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(checked, i), F.lit(0.0))).alias("values"),
        F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i < size).alias("mask"),
    )


def overlap(a_start: Column, a_count: Column, b_start: Column, b_count: Column) -> Column:
    """start and end of what two half-open intervals share; null if they share nothing."""
    start, end = F.greatest(a_start, b_start), F.least(a_start + a_count, b_start + b_count)
    return F.when(end > start, F.struct(start.alias("start"), end.alias("end")))


def contiguity_gaps(phases: DataFrame, keys: Sequence[str], start: str, end: str, tolerance: float = 1e-6) -> DataFrame:
    """Phases that don't begin where the one before ends, with ``gap``, negative where they overlap."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(start, end))
    return phases.withColumn("gap", F.col(start) - before).filter(F.abs("gap") > tolerance)


def section_counts(lines: DataFrame, file: str, number: str, text: str, domain: Sequence[str]) -> DataFrame:
    """Bullets ("- ") under the last heading ("## ") before them, for every file and heading of the domain, 0 where there are none; white space around a heading doesn't count."""
    named = F.when(F.startswith(text, F.lit("## ")), F.upper(F.trim(F.substring(text, 4, 1 << 20), F.lit(" \t\n\r\x0b\x0c"))))
    last = F.last(named, ignorenulls=True).over(Window.partitionBy(file).orderBy(number))
    found = lines.withColumn("section", last).filter(F.startswith(text, F.lit("- "))).groupBy(file, "section").agg(F.count("*").alias("bullets"))
    every = lines.select(file).distinct().withColumn("section", F.explode(F.array(*map(F.lit, domain))))
    return every.join(found, [file, "section"], "left").select(file, "section", F.coalesce("bullets", F.lit(0)).alias("bullets"))


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two ISO times."""
    return (F.unix_micros(F.try_to_timestamp(end)) - F.unix_micros(F.try_to_timestamp(start))) / 1e6


def throughput(windows: DataFrame, keys: Sequence[str], start: str, end: str, frames: str, fps: float, workers: int) -> DataFrame:
    """Wall seconds from the first start to the last end, frames a second, the factor to real time and worker hours.

    Starts and ends are ISO times with any offsets and are compared as times.
    ``unfinished`` counts the windows whose start or end is null or no time; a
    group that has one has no figures.
    """
    begun, over = (F.unix_micros(F.try_to_timestamp(c)) for c in (F.col(start), F.col(end)))
    found = windows.groupBy(*keys).agg(F.count_if(begun.isNull() | over.isNull()).alias("unfinished"), ((F.max(over) - F.min(begun)) / 1e6).alias("wall"), F.sum(frames).alias("frames"))
    found = found.withColumn("wall", F.when(F.col("unfinished") == 0, F.col("wall")))
    return found.select(
        *keys,
        "unfinished",
        "wall",
        F.try_divide("frames", "wall").alias("frames_a_second"),
        F.try_divide(F.col("wall"), F.col("frames") / fps).alias("realtime_factor"),
        (F.col("wall") * workers / 3600).alias("worker_hours"),
    )


def compare_runs(baseline: DataFrame, optimised: DataFrame, key: str, same: Sequence[str], status: str = "status", wall: str = "wall", rate: str = "frames_a_second", hours: str = "worker_hours") -> DataFrame:
    """Two runs of each case: speedup, gain in rate and the share of worker hours saved, if the runs can be compared.

    ``mismatches`` names the fields of ``same`` in which the runs differ (equal
    nulls agree), and status where one isn't 'completed'. A pair with a mismatch
    and a case that only one side has get no figures; the latter is named by
    'missing'. A case that occurs twice on a side gives a row for each pair.
    """
    side = lambda df, n: df.select(key, F.struct(*same, status, wall, rate, hours).alias(n))
    both = side(baseline, "_a").join(side(optimised, "_b"), key, "full")
    a, b = F.col("_a"), F.col("_b")
    unlike = F.array_compact(F.array(*(F.when(~a[f].eqNullSafe(b[f]), F.lit(f)) for f in same), F.when(~(F.coalesce(a[status] == "completed", F.lit(False)) & F.coalesce(b[status] == "completed", F.lit(False))), F.lit(status))))
    both = both.withColumn("mismatches", F.when(a.isNull() | b.isNull(), F.array(F.lit("missing"))).otherwise(unlike))
    fit = F.size("mismatches") == 0
    return both.select(key, "mismatches", F.when(fit, F.try_divide(a[wall], b[wall])).alias("speedup"), F.when(fit, F.try_divide(b[rate], a[rate])).alias("rate_gain"), F.when(fit, 1 - F.try_divide(b[hours], a[hours])).alias("hours_saved"))


def centreline_audit(points: DataFrame, keys: Sequence[str], frame: str, node: str, xyz: Sequence[str], confidence: str, nodes: int, least_visible: float = 0.8, most_cv: float = 0.12) -> DataFrame:
    """Whether the nodes of a line are seen often enough and the segments between them keep their lengths.

    One row for each node (from 0) of each frame. A node is visible if its
    coordinates and its confidence are finite and the confidence is above 0. A
    segment's variation is the population deviation of its length by its mean,
    over the frames in which both ends are visible; seen fewer than twice, or of
    no length, it is infinite. Returns ``keys``, frames, visible (share of all
    nodes of all frames), worst_cv, finite_confidence (all confidences are
    finite and not negative) and passed. Null never passes.
    """
    finite = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    seen = finite(confidence) & F.coalesce(F.col(confidence) > 0, F.lit(False))
    for c in xyz:
        seen = seen & finite(c)
    rows = points.select(*keys, F.col(frame).alias("_frame"), F.col(node).alias("_node"), *xyz, (finite(confidence) & (F.col(confidence) >= 0)).alias("_good"), seen.alias("_seen"))
    after = Window.partitionBy(*keys, "_frame").orderBy("_node")
    both = F.col("_seen") & F.lead("_seen").over(after) & (F.lead("_node").over(after) == F.col("_node") + 1)
    size = F.sqrt(sum((F.pow(F.lead(c).over(after) - F.col(c), 2) for c in xyz), F.lit(0.0)))
    segments = rows.withColumn("_size", F.when(both, size)).groupBy(*keys, "_node").agg(F.count("_size").alias("_n"), F.avg("_size").alias("_mean"), F.stddev_pop("_size").alias("_dev"))
    cv = F.when((F.col("_n") >= 2) & (F.col("_mean") > 1e-8), F.col("_dev") / F.col("_mean")).otherwise(float("inf"))
    worst = segments.filter(F.col("_node") < nodes - 1).groupBy(*keys).agg(F.max(cv).alias("_cv"), F.count("*").alias("_segments"))
    whole = rows.groupBy(*keys).agg(F.count_distinct("_frame").alias("frames"), F.count_if("_seen").alias("_visible"), F.coalesce(F.min("_good"), F.lit(False)).alias("finite_confidence"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        worst = worst.withColumnRenamed(k, f"_k{i}")
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    found = whole.join(worst, same, "left").withColumn("worst_cv", F.when(F.col("_segments") == nodes - 1, F.col("_cv")).otherwise(float("inf")))
    found = found.withColumn("visible", F.col("_visible") / (F.col("frames") * nodes))
    passed = F.col("finite_confidence") & (F.col("visible") >= least_visible) & (F.col("worst_cv") <= most_cv)
    return found.select(*keys, "frames", "visible", "worst_cv", "finite_confidence", F.coalesce(passed, F.lit(False)).alias("passed"))


def greatest_step(rows: DataFrame, keys: Sequence[str], at: str, x: str, y: str, most: float) -> DataFrame:
    """The longest step of a series of points, the first row that ends one as long, and whether it is ``most`` at most; a single point has none."""
    own = Window.partitionBy(*keys).orderBy(at)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(own), 2) + F.pow(F.col(y) - F.lag(y).over(own), 2))
    longest = F.max(F.struct(F.col("_step"), -F.col(at)))
    found = rows.withColumn("_step", step).groupBy(*keys).agg(F.coalesce(F.max("_step"), F.lit(0.0)).alias("step"), F.when(F.max("_step").isNotNull(), -longest["col2"]).alias("at"))
    return found.withColumn("passed", F.col("step") <= most)


def hold_baseline(rows: DataFrame, keys: Sequence[str], at: str, distance: str, hold: int, increase: float) -> DataFrame:
    """Median distance of the first ``hold`` rows, the largest and the last one, and whether the largest is within ``increase`` of the median."""
    found = rows.groupBy(*keys).agg(
        F.median(F.when(F.col(at) < hold, F.col(distance))).alias("baseline"), F.max(distance).alias("largest"), F.max_by(distance, at).alias("terminal")
    )
    return found.withColumn("passed", F.col("largest") <= F.col("baseline") + increase)


def worst_ratio(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """The least of the ratios candidate to baseline, none above 1; a baseline of 0 that the candidate reaches counts as 1."""
    one = lambda b, c: F.when((b == 0) & (c >= b), 1.0).otherwise(F.least(F.lit(1.0), c / F.greatest(b, F.lit(1e-9))))
    return F.least(*(one(b, c) for b, c in pairs))


def progress_score(expected: tuple[Column, Column], observed: tuple[Column, Column]) -> Column:
    """score, progress, lateral and cosine of a movement against the expected one; zeros, and an infinite lateral, where either is all but none."""
    (ex, ey), (ox, oy) = expected, observed
    wanted, moved = F.hypot(ex, ey), F.hypot(ox, oy)
    along, lateral = (ox * ex + oy * ey) / wanted, F.abs(ox * ey - oy * ex) / wanted
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    kept = F.exp(-lateral / F.greatest(F.lit(20.0), wanted * 0.6))
    score = unit((unit(along / wanted) * 0.75 + kept * 0.25) * unit(along / moved))
    still = (wanted < 1e-6) | (moved < 1e-6)
    named = {"score": (0.0, score), "progress": (0.0, along / wanted), "lateral": (float("inf"), lateral), "cosine": (0.0, unit(along / moved))}
    return F.struct(*(F.when(still, F.lit(none)).otherwise(v).alias(k) for k, (none, v) in named.items()))


def byte_range(header: Column, size: Column) -> Column:
    """first and last byte, both included, of a header like bytes=0-99, bytes=100- or bytes=-50; null without one, one that is malformed, or one outside."""
    held = F.trim(header)
    first = F.try_to_number(F.nullif(F.regexp_extract(held, r"^bytes=(\d*)-(\d*)$", 1), F.lit("")), F.lit("999999999999999999")).cast("long")
    last = F.try_to_number(F.nullif(F.regexp_extract(held, r"^bytes=(\d*)-(\d*)$", 2), F.lit("")), F.lit("999999999999999999")).cast("long")
    start = F.coalesce(first, F.when(last > 0, F.greatest(F.lit(0).cast("long"), size - last)))
    end = F.when(first.isNull(), size - 1).otherwise(F.coalesce(last, size - 1))
    return F.when((start < size) & (end >= start), F.struct(start.alias("first"), F.least(end, size - 1).alias("last")))


def unwrapped(rows: DataFrame, keys: Sequence[str], at: str, angle: str) -> DataFrame:
    """Adds ``unwrapped``: the angle without jumps of more than half a turn."""
    own = Window.partitionBy(*keys).orderBy(at)
    turned = rows.withColumn("_turn", F.coalesce(wrap_angle(F.col(angle) - F.lag(angle).over(own)), F.col(angle)))
    return turned.withColumn("unwrapped", F.sum("_turn").over(own)).drop("_turn")


def folded(updates: DataFrame, keys: Sequence[str], name: str, order: str, value: str, reducers: Mapping[str, Column]) -> DataFrame:
    """The state after all updates: names with a reducer are aggregated by it, all others take their last value."""
    last = F.max_by(value, order)
    chosen = F.lit(None).cast("double")
    grouped = updates.groupBy(*keys, name).agg(last.alias("_last"), *(c.alias(f"_r{i}") for i, c in enumerate(reducers.values())))
    chosen = F.col("_last")
    for i, reduced in enumerate(reducers):
        chosen = F.when(F.col(name) == reduced, F.col(f"_r{i}")).otherwise(chosen)
    return grouped.select(*keys, name, chosen.alias(value))


def positions_of(frames: DataFrame, keys: Sequence[str], at: str, frame: str, first: int, last: int, step: int) -> DataFrame:
    """Where each frame of a range lies in a series, null where it has none."""
    wanted = frames.select(*keys).distinct().withColumn(frame, F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))))
    return wanted.join(frames.select(*keys, frame, F.col(at).alias("position")), [*keys, frame], "left")


def shifted(rows: DataFrame, keys: Sequence[str], at: str, value: str, by: int) -> DataFrame:
    """``value`` delayed by some rows, at most all but one; the first is held."""
    own = Window.partitionBy(*keys).orderBy(at)
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    early = F.col(at) < F.least(F.lit(by), F.count("*").over(whole) - 1)
    return rows.withColumn(value, F.when(early | F.lag(value, by).over(own).isNull(), F.first(value).over(whole)).otherwise(F.lag(value, by).over(own)))


def stretched(rows: DataFrame, keys: Sequence[str], time: str, factor: float) -> DataFrame:
    """Times, as numbers, moved away from the first one by a factor."""
    origin = F.min(time).over(Window.partitionBy(*keys))
    return rows.withColumn(time, origin + (F.col(time) - origin) * factor)


def over_limit(rows: DataFrame, keys: Sequence[str], at: str, value: str, low: Column, high: Column) -> DataFrame:
    """The last value of each series put a tenth of the range above its upper limit."""
    last = F.col(at) == F.max(at).over(Window.partitionBy(*keys))
    return rows.withColumn(value, F.when(last, high + (high - low) * 0.1).otherwise(F.col(value)))


def seeded_noise(key: Column, seed: str, deviation: float) -> Column:
    """Normal noise that follows from the key and the seed alone: two uniform numbers from an MD5 digest, by the polar method of Box and Muller."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    part = lambda k: (F.conv(F.substring(digest, k, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.sqrt(F.log(part(1)) * -2.0) * F.cos(part(13) * 2.0 * 3.141592653589793) * deviation


def rebased(source: DataFrame, donor: DataFrame, keys: Sequence[str], at: str, history: int, positions: Sequence[str], angles: Sequence[str], copied: Sequence[str]) -> DataFrame:
    """The source's history, then the donor's movement since its own last row of history, from where the source stood."""
    names = [*positions, *angles, *copied]
    anchor = lambda df, mark: df.filter(F.col(at) == history - 1).select(*keys, *(F.col(c).alias(mark + c) for c in names))
    moved = donor.filter(F.col(at) >= history).join(anchor(donor, "_d_"), list(keys)).join(anchor(source, "_s_"), list(keys))
    out = [*keys, at]
    out += [(F.col(f"_s_{c}") + F.col(c) - F.col(f"_d_{c}")).alias(c) for c in positions]
    out += [wrap_angle(F.col(f"_s_{c}") + wrap_angle(F.col(c) - F.col(f"_d_{c}"))).alias(c) for c in angles]
    return source.filter(F.col(at) < history).select(*keys, at, *names).unionByName(moved.select(*out, *copied))
