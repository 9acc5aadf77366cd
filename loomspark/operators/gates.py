"""Fail-closed gates: what is missing has failed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate_report(measured: DataFrame, keys: Sequence[str], gate: str, score: str, thresholds: Mapping[str, float]) -> DataFrame:
    """Keys, failed_gates (sorted), pass_count and worst_margin of each entity.

    A gate without a score, or with a null one, has failed and has the margin
    -1. Of several scores of a gate the smallest counts. Scores of gates that
    aren't required are ignored.
    """
    names = sorted(thresholds)
    found = measured.groupBy(*keys).agg(
        *(F.min(F.when(F.col(gate) == n, F.col(score))).alias(f"_{i}") for i, n in enumerate(names))
    )
    margins = [F.coalesce(F.col(f"_{i}") - F.lit(float(thresholds[n])), F.lit(-1.0)) for i, n in enumerate(names)]
    passed = [F.coalesce(F.col(f"_{i}") >= F.lit(float(thresholds[n])), F.lit(False)) for i, n in enumerate(names)]
    failed = F.array_compact(F.array(*(F.when(~ok, F.lit(n)) for n, ok in zip(names, passed, strict=True))))
    return found.select(
        *keys,
        failed.alias("failed_gates"),
        sum((ok.cast("long") for ok in passed), F.lit(0).cast("long")).alias("pass_count"),
        (F.least(*margins) if len(margins) > 1 else margins[0]).alias("worst_margin"),
    )


def assess_against_baseline(
    candidates: DataFrame,
    baseline: DataFrame | Column,
    keys: Sequence[str],
    weights: Mapping[str, float],
    floors: Mapping[str, float],
    tolerance: float,
    cost: Column | None = None,
) -> DataFrame:
    """Candidates with shortfall, excess, utility and penalised utility against the baseline of their keys.

    ``baseline`` is a table, or says which of the candidates' rows, one for
    their keys, is theirs; then no join is needed.
    shortfall adds up what metrics lack to their floors, excess what they fall
    behind the baseline by more than the tolerance. A candidate without a
    baseline has nulls and is not accepted.
    """
    if isinstance(baseline, Column):
        own = Window.partitionBy(*keys)
        joined = candidates.withColumns({f"base_{m}": F.max(F.when(baseline, F.col(m))).over(own) for m in weights})
    else:
        base = baseline.select(*keys, *(F.col(m).alias(f"base_{m}") for m in weights))
        joined = candidates.join(base, list(keys), "left")
    shortfall = sum((F.greatest(F.lit(0.0), F.lit(floors[m]) - F.col(m)) for m in floors), F.lit(0.0))
    excess = sum((F.greatest(F.lit(0.0), F.col(f"base_{m}") - F.col(m) - F.lit(tolerance)) for m in weights), F.lit(0.0))
    missing = F.greatest(*(F.col(f"base_{m}").isNull().cast("int") for m in weights), F.lit(0)) == 1
    utility = sum((F.lit(w) * F.col(m) for m, w in weights.items()), F.lit(0.0)) - (cost if cost is not None else F.lit(0.0))
    return (
        joined.withColumn("shortfall", F.when(~missing, shortfall))
        .withColumn("excess", F.when(~missing, excess))
        .withColumn("utility", F.when(~missing, utility))
        .withColumn("penalised", F.col("utility") - F.col("shortfall") - F.col("excess"))
        .withColumn("accepted", F.coalesce((F.col("shortfall") <= 1e-12) & (F.col("excess") <= 1e-12), F.lit(False)))
        .drop(*(f"base_{m}" for m in weights))
    )


def review_state(automatic: Column, human: Column) -> tuple[Column, Column]:
    """Whether to show (not refused by anyone) and whether to promote (agreed to by a person)."""
    ok = F.coalesce(automatic, F.lit(False))
    return ok & F.coalesce(human, F.lit(True)), ok & human.eqNullSafe(F.lit(True))


def capped_margin(margins: Sequence[Column], human: Column) -> Column:
    """The worst margin, at most -1 if a person refused and at most -0.5 if nobody has looked."""
    worst = F.least(*margins) if len(margins) > 1 else margins[0]
    return F.when(human.isNull(), F.least(worst, F.lit(-0.5))).when(~human, F.least(worst, F.lit(-1.0))).otherwise(worst)


def first_reason(reasons: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The name of the first condition that holds; a condition that is null doesn't hold."""
    out = F.when(F.coalesce(reasons[0][0], F.lit(False)), F.lit(reasons[0][1]))
    for condition, name in reasons[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def band_gates(bands: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """Whether every column lies within its bounds, ends included; null fails."""
    ok = F.lit(True)
    for name, (low, high) in bands.items():
        if low is not None:
            ok = ok & F.coalesce(F.col(name) >= low, F.lit(False))
        if high is not None:
            ok = ok & F.coalesce(F.col(name) <= high, F.lit(False))
    return ok


def violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break; a rule that is null is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.withColumn("broken", broken).filter(F.size("broken") > 0)


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, null keys among them."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_none(found: DataFrame, what: str) -> None:
    """Raises if there is a row, and names a few."""
    some = found.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {[r.asDict() for r in some]}")


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys, field and both values where two tables disagree or one lacks the key; equal nulls agree."""

    def long(df: DataFrame, side: str) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
        return df.select(*keys, pairs.alias("p")).select(*keys, F.col("p.field").alias("field"), F.col("p.value").alias(side), F.lit(True).alias(f"in_{side}"))

    both = long(left, "left").join(long(right, "right"), [*keys, "field"], "full")
    same = F.col("in_left").isNotNull() & F.col("in_right").isNotNull() & F.col("left").eqNullSafe(F.col("right"))
    return both.filter(~same).select(*keys, "field", "left", "right")
