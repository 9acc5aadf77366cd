"""Selection with total orders: every choice has a rule for ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.ranking import ranked


def best_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], eligible: Column | None = None) -> DataFrame:
    """The first row of each group in the given order, among eligible rows; groups without one have no row."""
    some = rows if eligible is None else rows.filter(F.coalesce(eligible, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return some.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def best_with_fallback(rows: DataFrame, keys: Sequence[str], eligible: Column, order: Sequence[Column], fallback: Sequence[Column]) -> DataFrame:
    """The first eligible row in ``order``; in a group without one the first row in ``fallback``. ``chosen_as`` says which."""
    ok = F.coalesce(eligible, F.lit(False))
    own = Window.partitionBy(*keys)
    marked = (
        rows.withColumn("_ok", ok)
        .withColumn("_any", F.max(F.col("_ok").cast("int")).over(own))
        .withColumn("_first", F.row_number().over(own.orderBy(F.col("_ok").desc(), *order)))
        .withColumn("_second", F.row_number().over(own.orderBy(*fallback)))
    )
    taken = marked.filter(((F.col("_any") == 1) & (F.col("_first") == 1)) | ((F.col("_any") == 0) & (F.col("_second") == 1)))
    return taken.withColumn("chosen_as", F.when(F.col("_any") == 1, "eligible").otherwise("fallback")).drop("_ok", "_any", "_first", "_second")


def cap_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """At most so many rows of each group, the first ones."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", rank).filter(F.col("place") <= most)


def route_rollup(rows: DataFrame, request: str, name: str, accepted: Column, latency: str) -> DataFrame:
    """Per request the sorted names of all and of accepted candidates, and the accepted one of least latency, null if there is none."""
    ok = F.coalesce(accepted, F.lit(False))
    place = F.struct(F.col(latency), F.col(name))
    return rows.groupBy(request).agg(
        F.array_sort(F.collect_list(name)).alias("candidates"),
        F.array_sort(F.collect_list(F.when(ok, F.col(name)))).alias("accepted"),
        F.min(F.when(ok, place))[name].alias("oracle"),
        F.min(F.when(ok, F.col(latency))).alias("oracle_latency"),
    )


def replay(rows: DataFrame, group: str, order: Sequence[Column], accepted: Column, cost: str) -> DataFrame:
    """Per group, trying rows in order until the first accepted one: attempts, cost so far and whether one was accepted."""
    own = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ok = F.coalesce(accepted, F.lit(False)).cast("int")
    tried = rows.withColumn("_ok", ok).withColumn("_before", F.coalesce(F.max("_ok").over(earlier), F.lit(0))).filter("_before = 0")
    return tried.groupBy(group).agg(
        F.count("*").alias("attempts"), F.sum(cost).alias("spent"), (F.max("_ok") == 1).alias("accepted")
    )


def preference_pairs(rows: DataFrame, group: str, utility: str, name: str, accepted: Column) -> DataFrame:
    """The best accepted row of each group against every other row of it: group, chosen, rejected and the gap in utility."""
    best = best_per_group(rows, [group], [F.col(utility).desc(), F.col(name)], accepted)
    best = best.select(F.col(group).alias("_group"), F.col(name).alias("chosen"), F.col(utility).alias("_best"))
    return (
        rows.join(best, F.col(group) == F.col("_group"))
        .filter(F.col(name) != F.col("chosen"))
        .select(group, "chosen", F.col(name).alias("rejected"), (F.col("_best") - F.col(utility)).alias("gap"))
    )


def dag_rank(nodes: DataFrame, needs: DataFrame, node: str, needed: str, priority: str, done: Column) -> DataFrame:
    """Nodes in the order in which to do them: fewest open needs, most nodes waiting, priority, name.

    ``needs`` links a node to one that it needs. A need that isn't done, or
    that isn't a node, is open.
    """
    state = nodes.select(F.col(node).alias("_n"), F.coalesce(done, F.lit(False)).alias("_done"))
    open_needs = needs.join(state, needs[needed] == state["_n"], "left").groupBy(node).agg(
        F.count(F.when(~F.coalesce(F.col("_done"), F.lit(False)), 1)).alias("open_needs")
    )
    waiting = needs.groupBy(F.col(needed).alias(node)).agg(F.count_distinct(needs[node]).alias("unblocks"))
    joined = nodes.join(open_needs, node, "left").join(waiting, node, "left").fillna(0, ["open_needs", "unblocks"])
    order = [F.col("open_needs"), F.col("unblocks").desc(), F.col(priority).desc(), F.col(node)]
    return ranked(joined, order, "place", "_nodes").drop("_nodes")


def blocked_bins(rows: DataFrame, entity: str, at: str, score: str, low: float, high: float, bins: int) -> DataFrame:
    """The best row of each equal-width bin of ``at``; ties go to the earlier one."""
    width = (high - low) / bins
    bin_no = F.least(F.floor((F.col(at) - low) / width), F.lit(bins - 1)).cast("int")
    return best_per_group(rows.withColumn("bin", bin_no), [entity, "bin"], [F.col(score).desc(), F.col(at)])
