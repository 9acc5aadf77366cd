"""Cheapest paths and components of graphs that are tables of edges, in rounds over all nodes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources.folders import stored


def _both_ways(edges: DataFrame, a: str, b: str, *more: str) -> DataFrame:
    there = edges.select(F.col(a).alias("u"), F.col(b).alias("v"), *more)
    back = edges.select(F.col(b).alias("u"), F.col(a).alias("v"), *more)
    return there.unionByName(back).filter("u <> v")


def cheapest_paths(edges: DataFrame, sources: DataFrame, a: str, b: str, cost: str, source: str, directed: bool = False, most_rounds: int = 10_000) -> DataFrame:
    """source, node and distance: the least sum of costs over the edges from each source to each node that it reaches.

    In a round the nodes whose distance fell in the round before offer their
    neighbours a way; a node that no offer betters is settled until one does.
    Of parallel edges the cheapest counts. Costs are not null and not negative,
    else reading them raises. A source that no edge has reaches itself. The rounds are as many as the
    edges of the longest cheapest path, each is written before the next.
    """
    checked = F.when(F.col(cost) >= 0, F.col(cost)).otherwise(F.raise_error(F.lit("a cost is null or negative")).cast("double"))
    priced = edges.withColumn("_cost", checked.cast("double"))
    ways = _both_ways(priced, a, b, "_cost") if not directed else priced.select(F.col(a).alias("u"), F.col(b).alias("v"), "_cost")
    ways = stored(ways.groupBy("u", "v").agg(F.min("_cost").alias("_cost")), "ways")
    held = stored(sources.select(F.col(source).alias("source"), F.col(source).alias("node"), F.lit(0.0).alias("distance"), F.lit(True).alias("open")).distinct(), "distances")
    for _ in range(most_rounds):
        frontier = held.filter("open")
        if frontier.isEmpty():
            return held.drop("open")
        offers = frontier.join(ways, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), (F.col("distance") + F.col("_cost")).alias("offer"))
        offers = offers.groupBy("source", "node").agg(F.min("offer").alias("offer"))
        both = held.drop("open").join(offers, ["source", "node"], "full")
        better = F.col("distance").isNull() | (F.col("offer") < F.col("distance"))
        held = stored(both.select("source", "node", F.least("distance", "offer").alias("distance"), F.coalesce(better, F.lit(False)).alias("open")), "distances")
    raise RuntimeError(f"the distances have not settled in {most_rounds} rounds")


def farthest(distances: DataFrame) -> DataFrame:
    """Of each source the reached node with the largest distance, the smallest of several."""
    best = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("distance"), "node"))
    return distances.withColumn("_n", best).filter("_n = 1").drop("_n")


def components(edges: DataFrame, nodes: DataFrame, a: str, b: str, node: str, most_rounds: int = 200) -> DataFrame:
    """node and root, the smallest node that it is connected with; a node without edges is its own root.

    In a round every node takes the least root among its neighbours', and then
    its root's root, so long chains halve. Edges whose ends aren't nodes are left out.
    """
    ways = stored(_both_ways(edges, a, b).distinct(), "ways")
    held = stored(nodes.select(F.col(node).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    for _ in range(most_rounds):
        near = ways.join(held, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        hooked = held.join(near, F.col("node") == F.col("u"), "left").select("node", "root", F.least("root", "near").alias("low"))
        tops = hooked.select(F.col("node").alias("low"), F.col("low").alias("top"))
        new = stored(hooked.join(tops, "low", "left").select("node", "root", F.least("low", "top").alias("new")), "roots")
        moved = not new.filter("new <> root").isEmpty()
        held = new.select("node", F.col("new").alias("root"))
        if not moved:
            return held
    raise RuntimeError(f"the components have not settled in {most_rounds} rounds")


def largest_component(found: DataFrame) -> DataFrame:
    """The nodes of the component with the most nodes, of the smallest root if there are several."""
    sizes = found.groupBy("root").agg(F.count("*").alias("_n"))
    best = sizes.agg(F.min_by("root", F.struct(-F.col("_n"), "root")).alias("root"))
    return found.join(F.broadcast(best), "root").select("node", "root")
