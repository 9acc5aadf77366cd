"""Connected components by alternating large-star and small-star steps; no link leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import cut, with_total


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for each node that has a link.

    In a star step every node's neighbours above it (large) or all its smaller
    neighbours (small) are linked to its smallest neighbour. A node's links are
    dealt into parts, so one with very many is no task's alone. Rounds go on
    until the links no longer change, which a count and a sum of hashes tell;
    the number of rounds is logarithmic in a component's size. No links give no
    rows; links of a node to itself are left out.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    sign = _sign(edges)
    for _ in range(most_rounds):
        both = _with_lowest(edges.union(edges.select("v", "u")))
        large = cut(both.filter("v > u").select(F.col("v").alias("u"), F.least("u", "lowest").alias("v")).filter("u <> v").distinct())
        best = _with_lowest(large)
        small = best.filter("v <> lowest").select(F.col("v").alias("u"), F.col("lowest").alias("v")).union(best.select("u", F.col("lowest").alias("v")))
        edges = cut(small.filter("u <> v").distinct())
        before, sign = sign, _sign(edges)
        if sign == before:
            break
    else:
        raise RuntimeError("the components have not settled")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def _with_lowest(edges: DataFrame) -> DataFrame:
    return with_total(edges, ["u"], "v", F.min("v"), "lowest")


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s
