"""Approximate nearest neighbours on sharded, robustly pruned, directed graphs.

Vectors are dealt into shards of bounded size. Each shard builds a graph: a
greedy search from its entry proposes neighbours for a batch of vectors at a
time, and pruning keeps a neighbour only if no kept one is closer to it, by
the factor ``alpha``, than the vector itself. A query runs one beam search in
every shard; the shards' answers are ranked together. Equal vectors are one
node, so copies can't crowd each other's neighbourhoods.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import cut


#: Nodes that a search opens at a time, and queries that are searched at a time.
OPEN, CHUNK = 4, 256


@dataclass(frozen=True)
class Graph:
    """``shard_rows`` is a shard's vectors on average, ``degree`` a node's edges, ``slack`` more of them until it is pruned again, ``beam`` and ``search_beam`` what a search keeps."""

    shard_rows: int = 8192
    degree: int = 24
    slack: int = 12
    beam: int = 48
    search_beam: int = 128
    alpha: float = 1.2
    passes: int = 1
    seed: int = 3


def _distances(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own row of ids; where the id is -1, infinite."""
    found = np.full(ids.shape, np.inf, np.float32)
    row, column = np.nonzero(ids >= 0)
    gap = vectors[ids[row, column]] - queries[row]
    found[row, column] = np.einsum("ij,ij->i", gap, gap)
    return found


def beam_search(queries: np.ndarray, vectors: np.ndarray, edges: np.ndarray, entry: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest nodes that a greedy search meets, and their squared distances.

    All queries take a step at a time: each opens its ``OPEN`` nearest unopened
    nodes, and their neighbours that are new to it compete for the beam.
    """
    n = len(queries)
    ids = np.full((n, beam), -1)
    ids[:, 0] = entry
    near = np.full((n, beam), np.inf, np.float32)
    near[:, :1] = _distances(queries, vectors, ids[:, :1])
    opened = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(vectors)), bool)
    seen[:, entry] = True
    active = np.arange(n)
    while len(active):
        waiting = np.where(opened[active] | (ids[active] < 0), np.inf, near[active])
        pick = np.argpartition(waiting, OPEN - 1, 1)[:, :OPEN]
        more = np.isfinite(np.take_along_axis(waiting, pick, 1))
        going = more.any(1)
        active, pick, more = active[going], pick[going], more[going]
        if not len(active):
            break
        row = np.arange(len(active))[:, None]
        opened[active[:, None], pick] |= more
        found = np.where(more[:, :, None], edges[ids[active[:, None], pick]], -1).reshape(len(active), -1)
        found.sort(1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[seen[active[:, None], found]] = -1
        seen[active[:, None], np.where(found < 0, entry, found)] = True
        all_ids = np.concatenate([ids[active], found], 1)
        all_near = np.concatenate([near[active], _distances(queries[active], vectors, found)], 1)
        all_opened = np.concatenate([opened[active], np.zeros(found.shape, bool)], 1)
        best = np.argpartition(all_near, beam - 1, 1)[:, :beam]
        ids[active], near[active], opened[active] = all_ids[row, best], all_near[row, best], all_opened[row, best]
    return ids, near


def prune(of: np.ndarray, candidates: np.ndarray, gaps: np.ndarray, vectors: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node the diverse ones of its candidates, -1 where there are fewer than ``degree``."""
    order = np.argsort(gaps, 1, kind="stable")
    row = np.arange(len(of))
    candidates, gaps = np.take_along_axis(candidates, order, 1), np.take_along_axis(gaps, order, 1).copy()
    twice = np.zeros(candidates.shape, bool)
    rank = np.argsort(candidates, 1, kind="stable")
    by_id = np.take_along_axis(candidates, rank, 1)
    np.put_along_axis(twice, rank[:, 1:], by_id[:, 1:] == by_id[:, :-1], 1)
    gaps[(candidates < 0) | (candidates == of[:, None]) | twice] = np.inf
    wide = vectors[candidates]
    square = np.einsum("ijk,ijk->ij", wide, wide)
    apart = square[:, :, None] + square[:, None, :] - 2 * (wide @ wide.transpose(0, 2, 1))
    left, kept = gaps.copy(), np.full((len(of), degree), -1)
    for k in range(degree):
        first = left.argmin(1)
        more = np.isfinite(left[row, first])
        if not more.any():
            break
        kept[more, k] = candidates[row, first][more]
        between = apart[row, first]
        left[alpha * alpha * between <= gaps] = np.inf
        left[row, first] = np.inf
    return kept


def build(vectors: np.ndarray, g: Graph) -> tuple[np.ndarray, int]:
    """The edges of each node and the node where searches begin: the one nearest to the mean."""
    n = len(vectors)
    mean = vectors.mean(0)
    entry = int(((vectors - mean) ** 2).sum(1).argmin())
    edges = np.full((n, g.degree + g.slack), -1, np.int32)
    rnd = np.random.default_rng(g.seed)
    for _ in range(g.passes):
        order = rnd.permutation(n)
        order = np.concatenate([[entry], order[order != entry]])
        done, size = 1, 1
        while done < n:
            some = order[done : done + size]
            ids, gaps = beam_search(vectors[some], vectors, edges, entry, g.beam)
            edges[some] = -1
            edges[some, : g.degree] = prune(some, ids, gaps, vectors, g.degree, g.alpha)
            _link_back(some, edges, vectors, g)
            done, size = done + len(some), min(256, max(1, done // 4))
    return edges, entry


def _link_back(some: np.ndarray, edges: np.ndarray, vectors: np.ndarray, g: Graph) -> None:
    """Adds the reverse of new edges; a node that has no room left is pruned to ``degree``."""
    source, target = np.repeat(some, g.degree), edges[some, : g.degree].ravel()
    source, target = source[target >= 0], target[target >= 0]
    known = (edges[target] == source[:, None]).any(1)
    source, target = source[~known], target[~known]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    held = (edges[nodes] >= 0).sum(1)
    place = np.arange(len(target)) - np.repeat(first, count) + np.repeat(held, count)
    room = np.repeat(held + count <= edges.shape[1], count)
    edges[target[room], place[room]] = source[room]
    full = np.flatnonzero(held + count > edges.shape[1])
    for i in range(0, len(full), 256):
        own = full[i : i + 256]
        fresh = np.full((len(own), int(count[own].max())), -1)
        for row, k in enumerate(own.tolist()):
            fresh[row, : count[k]] = source[first[k] : first[k] + count[k]]
        both = np.concatenate([edges[nodes[own]], fresh], 1)
        kept = prune(nodes[own], both, _distances(vectors[nodes[own]], vectors, both), vectors, g.degree, g.alpha)
        edges[nodes[own]] = -1
        edges[nodes[own], : g.degree] = kept


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, not all zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, every: int = 100, k: int = 10, g: Graph = Graph()) -> DataFrame:
    """The ``k`` nearest found of each row whose vec_id is divisible by ``every``, among all other rows.

    Returns query_id, rank, vec_id and score, the Euclidean distance in double
    precision; ties go to the smaller vec_id. Only vectors of a query's length
    are its candidates. Null, empty and zero vectors and those with null or
    non-finite components take no part. Rows with a null id are no queries and
    no candidates, and rows that repeat an id and its vector count once, as
    queries too; an id with several vectors is ranked once, by the nearest. Of
    equal vectors the k + 1 smallest ids can be among the nearest, so no more
    are kept. A vector of any length fits if ``shard_rows`` of them fit in a
    task. An empty table gives no rows; other columns are ignored.

    A task holds one shard and a chunk of its queries at a time. Every query
    visits every shard, so with queries that grow with the table the searches
    grow with its square, the building in proportion.
    """
    good = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").alias("v")).distinct()
    own = Window.partitionBy("key").orderBy("vec_id")
    few = good.withColumn("key", F.xxhash64("v")).withColumn("n", F.row_number().over(own)).filter(F.col("n") <= k + 1)
    nodes = cut(few.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("size", F.size("v")))
    sizes = {r["size"]: r["n"] for r in nodes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    shards = {size: math.ceil(n / g.shard_rows) for size, n in sorted(sizes.items())}
    if not shards:
        return good.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    first, last = {}, 0
    for size, n in shards.items():
        first[size], last = last, last + n
    of = lambda known: F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[F.col("size")]
    dealt = nodes.select((of(first) + F.pmod(F.xxhash64("v", F.lit(g.seed)), of(shards))).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("query_id"), "ids", "v")
    queries = good.filter(F.col("vec_id") % every == 0).withColumn("size", F.size("v"))
    each = F.explode(F.sequence(of(first), of(first) + of(shards) - 1)).alias("shard")
    asked = queries.select(each, F.lit(1).alias("kind"), F.col("vec_id").alias("query_id"), F.array().cast("array<bigint>").alias("ids"), "v")
    streams = dealt.unionByName(asked).repartitionById(last, F.col("shard")).sortWithinPartitions("shard", "kind")
    found = streams.mapInArrow(lambda batches: _searched(batches, k, g), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _wide(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy().astype(np.float64).reshape(len(vectors), -1)


def _searched(batches: Iterator[pa.RecordBatch], k: int, g: Graph) -> Iterator[pa.RecordBatch]:
    """Searches the shards of a partition one after the other: its vectors come first, then its queries."""
    held: list[pa.RecordBatch] = []
    shard: Shard | None = None
    for batch in batches:
        number, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)).tolist()
        for start, stop in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            some = batch.slice(start, stop - start)
            if kind[start] == 0:
                if held and held[0].column(0)[0].as_py() != number[start]:
                    held, shard = [], None
                held.append(some)
                continue
            if not held or held[0].column(0)[0].as_py() != number[start]:
                continue  # a shard without vectors
            if shard is None or shard.number != number[start]:
                shard = Shard(pa.concat_batches(held), g)
                held = held[:1]
            for i in range(0, some.num_rows, CHUNK):
                yield shard.search(some.slice(i, CHUNK), k)


class Shard:
    """The graph of one shard's vectors."""

    def __init__(self, rows: pa.RecordBatch, g: Graph):
        exact = _wide(rows.column(4))
        order = np.lexsort(exact.T[::-1])  # the graph doesn't depend on the order in which rows arrive
        self.number, self.g = rows.column(0)[0].as_py(), g
        self.exact, self.ids = exact[order], [rows.column(3)[i].as_py() for i in order.tolist()]
        self.scale = np.abs(exact).max()
        self.vectors = (self.exact / self.scale).astype(np.float32)
        self.edges, self.entry = build(self.vectors, g)

    def search(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        asked = _wide(queries.column(4))
        nodes, _ = beam_search((asked / self.scale).astype(np.float32), self.vectors, self.edges, self.entry, max(self.g.search_beam, 2 * k))
        out: list[tuple[int, int, float]] = []
        for query, q, met in zip(queries.column(2).to_pylist(), asked, nodes, strict=True):
            met = met[met >= 0]
            score = np.sqrt(((self.exact[met] - q) ** 2).sum(1))
            first: dict[int, float] = {}
            for s, v in sorted((s, v) for s, node in zip(score.tolist(), met.tolist(), strict=True) for v in self.ids[node] if v != query):
                first.setdefault(v, s)
            out += [(query, v, s) for v, s in list(first.items())[:k]]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.float64()])], ["query_id", "vec_id", "score"])
