"""Graph search against brute force."""

import math
import random

import numpy as np

from loomspark.llm import vamana
from loomspark.llm.vamana import Graph, nearest

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute_force(rows, every, k):
    good = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.float32(v).astype(float)
    out = {}
    for q in (i for i in good if i % every == 0):
        near = sorted((math.sqrt(((good[q] - v) ** 2).sum()), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        out[q] = [(i, s) for s, i in near[:k]]
    return out


def found(spark, rows, every, g=Graph()):
    out = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA), every, 10, g).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_over_shards(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.normal(size=16).astype(np.float32)], 0) for i in range(1500)]
    want, got = brute_force(rows, 20, 10), found(spark, rows, 20, Graph(shard_rows=400, degree=16, beam=32, search_beam=64))
    assert want.keys() == got.keys()
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 10 for q in want]) > 0.95
    for q in got:
        assert all(abs(dict(want[q])[i] - s) < 1e-12 for i, s in got[q] if i in dict(want[q]))


def test_recall_of_real_vectors_in_eight_shards(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, 0) for r in table.collect()]
    want, got = brute_force(rows, 20, 10), found(spark, rows, 20, Graph(shard_rows=250))
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 10 for q in want]) > 0.95


def test_queries_in_chunks_and_uneven_shards(spark, monkeypatch):
    monkeypatch.setattr(vamana, "CHUNK", 3)
    rnd = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rnd.normal(size=3 + i % 2).astype(np.float32)], 0) for i in range(200)]
    assert found(spark, rows, 4, Graph(shard_rows=9)) == brute_force(rows, 4, 10)


def test_repeated_query_rows(spark):
    rnd = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rnd.normal(size=4).astype(np.float32)], 0) for i in range(60)]
    assert found(spark, rows + [rows[0], rows[0], rows[20], rows[7]], 20) == brute_force(rows, 20, 10)


def test_id_with_two_vectors_is_ranked_once(spark):
    rows = [(0, [0.0, 1.0], 0), (0, [0.0, 1.5], 0)] + [(i, [float(i), 1.0], 0) for i in range(1, 15)] + [(3, [3.0, 1.5], 0)]
    got = found(spark, rows, 100)[0]
    assert [v for v, _ in got] == list(range(1, 11))


def test_odd_vectors_copies_and_ties(spark):
    rnd = random.Random(2)
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(0, 60)]
    rows += [(100 + i, [float(rnd.randint(-2, 2)) for _ in range(3)], 0) for i in range(60)]
    rows += [(300, None, 0), (301, [0.0, 0.0, 0.0], 0), (302, [1.0, None, 2.0], 0), (303, [float("nan"), 1.0, 1.0], 0), (304, [float("inf"), 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 0)]
    rows += [(400, [1.0, 2.0], 0), (410, [1.0, 2.5], 0), (500, [7.0], 0), rows[3], (305, [], 0)]
    got = found(spark, rows, 10)
    want = {q: near for q, near in brute_force(rows, 10, 10).items() if near}
    assert got == want
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
