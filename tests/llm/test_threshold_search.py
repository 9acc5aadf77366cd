"""Ranked search by the threshold algorithm against the scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import threshold_search as ts
from loomspark.llm.threshold_search import Corpus, Query, Shard, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k=10):
    counts = [Counter(terms(text)) for _, text in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_all = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc_id, _), c, n in zip(docs, counts, sizes, strict=True):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (25 + (75 * n * n_docs) // n_all)))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") * rnd.choice([1, 1, 1, 2]) + rnd.choice(["", "", "é", "1"])
    docs = [(i, " ".join(word() for _ in range(rnd.choice([0, 3, 10, 10, 80])))) for i in range(120)]
    docs += docs[:9] + [(500 - i, docs[5][1].upper()) for i in range(30)] + [(None, docs[7][1]), (None, None), (13, ""), (14, " ?!")]
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 5, 12, 30])))) for i in range(15)]
    return docs, items + [items[0], (3, "j jj"), (None, "a b"), (77, None), (78, ""), (79, "nowhere"), (80, docs[5][1])]


def tables(spark, docs, items):
    odd = ["1 AS n", "2 AS terms", "3 AS score", "4 AS query", "5 AS rank"]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", *odd)
    return d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", *odd)


@pytest.mark.parametrize(("seed", "postings", "depth", "most_bytes"), [(1, 1 << 20, 16, 1 << 20), (2, 100, 1, 1 << 20), (3, 1, 3, 1000)])
def test_against_all_documents(spark, monkeypatch, seed, postings, depth, most_bytes):
    monkeypatch.setattr(ts, "POSTINGS", postings)
    monkeypatch.setattr(ts, "DEPTH", depth)
    monkeypatch.setattr(ts, "CELLS", 50)
    docs, items = corpus(seed)
    got = search(*tables(spark, docs, items), most_bytes=most_bytes).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=repr) == brute_force(docs, items)


def shard(rows, weights):
    n = [sum(tfs) for _, _, tfs in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(n, pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])
    return Shard(batch, Corpus(len(rows), sum(n), np.array(weights)))


def test_the_threshold_stops_before_the_lists_end():
    own = shard([(i, [0], [1 + 1000 * (i < 20)]) for i in range(5000)], [700])
    q = Query(1, np.array([0]), np.array([2]))
    docs, scores, depth = own.best(q, 10)
    assert docs.tolist() == list(range(10)) and len(set(scores.tolist())) == 1 and depth < 100
    docs, _, depth = own.best(q, 30)
    assert docs.tolist() == list(range(30)) and depth >= 5000  # ties with the threshold go on to the end


def test_no_weight_and_no_term(spark):
    assert search(*tables(spark, [(i, "a") for i in range(3000)], [(1, "a")])).count() == 0
    docs, items = tables(spark, [(1, "a b"), (2, None)], [(1, "a")])
    assert [tuple(r)[:3] for r in search(docs, items).collect()] == [(1, 1, 1)]
    assert search(docs.limit(0), items).count() == search(docs, items.limit(0)).count() == search(docs.filter("doc_id = 2"), items).count() == 0
    assert search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_a_very_long_text(spark):
    docs = [(1, "a b " * 400_000), (2, "a"), (3, "b c")]
    got = search(*tables(spark, docs, [(1, "a b"), (2, "b " * 50_000)])).collect()
    assert sorted(map(tuple, got), key=repr) == brute_force(docs, [(1, "a b"), (2, "b " * 50_000)])
