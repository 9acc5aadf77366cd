"""The classifier on held-out documents and odd rows."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import quality
from loomspark.llm.quality import Settings, classify, features, keep_good, scored, train
from loomspark.llm.rolling import BASE, MIX_1, MIX_2
from loomspark.llm.queries import queries

SMALL = Settings(sample=400, bits=12, steps=150)
SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries()["op4_quality"](spark, folder).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{folder}/labels.parquet')").fetchall()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    right = [got[i].predicted == q for i, q in labels if got[i].held_out]
    assert np.mean(right) > 0.94


def docs_and_labels(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        words = [rnd.choice("alpha beta gamma delta and of the".split()) for _ in range(rnd.randint(5, 40))]
        rows.append((i, " ".join(words) if i % 3 else " ".join(w.upper() + "!!" for w in words), "en", "x"))
    odd = [(1000, None, None, None), (1001, "", "en", "y"), (None, "alpha of the beta", "en", "z"), (1002, "alpha " * 100_000, "en", "x"), rows[4], rows[4], (4, "THE!! OF!!", "en", "x")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(300)] + [(7, None, 0), (None, 1, 0), (8, 5, 1), (9000, 0, 0), (10, 1, 0), (10, 1, 0)]
    return spark.createDataFrame(rows + odd, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows + odd


def test_odd_rows(spark):
    docs, labels, rows = docs_and_labels(spark)
    got = classify(docs, labels, SMALL).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got if r.doc_id != 4}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0 and i != 4]
    assert np.mean([(score[i] >= 0.3) == (i % 3 > 0) for i in held]) > 0.95
    assert score[1000] == score[1001]
    kept = keep_good(docs, labels, SMALL)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert sorted(r.score for r in classify(docs.repartition(7), labels, SMALL).collect()) == sorted(r.score for r in got)


def test_an_id_is_one_row_of_the_sample(spark):
    rows = [(7, f"text {i} of one id", "en", "x") for i in range(5000)] + [(i, f"other {i}", "en", "x") for i in range(8, 40)] + [(7, None, "en", "x")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7, 40)] * 3, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    usable = [i for i in range(7, 40) if zlib.crc32(str(i).encode()) % 5]
    got = quality.sampled(docs, labels, Settings(sample=10)).collect()
    assert len(got) == 10 and len({r.doc_id for r in got} & set(usable)) == 10
    whole = quality.sampled(docs, labels, Settings()).collect()
    assert sorted(r.doc_id for r in whole) == usable and sorted(map(tuple, whole)) == sorted(map(tuple, quality.sampled(docs.repartition(7), labels, Settings()).collect()))
    weights, _ = quality.fit(docs, labels, Settings(bits=10, steps=5, sample_bytes=400))  # a few rows fill the bound
    assert np.isfinite(weights).all() and weights.any()
    assert not quality.fit(docs, labels, Settings(bits=10, steps=5, sample_bytes=0))[0].any()


def test_empty_tables(spark):
    docs, labels, rows = docs_and_labels(spark)
    assert classify(docs.limit(0), labels, SMALL).count() == keep_good(docs.limit(0), labels, SMALL).count() == 0
    assert {r.score for r in classify(docs, labels.limit(0), SMALL).collect()} == {0.5}


def test_features_stay_in_their_document():
    texts = ["ab", None, "abcd efg efg", "", "x" * 9, "q r"]
    together = features(pa.array(texts), 12)
    for i, text in enumerate(texts):
        alone = [sorted(k.tolist()) for k, at in features(pa.array([text]), 12)]
        for k, (found, at) in enumerate(together):
            assert sorted(found[at[i] : at[i + 1]].tolist()) == (alone[k] if k < len(alone) else [])


WORD64 = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * int(MIX_1) & WORD64
    x = (x ^ x >> 27) * int(MIX_2) & WORD64
    return x ^ x >> 31


def plain_hash(data):
    return plain_mix((sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(data)) + len(data) * int(MIX_2)) & WORD64)


def plain_features(text, bits):
    """The four kinds of buckets of one text, feature by feature."""
    word = [plain_hash(w.encode()) for w in text.replace("\x0b", " ").replace("\x0c", " ").split()]
    grams = [[plain_hash(text[i : i + n].encode()) + n for i in range(len(text) - n + 1)] for n in (3, 4)]
    kinds = [word, [b - a + 5 for a, b in zip(word, word[1:])], *grams]
    return [[plain_mix(x & WORD64) >> 64 - bits for x in kind] for kind in kinds]


ODD = ["", None, "ab", "ab cd", "h\u00e9llo w\u00f6rld \u4e2d\u6587\u5b57 \U0001f600\U0001f600 x", "a a a b", "  x\ty\nz  ", "abc"]


def test_features_one_by_one():
    kinds = features(pa.array(ODD, pa.string()), 11)
    for i, text in enumerate(ODD):
        assert [found[at[i] : at[i + 1]].tolist() for found, at in kinds] == plain_features(text or "", 11)


def test_scores_one_by_one():
    weights = np.random.default_rng(2).normal(size=1 << 9).astype(np.float32)
    got = scored(pa.array(ODD, pa.string()), weights, 0.25, 9)
    for text, score in zip(ODD, got, strict=True):
        ids = [x for kind in plain_features(text or "", 9) for x in kind]
        mean = sum(float(weights[x]) for x in ids) / max(1, len(ids))
        assert score == pytest.approx(1 / (1 + np.exp(-(mean + 0.25))), abs=1e-6)


def test_steps_of_gradient_descent_one_by_one():
    s = Settings(bits=4, size=3, steps=3, batch=2, rate=0.7, seed=5)
    docs = [([0, 3], [0.25, 0.75], 1), ([3, 9, 15], [0.2, 0.4, 0.4], 0), ([1], [1.0], 1)]
    rnd = np.random.default_rng(s.seed)
    vectors, out, offset = rnd.uniform(-1 / 3, 1 / 3, (16, 3)), rnd.uniform(-1, 1, (3, 2)), np.zeros(2)
    order = []
    for step in range(3):
        while len(order) < 2:
            order += rnd.permutation(3).tolist()
        some, order, rate = [docs[j] for j in order[:2]], order[2:], 0.7 * (1 - step / 3)
        moves, out_move, offset_move = np.zeros_like(vectors), np.zeros_like(out), np.zeros(2)
        for ids, share, label in some:
            hidden = sum(w * vectors[i] for i, w in zip(ids, share, strict=True))
            p = np.exp(hidden @ out + offset) / np.exp(hidden @ out + offset).sum()
            p[label] -= 1
            for i, w in zip(ids, share, strict=True):
                moves[i] += w * (out @ p)
            out_move += np.outer(hidden, p)
            offset_move += p
        vectors, out, offset = vectors - rate * 8 / 2 * moves, out - 0.02 * rate / 2 * out_move, offset - 0.02 * rate / 2 * offset_move
    got, shift = train([(np.array(a, np.int32), np.array(b, np.float32), c) for a, b, c in docs], s)
    assert got == pytest.approx(vectors @ (out[:, 1] - out[:, 0]), abs=1e-5) and shift == pytest.approx(offset[1] - offset[0], abs=1e-6)


def test_columns_of_any_name(spark):
    docs, labels, rows = docs_and_labels(spark)
    more = docs.selectExpr("*", "doc_id AS _own_score", "text AS _score", "1 AS c0", "2 AS _row_no")
    kept = keep_good(more, labels, SMALL)
    assert kept.columns == more.columns
    assert all(r._own_score == r.doc_id and r._score == r.text and (r.c0, r._row_no) == (1, 2) for r in kept.collect())
