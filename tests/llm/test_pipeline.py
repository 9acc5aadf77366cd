"""The pipeline stage by stage against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from test_native import targets
from test_ngram_join import brute_force
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], FOLDER).write.parquet(f"{top}/{name}")
        out.append(spark.read.parquet(f"{top}/{name}"))
    return [(df.columns, df.collect()) for df in out]


def test_columns(stages):
    assert [c for c, _ in stages[:-1]] == [COLUMNS] * 5 and all(rows for _, rows in stages)


def test_rejects_low_quality_alone(stages):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{FOLDER}/labels.parquet')").fetchall())
    before, after = {r.doc_id for r in stages[0][1]}, {r.doc_id for r in stages[1][1]}
    assert after < before
    wrong = [i for i, q in labels.items() if (i in after) != (q == 1)]
    assert len(wrong) <= 0.05 * len(labels)


def test_one_of_equal_texts(stages):
    best = {}
    for r in stages[1][1]:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in stages[2][1]) == sorted(best.values())


def test_one_of_each_group(stages):
    classes = {i: c for i, c, _ in brute_force([(r.doc_id, r.text) for r in stages[2][1]])}
    assert sorted(classes[r.doc_id] for r in stages[3][1]) == sorted(set(classes.values()))


def test_mix(stages):
    docs = stages[3][1]
    sizes, place = {}, {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
        place[r.doc_id] = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:9], 16)
    want = targets(sizes)
    got = Counter(r.doc_id for r in stages[4][1])
    for source, size in sizes.items():
        own = sorted((r for r in docs if r.source == source), key=lambda r: place[r.doc_id])
        most, taken = max(len(WORD.findall(r.text or "")) for r in own), sum(got[r.doc_id] * len(WORD.findall(r.text or "")) for r in own)
        assert abs(taken - want[source]) <= most and taken <= 3 * size
        repeats = [got[r.doc_id] for r in own]
        assert repeats == sorted(repeats, reverse=True) and max(repeats) - min(repeats) <= 1  # a prefix of the hash line is taken once more


def test_ids(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in stages[4][1]}
    assert len(stages[5][1]) == len(stages[4][1])
    for r in stages[5][1]:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r.doc_id, r.ids_sha256) for r in got.collect()) == sorted((r.doc_id, r.ids_sha256) for r in stages[5][1])


def through_stages(spark, docs, top):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs


def test_an_empty_table_goes_through(spark, tmp_path):
    assert through_stages(spark, spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0), tmp_path).count() == 0


def test_odd_rows_go_through(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = duckdb.sql(f"SELECT doc_id FROM read_parquet('{FOLDER}/labels.parquet') WHERE quality = 1 ORDER BY doc_id LIMIT 1").fetchall()[0]
    good = docs.filter(docs.doc_id == labels[0]).first()
    odd = [(9001, None, None, None, None), (9002, "", "en", "x", 0), (None, good.text, None, None, 1), (None, None, None, None, None), (9003, (good.text + " ") * 3000, "en", "x", 1), tuple(good), tuple(good)]
    every = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("row_no", F.lit(5)).withColumn("_place", F.lit("p")).withColumn("score", F.lit("s"))
    got = through_stages(spark, every, tmp_path).collect()
    assert len({r.doc_id for r in got}) > 50
    mixed = spark.read.parquet(f"{tmp_path}/source_mix")
    assert mixed.columns == every.columns and mixed.select("row_no", "_place", "score").distinct().collect() == [(5, "p", "s")]
    texts = {r.text for r in spark.read.parquet(f"{tmp_path}/near_dedup").collect()}
    assert len(texts) == spark.read.parquet(f"{tmp_path}/near_dedup").count()
