"""The n-gram Jaccard join against all pairs."""

import itertools
import random

import pytest

from loomspark.llm import ngram_join
from loomspark.llm.components import components
from loomspark.llm.ngram_join import keep_one_of_each, near_duplicates


def brute_force(rows, n=5, threshold=0.8):
    sets = []
    for _, text in rows:
        words = (text or "").split()
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            a, b = sorted((top(i), top(j)))
            root[b] = a
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        names[top(i)] = min(names.get(top(i), doc_id), doc_id)
    return sorted((doc_id, names[top(i)], links[i]) for i, (doc_id, _) in enumerate(rows))


def corpus(seed, changed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randint(0, 30))
    rows = [(900, None), (901, ""), (902, "  "), (903, "one two"), (904, "one two"), (905, "one  two"), (906, "one three"), (907, "one two")]
    passage = [word() for _ in range(40)]
    for g in range(12):
        base = passage + [word() for _ in range(rnd.randint(20, 200))]
        for _ in range(rnd.choice([1, 2, 5, 40])):
            text = list(base)
            for _ in range(rnd.randint(0, changed)):
                text[rnd.randrange(len(text))] = word()
            rows.append((5000 - len(rows) if g % 2 else 2000 + len(rows), " ".join(text)))
    return rows + [rows[20], rows[30]]


@pytest.mark.parametrize(("seed", "changed", "block"), [(1, 3, 256), (2, 6, 256), (3, 4, 7)])
def test_against_all_pairs(spark, monkeypatch, tmp_path, seed, changed, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(seed, changed)
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep int").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(docs).collect())
    assert got == brute_force(rows)
    kept = [r.doc_id for r in keep_one_of_each(docs).collect()]
    classes = {r[0]: r[1] for r in got}
    assert sorted(classes[d] for d in kept) == sorted(set(classes.values()))
    assert keep_one_of_each(docs).columns == docs.columns


def test_splits_that_change_between_jobs(spark, monkeypatch, tmp_path):
    rows = corpus(4, 3)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/docs")
    docs, name = spark.read.parquet(f"{tmp_path}/docs"), "spark.sql.files.maxPartitionBytes"

    def later(*links):
        spark.conf.set(name, "4096")
        return components(*links)

    monkeypatch.setattr(ngram_join, "components", later)
    try:
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(docs).collect()) == brute_force(rows)
        spark.conf.unset(name)
        classes = {r[0]: r[1] for r in brute_force(rows)}
        assert sorted(classes[r.doc_id] for r in keep_one_of_each(docs).collect()) == sorted(set(classes.values()))
    finally:
        spark.conf.unset(name)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400)], "a long, b long")
    assert {(r.node, r.root) for r in components(links, "a", "b").collect()} == {(i, 0) for i in range(201)} | {(500, 400), (400, 400)}
