"""The divergence audit against sums over all terms in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomspark.llm import divergence as dv
from loomspark.llm.divergence import apart, divergence, share

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_force(docs, least=3, most=200):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        found = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        df[lang].update(set(found))
        counts[lang, source].update(found)
        counts[lang, None].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def shares(source):
            c = counts[lang, source]
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        whole, own = shares(None), {s: shares(s) for s in sources}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(own[s][t], whole[t]), t) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, values in (("pair", pairs), ("term", terms)):
                order = sorted(values, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(order, 1) if part == "pair" or i <= most]
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice(["", "É", "x", "Q"]) + rnd.choice("mnop")
    docs = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s3", None, "ß", ""]), " ".join(word() for _ in range(rnd.choice([0, 5, 40])))) for _ in range(150)]
    return docs + [("fr", "s1", "only once"), ("fr", "s2", None), ("en", "empty", ""), ("en", "s1", "the " * 3000), ("it", "s1", "1 2 3"), docs[3], docs[3]]


@pytest.mark.parametrize(("seed", "held", "most"), [(1, 300_000, 200), (2, 10, 5)])
def test_against_all_terms(spark, monkeypatch, seed, held, most):
    monkeypatch.setattr(dv, "HELD", held)
    docs = corpus(seed)
    rows = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, lang string, source string, text string").repartition(4)
    got = divergence(rows.selectExpr("*", "1 AS term", "2 AS n", "3 AS total", "4 AS v", "5 AS item", "6 AS docs"), most_terms=most)
    assert sorted(map(tuple, got.collect())) == brute_force(docs, most=most)


def test_no_rows_and_one_source(spark):
    rows = spark.createDataFrame([("en", "a", "x y"), ("en", "a", "x"), ("en", "a", "x")], "lang string, source string, text string")
    assert divergence(rows.limit(0)).count() == 0
    assert divergence(rows).count() == 0  # no other source, and no share above the lang's


def test_a_very_long_text(spark):
    docs = [("en", "a", "word other " * 200_000), ("en", "b", "word"), ("en", "b", "word other x"), ("en", "c", "other x"), ("en", "c", "x")]
    assert sorted(map(tuple, divergence(spark.createDataFrame(docs, "lang string, source string, text string")).collect())) == brute_force(docs)


def test_shares_are_exact_for_any_count(spark):
    rows = [(n, total, v) for n, total, v in [(0, 0, 0), (0, 0, 1), (5, 9, 4), (10**14, 3 * 10**14 + 7, 10**8), (9 * 10**15, 9 * 10**15, 3), (10**9 - 1, 10**9, 1)]]
    got = spark.createDataFrame(rows, "n long, total long, v long").select("n", "total", "v", share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 1) // (total + v) if v else 1 for n, total, v in rows]
    far = spark.createDataFrame([(10**9 + 1, 1), (1, 10**9 + 1)], "p long, q long").select(apart(F.col("p"), F.col("q")).alias("f")).collect()
    assert [r.f for r in far] == [10**18, 10**18 // (10**9 + 1)]
