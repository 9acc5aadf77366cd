"""Decontamination against all windows of all items, looked up one by one."""

import random
import re

import pytest

from loomspark.llm.decontaminate import Automaton, decontaminate, united

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def brute_force(docs, items, window):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for name, item in items:
            w = words(item)
            size = min(window, len(w))
            wanted = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
            for i in range(len(own) - size + 1):
                if w and tuple(own[i : i + size]) in wanted:
                    hit |= set(range(i, i + size))
                    found.add("" if name is None else str(name))
        out.append((doc_id, len(own), len(hit), sorted(found), sorted(hit)))
    return sorted(out, key=repr)


def tables(spark, docs, items):
    odd = ["1 AS spans", "2 AS items", "3 AS n_words", "4 AS kept", "5 AS _long"]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *odd)
    return d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", *odd)


def corpus(seed, letters):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice(letters) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 3, 4, 5, 8, 12]))) for i in range(14)] + [(None, text(6)), (3, text(7)), (99, None), (98, " .,"), (97, "")]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(40)]
    for i in range(40, 60):
        passage = rnd.choice(items)[1] or ""
        docs.append((i, f"{text(5)}, {passage.upper()}! {text(4)}.{passage}"))
    return docs + [(None, None), (None, text(30)), (7, None), (8, ""), (9, " \n.;")] + docs[50:52], items


@pytest.mark.parametrize(("seed", "letters", "window", "most_bytes"), [(1, "abcde", 4, 1 << 20), (2, "abcdefghijklmnop", 3, 400), (3, ["é", "ÉÉ", "x1", "Ω", "zz"], 5, 1 << 20), (4, "ab", 6, 1 << 20)])
def test_against_every_window(spark, seed, letters, window, most_bytes):
    docs, items = corpus(seed, letters)
    got = []
    for r in decontaminate(*tables(spark, docs, items), window, texts=False, most_bytes=most_bytes).collect():
        hit = [i for s in r.spans for i in range(s.start, s.stop)]
        assert r.n_hit == len(hit) and r.n_items == len(r.items) and r.contaminated == (r.n_hit > 0)
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
        got.append((r.doc_id, r.n_words, r.n_hit, list(r.items), hit))
    assert sorted(got, key=repr) == brute_force(docs, items, window)


def test_spans_are_cut_out_and_covered_documents_dropped(spark):
    items = [(1, "The quick Brown fox jumps over the lazy dog again today"), (2, "née Élan")]
    docs = [(1, "Intro -- the QUICK brown fox, jumps over the lazy dog again; and so it goes on and on for long (end)."), (2, "the quick brown fox jumps over the lazy dog again today"), (3, "clean\ttext"), (4, None), (5, "")]
    docs.append((6, "a née ÉLAN née Élan b c d e f g"))
    got = {r.doc_id: r for r in decontaminate(*tables(spark, docs, items), most_coverage=0.6).collect()}
    assert got[1].kept == "Intro -- ; and so it goes on and on for long (end)." and not got[1].dropped and got[1].longest == 10
    assert got[2].dropped and got[2].kept is None and got[2].coverage == 1.0 and got[2].longest == 11
    assert got[3].kept == "clean\ttext" and got[4].kept is None and got[5].kept == "" and not got[4].dropped
    assert got[6].kept == "a  b c d e f g" and got[6].items == ["2"]


def test_very_long_texts_stream_past(spark):
    rnd = random.Random(5)
    item = " ".join(f"w{rnd.randint(0, 50)}" for _ in range(300))
    text = " ".join(f"w{rnd.randint(0, 50)}" for _ in range(300_000)) + " " + item
    got = decontaminate(*tables(spark, [(1, text), (2, item * 2)], [(1, item)]), texts=False).orderBy("doc_id").collect()
    assert (got[0].n_words, got[0].n_hit, got[0].longest) == (300_300, 300, 300)
    assert got[1].n_hit >= 598 and got[1].items == ["1"]


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, "a b c")], [(1, "a b")])
    assert decontaminate(docs.limit(0), items).count() == 0
    row = decontaminate(docs, items.limit(0)).first()
    assert (row.n_hit, row.n_items, row.kept, row.n_words) == (0, 0, "a b c", 3)
    with pytest.raises(ValueError):
        Automaton([], 0)


def test_automaton_has_every_part_of_the_items_and_no_other():
    rnd = random.Random(9)
    items = [(str(i), " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))) for i in range(12)]
    own = Automaton([(n, t.encode()) for n, t in items], 4)
    parts = {tuple(w[i:j]) for _, t in items for w in [t.encode().split()] for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    assert len(own.link) <= 2 * sum(len(t.split()) for _, t in items) + 1
    for n in range(1, 6):
        for _ in range(300):
            some = tuple(rnd.choice([b"a", b"b", b"c"]) for _ in range(n))
            state = 0
            for word in some:
                state = own.next[state].get(own.ids[word]) if state is not None else None
            assert (state is not None) == (some in parts)


def test_united_spans():
    assert united([(5, 7), (0, 2), (2, 3), (6, 9)]) == [(0, 3), (5, 9)] and united([]) == []
