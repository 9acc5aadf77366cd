"""Chat formatting, exact dedup and source mixing: SQL on the tables, plain Python on odd rows."""

import hashlib

import duckdb
import pytest

from loomspark.llm import exact_dedup as exact
from loomspark.llm import mixing, oracles, queries
from loomspark.llm.chat import rotate_perspectives
from loomspark.llm.exact_dedup import drop_copies, exact_dedup
from loomspark.llm.mixing import keep_mixed, mix
from loomspark.llm.ngram_join import keep_one_of_each

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    found, want = queries.queries()[name](spark, FOLDER), duck.sql(oracles.oracle_sql()[name])
    order = sorted(found.columns)
    assert order == sorted(want.columns)
    rows = lambda columns, rs: sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in rs)
    assert rows(found.columns, found.collect()) == rows(want.columns, want.fetchall())


def render(turns, me):
    out, spans, at = "", [], 0
    for _, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0], t[1] or "unknown", t[2] or "")):
        name, said = role or "unknown", text or ""
        head = "<|im_start|>" + ("assistant" if name == me else f"user name={name}") + "\n"
        if name == me:
            spans.append((at + len(head), at + len(head) + len(said)))
        out += head + said + "<|im_end|>\n"
        at = len(out)
    return out, spans


def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 1, "bob", None), (1, 2, None, ""), (1, None, "ann", "x"), (1, 3, "ann", "é😀" * 50), (2, 0, "bob", "y" * 200_000), (None, 0, "bob", "z"), (None, 1, "cat", "w"), (3, 5, None, None)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = {}
    for r in rotate_perspectives(turns, 2).collect():
        got.setdefault((r.conv_id, r.speaker), []).append(r)
    assert got.keys() == {(c, role or "unknown") for c, _, role, _ in rows}
    for (conv, me), parts in got.items():
        parts.sort(key=lambda r: r.part)
        text, spans = render([r[1:] for r in rows if r[0] == conv], me)
        assert "".join(p.rendered for p in parts) == text
        assert [(p.start + a, p.start + b) for p in parts for a, b in zip(p.mask_starts, p.mask_ends, strict=True)] == spans
        assert sum(p.n_turns for p in parts) == sum(r[0] == conv for r in rows) and sum(p.n_own for p in parts) == len(spans)
    assert rotate_perspectives(turns.limit(0)).count() == 0


def test_crowded_parts_are_cut(spark):
    rows = [("a", None, "u", f"n{i % 7}") for i in range(23)] + [("a", 0, "v", "same")] * 11 + [("a", i, "w", str(i)) for i in range(12)]
    rows += [(None, i % 5, "uv"[i % 2], f"t{i}") for i in range(40)] + [("b", i, "u", "x") for i in range(10)]
    got = {}
    for r in rotate_perspectives(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"), 4).collect():
        assert r.n_turns <= 4
        got.setdefault((r.conv_id, r.speaker), []).append(r)
    assert got.keys() == {(c, role) for c, _, role, _ in rows}
    for (conv, me), parts in got.items():
        parts.sort(key=lambda r: r.part)
        assert len({p.part for p in parts}) == len(parts)
        text, spans = render([r[1:] for r in rows if r[0] == conv], me)
        assert "".join(p.rendered for p in parts) == text
        assert [(p.start + a, p.start + b) for p in parts for a, b in zip(p.mask_starts, p.mask_ends, strict=True)] == spans
    assert sorted(p.part for p in got["b", "u"]) == [0, 1, 2]


ODD = [(5, "a", "s"), (9, "a", "s"), (7, "a", None), (1, None, "s"), (2, "", "t"), (3, " ", "t"), (None, "a", "s"), (None, "b", "s"), (4, "é", "s"), (6, "é", "s"), (8, "x" * 300_000, "u"), (10, "x" * 300_000, "u"), (9, "a", "s"), (11, "c", "s"), (11, "c", "s")]


@pytest.mark.parametrize(("fan_in", "bucket"), [(4, 2048), (2, 2), (3, 1)])
def test_exact_dedup_of_odd_rows(spark, tmp_path, monkeypatch, fan_in, bucket):
    monkeypatch.setattr(exact, "BUCKET", bucket)
    spark.createDataFrame([(*r, 1, 2) for r in ODD], "doc_id long, text string, source string, run int, row_no int").repartition(7).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    groups = {}
    for doc_id, text, _ in ODD:
        groups.setdefault(text or "", []).append(doc_id)
    got = exact_dedup(docs, fan_in).collect()
    assert len(got) == len(ODD)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        t = by_digest[r.text_sha256]
        assert (r.keep_id, r.group_size) == (best[t], len(groups[t])) and (not r.kept or r.doc_id == best[t])
    assert sorted(by_digest[r.text_sha256] for r in got if r.kept) == sorted(groups)
    kept = drop_copies(docs, fan_in)
    assert kept.columns == docs.columns and sorted(((r.text or "") for r in kept.collect())) == sorted(groups)
    assert exact_dedup(docs.limit(0)).count() == drop_copies(docs.limit(0)).count() == 0


def test_exact_dedup_reads_its_table_once_and_splits_may_change(spark, tmp_path):
    rows = [(i, f"text {i % 37}") for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(f"{tmp_path}/d")
    name, docs = "spark.sql.files.maxPartitionBytes", spark.read.parquet(f"{tmp_path}/d")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set(name, "1000")
        found, kept = exact_dedup(docs), drop_copies(docs)
        spark.conf.set(name, "100000000")
        got = found.collect()
        assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, 463 + (i - 463) % 37, len(range(i % 37, 500, 37)), i >= 463) for i in range(500)}
        assert sorted(r.doc_id for r in kept.collect()) == list(range(463, 500))
    finally:
        spark.conf.unset(name)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_columns_of_any_name_come_back(spark):
    rows = [(i, "abcd"[i % 4] * 9 + " w" * (i % 5), "st"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = "_row_no _place _copy _low _passes _rest _repeats _salt _dealt _source _part row_no run rep c0 C1 score _own_score _score kept".split()
    more = docs.selectExpr("*", *(f"doc_id AS `{c}`" for c in odd))
    for keep in (drop_copies, keep_mixed, keep_one_of_each):
        kept = keep(more)
        assert kept.columns == more.columns
        got = kept.collect()
        assert got and all(r[c] == r.doc_id for r in got for c in odd) and {tuple(r)[:3] for r in got} <= set(rows)


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_ = {}, set(names)
    left = sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: float(cap * sizes[s]) for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return out


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), s) for i, s in enumerate(["a"] * 400 + ["b"] * 30 + ["c"] * 100 + ["d"] * 5 + [None] * 60)]
    rows += [(900, None, "a"), (901, "", "zero"), (902, "w " * 3000, "c"), (5, "w w", "a"), (None, "w", "b")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, repeats int")
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want, taken, got = targets(sizes), {}, mix(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken == r.repeats * r.size <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, target in want.items():
        most = max(len((t or "").split()) for _, t, s in rows if s == source)
        assert abs(taken[source] - target) <= most
    again = sorted((r.doc_id or -1, r.source or "", r.size, r.taken) for r in mix(docs.repartition(5)).collect())
    assert again == sorted((r.doc_id or -1, r.source or "", r.size, r.taken) for r in got)
    kept = keep_mixed(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.repeats for r in got)
    assert mix(docs.limit(0)).count() == keep_mixed(docs.limit(0)).count() == 0


def test_mix_with_more_sources_than_are_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 5), f"s{i % 9}") for i in range(300)], "doc_id long, text string, source string")
    want = sorted(map(tuple, mix(docs).collect()))
    monkeypatch.setattr(mixing, "SMALL", 3)
    assert sorted(map(tuple, mix(docs).collect())) == want
