"""Repeated strings against a table of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import suffix_dedup
from loomspark.llm.suffix_dedup import LoserTree, decoded, front_coded, remove_repeats


def brute_force(rows, span=200):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if times[t[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((doc_id, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n, kinds="abcdefgh é": "".join(rnd.choice(kinds) for _ in range(n))
    shared = [text(n) for n in (150, 199, 200, 201, 260, 330, 700)]
    rows = [(0, None), (1, ""), (2, "x" * 1000), (3, "xy" * 300), (None, "x" * 199), (5, "x" * 200), (6, text(199)), (7, shared[4] * 3)]
    for i in range(60):
        parts = [text(rnd.randint(0, 300)) for _ in range(3)]
        for _ in range(2):
            s = rnd.choice(shared)
            a, b = sorted((rnd.randint(0, len(s)), rnd.randint(0, len(s))))
            parts.insert(rnd.randint(0, len(parts)), s if rnd.random() < 0.5 else s[a:b])
        rows.append((10 + i, "".join(parts)))
    base = text(1500)
    for i in range(40):
        at = rnd.randrange(1500)
        rows.append((100 + i, text(rnd.randint(0, 5)) + base[:at] + "#" + base[at + 1 :]))
    return rows + [rows[12], rows[12], (rows[13][0] + 500, rows[13][1])]


@pytest.mark.parametrize(("seed", "bits", "rows_of_bucket", "pairs"), [(1, 10, 20_000, 24), (2, 3, 50, 24), (3, 4, 30, 2)])
def test_against_all_strings(spark, tmp_path, seed, bits, rows_of_bucket, pairs):
    rows = corpus(seed)
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, batch int").repartition(3).write.parquet(f"{tmp_path}/docs")
    got = remove_repeats(spark.read.parquet(f"{tmp_path}/docs"), True, bits, rows_of_bucket, pairs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_force(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize(("seed", "bits", "most"), [(1, 10, 2), (2, 3, 8), (3, 4, 30)])
def test_cores_of_many_contexts_against_all_strings(spark, tmp_path, seed, bits, most):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    line, passage = text(100), text(260)
    rows = corpus(seed) + [(1000 + i, text(rnd.randint(90, 200)) + (line, passage)[i % 5 == 0] + text(rnd.randint(90, 200))) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    got = remove_repeats(spark.read.parquet(f"{tmp_path}/docs"), True, bits, 50, 24, most).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_force(rows)


def test_no_bucket_gets_a_hot_core():
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n)).encode()
    line = text(190)
    raw = [text(100) + line + text(100) for _ in range(50)]
    data, borders = np.frombuffer(b"".join(raw), np.uint8), np.arange(51) * 390
    hashes, times = np.unique(suffix_dedup.core_hashes(data, suffix_dedup.anchors(data, borders)[0]), return_counts=True)
    packed = next(suffix_dedup._packed(iter([pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([t.decode() for t in raw]), pa.array(range(50))], ["row_no", "text", "doc_id"])]), 10))
    flagged = pa.table({"batch": pa.array(np.zeros(len(hashes), np.int64)), "hash": pa.array(hashes), "hot": pa.array(times > 20)}).filter(pa.array(times > 1))
    runs = suffix_dedup._runs(pa.Table.from_batches([packed]), flagged, 4, 10).to_pylist()
    assert sum(1 for _ in decoded(next(r["run"] for r in runs if r["bucket"] == -2))) >= 50
    assert all(sum(1 for _ in decoded(r["run"])) <= 20 for r in runs if r["bucket"] >= 0)


def test_splits_that_change_between_jobs(spark, tmp_path):
    rows = corpus(6)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/docs")
    found = remove_repeats(spark.read.parquet(f"{tmp_path}/docs"), True, 3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = found.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_force(rows)


def test_batches_are_bounded_by_bytes_too(spark, tmp_path):
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    passage = text(900)
    rows = [(i, text(150_000) + passage + text(1000 + i)) for i in range(4)] + [(i, f"short {i} {passage[i:250 + i]}") for i in range(4, 40)] + [(90, None), (91, "")]
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    spark.conf.set(name, "200000")
    try:
        packed = docs.selectExpr("monotonically_increasing_id() AS row_no", "text", "doc_id").mapInArrow(lambda x: suffix_dedup._packed(x, 10), suffix_dedup.PACKED).collect()
        assert len({r.batch for r in packed}) == len(packed) > 2 and max(r["size"] for r in packed) < 400_000
        got = remove_repeats(docs, texts=False).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_force(rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_loser_tree_merges_with_shared_lengths():
    rnd = random.Random(4)
    runs, every = [], []
    for _ in range(9):
        some = sorted({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(1, 30))})
        runs.append(front_coded([(s, b"f" * i, i, 1) for i, s in enumerate(some)]))
        assert [e[0] for e in decoded(runs[-1])] == some
        every += some
    got = list(LoserTree([decoded(r) for r in runs]))
    assert [e[0] for _, _, e in got] == sorted(every)
    for (_, _, a), (_, shared, b) in zip(got, got[1:]):
        assert b[0][:shared] == a[0][:shared] and (len(a[0]) == shared or len(b[0]) == shared or a[0][shared] != b[0][shared])
