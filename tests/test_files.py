"""Line-exact JSON lines, appends that exclude each other, digests of streams."""

import hashlib
import threading

import pytest
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from loomspark.sources import commits, digests, lines, records

SCHEMA = StructType([StructField("id", LongType()), StructField("name", StringType())])


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def write(path, n, wrong=()):
    text = []
    for i in range(n):
        if i % 9 == 4:
            text.append(" " * (i % 3))
        text.append(wrong[i] if i in wrong else f'{{"id": {i}, "name": "{"x" * (i % 83)}"}}')
    path.write_text("\n".join(text) + "\n")
    return text


def test_lines_keep_their_numbers_over_splits(spark, tmp_path, small_splits):
    (tmp_path / "in").mkdir()
    want = {}
    for name, n in (("b.jsonl", 3000), ("a.jsonl", 5), ("c.jsonl", 700)):
        want |= {(name, i): line for i, line in enumerate(write(tmp_path / "in" / name, n), 1)}
    found = lines.numbered_lines(spark, f"{tmp_path}/in")
    assert spark.read.text(f"{tmp_path}/in").rdd.getNumPartitions() > 20
    assert {(r.path.rsplit("/", 1)[1], r.line): r.text for r in found.collect()} == want
    first = lines.read_records(spark, f"{tmp_path}/in", SCHEMA, limit=1200, exact=True).orderBy("ordinal").collect()
    assert [(r.ordinal, r.id) for r in first] == [(i + 1, i if i < 5 else i - 5) for i in range(1200)]
    assert lines.read_records(spark, f"{tmp_path}/in", SCHEMA).count() == 3705


def test_errors_name_file_and_line(spark, tmp_path, small_splits):
    path = tmp_path / "x.jsonl"
    wrong = {2000: '{"id": "no"', 2100: '{"id": 3}', 2200: '{"id": 3, "name": "a", "more": 1}', 2300: "[1]"}
    text = write(path, 2500, wrong)
    place = {i: text.index(line) + 1 for i, line in wrong.items()}
    with pytest.raises(ValueError, match=f"x.jsonl:{place[2000]}: no record"):
        records.read_json_lines(spark, str(path), SCHEMA)
    got = {r.line: r.fault for r in lines.bad_lines(spark, str(path), SCHEMA, exact=True).collect()}
    assert got == {place[2000]: "no record", place[2100]: "missing field", place[2200]: "unknown field", place[2300]: "no record"}
    assert lines.read_records(spark, str(path), SCHEMA, limit=1500).count() == 1500  # what is wrong behind the limit doesn't count
    with pytest.raises(ValueError, match="2 are needed"):
        lines.read_records(spark, str(path), SCHEMA, limit=1, least=2)
    with pytest.raises(ValueError, match="positive"):
        lines.first_lines(spark, str(path), -1)
    path.write_text("\n \n")
    assert records.read_json_lines(spark, str(path), SCHEMA).count() == 0
    path.write_text('{"id": 1, "name": "a"}\n{"id": 1, "name": "b"}\n')
    with pytest.raises(ValueError, match="twice"):
        records.read_json_lines(spark, str(path), SCHEMA, ["id"])


def test_ledger_faults(spark, tmp_path):
    schema = StructType().add("key", "string").add("links", ArrayType(StringType()))
    rows = ['{"key": "a", "links": []}', "", '{"key": "b", "links": ["a", "a", "b", "c"]}', '{"key": "a", "links": ["b"]}', '{"key": "c", "links": null}', "{", '{"key": "d"}']
    (tmp_path / "l.jsonl").write_text("\n".join(rows))
    got = sorted((r.line, r.key, r.fault) for r in lines.ledger_faults(spark, f"{tmp_path}/l.jsonl", schema, "key", "links").fillna("-", ["key"]).collect())
    assert got == [(3, "b", "links to b"), (3, "b", "links to c"), (4, "a", "key exists"), (6, "-", "no record"), (7, "d", "missing field")]


def test_ledger_faults_broadcast_no_keys(spark, tmp_path):
    schema = StructType().add("key", "string").add("links", ArrayType(StringType()))
    (tmp_path / "l.jsonl").write_text("\n".join(f'{{"key": "{i}", "links": []}}' for i in range(100)))
    found = lines.ledger_faults(spark, f"{tmp_path}/l.jsonl", schema, "key", "links")
    assert found.count() == 0 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def together(*jobs):
    """Runs the jobs at the same time; what each returned or raised."""
    found = [None] * len(jobs)

    def run(i):
        try:
            found[i] = jobs[i]()
        except Exception as error:  # noqa: BLE001
            found[i] = error

    threads = [threading.Thread(target=run, args=(i,)) for i in range(len(jobs))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    return found


@pytest.mark.parametrize("format", ["json", "parquet"])
def test_of_two_writers_one_is_first_and_none_is_lost(spark, tmp_path, format):
    frame = lambda *ids: spark.createDataFrame([(i, f"n{i}") for i in ids], SCHEMA)
    folder, meet = f"{tmp_path}/t", threading.Barrier(2)
    tries = threading.local()

    def both_at_once(new, old):
        if not getattr(tries, "done", False):  # both have checked before either commits
            tries.done = True
            meet.wait(120)

    append = lambda rows: lambda: commits.append(rows, folder, ["id"], both_at_once, format)
    assert sorted(together(append(frame(1, 2)), append(frame(3)))) == [1, 2]
    assert sorted(r.id for r in commits.read_committed(spark, folder, SCHEMA, format).collect()) == [1, 2, 3]
    a, b = together(append(frame(4)), append(frame(4, 5)))
    won, lost = (a, b) if isinstance(a, int) else (b, a)
    assert won == 3 and isinstance(lost, ValueError) and "exist" in str(lost)
    kept = sorted(r.id for r in commits.read_committed(spark, folder, SCHEMA, format).collect())
    assert kept in ([1, 2, 3, 4], [1, 2, 3, 4, 5]) and len(commits.commits(spark, folder)) == 3
    assert len(list((tmp_path / "t/data").iterdir())) == 3


def test_refused_appends_leave_nothing(spark, tmp_path):
    folder = f"{tmp_path}/t"
    frame = lambda rows: spark.createDataFrame(rows, "id string, supersedes array<string>")
    check = commits.links_exist("id", "supersedes")
    assert commits.read_committed(spark, folder, frame([("x", [])]).schema).count() == 0
    assert records.append_json_lines(frame([("a", [])]), folder, ["id"], check) == 1
    for rows, what in (([("b", ["c"])], "don't exist"), ([("b", []), ("b", [])], "twice"), ([("a", [])], "exist")):
        with pytest.raises(ValueError, match=what):
            records.append_json_lines(frame(rows), folder, ["id"], check)
    assert records.append_json_lines(frame([("b", ["a"])]), folder, ["id"], check) == 2
    assert sorted(r.id for r in commits.read_committed(spark, folder, frame([("x", [])]).schema, "json").collect()) == ["a", "b"]
    assert commits.create_if_absent(spark, f"{tmp_path}/one", "x") and not commits.create_if_absent(spark, f"{tmp_path}/one", "y")
    assert (tmp_path / "one").read_text() == "x"


def test_digests_of_files_over_two_gigabytes(spark, tmp_path):
    want = {}
    for name, size in (("large", (1 << 31) + 4097), ("empty", 0), ("small", 3)):
        with open(tmp_path / name, "wb") as out:
            out.write(b"abc"[: min(size, 3)])
            out.truncate(size)
        with open(tmp_path / name, "rb") as held:
            want[name] = (size, hashlib.file_digest(held, "sha256").hexdigest())
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in digests.file_digests(spark, str(tmp_path), 1).collect()}
    assert got == {name: found for name, found in want.items() if name != "empty"}
