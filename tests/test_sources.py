"""Sources, sinks, streams and plans."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomspark.plans.steps import Step, ordered, run
from loomspark.sources import records
from loomspark.streaming import events

SCHEMA = StructType([StructField("id", LongType()), StructField("name", StringType())])


def test_csv(spark, tmp_path):
    records.write_csv(spark.createDataFrame([(1, "a,b"), (2, None)], SCHEMA), f"{tmp_path}/t")
    assert sorted((r.id, r.name) for r in records.read_csv(spark, f"{tmp_path}/t", SCHEMA, 2).collect()) == [(1, "a,b"), (2, None)]
    with pytest.raises(ValueError, match="fewer"):
        records.read_csv(spark, f"{tmp_path}/t", SCHEMA, 3)
    with pytest.raises(ValueError, match="header"):
        records.read_csv(spark, f"{tmp_path}/t", StructType(SCHEMA.fields[:1]))
    text = spark.createDataFrame([("0, A100, 17\n1, H100, 5\n",)], "out string")
    assert [tuple(r) for r in records.rows_from_csv_text(text, "out", "i int, name string, used int").collect()] == [(0, "A100", 17), (1, "H100", 5)]


def test_parts_and_digests(spark, tmp_path):
    records.write_parts(spark.range(10).withColumn("k", F.col("id") % 2), f"{tmp_path}/p", ["k"])
    found = records.read_parts(spark, f"{tmp_path}/p", ["id", "k"])
    assert found.filter("k = 1").count() == 5
    with pytest.raises(ValueError, match="no columns"):
        records.read_parts(spark, f"{tmp_path}/p", ["none"])
    one = spark.createDataFrame([(1, "a")], SCHEMA)
    with pytest.raises(ValueError, match="twice"):
        records.union_checked([one, one], ["id"])


def test_streams(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(1, at(0), "a", 1.0), (2, at(3), "a", 2.0), (3, at(7), "b", 4.0), (4, at(59), "a", 8.0)]
    frame = spark.createDataFrame(rows, "id long, ts timestamp, kind string, value double")
    frame.write.parquet(f"{tmp_path}/in")
    stream = events.read_stream(spark, f"{tmp_path}/in", frame.schema, 1)
    q = events.windowed_counts(stream, "ts", "kind", "value", "5 minutes", "10 minutes").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start.minute, r.kind): (r.n, r.total) for r in spark.table("counted").collect()}
    assert got == {(0, "a"): (2, 3.0), (5, "b"): (1, 4.0), (55, "a"): (1, 8.0)}
    log = events.append_log(stream, f"{tmp_path}/log", f"{tmp_path}/latest", "kind", "ts", f"{tmp_path}/check")
    log.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    assert {r.kind: r.id for r in events.latest_state(spark, f"{tmp_path}/latest", "kind", "ts").collect()} == {"a": 4, "b": 3}
    assert {(r.kind, r.n) for r in events.sessions(frame, "ts", "kind", "10 minutes", "1 hour").collect()} == {("a", 2), ("a", 1), ("b", 1)}


def test_plans_run_each_step_once(spark, tmp_path):
    ran = []

    def make(name, f):
        def step(session, tables):
            ran.append(name)
            return f(tables)

        return step

    steps = [
        Step("twice", ["some"], make("twice", lambda t: t["some"].withColumn("id", F.col("id") * 2))),
        Step("some", ["given"], make("some", lambda t: t["given"].filter("id > 1"))),
    ]
    for _ in range(2):
        got = run(spark, steps, f"{tmp_path}/plan", {"given": spark.range(4)})
        assert sorted(r.id for r in got["twice"].collect()) == [4, 6]
    assert ran == ["some", "twice"]
    with pytest.raises(ValueError, match="nothing can run"):
        ordered([Step("a", ["b"], make("a", None)), Step("b", ["a"], make("b", None))])
