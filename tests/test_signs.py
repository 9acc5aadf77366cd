"""Queries whose rounded values may be a negative zero, digit by digit against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspark.functions import scalar
from loomspark.queries import ORACLES, QUERIES


def test_rounded(spark):
    values = [-1e-9, 1e-9, -0.0, 0.0, 0.125, -0.125, 1.005, -2.5e-3, 1e308, float("inf"), float("nan")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.x for r in rows.select("i", scalar.rounded(F.col("v"), 2).alias("x")).orderBy("i").collect()]
    assert list(map(repr, got)) == ["-0.0", "0.0", "-0.0", "0.0", "0.13", "-0.13", "1.0", "-0.0", "1e+308", "inf", "nan"]
    assert spark.range(1).select(scalar.rounded(F.lit(None).cast("double"), 2).alias("x")).first().x is None


@pytest.fixture(scope="module")
def tiny(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tiny")
    vectors = "list_transform(range(64), lambda i: CAST(sin(v * 64 + i) * CASE WHEN (v + i) % 3 = 0 THEN 1e-7 ELSE 0.2 END AS FLOAT))"
    duckdb.sql(f"COPY (SELECT v AS vec_id, {vectors} AS embedding, CAST(v % 2 AS INTEGER) AS label FROM range(40) r(v)) TO '{folder}/embeddings.parquet'")
    duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i % 2 AS user_id, 'a' AS event_type, CASE WHEN i % 3 = 0 THEN 45 - 1e-7 ELSE 45 + (i % 5 - 2) * 1e-8 END AS value FROM range(20) r(i)) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize(("name", "tables"), [("clamp_limits", ["embeddings"]), ("clamped_walk", ["events"]), ("fan_out", ["embeddings"]), ("rebased_turns", ["embeddings"])])
def test_same_signs_as_sql(spark, tiny, name, tables):
    duck = duckdb.connect()
    for t in tables:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    found, want = QUERIES[name](spark, tiny), duck.sql(ORACLES[name])
    names = sorted(found.columns)
    plain = lambda rows, columns: sorted(repr([list(v) if isinstance(v, (list, tuple)) else v for v in (r[columns.index(c)] for c in names)]) for r in rows)
    got = plain(found.collect(), found.columns)
    assert got == plain(want.fetchall(), want.columns)
    assert any("-0.0," in r or "-0.0]" in r for r in got)
