"""Every query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from loomspark.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in TABLES:
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return found


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((repr([plain(r[i]) for i in order]) for r in rows))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    found, want = QUERIES[name](spark, FOLDER), duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_again_alike(spark, name):
    first, second = QUERIES[name](spark, FOLDER), QUERIES[name](spark, FOLDER)
    rows = rows_of(first.columns, first.collect())
    assert rows and rows == rows_of(second.columns, second.collect())
