"""Readers and writers of records: JSON lines, CSV with a header, Parquet parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspark.operators.gates import repeated_keys, require_none
from loomspark.sources import commits
from loomspark.sources.lines import read_records


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: StructType, keys: Sequence[str] = (), limit: int = 0, exact: bool = False) -> DataFrame:
    """Records of JSON-lines files under an explicit schema, or the first ``limit`` of them.

    A line that isn't a record of the schema raises with its file and number,
    and so does a key that occurs twice. Blank lines are skipped.
    """
    rows = read_records(spark, paths, schema, limit, exact).select(*schema.fieldNames())
    if keys:
        require_none(repeated_keys(rows, keys), "keys that occur twice")
    return rows


def append_json_lines(rows: DataFrame, folder: str, keys: Sequence[str], check: commits.Check | None = None) -> int:
    """Appends records whose keys are new as one commit; a known or repeated key raises and nothing counts, whoever else appends meanwhile."""
    return commits.append(rows, folder, keys, check, "json")


def read_csv(spark: SparkSession, path: str, schema: StructType, least_rows: int = 1) -> DataFrame:
    """A CSV file whose header has to name the schema's columns, in any order."""
    header = spark.read.option("header", True).csv(path).columns
    if sorted(header) != sorted(schema.fieldNames()):
        raise ValueError(f"the header is {header}")
    by_name = {f.name: f for f in schema.fields}
    rows = spark.read.option("header", True).schema(StructType([by_name[c] for c in header])).csv(path)
    if rows.limit(least_rows).count() < least_rows:
        raise ValueError(f"fewer than {least_rows} rows")
    return rows.select(*schema.fieldNames())


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)


def read_parts(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Some columns of Parquet files, all of which have to be there; only they are read."""
    rows = spark.read.parquet(path)
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    return rows.select(*columns)


def write_parts(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    rows.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def union_checked(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The rows of tables of one schema; a key in two of them raises."""
    out = parts[0]
    for part in parts[1:]:
        if sorted(part.dtypes) != sorted(out.dtypes):
            raise ValueError(f"{part.dtypes} is not {out.dtypes}")
        out = out.unionByName(part)
    require_none(repeated_keys(out, keys), "keys that occur twice")
    return out


def rows_from_csv_text(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """One row per non-blank line of CSV text."""
    lines = rows.select(F.explode(F.split(column, "\n")).alias("line")).filter(F.length(F.trim("line")) > 0)
    return lines.select(F.from_csv("line", schema, {"ignoreLeadingWhiteSpace": "true"}).alias("r")).select("r.*")
