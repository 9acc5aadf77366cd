"""Lines of text files in file order: their numbers, the first of them, and the records and faults in them.

Spark reads a large file as several byte ranges and tells of each line from
which one it comes. Within a range lines come in order, so a line's place is
its file, the start of its range and its place in the scan. That is enough to
take the first lines. Line numbers also need the number of lines of all ranges
before; as ranges follow from the cores at hand, lines are stored once with
their ranges before they are counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomspark.sources.folders import stored

CORRUPT = "_corrupt"


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, place and text of every line, blank ones too; ``place`` orders them by path and then as they stand in the file."""
    read = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    place = F.struct(path.alias("path"), start.alias("start"), F.monotonically_increasing_id().alias("row"))
    return read.select(path.alias("path"), place.alias("place"), F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, line (from 1) and text of every line of files of any length, blank ones too.

    The lines are stored once. What is counted is one row for each byte range.
    """
    held = stored(lines(spark, paths), "lines")
    ranges = held.groupBy("path", "place.start").agg(F.count("*").alias("_n"), F.min("place.row").alias("_first"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("path", F.col("start").alias("_start"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = held.withColumn("_start", F.col("place.start")).join(starts, ["path", "_start"])
    return found.select("path", (F.col("_before") + F.col("place.row") - F.col("_first") + 1).alias("line"), "text")


def first_lines(spark: SparkSession, paths: str | Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` lines that aren't blank, in the order of the paths and files, with their ordinal from 1; one scan."""
    if limit < 1:
        raise ValueError("the limit is a positive number")
    some = lines(spark, paths).filter(F.trim("text") != "").orderBy("place").limit(limit)
    return some.select("path", F.row_number().over(Window.orderBy("place")).cast("long").alias("ordinal"), "text")


def _fault(schema: StructType, exact: bool) -> tuple[Column, Column]:
    """The record in the column ``text``, and what is wrong with it or null."""
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = F.from_json("text", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    fault = F.when(parsed.isNull() | parsed[CORRUPT].isNotNull(), F.lit("no record"))
    if exact:
        names = F.array(*map(F.lit, schema.fieldNames()))
        own = F.json_object_keys("text")
        fault = fault.when(F.size(F.array_except(own, names)) > 0, F.lit("unknown field")).when(F.size(F.array_except(names, own)) > 0, F.lit("missing field"))
    return parsed, fault


def bad_lines(spark: SparkSession, paths: str | Sequence[str], schema: StructType, exact: bool = False) -> DataFrame:
    """path, line, fault and text of the lines that are no records of the schema; with ``exact``, fields may neither be missing nor unknown."""
    _, fault = _fault(schema, exact)
    found = numbered_lines(spark, paths).filter(F.trim("text") != "").withColumn("fault", fault)
    return found.filter(F.col("fault").isNotNull()).select("path", "line", "fault", "text")


def read_records(spark: SparkSession, paths: str | Sequence[str], schema: StructType, limit: int = 0, exact: bool = False, least: int = 0) -> DataFrame:
    """The records of JSON-lines files, or the first ``limit`` of them in file order.

    Blank lines are skipped. A line among those asked for that is no record of
    the schema raises when it is met, and so do fewer than ``least`` records;
    ``ValueError`` names files and lines. Lines behind the limit aren't looked at.
    """
    some = first_lines(spark, paths, limit) if limit else lines(spark, paths).filter(F.trim("text") != "")
    parsed, fault = _fault(schema, exact)
    rows = some.select(parsed.alias("_r"), fault.alias("_f"), *(["ordinal"] if limit else []))
    checked = rows.agg(F.count("*").alias("n"), F.count("_f").alias("bad")).first()
    if checked.bad:
        named = bad_lines(spark, paths, schema, exact).orderBy("path", "line").limit(5).collect()
        raise ValueError("; ".join(f"{r.path}:{r.line}: {r.fault}" for r in named))
    if checked.n < least:
        raise ValueError(f"{checked.n} records, {least} are needed")
    return rows.select(*(F.col(f"_r.{c}").alias(c) for c in schema.fieldNames()), *(["ordinal"] if limit else []))


def ledger_faults(spark: SparkSession, paths: str | Sequence[str], schema: StructType, key: str, links: str) -> DataFrame:
    """path, line, key and fault of a ledger's lines: no record, a key that an earlier line has, a link to a key that no earlier line has.

    Earlier means by path and then by line. ``links`` is an array of keys. One
    line can have several faults; links that name the same key count once.
    Keys meet by a shuffle: stored lines are so small on disk that Spark would
    broadcast all keys through the driver.
    """
    parsed, fault = _fault(schema, True)
    read = numbered_lines(spark, paths).filter(F.trim("text") != "").select("path", "line", fault.alias("fault"), parsed[key].alias("key"), parsed[links].alias("links"))
    rows = stored(read, "ledger")
    good = rows.filter("fault IS NULL").select("path", "line", "key", "links")
    first = good.groupBy("key").agg(F.min(F.struct("path", "line")).alias("_first")).hint("merge")
    own = F.struct("path", "line")
    twice = good.join(first, "key").filter(own > F.col("_first")).select("path", "line", "key", F.lit("key exists").alias("fault"))
    linked = good.select("path", "line", F.col("key").alias("_key"), F.explode(F.array_distinct("links")).alias("key")).join(first, "key", "left")
    ahead = linked.filter(F.col("_first").isNull() | (F.col("_first") >= own)).select("path", "line", F.col("_key").alias("key"), F.concat(F.lit("links to "), "key").alias("fault"))
    return rows.filter("fault IS NOT NULL").select("path", "line", "key", "fault").unionByName(twice).unionByName(ahead)
