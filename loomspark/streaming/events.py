"""Streams: windows over event time, an event log, and the ledger's state of each record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def windowed_counts(events: DataFrame, at: str, kind: str, value: str, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Number and sum per window and kind; events later than ``late`` behind the newest are left out in a stream."""
    own = F.window(at, window, slide) if slide else F.window(at, window)
    found = events.withWatermark(at, late).groupBy(own, kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """Runs of a key's events with pauses below ``gap``."""
    found = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_of_each(events: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """Drops events whose keys were seen within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def append_log(events: DataFrame, log: str, latest: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to a log and writes the newest event of each key of the batch beside it.

    A batch that is run again overwrites its own folder, so nothing is logged twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        newest = batch.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{latest}/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, latest: str, key: str, order: str) -> DataFrame:
    """The newest event of each key over all batches."""
    rows = spark.read.parquet(latest).drop("batch")
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
