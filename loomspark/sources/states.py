"""A store of states: numbered, never changed, checked when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.gates import require_none
from loomspark.sources import commits


def append_states(states: DataFrame, folder: str, thread: str = "thread", number: str = "number", state: str = "state") -> int:
    """Appends states (JSON texts) with their digests as one commit; a number that its thread has already raises, whoever else appends meanwhile."""
    rows = states.select(thread, number, state).withColumn("state_sha256", F.sha2(F.col(state).cast("binary"), 256))
    return commits.append(rows, folder, [thread, number])


def read_states(spark: SparkSession, folder: str, state: str = "state") -> DataFrame:
    """All states that were committed; one that doesn't fit its digest raises."""
    parts = [f"{folder}/{data}" for _, data in commits.commits(spark, folder)]
    rows = spark.read.parquet(*parts)
    require_none(rows.filter(F.sha2(F.col(state).cast("binary"), 256) != F.col("state_sha256")).drop(state), "states that were changed")
    return rows


def latest_states(spark: SparkSession, folder: str, thread: str = "thread", number: str = "number") -> DataFrame:
    """The state of the highest number of each thread."""
    return read_states(spark, folder).groupBy(thread).agg(F.max_by(F.struct("*"), number).alias("s")).select("s.*")
