"""The append-only ledger: records that later ones supersede."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(records: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Records that no record supersedes; ``supersedes`` is an array of keys."""
    gone = records.select(F.explode(supersedes).alias(key)).distinct()
    return records.join(gone, key, "left_anti")


def unknown_references(records: DataFrame, key: str, supersedes: str, order: str) -> DataFrame:
    """References to keys that no earlier record has."""
    wanted = records.select(F.col(key).alias("by"), F.col(order).alias("_at"), F.explode(supersedes).alias("wanted"))
    own = records.select(F.col(key).alias("wanted"), F.col(order).alias("_before"))
    found = wanted.join(own, "wanted", "left")
    return found.filter(F.col("_before").isNull() | (F.col("_before") >= F.col("_at"))).select("by", "wanted")


def status_counts(records: DataFrame, key: str, supersedes: str, status: str, domain: Sequence[str]) -> DataFrame:
    """For every status of the domain the records and the active records, 0 where there are none."""
    alive = active(records, key, supersedes).select(key).withColumn("_alive", F.lit(True))
    marked = records.join(alive, key, "left").withColumn("_alive", F.coalesce("_alive", F.lit(False)))
    counted = marked.groupBy().agg(
        *(F.count_if(F.col(status) == s).alias(f"_a{i}") for i, s in enumerate(domain)),
        *(F.count_if((F.col(status) == s) & F.col("_alive")).alias(f"_b{i}") for i, s in enumerate(domain)),
    )
    rows = F.array(*(F.struct(F.lit(s).alias("status"), F.col(f"_a{i}").alias("history"), F.col(f"_b{i}").alias("active")) for i, s in enumerate(domain)))
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def record_rules(required_by_status: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Rules of a record: a safe id, a time with an offset, and arrays that mustn't be empty for some status."""
    rules = {
        "id": F.col("record_id").rlike(r"^[a-z0-9][a-z0-9._-]*$"),
        "time": F.col("recorded_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$") & F.try_to_timestamp("recorded_at").isNotNull(),
        "summary": F.length(F.trim("summary")) > 0,
    }
    for status, columns in required_by_status.items():
        for c in columns:
            rules[f"{status}_{c}"] = (F.col("status") != status) | (F.size(c) > 0)
    return rules


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last."""
    every = F.struct(F.col(order).alias("_order"), *(F.col(c) for c in rows.columns if c != key))
    best = rows.groupBy(key).agg(F.max_by(every, order).alias("_r"))
    return best.select(*(F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns))
