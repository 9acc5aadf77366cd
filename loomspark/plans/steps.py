"""Plans of named steps, each written as Parquet and read again; finished steps are not run twice."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Step:
    """A step makes a table from the tables of the steps that it needs."""

    name: str
    needs: Sequence[str]
    make: Callable[[SparkSession, Mapping[str, DataFrame]], DataFrame]


def ordered(steps: Sequence[Step], given: Sequence[str] = ()) -> list[Step]:
    """The steps, each after those it needs; an unknown, repeated or circular need raises."""
    if len({s.name for s in steps} | set(given)) < len(steps) + len(given):
        raise ValueError("a name occurs twice")
    done, left, out = set(given), list(steps), []
    while left:
        ready = [s for s in left if set(s.needs) <= done]
        if not ready:
            raise ValueError(f"nothing can run before {sorted(s.name for s in left)}")
        out += ready
        done |= {s.name for s in ready}
        left = [s for s in left if s not in ready]
    return out


def run(spark: SparkSession, steps: Sequence[Step], folder: str, given: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Runs the steps whose tables aren't in ``folder`` yet and returns all tables. A table counts once its writer has succeeded."""
    tables = dict(given)
    for step in ordered(steps, list(given)):
        path = f"{folder}/{step.name}"
        try:
            spark.read.text(f"{path}/_SUCCESS")
        except AnalysisException:
            step.make(spark, {n: tables[n] for n in step.needs}).write.mode("overwrite").parquet(path)
        tables[step.name] = spark.read.parquet(path)
    return tables
