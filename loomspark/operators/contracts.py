"""Contracts on how many rows of which kind a group has, checked in the pass that writes the rows."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomspark.sources import commits


def by_pattern(rows: DataFrame, keys: Sequence[str], path: str, kinds: Mapping[str, tuple[str, int]]) -> DataFrame:
    """The rows whose path matches a pattern, with their kind and what is wrong with their group.

    ``kinds`` gives a name, a regular expression for the whole path and the
    exact number of rows that each group needs; the first kind that matches
    counts and other rows are left out. ``fault`` names a path that occurs twice
    in its group or the first kind with another number of rows, else it is null.
    A group without any row that matches isn't there to have a fault.
    """
    kind = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(kinds.items()):
        kind = F.when(F.col(path).rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    some = rows.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    own = Window.partitionBy(*keys)
    some = some.withColumn("_copies", F.count("*").over(Window.partitionBy(*keys, path)))
    fault = F.when(F.max("_copies").over(own) > 1, F.lit("a path occurs twice"))
    for name, (_, number) in kinds.items():
        n = F.count_if(F.col("kind") == name).over(own)
        fault = fault.when(n != number, F.concat(F.lit(f"{number} {name} needed, found "), n.cast("string")))
    return some.withColumn("fault", fault).drop("_copies")


def append_observed(rows: DataFrame, folder: str, keys: Sequence[str], broken: Column, format: str = "parquet") -> int:
    """Appends ``rows`` as a commit (see :mod:`loomspark.sources.commits`) unless one of them is ``broken``.

    The write itself counts rows and broken ones; no other job reads the rows.
    Keys are checked against what is there, as in every append.
    """
    name = f"contract-{uuid.uuid4().hex}"
    seen = Observation(name)
    watched = rows.observe(seen, F.count("*").alias("n"), F.count_if(F.coalesce(broken, F.lit(True))).alias("broken"))

    def check(new: DataFrame, old: DataFrame) -> None:
        if seen.get["broken"]:
            raise ValueError(f"{seen.get['broken']} of {seen.get['n']} rows break the contract")

    return commits.append(watched, folder, keys, check, format)


def relabelled(rows: DataFrame, labels: str, evidence: Column, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    """Gives the channels in the array ``labels`` the names ``new`` where they are named ``old`` and the evidence holds.

    ``old_labels`` keeps what they were called and ``relabelled`` says whether
    they changed. Other names, or no evidence (null is none), change nothing.
    """
    if len(old) != len(new):
        raise ValueError("there are as many new names as old ones")
    names = lambda xs: F.array(*map(F.lit, xs))
    fits = F.coalesce(evidence & (F.col(labels) == names(old)), F.lit(False))
    return rows.withColumn("old_labels", F.col(labels)).withColumn("relabelled", fits).withColumn(labels, F.when(fits, names(new)).otherwise(F.col(labels)))
