"""Estimates that iterate or enumerate inside one group: assignments."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _types(rows: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def best_permutation(rows: DataFrame, keys: Sequence[str], source: str, target: str, cost: str, margin: float, most: int = 6) -> DataFrame:
    """Per group of up to ``most`` sources and as many targets the cheapest pairing, and whether it beats the straight one by the margin.

    Sources and targets go by their order; of several costs of a pair the least
    counts, and of equally cheap pairings the first. A group that isn't square or
    lacks a cost has nulls; a larger one is an error.
    """
    held = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_set(source)).alias("_s"), F.array_sort(F.collect_set(target)).alias("_t"), F.collect_list(F.struct(F.col(source).alias("a"), F.col(target).alias("b"), F.col(cost).cast("double").alias("c"))).alias("_c")
    )
    cell = lambda s, t: F.array_min(F.transform(F.filter("_c", lambda c: (c["a"] == s) & (c["b"] == t)), lambda c: c["c"]))
    grid = F.flatten(F.transform("_s", lambda s: F.transform("_t", lambda t: cell(s, t))))
    held = held.withColumn("_g", grid).withColumn("_n", F.size("_s"))
    bound = F.raise_error(F.concat(F.lit(f"a group is larger than the bound of {most}: "), F.col("_n").cast("string"))).cast("int")
    held = held.withColumn("_n", F.when(F.greatest("_n", F.size("_t")) > most, bound).otherwise(F.col("_n")))
    square = (F.size("_t") == F.col("_n")) & ~F.exists("_g", lambda x: x.isNull())
    orders, straight = F.lit(None).cast("array<array<int>>"), F.aggregate(F.sequence(F.lit(0), F.col("_n") - 1), F.lit(0.0), lambda t, i: t + F.col("_g")[i * F.col("_n") + i])
    for n in range(1, most + 1):
        every = F.array(*(F.array(*map(F.lit, p)) for p in itertools.permutations(range(n))))
        orders = F.when(square & (F.col("_n") == n), every).otherwise(orders)
    total = lambda p: F.aggregate(F.sequence(F.lit(0), F.col("_n") - 1), F.lit(0.0), lambda t, i: t + F.col("_g")[i * F.col("_n") + p[i]])
    best = F.array_min(F.transform(orders, lambda p: F.struct(total(p).alias("least"), p.alias("pairing"))))
    found = held.withColumn("_b", best).withColumn("straight", F.when(F.col("_b").isNotNull(), straight))
    return found.select(*keys, "_b.pairing", "_b.least", "straight", (F.col("straight") - F.col("_b.least") > margin).alias("swapped"))


def least_distance(points: DataFrame, keys: Sequence[str], label: str, coordinates: Sequence[str]) -> DataFrame:
    """The least distance between two differently labelled points of each group, which is meant to be a few points."""
    a = points.select(*keys, F.col(label).alias("_a"), *(F.col(c).alias(f"_{c}") for c in coordinates))
    gap = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in coordinates), F.lit(0.0)))
    pairs = points.join(a, list(keys)).filter(F.col(label) < F.col("_a"))
    return pairs.groupBy(*keys).agg(F.min(gap).alias("distance"), F.count("*").alias("pairs"))


def first_json_object(text: Column) -> Column:
    """The first JSON object in a text, without a fence around it, as JSON with sorted keys; null if there is none."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(t: str | None) -> str | None:
            for i, c in enumerate(t or ""):
                if c == "{":
                    try:
                        return json.dumps(decoder.raw_decode(t, i)[0], sort_keys=True, separators=(",", ":"))
                    except ValueError:
                        continue
            return None

        return texts.map(one)

    return find(text)


def canonical_digest(json_text: Column) -> Column:
    """SHA-256 of a JSON value written with sorted keys and no spaces; null for what isn't JSON."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        import hashlib

        def one(t: str | None) -> str | None:
            try:
                return hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return digest(json_text)


def packed_masks(rows: DataFrame, keys: Sequence[str], mask: str) -> DataFrame:
    """Arrays of booleans as bytes, eight to each, the first the lowest bit; ``bits`` is their number."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            masks = [np.asarray(m, bool) for m in pdf[mask]]
            yield pdf[list(keys)].assign(bits=[len(m) for m in masks], packed=[np.packbits(m, bitorder="little").tobytes() for m in masks])

    return rows.select(*keys, mask).filter(F.col(mask).isNotNull()).mapInPandas(pack, f"{_types(rows, keys)}, bits long, packed binary")


def unpacked_masks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The masks that :func:`packed_masks` packed."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            masks = [np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little").astype(bool).tolist() for p, n in zip(pdf["packed"], pdf["bits"], strict=True)]
            yield pdf[list(keys)].assign(mask=masks)

    return rows.select(*keys, "bits", "packed").mapInPandas(unpack, f"{_types(rows, keys)}, mask array<boolean>")
