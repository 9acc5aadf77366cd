"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Each source gets a budget of words. Whole passes over the source cover
``floor(budget / size)`` of it; for the rest, documents are placed on a hash
line and the words below every threshold are summed in a histogram of 4,096
buckets per source. The bucket in which the budget runs out, and only that, is
refined by the next twelve bits of the hash, three times in all. A document is
taken once more if its hash lies below its source's threshold: a filter, no
sort of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import WORD, by_place, cut, whole_text

BITS, LEVELS, SALTS, SMALL = 12, 3, 64, 10_000


def line_place(doc_id: Column, seed: str) -> Column:
    """A place of 36 bits on the hash line: the first nine hex digits of an MD5 digest."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, size in words and place on the hash line."""
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"),
        line_place(F.col("doc_id"), seed).alias("_place"),
    )


def budgets(rows: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """One row per source: its size, its budget and how the budget splits into passes and a remainder.

    Budgets are shared by weight, sources in code point order and null last. No
    budget exceeds ``max_repeats`` times the source; what is cut off is shared
    again by weight. That is a water level: in the order of size per weight,
    the sources below the level are full, the others hold level times weight.
    The windows here run over one row per source.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("at", (F.row_number().over(names) - 1) % len(weights)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.col("at") + 1).cast("double")
    )
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("fill").asc(), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    filled = ranked.withColumn("fill", F.lit(max_repeats) * F.col("source_size") / F.col("weight")).select(
        "*",
        (F.sum("source_size").over(everything) * share).alias("all_words"),
        F.sum("weight").over(everything).alias("all_weights"),
        F.coalesce(F.sum("source_size").over(before) * max_repeats, F.lit(0)).alias("full_words"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("full_weights"),
    )
    level = (F.col("all_words") - F.col("full_words")) / (F.col("all_weights") - F.col("full_weights"))
    leveled = filled.withColumn("level", level).withColumn(
        "level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything)
    )
    target = F.least(
        F.coalesce(F.col("level") * F.col("weight"), F.lit(max_repeats) * F.col("source_size")),
        F.lit(max_repeats) * F.col("source_size"),
    ).cast("double")
    whole = F.when(
        F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-9), F.lit(max_repeats))
    ).otherwise(0)
    rest = F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))
    return (
        leveled.withColumn("target", target)
        .withColumn("passes", whole.cast("long"))
        .select("source", "source_size", "target", "passes", rest.alias("rest"))
    )


def _by_source(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Joins one row per source to the documents.

    Up to ``SMALL`` sources, which is checked, are broadcast. More than that
    are dealt over 64 salts, so that a source that holds a third of all rows
    isn't one task's.
    """
    right = small.withColumnRenamed("source", "_source")
    if small.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(right), rows["source"].eqNullSafe(right["_source"])).drop("_source")
    left = rows.withColumn("_salt", F.pmod("_place", F.lit(SALTS)).cast("int"))
    right = right.withColumn("_dealt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = left["source"].eqNullSafe(right["_source"]) & (left["_salt"] == right["_dealt"])
    return left.join(right, on).drop("_salt", "_dealt", "_source")


def thresholds(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """Adds to each budget the first place on the line that is not taken once more.

    At each level the histogram covers only what lies in the bucket that was
    open before. The last bucket, 2**-36 of the line, is taken whole if that
    comes nearer to the budget.
    """
    found = budget.withColumn("low", F.lit(0).cast("long")).withColumn("spent", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        width = 1 << (BITS * (LEVELS - level))
        inside = (
            rows
            if level == 1
            else _by_source(rows, found.select("source", "low")).filter(
                (F.col("_place") >= F.col("low")) & (F.col("_place") < F.col("low") + F.lit(width << BITS))
            )
        )
        histogram = inside.groupBy("source", F.floor(F.col("_place") / width).alias("bucket")).agg(
            F.sum("size").alias("words")
        )
        order = Window.partitionBy("source").orderBy("bucket")
        running = histogram.withColumn("upto", F.sum("words").over(order)).withColumnRenamed("source", "_source")
        joined = found.join(running, found["source"].eqNullSafe(running["_source"]), "left")
        last = F.lit(level == LEVELS)
        fits = F.col("spent") + F.col("upto") <= F.col("rest")
        nearer = last & (F.col("spent") + F.col("upto") - F.col("rest") < F.col("rest") - F.col("spent") - (F.col("upto") - F.col("words")))
        keep = fits | nearer
        end = F.when(F.count(F.when(~keep, 1)) > 0, F.min(F.when(~keep, F.col("bucket"))) * width).otherwise(
            F.max(F.col("low")) + F.lit(width << BITS)
        )
        # The open bucket begins at ``end``; words before it are spent.
        found = joined.groupBy("source", "source_size", "target", "passes", "rest", "low", "spent").agg(
            end.alias("_low"), F.coalesce(F.max(F.when(keep, F.col("upto"))), F.lit(0)).alias("_more")
        )
        found = found.select(
            "source", "source_size", "target", "passes", "rest",
            F.col("_low").alias("low"), (F.col("spent") + F.col("_more")).alias("spent"),
        )
        found = cut(found)
    return found


def _planned(docs: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and places, and each source's threshold under names that no column of the documents has."""
    rows = cut(sized(docs, seed))
    found = thresholds(rows, cut(budgets(rows, weights, share, max_repeats)))
    return rows, found.select("source", *(F.col(c).alias(f"_{c}") for c in found.columns if c != "source"))


def _repeats(max_repeats: int):
    more = (F.col("_place") < F.col("_low")) & (F.col("_passes") < max_repeats) & (F.col("_rest") > 0)
    return F.col("_passes") + more.cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    max_repeats: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """How many words of every document a mix of all sources takes.

    Returns doc_id, source, size, source_size, target (the source's), repeats
    and taken = repeats * size. ``weights`` repeat over the sources in code
    point order, null last. Null and empty texts have size 0 and are taken as
    often as their place says; an empty table gives no rows. Rows that repeat a
    doc_id share a place and are taken alike; a null id is a place too.
    """
    rows, found = _planned(docs, weights, share, max_repeats, seed)
    return (
        _by_source(rows, found)
        .withColumn("repeats", _repeats(max_repeats))
        .select(
            "doc_id",
            "source",
            "size",
            F.col("_source_size").alias("source_size"),
            F.col("_target").alias("target"),
            "repeats",
            (F.col("repeats") * F.col("size")).alias("taken"),
        )
    )


def keep_mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    max_repeats: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """The documents of the mix with all their columns as they are, whatever these are called, each as often as the mix takes it.

    What nulls, empty texts, repeated ids and an empty table do is as in :func:`mix`.
    """
    _, found = _planned(docs, weights, share, max_repeats, seed)
    plain, names = by_place(docs)
    placed = plain.withColumn("source", F.col(names["source"])).withColumn("_place", line_place(F.col(names["doc_id"]), seed))
    return (
        _by_source(placed, found)
        .withColumn("_repeats", _repeats(max_repeats))
        .filter("_repeats > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_repeats").cast("int"))))
        .select(*names.values())
        .toDF(*docs.columns)
    )
