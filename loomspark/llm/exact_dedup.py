"""Exact dedup by a tree merge of sorted digest runs, in DataFrame functions only.

The table is read once: each partition's digests are its run, kept in the
shared folder. A run is cut into buckets of digests and each piece held as one
sorted array with one entry per digest. Runs then exchange in rounds, as in a
binomial tree: in every round the runs whose numbers differ only in the last
digit to the base ``fan_in`` meet and are merged, bucket by bucket, and the
number of rounds follows from the number of partitions. A merged entry keeps
the largest id, the number of rows behind it and the fields that verify the
digest. The survivors go back to the first runs, so a text that makes up a
third of all rows is one entry of each run in both directions and never meets
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import by_place, cut, numbered, whole_text

#: Equal texts agree on all three; the pair of independent digests and the length verify each other.
DIGEST = ["text_sha256", "n_bytes", "check_hash"]
#: Entries of a merged bucket, on average.
BUCKET = 2048


def digest_rows(docs: DataFrame, row_no: Column | None = None) -> DataFrame:
    """One row per document: id, row number, run and digest fields; the text is read once and not kept."""
    text = whole_text()
    rows = docs.select(
        "doc_id",
        (F.monotonically_increasing_id() if row_no is None else row_no).alias("row_no"),
        F.spark_partition_id().alias("run"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("check_hash"),
    )
    return cut(rows)


def first_runs(rows: DataFrame) -> DataFrame:
    """One entry per run and digest; Spark combines on the map side before it exchanges."""
    best = F.max(F.struct("doc_id", "row_no")).alias("best")
    return rows.groupBy("run", *DIGEST).agg(best, F.count("*").alias("n"))


def as_sorted(entries: DataFrame, buckets: int) -> DataFrame:
    """run, bucket and the sorted array of its entries."""
    entry = F.struct(F.struct("check_hash", "text_sha256", "n_bytes").alias("digest"), "best", "n")
    bucket = F.pmod("check_hash", F.lit(buckets)).alias("bucket")
    return entries.groupBy("run", bucket).agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def merged(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: ``fan_in`` sorted runs become one.

    The sort of arrays that are put one behind the other finds the runs in them
    and merges these. A run has a digest once, so at most ``fan_in`` neighbours
    have the same one; the last has the largest id and takes over the others' rows.
    """
    met = runs.groupBy(F.expr(f"run DIV {fan_in}").alias("run"), "bucket").agg(F.array_sort(F.flatten(F.collect_list("entries"))).alias("held"))
    at = lambda i, back=0: F.get("held", i - back)
    last = F.filter(F.sequence(F.lit(0), F.size("held") - 1), lambda i: F.coalesce(at(i)["digest"] != at(i, -1)["digest"], F.lit(True)))

    def entry(i: Column) -> Column:
        rows = at(i)["n"]
        for back in range(1, fan_in):
            rows = rows + F.when(at(i, back)["digest"] == at(i)["digest"], at(i, back)["n"]).otherwise(0)
        return F.struct(at(i)["digest"].alias("digest"), at(i)["best"].alias("best"), rows.alias("n"))

    return met.withColumn("last", last).select("run", "bucket", F.transform("last", entry).alias("entries"))


def merge_tree(entries: DataFrame, fan_in: int) -> DataFrame:
    """The digest fields, ``keep`` and ``group_size`` of each distinct text, by as many rounds as it takes to come to one run."""
    size = entries.agg(F.coalesce(F.max("run"), F.lit(0)).alias("last"), F.count("*").alias("n")).first()
    level, runs = as_sorted(entries, max(1, -(-size.n // BUCKET))), size.last + 1
    while runs > 1:
        level, runs = merged(level, fan_in), -(-runs // fan_in)
    one = level.select(F.explode("entries").alias("e"))
    return one.select(*(F.col(f"e.digest.{c}").alias(c) for c in DIGEST), F.col("e.best").alias("keep"), F.col("e.n").alias("group_size"))


def exact_dedup(docs: DataFrame, fan_in: int = 4, row_no: Column | None = None) -> DataFrame:
    """Marks every row of ``docs`` with the row that stands for its text.

    Returns doc_id, row_no, keep_id, group_size, kept, text_sha256. Of equal
    texts (byte for byte, null counting as empty, of any length) the largest
    doc_id stays, a null id being the smallest; rows that repeat an id and its
    text are told apart by their place in the input, so exactly one row of a
    group is kept. An empty table gives no rows, other columns are ignored.
    ``docs`` is read once, in this call. ``row_no`` is a stored number of each
    row, if there is one.
    """
    rows = digest_rows(docs, row_no)
    first = first_runs(rows)
    down = first.select("run", *DIGEST).join(merge_tree(first, fan_in), DIGEST)
    same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("row_no") == F.col("keep.row_no"))
    return rows.join(down, ["run", *DIGEST]).select(
        "doc_id",
        "row_no",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        same.alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, fan_in: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they are, whatever these are called.

    Which rows stay, and what nulls, ties, repeated rows and an empty table do,
    is as in :func:`exact_dedup`. The rows are numbered once, in the shared folder.
    """
    plain, names = by_place(docs)
    rows = numbered(plain, "row_no")
    marked = exact_dedup(rows.select(F.col(names["doc_id"]).alias("doc_id"), F.col(names["text"]).alias("text"), "row_no"), fan_in, F.col("row_no"))
    return rows.join(marked.filter("kept").select("row_no"), "row_no", "left_semi").drop("row_no").toDF(*docs.columns)
