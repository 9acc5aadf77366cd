"""Source divergence audit: how far the term shares of a language's sources lie apart, from an inverted index.

A term's posting list has its count in each source that has the term. For two
sources nearly all terms of a language are absent from one or both, so no pair
of sources is compared term by term. A pair starts at V times the divergence of
two zero counts, as if no term occurred. Terms that only one of the two counts
correct that by how many terms a source has with each count. Only terms that
both have emit a correction of their own, from their posting list. What is left
when all corrections are added is the sum over all terms, exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import cut, in_text_batches

#: Terms of UTF-8 bytes, before A to Z are lower-cased: letters and everything beyond ASCII.
LETTERS = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Entries of the counts that a task holds before it passes them on.
HELD = 300_000
SCALE = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs: partial counts, and a row with a null term for each group that occurs."""

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs_) in held.items():
            terms, size = [None, *n], len(n) + 1
            columns = [pa.repeat(lang, size), pa.repeat(source, size), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs_.__getitem__, n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                terms = LETTERS.findall(text.as_py().lower())
                n.update(terms)
                docs_.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from rows(held)
                held = {}
        yield from rows(held)

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    texts = in_text_batches(docs).select(*named, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(step, "lang string, source string, term string, n long, docs long")


def inverted_index(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, total and postings (source, n) of the kept terms, and a row with a null term whose postings name a language's sources.

    Counts combine in the tasks that read, before they are exchanged. A term's
    rows, no more than there are such tasks and sources, meet once; there they
    become one count for each source and then one list, which has as many
    entries as the language has sources, however often the term occurs.
    """
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    lists = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return cut(lists.filter(F.col("term").isNull() | (F.col("docs") >= least_docs)).drop("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + 10^9 (n + 1) div (total + terms), exactly; 1 where there are no terms."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.when(terms > 0, 1 + F.call_function("div", whole, F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)"))).otherwise(1).cast("long")


def apart(p: Column, q: Column) -> Column:
    """(p - q)^2 div q; shares are at most 10^9 + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """How the sources of each language differ from each other, and in which terms from the language.

    Returns lang, source, part, item, value and rank. Each lang keeps the terms
    that at least ``least_docs`` of its rows have. A (lang, source) group, and a
    lang as a whole, gives each kept term the share
    p = 1 + 10^9 (n + 1) div (N + V), with n occurrences in it, N of all kept
    terms, and V kept terms. For part ``pair`` item is each other source of the
    lang and value the sum of (p - q)^2 div q over all kept terms, q the other's
    share; all pairs come, with 0 if no term is kept. For part ``term`` item is
    each term that the group has with p > q, q the lang's share, and the
    ``most_terms`` with the highest values come. rank counts by falling value,
    then by the item's bytes.

    Null lang, source and text are read as '', so they are one group with those
    that are empty. Each row is a document, repeated ones too. Texts may be of
    any length. An empty table gives no rows; other columns are ignored. A pair's
    value is below 2^63 for up to 10^8 kept terms. The result has a row for every two sources of a
    lang, whatever their number; a term's list is bounded by it too.
    """
    index = inverted_index(docs, least_docs)
    terms = index.filter(F.col("term").isNotNull())
    postings = terms.select("lang", "term", "total", F.explode("postings").alias("at")).select("lang", "term", "total", "at.source", "at.n")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    occurring = index.filter(F.col("term").isNull()).select("lang", F.explode("postings.source").alias("source"))
    zero = F.lit(0).cast("long")
    groups = occurring.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["v", "lang_n", "group_n"])
    groups = cut(groups.withColumn("z", share(zero, F.col("group_n"), F.col("v"))))
    shares = postings.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v")))
    return _terms(shares, most_terms).unionByName(_pairs(shares, groups))


def _terms(shares: DataFrame, most: int) -> DataFrame:
    higher = shares.withColumn("q", share(F.col("total"), F.col("lang_n"), F.col("v"))).filter("p > q")
    values = higher.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    return _ranked(values).filter(F.col("rank") <= most)


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Values of all pairs of sources: the baseline and three kinds of corrections."""
    p, q, z, y = F.col("p"), F.col("q"), F.col("z"), F.col("other.z")
    here, there = groups.select("lang", "source", "v", "z").alias("own"), groups.select("lang", "source", "z").alias("other")
    each = here.join(there, (F.col("own.lang") == F.col("other.lang")) & (F.col("own.source") != F.col("other.source")))
    base = each.select("own.lang", "own.source", F.col("other.source").alias("item"), (F.col("own.v") * apart(F.col("own.z"), y)).alias("value"))

    steps = shares.groupBy("lang", "source", "p", "z").agg(F.count("*").alias("n")).alias("own")
    met = steps.join(there, (F.col("own.lang") == F.col("other.lang")) & (F.col("own.source") != F.col("other.source")))
    mine, theirs = apart(F.col("own.p"), y) - apart(F.col("own.z"), y), apart(y, F.col("own.p")) - apart(y, F.col("own.z"))
    sides = F.explode(F.array(F.struct(F.col("own.source").alias("source"), F.col("other.source").alias("item"), (F.col("n") * mine).alias("value")), F.struct(F.col("other.source").alias("source"), F.col("own.source").alias("item"), (F.col("n") * theirs).alias("value"))))
    one_sided = met.select(F.col("own.lang").alias("lang"), sides.alias("e")).select("lang", "e.*")

    lists = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "z"))).alias("held")).filter(F.size("held") > 1)
    firsts = lists.select("lang", "held", F.posexplode("held").alias("i", "a"))
    both = firsts.select("lang", "a", F.explode(F.slice("held", F.col("i") + 2, F.size("held"))).alias("b"))
    both = both.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.col("a.p").alias("p"), F.col("a.z").alias("z"), F.col("b.p").alias("q"), F.col("b.z").alias("y"))
    y = F.col("y")
    there_, back = apart(p, q) - apart(p, y) - apart(z, q) + apart(z, y), apart(q, p) - apart(q, z) - apart(y, p) + apart(y, z)
    summed = both.groupBy("lang", "source", "item").agg(F.sum(there_).alias("there"), F.sum(back).alias("back"))
    sides = F.explode(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))))
    two_sided = summed.select("lang", sides.alias("e")).select("lang", "e.*")

    values = base.unionByName(one_sided).unionByName(two_sided).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(values.withColumn("part", F.lit("pair")))


def _ranked(values: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return values.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
