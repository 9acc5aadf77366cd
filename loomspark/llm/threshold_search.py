"""Ranked lexical search by Fagin's threshold algorithm over shards of documents.

One pass over the documents keeps of each its number of terms and how often it
has each of the queries' terms: the forward index. Its counts give the weights.
A shard is a bounded part of that index and has a list for each term, sorted by
impact, the most a term adds to a document's score. A query reads its lists
round by round, the same depth of each; every document that it meets is looked
up in the forward index and scored whole. What no document further down can
exceed is the threshold, the sum of the impacts last read. Once that falls
strictly below the k-th score, no document that is left can be among the best,
not even by its id, and the query is done with the shard. The shards' best are
ranked together.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import BLOCK_BYTES, cut, in_blocks, in_text_batches

#: Terms of UTF-8 bytes, before A to Z are lower-cased: digits, letters and everything beyond ASCII.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Postings of a shard, the depth of a query's first round (each round goes twice as deep as the one before), and scores looked up at once.
POSTINGS, DEPTH, CELLS = 1 << 19, 16, 1 << 18


def terms_of(text: bytes | None) -> list[bytes]:
    return TERM.findall(text.lower()) if text else []


@dataclass(frozen=True)
class Query:
    """The distinct terms of a query, sorted, and how often each occurs in it."""

    item_id: object
    terms: np.ndarray
    times: np.ndarray


@dataclass(frozen=True)
class Corpus:
    """The documents with terms, all their terms, and the weight of each term of the queries."""

    documents: int
    terms: int
    weights: np.ndarray


class Shard:
    """The forward index and the impact-sorted lists of some documents."""

    def __init__(self, rows: pa.RecordBatch, corpus: Corpus):
        rows = rows.take(pc.array_sort_indices(rows.column(0), null_placement="at_end"))  # ties go to the smaller place
        self.ids = rows.column(0)
        n = rows.column(1).to_numpy()
        m = 100 - 75 + (75 * n * corpus.documents) // corpus.terms
        terms, tf = rows.column(2).flatten().to_numpy(), rows.column(3).flatten().to_numpy().astype(np.int64)
        docs = np.repeat(np.arange(len(n)), pc.list_value_length(rows.column(2)).to_numpy())
        self.vocabulary = len(corpus.weights)
        self.keys = docs * self.vocabulary + terms
        self.values = corpus.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
        order = np.lexsort((docs, -self.values, terms))
        self.docs, self.impacts = docs[order], self.values[order]
        self.borders = np.searchsorted(terms[order], np.arange(self.vocabulary + 1))
        self.met = np.zeros(len(n), bool)

    def scores(self, docs: np.ndarray, q: Query) -> np.ndarray:
        """Whole scores of documents, by lookups in the forward index."""
        out, step = np.zeros(len(docs), np.int64), max(1, CELLS // len(q.terms))
        for i in range(0, len(docs), step):
            wanted = (docs[i : i + step, None] * self.vocabulary + q.terms).ravel()
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            value = np.where(self.keys[at] == wanted, self.values[at], 0)
            out[i : i + step] = value.reshape(-1, len(q.terms)) @ q.times
        return out

    def best(self, q: Query, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the ``k`` best documents with a score above 0, and the depth at which the threshold fell below them."""
        low, high, times = self.borders[q.terms], self.borders[q.terms + 1], q.times
        held = low < high
        low, high, times = low[held], high[held], times[held]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, more = 0, DEPTH
        self.met[:] = False
        while len(low):
            read = np.concatenate([self.docs[a:b] for a, b in zip(low + depth, np.minimum(low + depth + more, high), strict=True)])
            new = np.unique(read[~self.met[read]])
            self.met[new] = True
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.scores(new, q)])
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            depth, more = depth + more, 2 * more
            left = low + depth < high
            low, high, times = low[left], high[left], times[left]
            threshold = int(self.impacts[low + depth - 1] @ times)
            if len(scores) == k and threshold < scores[-1]:
                break
        return docs[scores > 0], scores[scores > 0], depth

    def answers(self, queries: Sequence[Query], k: int) -> pa.RecordBatch:
        found = [self.best(q, k)[:2] for q in queries]
        items = np.repeat(np.arange(len(queries), dtype=np.int32), [len(docs) for docs, _ in found])
        docs, scores = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(items), self.ids.take(pa.array(docs)), pa.array(scores)], ["query", "doc_id", "score"])


def forward_index(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms with repeats), terms (those of ``numbers`` that occur, sorted) and tfs of each document; kept in the shared folder."""
    held = docs.sparkSession.sparkContext.broadcast(numbers)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                counts = Counter(words)
                own = sorted((known[w], counts[w]) for w in known.keys() & counts.keys())
                n.append(len(words))
                terms.append([t for t, _ in own])
                tfs.append([c for _, c in own])
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = in_text_batches(docs).select("doc_id", F.col("text").cast("binary"))
    return cut(rows.mapInArrow(step, f"doc_id {kind}, n long, terms array<int>, tfs array<int>"))


def counted(index: DataFrame, vocabulary: int) -> Corpus | None:
    """Counts over all documents and the weights of the terms; none if no document has terms."""
    sums = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    if not sums.terms:
        return None
    weights = np.zeros(vocabulary, np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
        weights[r.t] = math.floor(1000 * math.log((2 * sums.documents + 2) / (2 * r.df + 1)))
    return Corpus(sums.documents, sums.terms, weights)


def _searched(batches: Iterator[pa.RecordBatch], queries: Sequence[Query], corpus: Corpus, k: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(2).flatten())
        if size >= POSTINGS:
            yield Shard(pa.concat_batches(held), corpus).answers(queries, k)
            held, size = [], 0
    if held:
        yield Shard(pa.concat_batches(held), corpus).answers(queries, k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` documents of ``docs`` with the highest scores above 0 for each row of ``items``.

    Returns item_id, rank, doc_id and score; equal scores by ascending doc_id,
    null doc_ids last. With N documents that have a term, L terms in all, df
    documents that have the term, n terms of the document and tf of them the
    term: a term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a
    document's score sums w * (10^9 tf div (1000 tf + 8 (25 + 75 n N div L)))
    over the item's terms with repeats. Null and empty texts have no terms;
    items without terms and items that no document shares a term with give no
    rows. Rows that repeat a doc_id are documents of their own and items that
    repeat an item_id are items of their own. Texts may be of any length, each
    is one row's work. Empty tables give no rows; other columns are ignored.

    Items are asked in blocks of ``most_bytes`` bytes of text, which bounds what
    goes to the driver and to each task. A task holds ``POSTINGS`` postings at a
    time, or those of one Arrow batch, and every item visits every shard.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("binary").alias("text"))
    parts = []
    for block in in_blocks(asked, "text", most_bytes):
        numbers: dict[bytes, int] = {}
        queries = []
        for r in block:
            counts = Counter(numbers.setdefault(w, len(numbers)) for w in terms_of(bytes(r.text) if r.text else None))
            if counts:
                terms = np.array(sorted(counts), np.int64)
                queries.append(Query(r.item_id, terms, np.array([counts[t] for t in terms.tolist()], np.int64)))
        if not queries:
            continue
        index = forward_index(docs, numbers)
        corpus = counted(index, len(numbers))
        if corpus is None:
            continue
        held = spark.sparkContext.broadcast((queries, corpus))
        step = lambda batches, held=held: _searched(batches, *held.value, k)
        found = index.filter(F.size("terms") > 0).mapInArrow(step, f"query int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, q.item_id) for i, q in enumerate(queries)], f"query int, item_id {items.schema['item_id'].dataType.simpleString()}")
        parts.append(ranked.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return asked.crossJoin(docs.select("doc_id").limit(0)).limit(0).select("item_id", F.lit(1).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.union, parts)
