"""A quality classifier on supervised subword embeddings.

Words, pairs of neighbouring words and runs of three and four characters are
hashed into buckets. Each bucket has a learned vector; a document is the mean of its
features' vectors, and a softmax over two classes scores it. Vectors and output
are trained together by stochastic gradient descent in numpy. As the mean and
the output are linear, scoring adds up one learned number per feature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomspark.llm.common import by_place, in_text_batches
from loomspark.llm.rolling import Spans, flat, mix, slices, words

#: Bytes of text that are turned into features at once.
STEP_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that the model is fitted on and ``sample_bytes`` the bytes of their features, ``bits`` the buckets; ``steps`` of ``batch`` rows each are taken at any size."""

    sample: int = 3000
    sample_bytes: int = 512 << 20
    bits: int = 17
    size: int = 6
    steps: int = 400
    batch: int = 32
    rate: float = 20.0
    seed: int = 7


def features(texts: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature the buckets, document after document, and the documents' borders among them.

    Kinds are words, pairs of words, and runs of three and four characters,
    white space included. The hash of a pair of words is taken from their hashes' difference, so a
    word that is said again after itself is one and the same feature.
    """
    data, borders = flat(texts)
    shift = np.uint64(64 - bits)
    bucket = lambda x: (mix(x) >> shift).astype(np.int32)
    starts, stops, first = words(data, borders)
    spans = Spans(data)
    word = spans.of(starts, stops)
    characters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    found = [(bucket(word), first)]
    for n, at in ((2, first), (3, np.searchsorted(characters, borders)), (4, np.searchsorted(characters, borders))):
        last = (len(word) if n == 2 else len(characters) - 1) - n + 1
        if last <= 0:
            found.append((np.zeros(0, np.int32), np.zeros_like(at)))
            continue
        inside = np.ones(last, bool)  # whether all n are in one document
        for i in range(1, n):
            crossed = at[1:-1] - i
            inside[crossed[(crossed >= 0) & (crossed < last)]] = False
        if n == 2:
            gram = word[1:] - word[:-1] + np.uint64(5)
        else:
            gram = spans.of(characters[:last], characters[n : n + last]) + np.uint64(n)
        places = np.concatenate([[0], np.cumsum(inside)])
        found.append((bucket(gram[inside]), places[np.minimum(at, last)]))
    return found


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent over (buckets, their shares in the document, label). Returns a number per bucket and an offset."""
    rnd = np.random.default_rng(s.seed)
    vectors = rnd.uniform(-1 / s.size, 1 / s.size, (1 << s.bits, s.size)).astype(np.float32)
    out, offset = rnd.uniform(-1, 1, (s.size, 2)).astype(np.float32), np.zeros(2, np.float32)
    order = np.zeros(0, np.int64)
    for step in range(s.steps):
        while len(order) < s.batch:
            order = np.concatenate([order, rnd.permutation(len(docs))])
        some, order = [docs[j] for j in order[: s.batch]], order[s.batch :]
        rate = s.rate * (1 - step / s.steps)
        ids, share = np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some])
        of = np.repeat(np.arange(len(some)), [len(x[0]) for x in some])
        hidden = np.zeros((len(some), s.size), np.float32)
        for k in range(s.size):
            hidden[:, k] = np.bincount(of, vectors[ids, k] * share, len(some))
        logits = hidden @ out + offset
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(some)), [x[2] for x in some]] -= 1
        back = (p @ out.T).astype(np.float32)
        np.subtract.at(vectors, ids, (rate * share)[:, None] * back[of] / len(some) * 8)
        out -= 0.02 * rate * hidden.T @ p / len(some)
        offset -= 0.02 * rate * p.sum(0) / len(some)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(offset[1] - offset[0])


def held_out(doc_id) -> F.Column:
    """Every fifth document by the CRC of its id, never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sampled(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """doc_id, label and text of the rows to learn from: ``sample`` at most, one for each id.

    Rows without a label of 0 or 1 or without an id are left out, of several
    labels of an id the smallest counts, of several texts of an id the one of
    the smallest hash. The ids are those of the smallest hashes that aren't held out.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Fits the model on the rows of :func:`sampled`.

    Features are made where the rows are; the bounded sample then meets in one
    task, row by row in the order of the ids' hashes, until ``sample_bytes`` are
    full. Without a usable row the score of every text is one half.
    """
    texts = in_text_batches(sampled(docs, labels, s))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for start, stop in slices(texts, STEP_BYTES):
                kinds = features(texts.slice(start, stop - start), s.bits)
                rows = []
                for i in range(stop - start):
                    ids = np.concatenate([k[at[i] : at[i + 1]] for k, at in kinds])
                    found, n = np.unique(ids, return_counts=True)
                    rows.append((found.astype(np.int32).tobytes(), (n / max(1, len(ids))).astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), batch.column("label").slice(start, stop - start), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                    ["doc_id", "label", "ids", "shares"],
                )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                size += len(r["ids"]) + len(r["shares"])
                if size <= s.sample_bytes:
                    rows.append(r)
        rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["ids"], r["shares"]))
        some = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["shares"], np.float32), r["label"]) for r in rows]
        weights, offset = train(some, s) if some else (np.zeros(1 << s.bits, np.float32), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([offset])], ["weights", "offset"])

    model = texts.mapInArrow(counted, "doc_id long, label int, ids binary, shares binary").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(fitted, "weights binary, offset double").collect()
    return (np.frombuffer(model[0].weights, np.float32), model[0].offset) if model else (np.zeros(1 << s.bits, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = Settings.bits, text: str = "text", name: str = "score") -> DataFrame:
    """The columns of ``docs`` and ``name``, the probability of the label 1 from 0 to 1; null and empty texts have one too.

    ``docs`` must not have a column ``name``.
    """
    weights, offset = model

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where)
            for start, stop in slices(texts, STEP_BYTES):
                scores = scored(texts.slice(start, stop - start), weights, offset, bits)
                yield pa.RecordBatch.from_arrays([*(c.slice(start, stop - start) for c in batch.columns), pa.array(scores)], names)

    where, names = docs.columns.index(text), [*docs.columns, name]
    return in_text_batches(docs).mapInArrow(step, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def scored(texts: pa.Array, weights: np.ndarray, offset: float, bits: int) -> np.ndarray:
    """The softmax of each text's mean, to six places of the mean so that the order of additions doesn't show."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for ids, borders in features(texts, bits):
        sums = np.concatenate([[0.0], np.cumsum(weights[ids], dtype=np.float64)])
        total += sums[borders[1:]] - sums[borders[:-1]]
        n += np.diff(borders)
    mean = np.round(total / np.maximum(1, n), 6)
    return 1 / (1 + np.exp(-np.clip(mean + offset, -50, 50)))


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) of every row.

    Labels, lang, source and doc_id are no inputs of a score. Null and empty
    texts have one too, of very long texts every feature counts. Repeated rows
    stay; an empty table gives no rows; other columns are ignored.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, s), s.bits)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns as they are, whatever these are called.

    Null and empty texts have a score like others; repeated rows stay or go
    together; an empty table gives no rows.
    """
    plain, names = by_place(docs)
    kept = score(plain, fit(docs, labels, s), s.bits, names["text"]).filter(F.col("score") >= threshold)
    return kept.drop("score").toDF(*docs.columns)
