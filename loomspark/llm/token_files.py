"""Token files: ids of whole texts, compressed by Re-Pair grammars that can be read at any document.

A shard holds the ids of some consecutive documents. In every round the
frequent pairs of neighbouring symbols are counted and each is replaced by a
nonterminal of its own, until no pair is frequent; pairs never cross the end of
a document. A shard stores its rules, the expansion length of each, the
compressed ids and each document's place among them, so one document is
decoded from its own slice and the rules alone.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.bpe import distinct_pieces, of_letters, runs, words_and_marks
from loomspark.llm.common import in_text_batches

#: Buckets in which pairs are counted before those of full buckets are counted exactly.
BUCKET_BITS = 20
#: Shards of a file format whose parts Spark's own Parquet writer and reader store.
SHARD_SCHEMA = (
    "part int, shard int, n_tokens long, vocabulary int, doc_ids array<long>, doc_tokens array<int>, "
    "doc_places array<int>, rules binary, rule_lengths binary, symbols binary"
)


def frequent(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that occur ``least`` times, most frequent first, the places of their occurrences and which key each is; exact."""
    bucket = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).view(np.int64)
    maybe = np.flatnonzero((np.bincount(bucket, minlength=1 << BUCKET_BITS) >= least)[bucket])
    key, bucket = key[maybe], bucket[maybe]
    held = np.sort(key)
    begins = np.flatnonzero(np.diff(held, prepend=-1))
    counts = np.diff(begins, append=len(held))
    often = np.flatnonzero(counts >= least)
    pairs = held[begins[often]]
    rank = np.empty(len(pairs), np.int64)
    rank[np.argsort(-counts[often], kind="stable")] = np.arange(len(pairs))
    # Each bucket knows one of its frequent keys; the few others are looked up one by one.
    known = np.full(1 << BUCKET_BITS, -1, np.int32)
    at = (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).view(np.int64)
    known[at] = np.arange(len(pairs))
    of = known[bucket]
    other = np.zeros(1 << BUCKET_BITS, bool)
    other[at[known[at] != np.arange(len(pairs))]] = True
    some = np.flatnonzero((of >= 0) & other[bucket]) if other.any() else np.zeros(0, np.int64)
    of[some] = np.minimum(np.searchsorted(pairs, key[some]), len(pairs) - 1)
    fits = np.flatnonzero(of >= 0)
    fits = fits[pairs[of[fits]] == key[fits]]
    return pairs[np.argsort(rank)], maybe[fits], rank[of[fits]]


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replaces frequent pairs of neighbours by nonterminals until no pair occurs ``least`` times; ``ends`` are the documents' ends in ``ids``.

    A round counts exactly the pairs that can have become frequent, those with
    a symbol of the last round and those that were frequent and lost an overlap
    in it, and replaces every frequent one. Returns the symbols, the documents'
    ends among them and the rules (one row of two symbols for each nonterminal,
    the first of which is ``vocabulary``).
    """
    symbols = ids.astype(np.int64)
    last = np.zeros(len(symbols), bool)
    last[ends[ends > 0] - 1] = True
    look = ~last  # places whose pair may be frequent
    rules: list[np.ndarray] = []
    made = 0
    while len(symbols) > 1:
        at = np.flatnonzero(look[:-1])
        pairs, where, of = frequent(symbols[at] << 32 | symbols[at + 1], least)
        if not len(pairs):
            break
        at = at[where]
        # Of pairs that overlap, each run of neighbours keeps the first, third and so on.
        begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        odd = (np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))) % 2
        found, lost = at[odd == 0], at[odd == 1]
        rules.append(np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1))
        symbols[found] = vocabulary + made + of[odd == 0]
        last[found] = last[found + 1]
        look = np.zeros(len(symbols), bool)
        look[found] = look[lost + 1] = True
        look[np.maximum(found, 1) - 1] = True
        look[lost] = True
        keep = np.ones(len(symbols), bool)
        keep[found + 1] = False
        symbols, last, look = symbols[keep], last[keep], look[keep]
        look &= ~last
        made += len(pairs)
    places = np.flatnonzero(last) + 1
    return symbols, places, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """How many ids each nonterminal stands for."""
    out = np.ones(len(rules), np.int64)
    size = lambda x: 1 if x < vocabulary else out[x - vocabulary]
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = size(a) + size(b)
    return out


def laid_out(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The entries ``which`` one after another, of those that lie in ``flat`` with these sizes."""
    starts, n = np.cumsum(sizes) - sizes, sizes[which]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class Grammar:
    """Rules laid out for expansion, all by one level at a time: any slice of symbols is expanded without the rest of its shard."""

    def __init__(self, rules: np.ndarray, sizes: np.ndarray, vocabulary: int):
        self.sizes = np.concatenate([np.ones(vocabulary, np.int64), sizes])
        held = rules.astype(np.int64).ravel()
        while (held >= vocabulary).any():
            n = 1 + (held >= vocabulary)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            held = np.repeat(held, n)
            wide = np.flatnonzero(held >= vocabulary)
            held[wide] = rules[held[wide] - vocabulary, inner[wide]]
        self.flat = np.concatenate([np.arange(vocabulary), held])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return laid_out(self.flat, self.sizes, symbols)


class Library:
    """The tokenizers library over distinct words, which a worker remembers up to a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tokenizer in (self.tokenizer, self.plain):
            tokenizer.no_truncation()
            tokenizer.no_padding()
        # Words of the letters a to z need no normaliser and no pattern.
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: Words met lately and before; what isn't met again is forgotten.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def prepare(self, wanted: list[str], remembered: int) -> None:
        """Sees to it that ``known`` has all these words."""
        if len(self.known) > remembered:
            self.before, self.known = self.known, {}
        new = []
        for word in wanted:
            if word not in self.known:
                if word in self.before:
                    self.known[word] = self.before[word]
                else:
                    new.append(word)
        self.learn(new)

    def learn(self, new: list[str]) -> None:
        """Encodes words, many to a text that is cut at their ends, and all else one by one."""
        plain, letters, other = [], [], []
        for word in new:
            if word.isascii():
                (plain if word.isalpha() and word.islower() else other).append(word)
            else:
                (letters if of_letters(word) else other).append(word)
        for tokenizer, words in ((self.plain, plain), (self.tokenizer, letters)):
            for i in range(0, len(words), 5000):
                some = words[i : i + 5000]
                ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) != len(some) or ends[-1] != len(ids):
                    other += some
                    continue
                packed, stops = ids.tobytes(), (4 * ends).tolist()
                self.known.update({word: packed[start:stop] for word, start, stop in zip(some, [0, *stops[:-1]], stops, strict=True)})
        for i in range(0, len(other), 5000):
            some = other[i : i + 5000]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.known.update({word: np.array(x.ids, np.uint32).tobytes() for word, x in zip(some, found, strict=True)})


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


def library_ids(path: str, texts: list[str], end: int, remembered: int = 300_000) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts by the tokenizers library, each with the end id, and the documents' lengths.

    White space ends every token of this tokenizer, so each piece between is
    encoded once, by its word and the marks behind; twice ``remembered`` words is
    the most that a worker holds beside those of the texts.
    """
    own, (distinct, codes, ends) = library(path), distinct_pieces(texts)
    words, word_of, marked, marks = words_and_marks(distinct)
    own.prepare(words, remembered)
    packed = [*map(own.known.__getitem__, words), b"", np.array([end], np.uint32).tobytes()]
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    # The pieces, each a word and marks or nothing, and last the end of a document.
    halves = np.full((len(word_of) + 1, 2), len(words), np.int64)
    halves[:-1, 0], halves[marked, 1], halves[-1, 0] = word_of, marks, len(words) + 1
    flat = laid_out(np.frombuffer(b"".join(packed), np.uint32), sizes, halves.ravel())
    sizes = sizes[halves].sum(1)
    which = np.insert(codes.astype(np.int64), ends, len(word_of))
    upto = np.concatenate([[0], np.cumsum(sizes[which])])[ends + np.arange(1, len(ends) + 1)]
    return laid_out(flat, sizes, which), np.diff(upto, prepend=0)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    vocabulary: int,
    end: int = 1,
    least: int = 48,
    shard_bytes: int = 4 << 20,
) -> None:
    """Writes the ids of every whole text, with ``end`` after each, in ascending doc_id order.

    The files are Parquet files of shards (``SHARD_SCHEMA``); a shard ends at
    the first document that fills ``shard_bytes`` of text, so a longer text is
    the last of its shard. Pairs that occur ``least`` times in a shard get a
    rule; all ids of a shard are in memory at once. Null ids come first,
    rows that repeat an id go by text. Null and empty texts are the end id
    alone. An empty table gives no shards; other columns are ignored.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, at = batch.column(0), 0
            for run in runs(batch.column(1).to_pylist(), shard_bytes):
                ids, sizes = library_ids(tokenizer_path, run, end)
                symbols, places, rules = compress(ids, np.cumsum(sizes), vocabulary, least)
                wide = np.uint16 if vocabulary + len(rules) <= 1 << 16 else np.uint32
                row = [part, shard, int(sizes.sum()), vocabulary, doc_ids.slice(at, len(run)).to_pylist(), sizes.tolist(), places.tolist()]
                row += [rules.astype(np.uint32).tobytes(), lengths(rules, vocabulary).astype(np.uint32).tobytes(), symbols.astype(wide).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, TYPES, strict=True)], NAMES)
                at, shard = at + len(run), shard + 1

    ordered = (
        in_text_batches(docs).select("doc_id", "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    )
    ordered.mapInArrow(step, SHARD_SCHEMA).write.parquet(folder)


NAMES = [f.split()[0] for f in SHARD_SCHEMA.split(", ")]
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]


def decoded_documents(row: dict, wanted: list[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a shard, or those at some places in it, each of these expanded from its own slice and the rules."""
    rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
    grammar = Grammar(rules, np.frombuffer(row["rule_lengths"], np.uint32).astype(np.int64), row["vocabulary"])
    wide = np.uint16 if row["vocabulary"] + len(rules) <= 1 << 16 else np.uint32
    symbols, ends = np.frombuffer(row["symbols"], wide), [0, *row["doc_places"]]
    if wanted is None:
        ids, borders = grammar.expand(symbols).astype(np.uint32), np.concatenate([[0], np.cumsum(grammar.sizes[symbols])])[ends].tolist()
        for doc_id, start, stop in zip(row["doc_ids"], borders[:-1], borders[1:], strict=True):
            yield doc_id, ids[start:stop]
    else:
        for i in wanted:
            yield row["doc_ids"][i], grammar.expand(symbols[ends[i] : ends[i + 1]]).astype(np.uint32)


def read_documents(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id, n_tokens and ids of the documents whose doc_id is in ``wanted``; of a shard only their slices are decoded.

    Ids that aren't in the files give no rows, an id that the files have twice gives two. Null ids match nothing.
    """
    files = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    held = files.select("part", "shard", F.posexplode("doc_ids").alias("at", "doc_id"))
    places = held.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("part", "shard").agg(F.array_sort(F.collect_list("at")).alias("at"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs = list(decoded_documents(row, row["at"]))
                columns = [pa.array([d for d, _ in docs], pa.int64()), pa.array([len(x) for _, x in docs], pa.int64()), pa.array([x.tolist() for _, x in docs], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])

    return files.join(places, ["part", "shard"]).mapInArrow(step, "doc_id long, n_tokens long, ids array<long>")


def read_token_files(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """One row per document, read back from the files.

    Returns doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    and ids (null unless ``ids``).
    """
    files = spark.read.schema(SHARD_SCHEMA).parquet(folder)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs = list(decoded_documents(row))
                sizes = np.array([len(x) for _, x in docs], np.int64)
                columns = [
                    pa.array([row["part"]] * len(docs), pa.int32()),
                    pa.array([row["shard"]] * len(docs), pa.int32()),
                    pa.array([d for d, _ in docs], pa.int64()),
                    pa.array(np.cumsum(sizes) - sizes),
                    pa.array(sizes),
                    pa.array([zlib.crc32(x.tobytes()) for _, x in docs], pa.int64()),
                    pa.array([x.tolist() if ids else None for _, x in docs], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"])

    documents = files.mapInArrow(step, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long, ids array<long>")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.sum("n").over(before).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("shard_start"))
    starts = shards.join(parts, "part").select("part", "shard", (F.coalesce("part_start", F.lit(0)) + F.col("shard_start")).alias("before"))
    return documents.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )
