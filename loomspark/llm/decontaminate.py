"""Benchmark decontamination: a generalised suffix automaton of the test items, past which the training words stream.

The words of all items are one automaton: a state stands for the word
sequences that end at the same places of the items, and its link leads to the
longest suffix that ends at more places. A document's words move a state and
the length of the longest match that ends at each word. Where that length
reaches a window, the window's words are hit. Only stretches whose neighbouring
words all are neighbours in some item can hold a match, so the automaton walks
those and passes the rest by.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import BLOCK_BYTES, cut, in_blocks, in_text_batches

#: Words of lower-cased UTF-8 bytes: digits, small letters and everything beyond ASCII.
ITEM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal_words(text: bytes | None) -> list[bytes]:
    """The words of a text, A to Z lower-cased."""
    return ITEM_WORD.findall(text.lower()) if text else []


class Automaton:
    """The suffix automaton of the words of several items, each a name and its text.

    ``window`` neighbouring words of an item are a window, and so is an item of
    fewer words. ``ends`` has the windows of a state: their length and the names
    of their items.
    """

    def __init__(self, items: Iterable[tuple[str, bytes | None]], window: int):
        if window < 1:
            raise ValueError("a window has a word at least")
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(name, [self.ids.setdefault(w, len(self.ids)) for w in normal_words(text)]) for name, text in items]
        for _, words in sequences:
            state = 0
            for word in words:
                state = self._extend(state, word)
        self.ends: list[dict[int, set[str]]] = [{} for _ in self.link]
        for name, words in sequences:
            self._mark(name, words, window)
        self.least = min((min(len(words), window) for _, words in sequences if words), default=0)
        pairs = {a * len(self.ids) + b for _, words in sequences for a, b in zip(words, words[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        #: The nearest state on the way of links, itself included, that has windows; -1 if there is none.
        self.nearest = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.nearest[state] = state if self.ends[state] else self.nearest[self.link[state]]

    def _extend(self, last: int, word: int) -> int:
        """The state of the sequence of ``last`` with ``word`` behind it."""
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            known = self.next[at][word]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, word, known)
        return new

    def _split(self, at: int, word: int, known: int) -> int:
        """Parts from ``known`` the sequences that are no longer than those of ``at`` with ``word``."""
        short = self._state(dict(self.next[known]), self.length[at] + 1, self.link[known])
        self.link[known] = short
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = short
            at = self.link[at]
        return short

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _mark(self, name: str, words: list[int], window: int) -> None:
        state, own = 0, min(window, len(words))
        for i, word in enumerate(words):
            state = self.next[state][word]
            while self.length[self.link[state]] >= own:  # no more than the window's words
                state = self.link[state]
            if i + 1 >= own:
                self.ends[state].setdefault(own, set()).add(name)

    def stretches(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Place and words of the stretches that can hold a window."""
        n = len(words)
        if n < self.least or not self.least:
            return
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, n)
        linked = (ids[1:] >= 0) & (ids[:-1] >= 0)
        if len(self.pairs):
            keys = ids[:-1][linked] * len(self.ids) + ids[1:][linked]
            near = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            linked[linked] = self.pairs[near] == keys
        else:
            linked[:] = False
        starts = np.flatnonzero(np.concatenate([[True], ~linked]))
        sizes = np.diff(starts, append=n)
        for i in np.flatnonzero((sizes >= self.least) & (ids[starts] >= 0)).tolist():
            yield int(starts[i]), ids[starts[i] : starts[i] + sizes[i]].tolist()

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Spans of hit words, names of the items whose windows occur, and the length of the longest match."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        longest = 0
        following, link, lengths, nearest = self.next, self.link, self.length, self.nearest
        for start, ids in self.stretches(words):
            state = length = 0
            for at, word in enumerate(ids, start + 1):
                while state and word not in following[state]:
                    state = link[state]
                    length = lengths[state]
                state = following[state].get(word, 0)
                length = length + 1 if state else 0
                longest = max(longest, length)
                end, own = nearest[state], 0
                while end > 0:
                    for size, names in self.ends[end].items():
                        if size <= length:
                            own = max(own, size)
                            found |= names
                    end = nearest[link[end]]
                if own:
                    begin = at - own
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, at))
        return spans, found, longest


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal spans of words that some span has; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its words in the spans and what stands between them; all else stays as it is."""
    places = [m.span() for m in ITEM_WORD.finditer(text.lower())]
    kept, at = [], 0
    for start, stop in spans:
        kept.append(text[at : places[start][0]])
        at = places[stop - 1][1]
    return b"".join([*kept, text[at:]])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
FOUND = "n_words long, longest long, spans array<struct<start: long, stop: long>>, items array<string>"


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What the test items have in common with each row of ``docs``.

    Returns doc_id, text, n_words, longest (the words of the longest match, 0 if
    no stretch is long enough for a window), spans (maximal ranges of hit words,
    from 0, stop excluded) and items (names of the items whose windows occur,
    each once, sorted). ``items`` has item_id and text; an item without words
    has no window, a null item_id is named by the empty text, and rows of one
    item_id are one item with several texts. Null and empty texts have no words;
    a text of any length streams past whole. Repeated rows and null doc_ids stay
    as they are, empty tables give no rows or no hits, other columns are ignored.

    Items go to the driver and to every task in blocks of ``most_bytes`` bytes of
    text, over all of which one automaton is held at a time. Documents pass one
    block's automaton after the other, what they have met is stored between.
    """
    spark = docs.sparkSession
    names = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    fields = docs.select("doc_id").schema.simpleString()[len("struct<") : -1].replace("doc_id:", "doc_id ") + ", text binary, " + FOUND
    empty = [F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("longest"), F.lit(None).cast("array<struct<start: long, stop: long>>").alias("spans"), F.lit(None).cast("array<string>").alias("items")]
    met = in_text_batches(docs).select("doc_id", F.col("text").cast("binary").alias("text"), *empty)
    for i, block in enumerate(in_blocks(items.select(names, F.col("text").cast("binary").alias("text")), "text", most_bytes)):
        held = spark.sparkContext.broadcast(Automaton(((r.item_id, bytes(r.text) if r.text else None) for r in block), window))
        met = (cut(met) if i else met).mapInArrow(lambda batches, held=held: _streamed(batches, held.value), fields)
    return met


def _streamed(batches: Iterator[pa.RecordBatch], automaton: Automaton) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words_, longest, spans, items = [], [], [], []
        for text, before, old, known in zip(batch.column(1), *(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
            words = normal_words(text.as_py())
            new, found, length = automaton.match(words)
            words_.append(len(words))
            longest.append(max(before, length))
            spans.append(united(new + [(s["start"], s["stop"]) for s in old]) if old else new)
            items.append(sorted(found.union(known), key=str.encode) if known else sorted(found, key=str.encode))
        pairs = [[{"start": a, "stop": b} for a, b in s] for s in spans]
        columns = [batch.column(0), batch.column(1), pa.array(words_, pa.int64()), pa.array(longest, pa.int64()), pa.array(pairs, SPANS), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, most_coverage: float = 0.5, texts: bool = True, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Removes from each row of ``docs`` the spans that test items have too, and names what is left.

    Returns the columns of :func:`contamination` without the text, n_hit (hit
    words), n_items, coverage (hit words by all words, 0 without words),
    contaminated (a word is hit), dropped (the coverage exceeds
    ``most_coverage``) and, with ``texts``, kept: the text without its hit
    spans, as it was if none is hit, null where the document is dropped or its
    text is null. Odd rows are treated as there.
    """
    met = contamination(docs, items, window, most_bytes)
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"]), F.lit(0).cast("long"))
    coverage = F.when(F.col("n_words") > 0, F.col("n_hit") / F.col("n_words")).otherwise(0.0)
    out = met.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("coverage", coverage)
    out = out.withColumn("contaminated", F.col("n_hit") > 0).withColumn("dropped", F.col("coverage") > most_coverage)
    if not texts:
        return out.drop("text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.drop("text").schema.fields) + ", kept string"
    return out.mapInArrow(_cut_out, fields)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, spans, dropped in zip(batch.column("text"), batch.column("spans").to_pylist(), batch.column("dropped").to_pylist(), strict=True):
            whole = None if dropped else text.as_py()
            kept.append(without(whole, [(s["start"], s["stop"]) for s in spans]) if whole and spans else whole)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept"])
