"""N-gram Jaccard self-join of documents by MinHash banding, verified on full n-gram sets.

Texts are shingled into runs of five words. Documents with the same set of
shingles are one row from then on. Signatures are cut into bands; how many, and
of how many rows, follows from the wanted recall. Two sets that agree on a band
meet in that band's bucket, and the pair counts in the first band on which they
agree and in no other, so every pair is looked at once, whatever else its two
sets resemble. First only signatures meet and tell which sets have a partner in
a bucket; then those sets' texts come, and pairs are compared block against
block on full shingle sets. A crowded bucket takes as many blocks as it needs.
Only counts and one link per set leave a block, so thousands of copies that all
differ never become millions of rows, and only verified links join classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import SALTS, by_place, cut, in_text_batches, numbered, with_total
from loomspark.llm.components import components
from loomspark.llm.rolling import Spans, flat, mix, slices, words

#: Bytes of text that are shingled at once, shingles hashed at once, and shingles that a block compares at once.
STEP_BYTES, CHUNK, WIDTH = 1 << 20, 512, 4096
#: Sets of a block of texts and their shingles at most (but for one set alone), sets of a block of signatures, and sets of a bucket that needs no blocks.
BLOCK, BLOCK_SHINGLES, CROWD, FEW = 256, 1 << 20, 512, 16


def chosen_bands(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """Bands and rows of a band: the most rows, so the fewest pairs by chance, with which so many hashes find a pair at the threshold with this probability."""
    found = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > hashes:
            break
        found = bands, rows
    if found is None:
        raise ValueError("too few hashes for this recall")
    return found


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of n words; a shorter text is one run, one without words has none."""
    data, borders = flat(texts)
    starts, stops, first = words(data, borders)
    word = Spans(data).of(starts, stops)
    size = np.diff(first)
    runs = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for i in range(n):
        runs = mix(runs + word[i : len(word) - n + 1 + i]) if len(runs) else runs
    out = []
    for at, count in zip(first[:-1].tolist(), size.tolist(), strict=True):
        if count >= n:
            out.append(np.unique(runs[at : at + count - n + 1]))
        elif count:
            h = np.full(1, count, np.uint64)
            for i in range(count):
                h = mix(h + word[at + i : at + i + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(of: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest of the shingles' hashes under each multiplier."""
    low = (of >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), CHUNK):
        np.minimum(out, (factors[:, None] * low[None, i : i + CHUNK]).min(1), out=out)
    return out


def signed(docs: DataFrame, n: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc_id, row_no, the digest of the shingle set, its size and a hash for each band; all null for a text without words."""
    factors = np.random.default_rng(seed).integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(bands * rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            texts = batch.column(1)
            for start, stop in slices(texts, STEP_BYTES):
                digests, sizes, keys = [], [], []
                for of in shingles(texts.slice(start, stop - start), n):
                    if not len(of):
                        digests.append(None)
                        sizes.append(None)
                        keys.append(None)
                        continue
                    low, high = int(np.bitwise_xor.reduce(mix(of))), int(mix(of + np.uint64(7)).sum())
                    digests.append(low.to_bytes(8, "little") + high.to_bytes(8, "little") + len(of).to_bytes(8, "little"))
                    sizes.append(len(of))
                    mins = mix(signature(of, factors).astype(np.uint64) + salt).reshape(bands, rows)
                    keys.append(mix(mins.sum(1)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), batch.column(2).slice(start, stop - start), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "row_no", "set_id", "size", "bands"],
                )

    return in_text_batches(docs).select("doc_id", "text", "row_no").mapInArrow(step, "doc_id long, row_no long, set_id binary, size int, bands array<long>")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut so that none begins or ends inside a group of rows with equal values in the first columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for i in range(keys):
            values = batch.column(i).to_numpy()
            change[1:] |= values[1:] != values[:-1]
            change[0] |= bool(held) and held[-1].column(i)[-1].as_py() != values[0]
        at = np.flatnonzero(change)
        if len(at):
            held.append(batch.slice(0, at[-1]))
            if whole := [b for b in held if b.num_rows]:
                yield pa.concat_batches(whole)
            held = []
        held.append(batch.slice(at[-1] if len(at) else 0))
    if held:
        yield pa.concat_batches(held)


def group_starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where each group of equal values in the first columns begins, and where the last one ends."""
    change = np.zeros(batch.num_rows + 1, bool)
    change[[0, -1]] = True
    for i in range(keys):
        values = batch.column(i).to_numpy()
        change[1:-1] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def band_keys(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def new_pairs(a: np.ndarray, b: np.ndarray, band: int, sizes_a: np.ndarray, sizes_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs agree on no band before this one, and have sizes that let them reach the threshold."""
    new = np.minimum.outer(sizes_a, sizes_b) >= threshold * np.maximum.outer(sizes_a, sizes_b) - 1e-6
    for k in range(band):
        new &= a[:, k, None] != b[None, :, k]
    return new


def blocks_of(rows: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Rows in the order of their sizes, cut into blocks that are bounded in sets and in shingles."""
    rows = rows[np.argsort(sizes[rows], kind="stable")]
    out, start, held = [], 0, 0
    for at, size in enumerate(sizes[rows].tolist()):
        if at > start and (at - start >= BLOCK or held + size > BLOCK_SHINGLES):
            out.append(rows[start:at])
            start, held = at, 0
        held += size
    return [*out, rows[start:]] if len(rows) else out


BUCKET = ["band", "key", "low", "high"]
BLOCKS = [*BUCKET, "i", "j"]


def partners(members: DataFrame, threshold: float) -> DataFrame:
    """The sets of each bucket that have a new partner there, with the blocks in which they meet it.

    ``members`` has a bucket's band and key, its two blocks of signatures
    (equal ones, or ``side`` tells in which a row is), rep, size and bands.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 4):
            borders = group_starts(batch, 4)
            band, low, high, side, size = (batch.column(i).to_numpy() for i in (0, 2, 3, 4, 6))
            keys, count = band_keys(batch.column(7)), np.diff(borders)
            few = np.repeat(count <= FEW, count)
            rest = np.where(few, np.repeat(borders[1:], count) - np.arange(len(band)) - 1, 0)
            left = np.repeat(np.arange(len(band)), rest)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(rest) - rest, rest)
            meets = np.zeros(len(band), bool)
            for i in range(0, len(left), 1 << 15):
                a, b = left[i : i + (1 << 15)], right[i : i + (1 << 15)]
                new = ~((keys[a] == keys[b]) & (np.arange(keys.shape[1]) < band[a][:, None])).any(1)
                new &= (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-6) & ((low[a] == high[a]) | (side[a] != side[b]))
                meets[a[new]] = meets[b[new]] = True
            rows = np.flatnonzero(meets)
            found = [(rows, np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32), side[rows])]
            for start, stop in zip(borders[:-1][count > FEW].tolist(), borders[1:][count > FEW].tolist(), strict=True):
                own, same = np.arange(start, stop), low[start] == high[start]
                first = blocks_of(own if same else own[side[own] == 0], size)
                second = first if same else blocks_of(own[side[own] == 1], size)
                for i, a in enumerate(first):
                    for j, b in enumerate(second):
                        if same and j < i:
                            continue
                        new = new_pairs(keys[a], keys[b], band[start], size[a], size[b], threshold)
                        if same and i == j:
                            np.fill_diagonal(new, False)
                        met = [(a[new.any(1)], 0)] if same and i == j else [(a[new.any(1)], 0), (b[new.any(0)], 1)]
                        found += [(x, np.full(len(x), i, np.int32), np.full(len(x), j, np.int32), np.full(len(x), s, np.int32)) for x, s in met if len(x)]
            rows, i, j, sides = (np.concatenate(x) for x in zip(*found, strict=True))
            columns = [*(batch.column(k).take(pa.array(rows)) for k in range(4)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sides, pa.int32()), batch.column(5).take(pa.array(rows))]
            yield pa.RecordBatch.from_arrays(columns, [*BLOCKS, "side", "rep"])

    rows = members.select(*BUCKET, "side", "rep", "size", "bands").repartition(*BUCKET).sortWithinPartitions(*BUCKET)
    return rows.mapInArrow(step, "band int, key long, low int, high int, i int, j int, side int, rep long")


def compare(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs of two lists of sets reach the threshold; exactly, by counting common elements."""
    every = sets_a + (sets_b or [])
    sizes = np.array([len(x) for x in every])
    of = np.repeat(np.arange(len(every)), sizes)
    values, column = np.unique(np.concatenate(every), return_inverse=True)
    times = np.bincount(column)
    shared = times[column] > 1
    rank = np.cumsum(times > 1) - 1
    of, column = of[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    n = len(sets_a)
    common = np.zeros((n, len(every) - n if sets_b else n), np.float32)
    width = max(1, min(WIDTH, int(column[-1]) + 1 if len(column) else 1))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        grid = np.zeros((len(every), width), np.float32)
        grid[of[lo:hi], column[lo:hi] - start] = 1
        common += grid[:n] @ (grid[n:] if sets_b else grid).T
    either = sizes[:n, None] + (sizes[n:] if sets_b else sizes)[None, :] - common
    return common >= threshold * either - 1e-6


def lowest(near: np.ndarray) -> np.ndarray:
    """The first row that links lead to from each row of a square table of links."""
    found = np.arange(len(near))
    while True:
        lower = np.minimum(found, np.where(near, found[None, :], len(near)).min(1))
        lower = lower[lower]
        if (lower == found).all():
            return found
        found = lower


def verified(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """rep, the weight of its links and the first row that they lead to inside the blocks, for each linked row of each two blocks.

    ``texts`` has the columns of :func:`partners` and weight, bands and text.
    """

    def linked(of: list[np.ndarray], rows: slice, band: int, side: np.ndarray, keys: np.ndarray) -> np.ndarray:
        sets, keys = of[rows], keys[rows]
        size = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(side[rows] == 0), np.flatnonzero(side[rows] == 1)
        near = np.zeros((len(sets), len(sets)), bool)
        if len(right) and len(left):
            new = new_pairs(keys[left], keys[right], band, size[left], size[right], threshold)
            near[np.ix_(left, right)] = compare([sets[i] for i in left], [sets[i] for i in right], threshold) & new
            near |= near.T
        elif len(left) > 1:
            near = compare(sets, None, threshold) & new_pairs(keys, keys, band, size, size, threshold)
            np.fill_diagonal(near, False)
        return near

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 6):
            band, side, rep, weight = (batch.column(k).to_numpy() for k in (0, 6, 7, 8))
            keys, of = band_keys(batch.column(9)), []
            for start, stop in slices(batch.column(10), STEP_BYTES):
                of += shingles(batch.column(10).slice(start, stop - start), n)
            out = []
            borders = group_starts(batch, 6)
            for start, stop in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                near = linked(of, slice(start, stop), int(band[start]), side, keys)
                links = near @ weight[start:stop]
                some = np.flatnonzero(links)
                if len(some):
                    out.append((rep[start:stop][some], links[some], rep[start:stop][lowest(near)[some]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["rep", "links", "other"])

    rows = texts.select(*BLOCKS, "side", "rep", "weight", "bands", "text").repartition(*BLOCKS).sortWithinPartitions(*BLOCKS, "rep")
    return rows.mapInArrow(step, "rep long, links long, other long")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, hashes: int = 192, seed: int = 11) -> DataFrame:
    """The class and the number of links of every document.

    Returns doc_id, row_no, class_id and n_links. Two documents are linked if
    the Jaccard similarity of their sets of runs of ``n`` words (between ASCII
    white space, as they are) is ``threshold`` or more; a text of fewer words
    is one run. class_id is the smallest doc_id that links lead to, n_links the
    number of other documents linked directly, copies included. A text without
    words (null, empty, white space) has no links and is a class of its own.
    Every linked pair is found with the probability ``recall`` at least, more
    with more similarity; ``hashes`` is how many a signature may have. Repeated
    rows are copies of each other. Very long texts are taken whole; a block of
    texts is bounded by its shingles. Documents with a null id form classes
    too, but no class takes its name from them unless all are null. An empty
    table gives no rows; other columns are ignored. ``docs`` is read once: its
    rows are numbered and kept in the shared folder.
    """
    return classes_of(numbered(docs.select("doc_id", "text"), "row_no"), n, threshold, recall, hashes, seed)


def classes_of(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, hashes: int = 192, seed: int = 11) -> DataFrame:
    """What :func:`near_duplicates` gives, for rows that have a stored ``row_no``."""
    own = cut(signed(docs, n, *chosen_bands(threshold, recall, hashes), seed).withColumn("part", F.pmod(F.xxhash64("row_no"), F.lit(SALTS)).cast("int")))
    sets = cut(
        own.filter("set_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min("row_no").alias("rep"), F.count("*").alias("weight"), F.min("size").alias("size"), F.min_by("bands", "row_no").alias("bands"), F.collect_set("part").alias("parts"))
    )
    dealt = sets.select("rep", F.posexplode("bands").alias("band", "key"))
    met = with_total(dealt, ["band", "key"], "rep", F.count("*"), "n", "n > 1").withColumn("blocks", F.ceil(F.col("n") / CROWD).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = met.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band",
        "key",
        F.least("block", "against").alias("low"),
        F.greatest("block", "against").alias("high"),
        F.when(F.col("block") <= F.col("against"), 0).otherwise(1).alias("side"),
        "rep",
    )
    wanted = cut(partners(members.join(sets.select("rep", "size", "bands"), "rep"), threshold))
    texts = docs.select("text", F.col("row_no").alias("rep")).join(wanted, "rep").join(sets.select("rep", "weight", "bands"), "rep")
    links = cut(verified(texts, n, threshold))
    classes = components(links, "rep", "other")
    totals = links.groupBy("rep").agg(F.sum("links").alias("links"))
    named = (
        sets.select("set_id", "rep", "weight", "parts")
        .join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .join(totals, "rep", "left")
        .select("set_id", F.explode("parts").alias("part"), F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    rows_of = own.select("doc_id", "row_no", "set_id", "part").join(named, ["set_id", "part"], "left")
    rows_of = cut(rows_of.select("doc_id", "row_no", F.coalesce("root", "row_no").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    return with_total(rows_of, ["root"], "row_no", F.min("doc_id"), "class_id").select("doc_id", "row_no", "class_id", "n_links", "root")


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` of which no near copy stays: the first row of each class, with all their columns as they are, whatever these are called.

    What nulls, texts without words, repeated rows and an empty table do is as in :func:`near_duplicates`.
    """
    plain, names = by_place(docs)
    rows = numbered(plain, "row_no")
    classes = classes_of(rows.select(F.col(names["doc_id"]).alias("doc_id"), F.col(names["text"]).alias("text"), "row_no"), **how)
    return rows.join(classes.filter("row_no = root").select("row_no"), "row_no", "left_semi").drop("row_no").toDF(*docs.columns)
