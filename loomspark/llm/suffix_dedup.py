"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Every repeat of ``SPAN`` bytes holds an anchor: the place of the least hash
among its first ``WINDOW`` places, which depends on nothing but the string. So
not all suffixes need sorting but those at anchors, about one in 64, each with
the bytes in front that its strings can begin with.

1. Hashes of the first ``CORE`` bytes of the anchors' suffixes tell which occur
   twice; the others can't be part of a repeat.
2. Each batch of documents sorts the rest, keeps equal ones once, codes them by
   what they share with the one before, and exchanges these runs.
3. A loser tree merges the runs of a bucket. It compares known common prefixes
   first and bytes only behind them. Neighbours in the merged order that share
   a core are compared to the last byte, front and back.
4. A core that occurs more often than a task can compare goes another way: the
   strings around it are counted by hash over all tasks, those counted twice by
   their bytes.
5. The batches get back which strings repeat, and remove them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import cut, cut_by, in_text_batches
from loomspark.llm.rolling import Spans, flat, mix, ranges_of

#: Bytes of a repeat, places of a window (a power of two), bytes of a gram, and bytes behind any anchor that its strings hold.
SPAN, WINDOW, GRAM = 200, 128, 8
CORE = SPAN - WINDOW + 1
#: Bytes of text that are hashed at once.
STEP_BYTES = 1 << 20


def anchors(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors, and the first and last string of ``SPAN`` bytes that belongs to each."""
    sizes = np.diff(borders)
    n = len(data)
    if n < SPAN or not (sizes >= SPAN).any():
        return (np.zeros(0, np.int64),) * 3
    wide = data.astype(np.uint64)
    gram = np.zeros(n - GRAM + 1, np.uint64)
    for i in range(GRAM):
        gram |= wide[i : n - GRAM + 1 + i] << np.uint64(8 * i)
    least = (mix(gram) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    step = 1
    while step < WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    valid = np.zeros(n + 1, np.int8)
    long = sizes >= SPAN
    valid[borders[:-1][long]] += 1
    valid[borders[1:][long] - SPAN + 1] -= 1
    starts = np.flatnonzero(np.cumsum(valid[:-1]))
    of = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(np.diff(of, prepend=-1))
    return of[change], starts[change], starts[np.append(change[1:], len(starts)) - 1]


def core_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return Spans(data).of(at, at + CORE).view(np.int64)


def _hashes(rows: pa.Table) -> pa.Table:
    """Core hashes of each batch of documents, with their number."""
    key = rows.column("batch")[0].as_py()
    _, _, data, borders = _unpacked(rows)
    hashes = [np.zeros(0, np.int64)]
    for start, stop in ranges_of(borders, STEP_BYTES):
        some = data[borders[start] : borders[stop]]
        at, _, _ = anchors(some, borders[start : stop + 1] - borders[start])
        if len(at):
            hashes.append(core_hashes(some, at))
    found, times = np.unique(np.concatenate(hashes), return_counts=True)
    return pa.table([pa.array(np.full(len(found), key, np.int64)), pa.array(found), pa.array(times.astype(np.int32))], ["batch", "hash", "times"])


PACKED = "batch long, doc_ids array<long>, first long, size long, texts binary"


def _packed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The documents of each batch in one row, their texts compressed, for the way to where the batch is worked on.

    A batch is named by its first row number. It lies between two multiples of
    ``1 << bits`` and inside one Arrow batch, so it has no more documents than
    that and no more bytes than an Arrow batch or one text.
    """
    for batch in batches:
        row_no = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(row_no >> bits)) + 1).tolist(), len(row_no)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if start == stop:
                continue
            data, borders = flat(batch.column(1).slice(start, stop - start))
            raw = np.diff(borders).astype(np.int64).tobytes() + data.tobytes()
            row = [int(row_no[start]), batch.column(2).slice(start, stop - start).to_pylist(), int(row_no[start]), len(raw), pa.compress(raw, "zstd", asbytes=True)]
            types = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["batch", "doc_ids", "first", "size", "texts"])


def _unpacked(rows: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's doc_ids, row numbers, bytes and borders, in the order of the numbers."""
    doc_ids: list = []
    numbers, sizes, data = [], [np.zeros(1, np.int64)], []
    for row in sorted(rows.to_pylist(), key=lambda r: r["first"]):
        raw = pa.decompress(row["texts"], row["size"], "zstd", asbytes=True)
        n = len(row["doc_ids"])
        doc_ids += row["doc_ids"]
        numbers.append(row["first"] + np.arange(n))
        sizes.append(np.frombuffer(raw, np.int64, n))
        data.append(np.frombuffer(raw, np.uint8, len(raw) - 8 * n, 8 * n))
    return doc_ids, np.concatenate([np.zeros(0, np.int64), *numbers]), np.concatenate([np.zeros(0, np.uint8), *data]), np.cumsum(np.concatenate(sizes))


def front_coded(entries: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """Sorted (suffix, front, number, times) as one run: each suffix without what it shares with the one before."""
    wide = np.zeros((len(entries), SPAN), np.uint8)
    sizes = np.array([len(e[0]) for e in entries])
    wide[np.arange(SPAN)[None, :] < sizes[:, None]] = np.frombuffer(b"".join([e[0] for e in entries]), np.uint8)
    shared = np.zeros(len(entries), np.int64)
    if len(entries) > 1:
        differ = wide[1:] != wide[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), SPAN)
        shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    head = np.array([len(entries)], np.uint32).tobytes()
    numbers = np.array([e[2] for e in entries], np.uint32).tobytes()
    small = [shared, sizes, [len(e[1]) for e in entries], [min(e[3], 2) for e in entries]]
    rests = b"".join([e[0][k:] for e, k in zip(entries, shared.tolist(), strict=True)])
    run = head + numbers + b"".join(np.array(x, np.uint8).tobytes() for x in small) + rests + b"".join([e[1] for e in entries])
    return np.array([len(run)], np.uint32).tobytes() + pa.compress(run, "zstd", asbytes=True)


def decoded(run: bytes) -> Iterator[tuple[bytes, int, bytes, int, int]]:
    """(suffix, bytes shared with the one before, front, number, times) of a run, one after the other."""
    run = pa.decompress(run[4:], int(np.frombuffer(run, np.uint32, 1)[0]), "zstd", asbytes=True)
    n = int(np.frombuffer(run, np.uint32, 1)[0])
    numbers = np.frombuffer(run, np.uint32, n, 4).tolist()
    shared, sizes, fronts, times = (np.frombuffer(run, np.uint8, n, 4 + 4 * n + i * n).tolist() for i in range(4))
    at, front_at, suffix = 4 + 8 * n, 4 + 8 * n + sum(sizes) - sum(shared), b""
    for i in range(n):
        more = sizes[i] - shared[i]
        suffix = suffix[: shared[i]] + run[at : at + more]
        at += more
        yield suffix, shared[i], run[front_at : front_at + fronts[i]], numbers[i], times[i]
        front_at += fronts[i]


def shared_bytes(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs by the prefix that each head shares with the last output.

    Of two heads the one that shares more with the last output is smaller; only
    if both share the same length, bytes are compared, from there on, and the
    loser keeps what it shares with the winner.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int, bytes, int, int]]]):
        self.runs, self.heads = runs, [next(r, None) for r in runs]
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.shared = [0] * self.size
        self.heads += [None] * (self.size - len(runs))
        self.losers = [-1] * self.size
        self.winner = self._play(1)

    def _less(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared length becomes the one with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.shared[a], self.shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        k = shared_bytes(x[0], y[0], p)
        a_first = len(x[0]) <= k or len(y[0]) > k and x[0][k] < y[0][k]
        self.shared[b if a_first else a] = k
        return (a, b) if a_first else (b, a)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        best, self.losers[node] = self._less(self._play(2 * node), self._play(2 * node + 1))
        return best

    def __iter__(self) -> Iterator[tuple[int, int, tuple[bytes, int, bytes, int, int]]]:
        """(run, bytes shared with the output before, entry) in the order of suffixes."""
        while (head := self.heads[run := self.winner]) is not None:
            yield run, self.shared[run], head
            following = next(self.runs[run], None)
            self.heads[run] = following
            self.shared[run] = following[1] if following is not None else 0
            node, best = (run + self.size) // 2, run
            while node:
                best, self.losers[node] = self._less(best, self.losers[node])
                node //= 2
            self.winner = best


def repeats(group: list[tuple[bytes, bytes, int]], pairs: int) -> list[list[tuple[int, int]]]:
    """For distinct (suffix, front, times) with one core, the offsets of the anchor in strings that another one or a copy has.

    Up to ``pairs`` of them are compared in pairs, more by whole strings, an offset at a time.
    """
    own = [(SPAN - len(s), len(f)) for s, f, _ in group]
    if len(group) > pairs:
        found: list[list[tuple[int, int]]] = [[] for _ in group]
        for a in range(WINDOW):
            keys = [(s[: SPAN - a], f[:a]) if lo <= a <= hi else None for (s, f, _), (lo, hi) in zip(group, own, strict=True)]
            times = Counter(keys)
            for i, key in enumerate(keys):
                if key is not None and times[key] > 1:
                    found[i].append((a, a))
    else:
        found = [[] for _ in group]
        for i, (s, f, _) in enumerate(group):
            for j in range(i):
                lo = max(SPAN - shared_bytes(s, group[j][0], CORE), own[i][0], own[j][0])
                hi = min(shared_bytes(f, group[j][1]), own[i][1], own[j][1])
                if lo <= hi:
                    found[i].append((lo, hi))
                    found[j].append((lo, hi))
    return [[o] if times > 1 else x for o, x, (_, _, times) in zip(own, found, group, strict=True)]


def _runs(rows: pa.Table, flagged: pa.Table, buckets: int, bits: int) -> pa.Table:
    """The front-coded runs of a batch, one for each bucket, one of hot cores under bucket -2, and under bucket -1 where its suffixes are."""
    out: list[tuple[int, int, bytes]] = []
    key = rows.column("batch")[0].as_py() if rows.num_rows else None
    wanted = np.unique(flagged.column("hash").to_numpy())
    hot = set(flagged.filter(flagged.column("hot")).column("hash").to_pylist())
    if key is not None and len(wanted):
        _, row_no, data, borders = _unpacked(rows)
        low = row_no & ((1 << bits) - 1)
        numbers: dict[tuple[bytes, bytes], int] = {}
        held: dict[int, list] = {}
        times: list[int] = []
        places: list[np.ndarray] = []
        for start, stop in ranges_of(borders, STEP_BYTES):
            base, own = borders[start], borders[start : stop + 1] - borders[start]
            some = data[base : borders[stop]]
            at, first, last = anchors(some, own)
            if not len(at):
                continue
            hashes = core_hashes(some, at)
            found = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes)
            doc = np.searchsorted(own, at[found], "right") - 1
            text, number = some.tobytes(), np.zeros(len(found), np.int64)
            for i, (x, lo, hi, h) in enumerate(zip(at[found].tolist(), first[found].tolist(), last[found].tolist(), hashes[found].tolist(), strict=True)):
                entry = text[x : hi + SPAN], text[lo:x][::-1]
                k = numbers.get(entry)
                if k is None:
                    k = numbers[entry] = len(times)
                    times.append(0)
                    held.setdefault(-2 if h in hot else h % buckets, []).append((*entry, k))
                times[k] += 1
                number[i] = k
            places.append(np.stack([number, low[start:stop][doc], at[found] - own[doc]]).astype(np.int32))
        for bucket, entries in held.items():
            entries.sort()
            out.append((bucket, key, front_coded([(s, f, k, times[k]) for s, f, k in entries])))
        if places:
            out.append((-1, key, np.concatenate(places, 1).tobytes()))
    return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "batch", "run"])


def _merged(rows: pa.Table, pairs: int) -> pa.Table:
    """The strings of a bucket that repeat: batch, number of the suffix, first and last offset of its anchor."""
    batches = rows.column("batch").to_pylist()
    tree = LoserTree([decoded(r) for r in rows.column("run").to_pylist()])
    out: list[tuple[int, int, int, int]] = []
    group: dict[tuple[bytes, bytes], list] = {}

    def close() -> None:
        distinct = [(s, f, times) for (s, f), (times, _) in group.items()]
        if len(distinct) > 1 or distinct and distinct[0][2] > 1:
            for (_, where), ranges in zip(group.values(), repeats(distinct, pairs), strict=True):
                out.extend((b, k, lo, hi) for b, k in where for lo, hi in ranges)
        group.clear()

    for run, shared, (suffix, _, front, number, times) in tree:
        if shared < CORE:
            close()
        held = group.setdefault((suffix, front), [0, []])
        held[0] += times
        held[1].append((batches[run], number))
    close()
    return pa.table([pa.array([x[i] for x in out], pa.int64() if i < 2 else pa.int32()) for i in range(4)], ["batch", "number", "low", "high"])


STRINGS = "hash long, string binary, times int, batch long, at int, numbers array<long>"


def _strings(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """The different strings around each hot core of a batch: hash and times, and if ``whole`` also bytes, anchor and suffixes.

    ``batches`` has the batch and its run of hot cores. Only equal cores can be
    in equal strings, so no more than the contexts of one are held at once.
    """
    out: list[tuple] = []

    def full() -> pa.RecordBatch:
        columns = [pa.array([x[i] for x in out], t) for i, t in enumerate([pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())])]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["hash", "string", "times", "batch", "at", "numbers"])

    def close(key: int, group: list[tuple[bytes, bytes, int, int]]) -> Iterator[pa.RecordBatch]:
        for a in range(WINDOW):
            at: dict[bytes, list] = {}
            for s, f, number, times in group:
                if SPAN - len(s) <= a <= len(f):
                    held = at.setdefault(f[:a][::-1] + s[: SPAN - a], [0, []])
                    held[0] += times
                    held[1].append(number)
            for string, (times, numbers) in at.items():
                digest = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)
                out.append((digest, string, min(times, 2), key, a, numbers) if whole else (digest, None, min(times, 2), None, None, None))
                if len(out) >= 4096:
                    yield full()

    for batch in batches:
        for key, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            group: list[tuple[bytes, bytes, int, int]] = []
            for suffix, shared, front, number, times in decoded(run):
                if shared < CORE:
                    yield from close(key, group)
                    group = []
                group.append((suffix, front, number, times))
            yield from close(key, group)
    if out:
        yield full()


def _hot_ranges(runs: DataFrame) -> DataFrame:
    """The repeated strings around hot cores, as :func:`_merged` gives them; ``runs`` has the batches' runs of hot cores.

    Both counts combine before they exchange. Hashes only choose the strings
    whose bytes are looked at; a batch has one row for each of them.
    """
    twice = runs.mapInArrow(lambda x: _strings(x, False), STRINGS).groupBy("hash").agg(F.sum("times").alias("n")).filter("n > 1").select("hash")
    held = cut(runs.mapInArrow(lambda x: _strings(x, True), STRINGS).join(twice, "hash", "left_semi"))
    same = held.groupBy("string").agg(F.sum("times").alias("n")).filter("n > 1").select("string")
    found = held.join(same, "string", "left_semi")
    return found.select("batch", F.explode("numbers").alias("number"), F.col("at").alias("low"), F.col("at").alias("high"))


def _removed(rows: pa.Table, found: pa.Table, bits: int) -> pa.Table:
    """The result rows of a batch. ``found`` has the batch's places in one row and ranges of repeats in the others."""
    doc_ids, row_no, data, borders = _unpacked(rows)
    depth = np.zeros(len(data) + 1, np.int32)
    packed = [p for p in found.column("run").to_pylist() if p is not None]
    if packed:
        number, low, at = np.frombuffer(b"".join(packed), np.int32).reshape(len(packed), 3, -1)[0].astype(np.int64)
        order = np.argsort(number, kind="stable")
        number, start = number[order], borders[np.searchsorted(row_no & ((1 << bits) - 1), low)][order] + at[order]
        ranges = found.filter(found.column("run").is_null())
        of = ranges.column("number").to_numpy()
        lo, hi = np.searchsorted(number, of), np.searchsorted(number, of, "right")
        which = np.repeat(np.arange(len(of)), hi - lo)
        place = start[np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        np.add.at(depth, place - ranges.column("high").to_numpy()[which], 1)
        np.add.at(depth, place - ranges.column("low").to_numpy()[which] + SPAN, -1)
    gone = np.cumsum(depth[:-1]) > 0
    kept, total = data[~gone].tobytes(), np.concatenate([[0], np.cumsum(gone)])
    begins = gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]
    begins[borders[:-1][borders[:-1] < len(data)]] |= gone[borders[:-1][borders[:-1] < len(data)]]
    spans = np.concatenate([[0], np.cumsum(begins)])
    removed, at = np.diff(total[borders]), borders - total[borders]
    texts = [kept[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.table(
        [pa.array(doc_ids, pa.int64()), pa.array(row_no), pa.array(np.diff(borders)), pa.array(removed.astype(np.int64)), pa.array(np.diff(spans[borders]).astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary())],
        ["doc_id", "row_no", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
    )


def remove_repeats(docs: DataFrame, texts: bool = True, bits: int = 10, bucket_rows: int = 20_000, pairs: int = 24, most: int = 20_000) -> DataFrame:
    """Every document without the bytes that a string of 200 bytes covers which also starts anywhere else.

    Returns doc_id, row_no, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and kept (the bytes that stay, null unless ``texts``). Strings
    are judged on the input, overlaps within a document count, and no string
    crosses the end of a document. Null counts as empty; rows that repeat a
    text, with the same id or not, are repeats of each other. Texts may be of any length. An empty table
    gives no rows; other columns are ignored. ``docs`` is read once: its rows
    are numbered, packed into batches and kept in the shared folder. A batch is ``1 << bits`` documents or
    16 MB of text at most, unless one text is longer: then it is that text alone, whose bytes one task holds with two numbers for each. A bucket has ``bucket_rows`` suffixes on
    average, ``pairs`` is how many are compared each with each, ``most`` how
    often a core may occur whose contexts one task compares.
    """
    rows = in_text_batches(docs).select("doc_id", "text").withColumn("row_no", F.monotonically_increasing_id())
    packed = cut_by(rows.select("row_no", "text", "doc_id").mapInArrow(lambda x: _packed(x, bits), PACKED), "batch")
    seen = packed.groupBy("batch").applyInArrow(_hashes, "batch long, hash long, times int")
    times = F.sum("times").over(Window.partitionBy("hash"))
    flagged = cut(seen.withColumn("n", times).filter("n > 1").select("batch", "hash", (F.col("n") > most).alias("hot")))
    counted = flagged.agg(F.count_if(~F.col("hot")).alias("few"), F.count_if("hot").alias("hot")).first()
    buckets = max(1, -(-counted.few // bucket_rows))
    by_batch = packed.groupBy("batch")
    runs = by_batch.cogroup(flagged.groupBy("batch")).applyInArrow(lambda a, b: _runs(a, b, buckets, bits), "bucket long, batch long, run binary")
    runs = cut(runs)
    ranges = runs.filter("bucket >= 0").groupBy("bucket").applyInArrow(lambda x: _merged(x, pairs), "batch long, number long, low int, high int")
    if counted.hot:
        ranges = ranges.unionByName(_hot_ranges(runs.filter("bucket = -2").select("batch", "run")))
    places = runs.filter("bucket = -1").select("batch", F.lit(None).cast("long").alias("number"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"), "run")
    found = ranges.withColumn("run", F.lit(None).cast("binary")).unionByName(places)

    def finish(own: pa.Table, known: pa.Table) -> pa.Table:
        done = _removed(own, known, bits)
        return done if texts else done.set_column(6, "kept", pa.nulls(done.num_rows, pa.binary()))

    return by_batch.cogroup(found.groupBy("batch")).applyInArrow(
        finish, "doc_id long, row_no long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
