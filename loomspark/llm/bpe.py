"""BPE encoding and decoding over a trie that shares prefixes.

White space ends every pre-token, so a text is encoded piece by piece (a piece
is a run without white space), by the different words and marks of a batch. The
distinct pre-tokens of those not met before go into a trie, walked depth first: its state at a prefix
is the last token of that prefix's encoding. A sequence of tokens is the BPE
encoding of its text exactly if each token encodes to itself and no neighbours
would have merged across their border, so the state of a longer prefix is the
one suffix token that is compatible with the state before it. Sorted order
visits the trie depth first, and the path from the root is all that is kept.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomspark.llm.common import in_text_batches

#: The white space of Unicode; Python's own split() also takes U+001C to U+001F.
SPACE = "\t-\r \x85\xa0  -     　"
PIECE = re.compile(f"[^{SPACE}]+")
ODD = re.compile("[\x1c-\x1f]")
#: The pre-tokens of lower-case ASCII text in this tokenizer's pattern.
ASCII_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
END, NEVER = "</w>", 1 << 60
#: Bytes of text that share a trie and that go out in one batch.
TRIE_BYTES, OUT_BYTES = 8 << 20, 1 << 20
#: How many words a worker remembers from late, and as many from before, how many pairs of tokens, and how many words are split at once.
REMEMBERED, PAIRS, AT_ONCE = 200_000, 1 << 20, 5000
#: Marks that are a pre-token of their own behind letters; the apostrophe isn't, letters may follow it.
MARKS = "".join(c for c in string.punctuation if c != "'")


def pieces(text: str) -> list[str]:
    return PIECE.findall(text) if ODD.search(text) else text.split()


def of_letters(word: str) -> bool:
    """Whether a word is one pre-token of letters as the tokenizer sees it; some letters are a letter and a mark in NFC, others in lower case."""
    return unicodedata.normalize("NFC", word).lower().isalpha()


class WordBpe:
    """A BPE tokenizer with word ends, read from its public file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.made = {a + b: (a, b) for a, b in reversed(pairs)}
        self.right_edge: dict[str, list[tuple[str, int]]] = {}
        self.left_edge: dict[str, list[tuple[str, int]]] = {}
        self.whole_known: dict[str, bool] = {}
        usable = {t: i for t, i in self.vocab.items() if self.whole(t)}
        #: Tokens that encode to themselves, inside a word and at its end, there without the sign of the end.
        self.inner = {t: i for t, i in usable.items() if not t.endswith(END)}
        self.final = {t.removesuffix(END): i for t, i in usable.items() if t.endswith(END)}
        #: What a token can begin with: where a text isn't, no token that starts there reaches further.
        self.begins = {t[:n] for known in (self.inner, self.final) for t in known for n in range(1, len(t) + 1)}
        self.packed = {i: i.to_bytes(4, "little") for i in self.names}
        self.fits_known: dict[int, bool] = {}
        #: Words met lately and before; what isn't met again is forgotten.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        #: The text of each id and a space.
        self.spaced = pa.array([f"{self.names[i]} " if i in self.names else None for i in range(max(self.names) + 1)], pa.large_string())

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The symbols at one end of a token while it grows, each with the rank of the merge that ends it."""
        known = (self.left_edge, self.right_edge)[side]
        if token not in known:
            parts = self.made.get(token)
            if parts is None:
                known[token] = [(token, NEVER)]
            else:
                inner = self.edge(parts[side], side)
                known[token] = [*inner[:-1], (inner[-1][0], self.rank[parts]), (token, NEVER)]
        return known[token]

    def apart(self, left: str, right: str, merged_at: int = -1) -> bool:
        """Whether no symbols that meet at the border of two tokens merge before either grows on.

        With ``merged_at``, the rank at which the two whole tokens merge, that
        merge is what is left when nothing else has happened.
        """
        a, b, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            if x_ends == NEVER and y_ends == NEVER and merged_at >= 0:
                return True
            r = self.rank.get((x, y), NEVER)
            if r < x_ends and r <= y_ends:
                return False
            if x_ends == NEVER and y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def fits(self, left: int, right: int) -> bool:
        found = self.apart(self.names[left], self.names[right])
        self.fits_known[left << 17 | right] = found
        return found

    def whole(self, token: str) -> bool:
        """Whether a token encodes to itself: its two halves do, and nothing merges across them before they merge."""
        found = self.whole_known.get(token)
        if found is None:
            parts = self.made.get(token)
            found = parts is None or self.whole(parts[0]) and self.whole(parts[1]) and self.apart(*parts, self.rank[parts])
            self.whole_known[token] = found
        return found

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of pre-tokens (in the byte alphabet), little endian; each shared prefix is computed once."""
        found: dict[str, bytes] = {}
        if len(self.fits_known) > PAIRS:
            self.fits_known.clear()
        # The trie's path: at each depth the last token, the depth before it, and the first start of a token that may reach it.
        last, came_from, open_from, before = [0], [0], [0], ""
        begins, known, packed = self.begins, self.fits_known, self.packed
        for word in sorted(words):
            size = len(word)
            common, n = 0, min(len(before), size - 1, len(last) - 1)
            while common < n and before[common] == word[common]:
                common += 1
            del last[common + 1 :], came_from[common + 1 :], open_from[common + 1 :]
            tokens, first = self.inner, open_from[common]
            for depth in range(common + 1, size + 1):
                if depth == size:
                    tokens = self.final
                while first < depth and word[first:depth] not in begins:
                    first += 1
                for start in range(first, depth):
                    token = tokens.get(word[start:depth])
                    if token is not None:
                        if start == 0:
                            break
                        fits = known.get(last[start] << 17 | token)
                        if fits is None:
                            fits = self.fits(last[start], token)
                        if fits:
                            break
                else:
                    raise ValueError(f"no encoding of {word!r}")
                if depth < size:
                    last.append(token)
                    came_from.append(start)
                    open_from.append(first)
            ids = [packed[token]]
            while start:
                ids.append(packed[last[start]])
                start = came_from[start]
            found[word] = b"".join(ids[::-1])
            before = word
        return found

    def pretokens(self, piece: str) -> list[str]:
        """The pre-tokens of a piece without special tokens, in the byte alphabet."""
        if piece.isascii() and piece.isprintable():
            return ASCII_PRETOKEN.findall(piece.lower())
        return self.shown_pretokens(piece)

    def shown_pretokens(self, text: str) -> list[str]:
        shown = self.library.normalizer.normalize_str(text)
        return [t for t, _ in self.library.pre_tokenizer.pre_tokenize_str(shown)]

    def split(self, wanted: Iterable[str]) -> dict[str, list]:
        """The pre-tokens of pieces, and the packed ids of special tokens between them."""
        found: dict[str, list] = {}
        letters: list[str] = []
        for piece in wanted:
            if piece.isascii():
                if piece.isalpha():
                    found[piece] = [piece.lower()]
                elif "<|" in piece:
                    found[piece] = self.around_special(piece)
                else:
                    found[piece] = self.pretokens(piece)
            elif of_letters(piece):
                letters.append(piece)
            else:
                found[piece] = self.around_special(piece)
        # A word of letters is one pre-token, so many are split in one text.
        for i in range(0, len(letters), AT_ONCE):
            some = letters[i : i + AT_ONCE]
            each = self.shown_pretokens(" ".join(some))
            if len(each) == len(some):
                found.update({word: [x] for word, x in zip(some, each, strict=True)})
            else:
                found.update({word: self.pretokens(word) for word in some})
        return found

    def around_special(self, piece: str) -> list:
        parts: list = []
        for x in self.special_split.split(piece):
            if x in self.special:
                parts.append(self.packed[self.special[x]])
            elif x:
                parts += self.pretokens(x)
        return parts

    def encode_pieces(self, wanted: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct pieces."""
        split = self.split(wanted)
        of = self.encode_words({x for parts in split.values() for x in parts if isinstance(x, str)})
        return {p: of[parts[0]] if len(parts) == 1 and isinstance(parts[0], str) else b"".join([of[x] if isinstance(x, str) else x for x in parts]) for p, parts in split.items()}

    def remembered_ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, those not met lately by the trie."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        new = []
        for word in words:
            if word not in known:
                if word in before:
                    known[word] = before[word]
                else:
                    new.append(word)
        known.update(self.encode_pieces(new))
        return [known[word] for word in words]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def runs(texts: list[str | None], most: int = TRIE_BYTES) -> Iterator[list[str]]:
    """The texts, null as empty, in runs of about so many bytes."""
    run: list[str] = []
    size = 0
    for text in texts:
        run.append(text or "")
        size += len(text or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def distinct_pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different runs without white space, which of them follow one another in all texts, and each text's end among those."""
    if any(map(ODD.search, texts)):
        split = pa.array([pieces(text) for text in texts], pa.large_list(pa.large_string()))
    else:
        split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
    coded = split.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), ends


def strings(column: pa.Array) -> list[str]:
    """As ``to_pylist``, which makes an Arrow scalar of each value first."""
    return column.to_numpy(zero_copy_only=False).tolist()


def words_and_marks(distinct: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Different words, the word of each piece, the pieces that have marks behind it and those marks, which are words too.

    A piece of letters, perhaps with marks behind, is a word and those marks,
    which many pieces share; any other is a word as it is. Case is no matter to
    this tokenizer.
    """
    bare = pc.utf8_rtrim(distinct, characters=MARKS)
    plain = pc.and_(pc.string_is_ascii(bare), pc.ascii_is_alpha(bare))
    whole, words = strings(distinct), strings(pc.if_else(plain, pc.ascii_lower(bare), bare))
    for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
        if words[i].isascii() or not of_letters(words[i]):
            words[i] = whole[i]
    marked = [i for i, (piece, word) in enumerate(zip(whole, words, strict=True)) if len(piece) != len(word)]
    words += [whole[i][len(words[i]) :] for i in marked]
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    of = coded.indices.to_numpy(zero_copy_only=False)
    return strings(coded.dictionary), of[: len(whole)], np.array(marked, np.int64), of[len(whole) :]


def encoded_runs(bpe: WordBpe, texts: list[str | None]) -> Iterator[tuple[list[str], pa.Array, np.ndarray, np.ndarray]]:
    """Runs of texts with the packed ids of their different pieces, which of these follow one another, and each text's end among those."""
    for run in runs(texts):
        distinct, codes, ends = distinct_pieces(run)
        words, word_of, marked, marks = words_and_marks(distinct)
        packed = pa.array([*bpe.remembered_ids(words), b""], pa.large_binary())
        behind = np.full(len(word_of), len(words), np.int64)
        behind[marked] = marks
        halves = packed.take(pa.array(word_of)), packed.take(pa.array(behind))
        yield run, pc.binary_join_element_wise(*halves, pa.scalar(b"", packed.type)), codes, ends


def end_to_end(values: pa.Array, which: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of the values ``which``, one after another, and where each starts and the last ends."""
    taken = values.take(pa.array(which))
    _, offsets, data = taken.buffers()
    held = np.frombuffer(offsets, np.int64, len(taken) + 1, 8 * taken.offset) if len(taken) else np.zeros(1, np.int64)
    return memoryview(data if data is not None else b""), held


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def encode_decode(docs: DataFrame, path: str, ids: bool = True, decoded: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns doc_id, n_tokens, ids (array of int, null unless ``ids``), decoded
    (null unless ``decoded``), ids_sha256 and decoded_sha256: digests of the
    ids as little-endian unsigned 32-bit integers and of the decoded text in
    UTF-8. Null and empty texts have no tokens; repeated rows and null ids stay
    as they are, an empty table gives no rows, other columns are ignored.
    ``path`` is a public tokenizer file that every executor has.
    """

    def out(bpe: WordBpe, doc_ids: pa.Array, of: pa.Array, codes: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        packed, at = end_to_end(of, codes)
        stops = at[np.concatenate([[0], ends])]
        flat = np.frombuffer(packed, np.int32, stops[-1] // 4)
        shown, at = end_to_end(bpe.spaced, flat)
        places = stops // 4
        # A text ends before the space behind its last token.
        texts = [shown[start : max(start, stop - 1)] for start, stop in pairwise(at[places].tolist())]
        counts = pa.array(np.diff(places), pa.int64())
        if ids:
            lists = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(flat))
        else:
            lists = pa.nulls(len(doc_ids), pa.list_(pa.int32()))
        wholes = pa.array([bytes(x) for x in texts], pa.string()) if decoded else pa.nulls(len(doc_ids), pa.string())
        digests = [pa.array([hashlib.sha256(x).hexdigest() for x in some], pa.string()) for some in ([packed[start:stop] for start, stop in pairwise(stops.tolist())], texts)]
        return pa.RecordBatch.from_arrays([doc_ids, counts, lists, wholes, *digests], ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in gathered(batches, TRIE_BYTES):
            done, doc_ids = 0, batch.column(0)
            for run, of, codes, ends in encoded_runs(bpe, batch.column(1).to_pylist()):
                at = begin = 0
                for some in runs(run, OUT_BYTES):
                    mine = ends[at : at + len(some)]
                    yield out(bpe, doc_ids.slice(done + at, len(some)), of, codes[begin : mine[-1]], mine - begin)
                    at, begin = at + len(some), mine[-1]
                done += at
        # The worker goes on to other work, with its memory.
        bpe.known, bpe.before = {}, {}
        pa.default_memory_pool().release_unused()

    return in_text_batches(docs).select("doc_id", "text").mapInArrow(
        step, "doc_id long, n_tokens long, ids array<int>, decoded string, ids_sha256 string, decoded_sha256 string"
    )
