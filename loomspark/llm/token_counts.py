"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The best segmentation of a pre-token is the one whose pieces have the highest
scores in sum. The forward score of a prefix, the best sum and the number of
tokens on its way, is the same for every pre-token that begins with it, so the
distinct pre-tokens of a batch go through a trie, depth first, and each shared
prefix is scored once. What a document needs is the count at the end of each of
its pre-tokens. Pieces and scores are those of a public model file.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm.bpe import runs
from loomspark.llm.common import in_text_batches

#: The sign that stands for a space, and what an unknown character costs more than the worst piece.
SPACE, PENALTY = "\u2581", 10
#: Characters that end a pre-token, unless a piece holds them.
STOPS = "\n\r\t"
REMEMBERED, TOO_MUCH = 400_000, 1 << 60


class UnigramCounts:
    """The pieces of a model with a whole negative score each; a character that is no piece falls back to one token a byte.

    Of equal sums the one with the longest last piece counts.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.cost = {model.id_to_piece(i): -round(model.get_score(i)) for i in usable}
        self.unknown = max(self.cost.values()) + PENALTY
        self.longest = max(map(len, self.cost))
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.cost):
            raise ValueError("pieces reach over the end of a word")
        stops = "".join(c for c in STOPS if not any(c in piece for piece in self.cost))
        self.pretoken = re.compile(f"{SPACE}*[^{SPACE}{stops}]+|{SPACE}+" + (f"|[{stops}]" if stops else ""))
        self.known: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        """A text begins with a space; each pre-token holds the spaces before it."""
        return self.pretoken.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count_words(self, words: Iterable[str]) -> dict[str, int]:
        """The number of tokens of each pre-token; the forward scores of a shared prefix are computed once."""
        found: dict[str, int] = {}
        cost, longest = self.cost, self.longest
        least, tokens, before = [0], [0], ""  # the trie's path: forward cost and tokens at each depth
        for word in sorted(words):
            common, n = 0, min(len(before), len(word))
            while common < n and before[common] == word[common]:
                common += 1
            del least[common + 1 :], tokens[common + 1 :]
            for depth in range(common + 1, len(word) + 1):
                best, count = TOO_MUCH, 0
                for start in range(depth - longest if depth > longest else 0, depth):
                    c = cost.get(word[start:depth])
                    if c is not None:
                        c += least[start]
                        if c < best:
                            best, count = c, tokens[start] + 1
                if word[depth - 1] not in cost and least[-1] + self.unknown < best:
                    best, count = least[-1] + self.unknown, tokens[-1] + len(word[depth - 1].encode())
                least.append(best)
                tokens.append(count)
            found[word] = tokens[len(word)]
            before = word
        return found

    def learn(self, words: set[str]) -> None:
        """Sees to it that ``known`` has the counts of all these pre-tokens."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known.update(self.count_words(words - self.known.keys()))


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounts:
    return UnigramCounts(path)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """How many tokens every whole text has, whatever its length.

    Returns doc_id, n_bytes, n_pretokens and n_tokens. ``path`` is a public
    model file of pieces with scores, which every executor has. Null and empty
    texts have none of either; repeated rows and null ids stay as they are, an
    empty table gives no rows, other columns are ignored.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            at = 0
            for run in runs(batch.column(1).to_pylist()):
                split = [own.pretokens(text) for text in run]
                own.learn(set().union(*split))
                of = own.known.__getitem__
                rows = [(len(text.encode()), len(words), sum(map(of, words))) for text, words in zip(run, split, strict=True)]
                columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(run)), *columns], ["doc_id", "n_bytes", "n_pretokens", "n_tokens"])
                at += len(run)

    return in_text_batches(docs).select("doc_id", "text").mapInArrow(step, "doc_id long, n_bytes long, n_pretokens long, n_tokens long")
