"""Token counts against the public library's unigram search and a path search over every text on its own."""

import random
import re

import public_tokenizers
from sentencepiece import SentencePieceProcessor
from test_tokens import texts

from loomspark.llm.token_counts import UnigramCounts, count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def unigram_library():
    """The public file with its kind set to unigram, which the library then decodes by scores."""
    with open(PATH, "rb") as f:
        raw = f.read()
    at = raw.rindex(b"\x18\x02")  # the field that names the kind is the last one with this tag and value
    return SentencePieceProcessor(model_proto=raw[:at] + b"\x18\x01" + raw[at + 2 :])


def plain_count(own, text):
    """Tokens of the best path over a whole text, spaces and all, without pre-tokens or a trie."""
    text = "\u2581" + text.replace(" ", "\u2581") if text else ""
    paths = [(0, 0)]
    for end in range(1, len(text) + 1):
        some = [(paths[s][0] + own.cost[text[s:end]], s, paths[s][1] + 1) for s in range(max(0, end - own.longest), end) if text[s:end] in own.cost]
        if text[end - 1] not in own.cost:
            some.append((paths[end - 1][0] + own.unknown, end - 1, paths[end - 1][1] + len(text[end - 1].encode())))
        best = min(some)
        paths.append((best[0], best[2]))
    return paths[-1][1]


def test_counts_of_all_lengths(spark):
    rnd = random.Random(3)
    given = texts() + [" \t\n x  y\n\n", "\x1c!\x1c a\x1c", "  ", "a 's it's  12,5 \u00e9\u0301\xa0 b", "\u2581x\u2581\u2581y", "the cat " * 20_000, "ab\u4e2d" * 40_000]
    given += ["".join(rnd.choice(" \n\tab1.'\u00e9\x1d\xa0\u2581") for _ in range(60)) for _ in range(300)]
    rows = [(i if i != 2 else None, t, 1) for i, t in enumerate(given)] + [(7, given[7], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    own = UnigramCounts(PATH)
    want = [(i, len((t or "").encode()), plain_count(own, t or "")) for i, t, _ in rows]
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(docs, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_counts_of_the_library():
    library, own, rnd = unigram_library(), UnigramCounts(PATH), random.Random(4)
    known = [p for p, c in own.cost.items() if c < 32_000]
    letters = [p for p in known if len(p) == 1 and p != "\u2581"]
    for _ in range(400):
        text = "".join(rnd.choice((rnd.choice(known), rnd.choice(letters), " ")) for _ in range(rnd.randint(1, 40))).replace("\u2581", " ")
        if not re.search("  ", text):
            own.learn(set(own.pretokens(text)))
            assert sum(own.known[w] for w in own.pretokens(text)) == len(library.encode(text)), text


def test_shared_prefixes_are_scored_once():
    own, asked = UnigramCounts(PATH), []

    class Cost(dict):
        def get(self, key):
            asked.append(key)
            return dict.get(self, key)

    own.cost = Cost(own.cost)
    own.count_words(["abc", "abcd", "abce", "abx"])
    assert asked.count("ab") == asked.count("abc") == 1
