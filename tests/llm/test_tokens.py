"""BPE round trips and token files against the tokenizers library on whole texts."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomspark.llm import bpe
from loomspark.llm.bpe import WordBpe, encode_decode, pieces
from loomspark.llm.token_files import compress, decoded_documents, lengths, library_ids, read_documents, read_token_files, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "",
    None,
    "<|endoftext|> a<|startoftext|>b <|endoftext",
    "ΑΣ Σ it's WE'LL \x1c\x1d a b᠎c é İ İx 12 3٤ …",
    "a\x00b\x85c ̀x",
    "'s't 'S don't",
    "a" * 3000,
    "中文字 かな 한국어 😀😀👍🏽",
    "a b",
    "a b",
]


def texts():
    rnd = random.Random(5)
    return ODD + ["".join(rnd.choice("abcdeinthst'.,!?19<|>é ßΣ\n\t") for _ in range(rnd.randint(0, 150))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_trie_gives_the_librarys_ids(library):
    own = WordBpe(PATH)
    for text in texts():
        of = own.encode_pieces(set(pieces(text or "")))
        packed = b"".join(of[p] for p in pieces(text or ""))
        assert list(memoryview(packed).cast("i")) == library.encode(text or "", add_special_tokens=False).ids, text


def test_a_very_long_word(library):
    text = "".join(random.Random(1).choice("abcdefghé中") for _ in range(150_000))
    packed = WordBpe(PATH).encode_pieces({text})[text]
    assert list(memoryview(packed).cast("i")) == library.encode(text, add_special_tokens=False).ids


def test_words_are_split_and_encoded_once(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    own, split, tried = WordBpe(PATH), [], []
    pretokens, encode_words = own.pretokens, own.encode_words
    monkeypatch.setattr(own, "pretokens", lambda piece: split.append(piece) or pretokens(piece))
    monkeypatch.setattr(own, "encode_words", lambda words: tried.extend(words) or encode_words(words))
    words, marks = [a + b for a in "bdfgl" for b in ("an", "é", "um", "ich")], list(".,!?") + ["...", ""]
    text = " ".join(w + m for word in words for w in (word, word.title()) for m in marks)
    for _ in range(3):
        assert len(list(bpe.encoded_runs(own, [text]))) == 1
    assert len(split) < len(marks) and len(tried) == len(set(tried)) == len(words) + len(marks) - 1


def test_round_trip(spark, library):
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    for r in encode_decode(docs, PATH).collect():
        text = rows[3 if r.doc_id is None else r.doc_id][1] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert encode_decode(docs.limit(0), PATH).count() == 0


def test_pieces_of_the_library(library):
    given = [t or "" for t in texts()]
    ids, sizes = library_ids(PATH, given, 1)
    ends = np.cumsum(sizes)
    for text, start, stop in zip(given, ends - sizes, ends, strict=True):
        assert ids[start:stop].tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_pieces_of_any_signs(library):
    rnd = random.Random(8)
    signs = "abcXYZ'.,!é ÈßſKİΣς٣0<|>\x1c\x85\u3000\u200b\u0301"
    given = ["".join(rnd.choices(signs, k=rnd.randrange(40))) for _ in range(2000)] + ["", "  ", "<|endoftext|>. a<|startoftext|>", "e\u0301a E\u0301A."]
    for some in (given, [t for t in given if "\x1c" not in t], [""], []):
        ids, sizes = library_ids(PATH, some, 1)
        want = [library.encode(t, add_special_tokens=False).ids + [1] for t in some]
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def test_letters_that_are_a_letter_and_a_mark_in_nfc(library):
    text = "\u0f57. \u0f43, \u0958! \u0f57 \u0f57a. é."
    want = library.encode(text, add_special_tokens=False).ids
    assert library_ids(PATH, [text], 1)[0].tolist() == [*want, 1]
    ((_, of, codes, _),) = bpe.encoded_runs(WordBpe(PATH), [text])
    assert np.frombuffer(b"".join(of.take(codes).to_pylist()), np.int32).tolist() == want


@pytest.mark.parametrize("kinds", [2, 3, 50])
def test_grammar_round_trip(kinds):
    rnd = np.random.default_rng(kinds)
    sizes = rnd.integers(1, 40, 200)
    ids, ends = rnd.integers(0, kinds, sizes.sum()).astype(np.uint32), np.cumsum(sizes)
    symbols, places, rules = compress(ids, ends, 100, 8)
    assert len(rules) and len(symbols) < len(ids)
    inside = np.ones(len(symbols) - 1, bool)
    inside[places[:-1] - 1] = False
    assert np.unique(np.stack([symbols[:-1], symbols[1:]])[:, inside], axis=1, return_counts=True)[1].max() < 8
    row = {
        "rules": rules.astype(np.uint32).tobytes(),
        "rule_lengths": lengths(rules, 100).astype(np.uint32).tobytes(),
        "vocabulary": 100,
        "symbols": symbols.astype(np.uint16).tobytes(),
        "doc_ids": list(range(200)),
        "doc_places": places.tolist(),
    }
    for (i, got), start, stop in zip(decoded_documents(row), ends - sizes, ends, strict=True):
        assert got.tolist() == ids[start:stop].tolist(), i


def test_token_files(spark, library, tmp_path):
    rows = [(i * 7 % 1000 if i != 3 else None, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    write_token_files(docs, f"{tmp_path}/files", PATH, 49_408, shard_bytes=5000, least=3)
    at = 0
    got = {(r.doc_id, r.start): r for r in read_token_files(spark, f"{tmp_path}/files").collect()}
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        r = got.pop((doc_id, at))
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    assert not got


def test_single_documents(spark, library, tmp_path):
    rows = [(i % 300, t) for i, t in enumerate(texts())] + [(900, "the cat sat on the mat " * 20_000), (None, "no id")]
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), f"{tmp_path}/files", PATH, 49_408, shard_bytes=5000, least=3)
    wanted = spark.createDataFrame([(i,) for i in (0, 5, 5, 299, 900, 12345, None)], "doc_id long")
    got = sorted((r.doc_id, r.ids) for r in read_documents(spark, f"{tmp_path}/files", wanted).collect())
    assert got == sorted((i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows if i in (0, 5, 299, 900))
    every = read_token_files(spark, f"{tmp_path}/files", ids=False).collect()
    assert sorted(r.doc_id is None or r.doc_id for r in every) == sorted(i is None or i for i, _ in rows)
    assert sorted((r.start, r.n_tokens) for r in every)[-1] == (sum(r.n_tokens for r in every) - next(r.n_tokens for r in every if r.doc_id == 900), next(r.n_tokens for r in every if r.doc_id == 900))


def test_repeated_rows_and_a_long_text_round_trip(spark, library):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (2, "It's a very long text, isn't it? " * 30_000)]
    got = encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    want = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(want, key=str)


def test_no_token_files_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    write_token_files(docs, f"{tmp_path}/none", PATH, 49_408)
    assert read_token_files(spark, f"{tmp_path}/none").count() == 0
