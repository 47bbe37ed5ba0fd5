"""Byte-level BPE against the library that the rank file is for."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from kinweave.llm import byte_bpe

SCHEMA = "doc_id long, text string, n_tokens long, ids binary, no_id string"


@pytest.fixture(scope="module")
def ranks():
    held = byte_bpe.read_vocabulary(byte_bpe.default_path())
    return dict(zip(held.entries, held.ranks.tolist(), strict=True))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    return byte_bpe.Codec(byte_bpe.vocabulary(ranks), public_tokenizers.PATTERN)


def ids(codec, text):
    return np.frombuffer(b"".join(codec.pieces(text)), "<u4").tolist()


def test_the_hash_finds_every_entry_and_no_other_word(codec, ranks):
    words = list(ranks)
    assert codec.look_up(words) == list(ranks.values())
    other = [w + b"\x00z" for w in words[:5000]]
    assert set(codec.look_up([w for w in other if w not in ranks])) == {-1} and codec.look_up([]) == []


def test_the_heap_as_the_library(codec, library, ranks):
    rng = random.Random(5)
    for alphabet in ("ab", "aeinrst", "äöüß é", "日本語中文字", "\x00\x7f\U0001f600🇩🇪 a", "0123456789", "=-_*"):
        for _ in range(200):
            word = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
            assert ids(codec, word) == library.encode_ordinary(word)
            data = word.encode()
            assert codec.merge(data) == (library._core_bpe.encode_single_piece(data) if data not in ranks else codec.merge(data))


def test_all_characters_fall_into_the_same_pre_tokens(codec, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 4096):
        for text in ("".join(every[at : at + 4096]), " a1 ".join(every[at : at + 4096 : 7]), "  ".join(every[at : at + 4096 : 5])):
            assert ids(codec, text) == library.encode_ordinary(text)


def test_another_pattern(ranks):
    """Of a pattern that isn't the public one, white space isn't taken for an end of its matches."""
    other = r"[a-z]+ [a-z]+|."
    codec = byte_bpe.Codec(byte_bpe.vocabulary(ranks), other)
    library = tiktoken.Encoding("other", pat_str=other, mergeable_ranks=ranks, special_tokens={})
    for text in ("ab cd ef gh", "one two three", "of the of the"):
        assert ids(codec, text) == library.encode_ordinary(text)


def test_texts_and_long_words(codec, library):
    rng = random.Random(6)
    texts = ["", " ", "\n\n  x", "don't I'll 'S", "<|endoftext|>", "a" * 30_000, "x́" * 3000, " " * 5000 + "end", "tab\t\t\tx  y   "]
    texts += ["".join(rng.choice(["the ", "Wort", "\r\n", "12", "é", "🙂", "  ", ".", "naïve ", "x'd"]) for _ in range(2000)) for _ in range(20)]
    for text in texts:
        assert ids(codec, text) == library.encode_ordinary(text)
        assert codec.decode(b"".join(codec.pieces(text))) == text.encode()
    with pytest.raises(IndexError):
        codec.decode(np.array([60_000], "<u4").tobytes())


def test_words_are_forgotten_and_learned_again(codec, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "HELD", 50)
    monkeypatch.setattr(byte_bpe, "HELD_BYTES", 6)
    monkeypatch.setattr(byte_bpe, "CHUNK", 40)
    rng = random.Random(7)
    words = [f"w{rng.randint(0, 10**9)}" * rng.randint(1, 3) for _ in range(200)]
    for _ in range(30):
        text = " ".join(rng.choice(words) for _ in range(300))
        assert ids(codec, text) == library.encode_ordinary(text)


def test_encode(spark, library):
    rows = [(1, "One two, drei vier!"), (2, None), (3, ""), (None, "no id"), (None, "no id"), (2**60 + 1, "große Zahl"), (4, "word " * 400_000), (1, "One two, drei vier!")]
    docs = spark.createDataFrame([(i, t, 7, b"x", "y") for i, t in rows], SCHEMA).repartition(3)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted(((i, len(own), sha(np.array(own, "<u4").tobytes()), sha((t or "").encode())) for i, t in rows for own in [library.encode_ordinary(t or "")]), key=repr)
    assert sorted(map(tuple, byte_bpe.encode(docs).collect()), key=repr) == want
    back = byte_bpe.decode(byte_bpe.encode(docs, with_ids=True)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert byte_bpe.encode(docs.limit(0)).count() == 0
