from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folderloom.llm.token_counts import Encoder, count_by_chunks, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def noise(rng, n):
    alphabet = "abcXYZ éßñΣς漢字0123'!?.,-  ́가\x1c\x85 \t\n   "
    parts = ["<|endoftext|>", "<|startoftext|>", "don't", "l'ê", "é"]
    return "".join(rng.choice(parts) if rng.random() < .05 else rng.choice(alphabet) for _ in range(n))


def test_chunks_equal_the_whole(whole):
    rng, encoder = random.Random(1), Encoder(PATH)
    for _ in range(150):
        text = noise(rng, rng.randrange(1, 900))
        assert encoder.counts([text]) == [whole(text)]
        for chunk, overlap in ((60, 8), (97, 1), (200, 60)):
            assert count_by_chunks(encoder, text, chunk, overlap) == whole(text)
    for text in ("x" * 500, " " * 300, "ab " + "é" * 400 + " cd", "漢" * 300 + "\n" + "z" * 90, "e" + "\u0301\u0323" * 200 + " a b c d e" * 30,
                 "<|endoftext|>" * 60, "it's we'll " * 80, "각" * 90 + "각" * 200):
        for chunk in (32, 61, 128):
            assert count_by_chunks(encoder, text, chunk, 4) == whole(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_vocabularies_and_texts_without_white_space(name):
    path = public_tokenizers.path(name)
    tokenizer, rng, encoder = Tokenizer.from_file(path), random.Random(2), Encoder(path)
    tokenizer.no_truncation()
    alphabet = ("ACGT0123456789+/=", "漢字仮名。、漢字", "ab  \n\n\t cd.,'s 12")
    for letters in alphabet:
        for _ in range(25):
            text = "".join(rng.choice(letters) for _ in range(3000))
            assert count_by_chunks(encoder, text, 256, 32) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_chunks_bound_what_the_library_gets():
    encoder, sizes = Encoder(PATH), []
    given = encoder.tokens
    encoder.tokens = lambda text, at: (sizes.append(len(text)), given(text, at))[1]
    rng = random.Random(3)
    text = "".join(rng.choice("abcxyz0123456789+/") for _ in range(50_000))
    assert count_by_chunks(encoder, text, 1000, 100) == encoder.counts([text])[0]
    assert len(sizes) >= 50 and max(sizes) <= 1500


def test_rows(spark, docs, whole):
    texts = [None, "", "Hello  wörld<|endoftext|>", "a " * 5000, "Hello  wörld<|endoftext|>"]
    df = docs([(k // 2, t) for k, t in enumerate(texts)]).withColumn("n_tokens", F.lit(7))
    got = sorted(map(tuple, token_counts(df, PATH, chunk=256, overlap=8).collect()))
    want = sorted((k // 2, len((t or "").encode()), whole(t or ""), whole(t or "") > 2048) for k, t in enumerate(texts))
    assert got == want
    assert token_counts(docs([]), PATH).collect() == []
