from __future__ import annotations

import glob
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folderloom.llm import token_files
from folderloom.llm.token_files import Encoder, TokenFile, file_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [0], np.uint32).tobytes()


def test_encoder_gives_what_the_library_gives(library, monkeypatch):
    monkeypatch.setattr(token_files, "PIECE", 60)
    monkeypatch.setattr(token_files, "MEMO", 40)
    rng = random.Random(5)
    parts = ["word", "don't", "'s", "x1", "12", "é", "漢字", "<|endoftext|>", "\n", "\t", " ", "  ", " ", "　", "\x1c", "\x85", "a" * 70,
             "᠎", "﻿", "​", "!?", "\r\n", "Ġ", "ĠĠ"]
    texts = ["", " ", "a", " a", "a ", "a b", "a  b", "a \nb", "\n", "a\n b c\n"]
    texts += ["".join(rng.choice(["", " ", " ", " ", "\n"]) + rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += [" ".join(rng.choice(parts[:8]) for _ in range(rng.randrange(80))) for _ in range(400)]
    assert list(Encoder(PATH, 0).texts(pa.array(texts))) == [library(t) for t in texts]
    monkeypatch.setattr(token_files, "SLAB", 300)
    assert list(Encoder(PATH, 0).texts(pa.array([None, *texts, None]).slice(1))) == [library(t) for t in [*texts, None]]


def test_a_file_is_plain_zstandard_and_opens_only_what_is_asked():
    rng = np.random.default_rng(1)
    docs = [(k * 3 if k else None, rng.integers(0, 50_000, n, dtype=np.uint32).tobytes()) for k, n in enumerate([5, 0, 900, 1, 4000, 3, 3])]
    content = file_bytes(docs, frame=1024) + token_files.EMPTY_FRAME
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True) as stream:
        assert stream.read() == b"".join(ids for _, ids in docs)
    f = TokenFile.of(content)
    assert list(f.documents()) == list(enumerate(ids for _, ids in docs))
    assert f.known.tolist() == [False] + [True] * 6 and f.doc_ids.tolist()[1:] == [3, 6, 9, 12, 15, 18]
    f = TokenFile.of(content)
    assert [ids for _, ids in f.documents([5, 6])] == [docs[5][1], docs[6][1]] and f.frames_read <= 2
    damaged = bytearray(content)
    damaged[int(f.at[2]) + 40] ^= 1
    assert next(TokenFile.of(bytes(damaged)).documents([0]))[1] == docs[0][1]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(TokenFile.of(bytes(damaged)).documents([2]))
    with pytest.raises(ValueError):
        TokenFile.of(content[:-20])


def test_round_trip(docs, spark, tmp_path, library):
    rng = random.Random(3)
    rows = [(k * 7 % 501, " ".join("w%d" % rng.randrange(900) for _ in range(rng.randrange(60)))) for k in range(500)]
    rows += [(9, "x y z " * 9000), (None, "no id"), (None, None), (600, None), (601, ""), (602, "a b"), (602, "a b"), (602, "b a")]
    frame = docs(rows).repartition(7).withColumns({"file": F.lit("x"), "start": F.lit(1), "_h": F.lit(2)})
    folder = str(tmp_path / "t")
    files = token_files.write(frame, folder, PATH, file_size=30_000, frame=4096)
    got = sorted(map(tuple, token_files.read(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert sorted(((d, zlib.crc32(x)) for d, _, _, x in got), key=str) == sorted(((d, zlib.crc32(library(t))) for d, t in rows), key=str)
    at = 0
    for _, start, n, ids in got:
        assert (start, 4 * n) == (at, len(ids))
        at += n
    assert files.count() > 5 and files.agg(F.sum("n_ids")).head()[0] == at
    some = token_files.read(spark, folder, [602, 9, 77777]).collect()
    assert sorted(map(tuple, some)) == [r for r in sorted(x for x in got if x[0] is not None) if r[0] in (9, 602)]
    name = glob.glob(f"{folder}/ids/part-*")[0]
    assert token_files.opened(spark, name).doc_ids.tolist() == TokenFile.of(open(name, "rb").read()).doc_ids.tolist()


def test_empty_table(docs, spark, tmp_path):
    folder = str(tmp_path / "t")
    assert token_files.write(docs([]), folder, PATH).collect() == []
    assert token_files.read(spark, folder).collect() == [] and token_files.read(spark, folder, [1]).collect() == []
    with pytest.raises(ValueError):
        token_files.read(spark, str(tmp_path / "none"))
