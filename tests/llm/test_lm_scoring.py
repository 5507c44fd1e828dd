from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folderloom.llm.lm_scoring import START, Lattice, Table, scores

PATH = public_tokenizers.path("piece_bpe_32k.model")


def small():
    pieces = {p: k for k, p in enumerate([START, "a", "b", START + "a", "ab", "ba", "aba"])}
    return Lattice(pieces, np.log(np.r_[np.arange(1, 8) / 40, np.full(256, 1e-3)]), 7)


def segmentations(s, lattice):
    if not s:
        yield []
    for n in range(1, len(s) + 1):
        if s[:n] in lattice.pieces:
            ids = [lattice.pieces[s[:n]]]
        elif n == 1:
            ids = [lattice.bytes_at + b for b in s.encode()[:len(s[0].encode())]]
        else:
            continue
        for rest in segmentations(s[n:], lattice):
            yield ids + rest


def test_forward_sums_all_segmentations():
    lattice = small()
    for word in ("a", "ab", "abab", "aéb", "漢ba", "baabaab"):
        all_ways = [sum(lattice.logs[k] for k in ids) for ids in segmentations(START + word, lattice)]
        assert lattice.forward(word) == pytest.approx(np.logaddexp.reduce(all_ways))
        counts, want = np.zeros(len(lattice.logs)), np.zeros(len(lattice.logs))
        lattice.expect(word, counts)
        for ids, w in zip(segmentations(START + word, lattice), all_ways, strict=True):
            for k in ids:
                want[k] += math.exp(w - lattice.forward(word))
        assert np.allclose(counts, want)
    assert math.isfinite(lattice.forward("ab" * 5000))


def test_many_words_at_a_time():
    for lattice in (small(), Lattice.from_file(PATH)):
        many = ["a", "ab", "ba", "b", "abéb", "漢ba", "x" * 80, "the", "tionhe,", "ab" * 24] * 3
        one, side = np.zeros(len(lattice.logs)), np.zeros(len(lattice.logs))
        for w in many:
            lattice.expect(w, one)
        Table(lattice).expect(many, side)
        assert np.allclose(one, side)
        assert np.allclose(Table(lattice).forward(many), [lattice.forward(w) for w in many])


def words(t):
    return re.findall(r"[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_against_brute_force(spark, docs):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["The", "thing,", "été", "x\x1cy", "rare%d" % rng.randrange(200), "漢字"]) for _ in range(rng.randrange(30))))
            for k in range(60)] + [(100, None), (101, ""), (102, " \n"), (203, "The the"), (203, "The the"), (103, "q" * 3000)]
    train = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    c, ends = Counter(), 0
    for d, t in rows:
        if train(d):
            c.update(words(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    frame = docs(rows).withColumns({"score": F.lit("x"), "token": F.lit(1), "train": F.crc32(F.col("doc_id").cast("string")) % 7 != 2})
    results = {}
    for frequent in (10 ** 6, 20, 1):  # all, some and no words by broadcast
        got = scores(frame, F.col("train"), PATH, ["doc_id"], frequent=frequent).collect()
        assert len(got) == len(rows)
        results[frequent] = sorted((r.doc_id, r.n_tokens, round(r.score, 6)) for r in got)
        texts = dict(rows)
        for r in got:
            w = words(texts[r.doc_id])
            base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
            assert r.base_score == pytest.approx(base) and r.score < 0
    assert results[10 ** 6] == results[20] == results[1]


def test_nothing_to_learn(docs):
    got = scores(docs([(1, "a b"), (2, None)]), F.lit(False), PATH, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 3, 0, 0, 0), (2, 1, 0, 0, 0)]
    assert all(r.score < 0 for r in got)
    assert scores(docs([]), F.lit(True), PATH, ["doc_id"]).collect() == []
