from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from folderloom.llm.language_id import PART, fit, ngrams, predict

SYLLABLES = {"aa": ["ba", "lo", "ti", "ne"], "bb": ["ür", "sch", "ei", "gt"], "cc": ["漢", "字", "仮", "名"]}


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(k, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(2, 40))), lang)
            for k in range(n) for lang in [sorted(SYLLABLES)[k % 3]]]


def brute(text):
    folded = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} ")
    folded = " ".join([""] + folded.split(" ") + [""])
    while "  " in folded:
        folded = folded.replace("  ", " ")
    return {folded[i:i + n] for n in (1, 2, 3) for i in range(len(folded) - n + 1)} - {" "}


def test_ngrams_are_exact():
    for text in ("", "a", "Ab, c!! é漢字", "x  y\n\nZ", "1 2 3", "ΑΣ ſ"):
        assert len(ngrams(text)) == len(brute(text)), text
    long = "abc dé " * (PART // 7 * 2)
    assert np.array_equal(ngrams(long), ngrams("abc dé abc dé "))


def test_held_out_accuracy_and_edges(docs):
    rows = texts(240)
    model = fit(docs(rows), sample=150)
    got = predict(docs(texts(90, 2)), model, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 89
    assert all(0 <= r.score <= 1 for r in got)
    odd = [(1, None, "aa"), (2, "", "aa"), (3, "123 !?", "aa"), (4, "ba lo", None), (4, "ba lo", None), (5, "ba " * 400_000, "aa")]
    frame = docs(odd).withColumn("lang_pred", F.lit("clash"))
    got = {(r.doc_id, r.lang_pred) for r in predict(frame, model, ["doc_id"]).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "aa")}
    none = fit(docs([(1, "abc", None), (2, None, "aa")]))
    assert [r.lang_pred for r in predict(docs([(1, "abc")]), none, ["doc_id"]).collect()] == ["und"]
    assert predict(docs([]), fit(docs([])), ["doc_id"]).collect() == []
