from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from folderloom.llm.quality import Model, features, fit, score
from folderloom.llm.text import flat


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(3, 80))]
        bad = k % 4 == 0
        out.append((k, "!! ".join(words).upper() if bad else " ".join(words).capitalize() + ".", int(not bad)))
    return out


def test_held_out_accuracy_without_negative_labels(spark, docs):
    known = rows(400, 1)
    for kept in (lambda r: r[0] % 3 == 0, lambda r: r[0] % 2 == 1 and r[2] == 1):  # both labels; positives only
        labels = spark.createDataFrame([(r[0], r[2]) for r in known if kept(r)], "doc_id long, quality int")
        model = fit(docs(known), labels)
        assert 0.6 < model.prior < 0.95
        got = {r.doc_id: r.score for r in score(docs(rows(100, 2)), model, ["doc_id"]).collect()}
        assert sum((got[k] >= 0.7) == bool(q) for k, _, q in rows(100, 2)) >= 95


def test_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    model = fit(docs(rows(10, 1)), labels)  # no usable positive
    got = score(docs([(1, None), (2, ""), (2, ""), (3, "x" * 5_000_000)]).withColumn("score", F.lit("clash")), model, ["doc_id"])
    assert sorted((r.doc_id, r.score) for r in got.collect()) == [(1, .5), (2, .5), (2, .5), (3, .5)]
    assert score(docs([]), model, ["doc_id"]).collect() == []
    assert fit(docs([]), labels).weights is None


def test_features_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["", "a b a b a b", "Ü\n\nü", None, "$$$ x!", "   "]
    whole = features(*flat(pa.array(texts)))
    for k, t in enumerate(texts):
        assert np.allclose(whole[k], features(*flat(pa.array([t], pa.string())))[0])
    assert Model(np.zeros((0, 2)), np.zeros((0, 2)), None).weights is None
