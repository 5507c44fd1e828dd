from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from folderloom.llm.neighbours import search

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in fine:
        if q % 50 == 0:
            s = sorted(((-(x @ y) / np.sqrt((x @ x) * (y @ y)), i) for i, y in fine if i != q))[:k]
            out[q] = [(i, -c) for c, i in s]
    return out


def test_recall_scores_and_edges(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    rows = [(k, (centres[k % 20] + rng.normal(size=8) * .4).tolist()) for k in range(3000)]
    rows += [(3000 + k, [1.0] * 8) for k in range(400)]  # one hot vector
    rows += [(9000, None), (9050, [0.0] * 8), (9100, [1.0, None] * 4), (9150, [float("nan")] * 8), (9200, [float("inf")] * 8),
             (9250, [1.0] * 3), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "leaf": F.lit(1)})
    got = search(frame, lambda c: c % 50 == 0, leaf=40, part=64).collect()
    want = brute(rows)
    found: dict = {}
    for r in sorted(got, key=lambda r: r.rank):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(want)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and len(v) == 8 and None not in v}
    for q, x in found.items():
        assert [s for _, s in x] == sorted((s for _, s in x), reverse=True) and q not in [i for i, _ in x]
        for i, s in x:
            a, b = exact[q], exact[i]
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert [i for i, _ in found[3000]] == [3001, 3002, 3003, 3004, 3005]


def test_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert search(empty, lambda c: c % 50 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0])], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in search(two, lambda c: c % 50 == 0).collect()] == [(0, 1, 1)]


def test_queries_in_small_leaves_still_get_k_rows(spark):
    """Thirty groups of equal vectors and eight small groups: a leaf may hold fewer than five others."""
    rng = np.random.default_rng(11)
    far = [rng.normal(size=8) for _ in range(38)]
    rows = [(k, far[k % 30].tolist()) for k in range(3000)]
    rows += [(10_000 + 25 * k, far[30 + k // 3].tolist()) for k in range(24)] + [(10_000, far[30].tolist())] * 9
    found: dict = {}
    for r in search(spark.createDataFrame(rows, SCHEMA), lambda c: c % 50 == 0, sample=3000, leaf=20).collect():
        found.setdefault(r.query_id, []).append(r.rank)
    assert set(found) == {i for i, _ in rows if i % 50 == 0} and all(sorted(x) == [1, 2, 3, 4, 5] for x in found.values())
