from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from folderloom.llm.centroids import Centroids, cluster

SCHEMA = "vec_id long, embedding array<double>"


def brute_nearest(x, centres):
    """(smallest distance, smallest number with it), by Python's whole numbers."""
    return min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(centres))


def brute(rows, dim, k=16, rounds=3):
    kept = [(i, [math.floor(max(min(64 * x, 2.0**27), -2.0**27)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and None not in v and all(map(math.isfinite, v))]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centres = [q for _, q in named[:k]]
    if not centres:
        return [], []
    for _ in range(rounds):
        groups: dict = {}
        for _, q in kept:
            groups.setdefault(brute_nearest(q, centres)[1], []).append(q)
        for c, members in groups.items():
            centres[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return [(i, *brute_nearest(q, centres)[::-1]) for i, q in kept], centres


def same(frame, rows, dim, **kw):
    found, table = cluster(frame, dim=dim, **kw)
    want, centres = brute(rows, dim, kw.get("k", 16))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    got = sorted(map(tuple, table.collect()))
    spent = [sum(d for _, c, d in want if c == i) for i in range(len(centres))]
    assert got == [(i, c, spent[i], sum(spent)) for i, c in enumerate(centres)]


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).round(2).tolist()) for k in range(400)]
    rows += [(1000 + k, [0.5] * 8) for k in range(200)]  # one hot vector
    rows += [(2000, [1.0] * 8), (2000, [1.0] * 8), (2000, [-1.0] * 8), (None, [0.25] * 8), (3, rows[3][1])]
    rows += [(5000, None), (5001, [1.0] * 7), (5002, [1.0] * 7 + [None]), (5003, [float("nan")] * 8), (5004, [float("-inf")] * 8), (5005, [])]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"id": F.lit("x"), "q": F.lit(1), "cluster": F.lit(2)})
    same(frame, rows, 8)


def test_huge_components_stay_exact(spark):
    rows = [(k, [float(10 ** (k % 7)) * (-1) ** k, 0.3 * k, 1e300 if k == 5 else 2.0**18 - 1]) for k in range(40)]
    same(spark.createDataFrame(rows, SCHEMA), rows, 3, k=5)


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    same(spark.createDataFrame(rows, SCHEMA), rows, 2)
    for some in ([], [(None, [1.0, 2.0])]):
        found, table = cluster(spark.createDataFrame(some, SCHEMA), dim=2)
        assert found.collect() == [] and table.collect() == []


def test_inequalities_skip_work_and_no_tie():
    rng = np.random.default_rng(9)
    centres = rng.integers(-90, 90, (60, 6)) + rng.integers(-200, 200, (60, 1))
    centres[7] = centres[41]  # a tie of two whole centroids
    c, x = Centroids(centres.tolist()), rng.integers(-300, 300, (500, 6))
    x[:50] = centres[41]
    number, distance = c.nearest(x)
    assert [(int(d), int(n)) for n, d in zip(number, distance, strict=True)] == [brute_nearest(v, centres) for v in x]
    assert c.visited < 500 * 60 / 2
