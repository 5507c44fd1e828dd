from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from folderloom.llm.mixing import mix, subset


def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if 3 * sizes[s] < level * w[s]]
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_targets_and_fit(docs):
    rng = random.Random(3)
    sources = ["b", "a", "é", None, "Z", "tiny"]
    rows = [(k, "w " * rng.choice([0, 1, 5, 5, 40, rng.randrange(300)]), "en",
             "tiny" if k % 97 == 0 else "a" if k % 3 == 0 else rng.choice(sources[:5])) for k in range(600)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "only empty"), (2000, "same", "en", "b"), (2000, "same", "en", "b")]
    got = mix(docs(rows), slices=8).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(docs(rows).repartition(3), slices=8).collect()), key=str)
    assert len(got) == len(rows)
    sizes, taken, want = defaultdict(int), defaultdict(int), {}
    by_id = defaultdict(list)
    for d, t, _, s in rows:
        sizes[s] += len((t or "").split())
        by_id[d].append((len((t or "").split()), s))
    want = brute_targets(sizes)
    for r in got:
        size, s = by_id[r.doc_id][0]
        assert r.size == size and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 3 * size and (size == 0 or r.taken % size == 0)
        taken[s] += r.taken
    for s in sizes:
        longest = max(n for x in by_id.values() for n, q in x if q == s)
        assert abs(taken[s] - want[s]) <= max(1, longest)
    assert mix(docs([])).collect() == []


def test_subset_is_exact_where_a_sum_exists():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 60, 12))
        counts = rng.integers(0, 5, len(lengths))
        total = int((lengths * counts).sum())
        reachable = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            for _ in range(c):
                reachable |= {x + n for x in reachable}
        for budget in rng.integers(0, total + 1, 3).tolist():
            x = subset(lengths, counts, budget, reach=1000)
            assert (x <= counts).all() and (x >= 0).all()
            assert (lengths * x).sum() <= budget
            small = subset(lengths, counts, budget)
            assert budget - (lengths * small).sum() <= lengths.max()
