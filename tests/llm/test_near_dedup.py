from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from folderloom.llm.components import components
from folderloom.llm.near_dedup import ROWS, _odd, _placed, near_duplicates
from folderloom.plans.staging import Stage


def shingles(t, n):
    w = re.findall(r"[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} - {()} if len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def roots(nodes, links):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute(rows, n):
    sets = [(d, shingles(t, n)) for d, t in rows]
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, q in sets[:i]
             if a is not None and b is not None and s and q and 100 * len(s & q) >= 80 * len(s | q)]
    root = roots({d for d, _ in rows if d is not None}, links)
    return sorted(((d, len(s), root.get(d), d is None or root[d] == d) for d, s in sets), key=str)


def corpus(seed, groups):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    rows, k = [], 0
    for size in groups:
        base = [word() for _ in range(rng.randrange(2, 120))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((k, rng.choice([" ", "\n", "  "]).join(copy).upper() if rng.random() < .2 else " ".join(copy)))
            k += 7
    rng.shuffle(rows)
    return rows


def test_against_brute_force(docs):
    rows = corpus(4, [1] * 40 + [2] * 20 + [5] * 6 + [60]) + [(10_001, None), (10_002, ""), (10_003, " "), (10_004, "One"), (10_005, "one"),
                                                              (10_006, "z " * 4000), (None, "One"), (10_004, "One")]
    frame = docs(rows).withColumns({"component_id": F.lit(1), "class": F.lit("x"), "kept": F.lit(0)})
    got = near_duplicates(frame, n=2)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 2)


def test_one_id_on_many_texts(docs):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (1, "q r s t"), (3, "q r s t"), (4, "x"), (4, None), (5, "y")]
    assert {(r.doc_id, r.component_id) for r in near_duplicates(docs(rows), n=2).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}


def test_empty_and_alone(docs):
    assert near_duplicates(docs([])).collect() == []
    assert [tuple(r) for r in near_duplicates(docs([(5, None)])).collect()] == [(5, 0, 5, True)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 540)]
    links = [(a, b) for a, b in links if a != b]
    got = components(spark.createDataFrame(links, "a long, b long"), Stage(spark), "t").collect()
    assert {r.node: r.label for r in got} == roots({x for p in links for x in p}, links)


def test_a_group_that_mostly_does_not_link(docs):
    rng = random.Random(8)
    base, rows = ["b%d" % k for k in range(100)], []
    for k in range(120):
        copy = list(base)
        for at in rng.sample(range(100), rng.choice([0, 1, 2, 4, 6, 7, 8, 9])):
            copy[at] = "e%d" % rng.randrange(20)
        rows.append((k, " ".join(copy)))
    assert sorted(map(tuple, near_duplicates(docs(rows), n=2).collect()), key=str) == brute(rows, 2)


def test_odd_sketches_never_differ_in_more_bits_than_the_sets_in_members():
    rng = np.random.default_rng(3)
    for size in (1, 40, 900, 6000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for changed in (0, 1, size // 9, size):
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)]))
            bits = sum(int(x).bit_count() for x in (_odd(a) ^ _odd(b)).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b))
            assert changed or bits == 0


def test_a_large_group_of_near_copies(docs):
    rng = random.Random(12)
    base, rows = ["b%d" % k for k in range(150)], []
    for k in range(700):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 5])):
            copy[at] = "e%d" % rng.randrange(5000)
        rows.append((k, " ".join(copy)))
    rows += corpus(3, [1] * 60)
    rows = list({d: (d, t) for d, t in rows}.values())
    assert sorted(map(tuple, near_duplicates(docs(rows), n=5).collect()), key=str) == brute(rows, 5)


def apart(seed, size):
    """Near copies of one text, most of which share many keys and do not link."""
    rng = random.Random(seed)
    rows = []
    for k in range(size):
        copy = ["b%d" % w for w in range(200)]
        for at in rng.sample(range(200), 5):
            copy[at] = "e%d" % rng.randrange(5000)
        rows.append((k, " ".join(copy)))
    return rows


def test_rows_of_a_group_follow_its_size(docs, monkeypatch):
    kept, keep = {}, Stage.keep

    def counted(self, df, name, by=()):
        out = keep(self, df, name, by)
        if name.startswith(("active-", "open-")):
            kept[name] = out.count()
        return out

    monkeypatch.setattr(Stage, "keep", counted)
    rows = apart(5, 150)
    assert sorted(map(tuple, near_duplicates(docs(rows), n=5).collect()), key=str) == brute(rows, 5)
    assert kept["active-0"] <= 2 * ROWS * len(rows)
    assert all(v <= ROWS * len(rows) for k, v in kept.items() if k.startswith("open-"))


def test_pairs_that_share_a_key_meet(spark):
    rng = random.Random(2)
    a = {k: [rng.choice([0, 0, 1, k // 2 + 2]) * 10 + at for at in range(3)] for k in range(120)}
    b = {k: [(7 if a[k][0] == 10 else k // 3) * 1000 + 500 + at for at in range(3)] for k in range(120)}
    named = "class long, n long, a array<struct<at:int,value:long>>, b array<struct<at:int,value:long>>"
    left = spark.createDataFrame([(k, 10, list(enumerate(a[k])), [(3 + at, v) for at, v in enumerate(b[k])]) for k in a], named)
    stage = Stage(spark)
    placed = _placed(left, 3, stage).collect()
    assert {r.split for r in spark.read.parquet(f"{stage.root}/values").collect()} == {True, False}
    met = {}
    for kind in ("first", "later"):
        at_key = {}
        for r in placed:
            if r[kind]:
                at_key.setdefault(r.key, []).append(r["class"])
        met[kind] = {(x, y) for some in at_key.values() for x in some for y in some if x < y}
    pairs = [(x, y) for x in a for y in a if x < y]
    assert met["later"] >= {(x, y) for x, y in pairs if set(a[x]) & set(a[y]) and set(b[x]) & set(b[y])}
    assert met["first"] >= {(x, y) for x, y in pairs if any(a[x][k] == a[y][k] and b[x][k] == b[y][k] for k in range(3))}
