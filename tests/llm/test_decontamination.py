from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from folderloom.llm.decontamination import contaminated, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[k:k + window]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case():
    rng = random.Random(5)
    vocabulary = ["a", "Bé", "c1", "漢", "zz", "ß"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(k, text(rng.choice([3, 9, 10, 14]))) for k in range(12)] + [(99, ""), (98, None), (None, text(12)), (3, "zz zz zz a")]
    rows = [(k, text(rng.randrange(0, 60)) + rng.choice(["", rng.choice(items)[1] or ""]) + text(5)) for k in range(60)]
    return [*rows, (7, None), (8, ""), (8, ""), (None, items[0][1])], items


def test_against_brute_force(spark, docs):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for blocks in (1 << 20, 60):  # the second: many blocks
        got = contaminated(docs(rows).withColumn("hits", F.lit(1)), bench, block_bytes=blocks)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, items)
    assert contaminated(docs([]), bench).collect() == []
    assert {r.n_hit for r in contaminated(docs(rows), bench.limit(0)).collect()} == {0}


def test_removal(spark, docs):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    clashing = docs(rows).withColumns({"items": F.lit("x"), "_row": F.lit(2)})
    kept = decontaminate(clashing, bench)
    assert kept.columns == clashing.columns
    clean = [r for r, b in zip(sorted(rows, key=str), [], strict=False)] or [r for r in rows if not brute([r], items)[0][5]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(clean, key=str)
    cut = decontaminate(clashing, bench, remove="spans").collect()
    assert len(cut) == len(rows)
    expected = {str(b[0]): b[1] - b[2] for b in brute(rows[:60], items)}
    assert {str(r.doc_id): len(words(r.text)) for r in cut if r.doc_id is not None and r.doc_id not in (7, 8)} == {
        k: v for k, v in expected.items() if k not in ("7", "8")}
