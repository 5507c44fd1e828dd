from __future__ import annotations

import itertools
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq

from folderloom.llm import filter_audit
from folderloom.llm.filter_audit import audit, mask, words

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failed(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(c for c, f in zip("ABCD", (
        len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        re.search(r"[#$%&*|]", text) is not None), strict=True) if f)


def brute(rows, labels):
    texts: dict = {}
    for d, t, _ in rows:
        texts.setdefault(t or "", set()).add(filter_audit.LARGEST if d is None else d)
    docs: dict = {}
    for d, t, s in rows:
        fails = set(failed(t or "")) | ({"E"} if min(texts[t or ""]) < (filter_audit.LARGEST if d is None else d) else set())
        own = [(q, x) for i, q, x in labels if i is not None and i == d]
        docs.setdefault(s or "", []).append((fails, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out, shapley = [], {}
    for part, some in docs.items():
        for order in itertools.permutations("ABCDE"):
            left = some
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                left = [x for x in left if f not in x[0]]
                out.append([part, "".join(order), step + 1, len(left), len(gone), sum(f in x[0] for x in some) - len(gone),
                            sum(x[0] == {f} for x in some), sum(x[1] for x in gone), sum(x[2] for x in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def write(folder, files, labels, spark):
    path = folder / "documents.parquet"
    path.mkdir()
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string()), ("key", pa.int32()), ("part", pa.string())])
    for k, rows in enumerate(files):
        columns = [[r[i] for r in rows] for i in range(3)]
        pq.write_table(pa.table([*columns, [1] * len(rows), ["x"] * len(rows)], schema=kinds), path / f"{k}.parquet")
    return str(path), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def corpus(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n // 2):
        w = ["%s%d" % (rng.choice("ab"), rng.randrange(rng.choice([20, 900]))) for _ in range(rng.randrange(20, 90))]
        texts.append(" ".join(w) + rng.choice(["", "", " 5%", "\tABCDEFGHIJKLMNOPQRSTUVWXYZ", " é"]))
    rows = [(d, rng.choice(texts), rng.choice(["s1", "s2", None, ""])) for d in rng.sample(range(10 * n), n)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d, _, _ in rows if rng.random() < .5]
    return rows, labels


def test_smaller_ids_that_come_later_are_retracted(spark, tmp_path):
    rows, labels = corpus(4, 300)
    rows += [(7000 + k, "hot " * 60, "s3") for k in range(200)] + [(5, "hot " * 60, "s1"), (None, "hot " * 60, "s1")]
    rows += [(9000, None, "s2"), (9001, "", "s2"), (9001, "", "s4"), (9001, "", "s4"), (None, "alone", "s4"), (None, "alone", None)]
    labels += [(5, 1, 1), (5, 0, 0), (None, 1, 1), (9001, 1, None)]
    rows.sort(key=lambda r: -(r[0] or 0))  # the smallest ids come last
    path, frame = write(tmp_path, [rows[k::1][:120] for k in range(0, len(rows), 120)], labels, spark)
    got = audit(spark, path, frame, rounds=5)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_one_file_and_an_empty_one(spark, tmp_path):
    rows, labels = corpus(6, 40)
    path, frame = write(tmp_path, [rows], labels, spark)
    assert sorted(map(tuple, audit(spark, f"{path}/0.parquet", frame).collect())) == brute(rows, labels)
    (tmp_path / "none").mkdir()
    path, frame = write(tmp_path / "none", [[]], [], spark)
    assert audit(spark, path, frame).collect() == []


def test_masks_of_long_and_odd_texts(monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "a", "A", "é" * 20 + "A", "#", "x\x0by\x0cz", "x\xa0y", "x\x1cy"] + [t for _, t, _ in corpus(8, 60)[0]]
    texts += ["".join(rng.choice("aB  \n") for _ in range(400)) for _ in range(30)]
    letters = lambda m: "".join(c for i, c in enumerate("ABCD") if m >> i & 1)
    assert [letters(mask(t.encode())) for t in texts] == [failed(t) for t in texts]
    whole = [words(t.encode()) for t in texts]
    monkeypatch.setattr(filter_audit, "LONG", 30)
    assert [words(t.encode()) for t in texts] == whole
