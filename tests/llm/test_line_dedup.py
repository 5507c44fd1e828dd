from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from folderloom.llm.line_dedup import chunks, deduplicate


def corpus():
    rng = random.Random(9)
    line = lambda n: " ".join("w%d" % rng.randrange(500) for _ in range(n))
    passage = "\n".join(line(12) for _ in range(12))
    long = line(60)
    rows = []
    for k in range(60):
        own = [line(rng.randrange(1, 20)) for _ in range(rng.randrange(0, 6))]
        own.insert(rng.randrange(len(own) + 1), rng.choice([passage, long, "", "short line", line(3)]))
        rows.append((k, "\n".join(own)))
    return [*rows, (70, None), (71, ""), (72, "\n\n"), (73, passage + "\n" + line(5) + "\n" + passage), (5, rows[5][1]), (74, "é " * 300_000)]


def test_against_brute_force(docs):
    rows = corpus()
    frame = docs(rows).withColumns({"place": F.lit(1), "_row": F.lit("x")})
    got = deduplicate(frame)
    assert got.columns == frame.columns
    got = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert got == brute(rows)
    assert sum(len(t or "") for _, t in got[:-1]) < 0.9 * sum(len(t or "") for d, t in rows if d != 74) + len(rows[-1][1])
    assert deduplicate(docs([])).collect() == []


def test_long_repeated_lines_go_and_unique_lines_stay(docs):
    rows = corpus()
    lines = [x for _, t in rows for x in (t or "").split("\n") if len(x.split()) == 60]
    texts = [r.text or "" for r in deduplicate(docs(rows)).collect()]
    assert len(lines) > 3 and sum(t.count(lines[0]) for t in texts) == 1


def every_run(rows):
    """Texts by all runs of lines, without chunks(): a run that also stands at an earlier place goes."""
    order, first, runs = lambda x: (x[0] is not None, x[0], x[1]), {}, {}
    for k, (_, t) in enumerate(rows):
        lines, at = [], 0
        for x in t.split("\n"):
            if x.split():
                lines.append((at, at + len(x), len(x.split())))
            at += len(x) + 1
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                total = sum(x[2] for x in lines[i:j + 1])
                if total >= (10 if j > i else 50):
                    runs.setdefault(t[lines[i][0]:lines[j][1]], []).append((rows[k][0], i, k, [x[:2] for x in lines[i:j + 1]]))
    gone, bytes_gone = {k: set() for k in range(len(rows))}, {k: set() for k in range(len(rows))}
    for copies in runs.values():
        first = min(copies, key=order)
        for x in copies:
            if order(x) != order(first):
                gone[x[2]].update(x[3])
                bytes_gone[x[2]].update(range(x[3][0][0], x[3][-1][1] + 1))
    out = []
    for k, (d, t) in enumerate(rows):
        out.append((d, "".join(c for at, c in enumerate(t) if at not in bytes_gone[k]), len(gone[k])))
    return sorted(out, key=str)


def brute(rows):
    """``every_run`` for rows that may be repeated or null; rows of one doc_id have one text."""
    want = {x[0]: x[1] for x in every_run([x for x in dict.fromkeys(rows) if x[1] is not None])}
    return sorted(((d, want.get(d)) for d, _ in rows), key=str)


def test_runs_of_few_ordinary_lines_go_wherever_they_stand(docs):
    rng = random.Random(3)
    line = lambda n: " ".join("v%d" % rng.randrange(10_000) for _ in range(n))
    passages = ["\n".join(line(rng.choice([1, 3, 4, 9, 15, 20])) for _ in range(n)) for n in (2, 3, 4, 4, 5, 6, 8) for _ in range(3)]
    passages += ["\n".join(line(15) for _ in range(4)), line(12) + "\n\n \n" + line(4), line(10) + "\n" + line(1) + "\n" + line(1), line(12), line(55)]
    rows = []
    for k in range(120):
        own = [line(rng.randrange(1, 6)) for _ in range(rng.randrange(1, 6))]
        for _ in range(2):
            own.insert(rng.randrange(len(own) + 1), rng.choice(passages))
        rows.append((k, "\n".join(own)))
    rows += [(200, "\n".join(["a b c d e f"] * 5)), (201, passages[-5])]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in deduplicate(docs(rows).select("doc_id", "text"), report=True).collect()), key=str)
    assert got == every_run(rows)
    texts = [t for _, t, _ in got]
    assert sum(passages[-5] in t for t in texts) == 1 and sum(passages[-2] in t for t in texts) > 1


def marks(text):
    raw = text.encode()
    (_, first, last, _, boundary), (_, hashes), _ = chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return {(int(a), int(b)): int(hashes[k]) for a, b, k in zip(first, last, boundary, strict=True)}, len(hashes)


def test_boundaries_follow_the_content_wherever_it_stands():
    rng = random.Random(5)
    line = lambda n: " ".join("u%d" % rng.randrange(10_000) for _ in range(n))
    for words, most in (((12,), 1.0), ((1, 2, 3), 0.7)):
        passage = [line(rng.choice(words)) for _ in range(40)]
        here, n = marks("\n".join(passage))
        assert n <= most * len(passage)
        for before in (1, 2, 7):
            there, _ = marks("\n".join([*[line(5) for _ in range(before)], *passage, line(4)]))
            assert all(there[a + before, b + before] == h for (a, b), h in here.items())


def test_a_run_that_most_documents_share(docs):
    run = "one two three four five six\nseven eight nine ten eleven"
    rows = [(k, f"own {k} text\n{run}\nend {k}") for k in range(400)]
    got = {r.doc_id: r.text for r in deduplicate(docs(rows)).collect()}
    assert got == {k: rows[0][1] if k == 0 else f"own {k} text\nend {k}" for k in range(400)}
