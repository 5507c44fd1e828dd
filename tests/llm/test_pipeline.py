from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from llm.test_decontamination import brute as leaks
from llm.test_language_id import texts as languages
from llm.test_line_dedup import brute as cut
from llm.test_mixing import brute_targets
from llm.test_near_dedup import brute as near

import corpus_pipeline


def write(folder, rows, items):
    table = {"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows],
             "source": [f"s{(r[0] or 0) % 4}" for r in rows], "n_chars": [len(r[1] or "") for r in rows]}
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.table(table, schema=kinds), folder / "documents.parquet")
    bench = pa.table({"item_id": pa.array([k for k, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())})
    pq.write_table(bench, folder / "benchmark.parquet")


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = languages(90, 4)
    long = {k: (k, " ".join(t for _, t, _ in languages(30, 100 + k)[rng.randrange(3)::3]), lang) for k, _, lang in rows}
    rows = [long[k] for k, _, _ in rows]
    passage = "\n".join(t for _, t, _ in languages(8, 77))
    items = [(1, " ".join(rows[4][1].split()[10:24])), (2, rows[7][1]), (3, None), (4, "")]
    rows += [(200, None, "aa"), (201, "", None), (202, "12 %", "bb"), (203, rows[0][1].replace(" ", "  "), "aa"),
             (204, rows[1][1] + " lo", "bb"), (204, rows[1][1] + " lo", "bb"), (205, rows[8][1] + "\n" + passage, "cc"),
             (206, passage + "\n" + rows[11][1], "cc"), (207, passage, "aa")]
    write(tmp_path, rows, items)
    kept = [(d, t) for d, t, _ in rows if any(map(str.isalpha, t or ""))]
    kept = [(d, t) for d, t in cut(kept) if t.strip()]
    groups = {r[0] for r in near(kept, 5) if r[3]}
    kept = list(dict.fromkeys((d, t) for d, t in kept if d in groups))
    kept = [k for k, b in ((k, leaks([k], items)[0]) for k in kept) if not b[5]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((d, len(t.split())) for d, t in kept)
    assert 60 < len(kept) < 95
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[f"s{r.doc_id % 4}"] += r["size"]
        taken[f"s{r.doc_id % 4}"] += r.taken
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) <= max(r["size"] for r in got)


def test_stages_keep_columns_and_pass_empty_tables(spark, tmp_path):
    write(tmp_path, [], [])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes and out.collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


FAR = ["Привет, как твои дела сегодня вечером", "안녕하세요 오늘 날씨가 아주 좋네요", "Καλημέρα σας τι κάνετε σήμερα", "xqzj wvkx zzyq"]


def test_language_stage_rejects_other_scripts_and_languages_and_keeps_one_clean_word(spark, docs, tmp_path):
    rows = [(k, t, lang) for k, t, lang in languages(900, 5)]
    word = next(w for w in rows[3][1].split() if len(w) > 3)
    extra = [(5000 + k, t, None) for k, t in enumerate(FAR)] + [(6000, word, None), (6001, "", None), (6002, None, None)]
    got = corpus_pipeline.language(spark, docs([(d, t, lang, "s") for d, t, lang in rows + extra]), str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == [*range(900), 6000]
