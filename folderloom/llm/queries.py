"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folderloom.llm import (
    centroids,
    decontamination,
    filter_audit,
    language_id,
    licenses,
    line_dedup,
    lm_scoring,
    mixing,
    near_dedup,
    neighbours,
    quality,
    token_counts,
    token_files,
)
from folderloom.plans.registry import load, query
from folderloom.plans.staging import Stage

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query(f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{SMALL}'), '{_ALNUM}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{SMALL}'), '{_ALNUM}') AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
             FROM iw WHERE len(w) > 0)),
dg AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
             FROM dw, (SELECT DISTINCT size FROM ig) WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, dg.size, item_id FROM dg JOIN ig ON dg.size = ig.size AND dg.g = ig.g),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit
       FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
       FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh ON nh.doc_id = dw.doc_id LEFT JOIN ni ON ni.doc_id = dw.doc_id
""")
def op2_benchmark_decontamination(spark, sf_dir):
    return decontamination.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query()
def op5_mixing_sources(spark, sf_dir):
    return mixing.mix(load(spark, sf_dir, "documents"))


@query()
def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n == 2


@query()
def op1_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("held_out", _remainder(4))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


@query()
def op3_lm_scoring(spark, sf_dir):
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").withColumn("held_out", _remainder(7))
    return lm_scoring.scores(docs, ~F.col("held_out"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "held_out"])


@query()
def op4_quality_classifier(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("held_out", _remainder(4))
    known = docs.where(~F.col("held_out"))
    model = quality.fit(known, load(spark, sf_dir, "labels").where(~_remainder(4)))
    scored = quality.score(docs, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query()
def op9_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"), n=2)


@query()
def op6_line_dedup(spark, sf_dir):
    found = line_dedup.deduplicate(load(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


#: The canonical form as the SQL states it, apart from that of the operator; both agree where no line begins with copyright.
_SQL_STEPS = [
    (r"(^|\n)[^a-z\n]*(copyright|\(c\)|©)[^\n]*", r" "),
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-infringement", "noninfringement"),
    (r"&", " and "),
    (r"https:", "http:"),
    (r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "),
]
_SQL_KNOWN = ("MIT", "MIT-titled", "ISC", "0BSD", "notice-Apache-2.0", "notice-MIT", "notice-GPL-3.0", "notice-CC-BY-NC-4.0",
              "notice-reserved", "notice-SPDX-MIT", "notice-SPDX-Apache-2.0")


def _canonical_sql(x: str) -> str:
    out = f"translate({x}, '{UPPER}', '{SMALL}')"
    for pattern, by in _SQL_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out}, ' ')"


@query(f"""
WITH known(id, raw) AS (VALUES {", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in licenses.KNOWN.items() if k in _SQL_KNOWN)}),
digests AS (SELECT id, sha256({_canonical_sql("raw")}) AS d FROM known),
whole AS (SELECT doc_id, text, sha256({_canonical_sql("coalesce(text, '')")}) AS d FROM documents),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents),
hit AS (SELECT DISTINCT doc_id, id FROM (SELECT doc_id, sha256({_canonical_sql("x")}) AS d FROM line) l JOIN digests ON digests.d = l.d)
SELECT whole.doc_id, whole.d AS digest, (SELECT min(id) FROM digests WHERE digests.d = whole.d) AS license,
       coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM hit WHERE hit.doc_id = whole.doc_id), '') AS notices
FROM whole
""")
def op7_license_scan(spark, sf_dir):
    found = licenses.scan(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


@query()
def op10_nearest_neighbours(spark, sf_dir):
    return neighbours.search(load(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


@query()
def op11_token_id_output(spark, sf_dir):
    import public_tokenizers

    folder = f"{Stage(spark).root}/tokens"
    token_files.write(load(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query(r"""
WITH d AS (SELECT coalesce(doc_id, 9223372036854775807) AS id, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic
      FROM labels GROUP BY doc_id),
w AS (SELECT id, doc_id, text, part, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CAST(len(w) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INTEGER)
             + 4 * CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS INTEGER)
             + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(least < id AS INTEGER) AS m
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
e(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM e p JOIN e q ON q.b <> p.b
      JOIN e r ON r.b NOT IN (p.b, q.b) JOIN e s ON s.b NOT IN (p.b, q.b, r.b) JOIN e t ON t.b NOT IN (p.b, q.b, r.b, s.b)),
g AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
      FROM (SELECT filter_order, bits, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
a AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN m & (bit + before) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN m & bit > 0 AND m & before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN m & bit > 0 AND m & before > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN m & bit > 0 AND m & before = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN m & bit > 0 AND m & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, g GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM a
""")
def op12_filter_interaction_audit(spark, sf_dir):
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", load(spark, sf_dir, "labels"))


def _lloyd_sql(rounds: int) -> str:
    """Assignment and update, round by round; floor division of whole numbers without fractions."""
    out = ""
    for r in range(rounds + 1):
        out += f"""
a{r} AS (SELECT row, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT row, c, CAST(list_sum(list_transform(range(1, 65), lambda j: (q[j] - y[j]) * (q[j] - y[j]))) AS BIGINT) AS d FROM v, c{r}) GROUP BY row),"""
        if r < rounds:
            out += f"""
s{r} AS (SELECT best.c AS c, j, CAST(sum(q[j]) AS BIGINT) AS s, count(*) AS n
      FROM a{r} JOIN v USING (row), (SELECT unnest(range(1, 65)) AS j) GROUP BY best.c, j),
c{r + 1} AS (SELECT c{r}.c, coalesce(z, y) AS y FROM c{r} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS z FROM s{r} GROUP BY c) m ON m.c = c{r}.c),"""
    return out


@query(f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q AS y FROM v WHERE vec_id IS NOT NULL
       ORDER BY sha256('1:' || vec_id), q LIMIT 16),{_lloyd_sql(3)}
last AS (SELECT row, best.c AS c, best.d AS d FROM a3)
SELECT vec_id, CAST(last.c AS INTEGER) AS cluster, d AS distance, (sum(d) OVER (PARTITION BY last.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM last JOIN v USING (row) JOIN c3 ON c3.c = last.c
""")
def op13_centroid_clustering(spark, sf_dir):
    found, table = centroids.cluster(load(spark, sf_dir, "embeddings"))
    joined = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    named = table.select("cluster", "cluster_inertia", "inertia", joined.alias("centroid_sha256"))  # at most 16 rows
    return found.join(F.broadcast(named), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
