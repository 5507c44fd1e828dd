"""A corpus pipeline of five operators: language, repeated lines, near-duplicates, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. Documents without text pass the language stage as ``und`` and are rejected there; repeated rows end in one
row at the near-duplicate stage; an empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folderloom.llm import decontamination, language_id, line_dedup, mixing, near_dedup
from folderloom.llm.text import pack, unpack
from folderloom.plans.registry import QUERIES, load
from folderloom.plans.staging import Stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that are labelled; those without a letter or far from all of them go."""
    packed = language_id.predict(pack(docs, "text"), language_id.fit(docs), ["_row", "_text"], "_text")
    return unpack(packed.where((F.col("lang_pred") != "und") & F.col("close")), docs, "text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; documents of which nothing is left go."""
    kept = line_dedup.deduplicate(docs).where(F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more; one row of each doc_id."""
    found = near_dedup.near_duplicates(docs)
    kept = docs.join(found.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of the benchmark."""
    return decontamination.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
]

#: Kernel scores, windows of lines and subset sums are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; what each keeps is written and read again."""
    stage, docs = Stage(spark), load(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage.keep(docs, f"stage-{k}")
    return docs


QUERIES["pipeline"] = run
