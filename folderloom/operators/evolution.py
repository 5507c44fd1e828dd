"""Schema evolution of whole sets of files: change timelines, final schemas, new columns.

Files are ordered by ``file_key`` (their path). A running type changes only where a type is seen
for the first time, so each (table, column) is first reduced to one row per type. The windows
below then see at most one row per type, however many files a table has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folderloom.functions.sqltypes import (
    CHAIN,
    COMPATIBLE,
    RANKED_ALIASES,
    RANKS,
    SAFE,
    is_numeric_type,
    lub_of_set,
    resolve_column,
)

KEYS = ("table_name", "column_name")
MONOTONE = ("lub", "ranked")
_MAX_STEPS = {"chain": max(map(len, CHAIN.values())), "pairs": len(COMPATIBLE) + 1, "safe": len(SAFE)}


def first_seen(batch_types: DataFrame) -> DataFrame:
    """(table, column, sql_type, file_key): the first file of each type, pre-aggregated map-side."""
    return batch_types.groupBy(*KEYS, "sql_type").agg(F.min("file_key").alias("file_key"))


def with_existing(batch_types: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Put the registered columns before all files, under an empty file key."""
    cols = [*KEYS, "sql_type", "file_key"]
    if existing is None:
        return batch_types.select(*cols)
    before = existing.select(*KEYS, "sql_type", F.lit("").alias("file_key"))
    return before.unionByName(batch_types.select(*cols))


def _running_rank(types: Column) -> Column:
    """Highest rank so far; of equal ranks the earliest stays."""
    alias = F.create_map(*[F.lit(x) for p in RANKED_ALIASES.items() for x in p])
    rank = F.create_map(*[F.lit(x) for p in RANKS.items() for x in p])
    named = F.transform(types, lambda t: F.coalesce(F.try_element_at(alias, t), t))
    ranked = F.transform(named, lambda t, i: F.struct(
        F.coalesce(F.try_element_at(rank, t), F.lit(0)).alias("rank"), (-i).alias("age"), t.alias("type")))
    return F.array_max(ranked).getField("type")


def column_states(batch_types: DataFrame, policy: str = "lub", existing: DataFrame | None = None) -> DataFrame:
    """(table, column, file_key, old_type, new_type): every type a column takes, in file order."""
    rows = with_existing(batch_types, existing)
    if policy in MONOTONE:
        running = {"lub": lub_of_set, "ranked": _running_rank}[policy]
        w = Window.partitionBy(*KEYS).orderBy("file_key", "sql_type")
        seen = first_seen(rows).withColumn(
            "new_type", running(F.collect_list("sql_type").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        )
        moved = seen.withColumn("old_type", F.lag("new_type").over(w))
        return moved.filter(F.col("old_type").isNull() | (F.col("old_type") != F.col("new_type"))).select(
            *KEYS, "file_key", "old_type", "new_type"
        )
    return _ordered_states(rows, policy)


def _ordered_states(rows: DataFrame, policy: str) -> DataFrame:
    """Policies where the order of files matters, followed transition by transition.

    A column can widen only as often as its chain is long, so a fixed number of aggregates finds
    every transition: each takes the first file after the last change that changes the type again.
    """
    start = rows.groupBy(*KEYS).agg(F.min(F.struct("file_key", "sql_type")).alias("at")).select(
        *KEYS, F.col("at.file_key").alias("file_key"), F.lit(None).cast("string").alias("old_type"),
        F.col("at.sql_type").alias("new_type"),
    )
    steps = [start]
    for _ in range(_MAX_STEPS[policy]):
        last = steps[-1].select(*KEYS, F.col("file_key").alias("_from"), F.col("new_type").alias("_state"))
        resolved = resolve_column("_state", "sql_type", policy)
        later = rows.join(last, list(KEYS)).filter((F.col("file_key") > F.col("_from")) & (resolved != F.col("_state")))
        step = later.groupBy(*KEYS).agg(
            F.min(F.struct(F.col("file_key"), F.col("_state").alias("old_type"), resolved.alias("new_type"))).alias("at")
        )
        steps.append(step.select(*KEYS, "at.file_key", "at.old_type", "at.new_type"))
    return reduce(DataFrame.unionByName, steps)


def relogged_text(batch_types: DataFrame, states: DataFrame) -> DataFrame:
    """Files that meet a TEXT column with another type; the chain policy logs each as TEXT to TEXT."""
    text_at = states.filter(F.col("new_type") == "TEXT").select(*KEYS, F.col("file_key").alias("_from"))
    met = batch_types.join(text_at, list(KEYS)).filter(
        (F.col("file_key") > F.col("_from")) & (F.col("sql_type") != "TEXT")
    )
    return met.select(*KEYS, "file_key", F.lit("TEXT").alias("old_type"), F.lit("TEXT").alias("new_type"))


def change_log(batch_types: DataFrame, policy: str = "lub", existing: DataFrame | None = None,
               relog: bool = False) -> DataFrame:
    """(table, change_type, column, old_type, new_type, source_file) of all files at once.

    The first file of a new table logs ``create_table``; its columns are part of the table. A column
    seen first in a later file logs ``add_column``, a changed type logs ``alter_type``.
    """
    states = column_states(batch_types, policy, existing)
    # A table's first file always sets a state, so the birth needs only the few state rows.
    known = states.withColumn("_born", F.min("file_key").over(Window.partitionBy("table_name")))
    if relog:
        known = known.unionByName(relogged_text(batch_types, states).withColumn("_born", F.lit("")))
    change = F.when(F.col("old_type").isNotNull(), "alter_type").when(F.col("file_key") > F.col("_born"), "add_column")
    changes = known.select(
        "table_name", change.alias("change_type"), "column_name", "old_type", "new_type",
        F.col("file_key").alias("source_file"),
    ).filter(F.col("change_type").isNotNull())
    none = F.lit(None).cast("string")
    created = states.groupBy("table_name").agg(F.min("file_key").alias("_born")).filter(F.col("_born") != "").select(
        "table_name", F.lit("create_table").alias("change_type"), none.alias("column_name"),
        none.alias("old_type"), none.alias("new_type"), F.col("_born").alias("source_file"),
    )
    return created.unionByName(changes)


def final_types(batch_types: DataFrame, policy: str = "lub", existing: DataFrame | None = None) -> DataFrame:
    """(table, column, sql_type) after all files. The default policy needs no order at all."""
    rows = with_existing(batch_types, existing)
    if policy == "lub":
        return rows.groupBy(*KEYS).agg(lub_of_set(F.collect_set("sql_type")).alias("sql_type"))
    last = column_states(batch_types, policy, existing).groupBy(*KEYS).agg(
        F.max(F.struct("file_key", "new_type")).alias("at")
    )
    return last.select(*KEYS, F.col("at.new_type").alias("sql_type"))


def new_columns(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming (table, column) pairs that the registry does not have."""
    return incoming.select(*KEYS).distinct().join(existing.select(*KEYS), list(KEYS), "left_anti")


def force_text(registered: DataFrame, rejects: DataFrame) -> DataFrame:
    """Numeric columns that meet non-numeric values become TEXT; ``rejects`` is (*KEYS, non_numeric)."""
    bad = rejects.filter(F.col("non_numeric") > 0).select(*KEYS).withColumn("_bad", F.lit(True))
    turned = F.col("_bad") & is_numeric_type("sql_type")
    return registered.join(bad, list(KEYS), "left").select(
        *KEYS, F.col("sql_type").alias("old_type"),
        F.when(F.coalesce(turned, F.lit(False)), "TEXT").otherwise(F.col("sql_type")).alias("new_type"),
    )
