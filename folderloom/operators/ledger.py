"""Import and schema-change ledgers: dedupe, appends, histories, rollups and metrics.

A ledger is a DataFrame. ``etl_imports`` has (id, table_name, source_file, file_sha256, row_count,
imported_at, folder_path); ``etl_schema_changes`` has (id, table_name, change_type, column_name,
old_type, new_type, source_file, changed_at, details).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folderloom.functions.names import base_name

IMPORT_KEY = ("table_name", "source_file", "file_sha256")
CONTENT_KEY = ("table_name", "file_sha256")


def not_imported(files: DataFrame, ledger: DataFrame, key=IMPORT_KEY) -> DataFrame:
    """Candidate files whose key is not in the ledger."""
    return files.join(ledger.select(*key).distinct(), list(key), "left_anti")


def remaining_folders(files: DataFrame, ledger: DataFrame, key=IMPORT_KEY) -> DataFrame:
    """Folders that still hold files to import, as after an interrupted run."""
    return not_imported(files, ledger, key).select("folder").distinct()


def first_copies(files: DataFrame, key=CONTENT_KEY, order: str = "source_file") -> DataFrame:
    """One file per key, the first in order.

    The first of each group is found by a map-side aggregate, so a content that a third of all
    files share costs one row per task; the files are then kept by a semi join.
    """
    first = files.groupBy(*key).agg(F.min(order).alias(order))
    return files.join(first, [*key, order], "left_semi")


def by_base_name(files: DataFrame, wanted: list[str], path: str = "source_file") -> DataFrame:
    """Whitelist by file name, without the folder."""
    return files.filter(base_name(path).isin(*wanted))


def import_rows(rows: DataFrame, keep_empty: DataFrame | None = None, key=IMPORT_KEY) -> DataFrame:
    """(*key, row_count) of data rows; ``keep_empty`` lists files to log even without rows."""
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count"))
    if keep_empty is None:
        return counts
    joined = keep_empty.select(*key).distinct().join(counts, list(key), "left")
    return joined.withColumn("row_count", F.coalesce("row_count", F.lit(0)))


def matching(df: DataFrame, **conditions: str | None) -> DataFrame:
    """Rows equal on all given columns; no condition selects nothing."""
    given = [F.col(name) == value for name, value in conditions.items() if value is not None]
    return df.filter(reduce(Column.__and__, given) if given else F.lit(False))


def status_rollup(ledger: DataFrame, limit: int | None = 10) -> DataFrame:
    """Files and rows per table, the latest import first."""
    out = ledger.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("row_count").alias("total_rows"),
        F.max("imported_at").alias("last_import"),
    ).orderBy(F.desc("last_import"), "table_name")
    return out if limit is None else out.limit(limit)


def grand_total(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count(F.lit(1)).alias("imports"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows")
    )


def distinct_tables(ledger: DataFrame) -> DataFrame:
    """Imported tables; the ledgers' own names (``etl_`` and one more character) are left out."""
    return ledger.select("table_name").distinct().filter(~F.col("table_name").like("etl_%"))


def import_history(ledger: DataFrame, table: str, limit: int = 20) -> DataFrame:
    return (
        ledger.filter(F.col("table_name") == table)
        .orderBy(F.desc("imported_at"), F.desc("id"))
        .limit(limit)
        .select("id", "source_file", "file_sha256", "row_count", "imported_at")
    )


def list_imports(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy(F.desc("imported_at"), F.desc("id"))


def change_history(changes: DataFrame, table: str, limit: int = 20) -> DataFrame:
    return (
        changes.filter(F.col("table_name") == table)
        .orderBy(F.desc("changed_at"), F.desc("id"))
        .limit(limit)
        .select("id", "change_type", "column_name", "old_type", "new_type", "source_file", "changed_at")
    )


def list_changes(changes: DataFrame, limit: int = 50) -> DataFrame:
    """Newest changes with a readable ``old -> new``."""
    arrow = F.concat_ws(" -> ", F.coalesce("old_type", F.lit("-")), F.coalesce("new_type", F.lit("-")))
    return changes.orderBy(F.desc("changed_at"), F.desc("id")).limit(limit).select(
        "id", "table_name", "change_type", F.coalesce("column_name", F.lit("-")).alias("column_name"),
        arrow.alias("type_change"), "changed_at",
    )


def changes_by_source(changes: DataFrame, table: str, source_file: str) -> DataFrame:
    return matching(changes, table_name=table, source_file=source_file).orderBy("id")


def row_counts(data: DataFrame, by: str = "table_name") -> DataFrame:
    return data.groupBy(by).agg(F.count(F.lit(1)).alias("row_count"))


def run_metrics(status: DataFrame) -> DataFrame:
    """One row over per-file (status, row_count, schema_changes, seconds)."""
    return status.agg(
        F.count_if(F.col("status") == "success").alias("files_processed"),
        F.count_if(F.col("status") == "skipped").alias("files_skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_imported"),
        F.coalesce(F.sum("schema_changes"), F.lit(0)).alias("schema_changes"),
        F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 2).alias("total_seconds"),
        F.round(F.coalesce(F.avg("seconds"), F.lit(0.0)), 2).alias("avg_seconds_per_file"),
    )


def outcome_counts(status: DataFrame) -> DataFrame:
    """Files per (status, reason)."""
    return status.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("files"))


def outcome_summary(status: DataFrame) -> DataFrame:
    """Counts of the three outcomes and the rounded success percentage, 0 for an empty run."""
    n = F.count(F.lit(1))
    ok = F.count_if(F.col("status") == "success")
    return status.agg(
        ok.alias("success"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.coalesce(F.floor(ok * 100 / F.nullif(n, F.lit(0)) + 0.5), F.lit(0)).cast("bigint").alias("success_rate"),
    )


def report_rollup(actions: DataFrame) -> DataFrame:
    """Totals of a revert report over (deleted_rows, executed, manual_step)."""
    return actions.agg(
        F.coalesce(F.sum("deleted_rows"), F.lit(0)).alias("total_deleted_rows"),
        F.coalesce(F.bool_or(F.col("manual_step").isNotNull()), F.lit(False)).alias("manual_steps_required"),
        F.count_if("executed").alias("executed_count"),
    )


def table_stats(registry: DataFrame, counts: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_name, table_exists, columns, row_count) for asked tables, absent ones included."""
    columns = registry.groupBy("table_name").agg(F.count(F.lit(1)).alias("columns"))
    return tables.join(columns, "table_name", "left").join(counts, "table_name", "left").select(
        "table_name",
        F.col("columns").isNotNull().alias("table_exists"),
        F.coalesce("columns", F.lit(0)).alias("columns"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
    )
