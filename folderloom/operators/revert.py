"""Reverts and backup retention, as plans over the ledgers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folderloom.functions.values import is_sha256
from folderloom.operators.joins import broadcast_if_small
from folderloom.operators.ledger import matching

VERSION = ("table_name", "source_file", "file_sha256")


def select_imports(ledger: DataFrame, table: str | None = None, source_file: str | None = None,
                   file_sha256: str | None = None) -> DataFrame:
    """Ledger rows to revert; a hash selects just that version of a file."""
    if source_file is None and file_sha256 is None:
        raise ValueError("a source file or a hash is needed")
    return matching(ledger, table_name=table, source_file=source_file, file_sha256=file_sha256)


def selector(value: str) -> dict[str, str]:
    """64 hex characters select by hash, anything else by file name."""
    return {"file_sha256": value} if re.fullmatch("[0-9a-fA-F]{64}", value) else {"source_file": value}


def revert_mode(value: Column | str) -> Column:
    return F.when(is_sha256(value), "hash").otherwise("file")


def remaining(data: DataFrame, reverted: DataFrame, key=VERSION) -> DataFrame:
    """Data rows whose import is not reverted."""
    return data.join(broadcast_if_small(reverted.select(*key).distinct()), list(key), "left_anti")


def affected(data: DataFrame, reverted: DataFrame, key=VERSION) -> DataFrame:
    """Data rows of the reverted imports."""
    return data.join(broadcast_if_small(reverted.select(*key).distinct()), list(key), "left_semi")


def revert_plan(imports: DataFrame, data: DataFrame, backups_root: str = "backups", key=VERSION) -> DataFrame:
    """Per import: rows on record, rows found, and the backup that would be taken. Changes nothing."""
    found = affected(data, imports, key).groupBy(*key).agg(F.count(F.lit(1)).alias("found_rows"))
    backup = F.concat(F.lit(backups_root + "/"), F.col("table_name"), F.lit("/"), F.col("table_name"), F.lit("_"),
                      F.col("source_file"), F.lit("_"), F.substring("file_sha256", 1, 8), F.lit(".csv"))
    return imports.join(found, list(key), "left").select(
        F.col("id").alias("import_id"), *key,
        F.col("row_count").alias("expected_rows"),
        F.coalesce("found_rows", F.lit(0)).alias("found_rows"),
        backup.alias("planned_backup"),
    )


def schema_revert_plan(changes: DataFrame, table: str | None = None, source_file: str | None = None,
                       drop_created: bool = False) -> DataFrame:
    """Inverse actions of schema changes, to be applied newest first (``step`` descending).

    ``drop_created`` drops a table that the file created; otherwise that step stays manual.
    """
    chosen = changes if table is None and source_file is None else matching(
        changes, table_name=table, source_file=source_file)
    kind = F.col("change_type")
    undoable = (kind == "alter_type") & F.col("old_type").isNotNull()
    action = (
        F.when(kind == "add_column", "drop_column")
        .when(undoable, "restore_type")
        .when((kind == "create_table") & F.lit(drop_created), "drop_table")
        .when(kind.isin("create_table", "alter_type"), "manual")
        .otherwise("unknown")
    )
    manual = F.when((kind == "create_table") & ~F.lit(drop_created), F.concat(F.lit("drop table "), "table_name")).when(
        (kind == "alter_type") & F.col("old_type").isNull(),
        F.concat(F.lit("original type unknown: "), "table_name", F.lit("."), "column_name"),
    )
    return chosen.select(
        F.col("id").alias("step"), "table_name", "source_file", "change_type", action.alias("action"), "column_name",
        F.when(undoable, F.col("old_type")).alias("restored_type"), manual.alias("manual_step"),
    )


def schema_after_revert(columns: DataFrame, plan: DataFrame) -> DataFrame:
    """Registry columns after the plan: dropped columns gone, each type as before the oldest undone change."""
    key = ["table_name", "column_name"]
    effect = plan.filter(F.col("action").isin("drop_column", "restore_type")).groupBy(*key).agg(
        F.bool_or(F.col("action") == "drop_column").alias("_dropped"),
        F.min_by("restored_type", F.when(F.col("action") == "restore_type", F.col("step"))).alias("_type"),
    )
    joined = columns.join(effect, key, "left").filter(~F.coalesce("_dropped", F.lit(False)))
    return joined.withColumn("sql_type", F.coalesce("_type", "sql_type")).select(*columns.columns)


def write_report(report: DataFrame, path: str) -> None:
    """A revert report or plan as JSON lines."""
    report.write.mode("overwrite").json(path)


def newest_per_group(df: DataFrame, group: str, order: str, tie: str, n: int, salts: int = 32) -> DataFrame:
    """The ``n`` newest rows of each group. Groups are first thinned in ``salts`` parts, so that no
    task sorts a whole large group."""
    salt = F.pmod(F.xxhash64(tie), F.lit(salts))
    newest = [F.desc(order), F.desc(tie)]
    thin = df.withColumn("_salt", salt)
    part = F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*newest))
    few = thin.withColumn("_n", part).filter(F.col("_n") <= n).drop("_n", "_salt")
    whole = F.row_number().over(Window.partitionBy(group).orderBy(*newest))
    return few.withColumn("_n", whole).filter(F.col("_n") <= n).drop("_n")


def expired_backups(manifest: DataFrame, now, retention_days: int | None = None, max_files: int | None = None,
                    key: str = "backup_path") -> DataFrame:
    """Backups that are past their age or beyond the newest ``max_files`` of what is left per table."""
    cutoff = None if retention_days is None else F.lit(now) - F.make_dt_interval(F.lit(retention_days))
    kept = manifest if cutoff is None else manifest.filter(F.col("created_at") >= cutoff)
    if max_files is not None:
        kept = newest_per_group(kept, "table_name", "created_at", key, max_files)
    return manifest.join(kept.select("table_name", key), ["table_name", key], "left_anti")
