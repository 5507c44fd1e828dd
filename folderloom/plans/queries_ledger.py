"""Queries on the import ledger, change ledger, reverts and backups.

Documents stand for files: ``source`` is the folder and table, the text is the content.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folderloom.functions import values
from folderloom.operators import ledger, revert
from folderloom.plans.registry import load, query

_START = "TIMESTAMP '2024-01-01 00:00:00'"


def _stamp(minutes: Column) -> Column:
    return F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))


def imports(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("table_name"),
        F.concat("lang", F.lit("/file_"), F.col("doc_id") % 50, F.lit(".xlsx")).alias("source_file"),
        values.content_hash("text").alias("file_sha256"), F.col("n_chars").alias("row_count"),
        _stamp(F.floor(F.col("doc_id") / 3)).alias("imported_at"), F.col("lang").alias("folder_path"),
    )


_IMPORTS = f"""(SELECT doc_id AS id, source AS table_name, lang || '/file_' || (doc_id % 50) || '.xlsx' AS source_file,
    sha256(text) AS file_sha256, n_chars AS row_count, {_START} + to_minutes(CAST(doc_id // 3 AS INT)) AS imported_at,
    lang AS folder_path FROM documents)"""


def changes(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("o_orderkey") % 5
    none = F.lit(None).cast("string")
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("t_"), F.lower("o_orderstatus")).alias("table_name"),
        F.when(kind == 0, "create_table").when(kind < 3, "add_column").otherwise("alter_type").alias("change_type"),
        F.when(kind > 0, F.concat(F.lit("c"), F.col("o_custkey") % 40)).otherwise(none).alias("column_name"),
        F.when((kind == 3), "INTEGER").otherwise(none).alias("old_type"),
        F.when(kind > 0, F.when(kind < 3, "INTEGER").otherwise("TEXT")).otherwise(none).alias("new_type"),
        F.concat(F.lit("f"), F.col("o_custkey") % 30, F.lit(".xlsx")).alias("source_file"),
        F.col("o_orderdate").alias("changed_at"),
    )


_CHANGES = """(SELECT o_orderkey AS id, 't_' || lower(o_orderstatus) AS table_name,
    CASE WHEN o_orderkey % 5 = 0 THEN 'create_table' WHEN o_orderkey % 5 < 3 THEN 'add_column' ELSE 'alter_type' END AS change_type,
    CASE WHEN o_orderkey % 5 > 0 THEN 'c' || (o_custkey % 40) END AS column_name,
    CASE WHEN o_orderkey % 5 = 3 THEN 'INTEGER' END AS old_type,
    CASE WHEN o_orderkey % 5 > 0 THEN CASE WHEN o_orderkey % 5 < 3 THEN 'INTEGER' ELSE 'TEXT' END END AS new_type,
    'f' || (o_custkey % 30) || '.xlsx' AS source_file, o_orderdate AS changed_at FROM orders)"""


# --- dedupe -------------------------------------------------------------------------------------

@query(f"""SELECT c.id, c.table_name, c.source_file, c.file_sha256 FROM {_IMPORTS} c WHERE NOT EXISTS (SELECT 1 FROM {_IMPORTS} l
    WHERE l.imported_at < TIMESTAMP '2024-01-01 02:00:00' AND l.table_name = c.table_name AND l.source_file = c.source_file
    AND l.file_sha256 = c.file_sha256)""")
def skip_imported(spark, sf):
    """Everything is delivered again after a first run; only unknown (table, file, hash) keys are left."""
    files = imports(spark, sf)
    done = files.filter("imported_at < TIMESTAMP_NTZ '2024-01-01 02:00:00'")
    return ledger.not_imported(files, done).select("id", "table_name", "source_file", "file_sha256")


@query("""SELECT doc_id, sha256(text) AS file_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n
    FROM documents) WHERE n = 1""")
def content_dedupe(spark, sf):
    files = load(spark, sf, "documents").select("doc_id", values.content_hash("text").alias("file_sha256"))
    return ledger.first_copies(files, key=("file_sha256",), order="doc_id")


@query(f"""SELECT table_name, file_sha256, min(id) AS id FROM {_IMPORTS} c WHERE NOT EXISTS (SELECT 1 FROM {_IMPORTS} l
    WHERE l.folder_path = 'fr' AND l.table_name = c.table_name AND l.file_sha256 = c.file_sha256) GROUP BY ALL""")
def renamed_dedupe(spark, sf):
    """A renamed file is known by its content within its table."""
    files = imports(spark, sf)
    fresh = ledger.not_imported(files, files.filter("folder_path = 'fr'"), key=ledger.CONTENT_KEY)
    return ledger.first_copies(fresh, order="id").select("table_name", "file_sha256", "id")


@query(f"""SELECT DISTINCT folder_path AS folder FROM {_IMPORTS} WHERE imported_at >= TIMESTAMP '2024-01-01 02:00:00'
    AND (table_name, source_file, file_sha256) NOT IN (SELECT (table_name, source_file, file_sha256) FROM {_IMPORTS}
      WHERE imported_at < TIMESTAMP '2024-01-01 02:00:00')""")
def remaining_folders(spark, sf):
    files = imports(spark, sf)
    done = files.filter("imported_at < TIMESTAMP_NTZ '2024-01-01 02:00:00'")
    return ledger.remaining_folders(files.withColumnRenamed("folder_path", "folder"), done)


# --- ledgers ------------------------------------------------------------------------------------

@query("""SELECT l_returnflag AS table_name, strftime(l_shipdate, '%Y-%m') || '.csv' AS source_file,
    sha256(strftime(l_shipdate, '%Y-%m')) AS file_sha256, count(*) AS row_count FROM lineitem GROUP BY ALL""")
def import_ledger(spark, sf):
    month = F.date_format("l_shipdate", "yyyy-MM")
    rows = load(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("table_name"), F.concat(month, F.lit(".csv")).alias("source_file"),
        values.content_hash(month.cast("binary")).alias("file_sha256"))
    return ledger.import_rows(rows)


@query(f"""SELECT table_name, count(*) AS files, sum(row_count)::BIGINT AS total_rows, max(imported_at) AS last_import FROM {_IMPORTS}
    GROUP BY table_name ORDER BY last_import DESC, table_name LIMIT 10""")
def status_rollup(spark, sf):
    return ledger.status_rollup(imports(spark, sf))


@query(f"SELECT count(*) AS imports, coalesce(sum(row_count), 0)::BIGINT AS total_rows FROM {_IMPORTS}")
def grand_total(spark, sf):
    return ledger.grand_total(imports(spark, sf))


@query(f"SELECT DISTINCT table_name FROM {_IMPORTS} WHERE table_name NOT LIKE 'etl_%'")
def distinct_tables(spark, sf):
    return ledger.distinct_tables(imports(spark, sf))


@query("SELECT l_returnflag AS table_name, count(*) AS row_count FROM lineitem GROUP BY 1")
def table_row_counts(spark, sf):
    return ledger.row_counts(load(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "table_name"))


@query(f"""SELECT id, source_file, file_sha256, row_count, imported_at FROM {_IMPORTS} WHERE table_name = 'src7'
    ORDER BY imported_at DESC, id DESC LIMIT 20""")
def import_history(spark, sf):
    return ledger.import_history(imports(spark, sf), "src7")


@query(f"SELECT * FROM {_IMPORTS} ORDER BY imported_at DESC, id DESC")
def list_imports(spark, sf):
    return ledger.list_imports(imports(spark, sf))


@query(f"""SELECT id, change_type, column_name, old_type, new_type, source_file, changed_at FROM {_CHANGES} WHERE table_name = 't_f'
    ORDER BY changed_at DESC, id DESC LIMIT 20""")
def change_history(spark, sf):
    return ledger.change_history(changes(spark, sf), "t_f")


@query(f"""SELECT id, table_name, change_type, coalesce(column_name, '-') AS column_name,
    coalesce(old_type, '-') || ' -> ' || coalesce(new_type, '-') AS type_change, changed_at FROM {_CHANGES}
    ORDER BY changed_at DESC, id DESC LIMIT 50""")
def list_changes(spark, sf):
    return ledger.list_changes(changes(spark, sf))


@query(f"SELECT * FROM {_CHANGES} WHERE table_name = 't_o' AND source_file = 'f7.xlsx' ORDER BY id")
def changes_by_source(spark, sf):
    return ledger.changes_by_source(changes(spark, sf), "t_o", "f7.xlsx")


@query(f"""SELECT * FROM {_IMPORTS} WHERE (table_name, source_file) = (SELECT (table_name, source_file) FROM {_IMPORTS} ORDER BY id LIMIT 1)""")
def ledger_predicates(spark, sf):
    """All imports of the file that was imported first, whatever its content."""
    log = imports(spark, sf)
    first = log.agg(F.min_by(F.struct("table_name", "source_file"), "id")).head()[0]
    return ledger.matching(log, table_name=first.table_name, source_file=first.source_file, file_sha256=None)


# --- outcomes -----------------------------------------------------------------------------------

def _outcomes(spark, sf):
    kind = F.col("event_type")
    return load(spark, sf, "events").select(
        F.col("event_id").alias("file"),
        F.when(kind == "error", "error").when(kind == "signup", "skipped").otherwise("success").alias("status"),
        F.when(kind == "error", "unreadable").when(kind == "signup", F.when(
            F.col("user_id") % 2 == 0, "Sheet not found").otherwise("Empty data")).alias("reason"),
        F.when(kind.isin("error", "signup"), 0).otherwise(F.col("user_id")).alias("row_count"),
        F.when(F.col("event_id") % 100 == 0, 1).otherwise(0).alias("schema_changes"),
        (F.floor(F.col("value")) / 4).alias("seconds"),
    )


_OUTCOMES = """(SELECT event_id AS file, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' ELSE 'success' END AS status,
    CASE event_type WHEN 'error' THEN 'unreadable' WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'Sheet not found' ELSE 'Empty data' END END AS reason,
    CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE user_id END AS row_count,
    CASE WHEN event_id % 100 = 0 THEN 1 ELSE 0 END AS schema_changes, floor(value) / 4 AS seconds FROM events)"""


@query(f"""SELECT count(*) FILTER (status = 'success') AS files_processed, count(*) FILTER (status = 'skipped') AS files_skipped,
    count(*) FILTER (status = 'error') AS errors, sum(row_count)::BIGINT AS rows_imported, sum(schema_changes)::BIGINT AS schema_changes,
    round(sum(seconds), 2) AS total_seconds, round(avg(seconds), 2) AS avg_seconds_per_file FROM {_OUTCOMES}""")
def run_metrics(spark, sf):
    return ledger.run_metrics(_outcomes(spark, sf))


@query(f"SELECT status, reason, count(*) AS files FROM {_OUTCOMES} GROUP BY ALL")
def outcome_counts(spark, sf):
    return ledger.outcome_counts(_outcomes(spark, sf))


@query(f"""SELECT count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS errors,
    count(*) FILTER (status = 'skipped') AS skipped,
    CAST(floor(count(*) FILTER (status = 'success') * 100.0 / count(*) + 0.5) AS BIGINT) AS success_rate FROM {_OUTCOMES}""")
def outcome_summary(spark, sf):
    return ledger.outcome_summary(_outcomes(spark, sf))


@query("""SELECT t AS table_name, c > 0 AS table_exists, c AS columns, n AS row_count FROM (
      SELECT 'A' AS t, 11 AS c, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') AS n
      UNION ALL SELECT 'N', 11, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'N') UNION ALL SELECT 'missing', 0, 0)""")
def table_stats(spark, sf):
    rows = load(spark, sf, "lineitem")
    registry = spark.createDataFrame([(t, c) for t in "AN" for c in rows.columns], "table_name string, column_name string")
    asked = spark.createDataFrame([("A",), ("N",), ("missing",)], "table_name string")
    return ledger.table_stats(registry, ledger.row_counts(rows.withColumnRenamed("l_returnflag", "table_name")), asked)


# --- reverts ------------------------------------------------------------------------------------

def _data(spark, sf):
    """Data rows: each turn of a conversation belongs to the import of the document of that number."""
    talk = load(spark, sf, "conversations")
    return talk.join(imports(spark, sf), F.col("id") == F.col("conv_id")).select(
        "table_name", "source_file", "file_sha256", "conv_id", "turn")


_DATA = f"""(SELECT table_name, source_file, file_sha256, conv_id, turn FROM conversations JOIN {_IMPORTS} i ON i.id = conv_id)"""


@query(f"""SELECT conv_id, turn, table_name, source_file FROM {_DATA} d WHERE source_file <> 'en/file_7.xlsx'""")
def revert_by_source(spark, sf):
    undone = revert.select_imports(imports(spark, sf), source_file="en/file_7.xlsx")
    return revert.remaining(_data(spark, sf), undone).select("conv_id", "turn", "table_name", "source_file")


@query(f"""SELECT conv_id, turn, table_name, source_file FROM {_DATA} d WHERE file_sha256 <> (SELECT sha256(text) FROM documents WHERE doc_id = 7)
    OR table_name <> (SELECT source FROM documents WHERE doc_id = 7)""")
def revert_by_hash(spark, sf):
    """Only that version of the file goes; other versions under the same path stay."""
    all_imports = imports(spark, sf)
    seventh = all_imports.filter("id = 7").select("table_name", "file_sha256")
    undone = all_imports.join(seventh, ["table_name", "file_sha256"], "left_semi")
    return revert.remaining(_data(spark, sf), undone).select("conv_id", "turn", "table_name", "source_file")


@query(f"""SELECT i.id AS import_id, i.table_name, i.source_file, i.file_sha256, i.row_count AS expected_rows,
    (SELECT count(*) FROM {_DATA} d WHERE d.table_name = i.table_name AND d.source_file = i.source_file AND d.file_sha256 = i.file_sha256) AS found_rows,
    'backups/' || i.table_name || '/' || i.table_name || '_' || i.source_file || '_' || substr(i.file_sha256, 1, 8) || '.csv' AS planned_backup
    FROM {_IMPORTS} i WHERE i.source_file = 'en/file_7.xlsx'""")
def revert_plan(spark, sf):
    undone = revert.select_imports(imports(spark, sf), source_file="en/file_7.xlsx")
    return revert.revert_plan(undone, _data(spark, sf))


@query(f"""SELECT table_name, source_file, file_sha256, conv_id, turn FROM {_DATA} WHERE table_name = 'src3'""")
def backup_rows(spark, sf):
    return revert.affected(_data(spark, sf), imports(spark, sf).filter("table_name = 'src3'"))


@query(f"""SELECT id AS step, table_name, source_file, change_type, CASE WHEN change_type = 'add_column' THEN 'drop_column'
      WHEN change_type = 'alter_type' AND old_type IS NOT NULL THEN 'restore_type' ELSE 'manual' END AS action, column_name,
    CASE WHEN change_type = 'alter_type' THEN old_type END AS restored_type,
    CASE WHEN change_type = 'create_table' THEN 'drop table ' || table_name WHEN change_type = 'alter_type' AND old_type IS NULL
      THEN 'original type unknown: ' || table_name || '.' || column_name END AS manual_step
    FROM {_CHANGES} WHERE table_name = 't_o' AND source_file = 'f7.xlsx'""")
def schema_revert_plan(spark, sf):
    return revert.schema_revert_plan(changes(spark, sf), "t_o", "f7.xlsx").orderBy(F.desc("step"))


@query(f"""SELECT table_name, source_file, count(*) FILTER (change_type = 'create_table') AS drops_table,
    count(*) FILTER (change_type = 'add_column') AS drops_column, count(*) FILTER (old_type IS NOT NULL) AS restores_type
    FROM {_CHANGES} GROUP BY ALL""")
def schema_revert_all(spark, sf):
    """The plan of every file at once, with created tables dropped."""
    plan = revert.schema_revert_plan(changes(spark, sf), drop_created=True)
    n = lambda a: F.count_if(F.col("action") == a)
    return plan.groupBy("table_name", "source_file").agg(
        n("drop_table").alias("drops_table"), n("drop_column").alias("drops_column"), n("restore_type").alias("restores_type"))


@query(f"""WITH p AS (SELECT * FROM {_CHANGES} WHERE source_file = 'f7.xlsx'),
    cols AS (SELECT DISTINCT table_name, column_name, 'TEXT' AS sql_type FROM {_CHANGES} WHERE column_name IS NOT NULL)
    SELECT table_name, column_name, coalesce((SELECT arg_min(old_type, id) FROM p WHERE p.table_name = c.table_name
      AND p.column_name = c.column_name AND old_type IS NOT NULL), sql_type) AS sql_type FROM cols c
    WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.table_name = c.table_name AND p.column_name = c.column_name AND change_type = 'add_column')""")
def schema_after_revert(spark, sf):
    log = changes(spark, sf)
    now = log.filter(F.col("column_name").isNotNull()).select("table_name", "column_name", F.lit("TEXT").alias("sql_type")).distinct()
    return revert.schema_after_revert(now, revert.schema_revert_plan(log, source_file="f7.xlsx"))


@query(f"""SELECT sum(CASE WHEN id % 3 = 0 THEN row_count ELSE 0 END)::BIGINT AS total_deleted_rows, bool_or(id % 50 = 0) AS manual_steps_required,
    count(*) FILTER (id % 3 = 0) AS executed_count FROM {_IMPORTS}""")
def report_rollup(spark, sf):
    done = F.col("id") % 3 == 0
    return ledger.report_rollup(imports(spark, sf).select(
        F.when(done, F.col("row_count")).otherwise(0).alias("deleted_rows"), done.alias("executed"),
        F.when(F.col("id") % 50 == 0, "drop table").alias("manual_step")))


@query(f"""SELECT table_name, CAST(id AS VARCHAR) AS backup_path FROM (
    SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY created_at DESC, CAST(id AS VARCHAR) DESC) AS n FROM (
      SELECT table_name, id, imported_at AS created_at FROM {_IMPORTS}))
    WHERE n > 5 OR created_at < (SELECT max(imported_at) FROM {_IMPORTS}) - INTERVAL 1 DAY""")
def backup_retention(spark, sf):
    manifest = imports(spark, sf).select("table_name", F.col("id").cast("string").alias("backup_path"),
                                         F.col("imported_at").alias("created_at"))
    now = manifest.agg(F.max("created_at")).head()[0]
    return revert.expired_backups(manifest, now, retention_days=1, max_files=5).select("table_name", "backup_path")
