"""Tables and ledgers as Parquet folders.

Rows of a run go to ``data/<table>/_schema_version=N/_run=R``; each ledger to ``ledger/<name>/_run=R``.
A run is committed by its entry in ``ledger/log``, made last by one writer only; readers see committed runs only,
and a repeated run overwrites what it left. Type changes and new columns are registry entries, data is
cast when read, so no file is rewritten.
"""

from __future__ import annotations

import datetime
import json
import re
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folderloom.functions import names
from folderloom.operators import columns, ledger, revert
from folderloom.operators.inference import struct_type
from folderloom.operators.joins import broadcast_if_small
from folderloom.plans.staging import Stage
from folderloom.sources import files as file_source
from folderloom.sources.delimited import CSV_OPTIONS, RECORD, below, read_declared, write_csv

# The columns of the ledgers ``imports`` and ``changes`` are what callers query; the others are this store's own.
LEDGERS = {
    "imports": "id bigint, table_name string, source_file string, file_sha256 string, row_count bigint, "
               "imported_at timestamp, folder_path string, schema_version int, length bigint, modified timestamp",
    "changes": "id bigint, table_name string, change_type string, column_name string, old_type string, "
               "new_type string, source_file string, changed_at timestamp, details string",
    "columns": "table_name string, version int, column_name string, sql_type string, ordinal int",
    "outcomes": "table_name string, source_file string, file_sha256 string, status string, reason string, "
                "row_count bigint, schema_changes bigint, seconds double, at timestamp",
    "reverts": "table_name string, source_file string, file_sha256 string, import_run string, reverted_at timestamp",
    "undone_changes": "id bigint, table_name string, source_file string, column_name string",
    "backups": "table_name string, backup_path string, row_count bigint, reason string, created_at timestamp, "
               "source_file string, file_sha256 string",
    "rejects": "table_name string, source_file string, file_sha256 string, record string, fitting_cells int, at timestamp",
    "expired": "table_name string, backup_path string",
    "purged": "table_name string, path string, state string, at timestamp",
}
LOG = "version bigint, _run string, committed_at timestamp, tables array<string>"
LINEAGE = {"source_file": T.StringType(), "load_timestamp": T.TimestampType()}


class ConcurrentCommit(RuntimeError):
    """Another run has changed the same tables since this one looked at them."""


class Store:
    """Tables below one root folder that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- ledgers --------------------------------------------------------------------------------

    def _path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(LEDGERS[name])

    def _raw_ledger(self, name: str) -> DataFrame:
        schema = T.StructType([*self._schema(name).fields, T.StructField("_run", T.StringType())])
        try:
            return self.spark.read.schema(schema).parquet(self._path("ledger", name))
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def commits(self, at: int | None = None) -> DataFrame:
        """The log: one row per committed run (version, _run, committed_at, tables), up to a version if given."""
        try:
            log = self.spark.read.schema(LOG).json(self._path("ledger", "log"))
        except AnalysisException:
            log = self.spark.createDataFrame([], LOG)
        return log if at is None else log.filter(F.col("version") <= at)

    def head(self) -> int:
        """Version of the last commit. Entries never change, so reads ``at`` a version always find the same runs."""
        return self.commits().agg(F.max("version")).head()[0] or 0

    def committed(self, run: str) -> bool:
        return not self.commits().filter(F.col("_run") == run).isEmpty()

    def _of_commits(self, rows: DataFrame, at: int | None) -> DataFrame:
        """Rows of committed runs; the names of runs stay out of the plan and the driver, however many there are."""
        return rows.join(self.commits(at).select("_run"), "_run", "left_semi").select(*rows.columns)

    def read_ledger(self, name: str, at: int | None = None) -> DataFrame:
        return self._of_commits(self._raw_ledger(name), at)

    def run_ledger(self, name: str, run: str) -> DataFrame:
        """What one run wrote, committed or not."""
        return self._raw_ledger(name).filter(F.col("_run") == run)

    def append_ledger(self, name: str, run: str, rows: DataFrame) -> None:
        wanted = self._schema(name)
        rows.select(*[F.col(f.name).cast(f.dataType) for f in wanted.fields]).write.mode("overwrite").parquet(
            self._path("ledger", name, f"_run={run}"))

    def commit(self, run: str, since: int | None = None, tables: Sequence[str] = ()) -> int:
        """Make a run visible by the next entry of the log; returns its version.

        An entry appears whole or not at all, and only one of several writers can make it, as in the log of a streaming
        query: by a rename that refuses an existing target. A run that was worked out from what stood ``since`` a version
        is refused with ``ConcurrentCommit`` if a later commit touches one of its tables; it stays invisible and may be run
        again. Runs on other tables, and those that only add to what is there, take the next version.
        """
        version, checked = self.head(), since
        while True:
            if since is not None and version > checked:
                later = self.commits().filter((F.col("version") > checked) & F.arrays_overlap("tables", F.lit(list(tables)).cast("array<string>")))
                if first := later.head():
                    raise ConcurrentCommit(f"run {run} is not committed: run {first['_run']} has changed {', '.join(set(tables) & set(first.tables))} meanwhile")
                checked = version
            moment = datetime.datetime.now(datetime.UTC).isoformat(timespec="microseconds")
            entry = {"version": version + 1, "_run": run, "committed_at": moment, "tables": sorted(tables)}
            if self._create_entry(version + 1, json.dumps(entry)):
                return version + 1
            version = max(version, self.head())

    def _create_entry(self, version: int, text: str) -> bool:
        """Whether this entry of the log was made here; False if it was there."""
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        folder = hadoop.Path(self._path("ledger", "log"))
        system = folder.getFileSystem(conf)
        entry = system.makeQualified(hadoop.Path(folder, f"{version:012d}.json"))
        draft = system.makeQualified(hadoop.Path(folder, f".{uuid.uuid4().hex}"))
        system.mkdirs(folder)
        out = system.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(hadoop, "Options$Rename")
        how = self.spark._sc._gateway.new_array(rename, 1)
        how[0] = rename.valueOf("NONE")
        try:
            hadoop.FileContext.getFileContext(system.getUri(), conf).rename(draft, entry, how)
            return True
        except Py4JJavaError as failed:
            if failed.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            system.delete(draft, False)
            return False

    def imports(self, at: int | None = None) -> DataFrame:
        """Live imports: committed and not reverted."""
        at = self.head() if at is None else at
        live = self.read_ledger("imports", at)
        gone = self.read_ledger("reverts", at).select("table_name", "source_file", F.col("import_run").alias("_run"))
        return live.join(gone.distinct(), ["table_name", "source_file", "_run"], "left_anti")

    def changes(self) -> DataFrame:
        at = self.head()
        key = ["id", "table_name", "source_file", "column_name"]
        undone = self.read_ledger("undone_changes", at).select(*key).distinct()
        return self.read_ledger("changes", at).join(undone, key, "left_anti")

    def outcomes(self) -> DataFrame:
        return self.read_ledger("outcomes")

    def quarantine(self) -> DataFrame:
        """Files that failed and were not imported since."""
        failed = self.outcomes().filter("status = 'error'")
        return failed.join(self.imports().select(*ledger.IMPORT_KEY), list(ledger.IMPORT_KEY), "left_anti")

    # --- catalogue ------------------------------------------------------------------------------

    def registry(self, at: int | None = None) -> DataFrame:
        """Columns of the current version of every table."""
        entries = self.read_ledger("columns", at)
        current = entries.groupBy("table_name").agg(F.max("version").alias("version"))
        return entries.join(current, ["table_name", "version"], "left_semi").filter("column_name IS NOT NULL")

    def tables(self) -> DataFrame:
        return ledger.distinct_tables(self.registry())

    def table_versions(self, table: str, at: int | None = None) -> dict[int, dict[str, str]]:
        """Column to type of one table by schema version, columns in order."""
        rows = self.read_ledger("columns", at).filter(F.col("table_name") == table).collect()
        out: dict[int, dict[str, str]] = {}
        for r in sorted(rows, key=lambda r: (r.version, r.ordinal)):
            out.setdefault(r.version, {}).update({r.column_name: r.sql_type} if r.column_name else {})
        return out

    def table_columns(self, table: str) -> dict[str, str]:
        versions = self.table_versions(table)
        return versions[max(versions)] if versions else {}

    def table_exists(self, table: str) -> bool:
        return bool(self.table_columns(table))

    def stats(self) -> DataFrame:
        """Columns, files and rows of every table, from the ledgers."""
        counts = self.imports().groupBy("table_name").agg(F.sum("row_count").alias("row_count"))
        return ledger.table_stats(self.registry(), counts, self.tables())

    def status(self, limit: int | None = 10) -> DataFrame:
        return ledger.status_rollup(self.imports(), limit)

    def next_version(self, at: int | None = None) -> DataFrame:
        return self.read_ledger("columns", at).groupBy("table_name").agg((F.max("version") + 1).alias("version"))

    # --- tables ---------------------------------------------------------------------------------

    def create_table(self, table: str, schema: dict[str, str], source_file: str | None = None,
                     if_exists: str = "ignore") -> bool:
        """Register an empty table and log it; an existing one is left alone, or refused with ``fail``."""
        columns.check_insertable(list(schema))
        if not is_table_name(table):
            raise ValueError(f"invalid table name {table!r}")
        at = self.head()
        if self.table_exists(table):
            if if_exists == "fail":
                raise ValueError(f"table {table} exists")
            return False
        run = f"create-{uuid.uuid4().hex}"
        rows = [(table, 1, c, t, i) for i, (c, t) in enumerate(schema.items())]
        self.append_ledger("columns", run, self.spark.createDataFrame(rows, self._schema("columns")))
        now = datetime.datetime.now()
        self.append_ledger("changes", run, self.spark.createDataFrame(
            [(int(now.timestamp() * 1000) << 20, table, "create_table", None, None, None, source_file, now, None)],
            self._schema("changes")))
        self.commit(run, at, [table])
        return True

    def load_csv(self, table: str, path: str, schema: dict[str, str]) -> int:
        """Bulk load of CSV files under a declared schema, creating the table if need be; returns the rows added.

        Files are known by name and content, so a second load adds only what is new. Records with a cell that does not fit its
        type, or with too few or too many cells, are no rows of the table: they go to ``rejects()`` as they stand in the file.
        An empty cell is null, in every type. A file without any good row is imported with no rows.
        """
        self.create_table(table, schema)
        at, run = self.head(), f"load-{uuid.uuid4().hex}"
        stage = Stage(self.spark)
        found = file_source.scan_files(self.spark, path, (".csv",), in_root=True)
        found = found.withColumns({"table_name": F.lit(table), "source_file": below(path, "source_file")})
        found = stage.keep(found, "found")
        if found.isEmpty():
            raise ValueError(f"no file ending in .csv at {path}")
        if unread := found.filter("signature = 'unread'").orderBy("source_file").head():
            raise RuntimeError(f"{unread.source_file} cannot be read")
        fresh = stage.keep(ledger.not_imported(found, self.imports(at)), "fresh")
        if fresh.isEmpty():
            return 0
        version = max(self.table_versions(table, at))
        rows = read_declared(self.spark, path, fresh, struct_type(schema))
        good, broken = rows.filter(F.col(RECORD).isNull()), rows.filter(F.col(RECORD).isNotNull())
        declared = columns.align(good.withColumn("load_timestamp", F.current_timestamp()), self.table_columns(table), [*LINEAGE])
        self.write_rows(table, version, run, declared)
        counts = self.written_counts(table, version, run)
        about = fresh.select("source_file", "file_sha256", "length", "modified")
        fitting = sum((columns.quoted(c).isNotNull().cast("int") for c in schema), F.lit(0)).alias("fitting_cells")
        self.append_ledger("rejects", run, broken.select("source_file", F.col(RECORD).alias("record"), fitting).join(about, "source_file").select(
            F.lit(table).alias("table_name"), "source_file", "file_sha256", "record", "fitting_cells", F.current_timestamp().alias("at")))
        self.append_ledger("imports", run, about.join(counts, "source_file", "left").select(
            F.xxhash64(F.lit(table), "source_file", "file_sha256").alias("id"), F.lit(table).alias("table_name"), "source_file",
            "file_sha256", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.current_timestamp().alias("imported_at"),
            F.lit(path).alias("folder_path"), F.lit(version).alias("schema_version"), "length", "modified"))
        self.commit(run, at, [table])
        stage.discard()
        return self.run_ledger("imports", run).agg(F.sum("row_count")).head()[0]

    def rejects(self) -> DataFrame:
        """Records that bulk loads kept out of the tables, with their files; those of reverted files are left out."""
        return self.read_ledger("rejects").join(self.imports().select(*ledger.IMPORT_KEY).distinct(), list(ledger.IMPORT_KEY), "left_semi")

    def write_rows(self, table: str, version: int, run: str, rows: DataFrame) -> None:
        columns.check_insertable(rows.columns)
        rows.write.mode("overwrite").parquet(self._path("data", table, f"_schema_version={version}", f"_run={run}"))

    def written_counts(self, table: str, version: int, run: str) -> DataFrame:
        """(source_file, row_count) of what a run wrote."""
        rows = self.spark.read.parquet(self._path("data", table, f"_schema_version={version}", f"_run={run}"))
        return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count"))

    def _all_rows(self, table: str, at: int) -> tuple[DataFrame | None, dict[str, str]]:
        """Rows of all versions with a live import, in the current schema with their run, reverted ones of these included.
        There is one scan per schema version, not per file."""
        schemas = self.table_versions(table, at)
        target = schemas[max(schemas)] if schemas else {}
        mine = self.imports(at).filter((F.col("table_name") == table) & (F.col("row_count") > 0))
        frames = []
        for version in sorted(r[0] for r in mine.select("schema_version").distinct().collect()):
            lineage = [T.StructField(n, t) for n, t in LINEAGE.items()]
            schema = T.StructType([*struct_type(schemas[version]).fields, *lineage, T.StructField("_run", T.StringType())])
            rows = self.spark.read.schema(schema).parquet(self._path("data", table, f"_schema_version={version}"))
            # A run that was refused and run again may have left rows under another version; its imports name the right one.
            held = mine.filter(F.col("schema_version") == version).select("_run").distinct()
            frames.append(rows.join(held, "_run", "left_semi").select(*rows.columns))
        return (columns.append_frames(frames, target, [*LINEAGE, "_run"]) if frames else None), target

    def read_table(self, table: str) -> DataFrame:
        """Live rows in the current schema."""
        at = self.head()
        rows, target = self._all_rows(table, at)
        if not target:
            raise ValueError(f"no table {table}")
        if rows is None:
            fields = [*struct_type(target).fields, *[T.StructField(n, t) for n, t in LINEAGE.items()]]
            return self.spark.createDataFrame([], T.StructType(fields))
        gone = self.read_ledger("reverts", at).filter(F.col("table_name") == table).select(
            "source_file", F.col("import_run").alias("_run")).distinct()
        if not gone.isEmpty():
            rows = rows.join(broadcast_if_small(gone), ["source_file", "_run"], "left_anti")
        return rows.select(*target, *LINEAGE)

    def _rows_of(self, table: str, imports: DataFrame) -> DataFrame:
        """Rows of chosen imports of one table."""
        rows, target = self._all_rows(table, self.head())
        chosen = imports.filter(F.col("table_name") == table).select("source_file", "_run")
        if rows is None:
            fields = [*struct_type(target).fields, *[T.StructField(n, t) for n, t in LINEAGE.items()]]
            return self.spark.createDataFrame([], T.StructType([*fields, T.StructField("_run", T.StringType())]))
        return rows.join(broadcast_if_small(chosen), ["source_file", "_run"], "left_semi").select(*target, *LINEAGE, "_run")

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        """SQL with named parameters over all tables and the ledgers ``etl_imports`` and ``etl_schema_changes``."""
        for r in self.tables().collect():
            self.read_table(r[0]).createOrReplaceTempView(r[0])
        self.imports().createOrReplaceTempView("etl_imports")
        self.changes().createOrReplaceTempView("etl_schema_changes")
        return self.spark.sql(text, args=args or {})

    # --- reverts --------------------------------------------------------------------------------

    def revert_plan(self, table: str | None = None, selector: str | None = None, **by: str) -> DataFrame:
        """What a revert would remove, per import, with counted rows; nothing is changed."""
        chosen = self._chosen(table, selector, by)
        found = [self._rows_of(r[0], chosen).groupBy("source_file", "_run").agg(F.count(F.lit(1)).alias("found_rows"))
                 .withColumn("table_name", F.lit(r[0])) for r in chosen.select("table_name").distinct().collect()]
        counts = found[0] if found else self.spark.createDataFrame(
            [], "source_file string, _run string, found_rows bigint, table_name string")
        for f in found[1:]:
            counts = counts.unionByName(f)
        return chosen.join(counts, ["table_name", "source_file", "_run"], "left").select(
            "id", "table_name", "source_file", "file_sha256", F.col("row_count").alias("expected_rows"),
            F.coalesce("found_rows", F.lit(0)).alias("found_rows"))

    def _chosen(self, table: str | None, selector: str | None, by: dict[str, str]) -> DataFrame:
        if selector is not None:
            by = revert.selector(selector)
        return revert.select_imports(self.imports(), table, by.get("source_file"), by.get("file_sha256"))

    def revert(self, table: str | None = None, selector: str | None = None, backup: bool = False, **by: str) -> DataFrame:
        """Undo imports by ``source_file``, ``file_sha256`` or a ``selector`` that is either.

        A hash undoes that version of the file only. Returns the report of what was removed.
        """
        since = self.head()
        return self.revert_imports(self._chosen(table, selector, by), backup, since)

    def revert_imports(self, chosen: DataFrame, backup: bool = False, since: int | None = None) -> DataFrame:
        """Undo any selection of ``imports()`` at once; of that ``since`` a version, or of now."""
        run, since = f"revert-{uuid.uuid4().hex}", self.head() if since is None else since
        touched = [r[0] for r in chosen.select("table_name").distinct().collect()]
        if backup:
            for table in touched:
                self._backup_imports(table, chosen, run)
        self.append_ledger("reverts", run, chosen.select(
            "table_name", "source_file", "file_sha256", F.col("_run").alias("import_run"),
            F.current_timestamp().alias("reverted_at")))
        report = self._raw_ledger("reverts").filter(F.col("_run") == run).drop("_run")
        counts = self.read_ledger("imports").select(
            "table_name", "source_file", F.col("_run").alias("import_run"), F.col("row_count").alias("deleted_rows"))
        self.commit(run, since, touched)
        return report.join(counts, ["table_name", "source_file", "import_run"]).select(
            "table_name", "source_file", "file_sha256", "deleted_rows", F.lit(True).alias("executed"),
            F.lit(None).cast("string").alias("manual_step"))

    def schema_revert_plan(self, table: str, source_file: str) -> DataFrame:
        return revert.schema_revert_plan(self.changes(), table, source_file).orderBy(F.desc("step"))

    def revert_schema(self, table: str, source_file: str) -> int:
        """Apply the plan as a new schema version; the changes leave the ledger. Returns the number undone."""
        at = self.head()
        plan = self.schema_revert_plan(table, source_file).filter("action IN ('drop_column', 'restore_type')")
        todo = plan.count()
        if not todo:
            return 0
        mine = self.registry().filter(F.col("table_name") == table)
        after = revert.schema_after_revert(mine, plan)
        run = f"schema-{uuid.uuid4().hex}"
        self.append_ledger("columns", run, after.withColumn("version", F.col("version") + 1))
        self.append_ledger("undone_changes", run, plan.select(
            F.col("step").alias("id"), "table_name", "source_file", "column_name"))
        self.commit(run, at, [table])
        return todo

    # --- backups --------------------------------------------------------------------------------

    def backup(self, table: str, where: str | None = None, fmt: str = "parquet", reason: str = "manual") -> tuple[str, int]:
        """Snapshot of the matching rows; returns its path and row count."""
        rows = self.read_table(table) if where is None else self.read_table(table).filter(where)
        run = f"backup-{uuid.uuid4().hex}"
        out = self._write_backup(table, rows, run, fmt, reason, None)
        self.commit(run)
        return out

    def _backup_imports(self, table: str, chosen: DataFrame, run: str) -> None:
        """Snapshot of imports that are about to go, unless every one already has a backup by its hash."""
        held = self.backups().filter(F.col("table_name") == table).select("file_sha256", "source_file")
        mine = chosen.filter(F.col("table_name") == table)
        missing = mine.join(held, ["file_sha256", "source_file"], "left_anti")
        if not missing.isEmpty():
            self._write_backup(table, self._rows_of(table, missing).drop("_run"), f"{run}-{table}", "parquet", "import_revert", missing)
            self.commit(f"{run}-{table}")

    def _write_backup(self, table: str, rows: DataFrame, run: str, fmt: str, reason: str,
                      imports: DataFrame | None) -> tuple[str, int]:
        path = self._path("backups", table, run)
        if fmt == "csv":
            write_csv(rows, path)
            # Cells may hold line ends, so the copy is counted by records.
            n = self.spark.read.options(**CSV_OPTIONS).option("multiLine", True).csv(path).count()
        else:
            rows.write.mode("overwrite").parquet(path)
            n = self.spark.read.parquet(path).count()
        about = [F.lit(table).alias("table_name"), F.lit(path).alias("backup_path"), F.lit(n).alias("row_count"),
                 F.lit(reason).alias("reason"), F.current_timestamp().alias("created_at")]
        if imports is None:
            entry = self.spark.range(1).select(*about, F.lit(None).cast("string").alias("source_file"),
                                               F.lit(None).cast("string").alias("file_sha256"))
        else:
            entry = imports.select(*about, "source_file", "file_sha256")
        self.append_ledger("backups", run, entry)
        return path, n

    def backups(self) -> DataFrame:
        at = self.head()
        gone = self.read_ledger("expired", at).select("table_name", "backup_path").distinct()
        return self.read_ledger("backups", at).join(gone, ["table_name", "backup_path"], "left_anti")

    def expire_backups(self, retention_days: int | None = None, max_files: int | None = None,
                       now: datetime.datetime | None = None) -> int:
        """Drop old backups from the manifest, and with the next ``purge`` from disk; returns how many."""
        manifest = self.backups().select("table_name", "backup_path", "created_at").distinct()
        moment = now or datetime.datetime.now()
        old = revert.expired_backups(manifest, moment, retention_days, max_files)
        run = f"expire-{uuid.uuid4().hex}"
        self.append_ledger("expired", run, old.select("table_name", "backup_path"))
        self.commit(run)
        return self._raw_ledger("expired").filter(F.col("_run") == run).count()

    # --- physical removal -----------------------------------------------------------------------

    def purge(self, grace_seconds: float = 86_400, rewrite: bool = True, now: datetime.datetime | None = None) -> DataFrame:
        """Remove from disk what no ledger holds any more; returns the paths that are gone (kind, table_name, path).

        Two phases, so that readers who fetched the list of runs before stay right. First, runs that are reverted in part
        are rewritten without the reverted rows (``rewrite``), as a run of its own that takes over the live imports by one
        commit; then the folders of runs without a live import are marked, those of dropped tables among them. Folders marked
        at least ``grace_seconds`` ago are deleted, and so are the copies of expired backups. A purge that fails half-way is
        simply run again: each step leaves a state that readers see the same rows in.
        """
        moment = now or datetime.datetime.now()
        if rewrite:
            self._rewrite_partial()
        self._mark_dead(moment)
        return self._remove(moment - datetime.timedelta(seconds=grace_seconds))

    def _import_states(self) -> DataFrame:
        """All committed imports with rows, and whether they are live."""
        at = self.head()
        key = ["table_name", "source_file", "_run"]
        every = self.read_ledger("imports", at).filter("row_count > 0")
        return every.join(self.imports(at).select(*key).distinct().withColumn("live", F.lit(True)), key, "left").withColumn(
            "live", F.coalesce("live", F.lit(False)))

    def _rewrite_partial(self) -> None:
        """Live rows of partly reverted runs go to one new run per table, in the current schema."""
        at = self.head()
        folder = ["table_name", "schema_version", "_run"]
        states = self._import_states()
        partial = states.groupBy(*folder).agg(F.bool_or("live").alias("_some"), F.bool_and("live").alias("_all")).filter("_some AND NOT _all")
        moved = states.filter("live").join(partial.select(*folder), folder, "left_semi")
        for table in sorted(r[0] for r in moved.select("table_name").distinct().collect()):
            run, version = f"purge-{uuid.uuid4().hex}", max(self.table_versions(table))
            mine = moved.filter(F.col("table_name") == table)
            self.write_rows(table, version, run, self._rows_of(table, mine).drop("_run"))
            self.append_ledger("imports", run, mine.withColumn("schema_version", F.lit(version)))
            self.append_ledger("reverts", run, mine.select(
                "table_name", "source_file", "file_sha256", F.col("_run").alias("import_run"), F.current_timestamp().alias("reverted_at")))
            self.commit(run, at, [table])

    def _mark_dead(self, moment: datetime.datetime) -> None:
        """Log the folders of runs without a live import, and those of expired backups."""
        states, at = self._import_states(), self.head()
        dead = states.groupBy("table_name", "schema_version", "_run").agg(F.bool_or("live").alias("_live")).filter("NOT _live")
        path = F.concat_ws("/", F.lit(self._path("data")), "table_name", F.concat(F.lit("_schema_version="), F.col("schema_version").cast("string")),
                           F.concat(F.lit("_run="), F.col("_run")))
        folders = dead.select("table_name", path.alias("path"), F.lit("marked").alias("state"))
        copies = self.read_ledger("expired", at).select("table_name", F.col("backup_path").alias("path"), F.lit("expired").alias("state"))
        known = self.read_ledger("purged", at).select("path").distinct()
        new = folders.unionByName(copies).distinct().join(known, "path", "left_anti")
        run = f"mark-{uuid.uuid4().hex}"
        self.append_ledger("purged", run, new.withColumn("at", F.lit(moment)))
        self.commit(run)

    def _remove(self, before: datetime.datetime) -> DataFrame:
        """Delete marked folders of ``before`` or earlier, expired copies at once; one call of the file system each."""
        log = self.read_ledger("purged")
        gone = log.filter("state = 'removed'").select("path")
        due = log.filter((F.col("state") == "expired") | ((F.col("state") == "marked") & (F.col("at") <= F.lit(before)))).join(
            gone, "path", "left_anti").select("state", "table_name", "path").distinct().collect()
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for r in due:
            at = hadoop(r.path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        removed = self.spark.createDataFrame(
            [("backup" if r.state == "expired" else "run", r.table_name, r.path) for r in due], "kind string, table_name string, path string")
        if due:
            run = f"removed-{uuid.uuid4().hex}"
            self.append_ledger("purged", run, removed.select("table_name", "path", F.lit("removed").alias("state"), F.current_timestamp().alias("at")))
            self.commit(run)
        return removed

    # --- reset ----------------------------------------------------------------------------------

    def drop_tables(self, tables: Sequence[str] | None = None, confirm: bool = False) -> list[str]:
        """Forget the named tables, or all imported ones: their imports are reverted and their columns
        unregistered, so that the next run starts them anew. Needs ``confirm=True``."""
        if not confirm:
            raise ValueError("dropping tables needs confirm=True")
        at = self.head()
        chosen = [r[0] for r in self.tables().collect()]
        if tables is not None:
            chosen = [t for t in chosen if t in set(tables)]
        if not chosen:
            return []
        run = f"drop-{uuid.uuid4().hex}"
        live = self.imports().filter(F.col("table_name").isin(*chosen))
        self.append_ledger("reverts", run, live.select(
            "table_name", "source_file", "file_sha256", F.col("_run").alias("import_run"),
            F.current_timestamp().alias("reverted_at")))
        gone = self.next_version().filter(F.col("table_name").isin(*chosen)).select(
            "table_name", "version", F.lit(None).cast("string").alias("column_name"),
            F.lit(None).cast("string").alias("sql_type"), F.lit(0).alias("ordinal"))
        self.append_ledger("columns", run, gone)
        self.commit(run, at, chosen)
        return chosen


def safe_run_name(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "-", text)


def is_table_name(text: str) -> bool:
    return re.match(names.IDENTIFIER_PATTERN, text) is not None
