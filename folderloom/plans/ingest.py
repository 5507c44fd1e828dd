"""Ingestion of a folder tree: list, hash, skip known files, scan, infer, evolve, clean, append, commit.

Every stage is one job over all files of all tables, except the final append, which is one job per
table because tables differ in schema.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folderloom.functions import names, sqltypes
from folderloom.operators import columns, evolution, inference, ledger
from folderloom.operators.joins import broadcast_if_small
from folderloom.operators.sheets import DEFAULT_SHEET
from folderloom.plans import scans as scanning
from folderloom.plans.scans import SOURCE, Scan, ScanSet, union
from folderloom.plans.staging import Stage
from folderloom.plans.store import Store, safe_run_name
from folderloom.sources import files as file_source
from folderloom.sources import workbook

# Appends of different tables that may run side by side, so that small tables do not idle the cluster.
TABLES_AT_ONCE = 8
EXTENSIONS = {"workbook": file_source.WORKBOOK_EXTENSIONS, "csv": (".csv",), "json": (".json",), "archive": (".zip",)}


@dataclass
class Options:
    """How a run reads, names, types and commits.

    ``table_naming`` path, safe or folder; ``dedupe`` key (table, file, hash) or content (table, hash);
    ``trust_listing`` takes files of unchanged path, size and time for known without reading them;
    ``inference`` votes (most common type from 80 %), majority (over half) or unanimous (all values);
    ``text_on_misfit`` makes a numeric column with any other value TEXT; ``policy`` how types widen;
    ``atomic`` file or folder, what a failed file holds back; ``on_error`` skip or abort.
    """

    dialect: str = "current"
    duplicates: str = "merge"
    table_naming: str = "path"
    sheets: dict = field(default_factory=dict)
    default_sheet: str | None = DEFAULT_SHEET
    sheet_rule: str = "nearest"
    all_sheets: bool = False
    policy: str = "lub"
    inference: str = "votes"
    compat: bool = False
    text_on_misfit: bool = False
    dedupe: str = "key"
    trust_listing: bool = False
    drop_empty: bool = True
    keep_empty: bool = False
    only_files: Sequence[str] = ()
    transforms: Sequence[Callable[[DataFrame], DataFrame]] = ()
    type_overrides: dict[str, str] = field(default_factory=dict)
    on_error: str = "skip"
    atomic: str = "file"
    json_lines: bool = False
    dry_run: bool = False
    #: Larger workbooks are refused; Spark's reader of whole files ends at this size.
    whole_row_bytes: int = (1 << 31) - 1 - (1 << 20)


@dataclass
class Result:
    """What a run did, or with ``dry_run`` would do."""

    run: str
    outcomes: DataFrame
    changes: DataFrame
    schema: DataFrame

    def metrics(self) -> DataFrame:
        return ledger.run_metrics(self.outcomes)

    def summary(self) -> DataFrame:
        return ledger.outcome_summary(self.outcomes)


def table_name(naming: str) -> Column:
    """Table of a listed file: the folder path, the path made safe, or the last folder alone."""
    parts = F.split("folder", "/")
    if naming == "path":
        return names.clean_identifier(names.table_from_parts(parts), "current")
    if naming == "safe":
        return names.safe_table_name(F.array_join(parts, "_"))
    if naming == "folder":
        return names.clean_identifier(F.element_at(parts, -1), "legacy")
    raise ValueError(f"unknown table naming {naming!r}")


def ingest(store: Store, root: str | Sequence[str], fmt: str = "workbook", options: Options | None = None,
           run: str | None = None, **kw) -> Result:
    """Import all new files of one format below a root folder, or below several one after the other."""
    if options and kw:
        raise TypeError(f"options are given; {sorted(kw)} would be ignored")
    options = options or Options(**kw)
    if not isinstance(root, str):
        return _together([ingest(store, r, fmt, options, run and f"{run}-{i}") for i, r in enumerate(root)])
    known = None
    if options.trust_listing and fmt != "archive":
        listed = file_source.list_files(store.spark, root, EXTENSIONS[fmt])
        same = store.imports().select("table_name", "file_sha256", *_UNCHANGED)
        known = listed.join(same, list(_UNCHANGED))
        fresh = listed.join(same, list(_UNCHANGED), "left_anti")
        found = file_source.scan_files(store.spark, root, EXTENSIONS[fmt], listed=fresh)
    else:
        found = file_source.scan_files(store.spark, root, EXTENSIONS[fmt], in_root=fmt == "archive")
    return ingest_files(store, root, found, fmt, options, run, known)


def _together(results: list[Result]) -> Result:
    """One result of several runs; of a table that several of them changed, each schema version stands once."""
    if not results:
        raise ValueError("no root is given")
    outcomes, changes, schema = (reduce(DataFrame.unionByName, frames) for frames in zip(
        *((r.outcomes, r.changes, r.schema) for r in results), strict=True))
    return Result(",".join(r.run for r in results), outcomes, changes, schema.distinct())


_UNCHANGED = ("source_file", "length", "modified")


def ingest_files(store: Store, root: str, found: DataFrame, fmt: str, options: Options, run: str | None = None,
                 known: DataFrame | None = None) -> Result:
    """Import hashed files; ``found`` has the columns of ``scan_files``. ``known`` are files that were left
    out because they are imported already."""
    began, run = time.time(), safe_run_name(run or f"run-{uuid.uuid4().hex}")
    for name, values in (("on_error", ("skip", "abort")), ("atomic", ("file", "folder")), ("dedupe", ("key", "content")),
                         ("inference", ("votes", "majority", "unanimous")), ("policy", sqltypes.POLICIES)):
        if getattr(options, name) not in values:
            raise ValueError(f"{name} is one of {values}")
    if options.all_sheets and options.dedupe == "content":
        raise ValueError("with all_sheets files are known by name and hash, not by content alone")
    unknown = set(options.type_overrides.values()) - set(sqltypes.SPARK_TYPES)
    if unknown:
        raise ValueError(f"unknown types {sorted(unknown)}")
    if store.committed(run):
        return _recorded(store, run)
    at, stage = store.head(), Stage(store.spark)  # everything below is worked out from this version
    listed, contents = _listed(store, root, found, fmt, options, stage)
    candidates = stage.keep(_fresh(listed, store.imports(at), options), "candidates")
    scanned = _scanned(store, root, candidates, contents, fmt, options, stage)
    good, problems = _admitted(candidates, scanned, options, stage)
    good = stage.keep(good, "good")
    kept = {r[0] for r in good.select("table_name").distinct().collect()}
    scans = [s for s in scanned.scans if s.table in kept]
    refused = problems.select(F.col("source_file").alias(SOURCE)).distinct()
    if not refused.isEmpty():  # what could be read of a refused file stays out as well
        refused = broadcast_if_small(refused)
        scans = [Scan(s.table, s.frame.join(refused, SOURCE, "left_anti"), s.columns) for s in scans]

    types = stage.keep(_inferred(scans, scanned.headers, good, options, store), "types")
    existing = store.registry(at)
    moves = evolution.change_log(types, options.policy, existing, relog=options.policy == "chain")
    changes = stage.keep(_numbered(moves, types, began, stage), "changes")
    schema = stage.keep(_versioned(types, existing, store.next_version(at), options), "schema")

    count = _counted if options.dry_run else _append
    counts = count(store, run, scans, schema)
    key = ["table_name", "source_file", "file_sha256"]
    repeated = listed.join(candidates.select("source_file"), "source_file", "left_anti").select(*key)
    if known is not None:
        repeated = repeated.unionByName(known.select(*key))
    outcomes = _outcomes(candidates, good, counts, problems, repeated, changes, began)
    if options.dry_run:
        held = Stage(store.spark)  # results outlive the working copies, which go at once
        kept = [held.keep(df, name) for df, name in ((outcomes, "outcomes"), (changes, "changes"), (schema, "schema"))]
        stage.discard()
        return Result(run, *kept)
    _commit(store, run, at, good, counts, schema, changes, outcomes, options)
    stage.discard()
    return _recorded(store, run)


def _recorded(store: Store, run: str) -> Result:
    """What the ledgers hold of a run. A run that is repeated after its commit is left as it is."""
    return Result(run, *[store.run_ledger(n, run) for n in ("outcomes", "changes", "columns")])


def _listed(store, root, found, fmt, options, stage) -> tuple[DataFrame, DataFrame | None]:
    """Files with their table, and for archives the contents of the members."""
    contents = None
    if fmt == "archive":
        raw = file_source.binary_files(store.spark, root).filter(F.lower("path").endswith(".zip"))
        opened = workbook.archive_members(raw.select(file_source.relative_path("path", root).alias("source_file"), "content"))
        members = stage.keep(opened, "members")
        named = scanning.archive_listing(members)
        contents = members.filter("member IS NOT NULL").select(
            F.concat_ws("/", "archive", "member").alias("source_file"), "content")
    else:
        named = found.withColumn("table_name", table_name(options.table_naming))
    if options.only_files:
        named = ledger.by_base_name(named, list(options.only_files))
    return stage.keep(named, "listed"), contents


def _fresh(listed: DataFrame, known: DataFrame, options: Options) -> DataFrame:
    """Files that are not imported yet, before anything of them is parsed."""
    if options.all_sheets:
        return ledger.not_imported(listed, known, ("source_file", "file_sha256"))
    if options.dedupe == "content":
        return ledger.first_copies(ledger.not_imported(listed, known, ledger.CONTENT_KEY))
    return ledger.not_imported(listed, known)


def _scanned(store, root, candidates, contents, fmt, options, stage) -> ScanSet:
    spark = store.spark
    if fmt == "archive":
        fresh = contents.join(broadcast_if_small(candidates.select("source_file")), "source_file", "left_semi")
        out = scanning.scan_contents(spark, fresh, candidates, options, stage)
    else:
        scan = {"csv": scanning.scan_csv, "json": scanning.scan_json, "workbook": scanning.scan_workbooks}[fmt]
        out = scan(spark, root, candidates, options, stage)
    if options.transforms:
        out.scans = [_transformed(s, options.transforms) for s in out.scans]
    return out


def _transformed(scan: Scan, hooks) -> Scan:
    frame = columns.apply_transforms(scan.frame, hooks)
    return Scan(scan.table, frame, [c for c in frame.columns if c != SOURCE])


def _admitted(candidates, scanned, options, stage) -> tuple[DataFrame, DataFrame]:
    """(files to import, problem files). A folder with a failed file is held back if asked."""
    problems = stage.keep(scanned.problems, "problems")
    failed = problems.filter("status = 'error'")
    if options.on_error == "abort" and not failed.isEmpty():
        first = failed.orderBy("source_file").first()
        raise RuntimeError(f"{first.source_file}: {first.reason}")
    about = candidates.select("source_file", "file_sha256", "folder", "length", "modified")
    good = scanned.assigned.join(problems.select("source_file").distinct(), "source_file", "left_anti").join(about, "source_file")
    if options.atomic == "folder":
        broken = failed.join(candidates.select("source_file", "table_name"), "source_file").select("table_name").distinct()
        held = good.join(broken, "table_name", "left_semi")
        problems = stage.keep(problems.unionByName(
            scanning.problem(held, "skipped", "another file of the folder failed")), "problems_of_folders")
        good = good.join(broken, "table_name", "left_anti")
    return good, problems


def _inferred(scans, headers, good, options, store) -> DataFrame:
    """(table_name, column_name, file_key, sql_type, ordinal) of all files to import."""
    keys, spark = ["table_name", "file_key", "column_name"], store.spark
    cells, order = [], []
    for scan in scans:
        frame = scan.frame.withColumns({"table_name": F.lit(scan.table), "file_key": F.col(SOURCE)})
        cells.append(inference.cells(frame, ["table_name", "file_key"], scan.columns))
        order += [(scan.table, c, i) for i, c in enumerate(scan.columns)]
    every = union(cells, spark, "table_name string, file_key string, column_name string, value string")
    if options.inference == "majority":
        totals = union([s.frame.groupBy(F.lit(s.table).alias("table_name"), F.col(SOURCE).alias("file_key")).agg(
            F.count(F.lit(1)).alias("n_rows")) for s in scans], spark, "table_name string, file_key string, n_rows bigint")
        types = inference.majority_types(every, keys, totals)
    elif options.inference == "unanimous":
        types = inference.unanimous_types(every, keys)
    else:
        votes = inference.count_votes(every, keys, options.compat)
        types = inference.infer_types(votes, options.compat, options.text_on_misfit).select(*keys, "sql_type")
    files = good.select("table_name", F.col("source_file").alias("file_key"))
    if headers is not None:
        types = inference.with_empty_columns(types, headers.withColumnRenamed("source_file", "file_key"), keys)
    else:
        # A JSON key that is null throughout is known by the scan's schema alone; the first file stands for it.
        listed = spark.createDataFrame([r[:2] for r in order], "table_name string, column_name string").distinct()
        silent = listed.join(types.select("table_name", "column_name").distinct(), ["table_name", "column_name"], "left_anti")
        first = files.groupBy("table_name").agg(F.min("file_key").alias("file_key"))
        types = types.select(*keys, "sql_type").unionByName(
            silent.join(first, "table_name").select(*keys, F.lit("TEXT").alias("sql_type")))
    for name, sql_type in options.type_overrides.items():
        types = types.withColumn("sql_type", F.when(F.col("column_name") == name, sql_type).otherwise(F.col("sql_type")))
    ordinals = spark.createDataFrame(order, "table_name string, column_name string, ordinal int").groupBy(
        "table_name", "column_name").agg(F.min("ordinal").alias("ordinal"))
    return types.join(files, ["table_name", "file_key"], "left_semi").join(ordinals, ["table_name", "column_name"])


def _numbered(moves: DataFrame, types: DataFrame, began: float, stage: Stage) -> DataFrame:
    """Changes with ids that are unique and rise in the order they took effect within a table.

    There may be as many changes as files (TEXT columns logged again by the chain policy), so they are sorted in ranges
    and numbered in each; only the ranges' sizes are summed up in one place.
    """
    place = types.groupBy("table_name", "column_name").agg(F.min("ordinal").alias("_at"))
    kind = F.when(F.col("change_type") == "create_table", 0).when(F.col("change_type") == "add_column", 1).otherwise(2)
    placed = moves.join(place, ["table_name", "column_name"], "left").withColumn("_kind", kind)
    ordered = placed.orderBy("table_name", "source_file", "_kind", "_at", "column_name", "old_type", "new_type")
    ordered = stage.keep(ordered.withColumn("_m", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_m", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    numbered = ordered.withColumn("_part", part).join(starts, "_part")
    return numbered.select(
        (F.lit(int(began * 1000) << 20) + F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("id"),
        "table_name", "change_type", "column_name", "old_type", "new_type", "source_file",
        F.timestamp_micros(F.lit(int(began * 1e6))).alias("changed_at"),
        F.to_json(F.struct("old_type", "new_type")).alias("details"),
    )


def _versioned(types: DataFrame, existing: DataFrame, next_version: DataFrame, options: Options) -> DataFrame:
    """All columns of the touched tables and the schema version they are written under.

    Registered columns keep their place; new ones follow by file and position. A table that does not
    change keeps its version.
    """
    pair = ["table_name", "column_name"]
    touched = types.select("table_name").distinct()
    final = evolution.final_types(types, options.policy, existing).join(touched, "table_name", "left_semi")
    first = types.groupBy(*pair).agg(F.min(F.struct("file_key", "ordinal")).alias("_first"))
    old = existing.select(*pair, F.col("sql_type").alias("_old"), F.col("ordinal").alias("_place"))
    merged = final.join(old, pair, "left").join(first, pair, "left")
    differs = F.col("_old").isNull() | (F.col("_old") != F.col("sql_type"))
    per_table = Window.partitionBy("table_name")
    placed = merged.select(
        *pair, "sql_type", F.bool_or(differs).over(per_table).alias("moved"),
        (F.row_number().over(per_table.orderBy(F.col("_place").asc_nulls_last(), "_first", "column_name")) - 1).alias("ordinal"))
    current = existing.groupBy("table_name").agg(F.max("version").alias("_current"))
    following = next_version.withColumnRenamed("version", "_next")
    version = F.when(F.col("moved"), F.coalesce("_next", F.lit(1))).otherwise(F.col("_current"))
    return placed.join(current, "table_name", "left").join(following, "table_name", "left").select(
        "table_name", version.alias("version"), "column_name", "sql_type", "ordinal", "moved")


def _append(store: Store, run: str, scans: list[Scan], schema: DataFrame) -> DataFrame:
    """Write the cleaned rows of every table, one job per table; gives (table_name, source_file, row_count) as written."""
    by_table: dict[str, list] = {}
    for r in schema.orderBy("table_name", "ordinal").collect():
        by_table.setdefault(r.table_name, []).append(r)

    def write(table: str) -> DataFrame:
        cols = by_table[table]
        frames = [_cleaned(s, {r.column_name: r.sql_type for r in cols}) for s in scans if s.table == table]
        rows = reduce(DataFrame.unionByName, frames).withColumn("load_timestamp", F.current_timestamp())
        store.write_rows(table, cols[0].version, run, rows)
        return store.written_counts(table, cols[0].version, run).withColumn("table_name", F.lit(table))

    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        counts = list(pool.map(inheritable_thread_target(store.spark)(write), by_table))
    return union(counts, store.spark, "source_file string, row_count bigint, table_name string")


def _cleaned(scan: Scan, target: dict[str, str]) -> DataFrame:
    """Rows of a scan in the table's schema; columns it lacks are null."""
    out = []
    for name, sql_type in target.items():
        wanted = sqltypes.SPARK_TYPES[sql_type]
        value = sqltypes.clean_value(columns.quoted(name), sql_type) if name in scan.columns else F.lit(None)
        out.append(value.cast(wanted).alias(name))
    return scan.frame.select(*out, F.col(SOURCE).alias("source_file"))


def _counted(store: Store, run: str, scans: list[Scan], schema: DataFrame) -> DataFrame:
    """Rows a run would write, per table and file."""
    return union([s.frame.groupBy(F.col(SOURCE).alias("source_file")).agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "table_name", F.lit(s.table)) for s in scans], store.spark, "source_file string, row_count bigint, table_name string")


def _outcomes(candidates, good, counts, problems, repeated, changes, began) -> DataFrame:
    """One row per listed file and table: success, skipped or error, with the reason."""
    key, none = ["table_name", "source_file", "file_sha256"], F.lit(None).cast("string")
    per_file = changes.groupBy("table_name", "source_file").agg(F.count(F.lit(1)).alias("schema_changes"))
    done = good.join(counts, ["table_name", "source_file"], "left").join(per_file, ["table_name", "source_file"], "left").select(
        *key, F.lit("success").alias("status"), none.alias("reason"), F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("schema_changes", F.lit(0)).alias("schema_changes"))
    zero = [F.lit(0).cast("bigint").alias("row_count"), F.lit(0).cast("bigint").alias("schema_changes")]
    once = problems.groupBy("source_file").agg(F.min(F.struct("status", "reason")).alias("_p"))
    failed = once.join(candidates, "source_file").select(*key, "_p.status", "_p.reason", *zero)
    known = repeated.select(*key, F.lit("skipped").alias("status"), F.lit("already imported").alias("reason"), *zero)
    share = (time.time() - began) / max(candidates.count(), 1)
    return done.unionByName(failed).unionByName(known).withColumns(
        {"seconds": F.lit(share), "at": F.current_timestamp()})


def _commit(store, run, at, good, counts, schema, changes, outcomes, options) -> None:
    """Ledgers first, the commit last: until then no reader sees anything of the run, and if it is refused, none ever does."""
    versions = schema.select("table_name", "version").distinct()
    logged = good.join(counts, ["table_name", "source_file"], "left").withColumn(
        "row_count", F.coalesce("row_count", F.lit(0))).join(versions, "table_name", "left")
    if not options.keep_empty:
        logged = logged.filter("row_count > 0")
    entries = {
        "imports": logged.select(
            F.xxhash64("table_name", "source_file", "file_sha256").alias("id"), "table_name", "source_file", "file_sha256",
            "row_count", F.current_timestamp().alias("imported_at"), F.col("folder").alias("folder_path"),
            F.col("version").alias("schema_version"), "length", "modified"),
        "changes": changes,
        "columns": schema.filter("moved"),
        "outcomes": outcomes,
    }
    append = inheritable_thread_target(store.spark)(lambda name: store.append_ledger(name, run, entries[name]))
    with ThreadPoolExecutor(len(entries)) as pool:
        list(pool.map(append, entries))
    store.commit(run, at, [r[0] for r in versions.select("table_name").collect()])
