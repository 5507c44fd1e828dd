"""Scans of listed files by format: text rows per table, with what could not be read."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folderloom.functions import names
from folderloom.operators import columns, sheets
from folderloom.operators.joins import broadcast_if_small
from folderloom.plans.staging import Stage
from folderloom.sources import delimited, files as file_source, workbook

SOURCE = delimited.SOURCE
PROBLEM = "source_file string, status string, reason string"


@dataclass
class Scan:
    """Text rows of one table: ``_source_file`` and clean columns."""

    table: str
    frame: DataFrame
    columns: list[str]


@dataclass
class ScanSet:
    """``assigned`` is (table_name, source_file) of the files read, ``problems`` those that are not.
    ``headers`` is (table_name, source_file, column_name), or None where a column is present only by
    its values."""

    scans: list[Scan]
    assigned: DataFrame
    problems: DataFrame
    headers: DataFrame | None


def union(frames: list[DataFrame], spark: SparkSession, empty: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], empty)


def problem(rows: DataFrame, status: str, reason: Column | str) -> DataFrame:
    text = F.lit(reason) if isinstance(reason, str) else reason
    return rows.select("source_file", F.lit(status).alias("status"), text.alias("reason"))


def scan_csv(spark: SparkSession, root: str, candidates: DataFrame, options, stage: Stage) -> ScanSet:
    groups = delimited.csv_groups(spark, candidates, options.dialect, options.duplicates)
    scans = []
    for group in groups:
        frame = delimited.csv_frame(spark, root, group)
        if options.drop_empty:
            frame = columns.drop_empty_rows(frame, frame.columns[1:])
        scans.append(Scan(group.table, frame, frame.columns[1:]))
    texts = spark.createDataFrame([(g.table, g.header_text, g.width, g.clean) for g in groups],
                                  "table_name string, header_text string, width int, names array<string>")
    headers = candidates.join(texts.distinct(), ["table_name", "header_text", "width"]).select(
        "table_name", "source_file", F.explode(F.array_distinct("names")).alias("column_name"))
    empty = problem(candidates.filter("header_text = ''"), "skipped", "Empty data")
    assigned = candidates.filter("header_text <> ''").select("table_name", "source_file")
    return ScanSet(scans, assigned, empty.unionByName(_unread(candidates)), headers)


def _unread(candidates: DataFrame) -> DataFrame:
    reason = f"cannot be read: a line of over {file_source.LINE_BYTES} bytes, or changed while it was read"
    return problem(candidates.filter("signature = 'unread'"), "error", reason)


def scan_json(spark: SparkSession, root: str, candidates: DataFrame, options, stage: Stage) -> ScanSet:
    paths: dict[str, list[str]] = {}
    readable = candidates.filter("signature <> 'unread'")
    for r in readable.select("table_name", "path").toLocalIterator():
        paths.setdefault(r.table_name, []).append(r.path)
    scans, broken = [], []
    for table in sorted(paths):
        frame, found, bad = delimited.json_frame(
            spark, root, paths[table], options.dialect, options.duplicates, options.json_lines)
        if bad is not None:
            bad = stage.keep(bad, f"broken_{len(broken)}")
            broken.append(problem(bad.withColumnRenamed(SOURCE, "source_file"), "error", "not valid JSON"))
            if options.json_lines and found:
                # Good rows may share a file with a broken line; the file is refused whole.
                frame = frame.join(broadcast_if_small(bad), SOURCE, "left_anti")
        if found:
            scans.append(Scan(table, frame, found))
    problems = union(broken, spark, PROBLEM).unionByName(_unread(candidates))
    return ScanSet(scans, readable.select("table_name", "source_file"), problems, None)


def scan_workbooks(spark: SparkSession, root: str, candidates: DataFrame, options, stage: Stage) -> ScanSet:
    readable = candidates.filter("signature <> 'unread'")
    held = readable.filter(F.col("length") <= options.whole_row_bytes)
    paths = [r[0] for r in held.filter("signature = 'workbook'").select("path").toLocalIterator()]
    contents = spark.createDataFrame([], "source_file string, content binary")
    if paths:
        contents = file_source.binary_files(spark, [file_source.glob_escaped(p) for p in paths]).select(
            file_source.relative_path("path", root).alias("source_file"), "content")
    found = scan_contents(spark, contents, held, options, stage)
    found.problems = reduce(DataFrame.unionByName, [
        found.problems, _too_large(readable, options.whole_row_bytes), _unread(candidates)])
    return found


def _too_large(candidates: DataFrame, limit: int) -> DataFrame:
    """A workbook is decoded from one row; a larger one is refused by name, the run goes on."""
    reason = F.concat(F.lit("too large for one row: "), F.col("length").cast("string"), F.lit(" bytes"))
    return problem(candidates.filter(F.col("length") > limit), "error", reason)


def archive_listing(members: DataFrame) -> DataFrame:
    """Members of ZIP archives as a file listing; an unreadable archive stands for itself."""
    return members.select(
        F.concat_ws("/", "archive", "member").alias("path"),
        F.concat_ws("/", "archive", "member").alias("source_file"),
        F.col("archive").alias("folder"),
        F.coalesce(names.base_name("member"), "archive").alias("name"),
        F.lower(F.regexp_extract(F.coalesce("member", "archive"), r"(\.[^./]+)$", 1)).alias("extension"),
        F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("length"),
        F.lit(None).cast("timestamp").alias("modified"),
        F.coalesce(F.sha2("content", 256), F.lit("")).alias("file_sha256"),
        F.coalesce(file_source.signature("content"), F.lit("unknown")).alias("signature"),
        F.lit(None).cast("string").alias("header_text"),
        F.lit(None).cast("boolean").alias("multiline"),
        F.lit(None).cast("int").alias("width"),
        workbook.suggested_table("archive").alias("table_name"),
    )


def scan_contents(spark: SparkSession, contents: DataFrame, candidates: DataFrame, options, stage: Stage) -> ScanSet:
    """Workbook contents to text rows.

    Decoded blocks are staged, so a workbook is parsed once for inference and append. The blocks of the sheets in use are then
    staged by table: however many tables there are, each reads its own part and the blocks are read a fixed number of times.
    """
    refused = problem(file_source.validate(candidates).filter("NOT ok"), "error", F.col("error"))
    decoded = workbook.decode_workbooks(contents)
    blocks = stage.keep(workbook.named_blocks(decoded, options.dialect, options.duplicates), "blocks")
    broken = problem(blocks.filter("error IS NOT NULL"), "error", F.col("error"))
    readable = blocks.filter("error IS NULL")
    catalogue = workbook.sheet_catalogue(readable)
    listed = candidates.select("source_file", "folder", "table_name")
    if options.all_sheets:
        chosen, missing = _every_sheet(listed, catalogue), spark.createDataFrame([], PROBLEM)
    else:
        chosen, missing = _one_sheet(listed, catalogue, options)
    chosen = stage.keep(chosen.select("source_file", "sheet", "table_name"), "sheets")
    used = stage.keep(readable.join(broadcast_if_small(chosen), ["source_file", "sheet"]).select(
        "table_name", "source_file", "sheet", "first_row", "header", "rows", "names"), "used", by=["table_name"])
    has_header = F.exists("header", lambda h: h.isNotNull())
    has_rows = F.exists("rows", lambda r: F.exists(r, lambda v: v.isNotNull()))
    # Staged, as it is used three times and has a row per file, where the rows of all files would be read again each time.
    held = stage.keep(used.groupBy("table_name", "source_file").agg(F.bool_or(has_header & has_rows).alias("_any")), "held")
    empty = problem(held.groupBy("source_file").agg(F.bool_or("_any").alias("_any")).filter("NOT _any"), "skipped", "Empty data")
    # Headers only: as many rows as files have columns.
    heads = stage.keep(used.filter(has_header).join(held.filter("_any"), ["table_name", "source_file"], "left_semi").select(
        "table_name", "source_file", F.posexplode("names").alias("i", "column_name")).distinct(), "heads")
    order = heads.groupBy("table_name", "column_name").agg(F.min("i").alias("i")).orderBy("table_name", "i", "column_name")
    by_table: dict[str, list[str]] = {}
    for r in order.collect():
        by_table.setdefault(r.table_name, []).append(r.column_name)
    scans = []
    for table, wanted in by_table.items():
        frame = workbook.wide_rows(used.filter(has_header & (F.col("table_name") == table)), wanted)
        if options.drop_empty:
            frame = columns.drop_empty_rows(frame, wanted)
        scans.append(Scan(table, frame.select(F.col("source_file").alias(SOURCE), *wanted), wanted))
    problems = reduce(DataFrame.unionByName, [refused, broken, missing, empty])
    assigned = held.filter("_any").select("table_name", "source_file")
    return ScanSet(scans, assigned, problems, heads.drop("i").distinct())


def _every_sheet(listed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """All sheets; a file with several feeds one table per sheet."""
    several = catalogue.groupBy("source_file").agg(F.count(F.lit(1)).alias("_sheets"))
    per_sheet = F.concat_ws("_", "table_name", names.clean_identifier("sheet", "legacy"))
    return catalogue.join(listed, "source_file").join(several, "source_file").withColumn(
        "table_name", F.when(F.col("_sheets") > 1, per_sheet).otherwise(F.col("table_name")))


def _one_sheet(listed: DataFrame, catalogue: DataFrame, options) -> tuple[DataFrame, DataFrame]:
    """The sheet configured for each folder; readable files without it are skipped."""
    resolved = sheets.resolve_sheets(listed, options.sheets, options.sheet_rule, options.default_sheet)
    chosen, absent = sheets.split_by_sheet(resolved.filter("sheet IS NOT NULL"), catalogue)
    unset = problem(resolved.filter("sheet IS NULL"), "skipped", "No sheet configured")
    read = catalogue.select("source_file").distinct()
    return chosen, unset.unionByName(problem(absent.join(read, "source_file", "left_semi"), "skipped", F.col("reason")))
