"""CSV and JSON scans. Files with the same header are read by one native scan."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folderloom.functions.names import as_column
from folderloom.operators.columns import clean_headers, flatten_structs, merge_columns
from folderloom.sources.files import glob_escaped, metadata_path, relative_path

SOURCE = "_source_file"
# Quotes inside quoted cells are doubled, read and written.
CSV_OPTIONS = {"header": "true", "escape": '"'}


def parse_header(text: str) -> list[str]:
    """Cells of a header record; empty ones are ``col_<position>``."""
    cells = next(csv.reader(io.StringIO(text)), [])
    return [c if c else f"col_{i}" for i, c in enumerate(cells)]


def read_csv_group(spark: SparkSession, root: str, paths: list[str], width: int, multiline: bool = False) -> DataFrame:
    """Files of one header width, all columns as text by position, with their relative path. Only files
    with line ends inside quotes are read unsplit."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    reader = spark.read.schema(schema).options(**CSV_OPTIONS).option("enforceSchema", True)
    raw = reader.option("multiLine", multiline).csv([glob_escaped(p) for p in paths])
    return raw.select(relative_path(metadata_path(), root).alias(SOURCE), *raw.columns)


@dataclass
class CsvGroup:
    """Files of one table that share a header, its clean form and the width of their widest record."""

    table: str
    header_text: str
    clean: list[str]
    multiline: bool
    width: int
    paths: list[str]


def csv_groups(spark: SparkSession, files: DataFrame, dialect: str = "current", duplicates: str = "merge") -> list[CsvGroup]:
    """The groups of the listed files.

    Headers and paths come to the driver, as they do for the scan's own file index; data does not. Cells beyond the
    header are ``extra_col_<position>``.
    """
    found: dict[tuple[str, str, bool, int], list[str]] = {}
    for r in files.filter("header_text <> ''").select("table_name", "header_text", "multiline", "width", "path").toLocalIterator():
        found.setdefault((r.table_name, r.header_text, bool(r.multiline), r.width), []).append(r.path)
    headers = [parse_header(text) for _, text, _, _ in found]
    padded = [h + [f"extra_col_{i}" for i in range(len(h), key[3])] for h, key in zip(headers, found, strict=True)]
    cleaned = clean_headers(spark, padded, dialect, duplicates)
    return [CsvGroup(table, text, clean, broken, width, paths)
            for ((table, text, broken, width), paths), clean in zip(found.items(), cleaned, strict=True)]


def csv_frame(spark: SparkSession, root: str, group: CsvGroup) -> DataFrame:
    """``_source_file`` and the clean columns of one group; equal names merge."""
    raw = read_csv_group(spark, root, group.paths, len(group.clean), group.multiline)
    return merge_columns(raw, [SOURCE, *group.clean])


def read_json(spark: SparkSession, root: str, paths: list[str], lines: bool = False) -> DataFrame:
    """JSON documents, scalars as text, nested objects as dotted columns, arrays left as JSON text."""
    raw = spark.read.option("multiLine", not lines).option("primitivesAsString", True).json(
        [glob_escaped(p) for p in paths])
    named = raw.select(relative_path(metadata_path(), root).alias(SOURCE), *[F.col(f"`{c}`") for c in raw.columns])
    flat = flatten_structs(named)
    return flat.select(*[
        F.col(f"`{f.name}`") if f.dataType == T.StringType() else F.to_json(f"`{f.name}`").alias(f.name)
        for f in flat.schema.fields
    ])


CORRUPT = "_corrupt_record"


def json_frame(spark: SparkSession, root: str, paths: list[str], dialect: str = "current", duplicates: str = "merge",
               lines: bool = False) -> tuple[DataFrame, list[str], DataFrame | None]:
    """(frame, clean column names, broken files) of the JSON documents of one table.

    Broken rows are left out of the frame; with ``lines`` the good rows of a broken file are still in it.
    """
    flat, broken = read_json(spark, root, paths, lines), None
    data = [c for c in flat.columns if c not in (SOURCE, CORRUPT)]
    if CORRUPT in flat.columns and not data:
        return flat.drop(CORRUPT), [], spark.createDataFrame([(p,) for p in paths], "path string").select(
            relative_path("path", root).alias(SOURCE))
    if CORRUPT in flat.columns:
        # The reader refuses to scan the corrupt column alone, so a data column is counted as well.
        broken = flat.groupBy(SOURCE).agg(F.count(CORRUPT).alias("_bad"), F.count(F.col(f"`{data[0]}`")).alias("_n"))
        broken = broken.filter("_bad > 0 AND _n >= 0").select(SOURCE)
        flat = flat.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    merged = merge_columns(flat, [SOURCE, *clean_headers(spark, [data], dialect, duplicates)[0]])
    return merged, merged.columns[1:], broken


def write_csv(df: DataFrame, path: str) -> None:
    """One dataset as CSV with a header."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


RECORD = "_record"


def below(root: str, relative: Column | str) -> Column:
    """Full name of a file: its root, which may be the file itself, and its place below it."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.nullif(as_column(relative), F.lit("")))


def read_declared(spark: SparkSession, root: str, files: DataFrame, schema: T.StructType) -> DataFrame:
    """Bulk read of scanned CSV files under a declared schema: its columns, ``source_file``, and the whole ``RECORD`` where a
    cell does not fit its type or the number of cells is another. Files with line ends inside quotes are read unsplit."""
    held: dict[bool, list[str]] = {}
    for r in files.select("path", "multiline").toLocalIterator():
        held.setdefault(bool(r.multiline), []).append(glob_escaped(r.path))
    wanted = T.StructType([*schema.fields, T.StructField(RECORD, T.StringType())])
    # Without column pruning every scan parses all cells, so rows and rejects agree on which records are broken.
    reader = spark.read.schema(wanted).options(**CSV_OPTIONS, columnNameOfCorruptRecord=RECORD, columnPruning=False)
    frames = [reader.option("multiLine", multiline).csv(paths) for multiline, paths in held.items()]
    return reduce(DataFrame.unionByName, [
        f.select(*schema.names, below(root, relative_path(metadata_path(), root)).alias("source_file"), RECORD) for f in frames])
