"""Parallel listing and hashing of files below a root folder."""

from __future__ import annotations

import hashlib
import re
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folderloom.functions import names
from folderloom.plans.staging import Stage

# Recognised extensions, configuration files that are never data, file signatures.
WORKBOOK_EXTENSIONS = (".xlsx", ".xls", ".xlsm", ".xlsb")
DATA_EXTENSIONS = (*WORKBOOK_EXTENSIONS, ".odf", ".ods", ".odt", ".csv", ".json")
CONFIG_FILES = ("config.json", "config.template.json")
ZIP_SIGNATURE, LEGACY_SIGNATURE = "504B0304", "D0CF11E0"
LARGE_FILE_BYTES = 100 * 1024 * 1024

# First record of a delimited file behind blank lines; line breaks inside quotes belong to it. The mark of UTF-8 may
# stand before it, decoded or, where bytes are taken for characters, not.
FIRST_RECORD = "^(?:\ufeff|\u00ef\u00bb\u00bf)?(?:[ \t]*+[\r\n])*+((?:[^\"\r\n]++|\"[^\"]*+\")*+)"
# One cell, quoted or not. Without its cells, a record is a row of commas.
CELL = '"(?:[^"]++|"")*+"|[^,\r\n]++'
# A file with a longer line is refused: Spark's readers hold a line as one row.
LINE_BYTES = 1 << 30
_MARK = b"\xef\xbb\xbf"
_LISTING = "path string, source_file string, folder string, name string, extension string, length bigint, modified timestamp"
_HASHES = "file_sha256 string, signature string, header_text string, multiline boolean, width int"


_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def plain_path(path: str) -> str:
    """Path without scheme and host, no slash at the end."""
    return re.sub("/+", "/", re.sub(_SCHEME, "", path)).rstrip("/")


def glob_escaped(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def relative_path(path: Column | str, root: str) -> Column:
    """What follows the root folder in a full path; of a relative root, its first place in the path."""
    base, plain = plain_path(root), F.regexp_replace(names.as_column(path), _SCHEME, "")
    start = F.lit(0) if base.startswith("/") or not base else F.instr(plain, F.lit(f"/{base}/"))
    return F.substr(plain, start + len(base) + 2)


def metadata_path() -> Column:
    """Plain path of the file a row was read from. The scan reports it URL-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def binary_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    with listed_in_bulk(spark):
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)


def _described(root: str) -> list[Column]:
    rel = relative_path("path", root)
    return [
        F.col("path"),
        rel.alias("source_file"),
        F.array_join(names.folder_parts(rel), "/").alias("folder"),
        names.base_name(rel).alias("name"),
        F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"),
        F.col("length"),
        F.col("modificationTime").alias("modified"),
    ]


def _chosen(listed: DataFrame, extensions, in_root: bool) -> DataFrame:
    kept = listed.filter(F.col("extension").isin(*extensions) & ~F.lower("name").isin(*CONFIG_FILES))
    return kept if in_root else kept.filter(F.col("folder") != "")


def described(found: DataFrame, root: str, extensions, in_root: bool = False) -> DataFrame:
    """The listing of binary file rows; their contents are not read."""
    return _chosen(found.select(*_described(root)), extensions, in_root)


def list_files(spark: SparkSession, root: str, extensions=WORKBOOK_EXTENSIONS, in_root: bool = False) -> DataFrame:
    """All files below ``root`` with one of the extensions, in any letter case.

    Files directly in the root belong to no table and are left out unless ``in_root``. A missing
    root gives no rows. Only names and sizes are read here, not contents.
    """
    try:
        raw = binary_files(spark, root)
    except AnalysisException:
        return spark.createDataFrame([], _LISTING)
    return described(raw, root, extensions, in_root)


def folders(files: DataFrame, with_parents: bool = False) -> DataFrame:
    """Distinct folders of a listing, with their ancestors if asked."""
    if not with_parents:
        return files.select("folder").distinct()
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.filter("folder <> ''").select(F.explode(up).alias("folder")).distinct()


def folder_files(files: DataFrame, folder: str) -> DataFrame:
    """Files directly in one folder, by path."""
    return files.filter(F.col("folder") == folder).orderBy("source_file")


def signature(content: Column | str) -> Column:
    """workbook, legacy or unknown, by the first bytes and not by the name."""
    first = F.hex(F.substring(names.as_column(content), 1, 4))
    return F.when(first == ZIP_SIGNATURE, "workbook").when(first == LEGACY_SIGNATURE, "legacy").otherwise("unknown")


def scan_files(spark: SparkSession, root: str, extensions=WORKBOOK_EXTENSIONS, in_root: bool = False,
               listed: DataFrame | None = None) -> DataFrame:
    """The listing with hash, kind, first record, quoted line ends and width of every file, in one pass over the contents.

    Files of every size go the same way: Spark's line reader hands each of them to one task, in order, and a task holds a few
    lines at a time. Any path that Spark opens will do. A file is ``unread`` where the lines that came do not make up its size:
    it changed under the scan, or one of its lines is longer than ``LINE_BYTES``.
    ``listed`` narrows the scan to some files of the listing, so that the contents of others are not read.
    """
    paths: str | list[str] = root
    if listed is not None:
        paths = [glob_escaped(r[0]) for r in listed.select("path").toLocalIterator()]
    else:
        listed = list_files(spark, root, extensions, in_root)
    sizes = listed.agg(F.max("length"), F.sum("length")).head()
    if not paths or sizes[0] is None:
        return spark.createDataFrame([], f"{_LISTING}, {_HASHES}")
    lines = spark.read.options(recursiveFileLookup=True, lineSep="\n", pathGlobFilter=_any_case(extensions)).option(
        "mapreduce.input.linerecordreader.line.maxlength", LINE_BYTES).text(paths)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
                         F.concat("value", F.lit("\n")).cast("binary").alias("line"))
    with _unsplit(spark, *sizes):
        facts = Stage(spark).keep(lines.mapInArrow(_facts, f"path string, {_HASHES}"), "facts")
    facts = facts.withColumn("source_file", relative_path(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), root)).drop("path")
    empty = F.col("length") == 0  # it has no line, so no row came
    digest = F.when(empty, hashlib.sha256().hexdigest()).otherwise(F.concat(F.lit("unread "), "path"))
    return listed.join(facts, "source_file", "left").select(
        *listed.columns, F.coalesce("file_sha256", digest).alias("file_sha256"),
        F.coalesce("signature", F.when(empty, "unknown").otherwise("unread")).alias("signature"),
        F.coalesce("header_text", F.when(empty & (F.col("extension") == ".csv"), "")).alias("header_text"), "multiline", "width")


def _any_case(extensions) -> str:
    """Glob of the extensions in any letter case."""
    return "*{%s}" % ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)


def _unsplit(spark: SparkSession, largest: int, total: int):
    """Scans planned inside read each file as one split: none is smaller than the largest file, and as many are made as that allows."""
    least = max(1, min(spark.sparkContext.defaultParallelism, total // max(largest, 1)))
    return _settings(spark, {"spark.sql.files.maxPartitionBytes": str(max(largest, 1 << 27)), "spark.sql.files.minPartitionNum": str(least)})


def listed_in_bulk(spark: SparkSession):
    """Files and folders that reads begun inside list go to the tasks in bulk; by itself Spark makes a task for each, up to 10,000."""
    return _settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(2 * spark.sparkContext.defaultParallelism)})


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _wide_lines(block: bytes, commas: int) -> list[bytes]:
    """The lines with more commas than that; the block ends with a line."""
    data = np.frombuffer(block, np.uint8)
    ends = np.flatnonzero(data == ord("\n"))
    held = np.diff(np.searchsorted(np.flatnonzero(data == ord(",")), ends), prepend=0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [block[starts[i]:ends[i]] for i in np.flatnonzero(held > commas)]


def _csv_facts(blocks):
    """(first record, quoted line ends, width) of a CSV, from blocks of its bytes; one record is held at a time."""
    header, split, width, commas, parts, odd, rest = None, False, 0, 0, [], False, b""

    def ended(line: bytes, last: bool = False) -> None:
        nonlocal header, split, width, commas, odd
        parts.append(line)
        odd ^= line.count(b'"') % 2 == 1
        split |= odd
        if odd and not last:
            return
        record = b"\n".join(parts)
        parts.clear()
        if header is None:
            record = record.removeprefix(b"\xef\xbb\xbf")
        if header is None and record.strip():
            header = re.match(FIRST_RECORD, record.decode("utf-8", "replace")).group(1)
            commas = re.sub(CELL, "", header).count(",")
        if record.count(b",") > max(commas, width - 1):
            cells = re.sub(CELL, "x", record.decode("ISO-8859-1")).rstrip(",")
            width = max(width, cells.count(",") + 1)

    for block in blocks:
        block = rest + block.replace(b"\r", b"\n")
        if header is not None and not odd and b'"' not in block:  # each line is a record: only wider ones are looked at
            cut = block.rfind(b"\n") + 1
            lines, rest = _wide_lines(block[:cut], max(commas, width - 1)) if cut else [], block[cut:]
        else:
            *lines, rest = block.split(b"\n")
        for line in lines:
            ended(line)
    ended(rest, last=True)
    return header or "", split, max(width, commas + 1)


def _stretches(batches):
    """(path, length, bytes) of lines in a row of one file, each with a line end, the last one too."""
    for batch in batches:
        line = batch.column("line").cast(pa.large_binary())
        offsets = np.frombuffer(line.buffers()[1], np.int64)[line.offset:line.offset + len(line) + 1]
        paths = batch.column("path").dictionary_encode()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(paths.indices.to_numpy())) + 1]) if len(line) else []
        for i, j in zip(starts, [*starts[1:], len(line)], strict=True):
            yield paths[i].as_py(), batch.column("length")[i].as_py(), line.buffers()[2][offsets[i]:offsets[j]].to_pybytes()


def _facts(batches):
    """One row per file. The reader leaves out a UTF-8 mark at the start and does not tell whether the last line has an end;
    both follow from the file's size."""
    kinds = {ZIP_SIGNATURE: "workbook", LEGACY_SIGNATURE: "legacy"}
    for (path, length), parts in groupby(_stretches(batches), key=lambda s: s[:2]):
        plain, marked, first, seen = hashlib.sha256(), hashlib.sha256(_MARK), b"", 0

        def blocks(parts=parts, length=length, plain=plain, marked=marked):
            nonlocal first, seen
            block = next(parts)[2]
            while block is not None:
                following = next(parts, (None, None, None))[2]
                seen += len(block)
                if following is None and seen - length in (1, 1 - len(_MARK)):  # the last line has no end
                    block, seen = block[:-1], seen - 1
                first = first if len(first) >= 4 else (first + block)[:4]
                plain.update(block)
                marked.update(block)
                yield block
                block = following

        read, header, split, width = blocks(), None, None, None
        if path.lower().endswith(".csv"):
            header, split, width = _csv_facts(read)
        for _ in read:
            pass
        if seen not in (length, length - len(_MARK)):
            continue
        kind = kinds.get(first.hex().upper(), "unknown") if seen == length else "unknown"
        digest = (plain if seen == length else marked).hexdigest()
        yield pa.RecordBatch.from_pylist(
            [dict(path=path, file_sha256=digest, signature=kind, header_text=header, multiline=split, width=width)],
            schema=pa.schema([(n, pa.bool_() if n == "multiline" else pa.int32() if n == "width" else pa.string())
                              for n in ("path", "file_sha256", "signature", "header_text", "multiline", "width")]))


def validate(files: DataFrame) -> DataFrame:
    """(source_file, ok, error, large) from hashed workbook listings; unreadable ones are flagged, none is lost."""
    ok = F.col("signature") == "workbook"
    error = F.when(F.col("signature") == "legacy", "legacy workbook format has no decoder").when(~ok, "not a workbook")
    return files.select("source_file", ok.alias("ok"), error.alias("error"),
                        (F.col("length") > LARGE_FILE_BYTES).alias("large"))
