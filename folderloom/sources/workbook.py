"""Distributed decode of ``.xlsx``/``.xlsm`` workbooks and of ZIP archives that hold them.

A sheet cannot be split, so a workbook is decoded in one task, streamed row by row and handed back
in blocks of rows. Header cleaning, merging and typing follow in the JVM.
"""

from __future__ import annotations

import io
import re
import zipfile
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from itertools import chain, islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folderloom.functions import names
from folderloom.sources.files import WORKBOOK_EXTENSIONS, listed_in_bulk

BLOCK_ROWS = 500
# Renames are round trips to the file system; so many are under way at a time.
RENAMES_AT_ONCE = 16
SEPARATOR = b"\n"
BLOCKS = ("source_file string, sheet string, first_row bigint, header array<string>, rows array<array<string>>, "
          "error string")
# Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out: list[str] = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if _local(node.tag) == "si":
                out.append(_text_of(node))
                node.clear()
    return out


def _text_of(node) -> str:
    """Visible text of a string item, phonetic hints left out."""
    if _local(node.tag) == "rPh":
        return ""
    own = node.text or "" if _local(node.tag) == "t" else ""
    return own + "".join(_text_of(child) for child in node)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dated = set(DATE_FORMATS)
    for node in root.iter():
        if _local(node.tag) == "numFmt":
            shown = re.sub(r'"[^"]*"|\[(?!h|m|s)[^\]]*\]|\\.|_.', "", node.get("formatCode", "").lower())
            if re.search("[dmyhs]", shown.replace("general", "")):
                dated.add(int(node.get("numFmtId")))
    cell_formats = next((n for n in root if _local(n.tag) == "cellXfs"), ())
    return {i for i, xf in enumerate(cell_formats) if int(xf.get("numFmtId", 0)) in dated}


def _sheets(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """(sheet name, part name) in workbook order, and whether dates count from 1904."""
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in rels}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    out, from_1904 = [], False
    for node in root.iter():
        if _local(node.tag) == "workbookPr":
            from_1904 = node.get("date1904") in ("1", "true")
        elif _local(node.tag) == "sheet":
            rid = next(v for k, v in node.attrib.items() if _local(k) == "id")
            target = targets[rid]
            out.append((node.get("name"), target.lstrip("/") if target.startswith("/") else "xl/" + target))
    return [s for s in out if "worksheets/" in s[1]], from_1904


def _date_text(serial: float, from_1904: bool) -> str:
    if 0 <= serial < 1:
        return str((datetime(1900, 1, 1) + timedelta(seconds=round(serial * 86400))).time())
    if from_1904:
        start = datetime(1904, 1, 1)
    else:
        # Day 60 of the 1900 calendar does not exist; earlier days count from a day later.
        start = datetime(1899, 12, 31) if serial < 60 else datetime(1899, 12, 30)
    moment = start + timedelta(seconds=round(serial * 86400))
    return moment.strftime("%Y-%m-%d" if moment.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


def _cell_text(cell, strings: list[str], dated: set[int], from_1904: bool) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return next((_text_of(n) for n in cell if _local(n.tag) == "is"), None)
    raw = next((n.text for n in cell if _local(n.tag) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return "true" if raw.strip() == "1" else "false"
    if kind != "n":
        return raw
    if int(cell.get("s", 0)) in dated:
        return _date_text(float(raw), from_1904)
    return repr(float(raw)) if re.search("[.eE]", raw) else raw


class _Locals(dict):
    """Local name of each tag, cut out once: a sheet has few tags and an element or two per cell."""

    def __missing__(self, tag: str) -> str:
        self[tag] = _local(tag)
        return self[tag]


def _events(stream):
    """Lists of the parse events of ``stream``; of a broken one, those before the fault come before it is raised."""
    parser = ElementTree.XMLPullParser(("start", "end"))
    while True:
        part = stream.read(1 << 14)
        if part:
            parser.feed(part)
        found, fault = [], None
        try:
            if not part:
                parser.close()
            found.extend(parser.read_events())
        except ElementTree.ParseError as e:
            fault = e
        yield found
        if fault:
            raise fault
        if not part:
            return


def _sheet_rows(stream, strings, dated, from_1904):
    """(row number, cells) of the rows a sheet holds, streamed."""
    row_no, holder, local = 0, None, _Locals()
    for event, node in chain.from_iterable(_events(stream)):
        name = local[node.tag]
        if event == "start":
            holder = node if name == "sheetData" else holder
            continue
        if name != "row":
            continue
        row_no = int(node.get("r", row_no + 1))
        cells: list[str | None] = []
        for cell in node:
            ref = cell.get("r")
            if ref:
                cells.extend([None] * (_column_index(ref) - len(cells)))
            kind, only = cell.get("t", "n"), cell[0] if len(cell) == 1 else None
            # Plain numbers and plain inline texts take a short way.
            if only is not None and kind == "n" and local[only.tag] == "v" and not dated and only.text is not None:
                raw = only.text
                cells.append(repr(float(raw)) if "." in raw or "e" in raw or "E" in raw else raw)
            elif only is not None and kind == "inlineStr" and local[only.tag] == "is" and len(only) == 1 and (
                    local[only[0].tag] == "t" and not len(only[0])):
                cells.append(only[0].text or "")
            else:
                cells.append(_cell_text(cell, strings, dated, from_1904))
        yield row_no, cells
        holder.remove(node)


def _blocks(source_file: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, dated = _shared_strings(book), _date_styles(book)
        sheets, from_1904 = _sheets(book)
        for sheet, part in sheets:
            header: list[str | None] = []
            block: list[list[str | None]] = []
            first, sent = 2, False
            with book.open(part) as stream:
                for row_no, cells in _sheet_rows(stream, strings, dated, from_1904):
                    if row_no == 1:
                        header = cells
                        continue
                    # Rows that the file leaves out are empty rows.
                    while first + len(block) < row_no:
                        block.append([])
                        if len(block) == BLOCK_ROWS:
                            yield source_file, sheet, first, header, block, None
                            first, block, sent = first + BLOCK_ROWS, [], True
                    block.append(cells)
                    if len(block) == BLOCK_ROWS:
                        yield source_file, sheet, first, header, block, None
                        first, block, sent = first + BLOCK_ROWS, [], True
            if block or not sent:
                yield source_file, sheet, first, header, block, None


def _decode(batches):
    types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.string()]
    schema = pa.schema(list(zip(("source_file", "sheet", "first_row", "header", "rows", "error"), types, strict=True)))
    one = lambda values: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], schema=schema)
    for batch in batches:
        for source_file, content in zip(batch.column("source_file").to_pylist(), batch.column("content"), strict=True):
            try:
                for block in _blocks(source_file, content.as_py()):
                    yield one(block)
            except Exception as e:  # noqa: BLE001 - a broken file is reported, the run goes on
                yield one((source_file, None, None, None, None, f"{type(e).__name__}: {e}"))


def decode_workbooks(contents: DataFrame) -> DataFrame:
    """Blocks of rows of (source_file, content); an unreadable file gives one row with its error.

    Every sheet gives at least one block, so that empty sheets are seen as well.
    """
    return contents.select("source_file", "content").mapInArrow(_decode, BLOCKS)


def _members(batches):
    for batch in batches:
        for source_file, content in zip(batch["source_file"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                    for member in archive.namelist():
                        if member.endswith(WORKBOOK_EXTENSIONS):
                            yield pd.DataFrame([(source_file, member, archive.read(member), None)],
                                               columns=["archive", "member", "content", "error"])
            except Exception as e:  # noqa: BLE001
                yield pd.DataFrame([(source_file, None, None, f"{type(e).__name__}: {e}")],
                                   columns=["archive", "member", "content", "error"])


def archive_members(contents: DataFrame) -> DataFrame:
    """(archive, member, content, error) of the workbooks in ZIP archives."""
    return contents.select("source_file", "content").mapInPandas(
        _members, "archive string, member string, content binary, error string")


def suggested_table(archive_name: Column | str) -> Column:
    """Table name for an archive: its name without ``.zip``, cleaned."""
    return names.clean_identifier(F.replace(names.base_name(archive_name), F.lit(".zip"), F.lit("")), "upload")


def sheet_catalogue(blocks: DataFrame) -> DataFrame:
    return blocks.filter("sheet IS NOT NULL").select("source_file", "sheet").distinct()


def named_blocks(blocks: DataFrame, dialect: str = "current", duplicates: str = "merge") -> DataFrame:
    """Blocks with clean header ``names``. Empty header cells are ``col_<position>``; cells beyond the
    header are ``extra_col_<position>``."""
    filled = F.transform("header", lambda h, i: F.coalesce(h, F.concat(F.lit("col_"), i.cast("string"))))
    width = F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0))
    cleaned = names.clean_header_cells("filled", dialect)
    if duplicates == "suffix":
        cleaned = names.suffix_duplicates(cleaned)
    padded = blocks.withColumn("filled", names.pad_header(filled, width))
    return padded.withColumn("names", cleaned).drop("filled")


def _places(name: str) -> Column:
    """Positions of a clean name in a block's header."""
    return F.filter(F.transform("names", lambda n, i: F.when(n == name, i)), lambda i: i.isNotNull())


def wide_rows(blocks: DataFrame, wanted: list[str]) -> DataFrame:
    """(source_file, sheet, row_no, *wanted) as text; cells under the same name merge to the first non-null.

    Where a name sits is worked out once per block, before its rows are laid out.
    """
    at = {c: f"_at{i}" for i, c in enumerate(wanted)}
    placed = blocks.select("source_file", "sheet", "first_row", "rows", *[
        _places(c).alias(a) for c, a in at.items()])
    rows = placed.select("source_file", "sheet", "first_row", *at.values(), F.posexplode("rows").alias("_i", "_cells"))
    pick = lambda a: F.get(F.filter(F.transform(a, lambda i: F.get("_cells", i)), lambda v: v.isNotNull()), F.lit(0))
    return rows.select("source_file", "sheet", (F.col("first_row") + F.col("_i")).alias("row_no"),
                       *[pick(a).alias(c) for c, a in at.items()])


def sheet_profile(blocks: DataFrame) -> DataFrame:
    """(source_file, sheet, row_count, columns) of every sheet."""
    named = named_blocks(blocks.filter("sheet IS NOT NULL"), "suffix", "suffix")
    return named.groupBy("source_file", "sheet").agg(
        F.max(F.when(F.size("rows") > 0, F.col("first_row") + F.size("rows") - 2).otherwise(0)).alias("row_count"),
        F.min_by("names", "first_row").alias("columns"),
    )


def file_info(files: DataFrame, blocks: DataFrame, sheet: str) -> DataFrame:
    """(source_file, length, sheet_exists, row_count, columns) of every listed file for one sheet."""
    profile = sheet_profile(blocks).filter(F.col("sheet") == sheet)
    return files.select("source_file", "length").join(profile, "source_file", "left").select(
        "source_file", "length", F.col("sheet").isNotNull().alias("sheet_exists"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))


_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                           '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                           '<Default Extension="xml" ContentType="application/xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type='
                   '"http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
}
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'


def workbook_bytes(sheets: dict[str, list[list]], comment: bytes = b"") -> bytes:
    """A plain ``.xlsx`` of rows of cells per sheet, the first row being the header; rows may differ in length."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _PARTS.items():
            book.writestr(name, text)
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="s{i}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                                    f"{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">{"".join(map(_cell, cells))}</row>' for r, cells in enumerate(rows, 1))
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
        book.comment = comment
    return out.getvalue()


def write_workbooks(books: DataFrame, root: str) -> None:
    """Write rows (folder, name, content) as ``root``/folder/name through Spark's text writer.

    A record of that writer ends with a line separator; content has it as the comment that closes a ZIP file, made by
    ``workbook_bytes(..., comment=SEPARATOR)`` and cut off here. Spark commits the files, then each is given its name. A workbook
    has a folder of its own until then, so these are listed, fetched and renamed many at a time.
    """
    spark = books.sparkSession
    cut = F.expr(f"substring(content, 1, length(content) - {len(SEPARATOR)})")
    books.select("folder", "name", cut.cast("string").alias("value")).write.partitionBy("folder", "name").option(
        "lineSep", SEPARATOR.decode()).option("maxRecordsPerFile", 1).text(f"{root}/_written")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system, made = path(root).getFileSystem(spark._jsc.hadoopConfiguration()), set()
    with listed_in_bulk(spark):
        written = spark.read.format("binaryFile").load(f"{root}/_written")

    def rename(r) -> None:
        if not system.rename(path(r.path), path(f"{root}/{r.folder}/{r.name}")):
            raise OSError(f"{r.folder}/{r.name} cannot be written")

    with ThreadPoolExecutor(RENAMES_AT_ONCE) as pool:
        # A job per partition is run here, and a scan makes one for every few files.
        rows = written.select("path", "folder", "name").coalesce(spark.sparkContext.defaultParallelism).toLocalIterator()
        while some := list(islice(rows, RENAMES_AT_ONCE * 100)):
            for folder in {r.folder for r in some} - made:
                system.mkdirs(path(f"{root}/{folder}"))
                made.add(folder)
            list(pool.map(rename, some))
    system.delete(path(f"{root}/_written"), True)
