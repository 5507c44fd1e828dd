"""Listing, hashing and decoding of generated files."""

from __future__ import annotations

import hashlib
import io
import zipfile

from conftest import workbook_bytes

from folderloom.sources import delimited, files, workbook


def contents(spark, *named):
    return spark.createDataFrame([(n, bytearray(c)) for n, c in named], "source_file string, content binary")


def test_listing(spark, tmp_path, put, make_workbook):
    root = tmp_path / "r"
    for name in ("folder_a/file1.xlsx", "folder_b/nested/file2.XLSX", "folder_b/x [1].xlsm", "in_root.xlsx"):
        make_workbook(root / name, {"Sheet1": [["a"], [1]]})
    put(root / "folder_a" / "not_excel.txt", "x")
    put(root / "folder_a" / "config.json", "{}")
    put(root / "folder_a" / "data.json", "{}")
    listed = files.list_files(spark, str(root))
    assert sorted(r.source_file for r in listed.collect()) == ["folder_a/file1.xlsx", "folder_b/nested/file2.XLSX", "folder_b/x [1].xlsm"]
    assert sorted(r[0] for r in files.folders(listed).collect()) == ["folder_a", "folder_b", "folder_b/nested"]
    only_deep = listed.filter("folder = 'folder_b/nested'")
    assert sorted(r[0] for r in files.folders(only_deep, with_parents=True).collect()) == ["folder_b", "folder_b/nested"]
    assert [r.name for r in files.folder_files(listed, "folder_b").collect()] == ["x [1].xlsm"]
    assert files.list_files(spark, str(root), in_root=True).count() == 4
    wide = files.list_files(spark, str(root), files.DATA_EXTENSIONS)
    assert "folder_a/data.json" in {r.source_file for r in wide.collect()} and wide.count() == 4
    assert files.list_files(spark, str(tmp_path / "missing")).count() == 0
    assert files.scan_files(spark, str(tmp_path / "missing")).count() == 0


def test_hashes_of_small_and_large_files(spark, tmp_path, put):
    put(tmp_path / "r" / "t" / "a.csv", '"x\ny",z\n1,2\n')
    put(tmp_path / "r" / "t" / "b.csv", "x\n" + "1\n" * 3_000_000)
    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "r" / "t").iterdir()}
    got = files.scan_files(spark, str(tmp_path / "r"), (".csv",)).collect()
    assert {r.name: r.file_sha256 for r in got} == want
    assert {r.name: r.header_text for r in got} == {"a.csv": '"x\ny",z', "b.csv": "x"}
    assert {r.name: r.multiline for r in got} == {"a.csv": True, "b.csv": False}


def test_validation(spark, tmp_path, put, make_workbook):
    make_workbook(tmp_path / "r" / "t" / "good.xlsx", {"Sheet1": [["a"]]})
    put(tmp_path / "r" / "t" / "bad.xlsx", "text")
    (tmp_path / "r" / "t" / "mislabelled.xlsx").write_bytes(bytes.fromhex("D0CF11E0") + b"0")
    got = files.validate(files.scan_files(spark, str(tmp_path / "r"))).collect()
    assert {r.source_file: r.error for r in got} == {
        "t/good.xlsx": None, "t/bad.xlsx": "not a workbook", "t/mislabelled.xlsx": "legacy workbook format has no decoder"}


def cells(spark, book: bytes):
    blocks = workbook.decode_workbooks(contents(spark, ("f", book))).collect()
    return [(b.sheet, b.header, b.rows) for b in blocks]


def test_cell_kinds(spark):
    book = workbook_bytes({"S": [
        ["text", "int", "float", "bool", "date", "moment", "error", "shared", "formula"],
        ["a<b&c", 30, 9.99, True, ("date", 45296), ("custom", 45296.4375), ("error", "#N/A"), ("shared", 1), ("formula", "2")],
        ["", 10**12, 1e-05, False, ("date", 59), ("date", 0.5), None, ("shared", 0)],
    ]}, shared=["s0", "s1"])
    [(sheet, header, rows)] = cells(spark, book)
    assert sheet == "S" and header[0] == "text"
    assert rows[0] == ["a<b&c", "30", "9.99", "true", "2024-01-05", "2024-01-05 10:30:00", "#N/A", "s1", "2"]
    assert rows[1] == ["", "1000000000000", "1e-05", "false", "1900-02-28", "12:00:00", None, "s0"]
    assert cells(spark, workbook_bytes({"S": [["d"], [("date", 1)]]}, date1904=True))[0][2] == [["1904-01-02"]]


def test_skipped_rows_and_blocks(spark):
    sheet = [["n"], [1], None, None, [4], *[[i] for i in range(1200)]]
    blocks = workbook.decode_workbooks(contents(spark, ("f", workbook_bytes({"S": sheet}))))
    named = workbook.named_blocks(blocks)
    got = sorted((r.row_no, r.n) for r in workbook.wide_rows(named, ["n"]).collect())
    assert [g[0] for g in got] == list(range(2, 1206))
    assert [g[1] for g in got][:4] == ["1", None, None, "4"] and got[-1] == (1205, "1199")


def test_ragged_rows_and_names(spark):
    book = workbook_bytes({"S": [["A", None, "a"], [None, "x", "second", "extra"], ["first", "y"]], "Empty": []})
    named = workbook.named_blocks(workbook.decode_workbooks(contents(spark, ("f", book))))
    assert sorted((r.sheet, r.names) for r in named.collect()) == [("Empty", []), ("S", ["a", "col_1", "a", "extra_col_3"])]
    got = workbook.wide_rows(named.filter("sheet = 'S'"), ["a", "col_1", "extra_col_3"]).orderBy("row_no").collect()
    assert [tuple(r)[2:] for r in got] == [(2, "second", "x", "extra"), (3, "first", "y", None)]
    profile = {r.sheet: (r.row_count, r.columns) for r in workbook.sheet_profile(
        workbook.decode_workbooks(contents(spark, ("f", book)))).collect()}
    listing = spark.createDataFrame([("f", 10), ("g", 20)], "source_file string, length bigint")
    info = workbook.file_info(listing, workbook.decode_workbooks(contents(spark, ("f", book))), "S").orderBy("source_file")
    assert [tuple(r)[:4] for r in info.collect()] == [("f", 10, True, 2), ("g", 20, False, 0)]
    assert profile == {"S": (2, ["a", "col_1", "a_1", "extra_col_3"]), "Empty": (0, [])}


def test_broken_workbook_is_reported(spark):
    got = workbook.decode_workbooks(contents(spark, ("bad", b"PK\x03\x04nope"), ("good", workbook_bytes({"S": [["a"]]})))).collect()
    assert {(r.source_file, r.sheet, r.error is None) for r in got} == {("bad", None, False), ("good", "S", True)}


def test_archives(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.xlsx", workbook_bytes({"S": [["a"]], "T": [["b"]]}))
        z.writestr("d/b.xlsm", workbook_bytes({"S": [["a"]]}))
        z.writestr("c.txt", "x")
    members = workbook.archive_members(contents(spark, ("up/My Data.zip", out.getvalue()), ("torn.zip", b"x")))
    assert sorted((r.archive, r.member) for r in members.collect() if r.member) == [("up/My Data.zip", "a.xlsx"), ("up/My Data.zip", "d/b.xlsm")]
    inner = members.filter("member IS NOT NULL").selectExpr("member AS source_file", "content")
    catalogue = workbook.sheet_catalogue(workbook.decode_workbooks(inner))
    assert sorted(r[0] for r in catalogue.select("sheet").distinct().collect()) == ["S", "T"]
    assert {r[0] for r in members.select(workbook.suggested_table("archive")).collect()} == {"my_data", "torn"}


def test_csv_sinks(spark, tmp_path):
    from folderloom.operators.inference import struct_type

    df = spark.createDataFrame([(1, 'a,"b"\\'), (2, None)], "id int, s string")
    delimited.write_csv(df, str(tmp_path / "out"))
    back = delimited.read_declared(spark, str(tmp_path / "out"), struct_type({"id": "INTEGER", "s": "TEXT"}))
    assert sorted(map(tuple, back.collect())) == [(1, 'a,"b"\\'), (2, None)]


def test_relative_paths(spark):
    from pyspark.sql import functions as F

    got = lambda path, root: spark.range(1).select(files.relative_path(F.lit(path), root)).head()[0]
    assert got("file:/data/x/data/f.csv", "/data") == got("file:/data/x/data/f.csv", "file:///data/") == "x/data/f.csv"
    assert got("s3a://bucket/in/t/f.csv", "s3a://bucket/in") == "t/f.csv"
    assert got("s3a://bucket/t/f.csv", "s3a://bucket/") == "t/f.csv"
    assert got("file:/home/me/in/t/in/f.csv", "in") == "t/in/f.csv"


def test_many_files_are_listed_in_bulk(spark, tmp_path, put):
    paths = [str(put(tmp_path / "r" / f"{k}.csv", f"{k}") or tmp_path / "r" / f"{k}.csv") for k in range(60)]
    context = spark.sparkContext
    context.setJobGroup("listing", "listing")
    found = files.binary_files(spark, paths)
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    context.setJobGroup("", "")
    assert max(tasks) <= 2 * context.defaultParallelism
    assert sorted(r.content.decode() for r in found.select("content").collect()) == sorted(map(str, range(60)))
