"""Folder trees from file to table."""

from __future__ import annotations

import hashlib
import zipfile

import pytest
from conftest import workbook_bytes

from folderloom.plans.ingest import Options, ingest
from folderloom.plans.store import ConcurrentCommit, Store
from folderloom.sources import files as file_source


def rows(df, *order):
    return [tuple(r) for r in df.select(*order).orderBy(*order).collect()]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture
def evolving(tmp_path, make_workbook):
    root = tmp_path / "data"
    make_workbook(root / "test_folder" / "file1.xlsx", {"Sheet1": [["ID", "Name", "Value"], [1, "A", 10], [2, "B", 20]]})
    make_workbook(root / "test_folder" / "file2.xlsx",
                  {"Sheet1": [["ID", "Name", "Value", "Category"], [3, "C", 30, "x"], [4, "D", 40, "y"]]})
    return root


def test_evolving_workbooks(store, evolving, make_workbook):
    result = ingest(store, str(evolving))
    assert result.summary().head().asDict() == {"success": 2, "errors": 0, "skipped": 0, "success_rate": 100}
    table = store.read_table("test_folder")
    assert rows(table, "id", "name", "value", "category") == [
        (1, "A", 10, None), (2, "B", 20, None), (3, "C", 30, "x"), (4, "D", 40, "y")]
    assert store.table_columns("test_folder") == {"id": "INTEGER", "name": "TEXT", "value": "INTEGER", "category": "TEXT"}
    assert rows(store.changes(), "change_type", "column_name", "source_file") == [
        ("add_column", "category", "test_folder/file2.xlsx"), ("create_table", None, "test_folder/file1.xlsx")]
    assert rows(store.imports(), "source_file", "row_count") == [
        ("test_folder/file1.xlsx", 2), ("test_folder/file2.xlsx", 2)]
    # A second run adds nothing.
    again = ingest(store, str(evolving))
    assert rows(again.outcomes, "status", "reason") == [("skipped", "already imported")] * 2
    assert store.read_table("test_folder").count() == 4
    assert store.imports().count() == 2
    assert store.changes().count() == 2
    # A later one widens the rows that are there.
    make_workbook(evolving / "test_folder" / "file3.xlsx", {"Sheet1": [["ID", "Value"], [5, "n/a"], [6, "7"], [7, "many"]]})
    ingest(store, str(evolving))
    assert store.table_columns("test_folder")["value"] == "TEXT"
    assert rows(store.read_table("test_folder"), "id", "value") == [
        (1, "10"), (2, "20"), (3, "30"), (4, "40"), (5, "n/a"), (6, "7"), (7, "many")]
    assert rows(store.changes().filter("change_type = 'alter_type'"), "column_name", "old_type", "new_type") == [
        ("value", "INTEGER", "TEXT")]


def test_reverts(store, evolving, make_workbook):
    ingest(store, str(evolving))
    before = rows(store.read_table("test_folder"), "id", "name")
    plan = store.revert_plan("test_folder", source_file="test_folder/file1.xlsx")
    assert rows(plan, "source_file", "expected_rows", "found_rows") == [("test_folder/file1.xlsx", 2, 2)]
    report = store.revert("test_folder", source_file="test_folder/file1.xlsx", backup=True)
    assert rows(report, "source_file", "deleted_rows") == [("test_folder/file1.xlsx", 2)]
    assert rows(store.read_table("test_folder"), "id") == [(3,), (4,)]
    assert rows(store.backups(), "row_count", "reason") == [(2, "import_revert")]
    ingest(store, str(evolving))
    assert rows(store.read_table("test_folder"), "id", "name") == before
    # By hash only one version of a file goes.
    make_workbook(evolving / "test_folder" / "file1.xlsx", {"Sheet1": [["ID", "Name", "Value"], [9, "Z", 90]]})
    ingest(store, str(evolving))
    assert rows(store.read_table("test_folder"), "id") == [(1,), (2,), (3,), (4,), (9,)]
    old = store.imports().filter("source_file = 'test_folder/file1.xlsx' AND row_count = 2").head().file_sha256
    store.revert("test_folder", old)
    assert rows(store.read_table("test_folder"), "id") == [(3,), (4,), (9,)]


def test_schema_revert(store, evolving):
    ingest(store, str(evolving))
    plan = store.schema_revert_plan("test_folder", "test_folder/file2.xlsx")
    assert rows(plan, "action", "column_name") == [("drop_column", "category")]
    assert store.revert_schema("test_folder", "test_folder/file2.xlsx") == 1
    assert list(store.table_columns("test_folder")) == ["id", "name", "value"]
    assert rows(store.read_table("test_folder"), "id") == [(1,), (2,), (3,), (4,)]
    assert rows(store.changes(), "change_type") == [("create_table",)]
    assert rows(store.schema_revert_plan("test_folder", "test_folder/file1.xlsx"), "action", "manual_step") == [
        ("manual", "drop table test_folder")]


def test_sheets_by_folder(store, tmp_path, make_workbook):
    root = tmp_path / "data"
    make_workbook(root / "folder_a" / "file1.xlsx", {"Policies": [["Name", "Age", "City"], ["a", 30, "x"], ["b", 25, "y"], ["c", 1, "z"]]})
    make_workbook(root / "folder_a" / "file2.xlsx", {"Policies": [["Name", "Age", "Department", "Salary"], ["d", 30, "p", 5], ["e", 25, "q", 6]]})
    make_workbook(root / "folder_b" / "nested" / "f.xlsx", {"Other": [["Product"], ["W"]], "Claims": [["Product", "Price"], ["Widget", 9.99]]})
    make_workbook(root / "folder_c" / "f.xlsx", {"Elsewhere": [["x"], [1]]})
    result = ingest(store, str(root), sheets={"folder_a": {"sheet": "Policies"}, "Folder_B": {"nested": {"sheet": "Claims"}}})
    assert rows(result.outcomes, "source_file", "status", "reason") == [
        ("folder_a/file1.xlsx", "success", None), ("folder_a/file2.xlsx", "success", None),
        ("folder_b/nested/f.xlsx", "success", None), ("folder_c/f.xlsx", "skipped", "Sheet not found")]
    assert store.read_table("folder_a").count() == 5
    assert rows(store.read_table("folder_a"), "name", "city", "department", "salary")[-1] == ("e", None, "q", 6)
    assert rows(store.read_table("folder_b_nested"), "product", "price") == [("Widget", 9.99)]
    assert rows(store.status(), "table_name", "files", "total_rows") == [("folder_a", 2, 5), ("folder_b_nested", 1, 1)]


def test_broken_empty_and_legacy_files(store, tmp_path, make_workbook, put):
    root = tmp_path / "data"
    make_workbook(root / "t" / "good.xlsx", {"Sheet1": [["a"], [1]]})
    make_workbook(root / "t" / "empty.xlsx", {"Sheet1": [["a"]]})
    make_workbook(root / "t" / "headless.xlsx", {"Sheet1": [None, [1]]})
    put(root / "t" / "text.xlsx", "not a workbook")
    (root / "t" / "old.xls").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"0" * 64)
    (root / "t" / "torn.xlsx").write_bytes(b"PK\x03\x04" + b"0" * 64)
    result = ingest(store, str(root))
    got = {r.source_file: (r.status, r.reason) for r in result.outcomes.collect()}
    assert got["t/good.xlsx"] == ("success", None)
    assert got["t/empty.xlsx"] == got["t/headless.xlsx"] == ("skipped", "Empty data")
    assert got["t/text.xlsx"] == ("error", "not a workbook")
    assert got["t/old.xls"] == ("error", "legacy workbook format has no decoder")
    assert got["t/torn.xlsx"][0] == "error" and got["t/torn.xlsx"][1].startswith("BadZipFile")
    assert store.quarantine().count() == 3
    with pytest.raises(RuntimeError, match="t/"):
        ingest(store, str(root), on_error="abort")


def test_folder_is_held_back_whole(store, tmp_path, make_workbook, put):
    root = tmp_path / "data"
    make_workbook(root / "bad" / "good.xlsx", {"Sheet1": [["a"], [1]]})
    put(root / "bad" / "text.xlsx", "not a workbook")
    make_workbook(root / "fine" / "good.xlsx", {"Sheet1": [["a"], [2]]})
    result = ingest(store, str(root), atomic="folder")
    assert rows(result.outcomes, "source_file", "status") == [
        ("bad/good.xlsx", "skipped"), ("bad/text.xlsx", "error"), ("fine/good.xlsx", "success")]
    assert rows(store.tables(), "table_name") == [("fine",)]
    make_workbook(root / "bad" / "text.xlsx", {"Sheet1": [["a"], [3]]})
    ingest(store, str(root), atomic="folder")
    assert rows(store.read_table("bad"), "a") == [(1,), (3,)]


def test_dry_run_writes_nothing(store, evolving):
    plan = ingest(store, str(evolving), dry_run=True)
    assert rows(plan.outcomes, "source_file", "row_count") == [("test_folder/file1.xlsx", 2), ("test_folder/file2.xlsx", 2)]
    assert rows(plan.changes, "change_type", "column_name") == [("add_column", "category"), ("create_table", None)]
    assert not store.table_exists("test_folder") and store.imports().isEmpty()


def test_csv_with_differing_headers(store, tmp_path, put):
    root = tmp_path / "d ä+ta" / "in"
    put(root / "in" / "Sales Data" / "a [1].csv", "Id,Amount (€),Paid\n1,$1.50,yes\n2,2,no\n")
    put(root / "in" / "Sales Data" / "b+2.csv", "ID,id,Paid,When\n,3,Y,2024-01-05\n4,,N,2024-02-30\n,,,\n")
    put(root / "in" / "Sales Data" / "c.csv", "\n")
    result = ingest(store, str(root), "csv")
    assert rows(result.outcomes, "source_file", "status", "row_count") == [
        ("in/Sales Data/a [1].csv", "success", 2), ("in/Sales Data/b+2.csv", "success", 2), ("in/Sales Data/c.csv", "skipped", 0)]
    got = [tuple(str(v) for v in r) for r in rows(store.read_table("in_sales_data"), "id", "amount", "paid", "when", "source_file")]
    assert got == [("1", "1.5", "True", "None", "in/Sales Data/a [1].csv"), ("2", "2.0", "False", "None", "in/Sales Data/a [1].csv"),
                   ("3", "None", "True", "2024-01-05", "in/Sales Data/b+2.csv"), ("4", "None", "False", "None", "in/Sales Data/b+2.csv")]


def test_json_documents(store, tmp_path, put):
    root = tmp_path / "data"
    put(root / "j" / "a.json", '[{"id": 1, "who": {"Name": "x", "tags": [1, 2]}}, {"id": 2, "who": {"Name": "y"}}]')
    put(root / "j" / "b.json", '{"id": 3.5, "who": {"Name": "z"}, "ok": true}')
    put(root / "j" / "broken.json", '{"id": ')
    result = ingest(store, str(root), "json", dialect="suffix")
    assert rows(result.outcomes, "source_file", "status") == [
        ("j/a.json", "success"), ("j/b.json", "success"), ("j/broken.json", "error")]
    assert store.table_columns("j") == {"id": "DOUBLE PRECISION", "who_name": "TEXT", "who_tags": "JSONB", "ok": "BOOLEAN"}
    assert rows(store.read_table("j"), "id", "who_name", "who_tags", "ok") == [
        (1.0, "x", '["1","2"]', None), (2.0, "y", None, None), (3.5, "z", None, True)]


def test_archive_of_workbooks(store, tmp_path):
    root = tmp_path / "up"
    root.mkdir()
    with zipfile.ZipFile(root / "Müşteri Listesi.zip", "w") as z:
        z.writestr("file1.xlsx", workbook_bytes({"Policies": [["Name", "Age"], ["a", 1], ["b", 2]]}))
        z.writestr("in/file2.xlsx", workbook_bytes({"Policies": [["Name", "Salary"], ["c", 2.5]]}))
        z.writestr("in/file3.xlsx", workbook_bytes({"Other": [["Name"], ["c"]]}))
        z.writestr("readme.txt", "no")
    (root / "torn.zip").write_bytes(b"nothing")
    result = ingest(store, str(root), "archive", sheets={}, default_sheet="Policies", dialect="upload",
                    policy="ranked", inference="unanimous")
    assert rows(result.outcomes, "source_file", "status", "row_count") == [
        ("Müşteri Listesi.zip/file1.xlsx", "success", 2), ("Müşteri Listesi.zip/in/file2.xlsx", "success", 1),
        ("Müşteri Listesi.zip/in/file3.xlsx", "skipped", 0), ("torn.zip", "error", 0)]
    assert rows(store.read_table("musteri_listesi"), "name", "age", "salary") == [
        ("a", 1, None), ("b", 2, None), ("c", None, 2.5)]
    assert store.table_columns("musteri_listesi") == {"name": "TEXT", "age": "BIGINT", "salary": "DOUBLE PRECISION"}


def test_every_sheet_is_a_dataset(store, tmp_path, make_workbook):
    root = tmp_path / "data"
    make_workbook(root / "t" / "one.xlsx", {"Only": [["a"], [1]]})
    make_workbook(root / "t" / "two.xlsx", {"First Page": [["a"], [2]], "2nd": [["b"], [3]]})
    ingest(store, str(root), all_sheets=True)
    assert rows(store.tables(), "table_name") == [("t",), ("t_col_2nd",), ("t_first_page",)]
    assert rows(store.read_table("t_col_2nd"), "b", "source_file") == [(3, "t/two.xlsx")]
    assert rows(ingest(store, str(root), all_sheets=True).outcomes, "status") == [("skipped",), ("skipped",)]


def test_content_dedupe_sees_renamed_files(store, tmp_path, put):
    root = tmp_path / "data"
    put(root / "t" / "a.csv", "x\n1\n")
    put(root / "t" / "b.csv", "x\n1\n")
    ingest(store, str(root), "csv", dedupe="content")
    assert rows(store.imports(), "source_file") == [("t/a.csv",)]
    put(root / "t" / "c.csv", "x\n1\n")
    ingest(store, str(root), "csv", dedupe="content")
    assert store.read_table("t").count() == 1
    ingest(store, str(root), "csv")
    assert store.read_table("t").count() == 3


def test_hooks_overrides_whitelist_and_roots(store, tmp_path, put):
    from pyspark.sql import functions as F

    put(tmp_path / "r1" / "t" / "a.csv", "x,y\n1,2\n")
    put(tmp_path / "r1" / "t" / "skip.csv", "x,y\n5,6\n")
    put(tmp_path / "r2" / "u" / "a.csv", "x\n7\n")
    ingest(store, [str(tmp_path / "r1"), str(tmp_path / "r2")], "csv", only_files=["a.csv"], type_overrides={"x": "TEXT"},
           transforms=[lambda df: df.withColumn("twice", F.concat("x", "x"))])
    assert rows(store.read_table("t"), "x", "twice") == [("1", 11)]
    assert rows(store.tables(), "table_name") == [("t",), ("u",)]


def test_large_workbook(store, tmp_path, make_workbook):
    root = tmp_path / "data"
    make_workbook(root / "large_test" / "large_file.xlsx",
                  {"Sheet1": [["ID", "Value"], *[[i, f"value_{i}"] for i in range(15000)]]})
    ingest(store, str(root))
    table = store.read_table("large_test")
    assert table.count() == 15000
    assert table.selectExpr("sum(id) AS s", "count(DISTINCT value) AS n").head().asDict() == {"s": 15000 * 14999 // 2, "n": 15000}


def test_store_catalogue(store, evolving):
    ingest(store, str(evolving))
    assert store.table_exists("test_folder") and not store.table_exists("nope")
    assert rows(store.stats(), "table_name", "columns", "row_count") == [("test_folder", 4, 4)]
    assert store.create_table("made", {"a": "INTEGER", "b": "TEXT"}) and not store.create_table("made", {"a": "TEXT"})
    with pytest.raises(ValueError):
        store.create_table("made", {"a": "TEXT"}, if_exists="fail")
    with pytest.raises(ValueError):
        store.create_table("no table", {"a": "TEXT"})
    assert store.read_table("made").columns[:2] == ["a", "b"] and store.read_table("made").count() == 0
    got = store.sql("SELECT t.id FROM test_folder t JOIN etl_imports i USING (source_file) WHERE t.id > :n AND i.row_count = 2", {"n": 2})
    assert rows(got, "id") == [(3,), (4,)]
    with pytest.raises(ValueError):
        store.drop_tables()
    assert sorted(store.drop_tables(confirm=True)) == ["made", "test_folder"]
    assert store.tables().isEmpty() and store.imports().isEmpty()
    ingest(store, str(evolving))
    assert store.read_table("test_folder").count() == 4


def test_backups(store, tmp_path, put):
    path = put(tmp_path / "in.csv", "id\n1\n2\n3\n4\n")
    store.load_csv("test_folder", str(path), {"id": "BIGINT"})
    path, n = store.backup("test_folder", "id > 1", fmt="csv")
    assert n == 3 and store.spark.read.option("header", True).csv(path).count() == 3
    store.backup("test_folder")
    assert store.expire_backups(max_files=1) == 1
    assert store.backups().count() == 1
    assert store.expire_backups(retention_days=0) == 1


def test_majority_and_misfits(store, tmp_path, put):
    put(tmp_path / "d" / "t" / "a.csv", "n,gaps,day,word\n1,1,2024-01-05,x\n2,,2024-01-06,1\n3,3,01/07/2024,y\n")
    ingest(store, str(tmp_path / "d"), "csv", inference="majority")
    assert store.table_columns("t") == {"n": "BIGINT", "gaps": "DOUBLE PRECISION", "day": "TIMESTAMP", "word": "TEXT"}
    put(tmp_path / "e" / "v" / "a.csv", "n\n1\n2\n3\n4\nfive\n")
    ingest(store, str(tmp_path / "e"), "csv", text_on_misfit=True)
    assert rows(store.read_table("v"), "n") == [("1",), ("2",), ("3",), ("4",), ("five",)]


def test_bulk_load_and_report(store, tmp_path, put):
    from folderloom.operators.revert import write_report

    path = put(tmp_path / "in.csv", "id,s\n1,a\n2,b\n")
    assert store.load_csv("bulk", str(path), {"id": "BIGINT", "s": "TEXT"}) == 2
    assert rows(store.read_table("bulk"), "id", "s") == [(1, "a"), (2, "b")]
    write_report(store.revert_plan("bulk", source_file=str(path)), str(tmp_path / "report"))
    assert store.spark.read.json(str(tmp_path / "report")).head().found_rows == 2


def test_bulk_load_keeps_rejects_and_files_apart(store, tmp_path, put):
    """Misfits are counted and kept, a second load adds what is new only, and a revert takes a file's rejects along."""
    put(tmp_path / "in" / "a.csv", "id,day\n1,2024-01-05\nx,2024-01-06\n3,2024-01-07,more\n4\n5,\n")
    put(tmp_path / "in" / "b.csv", 'id,day\n"6",2024-01-08\n"7\n7",2024-01-09\n')
    put(tmp_path / "in" / "sub" / "c.csv", "id,day\nnone,none\n")
    schema, root = {"id": "BIGINT", "day": "DATE"}, str(tmp_path / "in")
    assert store.load_csv("bulk", root, schema) == 3
    assert [(r.id, str(r.day)) for r in store.read_table("bulk").orderBy("id").collect()] == [(1, "2024-01-05"), (5, "None"), (6, "2024-01-08")]
    assert rows(store.rejects(), "source_file", "record") == [
        (f"{root}/a.csv", "3,2024-01-07,more"), (f"{root}/a.csv", "4"), (f"{root}/a.csv", "x,2024-01-06"),
        (f"{root}/b.csv", '"7\n7",2024-01-09'), (f"{root}/sub/c.csv", "none,none")]
    assert rows(store.imports(), "source_file", "row_count") == [(f"{root}/a.csv", 2), (f"{root}/b.csv", 1), (f"{root}/sub/c.csv", 0)]
    assert store.load_csv("bulk", root, schema) == 0
    put(tmp_path / "in" / "d.csv", "id,day\n8,2024-01-10\n")
    assert store.load_csv("bulk", root, schema) == 1 and store.read_table("bulk").count() == 4
    store.revert("bulk", source_file=f"{root}/a.csv")
    assert store.rejects().count() == 2 and rows(store.read_table("bulk"), "id") == [(6,), (8,)]
    with pytest.raises(ValueError, match="no file"):
        store.load_csv("bulk", str(tmp_path / "nowhere"), schema)


def test_quoted_line_ends_and_quotes(store, tmp_path, put):
    root = tmp_path / "d"
    put(root / "t" / "a.csv", 'id,note\n1,"two\nlines, ""quoted"""\n2,plain\n')
    put(root / "t" / "b.csv", 'id,note\n3,"one ""line"""\n4,back\\slash\n')
    ingest(store, str(root), "csv")
    assert rows(store.read_table("t"), "id", "note") == [
        (1, 'two\nlines, "quoted"'), (2, "plain"), (3, 'one "line"'), (4, "back\\slash")]


def test_unchanged_files_are_not_read_again(store, tmp_path, put):
    import os

    root = tmp_path / "d"
    first = put(root / "t" / "a.csv", "id\n1\n")
    ingest(store, str(root), "csv", trust_listing=True)
    stamp = first.stat()
    first.write_text("id\n7\n")
    os.utime(first, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    put(root / "t" / "b.csv", "id\n2\n")
    result = ingest(store, str(root), "csv", trust_listing=True)
    assert rows(result.outcomes, "source_file", "status") == [("t/a.csv", "skipped"), ("t/b.csv", "success")]
    assert rows(ingest(store, str(root), "csv").outcomes, "source_file", "status") == [("t/a.csv", "success"), ("t/b.csv", "skipped")]


def test_unknown_options_are_refused(store, evolving):
    for bad in ({"atomic": "row"}, {"dedupe": "x"}, {"type_overrides": {"a": "MONEY"}}):
        with pytest.raises(ValueError):
            ingest(store, str(evolving), options=Options(**bad))


def test_several_roots_give_one_result(store, evolving, tmp_path, make_workbook):
    make_workbook(tmp_path / "more" / "other" / "a.xlsx", {"Sheet1": [["ID"], [1]]})
    result = ingest(store, [str(evolving), str(tmp_path / "more")])
    assert result.summary().head()["success"] == 3
    assert {r.table_name for r in result.changes.collect()} == {"test_folder", "other"}
    with pytest.raises(TypeError):
        ingest(store, str(evolving), options=Options(), dedupe="content")


def test_ragged_csv_keeps_every_cell(store, tmp_path, put):
    root = tmp_path / "data"
    put(root / "t" / "a.csv", '\n\na,b\n3,4,5\n6\n"x,\ny",7,,"8"",8",\n')
    put(root / "t" / "b.csv", "\n \na,b\n1,2,,\n")
    names = [f"c{i}_" + "long" * 3000 for i in range(8)]  # a header of about 100 000 characters
    put(root / "wide" / "c.csv", ",".join(names) + "\n" + ",".join(map(str, range(8))) + "\n")
    result = ingest(store, str(root), "csv")
    assert result.summary().head().success == 3
    assert rows(store.read_table("t"), "a", "b", "extra_col_2", "extra_col_3") == [
        ("1", 2, None, None), ("3", 4, 5, None), ("6", None, None, None), ("x,\ny", 7, None, '8",8')]
    wide = store.read_table("wide")
    assert len(wide.columns) == 10 and tuple(wide.head())[:8] == tuple(range(8))


TEXTS = {
    "a.csv": '\r\n \n"x\ny",z\r\n1,2,3,,\n"p,""q",r,s,"t"\n', "b.csv": "x,y\n1\n", "d.csv": '\ufeff"h,1",k\n1,2', "e.csv": "\ufeffx\n1\n",
    "f.csv": "x", "g.csv": "x\n\n\n1,,2\n\n", "h.csv": "x\n" + "1,2\n" * 30_000 + "1,2,3,4,,\n" + '"5\n5",6\n' * 9_000 + "7"}


def facts_of(spark, root):
    found = file_source.scan_files(spark, str(root), (".csv",), in_root=True).collect()
    return {r.name: (r.file_sha256, r.header_text, r.multiline, r.width) for r in found}


@pytest.mark.parametrize("rows_at_once", ["10000", "1"])
def test_facts_of_files_do_not_depend_on_blocks_and_splits(spark, tmp_path, put, rows_at_once):
    for name, text in TEXTS.items():
        if rows_at_once != "1" or len(text) < 1000:
            put(tmp_path / "r" / name, text)
    confs = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows_at_once, "spark.sql.files.maxPartitionBytes": "1000",
             "spark.sql.files.openCostInBytes": "10"}
    for key, value in confs.items():
        spark.conf.set(key, value)
    try:
        facts = facts_of(spark, tmp_path / "r")
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1000"  # as it was before
    finally:
        for key in confs:
            spark.conf.unset(key)
    wanted = {"a.csv": ('"x\ny",z', True, 4), "b.csv": ("x,y", False, 2), "d.csv": ('"h,1",k', False, 2), "e.csv": ("x", False, 1),
              "f.csv": ("x", False, 1), "g.csv": ("x", False, 3), "h.csv": ("x", True, 4)}
    assert facts == {n: (hashlib.sha256(TEXTS[n].encode()).hexdigest(), *wanted[n]) for n in facts}
    assert len(facts) == (7 if rows_at_once != "1" else 6)


def test_a_path_that_only_spark_opens(spark, tmp_path, put, make_workbook):
    """The same files by a mount table of Hadoop, for every format."""
    put(tmp_path / "data" / "t" / "a b.csv", "id\n1\n2\n")
    put(tmp_path / "data" / "u" / "c.json", '[{"id": 3}]')
    make_workbook(tmp_path / "data" / "v" / "d.xlsx", {"Sheet1": [["ID"], [4]]})
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./in", f"file://{tmp_path}/data")
    store = Store(spark, str(tmp_path / "mounted"))
    for fmt in ("csv", "json", "workbook"):
        outcome = ingest(store, "viewfs://far/in", fmt).outcomes.collect()
        assert [(r.status, r.reason) for r in outcome] == [("success", None)]
    assert [r.id for t in "tuv" for r in sorted(store.read_table(t).collect())] == [1, 2, 3, 4]
    digest = hashlib.sha256((tmp_path / "data" / "t" / "a b.csv").read_bytes()).hexdigest()
    assert store.imports().filter("table_name = 't'").head().file_sha256 == digest


def test_a_file_with_too_long_a_line_is_refused_by_name(store, tmp_path, put, monkeypatch):
    monkeypatch.setattr(file_source, "LINE_BYTES", 50)
    put(tmp_path / "data" / "t" / "a.csv", "id\n1\n")
    put(tmp_path / "data" / "t" / "b.csv", "id\n" + "2" * 100 + "\n3\n")
    result = ingest(store, str(tmp_path / "data"), "csv")
    assert rows(result.outcomes, "source_file", "status", "reason") == [
        ("t/a.csv", "success", None), ("t/b.csv", "error", f"cannot be read: a line of over 50 bytes, or changed while it was read")]
    assert rows(store.read_table("t"), "id") == [(1,)]


def test_rows_of_a_refused_file_stay_out(store, tmp_path, make_workbook):
    path = make_workbook(tmp_path / "data" / "t" / "torn.xlsx", {"Sheet1": [["ID"], *[[i] for i in range(2500)]]})
    whole = path.read_bytes()
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    sheet = next(n for n in parts if n.endswith("sheet1.xml"))
    with zipfile.ZipFile(path, "w") as z:
        for n, data in parts.items():
            z.writestr(n, data[:-400] if n == sheet else data)
    make_workbook(tmp_path / "data" / "t" / "good.xlsx", {"Sheet1": [["ID"], [-1]]})
    result = ingest(store, str(tmp_path / "data"))
    assert rows(result.outcomes, "source_file", "status", "row_count") == [("t/good.xlsx", "success", 1), ("t/torn.xlsx", "error", 0)]
    assert rows(store.read_table("t"), "id") == [(-1,)]
    path.write_bytes(whole)
    ingest(store, str(tmp_path / "data"))
    assert store.read_table("t").count() == 2501


def test_json_keys_that_are_always_null(store, tmp_path, put):
    put(tmp_path / "data" / "t" / "a.json", '[{"a": 1, "b": null}, {"a": 2, "b": null}]')
    ingest(store, str(tmp_path / "data"), "json")
    assert store.table_columns("t") == {"a": "INTEGER", "b": "TEXT"}
    assert rows(store.read_table("t"), "a", "b") == [(1, None), (2, None)]


def test_revert_plan_counts_by_import(store, tmp_path, put):
    put(tmp_path / "data" / "t" / "a.csv", "id\n1\n2\n")
    ingest(store, str(tmp_path / "data"), "csv")
    put(tmp_path / "data" / "t" / "a.csv", "id\n1\n2\n3\n")
    ingest(store, str(tmp_path / "data"), "csv")
    assert rows(store.revert_plan("t", source_file="t/a.csv"), "expected_rows", "found_rows") == [(2, 2), (3, 3)]
    put(tmp_path / "data" / "empty" / "e.csv", "id\n")
    ingest(store, str(tmp_path / "data"), "csv", keep_empty=True)
    assert rows(store.revert_plan("empty", source_file="empty/e.csv"), "expected_rows", "found_rows") == [(0, 0)]


def test_change_ids_are_unique_and_ordered(store, tmp_path, put):
    for i, value in enumerate(("1", "1.5", "x", "y")):
        put(tmp_path / "data" / "t" / f"f{i}.csv", f"a,c{i}\n{value},1\n")
        put(tmp_path / "data" / "u" / f"f{i}.csv", f"a\n{value}\n")
    ingest(store, str(tmp_path / "data"), "csv", policy="chain")
    found = rows(store.changes(), "id", "table_name", "source_file")
    assert len({f[0] for f in found}) == len(found) > 6
    for t in ("t", "u"):
        files = [f[2] for f in found if f[1] == t]
        assert files == sorted(files)


def test_two_runs_at_once_do_not_mix(store, tmp_path, put, monkeypatch):
    """A second run imports into the same table while the first one writes: the first is refused, and right when run again."""
    put(tmp_path / "one" / "t" / "a.csv", "id\n1\n")
    put(tmp_path / "two" / "t" / "b.csv", "id\nx\n")
    put(tmp_path / "other" / "u" / "c.csv", "id\n7\n")
    put(tmp_path / "zero" / "t" / "z.csv", "id\n0\n")
    ingest(store, str(tmp_path / "zero"), "csv", run="zero")
    write = Store.write_rows

    def interrupted(self, table, version, run, frame):
        monkeypatch.setattr(Store, "write_rows", write)
        ingest(self, str(tmp_path / "two"), "csv", run="two")  # the column becomes text, so version 2 begins
        ingest(self, str(tmp_path / "other"), "csv", run="other")
        return write(self, table, version, run, frame)

    monkeypatch.setattr(Store, "write_rows", interrupted)
    with pytest.raises(ConcurrentCommit, match="run one is not committed: run two has changed t"):
        ingest(store, str(tmp_path / "one"), "csv", run="one")
    assert rows(store.read_table("t"), "id") == [("0",), ("x",)]
    assert rows(store.imports(), "source_file") == [("t/b.csv",), ("t/z.csv",), ("u/c.csv",)]
    ingest(store, str(tmp_path / "one"), "csv", run="one")  # what it left under version 1 stays unseen
    assert rows(store.read_table("t"), "id") == [("0",), ("1",), ("x",)]
    assert rows(store.commits(), "version", "_run") == [(1, "zero"), (2, "two"), (3, "other"), (4, "one")]
    assert sorted(store.table_versions("t")) == [1, 2]


def test_a_run_on_another_table_is_in_nobodys_way(store, tmp_path, put, monkeypatch):
    put(tmp_path / "one" / "t" / "a.csv", "id\n1\n")
    put(tmp_path / "other" / "u" / "c.csv", "id\n7\n")
    write = Store.write_rows

    def interrupted(self, *args):
        monkeypatch.setattr(Store, "write_rows", write)
        ingest(self, str(tmp_path / "other"), "csv", run="other")
        return write(self, *args)

    monkeypatch.setattr(Store, "write_rows", interrupted)
    ingest(store, str(tmp_path / "one"), "csv", run="one")
    assert rows(store.commits(), "version", "_run") == [(1, "other"), (2, "one")]
    assert rows(store.read_table("t"), "id") == [(1,)] and rows(store.read_table("u"), "id") == [(7,)]
