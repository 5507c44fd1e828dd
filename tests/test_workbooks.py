from __future__ import annotations

from folderloom.plans.ingest import ingest
from folderloom.plans.staging import Stage
from folderloom.plans.store import Store
from folderloom.sources import workbook


def test_written_workbooks_are_read_again(spark, tmp_path):
    sheets = {"Data <1>": [["Id", "Name & so"], [1, "a<b"], [2.5], [3, None, "more"]], "Empty": []}
    content = workbook.workbook_bytes(sheets, workbook.SEPARATOR)
    books = spark.createDataFrame([("x y", "one.xlsx", content), ("z", "two.xlsx", content)], "folder string, name string, content binary")
    workbook.write_workbooks(books, str(tmp_path / "in"))
    assert (tmp_path / "in" / "x y" / "one.xlsx").read_bytes() == content
    store = Store(spark, str(tmp_path / "store"))
    done = ingest(store, str(tmp_path / "in"), "workbook", default_sheet="Data <1>")
    assert {r.source_file: r.status for r in done.outcomes.collect()} == {"x y/one.xlsx": "success", "z/two.xlsx": "success"}
    got = sorted(tuple(r)[:3] for r in store.read_table("x_y").collect())
    assert got == [(1.0, "a<b", None), (2.5, None, None), (3.0, None, "more")]


def test_a_workbook_too_large_for_one_row_is_refused_by_name(spark, tmp_path, make_workbook):
    make_workbook(tmp_path / "in" / "a" / "small.xlsx", {"Sheet1": [["Id"], [1]]})
    big = make_workbook(tmp_path / "in" / "a" / "big.xlsx", {"Sheet1": [["Id"]] + [[k * 7919 % 10007] for k in range(3000)]})
    store = Store(spark, str(tmp_path / "store"))
    done = ingest(store, str(tmp_path / "in"), "workbook", whole_row_bytes=big.stat().st_size - 1)
    assert {r.source_file: (r.status, r.reason) for r in done.outcomes.collect()} == {
        "a/small.xlsx": ("success", None), "a/big.xlsx": ("error", f"too large for one row: {big.stat().st_size} bytes")}
    assert [r.id for r in store.read_table("a").collect()] == [1]


def test_a_table_reads_its_own_part_of_what_is_staged(spark):
    rows = spark.range(40).selectExpr("concat('t', id % 4) AS table_name", "id AS x")
    staged = Stage(spark).keep(rows, "used", by=["table_name"])
    assert sorted(r.x for r in staged.filter("table_name = 't1'").collect()) == list(range(1, 40, 4))
    assert {f.split("table_name=")[1].split("/")[0] for f in staged.inputFiles()} == {"t0", "t1", "t2", "t3"}
    plan = staged.filter("table_name = 't1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(table_name" in plan


def test_a_sheet_is_read_without_work_for_every_element(monkeypatch):
    rows = [["Id", "Price", "Text", "None"], *[[k, k / 4, f"<{k}>", None] for k in range(1200)]]
    content, calls, cut = workbook.workbook_bytes({"S": rows}), [], workbook._local
    monkeypatch.setattr(workbook, "_local", lambda tag: calls.append(tag) or cut(tag))
    blocks = list(workbook._blocks("f", content))
    assert [(b[2], len(b[4])) for b in blocks] == [(2, 500), (502, 500), (1002, 200)]
    assert blocks[0][3] == rows[0] and blocks[2][4][-1] == ["1199", "299.75", "<1199>", None]
    assert len(calls) < 100


def test_rows_before_a_fault_are_read(spark):
    body = "".join(f'<row r="{r}"><c><v>{r}</v></c></row>' for r in range(1, 4001))
    import io
    got = []
    rows = workbook._sheet_rows(io.BytesIO(f"<worksheet><sheetData>{body}<row></sheetData>".encode()), [], set(), False)
    try:
        for row in rows:
            got.append(row)
    except workbook.ElementTree.ParseError:
        got.append("fault")
    assert got == [*[(r, [str(r)]) for r in range(1, 4001)], "fault"]
