"""Operators against brute force on small random inputs and on hand-written frames."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from folderloom.functions import sqltypes
from folderloom.operators import columns, evolution, inference, joins, ledger, revert, sheets


def rows(df, *order):
    out = [tuple(r) for r in df.select(*order).collect()]
    return sorted(out, key=lambda t: tuple((v is not None, v) for v in t))


def simulate(files, policy, existing=None, relog=False):
    """File by file, one after the other."""
    tables = {t: dict(c) for t, c in (existing or {}).items()}
    log = []
    for table, key, types in files:
        if table not in tables:
            tables[table] = dict(types)
            log.append((table, "create_table", None, None, None, key))
            continue
        known = tables[table]
        for column, new in types.items():
            if column not in known:
                known[column] = new
                log.append((table, "add_column", column, None, new, key))
                continue
            old, known[column] = known[column], sqltypes.resolve(known[column], new, policy)
            if known[column] != old or (relog and old == "TEXT" and new != "TEXT"):
                log.append((table, "alter_type", column, old, known[column], key))
    return log, tables


@pytest.mark.parametrize("policy", sqltypes.POLICIES)
def test_timelines_match_the_file_by_file_fold(spark, policy):
    rng = random.Random(policy)
    kinds = ["SMALLINT", "INTEGER", "BIGINT", "REAL", "DOUBLE PRECISION", "DATE", "TIMESTAMP", "TEXT", "BOOLEAN"]
    if policy == "ranked":
        kinds = ["BOOLEAN", "BIGINT", "DOUBLE PRECISION", "TIMESTAMP", "TEXT"]
    files = []
    for t in range(12):
        few = rng.sample(kinds, rng.randint(2, 4))
        for f in range(rng.randint(1, 9)):
            present = rng.sample("abcd", rng.randint(1, 4))
            files.append((f"t{t}", f"f{f}.csv", {c: rng.choice(few) for c in present}))
    existing = {"t0": {"a": "BIGINT", "z": "TEXT"}, "t1": {"b": "TEXT"}}
    flat = [(t, k, c, s) for t, k, types in files for c, s in types.items()]
    batch = spark.createDataFrame(flat, "table_name string, file_key string, column_name string, sql_type string")
    held = spark.createDataFrame([(t, c, s) for t, cs in existing.items() for c, s in cs.items()],
                                 "table_name string, column_name string, sql_type string")
    relog = policy == "chain"
    log, tables = simulate(files, policy, existing, relog)
    got = evolution.change_log(batch, policy, held, relog)
    order = ["table_name", "change_type", "column_name", "old_type", "new_type", "source_file"]
    assert rows(got, *order) == sorted(log, key=lambda t: tuple((v is not None, v) for v in t))
    final = evolution.final_types(batch, policy, held)
    assert rows(final, "table_name", "column_name", "sql_type") == sorted(
        (t, c, s) for t, cs in tables.items() for c, s in cs.items())


def test_new_columns(spark):
    a = spark.createDataFrame([("t", "x"), ("t", "y"), ("u", "x")], "table_name string, column_name string")
    b = spark.createDataFrame([("t", "x")], "table_name string, column_name string")
    assert rows(evolution.new_columns(a, b), "table_name", "column_name") == [("t", "y"), ("u", "x")]


def test_merge_colliding_columns(spark):
    df = spark.createDataFrame([("Alice", None, 25), (None, "Bob", 30)], "Name string, NAME_ string, Age int")
    out = columns.normalize_columns(df)
    assert out.columns == ["name", "age"] and rows(out, "name", "age") == [("Alice", 25), ("Bob", 30)]
    three = spark.createDataFrame([(1, None, None), (None, 2, None), (None, None, 3)], "Col int, `col ` int, `COL.` int")
    assert rows(columns.normalize_columns(three), "col") == [(1,), (2,), (3,)]
    same = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string").toDF("col", "col")
    assert columns.suffix_columns(same).columns == ["col", "col_1"]
    legacy = spark.createDataFrame([(1, 2)], "`9lives` int, `!` int")
    assert columns.normalize_columns(legacy, "legacy").columns == ["col_9lives", "col_1"]


def test_insert_checks(spark):
    columns.check_insertable(["a", "b_1"])
    for bad in (["a", "a"], ["1a"], ["a b"]):
        with pytest.raises(ValueError):
            columns.check_insertable(bad)


def test_frame_inference(spark):
    df = spark.createDataFrame([(1, "a", 1.5, True), (2, "b", 2.5, False), (3, "c", 3.0, True)],
                               "id int, name string, score double, passed boolean")
    got = inference.infer_schema(df.withColumn("f", F.lit("x")), ["f"], df.columns)
    assert rows(got, "column_name", "sql_type") == [
        ("id", "INTEGER"), ("name", "TEXT"), ("passed", "BOOLEAN"), ("score", "DOUBLE PRECISION")]


def test_acceptance_share_and_integer_bounds(spark):
    cols = {"four_of_five": ["1", "2", "3", "4", "x"], "three_of_four": ["1", "2", "3", "x", None],
            "edge": ["2147483646", "1", None, None, None], "over": ["2147483647", "1", None, None, None],
            "low": ["-2147483647", None, None, None, None], "mixed": ["1", "2", "3.5", "4.5", None],
            "flags": ["1", "0", "yes", "no", "y"], "dates": ["2024-01-01", "01/02/2024", "1-Jan-2024", "x", "2024/01/01"]}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} string" for c in cols)).withColumn("f", F.lit("x"))
    expected = {"four_of_five": "INTEGER", "three_of_four": "TEXT", "edge": "INTEGER", "over": "BIGINT", "low": "INTEGER",
                "mixed": "DOUBLE PRECISION", "flags": "TEXT", "dates": "DATE"}
    got = inference.infer_schema(df, ["f"], list(cols))
    assert {r.column_name: r.sql_type for r in got.collect()} == expected
    split = inference.infer_schema(df, ["f"], list(cols), compat=True)
    assert {r.column_name: r.sql_type for r in split.collect()} == {**expected, "mixed": "TEXT"}


def test_majority(spark):
    df = spark.createDataFrame([("1", "1"), ("2", "2"), ("3", "abc"), ("4", "def"), ("5", "ghi")], "numbers string, mixed string")
    cells = df.withColumn("k", F.lit(1)).unpivot(["k"], ["numbers", "mixed"], "column_name", "value")
    assert rows(inference.infer_majority(cells, ["column_name"]), "column_name", "kind") == [("mixed", "text"), ("numbers", "numeric")]


def test_overrides_in_struct_type():
    got = inference.struct_type({"a": "TEXT", "u": "UUID"}, {"a": "BIGINT", "absent": "DATE"})
    assert got.simpleString() == "struct<a:bigint,u:string>" and got["u"].metadata == {"logical": "uuid"}


def test_flatten(spark):
    df = spark.createDataFrame([(1, ((2, [3]),))], "a int, b struct<c: struct<d: int, e: array<int>>>")
    assert columns.flatten_structs(df).columns == ["a", "b.c.d", "b.c.e"]


CONFIG = {"folder_a": {"sheet": "Policies"}, "Folder_B": {"nested": {"sheet": "Claims"}, "sheet": "B"}, 2024: {"q1": {}},
          "skip": {"deep": {"sheet": "Deep"}}}


def walked_sheet(config, parts, rule, default):
    """Plain walks down the mapping, keys folded to lower case."""
    fold = lambda d: {str(k).lower(): v for k, v in d.items()}
    node, found = config, None
    for part in parts:
        child = fold(node).get(part.lower())
        if not isinstance(child, dict):
            if rule == "deepest":
                continue
            if rule == "exact":
                return default
            break
        node = child
        if "sheet" in node:
            found = node["sheet"]
    return (found or default) if rule == "nearest" else node.get("sheet", default)


@pytest.mark.parametrize("rule", ["nearest", "exact", "deepest"])
def test_sheet_rules(spark, rule):
    folders = ["folder_a", "FOLDER_A/x", "folder_b", "folder_b/nested", "folder_b/nested/more", "2024/q1", "other", "x/folder_a",
               "skip", "skip/between/deep", "skip/deep"]
    df = spark.createDataFrame([(f,) for f in folders], "folder string")
    got = {r.folder: r.sheet for r in sheets.resolve_sheets(df, CONFIG, rule, "Sheet1").collect()}
    assert got == {f: walked_sheet(CONFIG, f.split("/"), rule, "Sheet1") for f in folders}


def test_ledger_dedupe(spark):
    files = spark.createDataFrame([("t", "a", "h1"), ("t", "b", "h1"), ("t", "c", "h2"), ("u", "a", "h1")],
                                  "table_name string, source_file string, file_sha256 string")
    done = files.filter("source_file = 'a' AND table_name = 't'")
    assert rows(ledger.not_imported(files, done), "table_name", "source_file") == [("t", "b"), ("t", "c"), ("u", "a")]
    assert rows(ledger.first_copies(files), "table_name", "source_file") == [("t", "a"), ("t", "c"), ("u", "a")]
    assert ledger.matching(files).count() == 0
    assert ledger.matching(files, table_name="t", source_file=None, file_sha256="h1").count() == 2


def test_metrics_of_an_empty_run(spark):
    empty = spark.createDataFrame([], "status string, reason string, row_count bigint, schema_changes bigint, seconds double")
    assert ledger.outcome_summary(empty).head().asDict() == {"success": 0, "errors": 0, "skipped": 0, "success_rate": 0}
    assert ledger.run_metrics(empty).head().rows_imported == 0
    three = spark.createDataFrame([("success",), ("success",), ("error",)], "status string")
    assert ledger.outcome_summary(three).head().success_rate == 67


def test_revert_selectors(spark):
    assert revert.selector("A" * 64) == {"file_sha256": "A" * 64} and revert.selector("f.xlsx") == {"source_file": "f.xlsx"}
    with pytest.raises(ValueError):
        revert.select_imports(spark.range(1))


def test_schema_revert_undoes_to_the_oldest_type(spark):
    log = spark.createDataFrame(
        [(1, "t", "create_table", None, None, None, "f1"), (2, "t", "add_column", "b", None, "INTEGER", "f2"),
         (3, "t", "alter_type", "a", "INTEGER", "BIGINT", "f2"), (4, "t", "alter_type", "a", "BIGINT", "TEXT", "f2"),
         (5, "t", "alter_type", "c", None, "TEXT", "f2")],
        "id bigint, table_name string, change_type string, column_name string, old_type string, new_type string, source_file string")
    plan = revert.schema_revert_plan(log, "t", "f2")
    now = spark.createDataFrame([("t", "a", "TEXT"), ("t", "b", "INTEGER"), ("t", "c", "TEXT")],
                                "table_name string, column_name string, sql_type string")
    assert rows(revert.schema_after_revert(now, plan), "column_name", "sql_type") == [("a", "INTEGER"), ("c", "TEXT")]
    assert plan.filter("manual_step IS NOT NULL").head().column_name == "c"
    assert rows(revert.schema_revert_plan(log, "t", "f1", drop_created=True), "action") == [("drop_table",)]


def test_retention_against_brute_force(spark):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    manifest = [(rng.choice("aaab"), f"p{i}", start + datetime.timedelta(hours=rng.randint(0, 40))) for i in range(60)]
    df = spark.createDataFrame(manifest, "table_name string, backup_path string, created_at timestamp_ntz")
    now = start + datetime.timedelta(days=2)
    for days, most in ((None, 5), (1, None), (1, 3), (None, None)):
        cut = [m for m in manifest if days is None or m[2] >= now - datetime.timedelta(days=days)]
        keep = set()
        for t in "ab":
            mine = sorted((m for m in cut if m[0] == t), key=lambda m: (m[2], m[1]), reverse=True)
            keep |= {m[1] for m in mine[:most]}
        got = {r.backup_path for r in revert.expired_backups(df, now, days, most).collect()}
        assert got == {m[1] for m in manifest} - keep


def test_broadcast_is_marked_only_when_small(spark):
    plan = lambda rows_: joins.broadcast_if_small(spark.range(10), rows_)._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in plan(10) or "UnresolvedHint" in plan(10)
    assert "Hint" not in plan(9)


def test_empty_columns_are_added_in_one_pass(spark):
    from folderloom.operators import inference

    keys = ["t", "c"]
    types = spark.range(2).selectExpr("'t' AS t", "concat('c', id) AS c", "'DATE' AS sql_type")
    headers = spark.createDataFrame([("t", "c0"), ("t", "x"), ("t", "x"), ("u", "c1")], "t string, c string")
    out = inference.with_empty_columns(types, headers, keys)
    assert sorted(map(tuple, out.collect())) == [("t", "c0", "DATE"), ("t", "c1", "DATE"), ("t", "x", "TEXT"), ("u", "c1", "TEXT")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
