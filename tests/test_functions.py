"""Value and name expressions on hand-written cases."""

from __future__ import annotations

import datetime
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folderloom.functions import names, sqltypes, values


def apply(spark, expr, inputs, kind="string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_clean_identifier_dialects(spark):
    raw = ["Column@Name!", "a___b___c", "123column", "café", "!!!", "_HelloWorld_", "", None, "İstanbul Şube.csv", "ﬁle™ Ⅻ"]
    assert apply(spark, lambda c: names.clean_identifier(c, "current"), raw) == [
        "column_name", "a_b_c", "_123column", "cafe", "col", "helloworld", "col", "none", "istanbul_sube_csv", "file_xii"]
    assert apply(spark, lambda c: names.clean_identifier(c, "suffix"), raw) == [
        "column_name", "a_b_c", "123column", "cafe", "", "helloworld", "", "", "istanbul_sube_csv", "filetm_xii"]
    assert apply(spark, lambda c: names.clean_identifier(c, "legacy"), raw)[:9] == [
        "column_name", "a_b_c", "col_123column", "caf", "", "helloworld", "", "", "istanbul_sube"]
    assert apply(spark, lambda c: names.clean_identifier(c, "upload"), raw)[:9] == [
        "column_name", "a_b_c", "123column", "caf", "", "helloworld", "unnamed", "unnamed", "i_stanbul_sube_csv"]
    with pytest.raises(ValueError):
        names.clean_identifier("v", "other")


def test_header_arrays_agree_with_single_names(spark):
    raw = [["Col", "Ünïcode", "", "9"], [], ["a.b", "a b"]]
    for dialect in names.DIALECTS:
        whole = apply(spark, lambda c: names.clean_header_cells(c, dialect), raw, "array<string>")
        single = [apply(spark, lambda c: names.clean_identifier(c, dialect), h) if h else [] for h in raw]
        assert whole == single


def test_repeated_names(spark):
    raw = [["name", "name", "name"], ["", "name", ""], ["a", "a", "a_1"]]
    assert apply(spark, names.suffix_duplicates, raw, "array<string>") == [
        ["name", "name_1", "name_2"], ["column", "name", "column_1"], ["a", "a_1", "a_1_1"]]
    assert apply(spark, names.fallback_names, [["ok", "", "9x", "col_1"]], "array<string>") == [
        ["ok", "col_1", "col_2", "col_1_1"]]
    assert apply(spark, lambda c: names.pad_header(c, F.lit(4)), [["a", "b", "c"]], "array<string>") == [
        ["a", "b", "c", "extra_col_3"]]


def test_table_names_and_paths(spark):
    assert apply(spark, names.safe_table_name, ["My Table", "123table", "table@#$%name", "", None]) == [
        "my_table", "t_123table", "table_name", "data_table", "data_table"]
    assert apply(spark, names.is_valid_identifier, ["valid_name", "123name", "select", "", None, "a b"]) == [
        True, False, False, False, False, False]
    assert apply(spark, lambda c: names.table_from_parts(names.folder_parts(c)), ["Folder_B/nested/f.xlsx", "f.xlsx"]) == [
        "folder_b_nested", ""]
    assert apply(spark, names.display_path, ["x" * 35, "y" * 40]) == ["x" * 35, "..." + "y" * 32]


def test_numbers(spark):
    raw = ["$1,234.50", "12 %", "1e3", "-.5", "1_000", "inf", "nan", "1d", "abc", "", None, "99999999999999999999",
           "9007199254740993", "-1.9", " 7 ", "+4"]
    assert apply(spark, values.as_double, raw)[:6] == [1234.5, 12.0, 1000.0, -0.5, None, float("inf")]
    assert apply(spark, values.as_double, raw)[6:11] == [None] * 5
    assert apply(spark, values.as_bigint, raw) == [
        1234, 12, 1000, 0, None, None, None, None, None, None, None, None, 9007199254740993, -1, 7, 4]
    assert apply(spark, values.is_numeric, raw) == [True] * 7 + [False, False, None, None] + [True] * 5


def test_dates(spark):
    raw = ["2024-01-05", "2024/1/5 10:30", "13/05/2024", "05/13/2024", "5-Jan-2024", "05-January-2024", "1/2/24", "2024-02-30",
           "2024-01-01 junk", "", None, "2024-01-01T10:20:30.5Z", "5-Abc-2024", " 12/31/1999 ", "20240105", "02/30/2024"]
    d = datetime.date
    assert apply(spark, values.as_date, raw) == [
        d(2024, 1, 5), d(2024, 1, 5), d(2024, 5, 13), d(2024, 5, 13), d(2024, 1, 5), d(2024, 1, 5), d(2024, 1, 2), None, None,
        None, None, d(2024, 1, 1), None, d(1999, 12, 31), None, None]
    moments = apply(spark, values.as_timestamp, raw)
    assert moments[1] == datetime.datetime(2024, 1, 5, 10, 30) and moments[11] == datetime.datetime(2024, 1, 1, 10, 20, 30, 500000)
    assert apply(spark, values.is_date_like, raw) == [
        True, False, True, True, True, True, True, True, True, False, None, True, True, True, False, True]


def test_words_text_and_ids(spark):
    raw = ["Yes", " n ", "TRUE", "0", "maybe", "", None, " \tx\u00a0"]
    assert apply(spark, values.as_boolean, raw) == [True, False, True, False, None, None, None, None]
    assert apply(spark, values.as_text, raw) == ["Yes", "n", "TRUE", "0", "maybe", None, None, "x"]
    assert apply(spark, values.is_uuid, ["123E4567-e89b-12d3-a456-426614174000", "123e4567"]) == [True, False]
    assert apply(spark, values.is_sha256, ["a" * 64, "a" * 63, "x.csv"]) == [True, False, False]
    assert apply(spark, values.nan_text_to_null, ["nan", "None", "x", None]) == [None, None, "x", None]
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", spark.range(1).select(values.utc_now_text()).head()[0])


def _is_json(text):
    if len(text) < 2 or text[0] not in "{[" or text[-1] not in "}]":
        return False
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


JSON_CASES = [
    '{"a":1}', '{"a":1} {"b":2}', '{"a":1,"a":2}', "{'a':1}", "[NaN]", "[1]],[2]", '{"a":[1,2,]}', '{"a":"x\\q"}', '{"a":"NaN"}',
    "[-Infinity]", '{"a":"b\tc"}', "[1],[2]", "[]", "{}", "[01]", '{"a":{"b":1,"b":2}}', '{"k":1}}', "[1]}", '["\\u12"]',
    "[\"it's\"]", "[1NaN]", "[-NaN]", "[ ]", '["a" "b"]', '{"a"}', '{"a":}', "[null,true]", '["\\"]"]', '["a]', "[1]\n", "[\n1]", "x", "",
]


def test_json_check_agrees_with_a_strict_parser(spark):
    assert apply(spark, values.is_json, JSON_CASES) == [_is_json(c) for c in JSON_CASES]


def test_json_check_on_random_edits(spark):
    import random

    rng = random.Random(5)
    base = ['{"a": [1, 2.5e3, {"b": null}], "c": "x\\ny"}', '[true, "q\'", {"k": -1}]', '{"k": {"k": []}}']
    cases = []
    for _ in range(600):
        text = list(rng.choice(base))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(text))
            text[at:at + rng.randint(0, 2)] = rng.choice(['"', "'", ",", "]", "}", "[", "{", ":", "1", " ", "\\", "NaN", "e", ""])
        cases.append("".join(text))
    assert apply(spark, values.is_json, cases) == [_is_json(c) for c in cases]


def test_votes(spark):
    raw = ["123e4567-e89b-12d3-a456-426614174000", '{"a": 1}', "2024-01-01junk", "5.0", "5.5", "1", "yes", "t", "hello", "", None,
           "$5", "1_0", "{'a': 1}", "[x]", '{"a": True}']
    assert apply(spark, values.vote, raw) == [
        "UUID", "JSONB", "DATE", "BIGINT", "DOUBLE PRECISION", "BIGINT", "BOOLEAN", "", "", "", None, "BIGINT", "BIGINT", "", "", ""]
    assert apply(spark, lambda c: values.vote(c, compat=True), ['{"a": True}']) == ["JSONB"]


def test_render_text(spark):
    assert apply(spark, lambda c: values.render_text(c, "double"), [1.0, 2.5, 1e10, None], "double") == ["1", "2.5", "10000000000", None]


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sampled_from(sqltypes.LATTICE), st.sampled_from(sqltypes.LATTICE), st.sampled_from(sqltypes.LATTICE))
def test_lub_is_a_join(a, b, c):
    lub = sqltypes.lub
    assert lub(a, a) == a and lub(a, b) == lub(b, a) and lub(a, lub(b, c)) == lub(lub(a, b), c)
    assert lub(a, "TEXT") == "TEXT" and lub(a, lub(a, b)) == lub(a, b)


def test_column_forms_agree_with_plain_ones(spark):
    from functools import reduce
    from itertools import combinations

    pairs = spark.createDataFrame([(a, b) for a in sqltypes.ALL_TYPES for b in sqltypes.ALL_TYPES], "a string, b string")
    for policy in sqltypes.POLICIES:
        got = pairs.select("a", "b", sqltypes.resolve_column("a", "b", policy).alias("r")).collect()
        assert all(r.r == sqltypes.resolve(r.a, r.b, policy) for r in got)
    assert sqltypes.widening_table(spark, "pairs").count() == (len(sqltypes.ALL_TYPES) + 1) ** 2
    sets = [list(c) for n in (1, 2, 3) for c in combinations(sqltypes.LATTICE, n)]
    df = spark.createDataFrame([(s,) for s in sets], "t array<string>")
    for r in df.select("t", sqltypes.lub_of_set("t").alias("r")).collect():
        assert r.r == reduce(sqltypes.lub, r.t), r


def test_fixture_type_pairs():
    assert sqltypes.resolve("INTEGER", "INTEGER", "pairs") == "INTEGER"
    assert sqltypes.resolve("INTEGER", "BIGINT", "pairs") == "BIGINT"
    assert sqltypes.resolve("INTEGER", "TEXT", "pairs") == "TEXT"
    assert sqltypes.resolve("BIGINT", "INTEGER", "chain") == "TEXT"
    assert sqltypes.resolve("BIGINT", "INTEGER") == "BIGINT"


def test_cleaning_works_out_each_part_once(spark):
    one = spark.createDataFrame([("1",)], "v string")
    plan = lambda out: one.select(out.alias("out"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(values.as_double("v")).count("translate(") == 1
    assert plan(values.as_bigint("v")).count("translate(") == 1
    assert plan(values.as_date("v")).count("RLIKE") == 4  # one for each shape
    assert apply(spark, values.as_double, ["$1,200.50", " 7 %", "+.5", "1e3", "x", "", None, "12\n", "inf"]) == [
        1200.5, 7.0, 0.5, 1000.0, None, None, None, 12.0, float("inf")]
    assert apply(spark, values.as_bigint, ["17.7", " 9 ", "$1,000", "9" * 20, "x", None, "-3", "1e3"]) == [
        17, 9, 1000, None, None, None, -3, 1000]
    day = datetime.date(1999, 12, 31)
    assert apply(spark, values.as_date, ["12/31/1999", "31/12/1999", "12/31/99", "1999/12/31 10:00", "31-Dec-1999", "31-Foo-1999", "x", None]) == [
        day, day, datetime.date(2099, 12, 31), day, day, None, None, None]
