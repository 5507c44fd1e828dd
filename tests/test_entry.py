"""The contract of the entry points, and a sample of queries against their SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_queries import TABLES, bag

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_entry(spark):
    assert entry_points.entry(spark).columns == [
        "table_name", "change_type", "column_name", "old_type", "new_type", "source_file"]


def test_every_query_has_sql():
    own = {k for k, f in entry_points.queries().items() if f.__module__.startswith("folderloom.plans")}
    assert own <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", ["clean_identifier_current", "numeric_clean", "infer_batches", "schema_timeline",
                                  "change_log_chain", "content_dedupe", "revert_plan", "sheet_resolution_nearest"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry_points.queries()[name](spark, SF)
    cur = con.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(columns, cur.fetchall())
