from __future__ import annotations

import datetime
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folderloom.plans.ingest import ingest
from folderloom.plans.store import ConcurrentCommit, Store


def fill(store, table, run, files):
    """One run that imports files, each with its ids."""
    spark = store.spark
    store.create_table(table, {"id": "BIGINT"})
    rows = spark.createDataFrame([(i, f) for f, found in files.items() for i in found], "id long, source_file string")
    store.write_rows(table, 1, run, rows.withColumn("load_timestamp", F.current_timestamp()))
    logged = spark.createDataFrame([(f, len(found)) for f, found in files.items()], "source_file string, row_count long")
    store.append_ledger("imports", run, logged.select(
        F.xxhash64("source_file").alias("id"), F.lit(table).alias("table_name"), "source_file", F.sha2("source_file", 256).alias("file_sha256"),
        "row_count", F.current_timestamp().alias("imported_at"), F.lit(table).alias("folder_path"), F.lit(1).alias("schema_version"),
        F.lit(None).alias("length"), F.lit(None).alias("modified")))
    store.commit(run)


@pytest.fixture
def store(spark, tmp_path):
    """Three files in one run of one table, and a file of another table in a second run."""
    found = Store(spark, str(tmp_path / "store"))
    fill(found, "a", "one", {f"a/f{k}.csv": [k, k + 10] for k in range(3)})
    fill(found, "b", "two", {"b/g.csv": [1]})
    return found


def ids(store, table):
    return sorted(r.id for r in store.read_table(table).collect())


def folders(store, table):
    return sorted(str(p.relative_to(store.root)) for p in Path(store.root, "data", table).glob("*/*"))


def test_reverted_rows_leave_the_disk_after_the_grace_time(store):
    before, logged = folders(store, "a"), store.imports().count()
    store.revert("a", source_file="a/f1.csv")
    old = store.head()
    assert store.purge().collect() == []  # rewritten and marked; a reader of the old list still finds its folder
    kept = folders(store, "a")
    assert len(kept) == 2 and before[0] in kept
    assert ids(store, "a") == [0, 2, 10, 12] and ids(store, "b") == [1]
    assert sorted(r.id for r in store._all_rows("a", old)[0].collect()) == [0, 1, 2, 10, 11, 12]
    assert store.imports().count() == logged - 1
    later = datetime.datetime.now() + datetime.timedelta(days=2)
    assert [(r.kind, r.table_name) for r in store.purge(now=later).collect()] == [("run", "a")]
    assert folders(store, "a") == [k for k in kept if k not in before]
    assert ids(store, "a") == [0, 2, 10, 12]
    assert store.purge(now=later).collect() == []


def test_a_revert_beside_a_purge_is_refused(store):
    since = store.head()
    chosen = store.imports().filter("source_file = 'a/f0.csv'")
    store.revert("a", source_file="a/f1.csv")
    store.purge()  # moves the rows that the second revert has chosen
    with pytest.raises(ConcurrentCommit):
        store.revert_imports(chosen, since=since)
    assert ids(store, "a") == [0, 2, 10, 12]
    store.revert("a", source_file="a/f0.csv")
    assert ids(store, "a") == [2, 12]


def test_writers_of_the_log_take_turns(store):
    """Many commits at once: each gets a version of its own, and plans do not grow with their number."""
    with ThreadPoolExecutor(8) as pool:
        versions = list(pool.map(lambda k: store.commit(f"stream-{k}"), range(24)))
    assert sorted(versions) == list(range(store.head() - 23, store.head() + 1))
    assert store.commits().select("version").distinct().count() == store.head()
    plan = store.imports()._jdf.queryExecution().optimizedPlan().toString()
    assert "stream-7" not in plan and ids(store, "b") == [1]


def test_purged_tables_go_on(store, tmp_path, put):
    store.revert("a", source_file="a/f0.csv")
    store.purge(grace_seconds=0)
    plan = store.revert_plan("a", source_file="a/f1.csv").collect()
    assert [(r.source_file, r.expected_rows, r.found_rows) for r in plan] == [("a/f1.csv", 2, 2)]
    put(tmp_path / "in" / "a" / "f9.csv", "id,more\n9,1.5\n")
    ingest(store, str(tmp_path / "in"), "csv")
    assert ids(store, "a") == [1, 2, 9, 11, 12]
    store.revert("a", source_file="a/f2.csv")
    store.purge(grace_seconds=0)
    assert ids(store, "a") == [1, 9, 11]
    assert sorted((r.id, r.more) for r in store.read_table("a").collect() if r.more) == [(9, 1.5)]


def test_dropped_tables_and_expired_backups_go(store):
    path, n = store.backup("b")
    assert n == 1 and Path(path).exists()
    store.drop_tables(["a"], confirm=True)
    assert store.expire_backups(max_files=0) == 1
    gone = {(r.kind, r.table_name) for r in store.purge(grace_seconds=0).collect()}
    assert gone == {("run", "a"), ("backup", "b")}
    assert not Path(path).exists() and folders(store, "a") == [] and ids(store, "b") == [1]


def test_without_rewriting_partly_reverted_runs_stay(store):
    store.revert("a", source_file="a/f1.csv")
    held = folders(store, "a")
    assert store.purge(grace_seconds=0, rewrite=False).collect() == [] and folders(store, "a") == held
