"""The incremental form: same tables as a batch run, nothing twice, resumable."""

from __future__ import annotations

from folderloom.plans.ingest import Options, ingest, ingest_files
from folderloom.plans.store import Store
from folderloom.sources.files import scan_files
from folderloom.streaming.incremental import ingest_stream


def table(store, name):
    return sorted(tuple(str(v) for v in r) for r in store.read_table(name).drop("load_timestamp").collect())


def test_stream_equals_batch_and_resumes(spark, tmp_path, put):
    root = tmp_path / "data"
    put(root / "t" / "a.csv", "id,v\n1,1\n2,2\n")
    put(root / "t" / "b.csv", "id,v,extra\n3,x,9\n")
    put(root / "u" / "c.csv", "k\nyes\n")
    put(root / "ignored.txt", "x")
    streamed, batch = Store(spark, str(tmp_path / "s1")), Store(spark, str(tmp_path / "s2"))

    def run():
        query = ingest_stream(streamed, str(root), str(tmp_path / "chk"), "csv", files_per_trigger=2)
        query.awaitTermination()
        assert query.exception() is None

    run()
    ingest(batch, str(root), "csv")
    for name in ("t", "u"):
        assert table(streamed, name) == table(batch, name)
    before = streamed.imports().count()
    run()
    assert streamed.imports().count() == before == 3
    put(root / "u" / "d.csv", "k\nno\n")
    run()
    assert streamed.imports().count() == 4 and streamed.read_table("u").count() == 2


def test_repeated_and_unfinished_runs(spark, tmp_path, put):
    root = tmp_path / "data"
    put(root / "t" / "a.csv", "id\n1\n")
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        ingest_files(store, str(root), scan_files(spark, str(root), (".csv",)), "csv", Options(), run="batch-7")
    assert store.imports().count() == 1 and store.read_table("t").count() == 1
    put(root / "t" / "b.csv", "id\n2\n")

    def lost(*_):
        raise OSError("driver lost")

    store.commit, real = lost, store.commit
    try:
        ingest(store, str(root), "csv", run="batch-8")
    except OSError:
        pass
    store.commit = real
    assert store.read_table("t").count() == 1 and store.imports().count() == 1
    ingest(store, str(root), "csv", run="batch-8")
    assert table(store, "t") == [("1", "t/a.csv"), ("2", "t/b.csv")]


def test_checkpoints_that_look_alike_lose_nothing(spark, tmp_path, put):
    store = Store(spark, str(tmp_path / "s"))
    for i, chk in enumerate(("c/x", "c-x")):
        put(tmp_path / f"data{i}" / "t" / f"{i}.csv", f"id\n{i}\n")
        query = ingest_stream(store, str(tmp_path / f"data{i}"), str(tmp_path / chk), "csv")
        query.awaitTermination()
        assert query.exception() is None
    assert store.read_table("t").count() == 2
