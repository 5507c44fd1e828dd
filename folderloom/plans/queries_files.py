"""Queries that go through files: tables are written as folder trees, imported, and read back."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folderloom.plans.ingest import Options, ingest, ingest_files
from folderloom.plans.queries_schema import event_batches
from folderloom.plans.registry import load, query
from folderloom.plans.staging import Stage
from folderloom.plans.store import Store
from folderloom.sources import files as file_source
from folderloom.sources import workbook
from folderloom.sources.delimited import CSV_OPTIONS
from folderloom.streaming.incremental import ingest_stream


def _event_tree(spark: SparkSession, sf: str, root: str) -> None:
    """One folder per event type, CSV files of text columns."""
    event_batches(spark, sf).drop("file_key").write.partitionBy("table_name").options(**CSV_OPTIONS).csv(root)


def _union(store: Store, columns: list[str]) -> DataFrame:
    tables = sorted(r[0] for r in store.tables().collect())
    return reduce(DataFrame.unionByName, [
        store.read_table(t).select(F.lit(t).alias("table_name"), *columns) for t in tables])


_EVENTS = """SELECT 'table_name_' || event_type AS table_name, CAST(event_id AS INTEGER) AS event_id,
    CASE WHEN day(ts) >= 5 THEN CAST(user_id AS INTEGER) END AS user_id, CASE WHEN day(ts) >= 10 THEN props END AS props,
    CAST(ts AS DATE) AS seen FROM events"""


@query(_EVENTS)
def ingest_csv_tables(spark, sf):
    stage = Stage(spark)
    _event_tree(spark, sf, f"{stage.root}/tree")
    store = Store(spark, f"{stage.root}/store")
    ingest(store, f"{stage.root}/tree", "csv")
    return _union(store, ["event_id", "user_id", "props", "seen"])


@query("""SELECT 'status_' || lower(o_orderstatus) AS table_name, CAST(o_orderkey AS INTEGER) AS id, o_totalprice AS price,
    o_orderpriority AS detail_priority FROM orders""")
def ingest_json_stream(spark, sf):
    """The same through the incremental form, at most 100 files per trigger."""
    stage = Stage(spark)
    nested = load(spark, sf, "orders").select(
        F.concat(F.lit("status_"), "o_orderstatus").alias("folder"), F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("price"), F.struct(F.col("o_orderpriority").alias("Priority")).alias("detail"))
    nested.write.partitionBy("folder").json(f"{stage.root}/tree")
    store = Store(spark, f"{stage.root}/store")
    running = ingest_stream(store, f"{stage.root}/tree", f"{stage.root}/stream", "json", files_per_trigger=100,
                            json_lines=True, table_naming="path")
    running.awaitTermination()
    tables = sorted(r[0] for r in store.tables().collect())
    return reduce(DataFrame.unionByName, [store.read_table(t).select(
        F.replace(F.lit(t), F.lit("folder_"), F.lit("")).alias("table_name"), "id", "price", "detail_priority") for t in tables])


@query("""SELECT source AS folder, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM documents WHERE source <> 'src7' GROUP BY source""")
def revert_after_ingest(spark, sf):
    """Documents imported by source folder; the files of one folder are reverted."""
    stage = Stage(spark)
    docs = load(spark, sf, "documents").select("doc_id", "n_chars", "source")
    docs.write.partitionBy("source").options(**CSV_OPTIONS).csv(f"{stage.root}/tree")
    store = Store(spark, f"{stage.root}/store")
    listed = file_source.scan_files(spark, f"{stage.root}/tree", (".csv",))
    flat = listed.withColumn("folder", F.lit("docs"))
    ingest_files(store, f"{stage.root}/tree", flat, "csv", Options())
    store.revert_imports(store.imports().filter("source_file LIKE '%source=src7/%'"))
    folder = F.regexp_extract("source_file", "source=([^/]+)/", 1)
    return store.read_table("docs").groupBy(folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"))


BOOK_ROWS = 2000


def _book(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """One workbook: rows of two to four cells under a header of three; every fourth file lacks the sheet, one is torn."""
    folder, number = key
    rows = [["Order Key", "Total Price", "Priority"]]
    for r in frame.sort_values("o_orderkey").itertuples():
        cells = [int(r.o_orderkey), float(r.o_totalprice), r.o_orderpriority, int(r.o_custkey)]
        rows.append(cells[:2] if r.o_orderkey % 7 == 0 else cells if r.o_orderkey % 5 == 0 else cells[:3])
    sheets = {"Notes": [["Text"], ["see the other sheet"]], "Other" if number % 4 == 3 else "Orders": rows}
    content = workbook.workbook_bytes(sheets, workbook.SEPARATOR)
    if (folder, number) == ("status_o", 1):
        content = content[:len(content) // 2]
    return pd.DataFrame([(folder, f"book{number}.xlsx", content)], columns=["folder", "name", "content"])


def _workbook_tree(spark: SparkSession, sf: str, root: str) -> None:
    """Orders as workbooks of about BOOK_ROWS rows, a folder per status; their number grows with the table."""
    orders = load(spark, sf, "orders").withColumn("folder", F.concat(F.lit("status_"), F.lower("o_orderstatus")))
    n = orders.groupBy("folder").agg(F.ceil(F.count(F.lit(1)) / BOOK_ROWS).cast("long").alias("_books"))
    dealt = orders.join(F.broadcast(n), "folder").withColumn("number", F.col("o_orderkey") % F.col("_books"))  # a row per status
    books = dealt.select("folder", "number", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").groupBy(
        "folder", "number").applyInPandas(_book, "folder string, name string, content binary")
    workbook.write_workbooks(books, root)


_BOOKS = f"""SELECT *, 'status_' || lower(o_orderstatus) AS folder,
    o_orderkey % CAST(ceil(count(*) OVER (PARTITION BY o_orderstatus) / {BOOK_ROWS}) AS BIGINT) AS number FROM orders"""
_GOOD_BOOK = "number % 4 <> 3 AND NOT (folder = 'status_o' AND number = 1)"


@query(f"""SELECT folder AS table_name, CAST(o_orderkey AS INTEGER) AS order_key, o_totalprice AS total_price,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 THEN CAST(o_custkey AS INTEGER) END AS extra_col_3
    FROM ({_BOOKS}) WHERE {_GOOD_BOOK}""")
def workbook_scan(spark, sf):
    """One configured sheet of every workbook: ragged rows, files without the sheet, a torn file."""
    stage = Stage(spark)
    _workbook_tree(spark, sf, f"{stage.root}/tree")
    store = Store(spark, f"{stage.root}/store")
    ingest(store, f"{stage.root}/tree", "workbook", default_sheet="Orders")
    return _union(store, ["order_key", "total_price", "priority", "extra_col_3"])


@query(f"""SELECT folder || '/book' || number || '.xlsx' AS source_file,
    CASE WHEN folder = 'status_o' AND number = 1 THEN 'error' WHEN number % 4 = 3 THEN 'skipped' ELSE 'success' END AS status,
    CASE WHEN {_GOOD_BOOK} THEN count(*) ELSE 0 END AS row_count FROM ({_BOOKS}) GROUP BY folder, number""")
def workbook_outcomes(spark, sf):
    """What became of every workbook, missing sheets and the torn one included; a dry run, which writes no row."""
    stage = Stage(spark)
    _workbook_tree(spark, sf, f"{stage.root}/tree")
    done = ingest(Store(spark, f"{stage.root}/store"), f"{stage.root}/tree", "workbook", default_sheet="Orders", dry_run=True)
    return done.outcomes.select("source_file", "status", "row_count")


@query(f"""SELECT folder AS table_name, count(*) AS rows, sum(CAST(o_orderkey AS BIGINT))::BIGINT AS keys
    FROM ({_BOOKS}) WHERE NOT (folder = 'status_o' AND number = 1) GROUP BY folder""")
def workbook_all_sheets(spark, sf):
    """Every sheet of every workbook; the tables of the two order sheets are put together again."""
    stage = Stage(spark)
    _workbook_tree(spark, sf, f"{stage.root}/tree")
    store = Store(spark, f"{stage.root}/store")
    ingest(store, f"{stage.root}/tree", "workbook", all_sheets=True)
    kept = [r[0] for r in store.tables().collect() if r[0].endswith(("_orders", "_other"))]
    rows = reduce(DataFrame.unionByName, [store.read_table(t).select(F.lit(t).alias("sheet_table"), "order_key") for t in kept])
    return rows.groupBy(F.regexp_replace("sheet_table", "_(orders|other)$", "").alias("table_name")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("order_key").cast("long")).alias("keys"))


@query(f"""SELECT folder || '/book' || number || '.xlsx' AS source_file, number % 4 <> 3 AND NOT (folder = 'status_o' AND number = 1) AS sheet_exists,
    CASE WHEN {_GOOD_BOOK} THEN count(*) ELSE 0 END AS row_count,
    CASE WHEN {_GOOD_BOOK} THEN 'order_key,total_price,priority' || CASE WHEN bool_or(o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0)
    THEN ',extra_col_3' ELSE '' END ELSE '' END AS columns FROM ({_BOOKS}) GROUP BY folder, number""")
def workbook_info(spark, sf):
    """Rows and columns of one sheet for every workbook, the ones without it included."""
    stage = Stage(spark)
    _workbook_tree(spark, sf, f"{stage.root}/tree")
    listed = file_source.list_files(spark, f"{stage.root}/tree")
    contents = file_source.binary_files(spark, f"{stage.root}/tree").select(
        file_source.relative_path("path", f"{stage.root}/tree").alias("source_file"), "content")
    blocks = stage.keep(workbook.decode_workbooks(contents), "blocks")
    return workbook.file_info(listed, blocks, "Orders").select(
        "source_file", "sheet_exists", "row_count", F.array_join("columns", ",").alias("columns"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 11 = 0 AS rejected, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def bulk_load(spark, sf):
    """Orders as CSV, each eleventh with a price that is none, loaded twice under a declared schema: rows and rejects together."""
    stage = Stage(spark)
    price = F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), price.alias("price"), F.to_date("o_orderdate").alias("day")).write.options(
        **CSV_OPTIONS).csv(f"{stage.root}/tree")
    store = Store(spark, f"{stage.root}/store")
    for _ in range(2):
        store.load_csv("orders", f"{stage.root}/tree", {"id": "BIGINT", "price": "DOUBLE PRECISION", "day": "DATE"})
    rows = store.read_table("orders").select("id", F.lit(False).alias("rejected"), "price", "day")
    return rows.unionByName(store.rejects().select(F.substring_index("record", ",", 1).cast("bigint").alias("id"), F.lit(True).alias("rejected")),
                            allowMissingColumns=True)


def _loaded(spark: SparkSession, rows: DataFrame, table: str, schema: dict[str, str]) -> Store:
    """A store whose table holds the rows, by a bulk load."""
    stage = Stage(spark)
    rows.select(*schema).write.options(**CSV_OPTIONS).csv(f"{stage.root}/tree")
    store = Store(spark, f"{stage.root}/store")
    store.load_csv(table, f"{stage.root}/tree", schema)
    return store


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01'")
def filtered_scan(spark, sf):
    """Some rows of a table of the store; the conditions reach its Parquet scan."""
    store = _loaded(spark, load(spark, sf, "lineitem"), "lineitem", {
        "l_orderkey": "BIGINT", "l_linenumber": "BIGINT", "l_quantity": "DOUBLE PRECISION", "l_returnflag": "TEXT", "l_shipdate": "TIMESTAMP"})
    chosen = store.read_table("lineitem").filter("l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01'")
    types = load(spark, sf, "lineitem").schema
    return chosen.select(*[F.col(c).cast(types[c].dataType) for c in ("l_orderkey", "l_linenumber", "l_quantity")])


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def sample_rows(spark, sf):
    """The first rows of a table of the store."""
    store = _loaded(spark, load(spark, sf, "orders"), "orders", {"o_orderkey": "BIGINT", "o_orderstatus": "TEXT"})
    return store.read_table("orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").limit(5)


@query("""SELECT o_orderstatus, count(*) AS orders, max(o_orderkey)::BIGINT AS last FROM orders WHERE o_totalprice >= 1000 AND o_orderpriority = '1-URGENT'
    GROUP BY o_orderstatus""")
def parameterised_sql(spark, sf):
    """SQL with named parameters over a table of the store."""
    store = _loaded(spark, load(spark, sf, "orders"), "orders", {
        "o_orderkey": "BIGINT", "o_orderstatus": "TEXT", "o_totalprice": "DOUBLE PRECISION", "o_orderpriority": "TEXT"})
    return store.sql("SELECT o_orderstatus, count(*) AS orders, max(o_orderkey) AS last FROM orders "
                     "WHERE o_totalprice >= :least AND o_orderpriority = :priority GROUP BY o_orderstatus",
                     {"least": 1000, "priority": "1-URGENT"})


@query("""SELECT source AS folder, count(*) AS rows, sum(n_chars)::BIGINT AS chars, count(*) AS stored FROM documents
    WHERE source <> 'src7' GROUP BY source""")
def purge_after_revert(spark, sf):
    """Documents imported by source folder; one folder is reverted and purged, then the stored rows are counted as well."""
    stage = Stage(spark)
    docs = load(spark, sf, "documents").select("doc_id", "n_chars", "source")
    docs.write.partitionBy("source").options(**CSV_OPTIONS).csv(f"{stage.root}/tree")
    store = Store(spark, f"{stage.root}/store")
    listed = file_source.scan_files(spark, f"{stage.root}/tree", (".csv",))
    ingest_files(store, f"{stage.root}/tree", listed.withColumn("folder", F.lit("docs")), "csv", Options())
    store.revert_imports(store.imports().filter("source_file LIKE '%source=src7/%'"))
    store.purge(grace_seconds=0)
    folder = F.regexp_extract("source_file", "source=([^/]+)/", 1).alias("folder")
    stored = spark.read.option("recursiveFileLookup", True).parquet(f"{store.root}/data/docs").groupBy(folder).agg(F.count(F.lit(1)).alias("stored"))
    live = store.read_table("docs").groupBy(folder).agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"))
    return live.join(stored, "folder", "full")
