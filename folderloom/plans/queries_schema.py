"""Queries on inference and schema evolution over batches of the event log.

Each (event type, day) is one file of the table of that event type. Columns come and go by day and
change their type, so that the timelines have something to follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folderloom.functions import sqltypes
from folderloom.operators import columns, evolution, inference
from folderloom.plans import oracle as q
from folderloom.plans.staging import Stage
from folderloom.plans.registry import load, load_spread, query

BATCH_COLUMNS = ["event_id", "user_id", "value", "props", "seen", "flag"]


def event_batches(spark: SparkSession, sf: str) -> DataFrame:
    day, kind = F.dayofmonth("ts"), F.col("event_type")
    whole = F.floor("value").cast("string")
    value = (
        F.when(day <= 3, whole)
        .when(day <= 6, (F.floor("value") + F.lit(3_000_000_000)).cast("string"))
        .when((kind == "view") & (day > 20), F.concat(F.lit("v"), whole))
        .otherwise(F.concat(F.lit("$"), F.col("value").cast("string")))
    )
    flag = F.when((kind == "error") & (day > 25), "7").otherwise(F.when(F.col("event_id") % 2 == 0, "Yes").otherwise("n"))
    return load_spread(spark, sf, "events").select(
        F.col("event_type").alias("table_name"),
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(".csv")).alias("file_key"),
        F.col("event_id").cast("string").alias("event_id"),
        F.when(day >= 5, F.col("user_id").cast("string")).alias("user_id"),
        value.alias("value"),
        F.when(day >= 10, F.col("props")).alias("props"),
        F.when(day <= 15, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "MM/dd/yyyy")).alias("seen"),
        flag.alias("flag"),
    )


_BATCHES = """SELECT event_type AS table_name, strftime(ts, '%Y-%m-%d') || '.csv' AS file_key,
    CAST(event_id AS VARCHAR) AS event_id, CASE WHEN day(ts) >= 5 THEN CAST(user_id AS VARCHAR) END AS user_id,
    CASE WHEN day(ts) <= 3 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
      WHEN day(ts) <= 6 THEN CAST(CAST(floor(value) AS BIGINT) + 3000000000 AS VARCHAR)
      WHEN event_type = 'view' AND day(ts) > 20 THEN 'v' || CAST(floor(value) AS BIGINT)
      ELSE '$' || value END AS value,
    CASE WHEN day(ts) >= 10 THEN props END AS props,
    CASE WHEN day(ts) <= 15 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%m/%d/%Y') END AS seen,
    CASE WHEN event_type = 'error' AND day(ts) > 25 THEN '7' WHEN event_id % 2 = 0 THEN 'Yes' ELSE 'n' END AS flag
    FROM events"""
_VOTES = q.count_votes(q.long_form(_BATCHES, "table_name, file_key", BATCH_COLUMNS), "table_name, file_key, column_name")
_TYPES = f"SELECT table_name, file_key, column_name, {q.DECIDE} AS sql_type FROM ({_VOTES})"


def batch_types(spark: SparkSession, sf: str) -> DataFrame:
    inferred = inference.infer_schema(event_batches(spark, sf), ["table_name", "file_key"], BATCH_COLUMNS)
    return inferred.select("table_name", "file_key", "column_name", "sql_type")


@query(f"SELECT *, {q.DECIDE} AS sql_type FROM ({_VOTES})")
def infer_batches(spark, sf):
    return inference.infer_schema(event_batches(spark, sf), ["table_name", "file_key"], BATCH_COLUMNS)


_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE_TEXT = "SELECT * FROM lineitem"


@query(f"""SELECT *, {q.DECIDE} AS sql_type FROM ({q.count_votes(q.long_form(
    _LINE_TEXT, "l_returnflag AS source_file", _LINE_COLUMNS), "source_file, column_name")})""")
def infer_lineitem(spark, sf):
    rows = load_spread(spark, sf, "lineitem").withColumn("source_file", F.col("l_returnflag"))
    return inference.infer_schema(rows, ["source_file"], _LINE_COLUMNS)


@query(f"""SELECT table_name, file_key, column_name, CASE WHEN greatest(n_date, n_bigint, n_double, n_boolean, n_uuid, n_json) < 0.8 * n_values
      THEN 'TEXT' WHEN n_date >= 0.8 * n_values THEN 'DATE'
      WHEN n_bigint >= 0.8 * n_values THEN CASE WHEN max_number < 2147483647 AND min_number > -2147483648 THEN 'INTEGER' ELSE 'BIGINT' END
      WHEN n_double >= 0.8 * n_values THEN 'DOUBLE PRECISION' WHEN n_boolean >= 0.8 * n_values THEN 'BOOLEAN'
      WHEN n_uuid >= 0.8 * n_values THEN 'UUID' ELSE 'JSONB' END AS sql_type FROM ({_VOTES})""")
def infer_split_numbers(spark, sf):
    """Whole and fractional numbers voting apart."""
    inferred = inference.infer_schema(event_batches(spark, sf), ["table_name", "file_key"], BATCH_COLUMNS, compat=True)
    return inferred.select("table_name", "file_key", "column_name", "sql_type")


_MAJORITY_DATE = "try_strptime(trim(value), ['%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%Y/%m/%d'])"


@query(f"""SELECT table_name, column_name, n_rows, n_numeric, n_datetime,
    CASE WHEN n_numeric / n_rows > 0.5 THEN 'numeric' WHEN n_datetime / n_rows > 0.5 THEN 'datetime' ELSE 'text' END AS kind
    FROM (SELECT table_name, column_name, count(*) AS n_rows, count({q.as_double('value')}) AS n_numeric,
      count({_MAJORITY_DATE}) AS n_datetime
      FROM ({q.long_form(_BATCHES, "table_name", BATCH_COLUMNS)}) GROUP BY table_name, column_name)""")
def infer_majority(spark, sf):
    rows = event_batches(spark, sf)
    totals = rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows"))
    return inference.infer_majority(
        inference.cells(rows, ["table_name"], BATCH_COLUMNS), ["table_name", "column_name"], totals)


@query(f"""SELECT l_returnflag, column_name, n_values, sql_type FROM (
    SELECT l_returnflag, 'l_quantity' AS column_name, count(l_quantity) AS n_values,
      CASE WHEN bool_or(l_quantity <> floor(l_quantity)) THEN 'DOUBLE PRECISION' ELSE 'BIGINT' END AS sql_type FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'l_tax', count(l_tax), CASE WHEN bool_or(l_tax <> floor(l_tax)) THEN 'DOUBLE PRECISION' ELSE 'BIGINT' END
      FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'l_orderkey', count(l_orderkey), 'BIGINT' FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'l_shipdate', count(l_shipdate), 'TIMESTAMP' FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'shipped', count(*), 'TIMESTAMP' FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'late', count(*), 'BOOLEAN' FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'l_linestatus', count(l_linestatus), 'TEXT' FROM lineitem GROUP BY 1)""")
def infer_unanimous(spark, sf):
    rows = load_spread(spark, sf, "lineitem").withColumns({
        "shipped": F.date_format("l_shipdate", "MM/dd/yyyy"), "late": F.col("l_discount") > 0.05})
    return inference.infer_unanimous(
        rows, ["l_returnflag"], ["l_quantity", "l_tax", "l_orderkey", "l_shipdate", "shipped", "late", "l_linestatus"])


@query(f"""SELECT table_name, file_key, string_agg(column_name || ' ' || sql_type, ', ' ORDER BY list_position(
    ['event_id', 'user_id', 'value', 'props', 'seen', 'flag'], column_name)) AS schema_text FROM ({_TYPES}) GROUP BY ALL""")
def schema_summary(spark, sf):
    ordinal = F.array_position(F.array(*[F.lit(c) for c in BATCH_COLUMNS]), F.col("column_name"))
    return inference.schema_summary(batch_types(spark, sf).withColumn("ordinal", ordinal), ["table_name", "file_key"])


_PART_COLUMNS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice", "code"]
_PART = """SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'x' || p_size WHEN p_partkey % 7 = 0 THEN NULL
    ELSE '$' || p_size END AS code FROM part"""


def _part_text(spark, sf):
    code = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("x"), "p_size")).when(
        F.col("p_partkey") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("$"), "p_size"))
    return load(spark, sf, "part").withColumn("code", code)


@query(f"""SELECT column_name, count(*) FILTER (value IS NOT NULL AND ({q.as_double('value')}) IS NULL) AS non_numeric
    FROM ({q.long_form(_PART, "p_partkey", _PART_COLUMNS)}) GROUP BY column_name""")
def non_numeric_columns(spark, sf):
    return columns.non_numeric_counts(_part_text(spark, sf), _PART_COLUMNS)


@query(f"""WITH r AS (SELECT column_name, count(*) FILTER (value IS NOT NULL AND ({q.as_double('value')}) IS NULL) AS bad
      FROM ({q.long_form(_PART, "p_partkey", _PART_COLUMNS)}) GROUP BY column_name),
    reg(column_name, sql_type) AS (VALUES ('p_name', 'TEXT'), ('p_size', 'INTEGER'), ('p_retailprice', 'DOUBLE PRECISION'),
      ('code', 'INTEGER'), ('p_type', 'BOOLEAN'))
    SELECT 'part' AS table_name, column_name, sql_type AS old_type, CASE WHEN bad > 0 AND
      regexp_matches(sql_type, 'DOUBLE|INT|REAL|NUMERIC|DECIMAL') THEN 'TEXT' ELSE sql_type END AS new_type FROM reg JOIN r USING (column_name)""")
def force_numeric_to_text(spark, sf):
    rejects = columns.non_numeric_counts(_part_text(spark, sf), _PART_COLUMNS).withColumn("table_name", F.lit("part"))
    registered = spark.createDataFrame(
        [("part", c, t) for c, t in (("p_name", "TEXT"), ("p_size", "INTEGER"), ("p_retailprice", "DOUBLE PRECISION"),
                                     ("code", "INTEGER"), ("p_type", "BOOLEAN"))],
        "table_name string, column_name string, sql_type string")
    return evolution.force_text(registered, rejects)


_LATTICE = ("SMALLINT", "INTEGER", "BIGINT", "REAL", "DOUBLE PRECISION", "BOOLEAN", "DATE", "TIMESTAMP", "TEXT")
_PAIRS = """(SELECT l[CAST(o_orderkey % 9 AS INT) + 1] AS a, l[CAST((o_orderkey // 9) % 9 AS INT) + 1] AS b FROM (SELECT o_orderkey,
    ['SMALLINT', 'INTEGER', 'BIGINT', 'REAL', 'DOUBLE PRECISION', 'BOOLEAN', 'DATE', 'TIMESTAMP', 'TEXT'] AS l FROM orders))"""
_NUM = "('SMALLINT', 'INTEGER', 'BIGINT', 'REAL', 'DOUBLE PRECISION')"
_RANK = """CASE {x} WHEN 'SMALLINT' THEN 1 WHEN 'INTEGER' THEN 2 WHEN 'BIGINT' THEN 3 WHEN 'REAL' THEN 4 WHEN 'DOUBLE PRECISION' THEN 5
    WHEN 'DATE' THEN 1 WHEN 'TIMESTAMP' THEN 2 ELSE 0 END"""
_BRANK = """CASE {x} WHEN 'BOOLEAN' THEN 1 WHEN 'INTEGER' THEN 2 WHEN 'BIGINT' THEN 2 WHEN 'DOUBLE PRECISION' THEN 3
    WHEN 'TIMESTAMP' THEN 4 WHEN 'TEXT' THEN 5 ELSE 0 END"""
_BNAME = "CASE WHEN {x} = 'INTEGER' THEN 'BIGINT' ELSE {x} END"


def _allowed(a: str, b: str) -> str:
    return f"""({b} = 'TEXT' OR ({a} IN {_NUM} AND {b} IN {_NUM} AND {b} <> 'REAL' AND ({_RANK.format(x=a)}) < ({_RANK.format(x=b)})
        AND ({a} <> 'REAL' OR {b} = 'DOUBLE PRECISION')) OR ({a} = 'DATE' AND {b} = 'TIMESTAMP'))"""


@query(f"""SELECT a AS current_type, b AS incoming_type, count(*) AS n,
    CASE WHEN a = b THEN a WHEN a IN {_NUM} AND b IN {_NUM} THEN CASE WHEN 'REAL' IN (a, b) THEN 'DOUBLE PRECISION'
        WHEN ({_RANK.format(x='a')}) > ({_RANK.format(x='b')}) THEN a ELSE b END
      WHEN a IN ('DATE', 'TIMESTAMP') AND b IN ('DATE', 'TIMESTAMP') THEN 'TIMESTAMP' ELSE 'TEXT' END AS lub,
    CASE WHEN a = b THEN a WHEN {_allowed('a', 'b')} THEN b ELSE 'TEXT' END AS chain,
    CASE WHEN ({_BRANK.format(x='b')}) > ({_BRANK.format(x='a')}) THEN {_BNAME.format(x='b')} ELSE {_BNAME.format(x='a')} END AS ranked,
    CASE WHEN a = b THEN a WHEN a = 'SMALLINT' AND b IN ('INTEGER', 'BIGINT') THEN b WHEN a = 'INTEGER' AND b = 'BIGINT' THEN b
      WHEN a = 'REAL' AND b = 'DOUBLE PRECISION' THEN a ELSE 'TEXT' END AS pairs,
    CASE WHEN (a, b) IN (('SMALLINT', 'INTEGER'), ('INTEGER', 'BIGINT'), ('INTEGER', 'DOUBLE PRECISION'), ('REAL', 'DOUBLE PRECISION'))
      THEN b ELSE a END AS safe
    FROM {_PAIRS} GROUP BY a, b""")
def widening_policies(spark, sf):
    names = F.array(*[F.lit(t) for t in _LATTICE])
    ninth = F.floor(F.col("o_orderkey") / 9)
    pairs = load(spark, sf, "orders").select(
        F.get(names, F.col("o_orderkey") % 9).alias("current_type"), F.get(names, ninth % 9).alias("incoming_type"))
    counted = pairs.groupBy("current_type", "incoming_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("*", *[sqltypes.resolve_column("current_type", "incoming_type", p).alias(p)
                                 for p in sqltypes.POLICIES])


# Every file in order with the least upper bound of all types up to it.
_RUNNING = f"""SELECT table_name, column_name, file_key, CASE WHEN fams > 1 OR has_text THEN 'TEXT' WHEN num > 0 THEN
      ['SMALLINT', 'INTEGER', 'BIGINT', 'REAL', 'DOUBLE PRECISION'][num] ELSE sql_type END AS t FROM (
    SELECT *, max(CASE WHEN sql_type IN {_NUM} THEN {_RANK.format(x='sql_type')} ELSE 0 END) OVER w AS num,
      bool_or(sql_type = 'TEXT') OVER w AS has_text,
      max(CASE WHEN sql_type IN {_NUM} THEN 1 ELSE 0 END) OVER w + max(CASE WHEN sql_type = 'BOOLEAN' THEN 1 ELSE 0 END) OVER w
      + max(CASE WHEN sql_type = 'DATE' THEN 1 ELSE 0 END) OVER w + max(CASE WHEN sql_type = 'JSONB' THEN 1 ELSE 0 END) OVER w AS fams
    FROM ({_TYPES}) WINDOW w AS (PARTITION BY table_name, column_name ORDER BY file_key))"""
_STATES = f"""SELECT * FROM (SELECT table_name, column_name, file_key,
    lag(t) OVER (PARTITION BY table_name, column_name ORDER BY file_key) AS old_type, t AS new_type FROM ({_RUNNING}))
    WHERE old_type IS NULL OR old_type <> new_type"""


@query(_STATES)
def schema_timeline(spark, sf):
    return evolution.column_states(batch_types(spark, sf))


def _log(states: str) -> str:
    return f"""WITH states AS ({states}), born AS (SELECT table_name, min(file_key) AS b FROM ({_TYPES}) GROUP BY 1)
    SELECT table_name, 'create_table' AS change_type, NULL::VARCHAR AS column_name, NULL::VARCHAR AS old_type, NULL::VARCHAR AS new_type,
      b AS source_file FROM born
    UNION ALL SELECT table_name, CASE WHEN old_type IS NULL THEN 'add_column' ELSE 'alter_type' END, column_name, old_type, new_type, file_key
      FROM states JOIN born USING (table_name) WHERE old_type IS NOT NULL OR file_key > b"""


@query(_log(_STATES))
def change_log(spark, sf):
    return evolution.change_log(batch_types(spark, sf))


# Order-dependent widening: the state follows the previous file until a type that is not reachable.
_CHAIN_STATES = f"""SELECT table_name, column_name, file_key, old_type, new_type FROM (
    SELECT *, CASE WHEN absorbed_before THEN 'TEXT' ELSE prev END AS old_type,
      CASE WHEN absorbed THEN 'TEXT' ELSE sql_type END AS new_type FROM (
      SELECT *, coalesce(bool_or(bad) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS absorbed_before,
        bool_or(bad) OVER w AS absorbed FROM (
        SELECT *, prev IS NOT NULL AND prev <> sql_type AND NOT {_allowed('prev', 'sql_type')} AS bad FROM (
          SELECT *, lag(sql_type) OVER w AS prev FROM ({_TYPES}) WINDOW w AS (PARTITION BY table_name, column_name ORDER BY file_key)))
      WINDOW w AS (PARTITION BY table_name, column_name ORDER BY file_key)))
    WHERE old_type IS NULL OR old_type <> new_type OR (old_type = 'TEXT' AND sql_type <> 'TEXT')"""


@query(_log(_CHAIN_STATES))
def change_log_chain(spark, sf):
    # Followed step by step, so the small types table is staged instead of inferred again each time.
    types = Stage(spark).keep(batch_types(spark, sf), "types")
    return evolution.change_log(types, policy="chain", relog=True)


_RANKED_STATES = f"""SELECT * FROM (SELECT table_name, column_name, file_key, lag(t) OVER w AS old_type, t AS new_type FROM (
    SELECT table_name, column_name, file_key, {_BNAME.format(x="arg_max(sql_type, " + _BRANK.format(x='sql_type') + ") OVER (PARTITION BY table_name, column_name ORDER BY file_key)")} AS t
    FROM ({_TYPES})) WINDOW w AS (PARTITION BY table_name, column_name ORDER BY file_key)) WHERE old_type IS NULL OR old_type <> new_type"""


@query(_RANKED_STATES)
def schema_timeline_ranked(spark, sf):
    return evolution.column_states(batch_types(spark, sf), policy="ranked")


@query(f"""SELECT table_name, column_name, arg_max(t, file_key) AS sql_type FROM ({_RUNNING}) GROUP BY ALL""")
def final_schema(spark, sf):
    return evolution.final_types(batch_types(spark, sf))


@query(f"""SELECT DISTINCT table_name, column_name FROM ({_TYPES}) WHERE file_key > '2024-01-09.csv'
    EXCEPT SELECT table_name, column_name FROM ({_TYPES}) WHERE file_key <= '2024-01-09.csv'""")
def new_columns(spark, sf):
    types = batch_types(spark, sf)
    return evolution.new_columns(types.filter("file_key > '2024-01-09.csv'"), types.filter("file_key <= '2024-01-09.csv'"))


@query("""SELECT l_orderkey AS id, CAST(l_quantity AS DOUBLE) AS amount, NULL::VARCHAR AS note, CAST(CAST(l_partkey AS BIGINT) AS VARCHAR) AS code
      FROM lineitem WHERE l_linestatus = 'F'
    UNION ALL SELECT l_orderkey, l_extendedprice, l_returnflag, l_returnflag || l_suppkey FROM lineitem WHERE l_linestatus = 'O'""")
def append_evolved(spark, sf):
    rows = load(spark, sf, "lineitem")
    old = rows.filter("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("int").alias("amount"), F.col("l_partkey").alias("code"))
    new = rows.filter("l_linestatus = 'O'").select(
        F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("note"),
        F.concat("l_returnflag", "l_suppkey").alias("code"))
    return columns.append_frames([old, new], {"id": "BIGINT", "amount": "DOUBLE PRECISION", "note": "TEXT", "code": "TEXT"})


@query("SELECT l_orderkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem")
def widen_to_text(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("quantity"),
                                              F.col("l_linenumber").alias("line"))
    return columns.align(rows, {"quantity": "TEXT", "line": "TEXT"}, keep=["l_orderkey"])
