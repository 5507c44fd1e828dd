"""Queries on value predicates, cleaners, type names and whole-frame cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from folderloom.functions import sqltypes, values
from folderloom.operators import columns
from folderloom.plans import oracle as q
from folderloom.plans.registry import load, load_spread, query


def _messy_numbers(spark, sf):
    kind = F.col("l_linenumber") % 7
    raw = (
        F.when(kind == 0, F.concat(F.lit("$"), "l_extendedprice"))
        .when(kind == 1, F.concat("l_orderkey", F.lit(",000")))
        .when(kind == 2, F.concat(F.lit(" "), "l_discount", F.lit(" %\t")))
        .when(kind == 3, F.concat(F.lit("-"), F.col("l_partkey").cast("string"), F.lit("e3")))
        .when(kind == 4, F.when(F.col("l_partkey") % 2 == 0, "").otherwise("n/a"))
        .when(kind == 5, F.concat(F.lit("+."), F.col("l_suppkey").cast("string")))
        .otherwise(F.when(F.col("l_partkey") % 3 == 0, F.lit(None)).otherwise(
            F.concat("l_orderkey", F.lit("_"), "l_suppkey")))
    )
    return load_spread(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))


_MESSY = r"""(SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7
    WHEN 0 THEN '$' || l_extendedprice WHEN 1 THEN l_orderkey || ',000' WHEN 2 THEN ' ' || l_discount || ' %' || chr(9)
    WHEN 3 THEN '-' || l_partkey || 'e3' WHEN 4 THEN CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 'n/a' END
    WHEN 5 THEN '+.' || l_suppkey
    ELSE CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_orderkey || '_' || l_suppkey END END AS raw FROM lineitem)"""


@query(f"""SELECT l_orderkey, l_linenumber, {q.numeric_text('raw')} AS cleaned, {q.is_numeric('raw')} AS numeric,
    {q.as_bigint('raw')} AS whole, {q.as_double('raw')} AS number FROM {_MESSY}""")
def numeric_clean(spark, sf):
    return _messy_numbers(spark, sf).select(
        "l_orderkey", "l_linenumber", values.numeric_text("raw").alias("cleaned"),
        values.is_numeric("raw").alias("numeric"), values.as_bigint("raw").alias("whole"),
        values.as_double("raw").alias("number"),
    )


@query(f"""SELECT l_orderkey, l_linenumber, cell, CASE WHEN w IN ('true', 'yes', 'y', '1', 't') THEN true
    WHEN w IN ('false', 'no', 'n', '0', 'f') THEN false END AS flag FROM (SELECT l_orderkey, l_linenumber, cell, lower({q.strip('raw')}) AS w FROM (
      SELECT l_orderkey, l_linenumber, unnest([0, 1, 2, 3]) AS cell, unnest([l_returnflag, ' ' || lower(l_linestatus) || chr(9),
      CAST(l_linenumber AS VARCHAR), CAST(l_discount > l_tax AS VARCHAR)]) AS raw FROM lineitem))""")
def boolean_clean(spark, sf):
    """Flags, numbers and comparisons of every line item as text; some of them answer yes or no."""
    cells = F.array("l_returnflag", F.concat(F.lit(" "), F.lower("l_linestatus"), F.lit("\t")), F.col("l_linenumber").cast("string"),
                    (F.col("l_discount") > F.col("l_tax")).cast("string"))
    every = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(cells).alias("cell", "raw"))
    return every.select("l_orderkey", "l_linenumber", "cell", values.as_boolean("raw").alias("flag"))


def _written_dates(spark, sf):
    kind, d = F.col("o_orderkey") % 10, F.col("o_orderdate")
    patterns = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy")
    raw = F.when(kind == 6, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("junk")))
    raw = raw.when(kind == 7, F.concat(F.lit("2024-13-"), F.date_format(d, "dd")))
    raw = raw.when(kind == 8, F.date_format(d, "dd/MM/yyyy")).when(kind == 9, "")
    for i, pattern in enumerate(patterns):
        raw = raw.when(kind == i, F.date_format(d, pattern))
    return load_spread(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))


_DATES = """(SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%b-%Y')
    WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
    WHEN 5 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%d') || 'junk'
    WHEN 7 THEN '2024-13-' || strftime(o_orderdate, '%d') WHEN 8 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE '' END AS raw
    FROM orders)"""
_PARSED = ("try_strptime(raw, ['%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%d/%m/%Y', '%d-%b-%Y', '%Y-%m-%d %H:%M:%S'])")


@query(f"""SELECT o_orderkey, {q.is_date_like('raw')} AS date_like, CAST({_PARSED} AS DATE) AS day,
    CAST({_PARSED} AS TIMESTAMP) AS moment FROM {_DATES}""")
def date_clean(spark, sf):
    return _written_dates(spark, sf).select(
        "o_orderkey", values.is_date_like("raw").alias("date_like"), values.as_date("raw").alias("day"),
        values.as_timestamp("raw").alias("moment"),
    )


@query(f"""SELECT doc_id, nullif({q.strip("CASE WHEN doc_id % 5 = 0 THEN ' ' || chr(9) ELSE chr(10) || ' ' || text || chr(13) || ' ' END")}, '') AS cleaned
    FROM documents""")
def text_clean(spark, sf):
    padded = F.when(F.col("doc_id") % 5 == 0, " \t").otherwise(F.concat(F.lit("\n "), "text", F.lit("\r ")))
    return load(spark, sf, "documents").select("doc_id", values.as_text(padded).alias("cleaned"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax END AS tax,
    CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE l_returnflag END AS flag FROM lineitem""")
def nan_to_null(spark, sf):
    marked = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_tax")).alias("tax"),
        F.when(F.col("l_linenumber") % 3 == 0, "nan").when(F.col("l_linenumber") % 3 == 1, "None")
        .otherwise(F.col("l_returnflag")).alias("flag"),
    )
    return marked.select("l_orderkey", "l_linenumber", values.nan_to_null("tax").alias("tax"),
                         values.nan_text_to_null("flag").alias("flag"))


@query("""WITH ids AS (SELECT doc_id, CASE doc_id % 4
      WHEN 0 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
      WHEN 1 THEN upper(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12))
      WHEN 2 THEN h ELSE source || '.xlsx' END AS v FROM (SELECT *, sha256(text) AS h FROM documents))
    SELECT doc_id, regexp_full_match(lower(v), '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') AS is_uuid,
      CASE WHEN regexp_full_match(v, '[0-9a-fA-F]{64}') THEN 'hash' ELSE 'file' END AS mode FROM ids""")
def id_shapes(spark, sf):
    from folderloom.operators.revert import revert_mode

    h = values.content_hash("text")
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4),
                         F.substring(h, 21, 12))
    kind = F.col("doc_id") % 4
    v = F.when(kind == 0, dashed).when(kind == 1, F.upper(dashed)).when(kind == 2, h).otherwise(
        F.concat("source", F.lit(".xlsx")))
    return load(spark, sf, "documents").select("doc_id", v.alias("v")).select(
        "doc_id", values.is_uuid("v").alias("is_uuid"), revert_mode("v").alias("mode"))


def _json_texts(spark, sf):
    kind, p = F.col("event_id") % 8, F.col("props")
    raw = (
        F.when(kind == 0, p).when(kind == 1, F.concat(p, F.lit(" "), p)).when(kind == 2, F.replace(p, F.lit('"'), F.lit("'")))
        .when(kind == 3, F.concat(F.lit("["), p, F.lit(", "), p, F.lit("]"))).when(kind == 4, F.concat(F.lit("["), p))
        .when(kind == 5, F.concat(F.lit("["), p, F.lit("]}"))).when(kind == 6, F.concat(p, F.lit(",[1]")))
        .otherwise(F.concat(F.lit('{"k": {"k": 1, "q": "it\'s"}, "e": '), p, F.lit("}")))
    )
    return load_spread(spark, sf, "events").select("event_id", raw.alias("raw"))


@query(rf"""SELECT event_id, coalesce({q.is_json('raw')}, false) AS valid FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN props
    WHEN 1 THEN props || ' ' || props WHEN 2 THEN replace(props, '"', chr(39)) WHEN 3 THEN '[' || props || ', ' || props || ']'
    WHEN 4 THEN '[' || props WHEN 5 THEN '[' || props || ']}}' WHEN 6 THEN props || ',[1]'
    ELSE '{{"k": {{"k": 1, "q": "it' || chr(39) || 's"}}, "e": ' || props || '}}' END AS raw FROM events)""")
def json_check(spark, sf):
    return _json_texts(spark, sf).select("event_id", values.is_json("raw").alias("valid"))


@query("SELECT doc_id, sha256(text) AS file_sha256, octet_length(encode(text)) AS length FROM documents")
def content_hashes(spark, sf):
    return load(spark, sf, "documents").select("doc_id", values.content_hash("text").alias("file_sha256"),
                                               F.octet_length("text").cast("bigint").alias("length"))


_TYPE_NAMES = ("int", " INT4", "INT8", "float", "FLOAT8 ", "varchar", "Character Varying", "BIGINT", "NUMERIC(10,2)",
               "VARCHAR(20)", "datetime", "text", "boolean", "REAL")


@query("""WITH t AS (SELECT o_orderkey, ['int', ' INT4', 'INT8', 'float', 'FLOAT8 ', 'varchar', 'Character Varying', 'BIGINT',
      'NUMERIC(10,2)', 'VARCHAR(20)', 'datetime', 'text', 'boolean', 'REAL'][CAST(o_orderkey % 14 AS INT) + 1] AS raw FROM orders)
    SELECT raw AS type_name, CASE trim(upper(raw)) WHEN 'INT' THEN 'INTEGER' WHEN 'INT4' THEN 'INTEGER' WHEN 'INT8' THEN 'BIGINT'
        WHEN 'FLOAT' THEN 'DOUBLE PRECISION' WHEN 'FLOAT8' THEN 'DOUBLE PRECISION' WHEN 'VARCHAR' THEN 'TEXT'
        WHEN 'CHARACTER VARYING' THEN 'TEXT' ELSE trim(upper(raw)) END AS normal,
      CASE WHEN contains(upper(raw), 'INTEGER') THEN 'BIGINT' WHEN contains(upper(raw), 'VARCHAR') THEN 'TEXT'
        WHEN contains(upper(raw), 'NUMERIC') THEN 'DOUBLE PRECISION' WHEN contains(upper(raw), 'DATETIME') THEN 'TIMESTAMP'
        ELSE upper(raw) END AS ranked,
      regexp_matches(upper(raw), 'DOUBLE|INT|REAL|NUMERIC|DECIMAL') AS numeric, count(*) AS n FROM t GROUP BY ALL""")
def type_names(spark, sf):
    raw = F.get(F.array(*[F.lit(t) for t in _TYPE_NAMES]), F.col("o_orderkey") % 14)
    return load(spark, sf, "orders").select(raw.alias("type_name")).select(
        "type_name", sqltypes.normalize_type("type_name").alias("normal"),
        sqltypes.ranked_type("type_name").alias("ranked"), sqltypes.is_numeric_type("type_name").alias("numeric"),
    ).groupBy("type_name", "normal", "ranked", "numeric").agg(F.count(F.lit(1)).alias("n"))


_CLEAN = {"price": "DOUBLE PRECISION", "quantity": "INTEGER", "order_key": "BIGINT", "flag": "BOOLEAN", "ship": "DATE",
          "status": "TEXT", "moment": "TIMESTAMP", "absent": "TEXT"}


@query(f"""SELECT {q.as_double('price')} AS price, CAST({q.as_bigint('quantity')} AS INTEGER) AS quantity,
    {q.as_bigint('order_key')} AS order_key, CASE flag WHEN 'Y' THEN true WHEN 'N' THEN false END AS flag,
    CAST(try_strptime(ship, '%m/%d/%Y') AS DATE) AS ship, nullif(trim(status), '') AS status,
    CAST(moment AS TIMESTAMP) AS moment, untouched
    FROM (SELECT '$' || l_extendedprice AS price, CAST(l_quantity AS BIGINT) || '.7' AS quantity, l_orderkey || ' ' AS order_key,
      CASE l_returnflag WHEN 'A' THEN 'Y' WHEN 'N' THEN 'N' ELSE '?' END AS flag, strftime(l_shipdate, '%m/%d/%Y') AS ship,
      CASE WHEN l_linenumber = 1 THEN '  ' ELSE ' ' || l_linestatus END AS status,
      strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS moment, l_partkey AS untouched FROM lineitem)""")
def clean_frame(spark, sf):
    raw = load_spread(spark, sf, "lineitem").select(
        F.concat(F.lit("$"), "l_extendedprice").alias("price"),
        F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(".7")).alias("quantity"),
        F.concat("l_orderkey", F.lit(" ")).alias("order_key"),
        F.when(F.col("l_returnflag") == "A", "Y").when(F.col("l_returnflag") == "N", "N").otherwise("?").alias("flag"),
        F.date_format("l_shipdate", "MM/dd/yyyy").alias("ship"),
        F.when(F.col("l_linenumber") == 1, "  ").otherwise(F.concat(F.lit(" "), "l_linestatus")).alias("status"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("moment"),
        F.col("l_partkey").alias("untouched"),
    )
    return sqltypes.clean_frame(raw, _CLEAN)


@query(f"""SELECT 'raw' AS column_name, count(*) FILTER ({q.strip('raw')} <> '' AND ({q.as_bigint('raw')}) IS NULL) AS rejected FROM {_MESSY}
    UNION ALL SELECT 'l_linenumber', count(*) FILTER (l_linenumber NOT IN (0, 1)) FROM {_MESSY}""")
def rejected_values(spark, sf):
    return columns.rejected_counts(_messy_numbers(spark, sf), {"raw": "BIGINT", "l_linenumber": "BOOLEAN"})


@query("""SELECT l_orderkey, l_linenumber, a, b, c FROM (SELECT l_orderkey, l_linenumber,
    CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS a, CASE WHEN l_quantity > 40 THEN l_quantity END AS b,
    CASE WHEN l_discount > 0.05 THEN l_discount END AS c FROM lineitem) WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL""")
def drop_empty_rows(spark, sf):
    sparse = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("a"),
        F.when(F.col("l_quantity") > 40, F.col("l_quantity")).alias("b"),
        F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("c"),
    )
    return columns.drop_empty_rows(sparse, ["a", "b", "c"])


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "detail.payload.k", event_type AS "detail.kind" FROM events""")
def json_flatten(spark, sf):
    """The props of every event, parsed and laid flat."""
    payload = F.from_json("props", "k bigint").alias("payload")
    parsed = load(spark, sf, "events").select("event_id", F.struct(payload, F.col("event_type").alias("kind")).alias("detail"))
    return columns.flatten_structs(parsed)
