"""Queries on identifiers, table names, sheets and file selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folderloom.functions import names
from folderloom.operators import columns, ledger, sheets
from folderloom.plans.registry import load, query


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Names, urls and accented text as (origin, id, raw)."""
    part = load(spark, sf, "part").select(F.lit("part").alias("origin"), F.col("p_partkey").alias("id"),
                                          F.concat_ws(" ", "p_partkey", "p_name", "p_brand").alias("raw"))
    cust = load(spark, sf, "customer").select(F.lit("customer"), "c_custkey",
                                              F.concat_ws(".", "c_name", "c_mktsegment"))
    page = load(spark, sf, "pages").select(F.lit("page"), "page_id", "url")
    talk = load(spark, sf, "conversations").select(F.lit("talk"), F.col("conv_id") * 1000 + F.col("turn"), "text")
    return part.union(cust).union(page).union(talk)


_TEXTS = """(SELECT 'part' AS origin, p_partkey AS id, concat_ws(' ', p_partkey, p_name, p_brand) AS raw FROM part
    UNION ALL SELECT 'customer', c_custkey, concat_ws('.', c_name, c_mktsegment) FROM customer
    UNION ALL SELECT 'page', page_id, url FROM pages
    UNION ALL SELECT 'talk', conv_id * 1000 + turn, text FROM conversations)"""
_FOLD = "regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"
_UNDER = "trim(regexp_replace({x}, '[^a-z0-9]+', '_', 'g'), '_')"


def _under(x: str) -> str:
    return _UNDER.format(x=x)


def _fold(x: str) -> str:
    return _FOLD.format(x=x)


@query(f"""SELECT origin, id, CASE WHEN b = '' THEN 'col' WHEN regexp_matches(b, '^[0-9]') THEN '_' || b ELSE b END AS name
    FROM (SELECT origin, id, {_under(_fold('lower(raw)'))} AS b FROM {_TEXTS})""")
def clean_identifier_current(spark, sf):
    return _texts(spark, sf).select("origin", "id", names.clean_identifier("raw", "current").alias("name"))


@query(f"SELECT origin, id, {_under('lower(' + _fold('raw') + ')')} AS name FROM {_TEXTS}")
def clean_identifier_suffix(spark, sf):
    return _texts(spark, sf).select("origin", "id", names.clean_identifier("raw", "suffix").alias("name"))


@query(f"""SELECT origin, id, CASE WHEN regexp_matches(b, '^[0-9]') THEN 'col_' || b ELSE b END AS name
    FROM (SELECT origin, id, {_under("lower(translate(CASE WHEN starts_with(raw, '.') THEN raw ELSE split_part(raw, '.', 1) END, 'ıİğĞüÜşŞöÖçÇ', 'iIgGuUsSoOcC'))")} AS b
          FROM {_TEXTS})""")
def clean_identifier_legacy(spark, sf):
    return _texts(spark, sf).select("origin", "id", names.clean_identifier("raw", "legacy").alias("name"))


@query(f"""SELECT origin, id, CASE WHEN raw IS NULL OR raw = '' THEN 'unnamed'
    ELSE {_under("translate(trim(lower(raw)), 'öçşğüı', 'ocsgui')")} END AS name FROM {_TEXTS}""")
def clean_identifier_upload(spark, sf):
    return _texts(spark, sf).select("origin", "id", names.clean_identifier("raw", "upload").alias("name"))


@query("""SELECT o_orderkey AS order_key, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END,
        c_mktsegment) AS label,
    coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, c_nationkey, o_orderkey) AS owner
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def merge_colliding_columns(spark, sf):
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    wide = o.join(c, o.o_custkey == c.c_custkey, "left").select(
        F.col("o_orderkey").alias("Order Key"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("Label"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("Owner"),
        F.col("c_mktsegment").alias("LABEL "),
        F.col("c_nationkey").cast("bigint").alias("owner!"),
        F.when(F.col("o_orderkey") >= 0, F.col("o_orderkey")).alias("OWNER"),
    )
    return columns.normalize_columns(wide, "current")


@query(r"""WITH words AS (SELECT page_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i
      FROM (SELECT page_id, str_split(regexp_replace(url, '[/.?=&_-]+', ' ', 'g'), ' ') AS w FROM pages)),
    clean AS (SELECT page_id, i, CASE WHEN c = '' THEN 'column' ELSE c END AS c
      FROM (SELECT page_id, i, trim(regexp_replace(lower(word), '[^a-z0-9]+', '_', 'g'), '_') AS c FROM words))
    SELECT page_id, i AS position, CASE WHEN n = 0 THEN c ELSE c || '_' || n END AS name
    FROM (SELECT *, row_number() OVER (PARTITION BY page_id, c ORDER BY i) - 1 AS n FROM clean)""")
def suffix_repeated_names(spark, sf):
    """Each page's url words stand for a header row."""
    words = F.split(F.regexp_replace("url", "[/.?=&_-]+", " "), " ")
    cleaned = F.transform(words, lambda w: names.clean_identifier(w, "suffix", ascii_input=True))
    header = load(spark, sf, "pages").select("page_id", names.suffix_duplicates(cleaned).alias("header"))
    return header.select("page_id", F.posexplode("header").alias("position", "name"))


@query("""SELECT l_orderkey, l_linenumber, 'batch_' || l_returnflag || '.csv' AS source_file FROM lineitem""")
def lineage_columns(spark, sf):
    stamped = columns.with_lineage(load(spark, sf, "lineitem"), F.concat(F.lit("batch_"), "l_returnflag", F.lit(".csv")), "load_date")
    return stamped.select("l_orderkey", "l_linenumber", "source_file")


def _folders(spark: SparkSession, sf: str) -> DataFrame:
    """Relative path of each page: host, language and file, with the scheme and query cut."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$|/+$", "")
    return load(spark, sf, "pages").select("page_id", path.alias("path")).withColumn(
        "folder", F.array_join(names.folder_parts("path"), "/"))


_PATHS = r"""(SELECT page_id, path, regexp_replace(path, '/[^/]*$', '') AS folder FROM
    (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$|/+$', '', 'g') AS path FROM pages))"""


@query(f"""SELECT page_id, lower(replace(folder, '/', '_')) AS table_name,
    CASE WHEN regexp_matches(n, '^[a-z]') THEN n ELSE 't_' || n END AS safe_name,
    CASE WHEN length(path) > 35 THEN '...' || right(path, 32) ELSE path END AS shown
    FROM (SELECT *, CASE WHEN c = '' THEN 'data_table' ELSE c END AS n FROM
      (SELECT *, trim(regexp_replace(lower(split_part(path, '/', -1)), '[^a-z0-9]+', '_', 'g'), '_') AS c FROM {_PATHS}))""")
def table_names(spark, sf):
    return _folders(spark, sf).select(
        "page_id",
        names.table_from_parts(F.split("folder", "/")).alias("table_name"),
        names.safe_table_name(names.base_name("path"), ascii_input=True).alias("safe_name"),
        names.display_path("path").alias("shown"),
    )


@query(f"""SELECT page_id, word, coalesce(regexp_matches(word, '^[A-Za-z_][A-Za-z0-9_]*$')
    AND lower(word) NOT IN ('select', 'insert', 'update', 'delete', 'from', 'where', 'and', 'or', 'not', 'null', 'true',
    'false', 'table', 'create', 'drop', 'alter', 'index', 'primary', 'key', 'foreign', 'references', 'constraint',
    'default', 'unique', 'check', 'auto_increment', 'serial', 'bigserial'), false) AS valid
    FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN split_part(path, '/', -1) WHEN 1 THEN split_part(path, '.', 2)
          ELSE CASE page_id % 2 WHEN 0 THEN 'Select' ELSE '' END END AS word FROM {_PATHS})""")
def valid_identifiers(spark, sf):
    word = F.when(F.col("page_id") % 3 == 0, names.base_name("path")).when(
        F.col("page_id") % 3 == 1, F.split_part("path", F.lit("."), F.lit(2))).otherwise(
        F.when(F.col("page_id") % 2 == 0, "Select").otherwise(""))
    return _folders(spark, sf).select("page_id", word.alias("word")).withColumn(
        "valid", names.is_valid_identifier("word"))


# A folder mapping as users write it: nested folders, some without a sheet of their own.
SHEET_CONFIG = {
    "m.ththth.example.net": {"sheet": "Mobile", "EN": {"sheet": "Policies"}, "fr": {}},
    "spam-farm.example.org": {"en": {"sheet": "Claims"}},
    "en": {"sheet": "English"},
    "es": {"sheet": "Spanish", "sub": {"sheet": "Deep"}},
}
_SHEETS = """(VALUES ('m.ththth.example.net', 'Mobile'), ('m.ththth.example.net/en', 'Policies'),
    ('spam-farm.example.org/en', 'Claims'), ('en', 'English'), ('es', 'Spanish'), ('es/sub', 'Deep')) AS s(prefix, sheet)"""


@query(f"""SELECT page_id, folder, coalesce((SELECT arg_max(sheet, length(prefix)) FROM {_SHEETS}
    WHERE lower(folder) = prefix OR starts_with(lower(folder), prefix || '/')), 'Sheet1') AS sheet FROM {_PATHS}""")
def sheet_resolution_nearest(spark, sf):
    return sheets.resolve_sheets(_folders(spark, sf).select("page_id", "folder"), SHEET_CONFIG)


@query(f"""SELECT page_id, folder, coalesce(sheet, 'Sheet1') AS sheet FROM {_PATHS}
    LEFT JOIN {_SHEETS} ON lower(folder) = prefix""")
def sheet_resolution_exact(spark, sf):
    return sheets.resolve_sheets(_folders(spark, sf).select("page_id", "folder"), SHEET_CONFIG, rule="exact")


@query(f"""SELECT page_id, folder, CASE
      WHEN host = 'm.ththth.example.net' THEN CASE WHEN lang = 'en' THEN 'Policies' WHEN lang = 'fr' THEN 'Sheet1' ELSE 'Mobile' END
      WHEN host = 'spam-farm.example.org' THEN CASE WHEN lang = 'en' THEN 'Claims' ELSE 'Sheet1' END
      WHEN lang = 'en' THEN 'English' WHEN lang = 'es' THEN 'Spanish' ELSE 'Sheet1' END AS sheet
    FROM (SELECT *, split_part(folder, '/', 1) AS host, split_part(folder, '/', 2) AS lang FROM {_PATHS})""")
def sheet_resolution_deepest(spark, sf):
    return sheets.resolve_sheets(_folders(spark, sf).select("page_id", "folder"), SHEET_CONFIG, rule="deepest")


@query(f"SELECT page_id, path FROM {_PATHS} WHERE split_part(path, '/', -1) IN ('25', '853', '960', '474.html')")
def file_whitelist(spark, sf):
    return ledger.by_base_name(_folders(spark, sf).select("page_id", "path"), ["25", "853", "960", "474.html"], "path")


@query(f"""SELECT folder, count(*) AS files, min(path) AS first_file, max(path) AS last_file FROM {_PATHS}
    WHERE contains(path, '/') AND regexp_matches(lower(path), '(/[0-9]+|\\.html)$') GROUP BY folder""")
def folder_listing(spark, sf):
    listed = _folders(spark, sf).filter(F.contains("path", F.lit("/")) & F.lower("path").rlike(r"(/[0-9]+|\.html)$"))
    return listed.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_file"),
                                        F.max("path").alias("last_file"))
