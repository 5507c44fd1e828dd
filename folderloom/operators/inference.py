"""Type inference over all files and columns at once.

A value votes once; votes are counted by (file, column) with map-side partial aggregation, so
what is shuffled is one small row per file and column and task, never the values themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folderloom.functions import values
from folderloom.functions.sqltypes import spark_field
from folderloom.operators.columns import quoted

# Acceptance share of the winning type, and the bounds of INTEGER.
ACCEPT_SHARE = 0.8
INTEGER_BELOW, INTEGER_ABOVE = 2147483647, -2147483648
VOTE_ORDER = ("DATE", "BIGINT", "DOUBLE PRECISION", "BOOLEAN", "UUID", "JSONB")
_SHORT = {"DATE": "date", "BIGINT": "bigint", "DOUBLE PRECISION": "double", "BOOLEAN": "boolean",
          "UUID": "uuid", "JSONB": "json"}


def cells(df: DataFrame, by: Sequence[str], columns: Sequence[str], name: str = "column_name") -> DataFrame:
    """Long form ``(*by, column_name, value)`` with text values; null cells are left out."""
    text = df.select(*by, *[values.render_text(quoted(c), df.schema[c].dataType.simpleString()).alias(c)
                            for c in columns])
    long = text.unpivot([F.col(b) for b in by], [quoted(c) for c in columns], name, "value")
    return long.filter(F.col("value").isNotNull())


def count_votes(cell_rows: DataFrame, by: Sequence[str], compat: bool = False) -> DataFrame:
    """One row per group with the votes for each type, the non-null count and the numeric range."""
    voted = cell_rows.select(
        *by, values.vote("value", compat).alias("vote"), values.as_double("value").alias("number")
    )
    return voted.groupBy(*by).agg(
        *[F.count_if(F.col("vote") == t).alias(f"n_{_SHORT[t]}") for t in VOTE_ORDER],
        F.count("vote").alias("n_values"),
        F.min("number").alias("min_number"),
        F.max("number").alias("max_number"),
    )


def decide_type(compat: bool = False) -> Column:
    """The type of a column from its votes.

    Whole and fractional numbers are pooled; ``compat`` counts them apart, so that a column
    of both may fall under the acceptance share.
    """
    n = {t: F.col(f"n_{_SHORT[t]}") for t in VOTE_ORDER}
    if not compat:
        numbers = n["BIGINT"] + n["DOUBLE PRECISION"]
        n["BIGINT"] = F.when(n["DOUBLE PRECISION"] == 0, numbers).otherwise(F.lit(0))
        n["DOUBLE PRECISION"] = F.when(F.col("n_double") > 0, numbers).otherwise(F.lit(0))
    ranked = F.array(*[F.struct(n[t].cast("bigint").alias("votes"), F.lit(-i).alias("order"), F.lit(t).alias("type"))
                       for i, t in enumerate(VOTE_ORDER)])
    best = F.array_max(ranked)
    winner = best.getField("type")
    fits = (F.col("max_number") < INTEGER_BELOW) & (F.col("min_number") > INTEGER_ABOVE)
    share = best.getField("votes") / F.nullif(F.col("n_values"), F.lit(0))
    return (
        F.when(F.coalesce(share, F.lit(0.0)) < ACCEPT_SHARE, "TEXT")
        .when((winner == "BIGINT") & fits, "INTEGER")
        .otherwise(winner)
    )


def infer_types(votes: DataFrame, compat: bool = False, text_on_misfit: bool = False) -> DataFrame:
    """Votes with ``sql_type``. With ``text_on_misfit`` a numeric column that holds any other value is TEXT."""
    decided = decide_type(compat)
    if text_on_misfit:
        misfit = F.col("n_bigint") + F.col("n_double") < F.col("n_values")
        decided = F.when(decided.isin("INTEGER", "BIGINT", "DOUBLE PRECISION") & misfit, "TEXT").otherwise(decided)
    return votes.withColumn("sql_type", decided)


def infer_schema(df: DataFrame, by: Sequence[str], columns: Sequence[str], compat: bool = False) -> DataFrame:
    """(*by, column_name, votes..., sql_type) of a text frame. A column without values is absent."""
    keys = [*by, "column_name"]
    return infer_types(count_votes(cells(df, by, columns), keys, compat), compat)


def with_empty_columns(inferred: DataFrame, headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the header columns that hold no value at all, as TEXT. One join, so that the values are gone through once."""
    types = inferred.select(*keys, "sql_type", F.lit(True).alias("_held"))
    return types.join(headers.select(*keys).distinct(), list(keys), "full").select(
        *keys, F.when(F.col("_held"), F.col("sql_type")).otherwise("TEXT").alias("sql_type"))


def infer_majority(cell_rows: DataFrame, by: Sequence[str], totals: DataFrame | None = None) -> DataFrame:
    """numeric if over half of all rows are numbers, else datetime if over half are dates, else text.

    The share is taken over all rows, null cells included: ``cell_rows`` carries them, or ``totals``
    (*group columns*, n_rows) gives the row counts.
    """
    agg = cell_rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count(values.as_double("value")).alias("n_numeric"),
        F.count(values.as_timestamp("value")).alias("n_datetime"),
    )
    if totals is not None:
        agg = agg.join(totals, [c for c in totals.columns if c != "n_rows"])
    else:
        agg = agg.withColumnRenamed("n_cells", "n_rows")
    kind = (
        F.when(F.col("n_numeric") / F.col("n_rows") > 0.5, "numeric")
        .when(F.col("n_datetime") / F.col("n_rows") > 0.5, "datetime")
        .otherwise("text")
    )
    return agg.select(*by, "n_rows", "n_numeric", "n_datetime", kind.alias("kind"))


def majority_types(cell_rows: DataFrame, keys: Sequence[str], totals: DataFrame) -> DataFrame:
    """(*keys, sql_type) by majority: BIGINT only where every row holds a whole number, a numeric column
    with gaps or fractions is DOUBLE PRECISION, dates are TIMESTAMP."""
    kinds = infer_majority(cell_rows, keys, totals)
    whole = cell_rows.groupBy(*keys).agg(F.count_if(F.col("value").rlike(r"^\s*[+-]?\d+\s*$")).alias("n_whole"))
    numeric = F.when(F.col("n_whole") == F.col("n_rows"), "BIGINT").otherwise("DOUBLE PRECISION")
    return kinds.join(whole, list(keys)).select(
        *keys, F.when(F.col("kind") == "numeric", numeric).when(F.col("kind") == "datetime", "TIMESTAMP")
        .otherwise("TEXT").alias("sql_type"))


def unanimous_types(cell_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, sql_type) on which all text values agree: BOOLEAN, BIGINT, DOUBLE PRECISION, TIMESTAMP or TEXT."""
    number = values.as_double("value")
    every = lambda test: F.bool_and(F.coalesce(test, F.lit(False)))
    agg = cell_rows.groupBy(*keys).agg(
        every(F.lower("value").isin("true", "false")).alias("boolean"),
        every(number.isNotNull()).alias("numeric"),
        every(number % 1 == 0).alias("whole"),
        every(values.as_timestamp("value").isNotNull()).alias("datetime"),
    )
    return agg.select(*keys, F.when(F.col("boolean"), "BOOLEAN").when(F.col("whole"), "BIGINT")
                      .when(F.col("numeric"), "DOUBLE PRECISION").when(F.col("datetime"), "TIMESTAMP")
                      .otherwise("TEXT").alias("sql_type"))


def infer_unanimous(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Types on which all non-null values agree, by native type first: one row per group and column."""
    aggregates, picks = [], []
    for i, name in enumerate(columns):
        c, kind, flag = quoted(name), df.schema[name].dataType, F.col(f"f{i}")
        aggregates.append(F.count(c).alias(f"n{i}"))
        if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            aggregates.append(F.bool_or(c % 1 != 0).alias(f"f{i}"))
            decided = F.when(flag, "DOUBLE PRECISION").otherwise("BIGINT")
        elif isinstance(kind, T.NumericType):
            decided = F.lit("BIGINT")
        elif isinstance(kind, T.BooleanType):
            decided = F.lit("BOOLEAN")
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            decided = F.lit("TIMESTAMP")
        else:
            parses = values.as_timestamp(c.cast("string")).isNotNull()
            aggregates.append(F.bool_and(F.when(c.isNotNull(), parses)).alias(f"f{i}"))
            decided = F.when(flag, "TIMESTAMP").otherwise("TEXT")
        picks.append(F.struct(F.lit(name).alias("column_name"), F.col(f"n{i}").alias("n_values"),
                              F.when(F.col(f"n{i}") == 0, "TEXT").otherwise(decided).alias("sql_type")))
    grouped = df.groupBy(*by).agg(*aggregates)
    return grouped.select(*by, F.inline(F.array(*picks)))


def schema_summary(columns: DataFrame, by: Sequence[str], name: str = "column_name", sql_type: str = "sql_type",
                   ordinal: str = "ordinal") -> DataFrame:
    """``col TYPE, col TYPE, ...`` per dataset; the list is as long as the header, whatever the data size."""
    entry = F.struct(F.col(ordinal).alias("o"), F.col(name).alias("c"), F.col(sql_type).alias("t"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat_ws(" ", e["c"], e["t"]))
    return columns.groupBy(*by).agg(F.array_join(listed, ", ").alias("schema_text"))


def struct_type(columns: dict[str, str], overrides: dict[str, str] | None = None) -> T.StructType:
    """Spark schema of named SQL types, with user overrides merged last."""
    merged = {**columns, **{k: v for k, v in (overrides or {}).items() if k in columns}}
    return T.StructType([spark_field(n, t) for n, t in merged.items()])
