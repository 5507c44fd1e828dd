"""SQL type names, aliases, Spark types and the widening policies."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folderloom.functions import values
from folderloom.functions.names import as_column

# What each type may widen to, narrowest first.
CHAIN = {
    "SMALLINT": ("INTEGER", "BIGINT", "DOUBLE PRECISION", "TEXT"),
    "INTEGER": ("BIGINT", "DOUBLE PRECISION", "TEXT"),
    "BIGINT": ("DOUBLE PRECISION", "TEXT"),
    "REAL": ("DOUBLE PRECISION", "TEXT"),
    "DOUBLE PRECISION": ("TEXT",),
    "BOOLEAN": ("TEXT",),
    "DATE": ("TIMESTAMP", "TEXT"),
    "TIMESTAMP": ("TEXT",),
    "TEXT": (),
}
# Type ranks of the ranked policy.
RANKS = {"BOOLEAN": 1, "BIGINT": 2, "DOUBLE PRECISION": 3, "TIMESTAMP": 4, "TEXT": 5}
# Exact type-name aliases, and the substring aliases of the ranked policy.
ALIASES = {"INT": "INTEGER", "INT4": "INTEGER", "INT8": "BIGINT", "FLOAT": "DOUBLE PRECISION",
           "FLOAT8": "DOUBLE PRECISION", "VARCHAR": "TEXT", "CHARACTER VARYING": "TEXT"}
RANKED_ALIASES = {"INTEGER": "BIGINT", "VARCHAR": "TEXT", "NUMERIC": "DOUBLE PRECISION", "DATETIME": "TIMESTAMP"}
# Pairs of the pairwise policies.
COMPATIBLE = {("INTEGER", "BIGINT"): "BIGINT", ("SMALLINT", "INTEGER"): "INTEGER", ("SMALLINT", "BIGINT"): "BIGINT",
              ("REAL", "DOUBLE PRECISION"): "REAL"}
SAFE = {("SMALLINT", "INTEGER"), ("INTEGER", "BIGINT"), ("INTEGER", "DOUBLE PRECISION"),
        ("REAL", "DOUBLE PRECISION"), ("VARCHAR", "TEXT")}

SPARK_TYPES = {
    "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "REAL": T.FloatType(),
    "DOUBLE PRECISION": T.DoubleType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(), "UUID": T.StringType(), "JSONB": T.StringType(), "TEXT": T.StringType(),
}
ALL_TYPES = tuple(SPARK_TYPES)
LATTICE = tuple(CHAIN) + ("UUID", "JSONB")
POLICIES = ("lub", "chain", "ranked", "pairs", "safe")


def spark_field(name: str, sql_type: str) -> T.StructField:
    logical = {"UUID": "uuid", "JSONB": "json"}.get(sql_type)
    return T.StructField(name, SPARK_TYPES[sql_type], True, {"logical": logical} if logical else None)


def sql_type_of(data_type: T.DataType) -> str:
    """SQL name of a Spark type; anything without one is TEXT."""
    if isinstance(data_type, T.TimestampType):
        return "TIMESTAMP"
    if isinstance(data_type, T.DecimalType):
        return "DOUBLE PRECISION"
    return next((name for name, t in SPARK_TYPES.items() if t == data_type and t != T.StringType()), "TEXT")


def normalize_type(value: Column | str) -> Column:
    """Upper-cased, stripped type name with exact aliases resolved."""
    name = values.strip(F.upper(as_column(value)))
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, name), name)


def ranked_type(value: Column | str) -> Column:
    """Upper-cased type name, aliases found anywhere in it."""
    name = F.upper(as_column(value))
    out = name
    for part, target in reversed(RANKED_ALIASES.items()):
        out = F.when(F.contains(name, F.lit(part)), target).otherwise(out)
    return out


def is_numeric_type(value: Column | str) -> Column:
    return F.coalesce(F.upper(as_column(value)).rlike("DOUBLE|INT|REAL|NUMERIC|DECIMAL"), F.lit(False))


def lub(first: str, second: str) -> str:
    """Least type both may widen to; independent of order."""
    if first == second:
        return first
    above = lambda t: (t, *CHAIN.get(t, ("TEXT",)))
    shared = [t for t in above(first) if t in above(second)]
    return shared[0] if shared else "TEXT"


def resolve(current: str, incoming: str, policy: str = "lub") -> str:
    """The column type after a batch of type ``incoming`` meets a column of type ``current``."""
    if policy == "lub":
        return lub(current, incoming)
    if policy == "ranked":
        current, incoming = RANKED_ALIASES.get(current, current), RANKED_ALIASES.get(incoming, incoming)
        return incoming if RANKS.get(incoming, 0) > RANKS.get(current, 0) else current
    if current == incoming:
        return current
    if policy == "chain":
        return incoming if incoming in CHAIN.get(current, ()) else "TEXT"
    if policy == "pairs":
        return COMPATIBLE.get((current, incoming), "TEXT")
    if policy == "safe":
        return incoming if (current, incoming) in SAFE else current
    raise ValueError(f"unknown policy {policy!r}; use one of {POLICIES}")


def _pairs(policy: str) -> list[tuple[str, str, str]]:
    known = (*ALL_TYPES, "VARCHAR")
    return [(a, b, resolve(a, b, policy)) for a, b in product(known, known)]


def widening_table(spark: SparkSession, policy: str) -> DataFrame:
    """All type pairs with the resolved type; as many rows as the square of the number of types."""
    return spark.createDataFrame(_pairs(policy), "current_type string, incoming_type string, resolved_type string")


def resolve_column(current: Column | str, incoming: Column | str, policy: str = "lub") -> Column:
    """``resolve`` over two type-name columns, as one literal map lookup."""
    lookup = F.expr("map(" + ", ".join(f"'{a}>{b}', '{r}'" for a, b, r in _pairs(policy)) + ")")
    a, b = as_column(current), as_column(incoming)
    fallback = a if policy in ("ranked", "safe") else F.lit("TEXT")
    known = F.try_element_at(lookup, F.concat_ws(">", a, b))
    return F.coalesce(known, F.when(a == b, a).otherwise(fallback))


def lub_of_set(types: Column | str) -> Column:
    """Least upper bound of an array of type names. The array holds at most one entry per type."""
    t = as_column(types)
    chain = ("SMALLINT", "INTEGER", "BIGINT")
    only = lambda *names: F.size(F.array_except(t, F.array(*[F.lit(n) for n in names]))) == 0
    has = lambda name: F.array_contains(t, name)
    return (
        F.when(F.size(F.array_distinct(t)) == 1, F.element_at(t, 1))
        .when(only(*chain), F.when(has("BIGINT"), "BIGINT").otherwise("INTEGER"))
        .when(only(*chain, "REAL", "DOUBLE PRECISION"), "DOUBLE PRECISION")
        .when(only("DATE", "TIMESTAMP"), "TIMESTAMP")
        .otherwise("TEXT")
    )


def clean_value(value: Column | str, sql_type: str) -> Column:
    """A text value cleaned and cast for a column of ``sql_type``; misfits give null."""
    c = as_column(value)
    if sql_type in ("SMALLINT", "INTEGER", "BIGINT"):
        return values.as_bigint(c).try_cast(SPARK_TYPES[sql_type])
    if sql_type in ("REAL", "DOUBLE PRECISION"):
        return values.as_double(c).cast(SPARK_TYPES[sql_type])
    if sql_type == "BOOLEAN":
        return values.as_boolean(c)
    if sql_type == "DATE":
        return values.as_date(c)
    if sql_type == "TIMESTAMP":
        return values.as_timestamp(c)
    if sql_type == "TEXT":
        return values.as_text(c)
    return c


def clean_frame(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Clean every column named in ``schema``; other columns pass through."""
    return df.select(*[
        clean_value(F.col(f"`{c}`").cast("string"), schema[c]).alias(c) if c in schema else F.col(f"`{c}`")
        for c in df.columns
    ])
