"""Frame-level operators: renaming, merging colliding columns, lineage, alignment, flattening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folderloom.functions import names, sqltypes, values

LINEAGE = ("source_file", "load_date", "load_timestamp")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def clean_headers(spark: SparkSession, headers: Sequence[Sequence[str]], dialect: str = "current",
                  duplicates: str = "merge") -> list[list[str]]:
    """Clean headers in one job. Only headers, never data, come to the driver.

    ``duplicates`` is ``merge`` (colliding names stay equal) or ``suffix``.
    """
    if not headers:
        return []
    rows = spark.createDataFrame([(i, list(h)) for i, h in enumerate(headers)], "i int, header array<string>")
    ascii_only = all(n.isascii() for h in headers for n in h)
    cleaned = names.clean_header_cells("header", dialect, ascii_only)
    if duplicates == "suffix":
        cleaned = names.suffix_duplicates(cleaned)
    return [r.header for r in sorted(rows.select("i", cleaned.alias("header")).collect(), key=lambda r: r.i)]


def clean_header(spark: SparkSession, header: Sequence[str], dialect: str = "current") -> list[str]:
    return clean_headers(spark, [header], dialect)[0]


def _positional(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def merge_columns(df: DataFrame, new_names: Sequence[str]) -> DataFrame:
    """Rename by position; columns with the same new name merge to their first non-null value."""
    groups: dict[str, list[int]] = {}
    for i, name in enumerate(new_names):
        groups.setdefault(name, []).append(i)
    return _positional(df).select(*[
        (F.coalesce(*[F.col(f"_c{i}") for i in at]) if len(at) > 1 else F.col(f"_c{at[0]}")).alias(name)
        for name, at in groups.items()
    ])


def normalize_columns(df: DataFrame, dialect: str = "current") -> DataFrame:
    """Clean all column names and merge those that collide."""
    merged = merge_columns(df, clean_header(df.sparkSession, df.columns, dialect))
    return merged.toDF(*_resolved(df.sparkSession, merged.columns, names.fallback_names)) if dialect == "legacy" else merged


def suffix_columns(df: DataFrame) -> DataFrame:
    """Clean all column names and keep colliding ones apart with ``_1``, ``_2`` and so on."""
    return df.toDF(*clean_headers(df.sparkSession, [df.columns], "suffix", "suffix")[0])


def _resolved(spark: SparkSession, header: Sequence[str], rule) -> list[str]:
    one = spark.createDataFrame([(list(header),)], "header array<string>")
    return one.select(rule("header").alias("header")).head().header


def check_insertable(columns: Sequence[str]) -> None:
    """Raise if a header has duplicate names or names that are no identifiers."""
    import re

    repeated = sorted({c for c in columns if list(columns).count(c) > 1})
    if repeated:
        raise ValueError(f"duplicate column names: {repeated}")
    invalid = [c for c in columns if not re.match(names.IDENTIFIER_PATTERN, c)]
    if invalid:
        raise ValueError(f"invalid column names: {invalid}")


def with_lineage(df: DataFrame, source_file: Column | str, stamp: str = "load_timestamp") -> DataFrame:
    """Add ``source_file`` and the load clock, ``load_date`` or ``load_timestamp``."""
    source = F.lit(source_file) if isinstance(source_file, str) else source_file
    clock = {"load_date": F.current_date(), "load_timestamp": F.localtimestamp()}[stamp]
    return df.withColumns({"source_file": source, stamp: clock})


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan over the cores where it has fewer splits than there are cores.

    For costly expressions over a few files that cannot be split. A large scan has more splits than
    cores and is left as it is. Only for plain scans: counting the splits of a plan with a shuffle
    would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def drop_empty_rows(df: DataFrame, data_columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("all", subset=list(data_columns or df.columns))


def reject_count(value: Column | str) -> Column:
    """Aggregate: non-null values that are no numbers."""
    c = names.as_column(value)
    return F.count_if(c.isNotNull() & values.as_double(c).isNull())


def non_numeric_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, non_numeric) over the whole frame, in one aggregate without a row per cell."""
    counts = df.agg(*[reject_count(quoted(c).cast("string")).alias(f"n{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("non_numeric"))
                      for i, c in enumerate(columns)])
    return counts.select(F.inline(cells))


def rejected_counts(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """(column_name, rejected): values that are there but do not fit the column's type and clean to null."""
    lost = [F.count_if(values.as_text(quoted(c)).isNotNull() & sqltypes.clean_value(quoted(c).cast("string"), t).isNull())
            for c, t in schema.items()]
    counts = df.agg(*[n.alias(f"n{i}") for i, n in enumerate(lost)])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("rejected")) for i, c in enumerate(schema)])
    return counts.select(F.inline(cells))


def align(df: DataFrame, target: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Project a typed frame on ``target`` types; missing columns become null."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name, sql_type in target.items():
        wanted = sqltypes.SPARK_TYPES[sql_type]
        if name not in have:
            column = F.lit(None).cast(wanted)
        elif have[name] == wanted:
            column = quoted(name)
        elif wanted == T.StringType():
            column = values.render_text(quoted(name), have[name].simpleString())
        else:
            column = quoted(name).try_cast(wanted)
        out.append(column.alias(name))
    return df.select(*[quoted(c) for c in keep], *out)


def append_frames(frames: Sequence[DataFrame], target: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Union of batches with differing columns, each cast explicitly first."""
    aligned = [align(f, target, keep) for f in frames]
    out = aligned[0]
    for nxt in aligned[1:]:
        out = out.unionByName(nxt)
    return out


def flatten_columns(schema: T.StructType, prefix: str = "") -> list[tuple[str, Column]]:
    """(dotted name, column) of every leaf; arrays and maps stay whole."""
    out: list[tuple[str, Column]] = []
    for field in schema.fields:
        path = f"{prefix}.`{field.name}`" if prefix else f"`{field.name}`"
        if isinstance(field.dataType, T.StructType):
            out += [(f"{field.name}.{name}", c) for name, c in flatten_columns(field.dataType, path)]
        else:
            out.append((field.name, F.col(path)))
    return out


def flatten_structs(df: DataFrame) -> DataFrame:
    return df.select(*[c.alias(name) for name, c in flatten_columns(df.schema)])


def apply_transforms(df: DataFrame, transforms: Sequence = ()) -> DataFrame:
    """Run user hooks, each a function from DataFrame to DataFrame."""
    for fn in transforms:
        df = df.transform(fn)
    return df
