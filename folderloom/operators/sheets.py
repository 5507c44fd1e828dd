"""Sheet resolution: which sheet a folder's workbooks are read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folderloom.functions.names import as_column

DEFAULT_SHEET = "Sheet1"


def flatten_mapping(config: dict, sheet_key: str = "sheet") -> list[tuple[str, str | None]]:
    """(folder path, sheet or None) of every node of a nested mapping, keys as lower-case text."""
    rows: list[tuple[str, str | None]] = []

    def walk(node: dict, path: list[str]) -> None:
        for key, child in node.items():
            if isinstance(child, dict):
                here = [*path, str(key).lower()]
                rows.append(("/".join(here), child.get(sheet_key)))
                walk(child, here)

    walk(config, [])
    return rows


def mapping_frame(spark: SparkSession, config: dict, sheet_key: str = "sheet") -> DataFrame:
    schema = T.StructType([T.StructField("prefix", T.StringType()), T.StructField("sheet", T.StringType())])
    return spark.createDataFrame(flatten_mapping(config, sheet_key), schema)


def resolve_sheets(folders: DataFrame, config: dict, rule: str = "nearest", default: str | None = DEFAULT_SHEET,
                   folder: str = "folder", sheet_key: str = "sheet") -> DataFrame:
    """Add ``sheet`` to a frame with a ``folder`` path.

    ``nearest``  the closest configured ancestor, else the default (null skips the folder).
    ``exact``    the folder's own node; an unmatched path or a node without sheet gives the default.
    ``deepest``  unmatched parts are skipped; the deepest node reached decides, else the default.

    A folder has few ancestors: they are listed in the row and looked up by an equi-join, and the
    longest match is taken by a map-side aggregate over distinct folders.
    """
    if rule == "deepest":
        return folders.withColumn("sheet", _deepest_sheet(folder, dict(flatten_mapping(config, sheet_key)), default))
    mapping = mapping_frame(folders.sparkSession, config, sheet_key)
    paths = folders.select(F.col(folder).alias("_folder")).distinct()
    parts = F.split(F.lower("_folder"), "/")
    lengths = F.sequence(F.lit(1), F.size(parts))
    prefixes = F.transform(lengths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    if rule == "exact":
        prefixes = F.array(F.lower("_folder"))
    tried = paths.select("_folder", F.explode(prefixes).alias("prefix"))
    hits = tried.join(mapping.filter(F.col("sheet").isNotNull()), "prefix")
    best = hits.groupBy("_folder").agg(F.max_by("sheet", F.length("prefix")).alias("sheet"))
    out = folders.join(best, F.col(folder) == F.col("_folder"), "left").drop("_folder")
    return out.withColumn("sheet", F.coalesce("sheet", F.lit(default)))


def _deepest_sheet(folder: str, nodes: dict[str, str | None], default: str | None) -> Column:
    """Walk the mapping by path part, staying put on an unmatched part; the literals are as many as
    the configuration has nodes."""
    known = F.array(*[F.lit(p) for p in nodes]) if nodes else F.array().cast("array<string>")
    sheets = {p: s for p, s in nodes.items() if s is not None}
    lookup = F.create_map(*[F.lit(x) for pair in sheets.items() for x in pair]) if sheets else None

    def step(at, part):
        child = F.when(at == "", part).otherwise(F.concat_ws("/", at, part))
        return F.when(F.array_contains(known, child), child).otherwise(at)

    reached = F.aggregate(F.split(F.lower(as_column(folder)), "/"), F.lit(""), step)
    found = F.try_element_at(lookup, reached) if lookup is not None else F.lit(None).cast("string")
    return F.coalesce(found, F.lit(default))


def split_by_sheet(files: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose resolved sheet exists, and files to skip with a reason.

    ``files`` has (source_file, sheet), ``catalogue`` has the sheets each file holds."""
    key = ["source_file", "sheet"]
    held = catalogue.select(*key).distinct()
    return files.join(held, key, "left_semi"), files.join(held, key, "left_anti").withColumn(
        "reason", F.lit("Sheet not found"))
