"""Identifier cleaning and path naming as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Turkish letters and their ASCII forms, for the legacy and upload dialects.
LEGACY_TURKISH = ("ıİğĞüÜşŞöÖçÇ", "iIgGuUsSoOcC")
UPLOAD_TURKISH = ("öçşğüı", "ocsgui")

# Words that may not be used as identifiers.
RESERVED_WORDS = (
    "select", "insert", "update", "delete", "from", "where", "and", "or", "not", "null",
    "true", "false", "table", "create", "drop", "alter", "index", "primary", "key",
    "foreign", "references", "constraint", "default", "unique", "check",
    "auto_increment", "serial", "bigserial",
)

_CELL_MARK = "\x1f"
IDENTIFIER_PATTERN = "^[A-Za-z_][A-Za-z0-9_]*$"
DIALECTS = ("current", "suffix", "legacy", "upload")


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


@F.pandas_udf(T.StringType())
def _decompose_to_ascii(values: pd.Series) -> pd.Series:
    def fold(text):
        if text is None:
            return None
        return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")

    return values.map(fold, na_action="ignore")


def fold_ascii(value: Column | str) -> Column:
    """NFKD fold to ASCII. Spark has no normaliser, so only non-ASCII values go to Python."""
    c = as_column(value)
    ascii_only = c.rlike(r"^\p{ASCII}*$")
    return F.when(ascii_only, c).otherwise(_decompose_to_ascii(F.when(~ascii_only, c)))


def _underscored(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", "_"), F.lit("_"))


def clean_identifier(value: Column | str, dialect: str = "current", ascii_input: bool = False) -> Column:
    """Turn free text into a column or table identifier.

    ``current``  lower, fold accents, underscore; leading digit gets ``_``; empty is ``col``.
    ``suffix``   fold accents, lower, underscore; null and empty give ''.
    ``legacy``   cut at the first dot, Turkish letters, underscore; leading digit gets ``col_``.
    ``upload``   lower and strip, Turkish letters, underscore; null and empty give ``unnamed``.

    ``ascii_input`` drops the accent step where the caller knows the text is ASCII.
    """
    c = as_column(value)
    fold = (lambda x: x) if ascii_input else fold_ascii
    if dialect == "current":
        body = _underscored(fold(F.lower(F.coalesce(c, F.lit("None")))))
        return (
            F.when(body == "", "col").when(body.rlike("^[0-9]"), F.concat(F.lit("_"), body)).otherwise(body)
        )
    if dialect == "suffix":
        return F.coalesce(_underscored(F.lower(fold(c))), F.lit(""))
    if dialect == "legacy":
        base = F.when(c.startswith("."), c).otherwise(F.substring_index(c, ".", 1))
        body = _underscored(F.lower(F.translate(base, *LEGACY_TURKISH)))
        return F.coalesce(F.when(body.rlike("^[0-9]"), F.concat(F.lit("col_"), body)).otherwise(body), F.lit(""))
    if dialect == "upload":
        body = _underscored(F.translate(F.trim(F.lower(c)), *UPLOAD_TURKISH))
        return F.when(c.isNull() | (c == ""), "unnamed").otherwise(body)
    raise ValueError(f"unknown dialect {dialect!r}; use one of {DIALECTS}")


def clean_header_cells(header: Column | str, dialect: str = "current", ascii_input: bool = False) -> Column:
    """``clean_identifier`` over an array of names. The accent fold runs once on the joined names."""
    cells = as_column(header)
    if dialect in ("current", "suffix"):
        joined = F.array_join(cells, _CELL_MARK)
        joined = F.lower(joined) if dialect == "current" else joined
        joined = joined if ascii_input else fold_ascii(joined)
        cells = F.when(F.size(cells) > 0, F.split(joined, _CELL_MARK)).otherwise(cells)
    return F.transform(cells, lambda n: clean_identifier(n, dialect, ascii_input=True))


def is_valid_identifier(value: Column | str) -> Column:
    """Identifier shape and not a reserved word; null is false."""
    c = as_column(value)
    return F.coalesce(c.rlike(IDENTIFIER_PATTERN) & ~F.lower(c).isin(*RESERVED_WORDS), F.lit(False))


def table_from_parts(parts: Column | str) -> Column:
    """Folder parts joined by ``_`` in lower case."""
    return F.lower(F.array_join(as_column(parts), "_"))


def safe_table_name(value: Column | str, ascii_input: bool = False) -> Column:
    """Cleaned table name: empty is ``data_table``, a first character that is no letter gets ``t_``."""
    cleaned = clean_identifier(value, "suffix", ascii_input)
    named = F.when(cleaned == "", "data_table").otherwise(cleaned)
    return F.when(named.rlike("^[a-zA-Z]"), named).otherwise(F.concat(F.lit("t_"), named))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(as_column(path), "/"), -1)


def folder_parts(relative_path: Column | str) -> Column:
    """Folder components of a relative file path (the file name dropped)."""
    pieces = F.split(as_column(relative_path), "/")
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def suffix_duplicates(names: Column | str) -> Column:
    """Array form: the n-th repeat of a name gets ``_n``; empty names become ``column``.

    A suffixed name that is already used counts on until it is free, so the result is unique.
    """
    filled = F.transform(as_column(names), lambda n: F.when(n == "", "column").otherwise(n))
    return _make_unique(filled)


def fallback_names(names: Column | str) -> Column:
    """Array form: names that are no identifiers become ``col_<position>``; repeats get a suffix."""
    valid = F.transform(
        as_column(names),
        lambda n, i: F.when(n.rlike(IDENTIFIER_PATTERN), n).otherwise(F.concat(F.lit("col_"), i.cast("string"))),
    )
    return _make_unique(valid)


def _make_unique(names: Column) -> Column:
    def place(done: Column, name: Column) -> Column:
        tries = F.transform(
            F.sequence(F.lit(1), F.size(done) + 1), lambda k: F.concat(name, F.lit("_"), k.cast("string"))
        )
        free = F.element_at(F.filter(tries, lambda t: ~F.array_contains(done, t)), 1)
        return F.concat(done, F.array(F.when(F.array_contains(done, name), free).otherwise(name)))

    return F.aggregate(names, F.array().cast("array<string>"), place)


def pad_header(header: Column | str, width: Column) -> Column:
    """Extend a header to ``width`` cells with ``extra_col_<position>``."""
    h = as_column(header)
    extra = F.transform(
        F.sequence(F.size(h), width - 1), lambda i: F.concat(F.lit("extra_col_"), i.cast("string"))
    )
    return F.when(width > F.size(h), F.concat(h, extra)).otherwise(h)


def display_path(path: Column | str) -> Column:
    """Paths over 35 characters keep their last 32 behind ``...``."""
    c = as_column(path)
    return F.when(F.length(c) > 35, F.concat(F.lit("..."), F.right(c, F.lit(32)))).otherwise(c)
