"""Value predicates and cleaners as Column expressions. Everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folderloom.functions.names import as_column

# Whitespace that a full Unicode strip removes; Spark's trim alone removes spaces only.
WHITESPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# The shapes a value is voted on.
UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
DATE_PREFIXES = (
    r"^\d{4}-\d{2}-\d{2}",
    r"^\d{2}/\d{2}/\d{4}",
    r"^\d{4}/\d{2}/\d{2}",
    r"^\d{1,2}-(?U:\w+)-\d{4}",
    r"^\d{1,2}/\d{1,2}/\d{2,4}",
)
NUMERIC_NOISE = "$,%"
BOOLEAN_VOTE_WORDS = ("true", "false", "yes", "no", "y", "n", "1", "0")

# Numbers as written without decoration; most values take this short way.
_PLAIN = r"^[+-]?\d+(?:\.\d+)?$"
_WHOLE = r"^[+-]?\d+$"
_DIGITS = r"\d+(?:_\d+)*+"
NUMBER_PATTERN = rf"^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))$"
CASTABLE_PATTERN = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))$"

_JSON_STRING = r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"'
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
# The same whitespace as above, for use at either end of a pattern.
_WS = r"[\s\x1c-\x1f\x85\xa0  -     　]*+"
_TIME = rf"((?:[T ]\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:\.\d+)?)?(?: ?(?:Z|[+-]\d{{2}}:?\d{{2}}))?)?){_WS}$"
_YEAR_FIRST = rf"^{_WS}\d{{4}}([-/])\d{{1,2}}\1\d{{1,2}}{_TIME}"
_SLASHED = rf"^{_WS}(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_TIME}"
_SLASHED_SHORT = rf"^{_WS}(\d{{1,2}})/(\d{{1,2}})/(\d{{2}}){_TIME}"
_WORDED = rf"^{_WS}(\d{{1,2}})-([A-Za-z]{{3,9}})-(\d{{4}}){_TIME}"


def strip(value: Column | str) -> Column:
    return F.trim(as_column(value), F.lit(WHITESPACE))


def is_uuid(value: Column | str) -> Column:
    c = as_column(value)
    return (F.octet_length(c) == 36) & F.lower(c).rlike(UUID_PATTERN)


def is_json(value: Column | str) -> Column:
    """Strict JSON object or array.

    The JSON builtins read one value and ignore what follows, so the text is checked twice,
    inside an array and inside an object: no trailing text closes both. String literals are
    checked by pattern first, which leaves only structure to the parser.
    """
    c = as_column(value)
    bracketed = (c.startswith("{") | c.startswith("[")) & (c.endswith("}") | c.endswith("]"))
    bare = F.regexp_replace(F.regexp_replace(c, _JSON_STRING, '""'), "-?Infinity|NaN", "null")
    clean_quotes = ~F.replace(bare, F.lit('""'), F.lit("")).rlike("[\"']")
    in_array = F.json_array_length(F.concat(F.lit("["), bare, F.lit("]"))) == 1
    in_object = F.size(F.json_object_keys(F.concat(F.lit('{"k":'), bare, F.lit("}")))) == 1
    return F.when(bracketed, F.coalesce(clean_quotes & in_array & in_object, F.lit(False))).otherwise(
        F.when(c.isNotNull(), F.lit(False))
    )


def is_date_like(value: Column | str) -> Column:
    """A date prefix; what follows is not looked at."""
    c = as_column(value)
    shapes = "|".join(p.removeprefix("^") for p in DATE_PREFIXES)
    return (F.contains(c, F.lit("-")) | F.contains(c, F.lit("/"))) & c.rlike(f"^{_WS}(?:{shapes})")


def _undecorated(c: Column) -> Column:
    return F.translate(c, NUMERIC_NOISE + WHITESPACE, "")


def numeric_text(value: Column | str) -> Column:
    """Currency, percent and thousands marks and all whitespace removed; empty gives null."""
    c = as_column(value)
    return F.when(c.rlike(_PLAIN), c).otherwise(F.nullif(_undecorated(c), F.lit("")))


def is_numeric(value: Column | str) -> Column:
    c = as_column(value)
    return F.when(c.rlike(_PLAIN), True).otherwise(F.nullif(_undecorated(c), F.lit("")).rlike(NUMBER_PATTERN))


def _worked_out(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once per row, however often ``then`` names it.

    A branch of a condition would work out a shared part each time. Spark also keeps projections with a lambda out of whole-stage
    code, where cleaning several columns makes one method that is too large for the JVM to compile, and splits them into small ones.
    """
    return F.get(F.transform(F.array(value), then), 0)


def as_double(value: Column | str) -> Column:
    bare = lambda b: F.when(b.rlike(CASTABLE_PATTERN), b.try_cast("double"))
    return _worked_out(as_column(value), lambda c: F.when(c.rlike(_PLAIN), c.try_cast("double")).otherwise(
        _worked_out(_undecorated(c), bare)))


def as_bigint(value: Column | str) -> Column:
    """Whole numbers exactly; fractions cut toward zero; anything else null."""
    bare = lambda b: F.when(b.rlike(_WHOLE), b.try_cast("bigint")).when(
        b.rlike(CASTABLE_PATTERN), b.try_cast("double").try_cast("bigint"))
    return _worked_out(as_column(value), lambda c: F.when(c.rlike(_WHOLE), c.try_cast("bigint")).otherwise(
        _worked_out(_undecorated(c), bare)))


def as_boolean(value: Column | str) -> Column:
    """The engine's own cast knows the same words: true, yes, y, 1, t and false, no, n, 0, f."""
    return strip(as_column(value).cast("string")).try_cast("boolean")


def as_text(value: Column | str) -> Column:
    return F.nullif(strip(as_column(value).cast("string")), F.lit(""))


def nan_to_null(value: Column | str) -> Column:
    c = as_column(value)
    return F.when(~F.isnan(c), c)


def nan_text_to_null(value: Column | str) -> Column:
    c = as_column(value)
    return F.when(~c.isin("nan", "None"), c)


def _recognised(c: Column, kind: str) -> Column:
    """A date with its time, cast from its ISO form. No text has two of the shapes, so the first that fits decides.

    A slashed date is month first; day first where that is no date, that is when the month is over 12.
    """
    month = F.lower(F.substring(F.regexp_extract(c, _WORDED, 2), 1, 3))
    at = F.instr(F.lit(_MONTHS), month)
    month_no = F.when((at > 0) & (at % 3 == 1), F.floor((at + 2) / 3).cast("string"))
    worded = F.concat(F.regexp_replace(c, _WORDED, "$3-"), month_no, F.regexp_replace(c, _WORDED, "-$1$4"))
    out = F.when(c.rlike(_YEAR_FIRST), F.translate(c, "/" + WHITESPACE.replace(" ", ""), "-").try_cast(kind))
    for pattern, century in ((_SLASHED, ""), (_SLASHED_SHORT, "20")):
        out = out.when(c.rlike(pattern), F.coalesce(*[
            F.regexp_replace(c, pattern, form).try_cast(kind) for form in (f"{century}$3-$1-$2$4", f"{century}$3-$2-$1$4")]))
    return out.when(c.rlike(_WORDED), worded.try_cast(kind))


def _first_cast(value: Column, kind: str) -> Column:
    return _worked_out(value, lambda c: F.when(
        F.contains(c, F.lit("-")) | F.contains(c, F.lit("/")), _recognised(c, kind)))


def as_date(value: Column | str) -> Column:
    return _first_cast(as_column(value), "date")


def as_timestamp(value: Column | str) -> Column:
    """Timestamp without zone: the recognised date plus the written time of day."""
    return _first_cast(as_column(value), "timestamp_ntz")


def is_sha256(value: Column | str) -> Column:
    return as_column(value).rlike("^[0-9a-fA-F]{64}$")


def content_hash(content: Column | str) -> Column:
    return F.sha2(as_column(content), 256)


def utc_now_text() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def render_text(value: Column | str, data_type: str) -> Column:
    """Text form of a typed value; whole doubles are written without fraction or exponent."""
    c = as_column(value)
    if data_type in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.try_cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def vote(value: Column | str, compat: bool = False) -> Column:
    """The type a single text value speaks for, '' for none, null for null.

    Cheap tests stand before patterns, so that a common value meets one or two of these.
    """
    c = as_column(value)
    braces = F.contains(c, F.lit("{")) | F.contains(c, F.lit("["))
    trimmed = strip(c)
    number = F.regexp_substr(_undecorated(c), F.lit(NUMBER_PATTERN))
    whole = F.replace(number, F.lit("_"), F.lit("")).try_cast("double") % 1 == 0
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(c.rlike(_PLAIN), F.when(c.rlike(_WHOLE), "BIGINT").otherwise(
            F.when(c.try_cast("double") % 1 == 0, "BIGINT").otherwise("DOUBLE PRECISION")))
        .when((F.octet_length(c) >= 36) & is_uuid(trimmed), "UUID")
        .when(braces & is_json(F.lower(trimmed) if compat else trimmed), "JSONB")
        .when(is_date_like(c), "DATE")
        .when(number.isNotNull(), F.when(whole, "BIGINT").otherwise("DOUBLE PRECISION"))
        .when(F.lower(trimmed).isin(*BOOLEAN_VOTE_WORDS), "BOOLEAN")
        .otherwise("")
    )
