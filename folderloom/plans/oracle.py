"""DuckDB fragments that the check SQL is put together from, written apart from the Spark code."""

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def numeric_text(x: str) -> str:
    return rf"nullif(regexp_replace({x}, '[$,%\s]', '', 'g'), '')"


def is_numeric(x: str) -> str:
    return (rf"regexp_full_match({numeric_text(x)}, '(?i)[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?"
            r"|inf|infinity|nan)')")


def as_double(x: str) -> str:
    n = numeric_text(x)
    return (rf"CASE WHEN regexp_full_match({n}, '(?i)[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)') "
            f"THEN try_cast({n} AS DOUBLE) END")


def as_bigint(x: str) -> str:
    n = numeric_text(x)
    return (rf"CASE WHEN regexp_full_match({n}, '[+-]?\d+') THEN try_cast({n} AS BIGINT) "
            f"ELSE try_cast(trunc({as_double(x)}) AS BIGINT) END")


def is_date_like(x: str) -> str:
    return (rf"regexp_matches({strip(x)}, '^(\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}/\d{{2}}/\d{{4}}|\d{{4}}/\d{{2}}/\d{{2}}"
            rf"|\d{{1,2}}-\w+-\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}})')")


def is_json(x: str) -> str:
    return rf"(regexp_matches({x}, '(?s)^[{{\[].*[}}\]]$') AND json_valid({x}))"


def vote(x: str) -> str:
    s = strip(x)
    return f"""CASE WHEN {x} IS NULL THEN NULL
        WHEN regexp_full_match(lower({s}), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN 'UUID'
        WHEN {is_json(s)} THEN 'JSONB'
        WHEN {is_date_like(x)} THEN 'DATE'
        WHEN {is_numeric(x)} THEN CASE WHEN {as_double(x)} = trunc({as_double(x)}) THEN 'BIGINT' ELSE 'DOUBLE PRECISION' END
        WHEN lower({s}) IN ('true', 'false', 'yes', 'no', 'y', 'n', '1', '0') THEN 'BOOLEAN' ELSE '' END"""


def count_votes(cells: str, keys: str) -> str:
    """Votes of a relation with ``keys`` and ``value``; null values are left out."""
    return f"""SELECT {keys},
        count(*) FILTER (v = 'DATE') AS n_date, count(*) FILTER (v = 'BIGINT') AS n_bigint,
        count(*) FILTER (v = 'DOUBLE PRECISION') AS n_double, count(*) FILTER (v = 'BOOLEAN') AS n_boolean,
        count(*) FILTER (v = 'UUID') AS n_uuid, count(*) FILTER (v = 'JSONB') AS n_json,
        count(*) AS n_values, min(d) AS min_number, max(d) AS max_number
        FROM (SELECT {keys}, {vote('value')} AS v, {as_double('value')} AS d FROM ({cells}) WHERE value IS NOT NULL)
        GROUP BY {keys}"""


DECIDE = """CASE
    WHEN greatest(n_date, n_bigint + n_double, n_boolean, n_uuid, n_json) < 0.8 * n_values THEN 'TEXT'
    WHEN n_date >= 0.8 * n_values THEN 'DATE'
    WHEN n_bigint + n_double >= 0.8 * n_values AND n_double > 0 THEN 'DOUBLE PRECISION'
    WHEN n_bigint >= 0.8 * n_values AND max_number < 2147483647 AND min_number > -2147483648 THEN 'INTEGER'
    WHEN n_bigint >= 0.8 * n_values THEN 'BIGINT'
    WHEN n_boolean >= 0.8 * n_values THEN 'BOOLEAN'
    WHEN n_uuid >= 0.8 * n_values THEN 'UUID' ELSE 'JSONB' END"""


def long_form(relation: str, keys: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM ({relation})"
                              for c in columns)
