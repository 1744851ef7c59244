"""Type names, lenient casts of text cells, and quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SQL spellings and the Spark types of declared columns (fixed values).
TYPES = {
    "INT": "bigint", "INTEGER": "bigint", "INT4": "bigint", "BIGINT": "bigint", "INT8": "bigint", "SERIAL": "bigint", "BIGSERIAL": "bigint",
    "BOOL": "boolean", "BOOLEAN": "boolean", "FLOAT": "double", "REAL": "double", "DOUBLE": "double", "NUMERIC": "double",
    "BYTEA": "string", "BLOB": "string", "TIMESTAMP": "string", "TIMESTAMPTZ": "string", "DATETIME": "string",
}


def spark_type(name: str) -> str:
    return TYPES.get(name.split("(")[0].strip().upper(), "string")


def lenient(cell: Column, kind: str) -> Column:
    """A text cell as ``kind``; empty and malformed cells are null."""
    text = F.trim(F.nullif(cell, F.lit("")))
    if kind == "bigint":
        return text.try_cast("bigint")
    if kind == "double":
        return F.when(~text.rlike("[dDfF]$") | text.rlike("(?i)^[+-]?inf$"), text.try_cast("double"))
    if kind == "boolean":
        low = F.lower(text)
        return F.when(low.isin("true", "t", "1", "yes"), True).when(low.isin("false", "f", "0", "no"), False)
    return F.nullif(cell, F.lit(""))


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def quote_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def quote_ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'
