"""Declared interface types <-> Spark types.

A declared type is a short name from a closed vocabulary. A column satisfies it
when its Spark type belongs to the accepted family below; widths of integers
are kept apart on purpose (``int`` does not accept ``bigint``). Anything
outside the vocabulary must equal the Spark ``simpleString`` exactly.

Each rule exists twice with the same table behind it: as a Python predicate for
schema-only checks on the driver, and as a Column expression so a DataFrame of
(declared, actual) pairs can be checked inside one Spark job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared-name aliases, and the Spark simpleString families each accepts.
# A trailing "(" means "this prefix followed by parameters", e.g. decimal(18,2).
DECLARED_ACCEPTS: dict[tuple[str, ...], tuple[str, ...]] = {
    ("string", "varchar", "text"): ("string", "varchar(", "char("),
    ("int", "integer"): ("int",),
    ("bigint", "long"): ("bigint",),
    ("decimal", "numeric"): ("decimal(",),
    ("double", "float"): ("double", "float"),
    ("bool", "boolean"): ("boolean",),
    ("date",): ("date",),
    ("timestamp",): ("timestamp", "timestamp_ntz"),
}

# The one canonical declared name for each accepted Spark family.
CANONICAL_DECLARED: list[tuple[str, str]] = [
    ("string", "string"),
    ("varchar(", "string"),
    ("char(", "string"),
    ("int", "integer"),
    ("bigint", "bigint"),
    ("decimal(", "decimal"),
    ("double", "double"),
    ("float", "double"),
    ("boolean", "boolean"),
    ("date", "date"),
    ("timestamp", "timestamp"),
    ("timestamp_ntz", "timestamp"),
]

# Warehouse-native (BigQuery) types each declared name accepts.
NATIVE_ACCEPTS: dict[str, dict[tuple[str, ...], tuple[str, ...]]] = {
    "bigquery": {
        ("string", "varchar", "text"): ("STRING",),
        ("int", "integer", "bigint", "long"): ("INT64",),
        ("decimal", "numeric"): ("NUMERIC", "BIGNUMERIC"),
        ("double", "float"): ("FLOAT64",),
        ("bool", "boolean"): ("BOOL",),
        ("date",): ("DATE",),
        ("timestamp",): ("TIMESTAMP", "DATETIME"),
    }
}

# Canonical declared name for a warehouse-native (BigQuery) type.
NATIVE_CANONICAL: dict[str, dict[str, str]] = {
    "bigquery": {
        "STRING": "string",
        "INT64": "bigint",
        "NUMERIC": "decimal",
        "BIGNUMERIC": "decimal",
        "FLOAT64": "double",
        "BOOL": "boolean",
        "DATE": "date",
        "TIMESTAMP": "timestamp",
        "DATETIME": "timestamp",
    }
}

UNMAPPED = "unmapped"


def _matches(actual: str, accepted: tuple[str, ...]) -> bool:
    return any(actual.startswith(p) if p.endswith("(") else actual == p for p in accepted)


def spark_type_name(dtype: T.DataType) -> str:
    return dtype.simpleString().lower()


def type_ok(declared: str, dtype: T.DataType | str) -> bool:
    """Does a column of Spark type ``dtype`` satisfy the declared type name?"""
    d = declared.strip().lower()
    a = dtype if isinstance(dtype, str) else spark_type_name(dtype)
    a = a.lower()
    for names, accepted in DECLARED_ACCEPTS.items():
        if d in names:
            return _matches(a, accepted)
    return a == d


def native_type_ok(connector: str, declared: str, native: str) -> bool | None:
    """Warehouse-native rule, or None when the connector has no native vocabulary."""
    rules = NATIVE_ACCEPTS.get(connector)
    if rules is None:
        return None
    d = declared.strip().lower()
    n = native.strip().upper()
    for names, accepted in rules.items():
        if d in names:
            return n in accepted
    return n.lower() == d


def declared_for(dtype: T.DataType | str) -> str | None:
    """The canonical declared name for a Spark type, None when there is none."""
    a = (dtype if isinstance(dtype, str) else spark_type_name(dtype)).lower()
    for prefix, name in CANONICAL_DECLARED:
        if (a.startswith(prefix) if prefix.endswith("(") else a == prefix):
            return name
    return None


def native_declared_for(connector: str, native: str) -> str | None:
    return NATIVE_CANONICAL.get(connector, {}).get(native.strip().upper())


# ---------------------------------------------------------------- column forms


def _accepts_col(actual: Column, accepted: tuple[str, ...]) -> Column:
    conds = [actual.startswith(p) if p.endswith("(") else actual == F.lit(p) for p in accepted]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def type_ok_col(declared: Column, actual: Column) -> Column:
    """Column form of :func:`type_ok` over (declared name, Spark simpleString) columns."""
    d = F.lower(F.trim(declared))
    a = F.lower(actual)
    expr = None
    for names, accepted in DECLARED_ACCEPTS.items():
        cond = d.isin(*names)
        expr = F.when(cond, _accepts_col(a, accepted)) if expr is None else expr.when(cond, _accepts_col(a, accepted))
    return expr.otherwise(a == d)


def native_type_ok_col(connector: str, declared: Column, native: Column) -> Column:
    """Column form of :func:`native_type_ok` for one connector."""
    rules = NATIVE_ACCEPTS[connector]
    d = F.lower(F.trim(declared))
    n = F.upper(F.trim(native))
    expr = None
    for names, accepted in rules.items():
        cond = d.isin(*names)
        ok = n.isin(*accepted)
        expr = F.when(cond, ok) if expr is None else expr.when(cond, ok)
    return expr.otherwise(F.lower(n) == d)


def declared_for_col(actual: Column) -> Column:
    """Column form of :func:`declared_for`; ``unmapped`` when no name exists."""
    a = F.lower(actual)
    expr = None
    for prefix, name in CANONICAL_DECLARED:
        cond = a.startswith(prefix) if prefix.endswith("(") else a == F.lit(prefix)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(UNMAPPED))
