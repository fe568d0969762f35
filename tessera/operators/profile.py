"""H1-H3, H8: probes over an export: coverage, distinct values, an example request, ages.

Every probe is one Spark job: all coverage columns come from a single
aggregate, distinct values stop after the cap plus one, and the example is a
distributed top-1 (no full sort to one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ReadError
from tessera.functions.columns import format_age
from tessera.model import Export

# Fixed value: how many distinct values of a string grain column are listed.
MAX_VALUES = 50
# Fixed value: page size of the example request.
EXAMPLE_LIMIT = 10


def column_field(df: DataFrame, name: str) -> T.StructField:
    """A column by name in any case."""
    for f in df.schema.fields:
        if f.name.lower() == name.lower():
            return f
    raise ReadError(f"column {name!r} is not in the export")


def _time_like(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def probe_coverage(df: DataFrame, export: Export) -> DataFrame:
    """H1: row count plus min/max (as text) of date/timestamp grain columns, one aggregate."""
    aggs = [F.count(F.lit(1)).cast("long").alias("rows")]
    for g in export.grain:
        f = column_field(df, g)
        if _time_like(f.dataType):
            aggs.append(F.min(f.name).cast("string").alias(f"min_{g}"))
            aggs.append(F.max(f.name).cast("string").alias(f"max_{g}"))
    return df.agg(*aggs)


def probe_export(df: DataFrame, export: Export, cap: int = MAX_VALUES) -> DataFrame:
    """H1 to H3 in one scan and one job: (column, value, complete, rows, coverage, example).

    Grouping sets count the whole export once (``column`` NULL: row count, the range of every date or timestamp grain
    column, the example request of the first row by grain) and list the distinct values of each string grain column.
    Partial sums per task come before the shuffle, and a limit per column, applied on both sides of it, lets no task
    hold more than ``cap + 1`` values; a column of more gets one row (NULL, false). An empty export
    has no rows here.
    """
    fields = {g: column_field(df, g) for g in export.grain}
    listed = [g for g in export.grain if isinstance(fields[g].dataType, T.StringType)]
    times = [g for g in export.grain if _time_like(fields[g].dataType)]
    plain = df.select(*(F.col(f.name).alias(g) for g, f in fields.items()))
    rows = plain.select("*", *(F.col(g).alias(f"__v{i}") for i, g in enumerate(listed)))
    whole = F.lit(True)
    for i in range(len(listed)):
        whole = whole & (F.grouping(f"__v{i}") == 1)
    bounds = [F.struct(F.lit(g).alias("column"), F.min(g).cast("string").alias("least"), F.max(g).cast("string").alias("greatest")) for g in times]
    coverage = F.array(*bounds) if bounds else F.lit(None).cast("array<struct<column:string,least:string,greatest:string>>")
    # NULLs last: a flag before each value.
    first = F.min(F.struct(*(c for g in export.grain for c in (F.col(g).isNull().alias(f"n_{g}"), F.col(g).alias(g))))) if export.grain else None
    aggs = [F.count("*").alias("rows"), coverage.alias("coverage"), *([first.alias("first")] if first is not None else [])]
    names = [f"__v{i}" for i in range(len(listed))]
    if names:
        at = F.coalesce(*(F.when(F.grouping(n) == 0, F.lit(g)) for n, g in zip(names, listed, strict=True)))
        aggs += [at.alias("column"), whole.alias("whole")]
        out = rows.groupingSets([[n] for n in names] + [[]], *names).agg(*aggs).withColumn("value", F.coalesce(*names))
    else:
        out = rows.agg(*aggs).withColumns({"column": F.lit(None).cast("string"), "whole": F.lit(True), "value": F.lit(None).cast("string")})
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    out = out.where(F.col("whole") | F.col("value").isNotNull()).withColumn("place", place).where(F.col("place") <= cap + 1)
    over = F.max(F.when(F.col("column").isNotNull(), F.col("place"))).over(Window.partitionBy("column")) > cap
    out = out.withColumn("over", F.coalesce(over, F.lit(False))).where(~F.col("over") | (F.col("place") == 1))
    example = F.lit(None).cast("string")
    if export.grain:
        request = example_column(export.grain, lambda g: F.col(f"first.{g}"))
        example = F.concat(F.lit(export.route + "?"), request, F.lit(f"&limit={EXAMPLE_LIMIT}"))
    return out.select(
        "column",
        F.when(~F.col("over"), F.col("value")).alias("value"),
        F.when(F.col("column").isNotNull(), ~F.col("over")).alias("complete"),
        F.when(F.col("whole"), F.col("rows")).alias("rows"),
        F.when(F.col("whole"), F.col("coverage")).alias("coverage"),
        F.when(F.col("whole"), example).alias("example"),
    )


def probe_document(df: DataFrame, export: Export, cap: int = MAX_VALUES) -> dict:
    """``probe_export`` as one document: coverage, values per string grain column, example."""
    rows = probe_export(df, export, cap).collect()  # at most cap + 1 rows a column, and one
    fields = {g: column_field(df, g).dataType for g in export.grain}
    coverage: dict = {"rows": 0, **{f"{m}_{g}": None for g, t in fields.items() if _time_like(t) for m in ("min", "max")}}
    values: dict = {g: {"values": [], "complete": True} for g, t in fields.items() if isinstance(t, T.StringType)}
    example = None
    for r in sorted(rows, key=lambda r: r["value"] or ""):
        if r["column"] is None:
            coverage["rows"], example = r["rows"], r["example"]
            for c in r["coverage"] or []:
                coverage.update({f"min_{c.column}": c.least, f"max_{c.column}": c.greatest})
        elif r["complete"]:
            values[r["column"]]["values"].append(r["value"])
        else:
            values[r["column"]] = {"values": None, "complete": False}
    return {"coverage": coverage, "values": values, "example": example}


def probe_values(df: DataFrame, column: str, cap: int = MAX_VALUES) -> DataFrame:
    """H2: all non-null distinct values as (value, complete), sorted; with more than ``cap`` of them none is listed.

    A list that is not the whole set would read as data, so an incomplete probe is one row: (NULL, false).
    Partial distinct per task, then a distributed top ``cap + 1`` decides; at most ``cap + 1`` rows go further.
    """
    head = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value").limit(cap + 1)
    complete = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) <= cap
    counted = head.withColumn("complete", complete)
    return counted.select(F.when(F.col("complete"), F.col("value")).alias("value"), "complete").distinct().orderBy("value")


def example_request(export: Export) -> Column:
    """H3 as a Column: ``route?g=v&...&limit=10``, NULL when any grain value is NULL."""
    return F.concat(F.lit(export.route + "?"), example_column(export.grain), F.lit(f"&limit={EXAMPLE_LIMIT}")).alias("example")


def probe_example(df: DataFrame, export: Export) -> str | None:
    """H3: a request for the first row by grain; None without a grain, a row, or a value for every grain column."""
    if not export.grain:
        return None
    first = df.orderBy(*[F.col(g).asc_nulls_last() for g in export.grain]).limit(1).select(example_request(export)).first()
    return first["example"] if first else None


def example_column(grain: list[str], of=F.col) -> Column:
    """H3 as a Column: ``g=v&...`` with RFC 3986 encoding, NULL when any grain value is NULL. ``of`` finds a grain value."""
    parts = [
        F.concat(F.lit(g + "="), F.regexp_replace(F.url_encode(of(g).cast("string")), r"\+", "%20"))
        for g in grain
    ]
    joined = [parts[0]]
    for p in parts[1:]:
        joined += [F.lit("&"), p]
    return F.concat(*joined).alias("example")  # concat is NULL when any part is NULL


def freshness_age(ts: Column, now: Column) -> Column:
    """H8: age of ``ts`` at ``now`` in the compact form."""
    return format_age(F.unix_timestamp(now) - F.unix_timestamp(ts))
