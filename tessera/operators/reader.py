"""The closed read over an export: projection, grain equality filters, ordered pages, JSON.

Parameters are validated before any job: only grain columns, ``limit`` and
``offset`` are accepted. Pages are cut from a total order (the grain, unique by
verification; or every column) with NULLs last, so paging never skips or
repeats rows. The filter literal is cast to the column's type (never the
column to the literal's), so it reaches the Parquet scan as a pushed filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ReadError
from tessera.model import Export
from tessera.operators.profile import column_field

# Page size default and cap, deepest allowed offset.
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
MAX_OFFSET = 1_000_000
#: Skipped rows a task may carry; a deeper page first finds the range of its rank.
CARRIED = 1 << 16
#: Ranges the rows are counted in at a time.
RANGES = 32


@dataclass
class ReadParams:
    filters: list[tuple[str, str]]
    limit: int
    offset: int


def page_number(name: str, given: str | None, default: int, most: int) -> int:
    """A page parameter: decimal digits, ``default`` when absent."""
    if given is None:
        return default
    text = str(given)
    if not text.isascii() or not text.isdigit():
        raise ReadError(f"{name} must be an integer from 0 to {most}; got {given!r}")
    return int(text)


def validate_params(export: Export, params: dict[str, str]) -> ReadParams:
    """Grain filters, ``limit`` (cut to its maximum) and ``offset`` (refused beyond its maximum); nothing else."""
    known = {*export.grain, "limit", "offset"}
    for name in sorted(set(params) - known):
        raise ReadError(f"unknown parameter {name!r} for {export.route}; known are {', '.join(sorted(known))}")
    offset = page_number("offset", params.get("offset"), 0, MAX_OFFSET)
    if offset > MAX_OFFSET:
        raise ReadError(f"offset {offset}: the maximum is {MAX_OFFSET}, narrow the read by its grain")
    limit = min(MAX_LIMIT, page_number("limit", params.get("limit"), DEFAULT_LIMIT, MAX_LIMIT))
    return ReadParams([(g, params[g]) for g in export.grain if g in params], limit, offset)


def project(df: DataFrame, export: Export) -> DataFrame:
    """Declared columns in declared order; every column when none is declared."""
    if not export.schema:
        return df
    return df.select(*[F.col(column_field(df, c).name).alias(c) for c in export.schema])


def apply_filters(df: DataFrame, filters: list[tuple[str, str]]) -> DataFrame:
    """ANDed equality filters, literal cast to the column type (a bad literal raises)."""
    for col, value in filters:
        f = column_field(df, col)
        df = df.where(F.col(f.name) == F.lit(value).cast(f.dataType))
    return df


def order_columns(df: DataFrame, export: Export) -> list[Column]:
    """Grain order, else all columns (maps cannot be ordered and are skipped); NULLs last."""
    if export.grain:
        return [F.col(column_field(df, c).name).asc_nulls_last() for c in export.grain]
    return [F.col(f.name).asc_nulls_last() for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]


def read_export(df: DataFrame, export: Export, params: dict[str, str] | None = None, carried: int = CARRIED) -> DataFrame:
    """One page of an export as a DataFrame.

    No task keeps more than ``carried`` skipped rows: a deeper page is cut by rank (``page_at``).
    """
    p = validate_params(export, params or {})
    out = apply_filters(project(df, export), p.filters)
    names = _order_names(out, export)
    if p.offset > carried and p.limit and all(_portable(out.schema[n].dataType) for n in names):
        return page_at(out, names, p.offset, p.limit, carried)
    out = out.orderBy(*order_columns(out, export))
    if p.offset:
        out = out.offset(p.offset)
    return out.limit(p.limit)


# ------------------------------------------------------------------ pages by rank


def _order_names(df: DataFrame, export: Export) -> list[str]:
    if export.grain:
        return [column_field(df, c).name for c in export.grain]
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]


def _portable(dt: T.DataType) -> bool:
    """Types whose values survive the way to the driver and back as a literal."""
    return isinstance(dt, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _carry(col: Column, dt: T.DataType) -> Column:
    return F.unix_micros(col).cast("string") if isinstance(dt, T.TimestampType) else col.cast("string")


def _literal(text: str | None, dt: T.DataType) -> Column:
    return _from_text(F.lit(text), dt)


def _beyond(fields: list[T.StructField], at: tuple) -> Column:
    """Rows after ``at`` in the order of ``fields``, NULLs last."""
    after, same = F.lit(False), F.lit(True)
    for f, text in zip(fields, at, strict=True):
        col, value = F.col(f.name), _literal(text, f.dataType)
        later = F.lit(False) if text is None else (col > value) | col.isNull()
        after, same = after | (same & later), same & col.eqNullSafe(value)
    return after


def _equals(fields: list[T.StructField], at: tuple) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f.name).eqNullSafe(_literal(t, f.dataType)) for f, t in zip(fields, at, strict=True)))


def page_at(df: DataFrame, names: list[str], offset: int, limit: int, carried: int = CARRIED) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order of ``names`` (NULLs last), without carrying the skipped ones.

    The rows are counted in ``RANGES`` ranges of the order, cut at the keys of smallest hash (a sample of bounded size
    that any layout gives alike); prefix sums name the range of the wanted rank, which is cut again until at most
    ``carried`` rows of it precede the page. Only the order columns are read for that, log(rows) times; the last range
    and what follows it are then filtered, so a task keeps ``carried + limit`` rows at most.
    """
    fields = [df.schema[n] for n in names]
    order = [F.col(n).asc_nulls_last() for n in names]
    low, skipped, part = None, 0, df.select(*names)
    key = F.xxhash64(*names)
    while offset - skipped > carried:
        keys = part.select(*(_carry(F.col(f.name), f.dataType).alias(f.name) for f in fields), key.alias("__h"))
        sample = keys.orderBy("__h", *names).limit(RANGES - 1).collect()
        cuts = list(dict.fromkeys(tuple(r)[:-1] for r in sample))
        place = reduce(lambda a, b: a + b, (_beyond(fields, c).cast("int") for c in cuts), F.lit(0))
        counts = {r.place: r.n for r in part.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}
        # Ranges by the number of cuts before them: their own cuts follow from sorting the cuts the way Spark does.
        ranked = _sorted_cuts(df, fields, cuts)
        at, before = 0, skipped
        while before + counts.get(at, 0) <= offset and at < len(cuts):
            before += counts.get(at, 0)
            at += 1
        if before + counts.get(at, 0) <= offset:
            return df.limit(0)  # the page lies past the last row
        bounds = F.lit(True)
        if at > 0:
            bounds = bounds & _beyond(fields, ranked[at - 1])
            low = ranked[at - 1]
        if at < len(cuts):
            bounds = bounds & ~_beyond(fields, ranked[at])
        skipped = before
        narrowed = part.where(bounds)
        if at < len(cuts) and counts.get(at, 0) > carried:
            # One key that fills its range: its rows are alike, any of them serve.
            alike = narrowed.where(_equals(fields, ranked[at])).count()
            if alike == counts[at]:
                left = skipped + alike - offset
                same = df.where(_equals(fields, ranked[at])).limit(min(limit, left))
                rest = df.where(_beyond(fields, ranked[at])).orderBy(*order).limit(max(limit - left, 0))
                return same.unionAll(rest).orderBy(*order)
        part = narrowed
    page = df if low is None else df.where(_beyond(fields, low))
    return page.orderBy(*order).offset(offset - skipped).limit(limit)


def _sorted_cuts(df: DataFrame, fields: list[T.StructField], cuts: list[tuple]) -> list[tuple]:
    """The cuts in Spark's own order (at most ``RANGES`` rows)."""
    rows = df.sparkSession.createDataFrame(
        [(*c, i) for i, c in enumerate(cuts)], T.StructType([*(T.StructField(f.name, T.StringType()) for f in fields), T.StructField("__i", T.IntegerType())])
    )
    typed = rows.select(*(_from_text(F.col(f.name), f.dataType).alias(f.name) for f in fields), "__i")
    return [cuts[r["__i"]] for r in typed.orderBy(*(F.col(f.name).asc_nulls_last() for f in fields)).collect()]


def _from_text(col: Column, dt: T.DataType) -> Column:
    return F.timestamp_micros(col.cast("long")) if isinstance(dt, T.TimestampType) else col.cast(dt)


def read_after(
    df: DataFrame, export: Export, last: dict[str, str | None], limit: int = DEFAULT_LIMIT, filters: list[tuple[str, str]] | None = None
) -> DataFrame:
    """The page that follows the row whose grain values are ``last`` (keyset paging).

    Deep pages cost what the first one does: the position is a filter on the grain, so each task keeps only
    ``limit`` rows, where an offset makes every task carry all skipped rows. Order as in ``read_export``, NULLs last.
    """
    if not export.grain or set(last) != set(export.grain):
        raise ReadError(f"give a value for each grain column of {export.route}: {', '.join(export.grain) or 'it has none'}")
    out = apply_filters(project(df, export), filters or [])
    beyond, same = F.lit(False), F.lit(True)
    for name in export.grain:
        f = column_field(out, name)
        col, value = F.col(f.name), F.lit(last[name]).cast(f.dataType)
        later = F.lit(False) if last[name] is None else (col > value) | col.isNull()
        beyond, same = beyond | (same & later), same & col.eqNullSafe(value)
    return out.where(beyond).orderBy(*order_columns(out, export)).limit(min(limit, MAX_LIMIT))


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row; NULL fields kept; timestamps rendered as text first."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.col(f.name).cast("string").alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            cols.append(F.col(f.name).cast("string").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("j"))


def read_json(df: DataFrame, export: Export, params: dict[str, str] | None = None) -> DataFrame:
    return to_json_rows(read_export(df, export, params))
