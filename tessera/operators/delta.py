"""Incremental deltas behind a watermark.

A delta is ``cursor > mark`` (strictly; NULL cursors never qualify) or, with no
watermark yet, the whole source including NULL cursors (bootstrap). Lookback
moves the mark back by a fixed window so late rows are re-delivered; delivery
is at-least-once, so the landing strategy must be replay-safe.

The mark literal is cast to the cursor column's own type so the comparison
stays on the column untouched and reaches the scan as a pushed filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ConfigError, StoreError
from tessera.functions.duration import parse_duration
from tessera.sources.staging import Staged, stage_parquet

WATERMARK_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("cursor_column", T.StringType(), False),
        T.StructField("mark_ts", T.TimestampNTZType()),
        T.StructField("mark_date", T.DateType()),
        T.StructField("mark_int", T.LongType()),
        T.StructField("last_delta_rows", T.LongType()),
    ]
)

MARK_COLUMN = {"timestamp": "mark_ts", "date": "mark_date", "integer": "mark_int"}
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def cursor_kind(dtype: T.DataType) -> str | None:
    """Closed set of cursor types: timestamps, dates, integers, scale-0 decimals."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, _INTEGERS):
        return "integer"
    if isinstance(dtype, T.DecimalType) and dtype.scale == 0:
        return "integer"
    return None


def validate_cursor(df: DataFrame, cursor: str, source: str = "source") -> tuple[str, list[str]]:
    """The cursor exists and has a cursor type; a nullable cursor only warns."""
    fields = {f.name.lower(): f for f in df.schema.fields}
    f = fields.get(cursor.lower())
    if f is None:
        cols = ", ".join(x.name for x in df.schema.fields)
        raise ConfigError(f"source {source!r}: cursor column {cursor!r} not found; columns are {cols}")
    kind = cursor_kind(f.dataType)
    if kind is None:
        raise ConfigError(
            f"source {source!r}: cursor {cursor!r} has type {f.dataType.simpleString()}; "
            "a cursor must be a timestamp, a date or an integer"
        )
    warnings = []
    if f.nullable:
        warnings.append(
            f"source {source!r}: cursor {cursor!r} is nullable; rows with a NULL cursor are read only at bootstrap"
        )
    return kind, warnings


def validate_lookback(kind: str, lookback: str | None, source: str = "source") -> timedelta | None:
    """Integer cursors take no lookback; date cursors whole days; timestamps any seconds."""
    if lookback is None:
        return None
    d = parse_duration(lookback)
    if kind == "integer":
        raise ConfigError(f"source {source!r}: lookback needs a time cursor; {lookback!r} on an integer cursor")
    if kind == "date" and d.total_seconds() % 86400 != 0:
        raise ConfigError(f"source {source!r}: a date cursor takes lookback in whole days, got {lookback!r}")
    return d


def apply_lookback(mark, kind: str, lookback: timedelta | None):
    """Move the mark back by the window (one driver value, no job)."""
    if lookback is None or mark is None:
        return mark
    if kind == "date":
        return mark - timedelta(days=int(lookback.total_seconds() // 86400))
    return mark - lookback


def typed_mark(mark, dtype: T.DataType) -> Column:
    """The mark as a literal of the column's own type (keeps the filter pushable).

    Marks of zone-aware timestamp cursors are stored as UTC wall-clock values; they
    become UTC-aware literals so no driver or session time zone can shift them.
    """
    if isinstance(dtype, T.TimestampType) and isinstance(mark, datetime) and mark.tzinfo is None:
        mark = mark.replace(tzinfo=timezone.utc)
    return F.lit(mark).cast(dtype)


def stored_mark(value, dtype: T.DataType):
    """A cursor maximum as stored: zone-aware timestamps become UTC wall-clock (PySpark returns them in
    the Python process's local zone); everything else is kept as is."""
    if isinstance(dtype, T.TimestampType) and isinstance(value, datetime):
        return value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def delta_filter(df: DataFrame, cursor: str, mark) -> DataFrame:
    """B1/B2: no mark -> everything (NULL cursors included); else strictly past the mark."""
    if mark is None:
        return df
    dtype = df.schema[cursor].dataType
    return df.where(F.col(cursor) > typed_mark(mark, dtype))


@dataclass
class Advance:
    source: str
    cursor: str
    kind: str
    rows: int
    new_max: object  # None for an empty delta

    def as_row(self) -> dict:
        row = {"source": self.source, "cursor_column": self.cursor, "mark_ts": None, "mark_date": None,
               "mark_int": None, "last_delta_rows": int(self.rows)}
        if self.new_max is not None:
            row[MARK_COLUMN[self.kind]] = self.new_max
        return row


def stage_delta(
    df: DataFrame, cursor: str, mark=None, lookback: str | None = None, source: str = "source",
    prefix: str | None = None,
) -> tuple[Staged, Advance]:
    """Stage the delta once; count and max(cursor) come from the staging write itself."""
    kind, _ = validate_cursor(df, cursor, source)
    window = validate_lookback(kind, lookback, source)
    start = apply_lookback(mark, kind, window)
    delta = delta_filter(df, cursor, start)
    staged = stage_parquet(delta, prefix, metrics={"__max": F.max(cursor)})
    new_max = stored_mark(staged.metrics["__max"], df.schema[cursor].dataType)
    if kind == "integer" and new_max is not None:
        new_max = int(new_max)
    return staged, Advance(source, cursor, kind, staged.rows, new_max)


def pinned_delta(
    df: DataFrame, cursor: str, mark=None, lookback: str | None = None, source: str = "source"
) -> tuple[DataFrame, Advance]:
    """The delta of a file source without copying it.

    A file source resolves its file list once, when it is read, and every later
    use of that DataFrame (guards, landing, replay) scans the same files, so the
    rows are already pinned. Count and ``max(cursor)`` come from one aggregate
    that reads only the cursor column, with the watermark filter pushed to the scan.
    """
    kind, _ = validate_cursor(df, cursor, source)
    window = validate_lookback(kind, lookback, source)
    delta = delta_filter(df, cursor, apply_lookback(mark, kind, window))
    r = compute_advance(delta, cursor).first()
    new_max = stored_mark(r["new_max"], df.schema[cursor].dataType)
    if kind == "integer" and new_max is not None:
        new_max = int(new_max)
    return delta, Advance(source, cursor, kind, int(r["rows"]), new_max)


def compute_advance(delta: DataFrame, cursor: str) -> DataFrame:
    """B7 as a DataFrame: rows and max(cursor) of a delta in one aggregate."""
    return delta.agg(F.count(F.lit(1)).alias("rows"), F.max(cursor).alias("new_max"))


# ------------------------------------------------------------- persisted marks


def watermarks_df(spark, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([_coerce(r) for r in rows], WATERMARK_SCHEMA)


def _coerce(r: dict) -> tuple:
    ts = r.get("mark_ts")
    if isinstance(ts, str):
        ts = datetime.fromisoformat(ts)
    if isinstance(ts, datetime) and ts.tzinfo is not None:
        ts = ts.replace(tzinfo=None)
    d = r.get("mark_date")
    if isinstance(d, str):
        d = date.fromisoformat(d)
    return (r["source"], r["cursor_column"], ts, d, r.get("mark_int"), r.get("last_delta_rows"))


def marks_to_json(rows) -> list[dict]:
    out = []
    for r in rows:
        d = r.asDict() if hasattr(r, "asDict") else dict(r)
        if d.get("mark_ts") is not None:
            d["mark_ts"] = d["mark_ts"].isoformat(sep=" ")
        if d.get("mark_date") is not None:
            d["mark_date"] = d["mark_date"].isoformat()
        out.append(d)
    return out


def check_watermarks(wm: DataFrame) -> DataFrame:
    """Sources with more than one watermark row (should be empty)."""
    return wm.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_unique_watermarks(rows: list[dict]) -> None:
    seen, dups = set(), set()
    for r in rows:
        (dups if r["source"] in seen else seen).add(r["source"])
    if dups:
        raise StoreError(f"watermark table has more than one row for source(s) {sorted(dups)}")


def mark_for(rows: list[dict], source: str, kind: str):
    for r in rows:
        if r["source"] == source:
            v = _coerce(r)
            return {"timestamp": v[2], "date": v[3], "integer": v[4]}[kind]
    return None


def upsert_watermarks(old: DataFrame, advances: DataFrame, full_refresh: bool = False) -> DataFrame:
    """Merge new advances into the persisted marks.

    ``advances`` has the watermark schema (one typed mark column set per row).
    An empty delta (no mark) leaves the source untouched; full refresh
    overwrites the mark; otherwise the mark becomes ``greatest(old, new)``
    (``coalesce`` covers an absent old mark). ``last_delta_rows`` counts every
    staged row, re-delivered ones included.
    """
    adv = advances.where(
        F.col("mark_ts").isNotNull() | F.col("mark_date").isNotNull() | F.col("mark_int").isNotNull()
    )
    a = adv.select(*[F.col(c).alias("n_" + c) for c in WATERMARK_SCHEMA.fieldNames()])
    j = old.join(a, old["source"] == a["n_source"], "full_outer")
    has_new = F.col("n_source").isNotNull()

    def merged(c: str) -> Column:
        new = F.col("n_" + c)
        if full_refresh:
            return F.when(new.isNotNull(), new).otherwise(F.col(c))
        return F.when(new.isNotNull(), F.coalesce(F.greatest(F.col(c), new), new)).otherwise(F.col(c))

    return j.select(
        F.coalesce("n_source", "source").alias("source"),
        F.when(has_new, F.col("n_cursor_column")).otherwise(F.col("cursor_column")).alias("cursor_column"),
        merged("mark_ts").alias("mark_ts"),
        merged("mark_date").alias("mark_date"),
        merged("mark_int").alias("mark_int"),
        F.when(has_new, F.col("n_last_delta_rows")).otherwise(F.col("last_delta_rows")).alias("last_delta_rows"),
    )


def mark_text(prefix: str = "") -> Column:
    """A watermark's value as text, whichever typed column holds it."""
    return F.coalesce(
        F.date_format(F.col(prefix + "mark_ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        F.col(prefix + "mark_date").cast("string"),
        F.col(prefix + "mark_int").cast("string"),
    )


def watermark_status(declared: DataFrame, wm: DataFrame) -> DataFrame:
    """Every declared incremental source with its mark, or a bootstrap note."""
    w = wm.select(
        F.col("source").alias("w_source"), mark_text().alias("mark"), "last_delta_rows"
    )
    j = declared.join(w, declared["source"] == w["w_source"], "left")
    return j.select(
        "source",
        "cursor",
        F.col("mark"),
        F.col("last_delta_rows"),
        F.when(F.col("w_source").isNull(), F.lit("next run bootstraps")).otherwise(F.lit("incremental")).alias("status"),
    )


def watermark_diff(current: DataFrame, target: DataFrame) -> DataFrame:
    """What a rollback does to each current mark: rewind, absent in target, or nothing."""
    c = current.select(F.col("source"), mark_text().alias("from_mark"))
    t = target.select(F.col("source").alias("t_source"), mark_text().alias("to_mark"))
    j = c.join(t, c["source"] == t["t_source"], "left")
    return (
        j.select(
            "source",
            F.when(F.col("t_source").isNull(), F.lit("absent_in_target")).otherwise(F.lit("rewind")).alias("change"),
            "from_mark",
            "to_mark",
        )
        .where((F.col("change") == "absent_in_target") | ~F.col("from_mark").eqNullSafe(F.col("to_mark")))
    )
