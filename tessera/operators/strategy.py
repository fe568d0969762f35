"""Keep-latest, guards, and the three landing strategies.

Guard order is observable and fixed: bootstrap -> NULL keys -> duplicate keys
-> (full refresh) -> schema drift -> write.

Landing works on the key-bucketed layout of :mod:`tessera.plans.store`:
rows with equal keys always live in the same bucket, so ``append`` and
``upsert`` read only the buckets the delta touches. That holds only for a table
laid out on the same key: when a transform's strategy or key changes, or the
buckets have outgrown their target size, the whole table is read, shown unique
on the key and laid out anew before anything lands.

The delta's keys are broadcast to the read only when their measured bytes in
memory are within a bound; otherwise Spark shuffles both sides on the key with
its own partitioning (keys are unique on both sides, so no key can be hot).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import GuardError
from tessera.functions.columns import key_display
from tessera.plans.store import (
    BUCKET_COL,
    BUCKET_TARGET_BYTES,
    Store,
    TableState,
    bucket_of,
    buckets_for_bytes,
    part_dir_of,
)
from tessera.sources.staging import Staged

# Broadcast the delta's keys only up to this many bytes, counted uncompressed with a row's overhead in a hash table.
BROADCAST_DELTA_BYTES = 64 * 1024 * 1024
HASHED_ROW_BYTES = 48
DUP_SAMPLE = 5


# ------------------------------------------------------------------ C6


def keep_latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, ties broken by the remaining columns.

    ``max(struct(order..., rest...))`` is an ordinary aggregate, so Spark combines
    map-side before the shuffle: a key holding a third of all rows costs one
    partial aggregate per task, not one giant sorted window partition.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    packed = F.struct(*[F.col(c) for c in order + rest]).alias("__w")
    agg = df.groupBy(*key).agg(F.max(packed).alias("__w"))
    return agg.select(*key, *[F.col("__w." + c).alias(c) for c in order + rest]).select(*df.columns)


def newer_than_stored(store: Store, delta: DataFrame, key: list[str], order: list[str], current: TableState | None) -> DataFrame:
    """The rows of ``delta`` (one per key) that win over the stored row of their key, by ``keep_latest``'s rule.

    A late older record loses to what an earlier batch has landed, so arrival order does not matter. Only the buckets
    the delta touches are read, and only rows of its keys are compared; a table of another shape is left to the guards.
    """
    if current is None or not current.parts or schema_drift(delta.schema, current.schema):
        return delta
    delta = _conform(delta, current.schema)
    stats = guard_stats(delta, key, current.buckets or 1)
    laid_out = bool(current.buckets) and [k.lower() for k in current.key or []] == [k.lower() for k in key]
    stored = store.read_state(current, stats.touched) if laid_out else store.read_state(current)
    rest = [c for c in delta.columns if c not in key and c not in order]
    packed = F.struct(*(F.col(c) for c in order + rest))
    keys = delta.select(*key)
    bound = F.broadcast(keys) if stats.key_bytes <= BROADCAST_DELTA_BYTES else keys
    old = stored.select(*key, packed.alias("__old")).join(bound, key, "left_semi")
    return delta.join(old, key, "left").where(F.col("__old").isNull() | (packed > F.col("__old"))).select(*delta.columns)


# ------------------------------------------------------------------ guards


def null_key_counts(df: DataFrame, key: list[str]) -> DataFrame:
    """NULL count per key column, all columns in one aggregate."""
    return df.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in key])


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count and a display string."""
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select(*key, key_display(key).alias("key_display"), "n")
    )


def top_duplicates(dups: DataFrame, key: list[str], k: int = DUP_SAMPLE) -> DataFrame:
    """The ``k`` most repeated keys; equal counts ordered by key so the sample is stable."""
    return dups.orderBy(F.col("n").desc(), *[F.col(c).asc_nulls_last() for c in key]).limit(k)


def check_duplicate_keys(df: DataFrame, key: list[str], label: str) -> None:
    enforce_guards(df, key, guard_stats(df, key, 1), label)


def schema_drift(staged: T.StructType, table: T.StructType) -> str | None:
    """First drift between a staged delta and the accumulated table, or None.

    New or retyped columns first, in staging order; then dropped columns, in
    table order. Names compare case-insensitively; positions and nullability
    are ignored.
    """
    tab = {f.name.lower(): f for f in table.fields}
    stg = {f.name.lower(): f for f in staged.fields}
    for f in staged.fields:
        t = tab.get(f.name.lower())
        if t is None:
            return f"the SELECT now returns column {f.name!r} ({f.dataType.simpleString()}) that the table does not have"
        if t.dataType.simpleString() != f.dataType.simpleString():
            return (
                f"column {f.name!r} changed type from {t.dataType.simpleString()} (table) to "
                f"{f.dataType.simpleString()} (SELECT)"
            )
    for t in table.fields:
        if t.name.lower() not in stg:
            return f"the table has column {t.name!r} that the SELECT no longer returns"
    return None


def drift_report(staged: T.StructType, table: T.StructType) -> list[tuple[str, str, str | None, str | None]]:
    """Every difference as (column, change, table_type, select_type); the guard names the first."""
    out = []
    tab = {f.name.lower(): f for f in table.fields}
    stg = {f.name.lower(): f for f in staged.fields}
    for f in staged.fields:
        t = tab.get(f.name.lower())
        if t is None:
            out.append((f.name, "new_column", None, f.dataType.simpleString()))
        elif t.dataType.simpleString() != f.dataType.simpleString():
            out.append((f.name, "type_change", t.dataType.simpleString(), f.dataType.simpleString()))
    for t in table.fields:
        if t.name.lower() not in stg:
            out.append((t.name, "dropped_column", t.dataType.simpleString(), None))
    return out


# ------------------------------------------------------------------ landing


@dataclass
class Changes:
    """What a landing did to its table, row by row; read lazily and only by a rollup that needs it."""

    new: DataFrame  # rows that came in
    old: DataFrame | None = None  # the stored rows whose place they took


@dataclass
class Landing:
    state: TableState
    rows_written: int
    buckets_touched: int  # buckets whose stored files were rewritten (upsert) or that received rows (append)
    buckets_total: int | None
    rows_rewritten: int = 0  # stored rows copied into rewritten buckets
    changes: Changes | None = None  # None: the table was built anew


def _conform(delta: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns matched by name (case-insensitive), in the table's order."""
    lower = {c.lower(): c for c in delta.columns}
    return delta.select(*[F.col(lower[f.name.lower()]).alias(f.name) for f in schema.fields])


@dataclass
class GuardStats:
    nulls: dict[str, int]
    duplicate_keys: int
    touched: set[int]
    key_bytes: int = 0  # of the distinct keys, as a hash table would hold them


def guard_stats(delta: DataFrame, key: list[str], buckets: int) -> GuardStats:
    """D8 + D9 + touched buckets in one job: one ``groupBy(key)`` and a global aggregate over the groups.

    NULL keys form their own groups, so their row counts fall out of the same
    pass; ``collect_set`` of bucket ids is bounded by the bucket count.
    """
    groups = delta.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    aggs = [F.coalesce(F.sum(F.when(F.col(k).isNull(), F.col("__n"))), F.lit(0)).alias(f"__null{i}")
            for i, k in enumerate(key)]
    aggs.append(F.count_if(F.col("__n") > 1).alias("__dups"))
    aggs.append(F.collect_set(bucket_of(key, buckets)).alias("__touched"))
    widths = [F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in key]
    aggs.append(F.coalesce(F.sum(sum(widths, F.lit(HASHED_ROW_BYTES))), F.lit(0)).alias("__bytes"))
    r = groups.agg(*aggs).first()
    return GuardStats(
        nulls={k: int(r[f"__null{i}"]) for i, k in enumerate(key)},
        duplicate_keys=int(r["__dups"]),
        touched={int(b) for b in (r["__touched"] or [])},
        key_bytes=int(r["__bytes"]),
    )


def enforce_guards(delta: DataFrame, key: list[str], stats: GuardStats, label: str) -> None:
    """Raise in the fixed order: NULL keys first, then duplicate keys (with a sample)."""
    for k in key:
        if stats.nulls[k] > 0:
            raise GuardError(
                f"transform {label!r}: key column {k!r} is NULL in {stats.nulls[k]} staged rows; a NULL key cannot "
                f"be matched and would add a new copy every run. Make {k!r} NOT NULL or filter those rows out"
            )
    if stats.duplicate_keys > 0:
        sample = top_duplicates(duplicate_keys(delta, key), key).collect()  # failure path only
        shown = ", ".join(f"{r['key_display']} ({r['n']}x)" for r in sample)
        raise GuardError(
            f"transform {label!r}: key {key} is not unique in the staged delta: {stats.duplicate_keys} key value(s) "
            f"occur more than once (e.g. {shown}). Keep one row per key in the SELECT (keep_latest / "
            f"row_number() = 1 over the key, ordered by the column that should win)"
        )


def land_replace(store: Store, df: DataFrame, table: str, statement: str | None = None) -> Landing:
    """D3: rebuild the table in a fresh directory; the manifest swaps it in."""
    parts, rows = store.write_plain(df, table)
    st = TableState(name=table, schema=df.schema, parts=parts, rows=rows, strategy="replace", statement=statement)
    return Landing(st, rows, 0, None)


def land_keyed(
    store: Store,
    staged: Staged,
    table: str,
    key: list[str],
    strategy: str,
    current: TableState | None,
    full_refresh: bool = False,
    label: str | None = None,
    buckets: int | None = None,
    statement: str | None = None,
) -> Landing:
    """D1/D2/D5/D6 with guards D7-D10 in the fixed order."""
    label = label or table
    delta = staged.df
    bootstrap = current is None
    if bootstrap:
        # The table takes the delta's schema.
        nb = buckets or buckets_for_bytes(staged.bytes)
        current = TableState(name=table, schema=delta.schema, key=list(key), buckets=nb, strategy=strategy)
    nb = current.buckets or buckets_for_bytes(staged.bytes)
    stats = guard_stats(delta, key, nb)
    enforce_guards(delta, key, stats, label)
    if full_refresh:
        # Rebuild from the staged rows; drift is allowed, guards above still ran. The bucket
        # count is chosen again from the rebuilt size, so a table that grew gets more buckets.
        nb = buckets or buckets_for_bytes(staged.bytes)
        parts, rows = store.write_bucketed(delta, table, key, nb)
        st = TableState(table, delta.schema, list(key), nb, parts, rows, strategy, statement)
        return Landing(st, rows, len(parts), nb)
    drift = schema_drift(delta.schema, current.schema)
    if drift:
        raise GuardError(
            f"transform {label!r}: schema drift: {drift}. The accumulated table keeps its schema; "
            "run a full refresh to rebuild it with the new shape"
        )
    delta = _conform(delta, current.schema)
    want = _layout_needed(current, key, buckets, staged.bytes)
    relaid = 0
    if want is not None:
        current = lay_out(store, current, key, want, label)
        relaid, nb = current.rows, want
        stats.touched = guard_stats(delta, key, nb).touched
    if staged.rows == 0:
        st = TableState(table, current.schema, list(key), nb, current.parts, current.rows, strategy, statement)
        return Landing(st, 0, 0, nb, rows_rewritten=relaid, changes=Changes(delta))
    touched = stats.touched
    if not current.parts:
        # Empty table: nothing to reconcile against.
        parts, rows = store.write_bucketed(delta, table, key, nb)
        st = TableState(table, current.schema, list(key), nb, parts, rows, strategy, statement)
        return Landing(st, rows, len(parts), nb)
    target = store.read_state(current, touched)
    small = stats.key_bytes <= BROADCAST_DELTA_BYTES
    bound = F.broadcast if small else (lambda df: df)
    if strategy == "append":
        # Only keys absent from the table; stored rows are never rewritten. What matches is at most the delta.
        existing = target.select(*key).join(bound(delta.select(*key)), key, "left_semi") if small else target.select(*key)
        parts, rows = store.write_bucketed(delta.join(bound(existing), key, "left_anti"), table, key, nb)
        st = TableState(table, current.schema, list(key), nb, _sorted(current.parts + parts), current.rows + rows,
                        strategy, statement)
        return Landing(st, rows, len(parts), nb, rows_rewritten=relaid,
                       changes=Changes(store.read_dirs(st, {p["dir"] for p in parts})))
    # Matched keys take every non-key column from the delta; unmatched keys are inserted.
    # 1) Which delta keys already exist, and in which part directories: only the key column (and the
    #    file path) of the touched buckets is read; one aggregate returns the match count and the
    #    directory set (bounded by the directories of those buckets, which compaction keeps small).
    dkeys = delta.select(*key)
    matched, rewrite_dirs = 0, set()
    if current.dirs(touched):
        located = target.select(*key, part_dir_of(F.col("_metadata.file_path")).alias("__dir"))
        existing = located.join(bound(dkeys), key, "left_semi")
        r = existing.agg(F.count(F.lit(1)).alias("n"), F.collect_set("__dir").alias("d")).first()
        matched, rewrite_dirs = int(r["n"]), set(r["d"] or [])
    rewrite = {p["bucket"] for p in current.parts if p["dir"] in rewrite_dirs}
    # 2) One write. Only directories holding an updated key are rewritten (their rows minus updated
    #    keys); every other delta row is a new key and lands as a new file in its bucket. Updates to
    #    recently inserted keys rewrite only the recent directories, inserts rewrite nothing. The number
    #    of write tasks follows from the rows (rebalance), not from the bucket count.
    incoming = delta.withColumn(BUCKET_COL, bucket_of(key, nb)).hint("rebalance", BUCKET_COL)
    out = incoming
    if rewrite_dirs:
        # Broadcast keys meet stored rows where they lie (each file holds one bucket): no shuffle.
        kept = store.read_dirs(current, rewrite_dirs).join(bound(dkeys), key, "left_anti")
        kept = kept.withColumn(BUCKET_COL, bucket_of(key, nb))
        out = (kept if small else kept.hint("rebalance", BUCKET_COL)).unionByName(incoming)
    parts, rows = store.write_bucketed(out, table, key, nb, clustered=True)
    carried = [p for p in current.parts if p["dir"] not in rewrite_dirs]
    total = current.rows - matched + staged.rows
    st = TableState(table, current.schema, list(key), nb, _sorted(carried + parts), total, strategy, statement,
                    touched=sorted(rewrite))
    replaced = store.read_dirs(current, rewrite_dirs).join(bound(dkeys), key, "left_semi") if rewrite_dirs else None
    return Landing(st, rows, len(rewrite), nb, rows_rewritten=rows - staged.rows + relaid, changes=Changes(delta, replaced))


def _layout_needed(current: TableState, key: list[str], buckets: int | None, incoming: int) -> int | None:
    """The bucket count a stored table must be laid out with before rows can land on ``key``; None if it fits.

    It does not fit when it was written without buckets (``replace``), on another key, in another number of buckets
    than the transform names, or, where it names none, when its buckets have grown past twice their target size.
    """
    if not current.parts:
        return None
    stored = current.bytes
    if not current.buckets or [k.lower() for k in current.key] != [k.lower() for k in key]:
        return buckets or buckets_for_bytes(stored + incoming)
    if buckets is not None:
        return buckets if buckets != current.buckets else None
    if stored + incoming > 2 * BUCKET_TARGET_BYTES * current.buckets:
        wider = buckets_for_bytes(stored + incoming)
        return wider if wider > current.buckets else None
    return None


def lay_out(store: Store, current: TableState, key: list[str], buckets: int, label: str) -> TableState:
    """The whole stored table written again, bucketed on ``key``, after a scan has shown it unique on that key."""
    rows = store.read_state(current)
    names = {f.name.lower(): f.name for f in current.schema.fields}
    missing = [k for k in key if k.lower() not in names]
    if missing:
        raise GuardError(f"transform {label!r}: the stored table has no key column {missing[0]!r}; run a full refresh")
    enforce_guards(rows, key, guard_stats(rows, key, buckets), f"{label} (rows already stored)")
    parts, n = store.write_bucketed(rows, current.name, key, buckets)
    return TableState(current.name, current.schema, list(key), buckets, parts, n, current.strategy, current.statement)


# A bucket holding more directories than this is rewritten into one by the next landing.
COMPACT_DIRS_PER_BUCKET = 8


def compact(store: Store, state: TableState, max_dirs: int = COMPACT_DIRS_PER_BUCKET) -> tuple[TableState, int]:
    """Rewrite buckets that accumulated more than ``max_dirs`` directories (appends add one per run).

    Only the crowded buckets are read and rewritten; rows are unchanged, so the
    result keeps the row count. Returns (new state, buckets compacted).
    """
    if not state.buckets:
        return state, 0
    per: dict[int, int] = {}
    for p in state.parts:
        per[p["bucket"]] = per.get(p["bucket"], 0) + 1
    crowded = {b for b, n in per.items() if n > max_dirs}
    if not crowded:
        return state, 0
    parts, _ = store.write_bucketed(store.read_state(state, crowded), state.name, state.key, state.buckets)
    kept = [p for p in state.parts if p["bucket"] not in crowded]
    out = TableState(state.name, state.schema, state.key, state.buckets, _sorted(kept + parts), state.rows,
                     state.strategy, state.statement, touched=state.touched)
    return out, len(crowded)


def _sorted(parts: list[dict]) -> list[dict]:
    return sorted(parts, key=lambda p: (p.get("bucket") is None, p.get("bucket") or 0, p["dir"]))


def append_by_key(target: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """D1 as a pure DataFrame: the table after appending keys it does not have."""
    return target.unionByName(delta.join(target.select(*key), key, "left_anti").select(*target.columns))


def upsert_by_key(target: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """D2 as a pure DataFrame: the table after an upsert of ``delta``."""
    return target.join(delta.select(*key), key, "left_anti").unionByName(delta.select(*target.columns))

