"""A rollup kept up to date from the rows that a landing changed.

A run that upserts a delta knows the rows that came in and the stored rows whose place they took. Both, signed and
grouped, say by how much every affected group changed; the groups' stored rows are read (in their buckets only), added
to and written, all others are carried over by reference. The accumulated table is not read again. A row moved from one
group to another counts against the first and for the second; a group left without rows goes; a delivery that repeats
stored rows cancels out and changes nothing.

That is exact only for a declaration that can be kept this way, whatever the sizes: counts and sums of whole numbers or
decimals, with the row count among them and, for every sum, the count of what it adds (it tells a sum of nothing, NULL,
from zero). Expressions must depend on their row alone. Any other declaration (``min``, ``avg``, a sum of floating
point, ``DISTINCT``) is computed in full by every run, as a plain ``replace`` transform is. So is a rollup that is new,
whose text changed, whose table was built anew or changed by anything but this run's landing (a stream, another
product version).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.model import Rollup, Transform
from tessera.operators.strategy import Changes, Landing, _sorted
from tessera.plans.store import BUCKET_COL, Store, TableState, bucket_of, buckets_for_bytes
from tessera.sources.staging import size_estimate, stage_parquet

EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
# Words whose value is not the row's alone: an old row cannot be taken back with them.
_MOVING = re.compile(r"\b(select|distinct|over|now|current_\w+|localtimestamp|rand\w*|uuid|monotonically_increasing_id|input_file_\w+)\b", re.I)


def maintainable(rollup: Rollup, schema: T.StructType, rows: DataFrame) -> bool:
    """Can changes alone keep the rollup exact? Decided by its declaration and the types of ``rows``, never by sizes."""
    measures = {c: (fn.lower(), e.strip()) for c, (fn, e) in rollup.measures.items()}
    declared = set(measures.values())
    if ("count", "*") not in declared:
        return False
    for column, (fn, e) in measures.items():
        if fn == "sum":
            if ("count", e) not in declared or not isinstance(schema[column].dataType, EXACT):
                return False
        elif fn != "count":
            return False
    texts = [*rollup.by.values(), *(e for _, e in measures.values() if e != "*")]
    if any(_MOVING.search(e) for e in texts):
        return False
    try:
        rows.select(*(F.expr(e) for e in texts))  # analysed, not run
    except ParseException:  # several arguments, a FILTER clause
        return False
    return True


def _counted(rollup: Rollup, expression: str) -> str:
    """The column that counts ``expression``."""
    return next(c for c, (fn, e) in rollup.measures.items() if fn.lower() == "count" and e.strip() == expression.strip())


def group_changes(changes: Changes, rollup: Rollup, schema: T.StructType) -> DataFrame:
    """By how much each measure of each group changed; groups whose changes cancel out are left out."""

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        def value(column: str, fn: str, e: str) -> Column:
            if fn.lower() == "sum":
                v = F.expr(e).cast(schema[column].dataType)
                return v if sign > 0 else -v
            one = F.lit(sign).cast("long")
            return one if e.strip() == "*" else F.when(F.expr(e).isNotNull(), one)

        return rows.select(*(F.expr(e).alias(c) for c, e in rollup.by.items()),
                           *(value(c, fn, e).alias(c) for c, (fn, e) in rollup.measures.items()))

    rows = signed(changes.new, 1)
    if changes.old is not None:
        rows = rows.unionAll(signed(changes.old, -1))
    moved = reduce(lambda a, b: a | b, (F.col(f"`{c}`") != 0 for c in rollup.measures))
    return _added(rows, rollup, schema).where(moved)


def _added(rows: DataFrame, rollup: Rollup, schema: T.StructType) -> DataFrame:
    sums = [F.coalesce(F.sum(f"`{c}`"), F.lit(0)).cast(schema[c].dataType).alias(c) for c in rollup.measures]
    return rows.groupBy(*(F.col(f"`{c}`") for c in rollup.by)).agg(*sums)


def merge_groups(stored: DataFrame, moved: DataFrame, rollup: Rollup) -> DataFrame:
    """Stored groups with the changes added; groups without rows are gone, sums of nothing are NULL again."""
    schema = stored.schema
    both = _added(stored.unionByName(moved.select(*(F.col(f"`{c}`") for c in stored.columns))), rollup, schema)
    n = F.col(f"`{_counted(rollup, '*')}`")
    below = F.raise_error(F.lit("rollup: a group has fewer rows than none; run a full refresh")).cast("boolean")
    both = both.where(F.when(n < 0, below).otherwise(n > 0))

    def measure(c: str) -> Column:
        fn, e = rollup.measures[c]
        if fn.lower() != "sum":
            return F.col(f"`{c}`")
        return F.when(F.col(f"`{_counted(rollup, e)}`") > 0, F.col(f"`{c}`")).alias(c)

    return both.select(*(measure(f.name) if f.name in rollup.measures else F.col(f"`{f.name}`") for f in schema.fields))


def land_rollup(
    store: Store, t: Transform, df: DataFrame, before: dict[str, TableState], after: dict[str, TableState],
    changes: Changes | None, statement: str,
) -> Landing:
    """The rollup's table after this run: from the changes where they suffice, else from ``df``, the whole SELECT."""
    rollup, stored, base = t.rollup, before.get(t.name), after[t.rollup.of]
    by = list(rollup.by)
    held = before.get(rollup.of)
    current = (
        changes is not None and stored is not None and held is not None and stored.basis == held.digest
        and stored.statement == statement and (t.buckets or stored.buckets) == stored.buckets
    )
    if not current or not maintainable(rollup, df.schema, changes.new):
        nb = t.buckets or buckets_for_bytes(stored.bytes if stored is not None else min(size_estimate(df) or 0, base.bytes))
        parts, rows = store.write_bucketed(df, t.name, by, nb)
        st = TableState(t.name, df.schema, by, nb, parts, rows, "replace", statement, basis=base.digest)
        return Landing(st, rows, len(parts), nb)
    moved = stage_parquet(group_changes(changes, rollup, stored.schema))
    try:
        if moved.rows == 0:
            st = TableState(t.name, stored.schema, by, stored.buckets, stored.parts, stored.rows, "replace", statement, basis=base.digest)
            return Landing(st, 0, 0, stored.buckets)
        buckets = bucket_of(by, stored.buckets)
        touched = set(moved.df.agg(F.collect_set(buckets).alias("b")).first()["b"])  # at most the bucket count
        old = store.read_state(stored, touched)
        replaced = old.count()
        merged = merge_groups(old, moved.df, rollup)
        parts, rows = store.write_bucketed(merged.withColumn(BUCKET_COL, buckets), t.name, by, stored.buckets)
    finally:
        moved.cleanup()
    kept = [p for p in stored.parts if p["bucket"] not in touched]
    total = stored.rows - replaced + rows
    st = TableState(t.name, stored.schema, by, stored.buckets, _sorted(kept + parts), total, "replace", statement,
                    touched=sorted(touched), basis=base.digest)
    return Landing(st, moved.rows, len(touched), stored.buckets, rows_rewritten=max(0, rows - moved.rows))
