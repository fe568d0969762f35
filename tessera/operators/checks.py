"""Multiset comparison, replay equality and shrink detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hash groups of rows whose digests are compared before any row is.
DIGEST_GROUPS = 1024


def _has_map(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType):
        return True
    if isinstance(dt, T.ArrayType):
        return _has_map(dt.elementType)
    if isinstance(dt, T.StructType):
        return any(_has_map(f.dataType) for f in dt.fields)
    return False


def _normal(c, dt: T.DataType):
    """Maps (at any depth) become their entries sorted by key, so equal maps compare equal."""
    if not _has_map(dt):
        return c
    if isinstance(dt, T.MapType):
        entries = F.map_entries(c)
        if _has_map(dt.valueType):
            entries = F.transform(entries, lambda e: F.struct(e["key"].alias("key"),
                                                              _normal(e["value"], dt.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _normal(x, dt.elementType))
    return F.struct(*[_normal(c[f.name], f.dataType).alias(f.name) for f in dt.fields])


def comparable(df: DataFrame) -> DataFrame:
    """Set operations and grouping reject maps: replace every map, at any depth, by its sorted entries."""
    return df.select(*[_normal(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _prints(df: DataFrame) -> tuple:
    """Two 64-bit hashes of a row that differ whenever the row does, but for chance.

    Spark's hash skips NULLs, so each column brings a flag; nested columns are hashed as text, once with their NULLs
    (JSON) and once with their full precision (cast).
    """
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        parts.append(c.isNull())
        if isinstance(f.dataType, (T.ArrayType, T.StructType)):
            parts += [F.to_json(F.struct(c), {"ignoreNullFields": "false"}), c.cast("string")]
        else:
            parts.append(c)
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *reversed(parts))


def group_digests(df: DataFrame, groups: int = DIGEST_GROUPS) -> DataFrame:
    """(part, n, a, b): per hash group of rows a 128-bit digest that no order of the rows changes and every copy does."""
    one, two = _prints(df)
    whole = "decimal(38,0)"
    return df.groupBy(F.pmod(one, F.lit(groups)).alias("part")).agg(
        F.count("*").alias("n"), F.sum(one.cast(whole)).alias("a"), F.sum(two.cast(whole)).alias("b")
    )


def differing_groups(before: DataFrame, after: DataFrame, groups: int = DIGEST_GROUPS) -> list[int]:
    """The hash groups whose digests differ: at most ``groups`` numbers; a task shuffles as many rows at most."""
    a, b = group_digests(before, groups), group_digests(after, groups)
    b = b.select("part", *(F.col(c).alias(f"{c}2") for c in ("n", "a", "b")))
    same = F.lit(True)
    for c in ("n", "a", "b"):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}2"))
    return sorted(r.part for r in a.join(b, "part", "full").where(~same).select("part").collect())


def multiset_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, as (columns..., change, copies).

    ``change`` is 'added' (more copies after) or 'removed'; ``copies`` is the
    difference in multiplicity. Digests of hash groups are compared first; only
    rows of groups that differ reach the signed-count aggregate over the union:
    duplicates count, like ``EXCEPT ALL`` in both directions, in a single
    shuffle with map-side combining (a heavily duplicated row costs one
    partial count per task). Equal tables shuffle digests and no rows.
    """
    a = comparable(before)
    b = comparable(after).select(*a.columns)
    cols = [f"`{c}`" for c in a.columns]
    parts = differing_groups(a, b)

    def some(df: DataFrame) -> DataFrame:
        return df.where(F.pmod(_prints(df)[0], F.lit(DIGEST_GROUPS)).isin(parts)) if len(parts) < DIGEST_GROUPS // 2 else df

    signed = some(a).withColumn("__s", F.lit(-1)).unionByName(some(b).withColumn("__s", F.lit(1)))
    net = signed.groupBy(*cols).agg(F.sum("__s").alias("__net")).where(F.col("__net") != 0)
    return net.select(
        *cols,
        F.when(F.col("__net") > 0, F.lit("added")).otherwise(F.lit("removed")).alias("change"),
        F.abs(F.col("__net")).cast("long").alias("copies"),
    )


def is_same_multiset(before: DataFrame, after: DataFrame) -> bool:
    """Equal digests of every group, else an empty difference (-0.0 and 0.0 differ in print and are one value)."""
    a = comparable(before)
    b = comparable(after).select(*a.columns)
    return not differing_groups(a, b) or multiset_diff(before, after).limit(1).count() == 0


def shrunk_tables(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables present before and after whose row count fell (warning only)."""
    b = before.select(F.col("table_name"), F.col("rows").alias("rows_before"))
    a = after.select(F.col("table_name"), F.col("rows").alias("rows_after"))
    j = b.join(a, "table_name", "inner")
    return j.where(F.col("rows_after") < F.col("rows_before")).select("table_name", "rows_before", "rows_after")
