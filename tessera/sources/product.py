"""A3-A5: tables published by another product, at LATEST or pinned to a version."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.store import Store


def bind_product(
    spark: SparkSession, name: str, root: str, table: str, version: int | None = None
) -> tuple[DataFrame, int | None]:
    """Read ``table`` of the product stored at ``root``; returns (frame, version read)."""
    store = Store(spark, root)
    v = store.latest() if version is None else version
    df = store.read_table(table, v)
    df.createOrReplaceTempView(name)
    return df, v


def data_as_of(spark: SparkSession, root: str, version: int | None = None) -> datetime | None:
    """A5: commit time of the pinned version, else the newest; None when unknown (best effort)."""
    try:
        store = Store(spark, root)
        m = store.manifest(version)
        return datetime.fromisoformat(m["committed_at"]) if m else None
    except Exception:
        return None
