"""Classify warehouse objects from an information-schema union.

Input rows ``(k, n, v1, v2)``: ``k='T'`` gives object ``n`` its type ``v1``;
``k='C'`` a column ``v1`` of native type ``v2``; ``k='D'`` a description ``v2``
for column ``v1``. One ``groupBy(n)`` folds them per object. Columns per object
are bounded by the warehouse's own column limit (10,000 in BigQuery), so the
per-object maps stay small whatever the number of objects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Object types read as a table, and those read through a query job.
TABLE_TYPES = ("BASE TABLE", "CLONE", "SNAPSHOT")
QUERY_TYPES = ("VIEW", "MATERIALIZED VIEW", "EXTERNAL")


def fold_objects(meta: DataFrame) -> DataFrame:
    """Per object: its type, column->type map and non-blank column descriptions.

    One scan, two aggregates: repeated metadata rows collapse per (object,
    kind, column) first, then each object folds its rows. Both levels combine
    map-side, so an object repeated across many rows is reduced per task.
    """
    k, v1, v2 = F.col("k"), F.col("v1"), F.col("v2")
    rows = meta.where(k.isin("T", "C", "D") & ((k == "T") | v1.isNotNull()))
    blank = F.trim(F.coalesce(v2, F.lit(""))) == ""
    level1 = rows.groupBy(
        "n", "k", F.when(k == "T", F.lit(None).cast("string")).otherwise(v1).alias("c")
    ).agg(
        F.max(F.when(k == "T", v1)).alias("t"),
        F.max(F.when(~((k == "D") & blank), v2)).alias("v"),
    )
    k1, c, v = F.col("k"), F.col("c"), F.col("v")
    return level1.groupBy("n").agg(
        F.max("t").alias("object_type"),
        F.map_from_entries(F.collect_list(F.when(k1 == "C", F.struct(c.alias("v1"), v.alias("v2"))))).alias("columns"),
        F.map_from_entries(
            F.collect_list(F.when((k1 == "D") & v.isNotNull(), F.struct(c.alias("v1"), v.alias("v2"))))
        ).alias("descriptions"),
    )


def classify_objects(meta: DataFrame) -> DataFrame:
    """A10: (object, object_type, kind, n_columns, n_described, columns, descriptions)."""
    f = fold_objects(meta)
    t = F.upper(F.col("object_type"))
    kind = (
        F.when(t.isin(*TABLE_TYPES), F.lit("table"))
        .when(t.isin(*QUERY_TYPES), F.lit("query"))
        .when(t.isNull(), F.lit("missing"))
        .otherwise(F.lit("unsupported"))
    )
    return f.select(
        F.col("n").alias("object"),
        "object_type",
        kind.alias("kind"),
        F.size("columns").cast("long").alias("n_columns"),
        F.size("descriptions").cast("long").alias("n_described"),
        "columns",
        "descriptions",
    )
