"""A declared interface inferred from a live source's schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.declared_types import declared_for_col, native_declared_for


def infer_interface(df: DataFrame, native: dict[str, str] | None = None, connector: str | None = None) -> DataFrame:
    """Rows (position, column, declared, native): ``unmapped`` where no declared name fits.

    Where a warehouse-native type is known, its canonical name wins. Descriptions
    are never copied.
    """
    spark = df.sparkSession
    rows = []
    for i, f in enumerate(df.schema.fields):
        nat = (native or {}).get(f.name.lower())
        override = native_declared_for(connector, nat) if (nat and connector) else None
        rows.append((i, f.name, f.dataType.simpleString(), nat, override, bool(nat and connector)))
    rep = spark.createDataFrame(
        rows, "position int, column string, spark_type string, native_type string, native_declared string, has_native boolean"
    )
    declared = F.when(F.col("has_native"), F.coalesce("native_declared", F.lit("unmapped"))).otherwise(
        declared_for_col(F.col("spark_type"))
    )
    return rep.select(
        "position", "column", declared.alias("declared"),
        F.coalesce("native_type", "spark_type").alias("native"),
    )
