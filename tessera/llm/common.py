"""Small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tessera.session import scratch_path

#: Rows turned into Python objects at a time inside an Arrow batch; bounds a worker's memory.
SLICE = 256


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: lineage ends there.

    A lost executor is then recovered from these files and the upstream work is not repeated.
    """
    path = scratch_path(df.sparkSession, "llm", name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_rows(batches, size: int = SLICE) -> Iterator[list[tuple]]:
    """Lists of at most ``size`` row tuples out of the Arrow batches of one task."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield list(zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True))
