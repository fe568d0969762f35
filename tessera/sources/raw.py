"""A1: raw file sources (Parquet / CSV / JSON, paths or globs) bound to a view name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import ConfigError
from tessera.model import resolve_uri

# File extension -> reader format.
EXTENSION_FORMATS = {
    ".parquet": "parquet",
    ".pq": "parquet",
    ".csv": "csv",
    ".tsv": "csv",
    ".json": "json",
    ".jsonl": "json",
    ".ndjson": "json",
}


def format_for(uri: str, explicit: str | None = None) -> str:
    if explicit:
        return explicit
    base = uri.rstrip("/").rsplit("/", 1)[-1].lower()
    for ext, fmt in EXTENSION_FORMATS.items():
        if base.endswith(ext):
            return fmt
    raise ConfigError(f"cannot tell the format of {uri!r}; give `format:` (parquet, csv or json)")


def read_raw(
    spark: SparkSession, uri: str, fmt: str | None = None, options: dict | None = None, schema=None
) -> DataFrame:
    fmt = format_for(uri, fmt)
    reader = spark.read.format(fmt)
    opts = dict(options or {})
    if fmt == "csv":
        opts.setdefault("header", "true")
        if uri.lower().endswith(".tsv"):
            opts.setdefault("sep", "\t")
        if schema is None:
            # Auto-detect like a desktop engine would; at scale pass an explicit schema
            # (inference reads the input twice).
            opts.setdefault("inferSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**opts).load(uri)


def bind_raw(
    spark: SparkSession, name: str, uri: str, base_dir: str = ".", fmt: str | None = None,
    options: dict | None = None, schema=None,
) -> DataFrame:
    df = read_raw(spark, resolve_uri(uri, base_dir), fmt, options, schema)
    df.createOrReplaceTempView(name)
    return df
