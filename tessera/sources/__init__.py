"""Sources: raw files, upstream product tables, JDBC tables/queries, staging, metadata."""

from tessera.sources.raw import bind_raw, read_raw
from tessera.sources.staging import preflight, stage_parquet, staged_info

__all__ = ["bind_raw", "preflight", "read_raw", "stage_parquet", "staged_info"]
