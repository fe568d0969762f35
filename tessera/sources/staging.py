"""Preflight a query, stage a DataFrame once to Parquet, report what was staged.

Staging evaluates a plan exactly once: the delta, every guard and the replay
check then read identical rows, even when the source is a live database or the
plan is nondeterministic. It also cuts the lineage. The staging folder lives
under ``spark.checkpoint.dir`` (shared storage) so it survives executor loss.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.plans import fs
from tessera.session import scratch_path


@dataclass
class Staged:
    df: DataFrame
    path: str
    rows: int
    bytes: int
    metrics: dict = field(default_factory=dict)

    def cleanup(self) -> None:
        try:
            fs.delete(self.df.sparkSession, self.path, True)
        except Exception:
            pass


def stage_parquet(df: DataFrame, prefix: str | None = None, metrics: dict | None = None) -> Staged:
    """Write ``df`` once to a unique scratch folder and read it back.

    ``metrics`` are extra aggregate Columns computed in the same write job
    (``observe``), e.g. ``max(cursor)`` for a watermark advance: no second scan.
    """
    spark = df.sparkSession
    path = prefix.rstrip("/") + "/" + uuid.uuid4().hex if prefix else scratch_path(spark, "stage")
    obs = Observation(f"stage_{uuid.uuid4().hex[:8]}")
    exprs = [F.count(F.lit(1)).alias("__rows")]
    exprs += [c.alias(n) for n, c in (metrics or {}).items()]
    df.observe(obs, *exprs).write.mode("errorifexists").parquet(path)
    got = obs.get
    rows = int(got["__rows"])
    back = spark.read.schema(df.schema).parquet(path)
    extra = {n: got[n] for n in (metrics or {})}
    return Staged(df=back, path=path, rows=rows, bytes=fs.du(spark, path), metrics=extra)


def staged_info(staged: Staged) -> DataFrame:
    """One row per staged column (column, type, rows), from the staged schema and the write job's count."""
    spark = staged.df.sparkSession
    rows = [(f.name, f.dataType.simpleString(), staged.rows) for f in staged.df.schema.fields]
    return spark.createDataFrame(rows, "column string, type string, rows long")


@dataclass
class Preflight:
    ok: bool
    bytes: int | None
    error: str | None = None
    warning: str | None = None


def size_estimate(df: DataFrame) -> int | None:
    """Estimated bytes from the optimized plan's statistics (no job); None when unavailable."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None


def preflight(spark: SparkSession, sql: str) -> Preflight:
    """Analyse a query without running it; invalid queries fail, estimated bytes reported.

    Parse and analysis errors raise (the query cannot run); a failure to
    estimate size only warns.
    """
    try:
        df = spark.sql(sql)
    except (ParseException, AnalysisException):
        raise
    size = size_estimate(df)
    if size is None:  # statistics unavailable: warn, do not fail
        return Preflight(ok=True, bytes=None, warning="size estimate unavailable")
    return Preflight(ok=True, bytes=size)
