"""Session helpers: the shared scratch area and local-session defaults.

Lineage is cut by writing Parquet under the folder the cluster names in
``spark.checkpoint.dir`` (shared storage, survives executor loss). We only set
our own folder where the session has none, which is the case in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the session, if any."""
    d = spark.conf.get(CHECKPOINT_CONF, None)
    if d:
        return d
    try:
        d = spark.sparkContext.getCheckpointDir()
    except Exception:  # Spark Connect has no SparkContext
        d = None
    return d or None


def ensure_checkpoint_dir(spark: SparkSession, default: str | None = None) -> str:
    """The session's checkpoint folder. Only a local master gets one made for it when none is set.

    On a cluster a folder of the driver's machine would be invisible to executors, so an unset one is an error.
    """
    d = checkpoint_dir(spark)
    if d:
        return d
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share (master {master})")
    d = default or tempfile.mkdtemp(prefix="tessera-ckpt-")
    spark.conf.set(CHECKPOINT_CONF, d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:
        pass
    return d


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    if not base:
        raise RuntimeError(
            "spark.checkpoint.dir is not set: staging needs a shared folder every executor can reach"
        )
    return _join(base, "tessera", *parts, uuid.uuid4().hex)


def _join(base: str, *parts: str) -> str:
    if "://" in base:
        return "/".join([base.rstrip("/"), *parts])
    return os.path.join(base, *parts)


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """A local[N] session with the settings the engine assumes (UTC, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark
