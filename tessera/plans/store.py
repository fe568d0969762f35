"""Snapshot store on Parquet: immutable data directories + one JSON manifest per version.

Layout under a store root (local path, HDFS or object store)::

    data/<table>/<uuid>/[__bucket=<b>/]part-*.parquet   immutable, written by Spark jobs
    versions/<N>.json                                    manifest of version N
    LATEST                                               pointer to the published version
    releases.json                                        pins per supported route
    history/<N>.json                                     run summary of the run that made N

A manifest lists every table's schema, key, bucket count, row count and the
explicit directories that hold its rows, plus the watermarks and the landed
stream batches. A reader opens one manifest and lists those directories; it
never globs ``data/``. Keyed tables are hash-bucketed on the key
(``pmod(murmur3(key), B)``, the shuffle partition id; B chosen again when the buckets outgrow their
target) so an upsert rewrites only the buckets its delta touches and carries the rest over by reference.

Commit is the exclusive creation of ``versions/<N>.json`` with N one past the
greatest existing version (never LATEST+1: after a rollback LATEST is not the
maximum), retried up to three times on collision, then LATEST moves. That is
safe on local file systems and HDFS; on object stores it relies on
create-if-absent, so run one writer per store root.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import StoreError
from tessera.plans import fs

BUCKET_COL = "__bucket"
COMMIT_ATTEMPTS = 3
# Target bytes per bucket when a keyed table is created without an explicit count.
BUCKET_TARGET_BYTES = 256 * 1024 * 1024
MIN_BUCKETS = 8
MAX_BUCKETS = 16384


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def iso(ts: datetime) -> str:
    return ts.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


@dataclass
class TableState:
    """One table inside a manifest."""

    name: str
    schema: T.StructType
    key: list[str] = field(default_factory=list)
    buckets: int | None = None
    parts: list[dict] = field(default_factory=list)  # [{"bucket": b or None, "dir": relative dir}]
    rows: int = 0
    strategy: str = "replace"
    statement: str | None = None
    touched: list[int] | None = None  # buckets rewritten by the landing that produced this state
    basis: str | None = None  # of a rollup: the digest of the table state it holds

    def to_json(self) -> dict:
        return {
            "name": self.name,
            "schema": self.schema.json(),
            "key": list(self.key),
            "buckets": self.buckets,
            "parts": list(self.parts),
            "rows": int(self.rows),
            "strategy": self.strategy,
            "statement": self.statement,
            "touched": self.touched,
            "basis": self.basis,
            "bucket_function": BUCKET_FUNCTION if self.buckets else None,
        }

    @staticmethod
    def from_json(d: dict) -> "TableState":
        return TableState(
            name=d["name"],
            schema=T.StructType.fromJson(json.loads(d["schema"])),
            key=list(d.get("key") or []),
            buckets=d.get("buckets"),
            parts=list(d.get("parts") or []),
            rows=int(d.get("rows") or 0),
            strategy=d.get("strategy", "replace"),
            statement=d.get("statement"),
            touched=d.get("touched"),
            basis=d.get("basis"),
        )

    @property
    def digest(self) -> str:
        """Names the stored rows: part directories are immutable, so equal lists hold equal rows."""
        return hashlib.sha256("\n".join(sorted(p["dir"] for p in self.parts)).encode()).hexdigest()

    @property
    def bytes(self) -> int:
        """Stored bytes of the table's parts, as measured when they were written."""
        return sum(int(p.get("bytes") or 0) for p in self.parts)

    def dirs(self, buckets: set[int] | None = None) -> list[str]:
        if buckets is None:
            return [p["dir"] for p in self.parts]
        return [p["dir"] for p in self.parts if p.get("bucket") in buckets]


# Fixed value: name of the bucket function recorded in every manifest.
BUCKET_FUNCTION = "pmod(murmur3(key), B)"


def bucket_of(key: list[str], buckets: int):
    """Bucket of a key: Spark's own hash-partition id for ``repartition(B, *key)``.

    So a shuffle on the key into B (or any power-of-two divisor or multiple of
    B) partitions is bucket-aligned: every task holds whole buckets, joins on
    the key need no second exchange, and the write produces one file per bucket
    per task.
    """
    return F.pmod(F.hash(*[F.col(k) for k in key]), F.lit(buckets)).cast("int")


def part_dir_of(path):
    """The part directory (relative to the store root) of a data file path Column."""
    return F.regexp_extract(path, r".*/(data/[A-Za-z0-9_]+/[0-9a-f]{32}(?:/" + BUCKET_COL + r"=\d+)?)/[^/]+$", 1)


def buckets_for_bytes(nbytes: int) -> int:
    """Bucket count for a new keyed table: a power of two near bytes/target, clamped."""
    want = max(MIN_BUCKETS, -(-int(nbytes) // BUCKET_TARGET_BYTES))
    b = 1
    while b < want:
        b *= 2
    return min(b, MAX_BUCKETS)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # ----------------------------------------------------------- paths

    def path(self, *parts: str) -> str:
        return fs.join(self.root, *parts)

    # ----------------------------------------------------------- versions

    def versions(self) -> list[int]:
        """Readable versions; an empty manifest (a writer that died) is none."""
        return sorted(v for v, size in self._manifest_sizes().items() if size > 0)

    def _manifest_sizes(self) -> dict[int, int]:
        files = fs.list_dir(self.spark, self.path("versions"))
        return {int(name[:-5]): size for name, is_dir, _, size in files if not is_dir and name.endswith(".json") and name[:-5].isdigit()}

    def latest(self) -> int | None:
        p = self.path("LATEST")
        if not fs.exists(self.spark, p):
            return None
        text = fs.read_text(self.spark, p).strip()
        return int(text) if text else None

    def manifest(self, version: int | None = None) -> dict | None:
        v = self.latest() if version is None else version
        if v is None:
            return None
        p = self.path("versions", f"{v}.json")
        if not fs.exists(self.spark, p):
            raise StoreError(f"version {v} does not exist in {self.root}")
        return json.loads(fs.read_text(self.spark, p))

    def tables(self, version: int | None = None) -> dict[str, TableState]:
        m = self.manifest(version)
        if m is None:
            return {}
        return {d["name"]: TableState.from_json(d) for d in m["tables"]}

    def lineage(self, version: int) -> list[int]:
        """Versions whose rows ``version`` was built on (itself first), as its manifest records them.

        Recorded, not walked: expired ancestors stay in the lineage. Manifests written before the record existed
        are followed by their parents as far as those still exist.
        """
        m = self.manifest(version)
        out = [version]
        while "lineage" not in m:
            parent = m.get("parent")
            if parent is None or parent in out:
                return out
            out.append(parent)
            if parent not in self.versions():
                return out
            m = self.manifest(parent)
        return out + [v for v in m["lineage"] if v not in out]

    def set_latest(self, version: int) -> None:
        fs.write_text(self.spark, self.path("LATEST"), str(version), overwrite=True)

    # ----------------------------------------------------------- reads

    def read_state(self, state: TableState, buckets: set[int] | None = None) -> DataFrame:
        dirs = state.dirs(buckets)
        if not dirs:
            return self.spark.createDataFrame(self.spark.sparkContext.emptyRDD(), state.schema)
        return self.spark.read.schema(state.schema).parquet(*[self.path(d) for d in dirs])

    def read_dirs(self, state: TableState, dirs: set[str]) -> DataFrame:
        """Rows of the listed part directories of ``state`` only."""
        chosen = [p["dir"] for p in state.parts if p["dir"] in dirs]
        if not chosen:
            return self.spark.createDataFrame(self.spark.sparkContext.emptyRDD(), state.schema)
        return self.spark.read.schema(state.schema).parquet(*[self.path(d) for d in chosen])

    def read_table(self, table: str, version: int | None = None) -> DataFrame:
        """A table at LATEST or at a given version (time travel)."""
        tables = self.tables(version)
        if table not in tables:
            raise StoreError(f"table {table!r} is not in version {version if version is not None else self.latest()}")
        return self.read_state(tables[table])

    # ----------------------------------------------------------- writes

    def _new_dir(self, table: str) -> str:
        return f"data/{table}/{uuid.uuid4().hex}"

    def write_plain(self, df: DataFrame, table: str) -> tuple[list[dict], int]:
        """Write rows to a fresh directory; returns (parts, rows). Rows counted in the same job."""
        rel = self._new_dir(table)
        obs = Observation(f"w_{uuid.uuid4().hex[:8]}")
        df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(self.path(rel))
        rows = int(obs.get["rows"])
        size = fs.du(self.spark, self.path(rel))
        return ([{"bucket": None, "dir": rel, "bytes": size}] if rows > 0 else []), rows

    def write_bucketed(
        self, df: DataFrame, table: str, key: list[str], buckets: int, clustered: bool = False
    ) -> tuple[list[dict], int]:
        """Write rows hash-bucketed on ``key`` into a fresh directory, one sub-directory per bucket.

        Unless the caller says the rows are already ``clustered`` by bucket (each
        task holding few buckets), ``rebalance`` on the bucket column lets AQE
        size the write tasks (split a large bucket over several files, merge
        small ones); keys are unique in a keyed table, so buckets are balanced.
        """
        rel = self._new_dir(table)
        obs = Observation(f"w_{uuid.uuid4().hex[:8]}")
        out = df if BUCKET_COL in df.columns else df.withColumn(BUCKET_COL, bucket_of(key, buckets))
        if not clustered:
            out = out.hint("rebalance", BUCKET_COL)
        (
            out.observe(obs, F.count(F.lit(1)).alias("rows"))
            .write.mode("errorifexists")
            .partitionBy(BUCKET_COL)
            .parquet(self.path(rel))
        )
        rows = int(obs.get["rows"])
        parts = []
        for name, is_dir, _, _ in fs.list_dir(self.spark, self.path(rel)):
            if is_dir and name.startswith(BUCKET_COL + "="):
                parts.append({"bucket": int(name.split("=", 1)[1]), "dir": f"{rel}/{name}"})
        parts.sort(key=lambda p: p["bucket"])
        # One measurement per write; keys are hashed, so its buckets are of about one size.
        size = fs.du(self.spark, self.path(rel)) if parts else 0
        for p in parts:
            p["bytes"] = size // len(parts)
        return parts, rows

    # ----------------------------------------------------------- commit

    def commit(
        self,
        tables: dict[str, TableState],
        watermarks: list[dict] | None = None,
        product: str | None = None,
        parent: int | None = None,
        extra: dict | None = None,
        committed_at: datetime | None = None,
    ) -> int:
        """G1: publish all tables and watermarks as one new version, or nothing."""
        fs.mkdirs(self.spark, self.path("versions"))
        parent = self.latest() if parent is None else parent
        body = {
            "parent": parent,
            "product": product,
            "committed_at": iso(committed_at or utc_now()),
            "tables": [t.to_json() for t in sorted(tables.values(), key=lambda t: t.name)],
            "watermarks": list(watermarks or []),
        }
        body.update(extra or {})
        before = self.lineage(parent) if parent is not None else []
        last_err = None
        for _ in range(COMMIT_ATTEMPTS):
            n = max([0, *self._manifest_sizes(), *self.tombstoned()]) + 1
            body["version"], body["lineage"] = n, [n, *before]
            try:
                fs.write_text(self.spark, self.path("versions", f"{n}.json"), json.dumps(body), overwrite=False)
            except FileExistsError as e:  # another writer took N
                last_err = e
                continue
            self.set_latest(n)
            return n
        raise StoreError(f"could not commit after {COMMIT_ATTEMPTS} attempts: {last_err}")

    # ----------------------------------------------------------- tombstones

    def tombstoned(self) -> list[int]:
        """Expired versions whose data may still lie in the store."""
        files = fs.list_dir(self.spark, self.path("tombstones"))
        return sorted(int(name[:-5]) for name, is_dir, _, _ in files if not is_dir and name[:-5].isdigit())

    def bury(self, version: int, expired_at: datetime) -> None:
        """Replace a version's manifest and run summary by a tombstone that remembers its directories."""
        m = self.manifest(version)
        dirs = sorted({p["dir"] for t in m["tables"] for p in t.get("parts") or []})
        doc = {"version": version, "expired_at": iso(expired_at), "dirs": dirs}
        fs.write_text(self.spark, self.path("tombstones", f"{version}.json"), json.dumps(doc))
        fs.delete(self.spark, self.path("versions", f"{version}.json"), False)
        fs.delete(self.spark, self.path("history", f"{version}.json"), False)

    def tombstones_df(self) -> DataFrame:
        """(version, expired_at, dir) of expired versions."""
        schema = "version bigint, expired_at string, dirs array<string>"
        if not self.tombstoned():
            empty = self.spark.createDataFrame([], schema)
        else:
            empty = self.spark.read.schema(schema).option("multiLine", "true").json(self.path("tombstones", "*.json"))
        return empty.select("version", F.to_timestamp_ntz("expired_at").alias("expired_at"), F.explode_outer("dirs").alias("dir"))

    # ----------------------------------------------------------- release pins

    def releases(self) -> dict:
        p = self.path("releases.json")
        if not fs.exists(self.spark, p):
            return {"routes": {}, "digests": {}}
        return json.loads(fs.read_text(self.spark, p))

    def write_releases(self, doc: dict) -> None:
        fs.write_text(self.spark, self.path("releases.json"), json.dumps(doc, sort_keys=True), overwrite=True)

    # ----------------------------------------------------------- run history

    def write_history(self, version: int, summary: dict) -> None:
        fs.write_text(self.spark, self.path("history", f"{version}.json"), json.dumps(summary), overwrite=True)

    def write_failure(self, summary: dict) -> None:
        """A failed run's record: no version, named by time so it never collides with a commit."""
        stamp = utc_now().strftime("%Y%m%dT%H%M%S%f")
        try:
            fs.write_text(self.spark, self.path("history", f"failed-{stamp}.json"), json.dumps(summary, default=str))
        except Exception:
            pass  # the original error matters more than its record

    # ----------------------------------------------------------- DataFrames over metadata

    def manifests_df(self) -> DataFrame:
        """Every manifest as one row (read by Spark, not looped on the driver)."""
        return self.spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").json(self.path("versions", "*.json"))

    def versions_df(self) -> DataFrame:
        return self.manifests_df().select(
            F.col("version").cast("long").alias("version"),
            F.col("parent").cast("long").alias("parent"),
            F.to_timestamp_ntz("committed_at").alias("committed_at"),  # UTC wall clock, as written
        )

    def referenced_dirs_df(self) -> DataFrame:
        """(version, table, dir) for every directory any manifest references."""
        return (
            self.manifests_df()
            .select("version", F.explode_outer("tables").alias("t"))
            .select("version", F.col("t.name").alias("table"), F.explode_outer("t.parts").alias("p"))
            .select("version", "table", F.col("p.dir").alias("dir"))
            .where(F.col("dir").isNotNull())
        )

    def data_files_df(self) -> DataFrame:
        """Listing of data files (path, modification time, size, directory relative to root).

        Spark lists in parallel once there are many directories; file content is
        never read because only metadata columns are selected.
        """
        data = self.path("data")
        if not fs.exists(self.spark, data):
            return self.spark.createDataFrame([], "path string, mtime timestamp, length long, dir string")
        df = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(data)
            .select("path", F.col("modificationTime").alias("mtime"), "length")
        )
        return df.withColumn("dir", part_dir_of(F.col("path")))


MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("parent", T.LongType()),
        T.StructField("product", T.StringType()),
        T.StructField("committed_at", T.StringType()),
        T.StructField(
            "tables",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("rows", T.LongType()),
                        T.StructField("buckets", T.IntegerType()),
                        T.StructField("strategy", T.StringType()),
                        T.StructField(
                            "parts",
                            T.ArrayType(
                                T.StructType(
                                    [T.StructField("bucket", T.IntegerType()), T.StructField("dir", T.StringType())]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)
