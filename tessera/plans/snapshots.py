"""Attach, release pins, meaning drift, rollback, retention, orphan sweep, pinned reads."""

from __future__ import annotations

import hashlib
import logging
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import StoreError
from tessera.model import Export, Product
from tessera.plans import fs
from tessera.plans.store import Store, utc_now

log = logging.getLogger("tessera")

# Fixed value: default retention window in days.
DEFAULT_RETENTION_DAYS = 30
_SEP = "\u001f"


def attach(spark: SparkSession, root: str, version: int | None = None, prefix: str = "") -> dict[str, DataFrame]:
    """Register every table of a snapshot as a temp view (read-only: views over immutable files)."""
    store = Store(spark, root)
    out = {}
    for name, st in store.tables(version).items():
        df = store.read_state(st)
        df.createOrReplaceTempView(prefix + name)
        out[prefix + name] = df
    return out


# ------------------------------------------------------------------ release


def description_digest(e: Export) -> str:
    """What an export means: its description, units and column descriptions, in a fixed order."""
    parts = [e.description or ""]
    for col, spec in e.schema.items():
        parts += [col, spec.unit or "", spec.description or ""]
    return hashlib.sha256(_SEP.join(parts).encode("utf-8")).hexdigest()


def release(spark: SparkSession, root: str, product: Product) -> tuple[dict, list[str]]:
    """Pin LATEST for supported, non-bound exports; warn on meaning drift at an unchanged version."""
    store = Store(spark, root)
    latest = store.latest()
    warnings = []
    if latest is None:
        raise StoreError("nothing has been committed; run before releasing")
    doc = store.releases()
    routes = dict(doc.get("routes", {}))
    digests = dict(doc.get("digests", {}))
    versions = dict(doc.get("versions", {}))
    pinned = 0
    for e in product.exports:
        if e.contract != "supported" or e.bind is not None:
            continue
        d = description_digest(e)
        if versions.get(e.route) == e.version and digests.get(e.route) not in (None, d):
            warnings.append(
                f"{e.route}: description changed but version {e.version} did not; readers of the pinned "
                "contract see a different meaning"
            )
        routes[e.route] = latest
        digests[e.route] = d
        versions[e.route] = e.version
        pinned += 1
    if pinned == 0:
        warnings.append("no supported, non-bound export: nothing to pin")
    doc = {"routes": routes, "digests": digests, "versions": versions}
    store.write_releases(doc)
    return doc, warnings


def description_changes(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """G5 as a join: routes whose version is unchanged but whose meaning digest moved.

    Both inputs: (route, version, description, units, column_descriptions).
    """
    def digest(df):
        return df.select(
            "route", "version",
            F.sha2(F.concat_ws(_SEP, F.coalesce("description", F.lit("")), F.coalesce("units", F.lit("")),
                               F.coalesce("column_descriptions", F.lit(""))), 256).alias("digest"),
        )
    p = digest(prev).select("route", F.col("version").alias("prev_version"), F.col("digest").alias("prev_digest"))
    c = digest(cur)
    j = c.join(p, "route", "inner")
    return j.where((F.col("version") == F.col("prev_version")) & (F.col("digest") != F.col("prev_digest"))).select(
        "route", "version", "prev_digest", "digest"
    )


def export_version(export: Export, pins: dict) -> int | None:
    """Supported exports read their pin, experimental ones read LATEST (None)."""
    if export.contract == "supported":
        return pins.get("routes", {}).get(export.route)
    return None


def read_export_table(spark: SparkSession, root: str, export: Export) -> DataFrame:
    store = Store(spark, root)
    v = export_version(export, store.releases())
    return store.read_table(export.table, v)


# ------------------------------------------------------------------ rollback


def rollback(spark: SparkSession, root: str, to: int | None = None) -> tuple[int, int]:
    """Make an earlier version the published one; returns (from, to).

    Without ``to`` it is the version published before LATEST. A pinned route must keep its data, so the target's
    lineage has to hold every pin. Later commits are still numbered past the greatest version.
    """
    store = Store(spark, root)
    published = store.latest()
    if published is None:
        raise StoreError("this store has not published anything yet")
    known = store.versions()
    target = max((v for v in known if v < published), default=None) if to is None else to
    if target is None:
        raise StoreError(f"version {published} is the oldest one kept: there is no earlier version")
    if target == published:
        raise StoreError(f"nothing to do: the store already points at version {target}")
    if target not in known:
        raise StoreError(f"version {target} does not exist; kept versions: {', '.join(map(str, known))}")
    held = set(store.lineage(target))
    lost = {route: pin for route, pin in store.releases().get("routes", {}).items() if pin not in held}
    if lost:
        named = "; ".join(f"{route} is pinned to version {pin}" for route, pin in sorted(lost.items()))
        raise StoreError(f"version {target} was not built on every released version: {named}")
    store.set_latest(target)
    return published, target


# ------------------------------------------------------------------ retention


def _utc_text(ts) -> str:
    """A cutoff as UTC wall-clock text; naive datetimes are taken as UTC, strings pass through."""
    if isinstance(ts, datetime):
        if ts.tzinfo is not None:
            ts = ts.astimezone(timezone.utc).replace(tzinfo=None)
        return ts.strftime("%Y-%m-%d %H:%M:%S.%f")
    return str(ts)


def _cutoff(ts, dtype) -> F.Column:
    """The cutoff as a literal comparable with a column of ``dtype``, independent of any time zone setting."""
    if isinstance(dtype, T.TimestampType):
        aware = ts if isinstance(ts, datetime) else datetime.fromisoformat(str(ts))
        aware = aware if aware.tzinfo is not None else aware.replace(tzinfo=timezone.utc)
        return F.lit(aware).cast(dtype)
    return F.lit(_utc_text(ts)).cast(dtype)


def select_expirable(versions: DataFrame, pins: DataFrame, cutoff) -> DataFrame:
    """Versions committed before ``cutoff``, not pinned, and not the newest.

    ``versions``: (version, committed_at); ``pins``: (version). A naive cutoff is UTC.
    """
    newest = versions.agg(F.max("version").alias("m")).first()["m"]  # one scalar
    old = versions.where(F.col("committed_at") < _cutoff(cutoff, versions.schema["committed_at"].dataType))
    unpinned = old.join(pins.select("version").distinct(), "version", "left_anti")
    return unpinned.where(F.col("version") != F.lit(newest)).select("version", "committed_at")


def expire(spark: SparkSession, root: str, cutoff: datetime, keep_pins: bool = True, now: datetime | None = None) -> list[int]:
    """Expire versions committed before ``cutoff``: manifest and run summary go, a tombstone stays.

    The data stays readable for whoever opened it; ``sweep_orphans`` removes it a window after the tombstone's time.
    """
    store = Store(spark, root)
    pins = store.releases().get("routes", {}) if keep_pins else {}
    pin_df = spark.createDataFrame([(int(v),) for v in set(pins.values())], "version long")
    latest = store.latest()
    doomed = select_expirable(store.versions_df(), pin_df, cutoff).where(F.col("version") != F.lit(latest or -1))
    out = sorted(int(r["version"]) for r in doomed.select("version").collect())  # one small int per manifest
    for v in out:
        try:
            store.bury(v, _aware(now) if now else utc_now())
        except Exception as e:  # retention never fails a run
            log.warning("could not expire version %s: %s", v, e)
    return out


def _aware(ts: datetime) -> datetime:
    return ts if ts.tzinfo is not None else ts.replace(tzinfo=timezone.utc)


def orphan_files(listing: DataFrame, referenced: DataFrame, cutoff, tombstones: DataFrame | None = None) -> DataFrame:
    """Data files no manifest references and that have been unreferenced since before ``cutoff``.

    A directory of an expired version counts from its latest tombstone (``tombstones``: dir, expired_at), however
    old its files are; a directory no version ever referenced (a refused run) counts from its files' time.
    """
    refs = referenced.select("dir").distinct()
    loose = listing.join(refs, "dir", "left_anti")
    if tombstones is None:
        return loose.where(F.col("mtime") < _cutoff(cutoff, listing.schema["mtime"].dataType))
    buried = tombstones.where("dir is not null").groupBy("dir").agg(F.max("expired_at").alias("__expired"))
    old_file = F.col("mtime") < _cutoff(cutoff, listing.schema["mtime"].dataType)
    old_grave = F.col("__expired") < _cutoff(cutoff, tombstones.schema["expired_at"].dataType)
    return loose.join(buried, "dir", "left").where(F.when(F.col("__expired").isNull(), old_file).otherwise(old_grave)).drop("__expired")


def orphan_deletions(orphans: DataFrame, referenced: DataFrame) -> DataFrame:
    """What to delete for a set of orphan directories, as few paths as possible.

    A write directory (``data/<table>/<uuid>``) none of whose buckets is
    referenced goes as one path; a write directory some of whose buckets are
    still carried by a manifest loses only its orphan bucket directories.
    """
    write_dir = r"^(data/[^/]+/[0-9a-f]{32})"
    o = orphans.select("dir").distinct().withColumn("write_dir", F.regexp_extract("dir", write_dir, 1))
    live = referenced.select(F.regexp_extract("dir", write_dir, 1).alias("write_dir")).distinct()
    whole = o.join(live, "write_dir", "left_anti").select(F.col("write_dir").alias("path")).distinct()
    partial = o.join(live, "write_dir", "left_semi").select(F.col("dir").alias("path"))
    return whole.unionByName(partial)


def sweep_orphans(spark: SparkSession, root: str, cutoff: datetime, workers: int = 16) -> int:
    """Delete data unreferenced since before ``cutoff`` (G8); returns the number of paths removed.

    Paths stream through the driver a partition at a time and are deleted side by side; a path that cannot be
    deleted is left for the next sweep. Tombstones whose time is over go last, so an interrupted sweep repeats.
    """
    from concurrent.futures import ThreadPoolExecutor

    store = Store(spark, root)
    refs, graves = store.referenced_dirs_df(), store.tombstones_df()
    orphans = orphan_files(store.data_files_df(), refs, cutoff, graves)
    paths = orphan_deletions(orphans, refs)

    def remove(path: str) -> int:
        try:
            fs.delete(spark, store.path(path), True)
            return 1
        except Exception as e:
            log.warning("could not remove %s: %s", path, e)
            return 0

    removed = 0
    with ThreadPoolExecutor(max_workers=workers) as pool:
        held: list[str] = []
        for row in paths.toLocalIterator():
            held.append(row["path"])
            if len(held) >= 1000:
                removed += sum(pool.map(remove, held))
                held = []
        removed += sum(pool.map(remove, held))
    over = graves.where(F.col("expired_at") < _cutoff(cutoff, graves.schema["expired_at"].dataType)).select("version").distinct()
    for row in over.toLocalIterator():
        fs.delete(spark, store.path("tombstones", f"{row['version']}.json"), False)
    return removed
