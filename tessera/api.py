"""One object per product store: the everyday operations, each a thin call into the operators.

    dp = DataProduct(spark, load_product("orders/product.yaml"), root="s3a://lake/products/orders")
    dp.run()                                  # build, verify, commit one snapshot
    dp.release()                              # pin supported routes to LATEST
    dp.read("orders_daily@2", {"region": "north", "limit": "50"}).show()
    dp.status(); dp.history().show(); dp.rollback()

Nothing here moves data through the driver: reads return DataFrames, status
and history are Spark jobs over small metadata tables.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import ReadError
from tessera.model import Export, Product
from tessera.operators import delta, profile, reader
from tessera.plans import catalog, fs, snapshots
from tessera.plans.run import RunResult, run, verify_published
from tessera.plans.store import Store


class DataProduct:
    def __init__(self, spark: SparkSession, product: Product, root: str):
        self.spark = spark
        self.product = product
        self.root = root
        self.store = Store(spark, root)

    # ------------------------------------------------------------ build

    def run(self, full_refresh: bool = False, replay_check: bool = False) -> RunResult:
        return run(self.spark, self.product, self.root, full_refresh=full_refresh, replay_check=replay_check)

    def verify(self, version: int | None = None):
        return verify_published(self.spark, self.product, self.root, version)

    def release(self) -> tuple[dict, list[str]]:
        return snapshots.release(self.spark, self.root, self.product)

    def rollback(self, to: int | None = None) -> tuple[int, int, DataFrame]:
        """Move LATEST back; also returns what happens to each watermark."""
        current = self.store.latest()
        marks_now = self.watermarks(current)
        old, new = snapshots.rollback(self.spark, self.root, to)
        return old, new, delta.watermark_diff(marks_now, self.watermarks(new))

    # ------------------------------------------------------------ metadata

    def watermarks(self, version: int | None = None) -> DataFrame:
        m = self.store.manifest(version) or {}
        return delta.watermarks_df(self.spark, m.get("watermarks", []))

    def status(self) -> dict:
        """Build status (H5) plus each declared incremental source's mark."""
        st = catalog.status(self.spark, self.root, self.product, catalog.source_check_fresh(self.spark, self.root, self.product))
        declared = self.spark.createDataFrame(
            [(s.name, s.incremental.cursor) for s in self.product.incremental_sources()], "source string, cursor string"
        )
        st["watermarks"] = delta.watermark_status(declared, self.watermarks())
        st["last_run"] = self._summary(self.store.latest())
        return st

    def _summary(self, version: int | None) -> dict | None:
        """The published run's summary, trimmed to what a status line shows."""
        if version is None:
            return None
        path = self.store.path("history", f"{version}.json")
        if not fs.exists(self.spark, path):
            return None
        h = json.loads(fs.read_text(self.spark, path))
        return {
            "execution": h.get("execution"), "outcome": h.get("outcome"), "started_at": h.get("started_at"),
            "finished_at": h.get("finished_at"),
            "tables": {t["table"]: t["rows"] for t in h.get("transforms", [])},
        }

    def history(self) -> DataFrame:
        return catalog.run_history(self.spark, self.root)

    def sources(self) -> DataFrame:
        """What every run read from each source (H6)."""
        return catalog.source_history(self.spark, self.root)

    def context(self) -> dict:
        """The discoverable interface as one document (H4/H9)."""
        doc = catalog.catalog_doc(self.product)
        doc["digest"] = catalog.interface_digest(self.product)
        doc["execution"] = self.store.latest()
        doc["pins"] = self.store.releases().get("routes", {})
        described = catalog.source_descriptions(self.spark, self.root, self.product)
        if described:
            doc["source_descriptions"] = described
        return doc

    def catalog(self) -> DataFrame:
        """One row per discoverable export column (H4)."""
        return catalog.catalog(self.spark, [self.product])

    def upstreams(self) -> DataFrame:
        """Declared upstream products joined to what the published run read (H7)."""
        latest = self.store.latest()
        path = self.store.path("history", f"{latest}.json") if latest is not None else None
        summary = json.loads(fs.read_text(self.spark, path)) if path and fs.exists(self.spark, path) else None
        return catalog.upstreams(self.spark, self.product, summary)

    def attach(self, version: int | None = None, prefix: str = "") -> dict[str, DataFrame]:
        return snapshots.attach(self.spark, self.root, version, prefix)

    # ------------------------------------------------------------ reads

    def export(self, route: str) -> Export:
        try:
            e = self.product.export(route)
        except KeyError:
            raise ReadError(f"no export {route!r}; routes are {[x.route for x in self.product.exports]}") from None
        if e.bind is not None:
            raise ReadError(f"export {e.route!r} is bound to a live source and is verified, not served")
        return e

    def table(self, route: str) -> DataFrame:
        """The export's table at its pin (supported) or at LATEST (experimental)."""
        e = self.export(route)
        return snapshots.read_export_table(self.spark, self.root, e)

    def read(
        self, route: str, params: dict[str, str] | None = None, as_json: bool = False, after: dict[str, str | None] | None = None
    ) -> DataFrame:
        """Closed read (I1-I6): grain equality filters, limit/offset pages in grain order.

        ``after`` (a value per grain column) gives the page that follows that row, at any depth for the price of the first.
        """
        e = self.export(route)
        p = params or {}
        checked = reader.validate_params(e, p)  # fail before any job
        df = self.table(route)
        if after is not None:
            if checked.offset:
                raise ReadError("give either `offset` or `after`")
            page = reader.read_after(df, e, after, checked.limit, checked.filters)
            return reader.to_json_rows(page) if as_json else page
        return reader.read_json(df, e, p) if as_json else reader.read_export(df, e, p)

    def probe(self, route: str) -> dict:
        """Coverage, distinct values of string grain columns and an example request (H1-H3)."""
        e = self.export(route)
        df = self.table(route)
        return profile.probe_document(df, e)

    # ------------------------------------------------------------ retention

    def expire(self, retention_days: int = snapshots.DEFAULT_RETENTION_DAYS, now: datetime | None = None) -> dict:
        """Expire old unpinned versions; remove data that has been unreferenced for a full window."""
        now = now or datetime.now(timezone.utc).replace(tzinfo=None)
        window = timedelta(days=retention_days)
        swept = snapshots.sweep_orphans(self.spark, self.root, now - window)
        expired = snapshots.expire(self.spark, self.root, now - window, now=now)
        return {"expired_versions": expired, "removed_paths": swept}

    def freshness(self, now: datetime | None = None) -> DataFrame:
        """Age of the published snapshot and of each upstream read by the last run (H7/H8)."""
        m = self.store.manifest() or {}
        rows = [("self", m.get("version"), m.get("committed_at"))]
        for s in m.get("sources", []):
            if s.get("kind") == "product":
                rows.append((s["name"], s.get("version"), s.get("data_as_of")))
        df = self.spark.createDataFrame(rows, "source string, execution long, data_as_of string")
        if now is not None and now.tzinfo is None:
            now = now.replace(tzinfo=timezone.utc)  # naive means UTC, like every stored time
        now_col = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        ts = F.concat(F.col("data_as_of"), F.lit("Z")).cast("timestamp")  # stored times are UTC text
        return df.withColumn(
            "age", F.when(ts.isNull(), F.lit("unknown")).otherwise(profile.freshness_age(ts, now_col))
        )
