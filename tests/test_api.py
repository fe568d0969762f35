import json
import os
from datetime import datetime, timedelta

import pytest

from tessera.api import DataProduct
from tessera.errors import ReadError
from tessera.model import ColumnSpec, Export, Incremental, Product, Source, Transform, load_product
from tessera.plans import flagship
from tessera.sources.staging import stage_parquet

FIXTURE = os.path.join(os.path.dirname(__file__), "fixtures", "orders", "product.yaml")


def test_build_release_read_probe_context(spark, root):
    dp = DataProduct(spark, load_product(FIXTURE), root)
    dp.run()
    dp.release()
    dp.run()
    rows = [json.loads(r.j) for r in dp.read("orders_daily@2", {"region": "north"}, as_json=True).collect()]
    assert [r["order_date"] for r in rows] == ["2025-03-01", "2025-03-02"]
    with pytest.raises(ReadError, match="no export"):
        dp.read("nope@1")
    with pytest.raises(ReadError, match="unknown parameter"):
        dp.read("orders_daily@2", {"revenue": "1"})
    pages = [r.j for r in dp.read("orders_daily@2", {"limit": "4"}, as_json=True).collect()]
    last = {k: json.loads(pages[1])[k] for k in ("order_date", "region")}
    assert [r.j for r in dp.read("orders_daily@2", {"limit": "2"}, as_json=True, after=last).collect()] == pages[2:4]
    with pytest.raises(ReadError, match="either"):
        dp.read("orders_daily@2", {"offset": "1"}, after=last)
    p = dp.probe("orders_daily@2")
    assert p["coverage"] == {"rows": 4, "min_order_date": "2025-03-01", "max_order_date": "2025-03-02"}
    assert p["values"]["region"] == {"values": ["north", "south", "west"], "complete": True}
    assert p["example"] == "orders_daily@2?order_date=2025-03-01&region=north&limit=10"
    ctx = dp.context()
    assert ctx["pins"] == {"orders_daily@2": 1} and ctx["execution"] == 2 and len(ctx["digest"]) == 64
    st = dp.status()
    assert st["status"] == "verified" and st["last_run"]["outcome"] == "success"
    assert st["last_run"]["tables"] == {"stg_orders": 5, "orders_daily": 4}
    assert dp.history().select("execution").distinct().count() == 2


def test_bound_exports_are_not_served(spark, sf, root):
    p = Product(name="b", sources={"orders": Source(name="orders", uri=f"{sf}/orders.parquet")},
                transforms=[Transform(name="t", sql="SELECT 1 AS one")],
                exports=[Export(name="raw_orders", bind="orders", grain=["o_orderkey"])])
    dp = DataProduct(spark, p, root)
    dp.run()
    with pytest.raises(ReadError, match="bound"):
        dp.read("raw_orders@1")


def test_rollback_reports_watermark_rewinds_and_status(spark, sf, root):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    head = stage_parquet(ev.where("ts < '2024-01-20'")).path

    def product(uri):
        return Product(
            name="ev", sources={"events": Source(name="events", uri=uri, format="parquet",
                                                 incremental=Incremental("ts"))},
            transforms=[Transform(name="acc", sql="SELECT event_id, ts FROM events", strategy="upsert",
                                  key=["event_id"])],
            exports=[Export(name="acc", schema={"event_id": ColumnSpec("bigint")})])

    dp = DataProduct(spark, product(head), root)
    assert dp.status()["watermarks"].first().status == "next run bootstraps"
    dp.run()
    dp = DataProduct(spark, product(f"{sf}/events.parquet"), root)
    dp.run()
    assert dp.status()["watermarks"].first().status == "incremental"
    old, new, diff = dp.rollback()
    assert (old, new) == (2, 1)
    d = diff.collect()
    assert len(d) == 1 and d[0].change == "rewind" and d[0].from_mark > d[0].to_mark


def test_expire_and_freshness(spark, sf, root):
    dp = DataProduct(spark, flagship.orders_product(sf), root)
    for _ in range(3):
        dp.run()
    future = datetime.now() + timedelta(days=100)
    out = dp.expire(retention_days=30, now=future)
    assert out["expired_versions"] == [1, 2] and out["removed_paths"] == 0  # open readers keep a full window
    later = dp.expire(retention_days=30, now=future + timedelta(days=31))
    assert later["expired_versions"] == [] and later["removed_paths"] == 4
    assert dp.table("orders_daily@2").count() > 0
    fr = dp.freshness(now=future).first()
    assert fr.source == "self" and (fr.age.startswith("99d") or fr.age.startswith("100d"))


def test_upstreams_and_catalog(spark, sf, tmp_path):
    up_root, down_root = str(tmp_path / "up"), str(tmp_path / "down")
    DataProduct(spark, flagship.orders_product(sf), up_root).run()
    down = Product(
        name="monthly",
        sources={"daily": Source(name="daily", kind="product", product="orders", root=up_root, table="orders_daily")},
        transforms=[Transform(name="m", sql="SELECT region, count(*) AS n FROM daily GROUP BY region")],
        exports=[Export(name="m", grain=["region"], schema={"region": ColumnSpec("string")})],
    )
    dp = DataProduct(spark, down, down_root)
    dp.run()
    up = dp.upstreams().first()
    assert (up.source, up.product, up.execution) == ("daily", "orders", 1) and up.data_as_of is not None
    assert [r.column for r in dp.catalog().collect()] == ["region"]
