"""End to end over a YAML product with inline rows: run, verify, release, pinned closed read."""

import json
import os
from decimal import Decimal

import pytest

from tessera.errors import ReadError
from tessera.model import load_product
from tessera.operators import reader
from tessera.plans import catalog as cat
from tessera.plans import snapshots
from tessera.plans.run import run, verify_published
from tessera.plans.store import Store

FIXTURE = os.path.join(os.path.dirname(__file__), "fixtures", "orders", "product.yaml")


def test_fixture_product_lifecycle(spark, root):
    p = load_product(FIXTURE)
    assert [t.name for t in p.transforms] == ["stg_orders", "orders_daily"]
    res = run(spark, p, root)
    v = {x.route: x for x in res.verifications}
    assert v["orders_daily@2"].grain == {"check": "grain_unique", "route": "orders_daily@2",
                                         "grain": ["order_date", "region"], "rows": 4, "distinct_grain": 4}
    doc, warns = snapshots.release(spark, root, p)
    assert doc["routes"] == {"orders_daily@2": 1} and not warns
    run(spark, p, root)  # version 2; the supported route stays pinned to 1
    store = Store(spark, root)
    supported, experimental = p.exports
    assert snapshots.export_version(supported, store.releases()) == 1
    assert snapshots.export_version(experimental, store.releases()) is None

    table = snapshots.read_export_table(spark, root, supported)
    page = reader.read_export(table, supported, {"region": "north"})
    assert [(str(r.order_date), r.revenue) for r in page.collect()] == [
        ("2025-03-01", Decimal("20.00")), ("2025-03-02", Decimal("10.00"))]
    rows = [json.loads(r.j) for r in reader.read_json(table, supported, {"limit": "2", "offset": "1"}).collect()]
    assert rows == [{"order_date": "2025-03-01", "region": "south", "revenue": 99.99},
                    {"order_date": "2025-03-02", "region": "north", "revenue": 10.0}]
    with pytest.raises(ReadError):
        reader.read_export(table, supported, {"amount": "1"})

    assert all(x.ok for x in verify_published(spark, p, root))
    assert cat.status(spark, root, p)["status"] == "verified"


def test_fleet_lists_unreadable_catalog_by_name(spark, tmp_path):
    from tessera.plans import fs
    prefix = str(tmp_path / "fleet")
    fs.write_text(spark, prefix + "/broken/catalog.json", "{not json")
    fs.write_text(spark, prefix + "/future/catalog.json", '{"format": 7, "product": "future"}')
    got = sorted((r.product, r.readable, r.route) for r in cat.fleet(spark, prefix).collect())
    assert got == [("broken", False, None), ("future", False, None)]
