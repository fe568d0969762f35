import random

import pytest

from tessera.errors import ConfigError
from tessera.plans import catalog as cat
from tessera.plans import flagship
from tessera.plans.run import run
from tessera.plans.store import Store
from tessera.session import scratch_path
from tessera.sources import classify, interface, jdbc, raw, staging
from tessera.streaming.land import land_stream


def test_raw_formats(spark, tmp_path):
    p = str(tmp_path / "x.csv")
    spark.createDataFrame([(1, "a")], "id int, v string").coalesce(1).write.option("header", True).csv(p)
    df = raw.read_raw(spark, p, "csv")
    assert df.first().id == 1
    with pytest.raises(ConfigError, match="cannot tell the format"):
        raw.format_for("/data/x.bin")
    assert raw.format_for("s3://b/x/*.parquet") == "parquet" and raw.format_for("a.jsonl") == "json"


def test_preflight(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("orders")
    assert staging.preflight(spark, "SELECT * FROM orders").bytes > 0
    with pytest.raises(Exception):
        staging.preflight(spark, "SELECT nope FROM orders")


def test_table_paths_and_predicates():
    assert jdbc.split_table_path("postgres", "sales.accounts") == ("sales", "accounts")
    for kind, t in [("postgres", '"a".b'), ("bigquery", "`a`.b"), ("snowflake", "a.b.c"), ("postgres", "a")]:
        with pytest.raises(ConfigError):
            jdbc.split_table_path(kind, t)
    from datetime import date, datetime
    assert jdbc.render_predicate("bigquery", "ts", "TIMESTAMP", datetime(2024, 1, 2, 3)) == \
        "`ts` > TIMESTAMP '2024-01-02 03:00:00+00'"
    assert jdbc.render_predicate("bigquery", "ts", "DATETIME", "2024-01-02 03:00:00.5+00") == \
        "`ts` > DATETIME '2024-01-02 03:00:00.5'"
    assert jdbc.render_predicate("snowflake", "updated_at", "TIMESTAMP_TZ", datetime(2024, 1, 2)) == \
        "\"UPDATED_AT\" > '2024-01-02 00:00:00'::TIMESTAMP_TZ"
    assert jdbc.render_predicate("snowflake", "d", "DATE", date(2024, 1, 2)) == "\"D\" > '2024-01-02'::DATE"
    assert jdbc.render_predicate("bigquery", "d", "DATE", date(2024, 1, 2)) == "`d` > DATE '2024-01-02'"
    assert jdbc.render_predicate("bigquery", "i", "INT64", 5) == "`i` > 5"
    with pytest.raises(ConfigError):
        jdbc.render_predicate("bigquery", "s", "STRING", "x")
    opts = jdbc.snowflake_options({"account": "acme", "database": "db", "user": "u"}, table="sales.accounts")
    assert opts["sfSchema"] == "SALES" and opts["dbtable"] == "ACCOUNTS"
    assert jdbc.bigquery_options({"project": "p"}, table="d.t")["table"] == "p.d.t"


def test_classify_objects(spark):
    meta = spark.createDataFrame([
        ("T", "a", "BASE TABLE", None), ("C", "a", "id", "INT64"), ("C", "a", "id", "INT64"),
        ("D", "a", "id", "the id"), ("D", "a", "x", "  "),
        ("T", "v", "VIEW", None), ("T", "m", "MODEL", None), ("C", "ghost", "c", "STRING"),
    ], "k string, n string, v1 string, v2 string")
    got = {r.object: r for r in classify.classify_objects(meta).collect()}
    assert got["a"].kind == "table" and got["a"].columns == {"id": "INT64"} and got["a"].descriptions == {"id": "the id"}
    assert got["v"].kind == "query" and got["m"].kind == "unsupported" and got["ghost"].kind == "missing"


def test_infer_interface(spark, sf):
    rows = {r.column: r.declared for r in interface.infer_interface(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()}
    assert rows == {"vec_id": "bigint", "embedding": "unmapped", "label": "integer"}
    nat = interface.infer_interface(spark.createDataFrame([(1,)], "a long"), {"a": "NUMERIC"}, "bigquery").first()
    assert nat.declared == "decimal" and nat.native == "NUMERIC"


def test_land_stream_is_idempotent_per_batch(spark, sf, root):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    src = scratch_path(spark, "stream_test")
    ev.repartition(3, "event_id").write.parquet(src)
    sdf = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = land_stream(sdf, root, "ev", ["event_id"], checkpoint=scratch_path(spark, "stream_test_ckpt"))
    q.awaitTermination()
    store = Store(spark, root)
    assert store.read_table("ev").count() == ev.count()
    m = store.manifest()
    assert m["stream_batches"]["ev"] >= 2
    # replaying an already committed batch id changes nothing
    from tessera.streaming.land import _lander
    before = store.latest()
    _lander(store, "ev", ["event_id"], "upsert", None, None)(ev.limit(5), m["stream_batches"]["ev"])
    assert store.latest() == before


def test_late_records_lose_in_any_arrival_order(spark, root):
    from tessera.operators.strategy import keep_latest
    from tessera.streaming.land import _lander

    rng = random.Random(9)
    records = [(k, rng.choice([None, 1, 2, 3, 4, 5]), f"v{rng.randint(0, 9)}") for k in range(12) for _ in range(8)]
    every = spark.createDataFrame(records, "k int, seq int, v string")
    want = sorted((tuple(r) for r in keep_latest(every, ["k"], ["seq"]).collect()), key=str)
    for turn in range(2):
        rng.shuffle(records)
        store = Store(spark, f"{root}{turn}")
        land = _lander(store, "t", ["k"], "upsert", ["seq"], 4)
        for batch in range(4):
            land(spark.createDataFrame(records[batch::4], "k int, seq int, v string"), batch)
        assert sorted((tuple(r) for r in store.read_table("t").collect()), key=str) == want
    store = Store(spark, f"{root}late")
    land = _lander(store, "t", ["k"], "upsert", ["seq"], None)
    land(spark.createDataFrame([(1, 10, "new")], "k int, seq int, v string"), 0)
    land(spark.createDataFrame([(1, 5, "late")], "k int, seq int, v string"), 1)
    assert [tuple(r) for r in store.read_table("t").collect()] == [(1, 10, "new")]


def test_catalog_status_history_fleet(spark, sf, tmp_path):
    prefix = str(tmp_path / "fleet")
    p = flagship.orders_product(sf)
    root = prefix + "/orders"
    assert cat.status(spark, root, p)["status"] == "draft"
    run(spark, p, root)
    st = cat.status(spark, root, p)
    assert st["status"] == "verified" and st["grain_verified"]
    cat.write_catalog(spark, root, p)
    rows = cat.catalog(spark, [p]).collect()
    assert [r.column for r in rows] == ["order_date", "region", "revenue"] and rows[0].route == "orders_daily@2"
    hist = cat.run_history(spark, root).collect()
    assert {r.table for r in hist} == {"stg_orders", "orders_daily"}
    fl = cat.fleet(spark, prefix).collect()
    assert [(r.product, r.route) for r in fl] == [("orders", "orders_daily@2")]
    assert len(cat.interface_digest(p)) == 64


def test_bigquery_routing_by_object_kind():
    from datetime import datetime
    conn = {"project": "prj"}
    t = jdbc.bigquery_read_options(conn, "sales.orders", "table", "ts", "TIMESTAMP", datetime(2024, 1, 2))
    assert t["table"] == "prj.sales.orders" and t["filter"] == "`ts` > TIMESTAMP '2024-01-02 00:00:00+00'"
    v = jdbc.bigquery_read_options(conn, "sales.orders_v", "query", "id", "INT64", 42)
    assert v["query"] == "SELECT * FROM `prj.sales.orders_v` WHERE `id` > 42" and v["viewsEnabled"] == "true"
    with pytest.raises(ConfigError):
        jdbc.bigquery_read_options(conn, "sales.m", "unsupported")


def test_yaml_raw_source_with_explicit_schema(spark, tmp_path):
    from tessera.model import load_product
    from tessera.plans.run import run
    from tessera.plans.store import Store
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.csv").write_text("id,amount\n1,2.5\n2,4.0\n")
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "totals.sql").write_text("SELECT count(*) AS n, CAST(sum(amount) AS DECIMAL(10,2)) AS total FROM raw")
    (tmp_path / "product.yaml").write_text(
        "product: csvdemo\n"
        "sources:\n  raw: {uri: data/*.csv, format: csv, schema: 'id BIGINT, amount DECIMAL(10,2)'}\n"
        "transforms:\n  - sql/totals.sql\n"
    )
    p = load_product(str(tmp_path / "product.yaml"))
    root = str(tmp_path / "store")
    run(spark, p, root)
    row = Store(spark, root).read_table("totals").first()
    assert row.n == 2 and str(row.total) == "6.50"


def test_stream_compacts_and_a_run_keeps_its_batch_ids(spark, root):
    """Twelve batches keep at most eight directories a bucket; a retried batch after another run is a no-op."""
    from tessera.model import Product, Source, Transform
    from tessera.operators.strategy import COMPACT_DIRS_PER_BUCKET
    from tessera.plans.run import run
    from tessera.streaming.land import _lander

    store = Store(spark, root)
    land = _lander(store, "t", ["id"], "append", None, 2)
    for b in range(12):
        land(spark.range(b * 10, b * 10 + 10), b)
    st = store.tables()["t"]
    for bucket in range(2):
        assert sum(p["bucket"] == bucket for p in st.parts) <= COMPACT_DIRS_PER_BUCKET
    assert store.read_table("t").count() == 120
    src = root + "-src.parquet"
    spark.range(3).withColumnRenamed("id", "n").write.parquet(src)
    product = Product(name="p", sources={"s": Source(name="s", kind="raw", uri=src)}, transforms=[Transform(name="o", sql="SELECT n FROM s", path="sql/o.sql")])
    run(spark, product, root)
    before = store.latest()
    land(spark.range(500, 510), 11)  # Spark retries the last batch
    assert store.latest() == before and store.read_table("t").count() == 120
    land(spark.range(500, 510), 12)
    assert store.read_table("t").count() == 130
