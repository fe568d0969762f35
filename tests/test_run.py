from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigError, StoreError, TesseraError, VerifyError
from tessera.model import ColumnSpec, Export, Incremental, Product, Source, Transform
from tessera.plans import flagship, snapshots
from tessera.plans.run import run
from tessera.plans.store import Store
from tessera.sources.staging import stage_parquet


def test_flagship_end_to_end(spark, sf, root):
    res = run(spark, flagship.orders_product(sf), root)
    store = Store(spark, root)
    assert res.version == 1 and store.latest() == 1
    v = res.verifications[0]
    assert v.ok and v.grain["rows"] == v.grain["distinct_grain"] > 0
    assert store.read_table("orders_daily").count() == v.grain["rows"]
    assert set(store.tables()) == {"stg_orders", "orders_daily"}


def _bad_grain_product(sf):
    return Product(
        name="bad", sources={"orders": Source(name="orders", uri=f"{sf}/orders.parquet")},
        transforms=[Transform(name="t", sql="SELECT o_custkey, o_orderstatus FROM orders")],
        exports=[Export(name="t", grain=["o_custkey"], schema={"o_custkey": ColumnSpec("bigint")})],
    )


def test_failed_verification_never_moves_latest(spark, sf, root):
    run(spark, flagship.orders_product(sf), root)
    with pytest.raises(VerifyError, match="not unique"):
        run(spark, _bad_grain_product(sf), root)
    assert Store(spark, root).latest() == 1


def test_select_only(spark, sf, root):
    src = {"orders": Source(name="orders", uri=f"{sf}/orders.parquet")}
    for sql, hint in [("SELECT * FROM orders;", "trailing"), ("DROP TABLE orders", "no DDL")]:
        p = Product(name="p", sources=src, transforms=[Transform(name="t", sql=sql)])
        with pytest.raises(ConfigError, match=hint):
            run(spark, p, root)


def test_transforms_see_earlier_outputs_and_lake_tables(spark, sf, root):
    src = {"orders": Source(name="orders", uri=f"{sf}/orders.parquet")}
    p = Product(name="p", sources=src, transforms=[
        Transform(name="a", sql="SELECT o_orderkey FROM orders"),
        Transform(name="b", sql="SELECT count(*) AS n FROM a"),
    ])
    run(spark, p, root)
    assert Store(spark, root).read_table("b").first().n == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_replay_check_catches_nondeterminism(spark, sf, root):
    src = {"orders": Source(name="orders", uri=f"{sf}/orders.parquet")}
    ok = Product(name="p", sources=src, transforms=[
        Transform(name="t", sql="SELECT o_orderkey, o_totalprice FROM orders", strategy="upsert", key=["o_orderkey"])])
    run(spark, ok, root, replay_check=True)
    bad = Product(name="p", sources=src, transforms=[
        Transform(name="t", sql="SELECT o_orderkey, rand() AS o_totalprice FROM orders", strategy="upsert",
                  key=["o_orderkey"])])
    with pytest.raises(TesseraError, match="not replay-safe"):
        run(spark, bad, root, replay_check=True)


def _events_product(uri, lookback=None):
    return Product(
        name="ev",
        sources={"events": Source(name="events", uri=uri, format="parquet",
                                  incremental=Incremental(cursor="ts", lookback=lookback))},
        transforms=[Transform(name="acc", sql="SELECT event_id, ts, value FROM events", strategy="upsert",
                              key=["event_id"])],
        exports=[Export(name="acc", schema={"event_id": ColumnSpec("bigint")})],
    )


def test_incremental_runs_watermark_and_redelivery(spark, sf, root):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    head = stage_parquet(ev.where("ts < '2024-01-20'"))
    r1 = run(spark, _events_product(head.path, "1d"), root)
    m1 = r1.watermarks[0]
    assert m1["source"] == "events" and m1["last_delta_rows"] == head.rows
    assert r1.summary["sources"][0]["mode"] == "bootstrap"
    r2 = run(spark, _events_product(f"{sf}/events.parquet", "1d"), root)
    tail = ev.where(F.col("ts") > F.lit(datetime.fromisoformat(m1["mark_ts"]) - timedelta(days=1))).count()
    assert r2.watermarks[0]["last_delta_rows"] == tail  # re-delivered rows are counted
    assert Store(spark, root).read_table("acc").count() == ev.count()
    r3 = run(spark, _events_product(f"{sf}/events.parquet"), root)  # nothing new: mark unchanged
    assert r3.watermarks[0]["mark_ts"] == r2.watermarks[0]["mark_ts"]
    assert Store(spark, root).manifest()["watermarks"] == r3.watermarks


def test_shrink_warning(spark, sf, root):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    src_uri = stage_parquet(ev).path
    p = Product(
        name="ev",
        sources={"events": Source(name="events", uri=src_uri, format="parquet", incremental=Incremental("ts"))},
        transforms=[Transform(name="acc", sql="SELECT event_id, ts FROM events", strategy="upsert", key=["event_id"]),
                    Transform(name="snap", sql="SELECT event_id FROM acc WHERE ts > (SELECT max(ts) - INTERVAL 1 DAY FROM acc)")],
    )
    run(spark, p, root)
    res = run(spark, p, root)
    assert not any("shrank" in w for w in res.warnings)


def test_rollback_numbering_and_pin_guard(spark, sf, root):
    p = flagship.orders_product(sf)
    for _ in range(3):
        run(spark, p, root)
    store = Store(spark, root)
    assert snapshots.rollback(spark, root) == (3, 2)
    assert run(spark, p, root).version == 4  # numbers past the maximum, not LATEST+1
    assert store.lineage(4) == [4, 2, 1]
    snapshots.release(spark, root, p)  # pins version 4
    with pytest.raises(StoreError, match="pinned to version 4"):
        snapshots.rollback(spark, root, 3)
    with pytest.raises(StoreError, match="does not exist"):
        snapshots.rollback(spark, root, 99)
    with pytest.raises(StoreError, match="already points"):
        snapshots.rollback(spark, root, 4)


def test_release_pins_supported_and_warns_on_meaning_drift(spark, sf, root):
    p = flagship.orders_product(sf)
    run(spark, p, root)
    doc, warns = snapshots.release(spark, root, p)
    assert doc["routes"] == {"orders_daily@2": 1} and not warns
    run(spark, p, root)
    p.exports[0].description = "Something else."
    doc, warns = snapshots.release(spark, root, p)
    assert doc["routes"]["orders_daily@2"] == 2 and any("description changed" in w for w in warns)
    exp = snapshots.read_export_table(spark, root, p.exports[0])
    assert exp.count() > 0


def test_expire_and_orphan_sweep(spark, sf, root):
    p = flagship.orders_product(sf)
    for _ in range(3):
        run(spark, p, root)
    with pytest.raises(VerifyError):
        run(spark, _bad_grain_product(sf), root)
    store = Store(spark, root)
    expired = snapshots.expire(spark, root, datetime.now() + timedelta(days=1))
    assert expired == [1, 2] and store.versions() == [3]
    n = snapshots.sweep_orphans(spark, root, datetime.now() + timedelta(days=1))
    assert n == 5  # one path per whole write directory: 2 tables x 2 expired versions + the failed run
    assert store.read_table("orders_daily").count() > 0  # LATEST untouched
    refs = {r.dir for r in store.referenced_dirs_df().collect()}
    files = {r.dir for r in store.data_files_df().collect()}
    assert files == refs


def test_compaction_bounds_directories_per_bucket(spark, sf, root):
    from tessera.operators import strategy
    store = Store(spark, root)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    state = None
    for lo in range(0, 1500, 100):
        staged = stage_parquet(orders.where(f"o_orderkey >= {lo} AND o_orderkey < {lo + 100}"))
        state = strategy.land_keyed(store, staged, "o", ["o_orderkey"], "append", state, buckets=8).state
    before = max(sum(1 for p in state.parts if p["bucket"] == b) for b in range(8))
    compacted, n = strategy.compact(store, state, max_dirs=4)
    after = max(sum(1 for p in compacted.parts if p["bucket"] == b) for b in range(8))
    assert before > 4 and n > 0 and after <= 4
    assert store.read_state(compacted).count() == orders.count() == compacted.rows


def test_verify_published_and_source_check(spark, sf, root):
    from tessera.plans import catalog as cat
    from tessera.plans.run import verify_published
    p = flagship.orders_product(sf)
    run(spark, p, root)
    out = verify_published(spark, p, root)
    assert all(v.ok for v in out) and cat.source_check_fresh(spark, root, p)
    p.exports[0].schema["revenue"] = ColumnSpec("double")
    assert not cat.source_check_fresh(spark, root, p)
    with pytest.raises(VerifyError, match="declared double"):
        verify_published(spark, p, root)


def test_failed_run_is_recorded_in_history(spark, sf, root):
    from tessera.plans import catalog as cat
    run(spark, flagship.orders_product(sf), root)
    with pytest.raises(VerifyError):
        run(spark, _bad_grain_product(sf), root)
    hist = cat.run_history(spark, root).select("execution", "outcome").distinct().collect()
    outcomes = sorted((r.execution is None, r.outcome.split(":")[0]) for r in hist)
    assert outcomes == [(False, "success"), (True, "failed")]


def test_grain_failure_hints_at_replay_safety_with_incremental_sources(spark, sf, root):
    ev = Source(name="events", uri=f"{sf}/events.parquet", incremental=Incremental("ts"))
    p = Product(
        name="ev", sources={"events": ev},
        transforms=[Transform(name="acc", sql="SELECT DISTINCT user_id, event_type FROM events", strategy="append",
                              key=["user_id", "event_type"]),
                    Transform(name="by_user", sql="SELECT user_id, event_type FROM acc")],
        exports=[Export(name="by_user", grain=["user_id"], schema={"user_id": ColumnSpec("bigint")})],
    )
    with pytest.raises(Exception, match="not replay-safe"):
        run(spark, p, root)


def test_commit_takes_the_next_free_version(spark, sf, root):
    from tessera.plans import fs
    run(spark, flagship.orders_product(sf), root)
    store = Store(spark, root)
    # another writer took version 2 between our read of LATEST and our commit
    fs.write_text(spark, store.path("versions", "2.json"), '{"version": 2, "parent": 1, "tables": []}', overwrite=False)
    v = store.commit(store.tables(1), [], product="orders", parent=1)
    assert v == 3 and store.latest() == 3 and store.manifest(3)["parent"] == 1
    with pytest.raises(Exception):
        fs.write_text(spark, store.path("versions", "3.json"), "{}", overwrite=False)  # exclusive create


def test_jdbc_delta_is_staged_once_and_cleaned_up(spark, sf, root, monkeypatch):
    """The JDBC branch stages its delta (a live database may change between reads); no database is started:
    the reader is replaced by a frame over the events table."""
    from tessera.plans import fs
    events = spark.read.parquet(f"{sf}/events.parquet")
    calls = []

    def fake_read_jdbc(spark_, conn, table=None, query=None, **kw):
        calls.append((conn["url"], table, query))
        return events

    monkeypatch.setattr("tessera.sources.jdbc.read_jdbc", fake_read_jdbc)
    src = Source(name="ev", kind="jdbc", connection={"url": "jdbc:test:events"}, table="app.events",
                 incremental=Incremental("ts"))
    p = Product(name="ev", sources={"ev": src},
                transforms=[Transform(name="acc", sql="SELECT event_id, ts FROM ev", strategy="upsert",
                                      key=["event_id"])])
    res = run(spark, p, root)
    info = res.summary["sources"][0]
    assert calls == [("jdbc:test:events", "app.events", None)]
    assert info["staged"] is True and info["rows"] == events.count() and info["mode"] == "bootstrap"
    assert Store(spark, root).read_table("acc").count() == events.count()
    assert "ev" not in [t.name for t in spark.catalog.listTables()]  # the run's views are gone
    stage_root = fs.join(spark.conf.get("spark.checkpoint.dir"), "tessera", "stage")
    leftovers = [n for n, is_dir, _, _ in fs.list_dir(spark, stage_root) if is_dir]
    res2 = run(spark, p, root)
    assert res2.summary["sources"][0]["rows"] == 0 and res2.watermarks == res.watermarks
    assert [n for n, is_dir, _, _ in fs.list_dir(spark, stage_root) if is_dir] == leftovers  # staged data removed


def test_bound_export_verified_against_live_source(spark, sf, root):
    """a bound export is checked against its live source, in a run and in a standalone verify."""
    from tessera.plans.run import verify_published
    src = {"lineitem": Source(name="lineitem", uri=f"{sf}/lineitem.parquet")}
    bad = Product(name="li", sources=src, transforms=[Transform(name="n", sql="SELECT count(*) AS n FROM lineitem")],
                  exports=[Export(name="lines", bind="lineitem", grain=["l_orderkey", "l_linenumber"],
                                  schema={"l_orderkey": ColumnSpec("bigint")})])
    with pytest.raises(VerifyError, match=r"lines@1: grain \['l_orderkey', 'l_linenumber'\] is not unique"):
        run(spark, bad, root)
    assert Store(spark, root).latest() is None
    with pytest.raises(VerifyError, match="not unique"):
        verify_published(spark, bad, root)


def test_duplicate_in_an_untouched_bucket_is_refused(spark, root, sf, tmp_path):
    """Verification counts the whole export: a stored duplicate is found even if the run lands elsewhere."""
    from tessera.plans.store import BUCKET_COL, TableState, bucket_of

    path = str(tmp_path / "in.parquet")
    spark.createDataFrame([(5, "n")], "id int, val string").write.parquet(path)
    store = Store(spark, root)
    stored = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, val string")
    parts, rows = store.write_bucketed(stored.withColumn(BUCKET_COL, bucket_of(["id"], 64)), "t", ["id"], 64)
    store.commit({"t": TableState("t", stored.schema, ["id"], 64, parts, rows, "append")})
    product = Product(
        name="p", sources={"src": Source(name="src", kind="raw", uri=path)},
        transforms=[Transform(name="t", sql="SELECT id, val FROM src", strategy="append", key=["id"], path="sql/t.sql")],
        exports=[Export(name="t", version="1.0.0", grain=["id"], schema={"id": ColumnSpec("int")})],
    )
    before = store.latest()
    with pytest.raises(VerifyError, match="4 rows but 3 distinct"):
        run(spark, product, root)
    assert store.latest() == before


def _versions_of(spark, root, n):
    store = Store(spark, root)
    df = spark.range(4)
    for k in range(n):
        parts, rows = store.write_plain(df.withColumn("v", F.lit(k)), "t")
        from tessera.plans.store import TableState

        store.commit({"t": TableState("t", df.withColumn("v", F.lit(k)).schema, parts=parts, rows=rows)})
    return store


def test_data_of_an_expired_version_stays_for_a_window(spark, root):
    """61 idle days, then one run: the version that was current an hour ago stays readable under open readers."""
    store = _versions_of(spark, root, 2)
    reader = store.read_table("t", 1)
    now = datetime.now() + timedelta(days=61)
    assert snapshots.sweep_orphans(spark, root, now - timedelta(days=30)) == 0
    assert snapshots.expire(spark, root, now - timedelta(days=30), now=now) == [1]
    assert snapshots.sweep_orphans(spark, root, now - timedelta(days=30)) == 0
    assert reader.count() == 4 and store.tombstoned() == [1] and store.versions() == [2]
    later = now + timedelta(days=31)
    assert snapshots.sweep_orphans(spark, root, later - timedelta(days=30)) == 1
    assert store.tombstoned() == [] and store.read_table("t").count() == 4


def test_rollback_over_expired_ancestors(spark, root):
    store = _versions_of(spark, root, 5)
    store.write_releases({"routes": {"t@1": 2}, "digests": {}, "versions": {}})
    now = datetime.now() + timedelta(days=61)
    assert snapshots.expire(spark, root, now, now=now) == [1, 3, 4]
    from tessera.plans.store import TableState

    df = store.read_table("t")
    store.commit({"t": TableState("t", df.schema, parts=store.tables()["t"].parts, rows=4)})
    assert store.versions() == [2, 5, 6]
    assert snapshots.rollback(spark, root, 5) == (6, 5)
    assert store.lineage(6) == [6, 5, 4, 3, 2, 1]


def test_a_half_written_manifest_is_ignored(spark, root):
    import os

    store = _versions_of(spark, root, 1)
    open(os.path.join(root, "versions", "2.json"), "w").close()
    assert store.versions() == [1] and store.latest() == 1
    parts, rows = store.write_plain(spark.range(2), "t")
    from tessera.plans.store import TableState

    assert store.commit({"t": TableState("t", spark.range(2).schema, parts=parts, rows=rows)}) == 3
    open(os.path.join(root, "LATEST"), "w").close()
    assert store.latest() is None


def test_small_files_are_created_once(spark, root):
    from tessera.plans import fs

    fs.write_text(spark, f"{root}/x.json", "one", overwrite=False)
    with pytest.raises(FileExistsError):
        fs.write_text(spark, f"{root}/x.json", "two", overwrite=False)
    assert fs.read_text(spark, f"{root}/x.json") == "one"
    fs.write_text(spark, f"{root}/x.json", "three")
    assert fs.read_text(spark, f"{root}/x.json") == "three"
    assert [n for n, *_ in fs.list_dir(spark, root)] == ["x.json"]


def test_a_run_leaves_the_callers_views_alone(spark, sf, root):
    spark.range(3).createOrReplaceTempView("orders")
    try:
        run(spark, flagship.orders_product(sf), root)
        assert spark.table("orders").count() == 3
    finally:
        spark.catalog.dropTempView("orders")


def test_warehouse_sources_are_dispatched_and_staged_once(spark, sf, root, monkeypatch):
    """Connection type picks the reader, partition options reach it, and a plain JDBC source is read once."""

    orders = spark.read.parquet(f"{sf}/orders.parquet")
    calls = []

    def jdbc_reader(spark_, conn, table=None, query=None, **kw):
        calls.append(("jdbc", table or query, kw))
        return orders

    def vendor_reader(spark_, fmt, options):
        calls.append((fmt, options["dbtable"], {}))
        return orders

    monkeypatch.setattr("tessera.sources.jdbc.read_jdbc", jdbc_reader)
    pg = {"type": "postgres", "url": "jdbc:postgresql://h/d"}
    product = Product(
        name="p",
        sources={
            "a": Source(name="a", kind="jdbc", connection=pg, table="s.orders", partition={"column": "o_orderkey", "lower": 0, "upper": 9, "partitions": 3}),
            "b": Source(name="b", kind="jdbc", connection={"type": "snowflake", "account": "x", "database": "d"}, table="s.orders"),
        },
        transforms=[Transform(name=n, sql=f"SELECT o_orderkey FROM {s}", path=f"sql/{n}.sql") for n, s in (("t1", "a"), ("t2", "a"), ("t3", "b"))],
    )
    res = run(spark, product, root, load=vendor_reader)
    assert sorted(c[0] for c in calls) == ["jdbc", "snowflake"]
    assert [{k: v for k, v in c[2].items() if k != "load"} for c in calls if c[0] == "jdbc"] == [{"partition_column": "o_orderkey", "lower": 0, "upper": 9, "num_partitions": 3}]
    assert {t.rows for t in res.tables.values()} == {orders.count()}
    assert all(s["staged"] and s["rows"] == orders.count() for s in res.summary["sources"])
    with pytest.raises(ConfigError, match="exactly two parts"):
        bad = Product(name="p", sources={"a": Source(name="a", kind="jdbc", connection=pg, table="orders")}, transforms=product.transforms[:1])
        run(spark, bad, root)
    with pytest.raises(ConfigError, match="lacks upper"):
        Source(name="a", kind="jdbc", connection=pg, table="s.o", partition={"column": "k", "lower": 1})


def test_names_that_differ_in_case_are_one(spark):
    inc = Source(name="ev", kind="raw", uri="x.parquet", incremental=Incremental(cursor="ts"))
    with pytest.raises(ConfigError, match="incremental source 'ev'"):
        Product(name="p", sources={"ev": inc}, transforms=[Transform(name="r", sql="SELECT * FROM EV")])
    with pytest.raises(ConfigError, match="both build"):
        Product(name="p", transforms=[Transform(name="t", sql="SELECT 1 AS a"), Transform(name="T", sql="SELECT 2 AS a")])
    with pytest.raises(ConfigError, match="name of a source"):
        Product(name="p", sources={"ev": inc}, transforms=[Transform(name="EV", sql="SELECT 1 AS a")])


def test_replay_of_a_full_refresh_notices_rows_a_rerun_loses(spark, root, tmp_path):
    path = str(tmp_path / "in.parquet")
    spark.range(400).write.parquet(path)
    product = Product(
        name="p", sources={"s": Source(name="s", kind="raw", uri=path)},
        transforms=[Transform(name="t", sql="SELECT id FROM s WHERE rand() < 0.5", strategy="upsert", key=["id"], path="sql/t.sql")],
    )
    with pytest.raises(TesseraError, match="replay"):
        run(spark, product, root, full_refresh=True, replay_check=True)
