import pytest
from pyspark.sql import functions as F

from tessera.errors import GuardError
from tessera.operators import checks, strategy
from tessera.plans.store import Store
from tessera.sources.staging import stage_parquet

SCHEMA = "id int, val string"


def land(spark, store, rows, strat, current, **kw):
    staged = stage_parquet(spark.createDataFrame(rows, SCHEMA) if isinstance(rows, list) else rows)
    return strategy.land_keyed(store, staged, "t", ["id"], strat, current, **kw)


def rows_of(store, state):
    return sorted((r.id, r.val) for r in store.read_state(state).collect())


def test_append_first_write_wins_and_redelivery_dropped(spark, root):
    store = Store(spark, root)
    a = land(spark, store, [(1, "a"), (2, "b")], "append", None)
    b = land(spark, store, [(2, "B"), (3, "c")], "append", a.state)
    assert rows_of(store, b.state) == [(1, "a"), (2, "b"), (3, "c")] and b.state.rows == 3
    assert b.rows_written == 1
    c = land(spark, store, [(2, "B"), (3, "c")], "append", b.state)  # same delta again: idempotent
    assert rows_of(store, c.state) == rows_of(store, b.state)


def test_upsert_replaces_matched_and_inserts_new(spark, root):
    store = Store(spark, root)
    a = land(spark, store, [(1, "a"), (2, "b")], "upsert", None)
    b = land(spark, store, [(2, "B"), (3, "c")], "upsert", a.state)
    assert rows_of(store, b.state) == [(1, "a"), (2, "B"), (3, "c")] and b.state.rows == 3
    c = land(spark, store, [(2, "B"), (3, "c")], "upsert", b.state)
    assert rows_of(store, c.state) == rows_of(store, b.state) and c.state.rows == 3


def test_upsert_rewrites_only_touched_buckets(spark, root, sf):
    store = Store(spark, root)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    staged = stage_parquet(orders)
    a = strategy.land_keyed(store, staged, "o", ["o_orderkey"], "upsert", None, buckets=16)
    assert len(a.state.parts) == 16
    one = stage_parquet(orders.where("o_orderkey = 7").withColumn("o_orderstatus", F.lit("Z")))
    b = strategy.land_keyed(store, one, "o", ["o_orderkey"], "upsert", a.state)
    assert b.buckets_touched == 1
    carried = {p["dir"] for p in a.state.parts} & {p["dir"] for p in b.state.parts}
    assert len(carried) == 15 and b.state.rows == a.state.rows
    got = store.read_state(b.state)
    assert got.where("o_orderkey = 7").first().o_orderstatus == "Z" and got.count() == orders.count()


def test_key_only_table_inserts_only(spark, root):
    store = Store(spark, root)
    df = spark.createDataFrame([(1,), (2,)], "id int")
    a = strategy.land_keyed(store, stage_parquet(df), "k", ["id"], "upsert", None)
    b = strategy.land_keyed(store, stage_parquet(spark.createDataFrame([(2,), (3,)], "id int")), "k", ["id"], "upsert", a.state)
    assert sorted(r.id for r in store.read_state(b.state).collect()) == [1, 2, 3]


def test_guards_in_order(spark, root):
    store = Store(spark, root)
    with pytest.raises(GuardError, match="key column 'id' is NULL in 1"):
        land(spark, store, [(None, "a"), (1, "a"), (1, "b")], "upsert", None)  # NULL guard before duplicates
    with pytest.raises(GuardError, match=r"1 key value\(s\) occur more than once \(e.g. 1 \(2x\)\)"):
        land(spark, store, [(1, "a"), (1, "b"), (2, "c")], "upsert", None)
    a = land(spark, store, [(1, "a")], "upsert", None)
    with pytest.raises(GuardError, match="drift.*'extra'"):
        land(spark, store, spark.createDataFrame([(2, "b", 1)], "id int, val string, extra int"), "upsert", a.state)
    with pytest.raises(GuardError, match="changed type from string"):
        land(spark, store, spark.createDataFrame([(2, 5)], "id int, val int"), "upsert", a.state)
    with pytest.raises(GuardError, match="no longer returns"):
        land(spark, store, spark.createDataFrame([(2,)], "id int"), "upsert", a.state)
    # names compare case-insensitively, positions ignored
    ok = land(spark, store, spark.createDataFrame([("b", 2)], "VAL string, ID int"), "upsert", a.state)
    assert rows_of(store, ok.state) == [(1, "a"), (2, "b")]


def test_dup_sample_top5_with_total(spark):
    df = spark.createDataFrame([(k,) for k in [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7]], "id int")
    with pytest.raises(GuardError) as e:
        strategy.check_duplicate_keys(df, ["id"], "t")
    msg = str(e.value)
    assert "6 key value(s)" in msg and "1 (3x), 2 (2x), 3 (2x), 4 (2x), 5 (2x)" in msg


def test_full_refresh_reconciles_deletes_and_allows_drift(spark, root):
    store = Store(spark, root)
    a = land(spark, store, [(1, "a"), (2, "b")], "upsert", None)
    df = spark.createDataFrame([(2, "b", 1)], "id int, val string, extra int")
    b = strategy.land_keyed(store, stage_parquet(df), "t", ["id"], "upsert", a.state, full_refresh=True)
    assert [tuple(r) for r in store.read_state(b.state).collect()] == [(2, "b", 1)]
    with pytest.raises(GuardError):
        strategy.land_keyed(store, stage_parquet(spark.createDataFrame([(1, "x"), (1, "y")], SCHEMA)), "t", ["id"],
                            "upsert", a.state, full_refresh=True)


def test_upsert_fold_equals_keep_latest_of_union(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "value")
    d1 = ev.where("ts < '2024-01-20'").withColumn("batch", F.lit(1))
    d2 = ev.where("ts >= '2024-01-10'").withColumn("value", F.col("value") + 1).withColumn("batch", F.lit(2))
    folded = strategy.upsert_by_key(d1, d2, ["event_id"])
    latest = strategy.keep_latest(d1.unionByName(d2), ["event_id"], ["batch"])
    assert checks.is_same_multiset(folded, latest)


def test_keep_latest_ties_are_deterministic(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 3, "z"), (2, None, "q")], "k int, o int, v string")
    got = sorted(tuple(r) for r in strategy.keep_latest(df, ["k"], ["o"]).collect())
    assert got == [(1, 5, "b"), (2, None, "q")]


def test_schema_drift_pure():
    from pyspark.sql import types as T
    a = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.StringType())])
    assert strategy.schema_drift(a, a) is None
    b = T.StructType([T.StructField("ID", T.IntegerType(), False), T.StructField("v", T.StringType())])
    assert strategy.schema_drift(b, a) is None  # case and nullability ignored


@pytest.mark.parametrize("strat", ["append", "upsert"])
def test_large_delta_path_matches_definition(spark, root, sf, monkeypatch, strat):
    """Above the broadcast bound both sides are partitioned by bucket; the result must not change."""
    monkeypatch.setattr(strategy, "BROADCAST_DELTA_BYTES", 0)
    store = Store(spark, root)
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderdate")
    first = orders.where("o_orderdate < '1999-01-01'")
    second = orders.where("o_orderdate >= '1998-07-01'").withColumn("o_orderstatus", F.lit("Z"))
    a = strategy.land_keyed(store, stage_parquet(first), "o", ["o_orderkey"], strat, None, buckets=8)
    b = strategy.land_keyed(store, stage_parquet(second), "o", ["o_orderkey"], strat, a.state)
    merge = strategy.upsert_by_key if strat == "upsert" else strategy.append_by_key
    assert checks.is_same_multiset(store.read_state(b.state), merge(first, second, ["o_orderkey"]))
    assert b.state.rows == orders.count()
    per_bucket = [sum(1 for p in b.state.parts if p["bucket"] == x) for x in range(8)]
    assert max(per_bucket) <= (2 if strat == "append" else 1)


@pytest.mark.parametrize("large", [False, True])
def test_upsert_rewrites_only_buckets_with_updated_keys(spark, root, sf, monkeypatch, large):
    if large:
        monkeypatch.setattr(strategy, "BROADCAST_DELTA_BYTES", 0)
    store = Store(spark, root)
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")
    old = orders.where("o_orderkey < 1000")
    a = strategy.land_keyed(store, stage_parquet(old), "o", ["o_orderkey"], "upsert", None, buckets=16)
    inserts = orders.where("o_orderkey >= 1000")  # new keys spread over every bucket
    b = strategy.land_keyed(store, stage_parquet(inserts), "o", ["o_orderkey"], "upsert", a.state)
    assert b.buckets_touched == 0 and b.rows_rewritten == 0 and b.state.rows == orders.count()
    assert {p["dir"] for p in a.state.parts} <= {p["dir"] for p in b.state.parts}  # nothing rewritten
    one = orders.where("o_orderkey = 7").withColumn("o_orderstatus", F.lit("Z"))
    mixed = one.unionByName(spark.createDataFrame([(10**9, "N")], "o_orderkey long, o_orderstatus string"))
    c = strategy.land_keyed(store, stage_parquet(mixed), "o", ["o_orderkey"], "upsert", b.state)
    assert c.buckets_touched == 1 and c.state.rows == orders.count() + 1
    expected = strategy.upsert_by_key(strategy.upsert_by_key(old, inserts, ["o_orderkey"]), mixed, ["o_orderkey"])
    assert checks.is_same_multiset(store.read_state(c.state), expected)
    assert c.state.touched == [c.state.touched[0]] and len(c.state.touched) == 1


@pytest.mark.parametrize("large", [False, True])
def test_updates_to_recent_keys_rewrite_only_recent_directories(spark, root, sf, monkeypatch, large):
    if large:
        monkeypatch.setattr(strategy, "BROADCAST_DELTA_BYTES", 0)
    store = Store(spark, root)
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")
    base = orders.where("o_orderkey < 1200")
    recent = orders.where("o_orderkey >= 1200")
    a = strategy.land_keyed(store, stage_parquet(base), "o", ["o_orderkey"], "upsert", None, buckets=4)
    b = strategy.land_keyed(store, stage_parquet(recent), "o", ["o_orderkey"], "upsert", a.state)
    upd = recent.where("o_orderkey < 1260").withColumn("o_orderstatus", F.lit("U"))
    c = strategy.land_keyed(store, stage_parquet(upd), "o", ["o_orderkey"], "upsert", b.state)
    old_dirs = {p["dir"] for p in a.state.parts}
    assert old_dirs <= {p["dir"] for p in c.state.parts}  # the older directories were not rewritten
    assert c.rows_rewritten == recent.count() - upd.count()
    expected = strategy.upsert_by_key(strategy.upsert_by_key(base, recent, ["o_orderkey"]), upd, ["o_orderkey"])
    assert checks.is_same_multiset(store.read_state(c.state), expected) and c.state.rows == orders.count()


def test_upsert_into_buckets_without_files(spark, root):
    store = Store(spark, root)
    a = land(spark, store, [(1, "a")], "upsert", None, buckets=64)
    b = land(spark, store, [(2, "b"), (3, "c")], "upsert", a.state)
    assert rows_of(store, b.state) == [(1, "a"), (2, "b"), (3, "c")]


@pytest.mark.parametrize("strat", ["append", "upsert"])
def test_table_built_without_key_is_laid_out_before_landing(spark, root, strat):
    store = Store(spark, root)
    plain = strategy.land_replace(store, spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), "t")
    b = land(spark, store, [(2, "B"), (3, "c")], strat, plain.state)
    assert rows_of(store, b.state) == [(1, "a"), (2, "B" if strat == "upsert" else "b"), (3, "c")] and b.state.rows == 3
    dup = strategy.land_replace(store, spark.createDataFrame([(1, "a"), (1, "b")], SCHEMA), "t")
    with pytest.raises(GuardError, match="already stored"):
        land(spark, store, [(2, "B")], strat, dup.state)


def test_changed_key_is_laid_out_anew(spark, root):
    store = Store(spark, root)
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, val string, more string")
    a = strategy.land_keyed(store, stage_parquet(df), "t", ["id", "val"], "upsert", None)
    d = spark.createDataFrame([(1, "z", "w")], "id int, val string, more string")
    b = strategy.land_keyed(store, stage_parquet(d), "t", ["ID"], "upsert", a.state)
    assert sorted(tuple(r) for r in store.read_state(b.state).collect()) == [(1, "z", "w"), (2, "b", "y")]
    assert b.state.rows == 2 and b.rows_rewritten >= 2


def test_outgrown_buckets_are_chosen_again(spark, root, sf, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(strategy, "BUCKET_TARGET_BYTES", 500)
    monkeypatch.setattr(strategy, "buckets_for_bytes", lambda n: 8 if n < 9000 else 64)
    store = Store(spark, root)
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderdate")
    a = strategy.land_keyed(store, stage_parquet(orders.where("o_orderkey < 20")), "o", ["o_orderkey"], "upsert", None)
    assert a.state.buckets == 8
    d = orders.where("o_orderkey >= 10").withColumn("o_orderstatus", F.lit("Z"))
    b = strategy.land_keyed(store, stage_parquet(d), "o", ["o_orderkey"], "upsert", a.state)
    assert b.state.buckets == 64 and b.state.rows == orders.count()
    want = strategy.upsert_by_key(orders.where("o_orderkey < 20"), d, ["o_orderkey"])
    assert checks.is_same_multiset(store.read_state(b.state), want)


def test_large_delta_is_not_held_to_the_bucket_count(spark, root, monkeypatch):
    """Joins and writes of a large delta into an 8-bucket table run in more tasks than buckets."""
    monkeypatch.setattr(strategy, "BROADCAST_DELTA_BYTES", 0)
    store = Store(spark, root)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        first = spark.range(0, 4000).selectExpr("cast(id as int) id", "cast(id as string) val")
        second = spark.range(2000, 9000).selectExpr("cast(id as int) id", "'new' val")
        a = strategy.land_keyed(store, stage_parquet(first), "t", ["id"], "upsert", None, buckets=8)
        b = strategy.land_keyed(store, stage_parquet(second), "t", ["id"], "upsert", a.state)
        files = store.data_files_df().where("path like '%/__bucket=%'")
        new_dirs = [p["dir"] for p in b.state.parts if p["dir"] not in {q["dir"] for q in a.state.parts}]
        assert files.where(F.col("dir").isin(new_dirs)).count() > 8
        assert b.state.rows == 9000 and store.read_state(b.state).where("val = 'new'").count() == 7000
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_a_named_bucket_count_lays_a_stored_table_out_anew(spark, root):
    from tessera.plans.store import Store
    from tessera.sources.staging import stage_parquet

    store = Store(spark, root)
    rows = spark.range(200).selectExpr("id", "id AS v")
    first = strategy.land_keyed(store, stage_parquet(rows), "t", ["id"], "upsert", None, buckets=8).state
    more = stage_parquet(spark.range(150, 220).selectExpr("id", "-id AS v"))
    kept = strategy.land_keyed(store, more, "t", ["id"], "upsert", first).state
    assert kept.buckets == 8
    wide = strategy.land_keyed(store, more, "t", ["id"], "upsert", first, buckets=64).state
    assert wide.buckets == 64 and len({p["bucket"] for p in wide.parts}) > 8
    for state in (kept, wide):
        got = sorted(tuple(r) for r in store.read_state(state).collect())
        assert got == sorted([(i, i) for i in range(150)] + [(i, -i) for i in range(150, 220)]) and state.rows == 220
