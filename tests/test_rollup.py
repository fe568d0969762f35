import random

import pytest

from tessera.errors import ConfigError
from tessera.model import Export, Product, Rollup, Source, Transform, load_product
from tessera.operators import rollup as rollups
from tessera.operators.strategy import land_keyed
from tessera.plans.run import run
from tessera.plans.store import Store
from tessera.sources.staging import stage_parquet

SCHEMA = "id int, grp string, day date, qty decimal(10,2), hits int, w double"
KEPT = {"n": ("count", "*"), "priced": ("count", "qty"), "total": ("sum", "qty"), "seen": ("count", "hits"), "hits": ("sum", "hits")}


def product(path, measures, by=("grp",), strategy="upsert", buckets=None, **kw):
    return Product(
        name="p", sources={"src": Source(name="src", uri=path, format="parquet")},
        transforms=[Transform(name="acc", sql="SELECT * FROM src", strategy=strategy, key=["id"]),
                    Transform(name="roll", rollup=Rollup("acc", by if isinstance(by, dict) else list(by), measures), buckets=buckets, **kw)],
        exports=[Export(name="roll", grain=list(by))],
    )


def file_of(spark, tmp_path, rows):
    path = str(tmp_path / f"in-{random.getrandbits(64):x}")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return path


def row(rng, i):
    return (i, rng.choice(["a", "b", "c", "d", None]), None, rng.choice([None, rng.randint(-500, 500)]), rng.choice([None, -3, 0, 7]),
            rng.random())


def typed(rows):
    from datetime import date
    from decimal import Decimal

    return [(i, g, date(2024, 1, 1 + i % 3), None if q is None else Decimal(q) / 4, h, w) for i, g, _, q, h, w in rows]


def result(spark, root, res, by, measures):
    """The stored rollup and the same SELECT over the stored table, as sorted rows."""
    store = Store(spark, root)
    got = store.read_state(res.tables["roll"])
    store.read_state(res.tables["acc"]).createOrReplaceTempView("acc_seen")
    want = spark.sql(Rollup("acc_seen", by, measures).sql)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert got.count() == res.tables["roll"].rows
    return sorted(map(repr, got.collect())), sorted(map(repr, want.collect()))


@pytest.mark.parametrize("strategy", ["upsert", "append"])
def test_equals_the_full_rollup_after_every_run(spark, root, tmp_path, strategy):
    rng = random.Random(5)
    by = {"g": "grp", "day": "day"}
    for step in range(4):
        ids = rng.sample(range(30), 12) if step else range(20)
        res = run(spark, product(file_of(spark, tmp_path, typed(row(rng, i) for i in ids)), KEPT, by, strategy), root, replay_check=True)
        got, want = result(spark, root, res, by, KEPT)
        assert got == want
        assert res.summary["transforms"][1]["rows_written"] <= 15


def test_moved_rows_leave_and_empty_groups_go(spark, root, tmp_path):
    first = typed([(1, "a", None, 8, 1, 0.0), (2, "a", None, None, None, 0.0), (3, "b", None, 4, None, 0.0), (4, None, None, 4, 2, 0.0)])
    run(spark, product(file_of(spark, tmp_path, first), KEPT), root)
    second = typed([(1, "c", None, 8, 1, 0.0), (3, "c", None, 4, None, 0.0), (4, None, None, 4, 2, 0.0)])
    res = run(spark, product(file_of(spark, tmp_path, second), KEPT), root)
    got = {r.grp: (r.n, r.priced, r.total, r.hits) for r in Store(spark, root).read_state(res.tables["roll"]).collect()}
    assert set(got) == {"a", "c", None}  # b is empty and gone
    assert got["a"] == (1, 0, None, None)  # the sum of nothing is NULL, not 0
    assert got["c"][:2] == (2, 2) and float(got["c"][2]) == 3.0 and got["c"][3] == 1
    assert res.summary["transforms"][1]["rows_written"] == 3  # a, b and c changed; the redelivered NULL group did not


def test_groups_without_changes_are_not_read(spark, root, tmp_path, monkeypatch):
    rows = typed((i, f"g{i % 40}", None, i, i, 0.0) for i in range(400))
    run(spark, product(file_of(spark, tmp_path, rows), KEPT, buckets=32), root)
    before = Store(spark, root).tables()
    reads = []
    read_state = Store.read_state
    monkeypatch.setattr(Store, "read_state", lambda self, st, buckets=None: reads.append((st.name, buckets)) or read_state(self, st, buckets))
    seen = []
    changed = rollups.group_changes
    monkeypatch.setattr(rollups, "group_changes", lambda ch, r, s: seen.append(ch) or changed(ch, r, s))
    res = run(spark, product(file_of(spark, tmp_path, typed([(5, "g5", None, 9, 9, 0.0)])), KEPT, buckets=32), root)
    roll = [b for name, b in reads if name == "roll" and b is not None]
    assert len(roll) == 1 and len(roll[0]) == 1  # one bucket of the rollup
    part = {p["dir"] for p in before["acc"].parts} - {p["dir"] for p in res.tables["acc"].parts}
    files = seen[0].old.inputFiles()
    old = [f for f in files if "/data/acc/" in f]
    assert len(part) == 1 and old and all(next(iter(part)) in f for f in old)  # the rewritten directory, not the table
    carried = {p["dir"] for p in before["roll"].parts} & {p["dir"] for p in res.tables["roll"].parts}
    assert len(carried) == len(before["roll"].parts) - 1
    again = run(spark, product(file_of(spark, tmp_path, typed([(5, "g5", None, 9, 9, 0.0)])), KEPT, buckets=32), root)
    assert again.tables["roll"].parts == res.tables["roll"].parts  # a redelivery changes nothing
    got, want = result(spark, root, again, {"grp": "grp"}, KEPT)
    assert got == want


@pytest.mark.parametrize("measures", [
    {"n": ("count", "*"), "top": ("max", "hits")},
    {"n": ("count", "*"), "c": ("count", "w"), "s": ("sum", "w")},  # floating point: the order of additions shows
    {"n": ("count", "*"), "s": ("sum", "hits")},  # nothing tells NULL from zero
    {"c": ("count", "hits")},  # no row count
    {"n": ("count", "*"), "c": ("count", "DISTINCT hits")},
    {"n": ("count", "*"), "c": ("count", "hits, qty")},
    {"n": ("count", "*"), "c": ("count", "CASE WHEN day < current_date() THEN 1 END")},
])
def test_other_declarations_are_computed_in_full(spark, root, tmp_path, monkeypatch, measures):
    monkeypatch.setattr(rollups, "group_changes", lambda *a: pytest.fail("kept from changes"))
    rows = typed((i, f"g{i % 3}", None, i, i, 0.5) for i in range(9))
    run(spark, product(file_of(spark, tmp_path, rows), measures), root)
    res = run(spark, product(file_of(spark, tmp_path, typed([(8, "g0", None, 1, 1, 0.5)])), measures), root)
    got, want = result(spark, root, res, {"grp": "grp"}, measures)
    assert got == want


def test_a_table_changed_outside_the_run_or_a_new_text_is_computed_in_full(spark, root, tmp_path):
    run(spark, product(file_of(spark, tmp_path, typed([(1, "a", None, 4, 1, 0.0)])), KEPT), root)
    store = Store(spark, root)
    tables = store.tables()
    extra = stage_parquet(spark.createDataFrame(typed([(2, "z", None, 4, 1, 0.0)]), SCHEMA))
    tables["acc"] = land_keyed(store, extra, "acc", ["id"], "upsert", tables["acc"]).state
    store.commit(tables)  # as a stream lands: the rollup knows nothing of it
    res = run(spark, product(file_of(spark, tmp_path, typed([(3, "a", None, 4, 1, 0.0)])), KEPT), root)
    got, want = result(spark, root, res, {"grp": "grp"}, KEPT)
    assert got == want and len(got) == 2
    other = {**KEPT, "total": ("sum", "qty * 2"), "priced": ("count", "qty * 2")}
    res = run(spark, product(file_of(spark, tmp_path, typed([(4, "b", None, 4, 1, 0.0)])), other), root)
    got, want = result(spark, root, res, {"grp": "grp"}, other)
    assert got == want
    res = run(spark, product(file_of(spark, tmp_path, typed([(4, "b", None, 4, 1, 0.0)])), other), root, full_refresh=True)
    got, want = result(spark, root, res, {"grp": "grp"}, other)
    assert got == want and len(got) == 1
    empty = run(spark, product(file_of(spark, tmp_path, []), other), root)
    assert empty.tables["roll"].parts == res.tables["roll"].parts


def test_declarations_are_checked(tmp_path):
    with pytest.raises(ConfigError, match="appends or upserts"):
        Product(name="p", sources={"s": Source(name="s", uri="x")}, transforms=[
            Transform(name="acc", sql="SELECT 1 AS id"), Transform(name="roll", rollup=Rollup("acc", ["id"], KEPT))])
    with pytest.raises(ConfigError, match="neither"):
        Transform(name="roll", sql="SELECT 1", rollup=Rollup("acc", ["id"], KEPT))
    with pytest.raises(ConfigError, match="twice"):
        Rollup("acc", ["N"], {"n": ("count", "*")})
    (tmp_path / "acc.sql").write_text("SELECT * FROM src")
    doc = tmp_path / "product.yaml"
    doc.write_text("""
product: p
sources: {src: in.parquet}
transforms:
  - {sql: acc.sql, materialize: upsert, key: [id]}
  - {name: roll, rollup: {of: ACC, by: {day: "date_trunc('DAY', ts)"}, measures: {n: {count: "*"}}}}
interface: [{name: roll, grain: [day]}]
""")
    p = load_product(str(doc))
    assert p.transforms[1].rollup.of == "acc" and p.transforms[1].strategy == "replace"
    doc.write_text(doc.read_text().replace("measures: {n: {count: \"*\"}}", "measures: {n: count}"))
    with pytest.raises(ConfigError, match="one aggregate"):
        load_product(str(doc))
