import random
from datetime import date, datetime, timedelta

import pytest

from tessera.errors import ConfigError
from tessera.model import Product, Source, Transform
from tessera.plans.registry import _database
from tessera.plans.run import run
from tessera.sources import jdbc_plan


def counts(df, predicates):
    return [df.where(p).count() for p in predicates]


def planned(spark, df, column, partitions):
    texts = []
    df.createOrReplaceTempView("planned_t")

    def ask(text):
        texts.append(text)
        return spark.sql(text)

    return jdbc_plan.plan(ask, "planned_t", column, partitions), texts


def skewed(kind, n=4000):
    rng = random.Random(3)
    keys = [int(10 ** rng.uniform(0, 12)) for _ in range(n)] + [-(2**62), 2**62]  # far outliers: equal strides would hold nearly all in one
    if kind == "date":
        return [date(2000, 1, 1) + timedelta(days=int(k % 1e9) ** 2 % 5000 // (1 + k % 40)) for k in keys]
    if kind == "timestamp":
        return [datetime(2024, 1, 1) + timedelta(microseconds=k % 10**13 // (1 + k % 7)) for k in keys]
    return keys


@pytest.mark.parametrize("kind", ["bigint", "date", "timestamp_ntz"])
def test_partitions_are_even_and_hold_every_row_once(spark, kind):
    values = [(v,) for v in skewed(kind.split("_")[0])]
    df = spark.createDataFrame([(None,)] * 700 + values, f"k {kind}").cache()
    predicates, texts = planned(spark, df, "k", 16)
    got = counts(df, predicates)
    assert sum(got) == df.count() and got[0] == 700 and predicates[0] == "k IS NULL"
    assert max(got[1:]) <= 2 * len(values) / 16 and len(predicates) <= 2 * 16 + 2
    assert len(texts) < 10
    df.unpersist()


def test_a_value_that_no_range_can_cut_is_alone(spark):
    df = spark.createDataFrame([(7,)] * 900 + [(i,) for i in range(300)], "k int").cache()
    predicates, _ = planned(spark, df, "k", 10)
    got = counts(df, predicates)
    assert sum(got) == 1200 and sorted(got)[-1] <= 901 + 60 and sorted(got)[-2] <= 240
    df.unpersist()


def test_empty_single_and_wrong_columns(spark):
    empty = spark.createDataFrame([], "k int, s string")
    assert planned(spark, empty, "k", 4)[0] == ["k IS NULL", "k IS NOT NULL"]
    one = spark.createDataFrame([(5, "a"), (5, "b"), (None, "c")], "k int, s string")
    assert counts(one, planned(spark, one, "k", 4)[0]) == [1, 2]
    with pytest.raises(ConfigError, match="integers, dates or timestamps"):
        planned(spark, one, "s", 4)
    with pytest.raises(ConfigError, match="plain column"):
        planned(spark, one, "k; DROP", 4)
    with pytest.raises(ConfigError, match="lacks column"):
        Source(name="a", kind="jdbc", connection={"url": "x"}, table="t", partition={"partitions": 3})


def test_a_run_reads_a_skewed_table_by_counted_ranges_once(spark, root):
    df = spark.createDataFrame([(k, i) for i, k in enumerate([None] * 50 + skewed("bigint", 500))], "k bigint, v int")
    database, calls = _database({"orders_t": df}), []

    def load(s, fmt, options):
        calls.append(options)
        return database(s, fmt, options)

    product = Product(
        name="p", sources={"src": Source(name="src", kind="jdbc", connection={"url": "jdbc:db"}, table="orders_t", partition={"column": "k", "partitions": 6})},
        transforms=[Transform(name="t", sql="SELECT * FROM src"), Transform(name="u", sql="SELECT count(*) AS n FROM src")],
    )
    res = run(spark, product, root, load=load)
    reads = [c for c in calls if "predicates" in c]
    assert len(reads) == 1 and len(reads[0]["predicates"]) >= 6  # one staged copy serves both transforms
    assert res.tables["t"].rows == 552
