import pytest
from pyspark.sql import functions as F

from tessera.operators import checks


def test_multiset_diff_counts_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (2,), (3,)], "x int")
    got = sorted(tuple(r) for r in checks.multiset_diff(a, b).collect())
    assert got == [(1, "removed", 1), (2, "added", 1), (3, "added", 1)]
    assert checks.multiset_diff(a, a).count() == 0


def test_equal_tables_shuffle_digests_only(spark):
    rows = spark.range(20_000).selectExpr("id", "cast(id % 7 AS string) AS g", "array(id, null) AS l")
    turned = rows.repartition(5).orderBy(F.rand(3))
    assert checks.differing_groups(rows, turned) == [] and checks.is_same_multiset(rows, turned)
    assert checks.group_digests(rows).count() <= checks.DIGEST_GROUPS
    # One row more: only its group is compared row by row.
    more = rows.unionAll(rows.limit(1))
    assert len(checks.differing_groups(rows, more)) == 1
    assert [(r.change, r.copies) for r in checks.multiset_diff(rows, more).collect()] == [("added", 1)]
    plan = checks.multiset_diff(rows, more)._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64" in plan and "Filter" in plan


@pytest.mark.parametrize("a, b", [
    ("SELECT CAST(NULL AS INT) AS x, 1 AS y", "SELECT 1 AS x, CAST(NULL AS INT) AS y"),
    ("SELECT array(1, NULL) AS x", "SELECT array(NULL, 1) AS x"),
    ("SELECT array('null') AS x", "SELECT array(CAST(NULL AS STRING)) AS x"),
    ("SELECT array(TIMESTAMP_NTZ '2024-01-01 00:00:00.000001') AS x", "SELECT array(TIMESTAMP_NTZ '2024-01-01 00:00:00.000002') AS x"),
])
def test_rows_that_hash_alike_are_told_apart(spark, a, b):
    assert not checks.is_same_multiset(spark.sql(a), spark.sql(b))


def test_zeros_of_either_sign_are_one_value(spark):
    assert checks.is_same_multiset(spark.sql("SELECT -0.0D AS x"), spark.sql("SELECT 0.0D AS x"))


def test_maps_are_comparable(spark):
    a = spark.sql("SELECT map('a', 1, 'b', 2) AS m")
    b = spark.sql("SELECT map('b', 2, 'a', 1) AS m")
    assert checks.is_same_multiset(a, b)


def test_shrunk_tables(spark):
    before = spark.createDataFrame([("a", 10), ("b", 5), ("gone", 3)], "table_name string, rows long")
    after = spark.createDataFrame([("a", 9), ("b", 6), ("new", 1)], "table_name string, rows long")
    assert [tuple(r) for r in checks.shrunk_tables(before, after).collect()] == [("a", 10, 9)]


def test_nested_maps_are_comparable(spark):
    a = spark.sql("SELECT named_struct('m', map('a', 1, 'b', 2)) AS s, array(map('x', map('p', 1, 'q', 2))) AS l")
    b = spark.sql("SELECT named_struct('m', map('b', 2, 'a', 1)) AS s, array(map('x', map('q', 2, 'p', 1))) AS l")
    c = spark.sql("SELECT named_struct('m', map('a', 1, 'b', 3)) AS s, array(map('x', map('p', 1, 'q', 2))) AS l")
    assert checks.is_same_multiset(a, b)
    assert not checks.is_same_multiset(a, c)
