import __spark_entry__ as E
from tessera.plans.registry import QUERIES


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["order_date", "region", "revenue"] and df.count() > 0


def test_registry_consistent():
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)
    assert len(qs) >= 70
    assert set(QUERIES) <= set(qs)
