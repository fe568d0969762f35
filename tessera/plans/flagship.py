"""The flagship product: orders x customer x nation -> revenue per (day, nation), verified on that grain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.model import ColumnSpec, Export, Product, Source, Transform
from tessera.plans.run import RunResult, run
from tessera.plans.store import Store
from tessera.session import scratch_path

STG_ORDERS = """
SELECT o.o_orderkey                        AS order_id,
       CAST(o.o_orderdate AS DATE)         AS order_date,
       n.n_name                            AS region,
       CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n   ON c.c_nationkey = n.n_nationkey
{where}"""

ORDERS_DAILY = """
SELECT order_date,
       region,
       CAST(SUM(amount) AS DECIMAL(18,2)) AS revenue
FROM stg_orders
GROUP BY order_date, region
"""


def orders_product(sf_dir: str, where: str | None = None) -> Product:
    stg = STG_ORDERS.format(where=f"WHERE {where}\n" if where else "")
    return Product(
        name="orders",
        description="Daily order revenue per nation.",
        sources={
            t: Source(name=t, kind="raw", uri=f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation")
        },
        transforms=[
            Transform(name="stg_orders", sql=stg, path="sql/stg_orders.sql"),
            Transform(name="orders_daily", sql=ORDERS_DAILY, path="sql/orders_daily.sql"),
        ],
        exports=[
            Export(
                name="orders_daily",
                version="2.1.0",
                description="Order totals added up per day and nation.",
                grain=["order_date", "region"],
                schema={
                    "order_date": ColumnSpec("date"),
                    "region": ColumnSpec("string"),
                    "revenue": ColumnSpec("decimal", unit="USD"),
                },
                freshness="daily",
                contract="supported",
            )
        ],
    )


def build_orders(spark: SparkSession, sf_dir: str, root: str | None = None) -> tuple[Store, RunResult]:
    root = root or scratch_path(spark, "products", "orders")
    product = orders_product(sf_dir)
    result = run(spark, product, root)
    return Store(spark, root), result


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, result = build_orders(spark, sf_dir)
    return store.read_table("orders_daily", result.version)


def flagship_oracle(where: str | None = None) -> str:
    """The flagship result stated directly in SQL (DuckDB and Spark both run it)."""
    return f"""
SELECT CAST(o.o_orderdate AS DATE) AS order_date,
       n.n_name AS region,
       CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS revenue
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
{"WHERE " + where if where else ""}
GROUP BY CAST(o.o_orderdate AS DATE), n.n_name
"""


FLAGSHIP_ORACLE = flagship_oracle()
