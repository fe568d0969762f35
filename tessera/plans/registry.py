"""Registered queries: one Spark callable per operator, plus the equivalent DuckDB SQL.

Every callable takes ``(spark, sf_dir)``, reads the given tables (or data Spark
derives from them) in full, and returns a DataFrame. Stateful operators become
pure queries by splitting a table at a cutoff: run 1 lands the rows up to the
cutoff, run 2 lands a later slice with an overlap whose values changed, and
the oracle states the merged result directly.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import GuardError
from tessera.model import ColumnSpec, Export, Incremental, Product, Rollup, Source, Transform
from tessera.operators import checks, delta, profile, reader, strategy, verify
from tessera.plans import catalog as cat
from tessera.plans import flagship, snapshots
from tessera.plans.run import evaluate, isolated, read_source, run
from tessera.plans.store import Store
from tessera.session import scratch_path
from tessera.sources import classify, interface, product as product_src, raw, staging
from tessera.streaming.land import land_stream

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle.strip()
        return fn

    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def views(spark: SparkSession, sf: str, *names: str) -> None:
    for n in names or TABLES:
        table(spark, sf, n).createOrReplaceTempView(n)


def root_for(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, "products", name)


def raw_sources(sf: str, *names: str) -> dict[str, Source]:
    return {n: Source(name=n, kind="raw", uri=f"{sf}/{n}.parquet") for n in names}


def derived_copy(df: DataFrame, name: str) -> str:
    """Write a Spark-derived slice of a given table to the shared scratch area (a source that grows later)."""
    path = scratch_path(df.sparkSession, "slices", name)
    df.write.parquet(path)
    return path


# Fixed values used by the split scenarios below.
TS_MARK = "2024-01-15 12:00:00"
TS_SPLIT = "2024-01-20 00:00:00"
ORDERS_SPLIT = "1999-01-01"
ORDERS_OVERLAP = "1998-07-01"
ORDERS_REFRESH = "2000-01-01"
ORDERS_V1 = "1998-01-01"

# =====================================================================  2.A sources


@register("source_raw", "SELECT * FROM orders")
def q_source_raw(spark, sf):
    return raw.bind_raw(spark, "raw_orders", f"{sf}/orders.parquet")


@register("source_product", flagship.FLAGSHIP_ORACLE)
def q_source_product(spark, sf):
    store, res = flagship.build_orders(spark, sf)
    df, _ = product_src.bind_product(spark, "up_orders_daily", store.root, "orders_daily")
    return df


def _versioned_orders(spark, sf) -> Store:
    """An upstream store with version 1 (orders before ORDERS_V1) and version 2 (all orders)."""
    root = root_for(spark, "orders_v")
    run(spark, flagship.orders_product(sf, where=f"o.o_orderdate < TIMESTAMP '{ORDERS_V1} 00:00:00'"), root)
    run(spark, flagship.orders_product(sf), root)
    return Store(spark, root)


@register("source_product_pinned", flagship.flagship_oracle(f"o.o_orderdate < TIMESTAMP '{ORDERS_V1} 00:00:00'"))
def q_source_product_pinned(spark, sf):
    store = _versioned_orders(spark, sf)
    df, _ = product_src.bind_product(spark, "pinned_daily", store.root, "orders_daily", version=1)
    return df


@register("upstream_as_of")
def q_upstream_as_of(spark, sf):
    store = _versioned_orders(spark, sf)
    rows = []
    for v in (1, None):
        as_of = product_src.data_as_of(spark, store.root, v)
        rows.append((v if v is not None else store.latest(), as_of is not None,
                     store.tables(v)["orders_daily"].rows))
    return spark.createDataFrame(rows, "version long, has_data_as_of boolean, rows long")


META_SQL = """
SELECT 'T' AS k, concat('obj_', CAST(p_partkey AS STRING)) AS n,
       CASE p_size % 7 WHEN 0 THEN 'BASE TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'CLONE' WHEN 3 THEN 'SNAPSHOT'
                       WHEN 4 THEN 'MATERIALIZED VIEW' WHEN 5 THEN 'EXTERNAL' ELSE 'MODEL' END AS v1,
       CAST(NULL AS STRING) AS v2
FROM part
UNION ALL
SELECT 'C', concat('obj_', CAST(l_partkey AS STRING)), concat('col_', CAST(l_linenumber AS STRING)),
       CASE l_returnflag WHEN 'A' THEN 'STRING' WHEN 'N' THEN 'INT64' ELSE 'NUMERIC' END
FROM lineitem
UNION ALL
SELECT 'D', concat('obj_', CAST(l_partkey AS STRING)), concat('col_', CAST(l_linenumber AS STRING)),
       CASE WHEN l_linestatus = 'O' THEN concat('open line of order ', CAST(l_orderkey AS STRING)) ELSE '  ' END
FROM lineitem
UNION ALL
SELECT 'C', concat('sup_', CAST(s_suppkey AS STRING)), 'col_1', 'STRING' FROM supplier
"""


@register(
    "classify_objects",
    f"""
WITH meta AS ({META_SQL}),
obj AS (SELECT DISTINCT n FROM meta),
t AS (SELECT n, max(v1) AS object_type FROM meta WHERE k = 'T' GROUP BY n),
c AS (SELECT n, count(DISTINCT v1) AS n_columns FROM meta WHERE k = 'C' GROUP BY n),
d AS (SELECT n, count(DISTINCT v1) AS n_described FROM meta
      WHERE k = 'D' AND trim(coalesce(v2, '')) <> '' GROUP BY n)
SELECT obj.n AS object, t.object_type,
       CASE WHEN upper(t.object_type) IN ('BASE TABLE', 'CLONE', 'SNAPSHOT') THEN 'table'
            WHEN upper(t.object_type) IN ('VIEW', 'MATERIALIZED VIEW', 'EXTERNAL') THEN 'query'
            WHEN t.object_type IS NULL THEN 'missing' ELSE 'unsupported' END AS kind,
       CAST(coalesce(c.n_columns, 0) AS BIGINT) AS n_columns,
       CAST(coalesce(d.n_described, 0) AS BIGINT) AS n_described
FROM obj LEFT JOIN t ON obj.n = t.n LEFT JOIN c ON obj.n = c.n LEFT JOIN d ON obj.n = d.n
""",
)
def q_classify_objects(spark, sf):
    views(spark, sf, "part", "lineitem", "supplier")
    out = classify.classify_objects(spark.sql(META_SQL))
    return out.select("object", "object_type", "kind", "n_columns", "n_described")


@register("preflight")
def q_preflight(spark, sf):
    views(spark, sf, "orders", "customer", "nation")
    p = staging.preflight(spark, flagship.FLAGSHIP_ORACLE)
    return spark.createDataFrame([("orders_daily", p.ok, p.bytes is not None and p.bytes > 0)],
                                 "query string, ok boolean, has_estimate boolean")


@register("stage_parquet", "SELECT * FROM lineitem")
def q_stage_parquet(spark, sf):
    return staging.stage_parquet(table(spark, sf, "lineitem")).df


LINEITEM_TYPES = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]


def _values(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, int):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


@register(
    "staged_info",
    f"""
SELECT t.column_name AS "column", t.type, (SELECT count(*) FROM lineitem) AS "rows"
FROM (VALUES {_values(LINEITEM_TYPES)}) AS t(column_name, type)
""",
)
def q_staged_info(spark, sf):
    return staging.staged_info(staging.stage_parquet(table(spark, sf, "lineitem")))


INFER_ROWS = [
    ("orders", 0, "o_orderkey", "bigint", "bigint"), ("orders", 1, "o_custkey", "bigint", "bigint"),
    ("orders", 2, "o_orderstatus", "string", "string"), ("orders", 3, "o_totalprice", "double", "double"),
    ("orders", 4, "o_orderdate", "timestamp", "timestamp_ntz"), ("orders", 5, "o_orderpriority", "string", "string"),
    ("embeddings", 0, "vec_id", "bigint", "bigint"), ("embeddings", 1, "embedding", "unmapped", "array<float>"),
    ("embeddings", 2, "label", "integer", "int"),
]


@register(
    "infer_interface",
    f"""SELECT * FROM (VALUES {_values(INFER_ROWS)}) AS t(table_name, position, "column", declared, native)
WHERE EXISTS (SELECT 1 FROM orders) AND EXISTS (SELECT 1 FROM embeddings)""",
)
def q_infer_interface(spark, sf):
    out = None
    for t in ("orders", "embeddings"):
        df = interface.infer_interface(table(spark, sf, t)).select(
            F.lit(t).alias("table_name"), F.col("position").cast("int").alias("position"), "column", "declared", "native"
        )
        out = df if out is None else out.unionByName(df)
    return out


# =====================================================================  2.B incremental


@register("delta_bootstrap", "SELECT * FROM events")
def q_delta_bootstrap(spark, sf):
    staged, _ = delta.stage_delta(table(spark, sf, "events"), "ts", None, source="events")
    return staged.df


@register("delta_ts", f"SELECT * FROM events WHERE ts > TIMESTAMP '{TS_MARK}'")
def q_delta_ts(spark, sf):
    staged, _ = delta.stage_delta(table(spark, sf, "events"), "ts", datetime.fromisoformat(TS_MARK), source="events")
    return staged.df


@register("delta_int", "SELECT * FROM orders WHERE o_orderkey > 5000")
def q_delta_int(spark, sf):
    staged, _ = delta.stage_delta(table(spark, sf, "orders"), "o_orderkey", 5000, source="orders")
    return staged.df


ORDERS_BY_DATE = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, o_orderstatus, o_totalprice FROM orders"


@register("delta_date", f"SELECT * FROM ({ORDERS_BY_DATE}) t WHERE order_date > DATE '1998-06-30'")
def q_delta_date(spark, sf):
    views(spark, sf, "orders")
    staged, _ = delta.stage_delta(spark.sql(ORDERS_BY_DATE), "order_date", date(1998, 6, 30), source="orders_by_date")
    return staged.df


@register("delta_lookback", "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15 06:00:00'")
def q_delta_lookback(spark, sf):
    staged, _ = delta.stage_delta(table(spark, sf, "events"), "ts", datetime.fromisoformat(TS_MARK), lookback="6h",
                                  source="events")
    return staged.df


@register(
    "watermark_advance",
    f"SELECT count(*) AS \"rows\", max(ts) AS new_max FROM events WHERE ts > TIMESTAMP '{TS_MARK}'",
)
def q_watermark_advance(spark, sf):
    d = delta.delta_filter(table(spark, sf, "events"), "ts", datetime.fromisoformat(TS_MARK))
    return delta.compute_advance(d, "ts")


WM_OLD_SQL = f"""
SELECT event_type AS source, 'ts' AS cursor_column, max(ts) AS mark_ts, CAST(NULL AS DATE) AS mark_date,
       CAST(NULL AS BIGINT) AS mark_int, count(*) AS last_delta_rows
FROM events WHERE ts < TIMESTAMP '{TS_SPLIT}' GROUP BY event_type
UNION ALL
SELECT concat('orders_', o_orderstatus), 'o_orderkey', CAST(NULL AS TIMESTAMP), CAST(NULL AS DATE),
       max(o_orderkey), count(*)
FROM orders WHERE o_orderdate < TIMESTAMP '{ORDERS_V1} 00:00:00' GROUP BY o_orderstatus
UNION ALL
SELECT concat('late_', o_orderstatus), 'o_orderdate', CAST(NULL AS TIMESTAMP), max(CAST(o_orderdate AS DATE)),
       CAST(NULL AS BIGINT), count(*)
FROM orders GROUP BY o_orderstatus
"""

WM_ADV_SQL = f"""
SELECT event_type AS source, 'ts' AS cursor_column, max(ts) AS mark_ts, CAST(NULL AS DATE) AS mark_date,
       CAST(NULL AS BIGINT) AS mark_int, count(*) AS last_delta_rows
FROM events WHERE ts > TIMESTAMP '2024-01-18 00:00:00' GROUP BY event_type
UNION ALL
SELECT concat('orders_', o_orderstatus), 'o_orderkey', CAST(NULL AS TIMESTAMP), CAST(NULL AS DATE),
       max(o_orderkey), count(*)
FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01 00:00:00' GROUP BY o_orderstatus
UNION ALL
SELECT concat('late_', o_orderstatus), 'o_orderdate', CAST(NULL AS TIMESTAMP),
       max(CASE WHEN o_orderdate > TIMESTAMP '2030-01-01 00:00:00' THEN CAST(o_orderdate AS DATE) END),
       CAST(NULL AS BIGINT), CAST(0 AS BIGINT)
FROM orders GROUP BY o_orderstatus
UNION ALL
SELECT 'all_events', 'ts', max(ts), CAST(NULL AS DATE), CAST(NULL AS BIGINT), count(*) FROM events
"""


def _wm(spark, sql: str) -> DataFrame:
    df = spark.sql(sql)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in delta.WATERMARK_SCHEMA.fields])


@register(
    "watermark_upsert",
    f"""
WITH old AS ({WM_OLD_SQL}), adv0 AS ({WM_ADV_SQL}),
adv AS (SELECT * FROM adv0 WHERE mark_ts IS NOT NULL OR mark_date IS NOT NULL OR mark_int IS NOT NULL)
SELECT coalesce(a.source, o.source) AS source,
       CASE WHEN a.source IS NOT NULL THEN a.cursor_column ELSE o.cursor_column END AS cursor_column,
       CASE WHEN a.mark_ts IS NOT NULL THEN coalesce(greatest(o.mark_ts, a.mark_ts), a.mark_ts) ELSE o.mark_ts END AS mark_ts,
       CASE WHEN a.mark_date IS NOT NULL THEN coalesce(greatest(o.mark_date, a.mark_date), a.mark_date) ELSE o.mark_date END AS mark_date,
       CASE WHEN a.mark_int IS NOT NULL THEN coalesce(greatest(o.mark_int, a.mark_int), a.mark_int) ELSE o.mark_int END AS mark_int,
       CASE WHEN a.source IS NOT NULL THEN a.last_delta_rows ELSE o.last_delta_rows END AS last_delta_rows
FROM old o FULL OUTER JOIN adv a ON o.source = a.source
""",
)
def q_watermark_upsert(spark, sf):
    views(spark, sf, "events", "orders")
    return delta.upsert_watermarks(_wm(spark, WM_OLD_SQL), _wm(spark, WM_ADV_SQL))


WM_DUP_SQL = """
SELECT o_orderpriority AS source, 'o_orderkey' AS cursor_column, max(o_orderkey) AS mark_int
FROM orders GROUP BY o_orderpriority, o_orderstatus
"""


@register("watermark_dups", f"SELECT source, count(*) AS n FROM ({WM_DUP_SQL}) w GROUP BY source HAVING count(*) > 1")
def q_watermark_dups(spark, sf):
    views(spark, sf, "orders")
    return delta.check_watermarks(spark.sql(WM_DUP_SQL))


EVENTS_ACC_SQL = "SELECT event_id, ts, user_id, event_type, value FROM events"


def _events_product(uri: str, lookback: str | None = None, rollup: bool = False) -> Product:
    transforms = [Transform(name="events_acc", sql=EVENTS_ACC_SQL, strategy="upsert", key=["event_id"],
                            path="sql/events_acc.sql")]
    exports = [Export(name="events_acc", version="1.0.0", schema={"event_id": ColumnSpec("bigint"),
                                                                  "ts": ColumnSpec("timestamp")})]
    if rollup:
        transforms.append(Transform(name="events_rollup", sql=ROLLUP_SQL,
                                    path="sql/events_rollup.sql"))
        exports.append(Export(name="events_rollup", version="1.0.0", grain=["event_type"],
                              schema={"event_type": ColumnSpec("string"), "n": ColumnSpec("bigint"),
                                      "total": ColumnSpec("decimal")}))
    return Product(
        name="events",
        sources={"events": Source(name="events", kind="raw", uri=uri, format="parquet",
                                  incremental=Incremental(cursor="ts", lookback=lookback))},
        transforms=transforms,
        exports=exports,
    )


@register("full_refresh", EVENTS_ACC_SQL)
def q_full_refresh(spark, sf):
    ev = table(spark, sf, "events")
    first = derived_copy(ev.where(F.col("ts") < F.lit(TS_SPLIT).cast("timestamp_ntz")), "events_head")
    root = root_for(spark, "events_fr")
    run(spark, _events_product(first), root)
    res = run(spark, _events_product(f"{sf}/events.parquet"), root, full_refresh=True)
    return Store(spark, root).read_table("events_acc", res.version)


WM_STATUS_DECL = """
SELECT DISTINCT event_type AS source, 'ts' AS "cursor" FROM events
UNION ALL
SELECT DISTINCT concat('orders_', o_orderstatus), 'o_orderkey' FROM orders
"""
WM_STATUS_MARKS = """
SELECT event_type AS source, 'ts' AS cursor_column, max(ts) AS mark_ts, CAST(NULL AS DATE) AS mark_date,
       CAST(NULL AS BIGINT) AS mark_int, count(*) AS last_delta_rows
FROM events GROUP BY event_type
"""


@register(
    "watermark_status",
    f"""
WITH d AS ({WM_STATUS_DECL}), w AS ({WM_STATUS_MARKS})
SELECT d.source, d."cursor", strftime(w.mark_ts, '%Y-%m-%d %H:%M:%S.%f') AS mark, w.last_delta_rows,
       CASE WHEN w.source IS NULL THEN 'next run bootstraps' ELSE 'incremental' END AS status
FROM d LEFT JOIN w ON d.source = w.source
""",
)
def q_watermark_status(spark, sf):
    views(spark, sf, "events", "orders")
    decl = spark.sql(WM_STATUS_DECL.replace('"cursor"', "`cursor`"))
    return delta.watermark_status(decl, _wm(spark, WM_STATUS_MARKS))


WM_TARGET = f"""
SELECT event_type AS source, 'ts' AS cursor_column, max(ts) AS mark_ts, CAST(NULL AS DATE) AS mark_date,
       CAST(NULL AS BIGINT) AS mark_int, count(*) AS last_delta_rows
FROM events WHERE ts < TIMESTAMP '{TS_SPLIT}' GROUP BY event_type
"""
WM_CURRENT = """
SELECT event_type AS source, 'ts' AS cursor_column, max(ts) AS mark_ts, CAST(NULL AS DATE) AS mark_date,
       CAST(NULL AS BIGINT) AS mark_int, count(*) AS last_delta_rows
FROM events GROUP BY event_type
UNION ALL
SELECT concat('orders_', o_orderstatus), 'o_orderkey', CAST(NULL AS TIMESTAMP), CAST(NULL AS DATE),
       max(o_orderkey), count(*)
FROM orders GROUP BY o_orderstatus
"""


def _mark_text_sql(p: str) -> str:
    return (f"coalesce(strftime({p}mark_ts, '%Y-%m-%d %H:%M:%S.%f'), CAST({p}mark_date AS VARCHAR), "
            f"CAST({p}mark_int AS VARCHAR))")


@register(
    "watermark_diff",
    f"""
WITH c AS ({WM_CURRENT}), t AS ({WM_TARGET}),
j AS (SELECT c.source, CASE WHEN t.source IS NULL THEN 'absent_in_target' ELSE 'rewind' END AS change,
             {_mark_text_sql('c.')} AS from_mark, {_mark_text_sql('t.')} AS to_mark
      FROM c LEFT JOIN t ON c.source = t.source)
SELECT * FROM j WHERE change = 'absent_in_target' OR from_mark IS DISTINCT FROM to_mark
""",
)
def q_watermark_diff(spark, sf):
    views(spark, sf, "events", "orders")
    return delta.watermark_diff(_wm(spark, WM_CURRENT), _wm(spark, WM_TARGET))


@register("land_stream", "SELECT * FROM events")
def q_land_stream(spark, sf):
    ev = table(spark, sf, "events")
    # The stream's input: the events table as several files, one micro-batch each.
    src = scratch_path(spark, "stream_in", "events")
    ev.repartition(4, "event_id").write.parquet(src)
    root = root_for(spark, "events_stream")
    sdf = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = land_stream(sdf, root, "events_stream", ["event_id"], "upsert",
                    checkpoint=scratch_path(spark, "stream_ckpt", "events"))
    q.awaitTermination()
    return Store(spark, root).read_table("events_stream")


def _warehouse(objects: dict[str, tuple[DataFrame, dict[str, str]]]):
    """A loader that answers as a warehouse of views would, over Spark frames: metadata rows, then query texts."""

    def load(spark, fmt, options):
        text = options["query"]
        if "INFORMATION_SCHEMA" in text:
            rows = [("T", name, "VIEW", None) for name in objects]
            rows += [("C", name, c, t) for name, (_, types) in objects.items() for c, t in types.items()]
            return spark.createDataFrame(rows, "k string, n string, v1 string, v2 string")
        for name, (df, _) in objects.items():
            text = text.replace(f"`acme.sales.{name}`", "{" + name + "}")
        session = next(iter(objects.values()))[0].sparkSession
        return session.sql(text.replace("DATETIME '", "TIMESTAMP_NTZ '"), **{name: df for name, (df, _) in objects.items()})

    return load


@register(
    "warehouse_view_delta",
    f"""
WITH mark AS (SELECT max(ts) - INTERVAL 6 HOURS AS m FROM events WHERE ts <= TIMESTAMP '{TS_SPLIT}')
SELECT event_id, ts, user_id, event_type, CASE WHEN ts > m THEN value + 1 ELSE value END AS value FROM events, mark
""",
)
def q_warehouse_view_delta(spark, sf):
    """A view's delta, filtered by the server from the rendered mark; the view's older rows changed unseen."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    types = {"event_id": "INT64", "ts": "DATETIME", "user_id": "INT64", "event_type": "STRING", "value": "FLOAT64"}
    view = Source(name="events", kind="jdbc", connection={"type": "bigquery", "project": "acme"}, table="sales.events_v",
                  incremental=Incremental(cursor="ts", lookback="6h"))
    product = Product(
        name="events", sources={"events": view},
        transforms=[Transform(name="events_acc", sql=EVENTS_ACC_SQL, strategy="upsert", key=["event_id"], path="sql/events_acc.sql")],
    )
    root = root_for(spark, "warehouse_view")
    first = events.where(F.col("ts") <= F.lit(TS_SPLIT).cast("timestamp_ntz"))
    later = events.withColumn("value", F.col("value") + 1)
    for rows in (first, later):
        run(spark, product, root, load=_warehouse({"events_v": (rows, types)}))
    return Store(spark, root).read_table("events_acc")


def _database(tables: dict[str, DataFrame]):
    """A JDBC reader that answers the texts it is sent from ``tables``."""

    def load(spark, fmt, options):
        if "query" in options:
            text = options["query"]
            for name in tables:
                text = re.sub(rf"\b{name}\b", f"{{{name}}}", text)
            return next(iter(tables.values())).sparkSession.sql(text, **tables)  # leaves no view behind
        rows = tables[options["dbtable"]]
        parts = [rows.where(p) for p in options.get("predicates", ["true"])]
        return functools.reduce(DataFrame.unionAll, parts)

    return load


@register(
    "source_jdbc_ranges",
    """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS n, sum(l_linenumber)::BIGINT AS line_sum FROM lineitem GROUP BY 1
""",
)
def q_source_jdbc_ranges(spark, sf):
    """A6 by counted ranges: every row of a table read in partitions planned from its counts arrives once."""
    product = Product(
        name="lines", sources={"lines": Source(name="lines", kind="jdbc", connection={"url": "jdbc:db"}, table="lineitem_t",
                                               partition={"column": "l_orderkey", "partitions": 12})},
        transforms=[Transform(name="by_month", sql="SELECT CAST(date_trunc('MONTH', l_shipdate) AS DATE) AS month, count(*) AS n, "
                              "sum(l_linenumber) AS line_sum FROM lines GROUP BY 1", path="sql/by_month.sql")],
        exports=[Export(name="by_month", version="1.0.0", grain=["month"], schema={"month": ColumnSpec("date"), "n": ColumnSpec("bigint")})],
    )
    root = root_for(spark, "jdbc_ranges")
    run(spark, product, root, load=_database({"lineitem_t": table(spark, sf, "lineitem")}))
    return Store(spark, root).read_table("by_month")


@register(
    "land_stream_order",
    """
SELECT event_id, ts, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events
  WHERE user_id IS NOT NULL) t
WHERE r = 1
""",
)
def q_land_stream_order(spark, sf):
    """B14 with a sequence column: one row per user, the latest, though every batch brings older records as well."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value").where("user_id IS NOT NULL")
    src = scratch_path(spark, "stream_in", "events_order")
    ev.repartition(3, "event_id").write.parquet(src)
    root = root_for(spark, "events_order")
    sdf = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = land_stream(sdf, root, "latest", ["user_id"], "upsert", checkpoint=scratch_path(spark, "stream_ckpt", "events_order"), order=["ts", "event_id"])
    q.awaitTermination()
    return Store(spark, root).read_table("latest")


# =====================================================================  2.C transforms


@register("product_orders_daily", flagship.FLAGSHIP_ORACLE)
def q_product_orders_daily(spark, sf):
    return flagship.orders_daily(spark, sf)


LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LI_REST = [c for c in LI_COLS if c not in ("l_orderkey", "l_linenumber", "l_shipdate")]


@register(
    "keep_latest",
    f"""
SELECT {', '.join(LI_COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
     ORDER BY l_shipdate DESC NULLS LAST, {', '.join(c + ' DESC NULLS LAST' for c in _LI_REST)}) AS rn
  FROM lineitem) t
WHERE rn = 1
""",
)
def q_keep_latest(spark, sf):
    return strategy.keep_latest(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])


# =====================================================================  2.D landing

ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
ORD_T_SQL = f"SELECT {ORDER_COLS} FROM orders WHERE o_orderdate < TIMESTAMP '{ORDERS_SPLIT} 00:00:00'"
ORD_D_SQL = (
    "SELECT o_orderkey, o_custkey, concat(o_orderstatus, '2') AS o_orderstatus, o_totalprice, o_orderdate, "
    f"o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '{ORDERS_OVERLAP} 00:00:00'"
)
ORD_F_SQL = f"SELECT {ORDER_COLS} FROM orders WHERE o_orderdate >= TIMESTAMP '{ORDERS_REFRESH} 00:00:00'"


def _orders_keyed(sf: str, sql: str, strategy_name: str) -> Product:
    t = Transform(name="orders_acc", sql=sql, strategy=strategy_name,
                  key=[] if strategy_name == "replace" else ["o_orderkey"], path="sql/orders_acc.sql")
    return Product(name="orders_acc", sources=raw_sources(sf, "orders"), transforms=[t],
                   exports=[Export(name="orders_acc", version="1.0.0",
                                   grain=["o_orderkey"] if strategy_name == "replace" else [],
                                   schema={"o_orderkey": ColumnSpec("bigint"), "o_orderstatus": ColumnSpec("string")})])


def _two_runs(spark, sf, strategy_name: str, name: str) -> DataFrame:
    root = root_for(spark, name)
    run(spark, _orders_keyed(sf, ORD_T_SQL, strategy_name), root)
    res = run(spark, _orders_keyed(sf, ORD_D_SQL, strategy_name), root)
    return Store(spark, root).read_table("orders_acc", res.version)


@register(
    "mat_append",
    f"""
{ORD_T_SQL}
UNION ALL
SELECT * FROM ({ORD_D_SQL}) d WHERE o_orderdate >= TIMESTAMP '{ORDERS_SPLIT} 00:00:00'
""",
)
def q_mat_append(spark, sf):
    return _two_runs(spark, sf, "append", "orders_append")


@register(
    "mat_upsert",
    f"""
SELECT {ORDER_COLS} FROM orders WHERE o_orderdate < TIMESTAMP '{ORDERS_OVERLAP} 00:00:00'
UNION ALL
{ORD_D_SQL}
""",
)
def q_mat_upsert(spark, sf):
    return _two_runs(spark, sf, "upsert", "orders_upsert")


@register(
    "mat_strategy_change",
    f"""
SELECT 'append' AS strategy, * FROM ({ORD_T_SQL}
  UNION ALL SELECT * FROM ({ORD_D_SQL}) d WHERE o_orderdate >= TIMESTAMP '{ORDERS_SPLIT} 00:00:00') a
UNION ALL
SELECT 'upsert' AS strategy, * FROM (SELECT {ORDER_COLS} FROM orders WHERE o_orderdate < TIMESTAMP '{ORDERS_OVERLAP} 00:00:00'
  UNION ALL {ORD_D_SQL}) u
""",
)
def q_mat_strategy_change(spark, sf):
    """A table first built by ``replace`` and then landed by key: the stored rows are laid out on the key first."""
    out = None
    for name in ("append", "upsert"):
        root = root_for(spark, f"orders_to_{name}")
        run(spark, _orders_keyed(sf, ORD_T_SQL, "replace"), root)
        res = run(spark, _orders_keyed(sf, ORD_D_SQL, name), root)
        got = Store(spark, root).read_table("orders_acc", res.version).select(F.lit(name).alias("strategy"), "*")
        out = got if out is None else out.unionByName(got)
    return out


@register(
    "mat_key_change",
    f"""
SELECT {ORDER_COLS} FROM orders WHERE o_orderdate < TIMESTAMP '{ORDERS_OVERLAP} 00:00:00'
UNION ALL
{ORD_D_SQL}
""",
)
def q_mat_key_change(spark, sf):
    """The key shrinks from (o_orderkey, o_custkey) to o_orderkey between two upserts."""
    root = root_for(spark, "orders_rekeyed")
    first = _orders_keyed(sf, ORD_T_SQL, "upsert")
    first.transforms[0].key = ["o_orderkey", "o_custkey"]
    run(spark, first, root)
    res = run(spark, _orders_keyed(sf, ORD_D_SQL, "upsert"), root)
    return Store(spark, root).read_table("orders_acc", res.version)


@register("mat_replace", ORD_D_SQL)
def q_mat_replace(spark, sf):
    return _two_runs(spark, sf, "replace", "orders_replace")


@register("mat_full_refresh", ORD_F_SQL)
def q_mat_full_refresh(spark, sf):
    root = root_for(spark, "orders_refresh")
    run(spark, _orders_keyed(sf, ORD_T_SQL, "upsert"), root)
    run(spark, _orders_keyed(sf, ORD_D_SQL, "upsert"), root)
    res = run(spark, _orders_keyed(sf, ORD_F_SQL, "upsert"), root, full_refresh=True)
    return Store(spark, root).read_table("orders_acc", res.version)


NULL_KEY_SQL = ("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status_key, "
                "nullif(o_orderpriority, '5-LOW') AS priority_key FROM orders")


@register(
    "guard_null_keys",
    f"""
SELECT count(*) FILTER (WHERE o_orderkey IS NULL) AS o_orderkey,
       count(*) FILTER (WHERE status_key IS NULL) AS status_key,
       count(*) FILTER (WHERE priority_key IS NULL) AS priority_key
FROM ({NULL_KEY_SQL}) t
""",
)
def q_guard_null_keys(spark, sf):
    views(spark, sf, "orders")
    return strategy.null_key_counts(spark.sql(NULL_KEY_SQL), ["o_orderkey", "status_key", "priority_key"])


@register(
    "guard_dup_keys",
    """
WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
           GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
SELECT l_orderkey, l_linenumber,
       concat_ws(' | ', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS key_display, n,
       (SELECT count(*) FROM d) AS total_offending
FROM d ORDER BY n DESC, l_orderkey, l_linenumber LIMIT 5
""",
)
def q_guard_dup_keys(spark, sf):
    key = ["l_orderkey", "l_linenumber"]
    dups = strategy.duplicate_keys(table(spark, sf, "lineitem"), key)
    total = dups.count()
    return strategy.top_duplicates(dups, key).withColumn("total_offending", F.lit(total).cast("long"))


DRIFT_SQL = ("SELECT o_orderkey, CAST(o_custkey AS INT) AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, "
             "'web' AS o_channel FROM orders")
DRIFT_ROWS = [
    ("o_custkey", "type_change", "bigint", "int"),
    ("o_channel", "new_column", None, "string"),
    ("o_orderpriority", "dropped_column", "string", None),
]


@register(
    "schema_drift",
    f"""SELECT * FROM (VALUES {_values(DRIFT_ROWS)}) AS t("column", change, table_type, select_type)
WHERE EXISTS (SELECT 1 FROM orders)""",
)
def q_schema_drift(spark, sf):
    """D10 as it happens in a run: the accumulated table is landed from orders, the drifted SELECT is
    staged, the guard refuses it, and every difference between the two is reported."""
    views(spark, sf, "orders")
    store = Store(spark, root_for(spark, "orders_drift"))
    acc = strategy.land_keyed(store, staging.stage_parquet(table(spark, sf, "orders")), "orders_acc",
                              ["o_orderkey"], "upsert", None).state
    drifted = staging.stage_parquet(spark.sql(DRIFT_SQL))
    try:
        strategy.land_keyed(store, drifted, "orders_acc", ["o_orderkey"], "upsert", acc)
        raise AssertionError("a drifted delta must be refused")
    except GuardError:
        pass
    rows = strategy.drift_report(drifted.df.schema, acc.schema)
    return spark.createDataFrame(rows, "column string, change string, table_type string, select_type string")


# =====================================================================  2.E checks

DIFF_COLS = "l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity"
DIFF_BEFORE = f"SELECT {DIFF_COLS} FROM lineitem WHERE l_returnflag IN ('R', 'A')"
DIFF_AFTER = (f"SELECT {DIFF_COLS} FROM lineitem WHERE l_returnflag IN ('A', 'N') UNION ALL "
              f"SELECT {DIFF_COLS} FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O'")


@register(
    "multiset_diff",
    f"""
WITH s AS (SELECT *, -1 AS s FROM ({DIFF_BEFORE}) b UNION ALL SELECT *, 1 AS s FROM ({DIFF_AFTER}) a)
SELECT {DIFF_COLS}, CASE WHEN sum(s) > 0 THEN 'added' ELSE 'removed' END AS change,
       CAST(abs(sum(s)) AS BIGINT) AS copies
FROM s GROUP BY {DIFF_COLS} HAVING sum(s) <> 0
""",
)
def q_multiset_diff(spark, sf):
    views(spark, sf, "lineitem")
    return checks.multiset_diff(spark.sql(DIFF_BEFORE), spark.sql(DIFF_AFTER))


@register(
    "replay_diff",
    """
SELECT event_id, ts, user_id, event_type, value + 1 AS value, 'added' AS change, CAST(1 AS BIGINT) AS copies
FROM events WHERE event_id % 100 = 0 AND value IS NOT NULL
UNION ALL
SELECT event_id, ts, user_id, event_type, value, 'removed', 1 FROM events WHERE event_id % 100 = 0 AND value IS NOT NULL
""",
)
def q_replay_diff(spark, sf):
    """A run that replays alike passes its check; a SELECT that gives other rows the second time shows them."""
    root = root_for(spark, "events_replay")
    res = run(spark, _events_product(f"{sf}/events.parquet"), root, replay_check=True)
    before = Store(spark, root).read_table("events_acc", res.version)
    events = table(spark, sf, "events").select(*before.columns)
    again = events.withColumn("value", F.when(F.col("event_id") % 100 == 0, F.col("value") + 1).otherwise(F.col("value")))
    if not checks.is_same_multiset(before, strategy.upsert_by_key(before, events, ["event_id"])):
        raise AssertionError("the same rows once more must not differ")
    return checks.multiset_diff(before, strategy.upsert_by_key(before, again, ["event_id"]))


SHRINK_BEFORE = "SELECT o_orderstatus AS table_name, count(*) AS \"rows\" FROM orders GROUP BY o_orderstatus"
SHRINK_AFTER = ("SELECT o_orderstatus AS table_name, count(*) AS \"rows\" FROM orders "
                f"WHERE o_orderdate < TIMESTAMP '{ORDERS_REFRESH} 00:00:00' GROUP BY o_orderstatus")


@register(
    "shrink_detect",
    f"""
SELECT b.table_name, b."rows" AS rows_before, a."rows" AS rows_after
FROM ({SHRINK_BEFORE}) b JOIN ({SHRINK_AFTER}) a ON b.table_name = a.table_name
WHERE a."rows" < b."rows"
""",
)
def q_shrink_detect(spark, sf):
    views(spark, sf, "orders")
    return checks.shrunk_tables(spark.sql(SHRINK_BEFORE.replace('"', "`")), spark.sql(SHRINK_AFTER.replace('"', "`")))


# =====================================================================  2.F verification

ORDERS_EXPORT = Export(
    name="orders_raw", version="1.0.0", bind="orders", grain=["o_orderkey"],
    schema={
        "o_orderkey": ColumnSpec("bigint"), "o_custkey": ColumnSpec("int"), "o_orderstatus": ColumnSpec("text"),
        "o_totalprice": ColumnSpec("decimal"), "o_orderdate": ColumnSpec("timestamp"),
        "o_orderpriority": ColumnSpec("string"), "o_missing": ColumnSpec("string"),
    },
)
SCHEMA_ROWS = [
    ("orders_raw@1", "o_orderkey", "column", "bigint", "bigint", True),
    ("orders_raw@1", "o_custkey", "column", "int", "bigint", False),
    ("orders_raw@1", "o_orderstatus", "column", "text", "string", True),
    ("orders_raw@1", "o_totalprice", "column", "decimal", "double", False),
    ("orders_raw@1", "o_orderdate", "column", "timestamp", "timestamp_ntz", True),
    ("orders_raw@1", "o_orderpriority", "column", "string", "string", True),
    ("orders_raw@1", "o_missing", "column", "string", None, False),
    ("orders_raw@1", "o_orderkey", "grain", None, "bigint", True),
]


@register(
    "verify_schema",
    f"""SELECT * FROM (VALUES {_values(SCHEMA_ROWS)}) AS t(route, "column", role, declared, actual, ok)
WHERE EXISTS (SELECT 1 FROM orders)""",
)
def q_verify_schema(spark, sf):
    return verify.schema_report(spark, [ORDERS_EXPORT], {"orders": table(spark, sf, "orders")})


# Declared interface over the classified objects: lineitem lines of open orders are declared decimal,
# the others int; locally every such column arrives degraded to string. Orders add objects with no
# native metadata, checked by the local rule.
DECLARED_SQL = """
SELECT concat('obj_', CAST(l_partkey AS STRING)) AS object, concat('col_', CAST(l_linenumber AS STRING)) AS column_name,
       max(CASE WHEN l_linestatus = 'O' THEN 'decimal' ELSE 'int' END) AS declared, 'string' AS actual
FROM lineitem GROUP BY l_partkey, l_linenumber
UNION ALL
SELECT concat('ord_', CAST(o_orderkey AS STRING)), 'o_totalprice',
       CASE WHEN o_orderstatus = 'F' THEN 'double' ELSE 'bigint' END, 'double'
FROM orders
"""


@register(
    "verify_native_types",
    f"""
WITH meta AS ({META_SQL}),
nat AS (SELECT lower(n) AS object_k, lower(v1) AS column_k, max(v2) AS native_type FROM meta WHERE k = 'C'
        GROUP BY lower(n), lower(v1)),
decl AS ({DECLARED_SQL})
SELECT d.object, d.column_name, d.declared, d.actual, n.native_type,
       CASE WHEN n.native_type IS NOT NULL THEN
              CASE d.declared WHEN 'decimal' THEN n.native_type IN ('NUMERIC', 'BIGNUMERIC')
                              WHEN 'int' THEN n.native_type = 'INT64' ELSE lower(n.native_type) = d.declared END
            ELSE CASE d.declared WHEN 'double' THEN d.actual IN ('double', 'float')
                                 WHEN 'bigint' THEN d.actual = 'bigint' ELSE d.actual = d.declared END
       END AS ok
FROM decl d LEFT JOIN nat n ON lower(d.object) = n.object_k AND lower(d.column_name) = n.column_k
""",
)
def q_verify_native_types(spark, sf):
    views(spark, sf, "part", "lineitem", "supplier", "orders")
    meta = spark.sql(META_SQL)
    native = (
        meta.where(F.col("k") == "C")
        .groupBy(F.col("n").alias("object"), F.col("v1").alias("column_name"))
        .agg(F.max("v2").alias("native_type"))
    )
    declared = spark.sql(DECLARED_SQL)
    return verify.native_type_report(declared, native, on=["object", "column_name"]).select(
        "object", "column_name", "declared", "actual", "native_type", "ok"
    )


GRAIN_CASES = [
    ("orders", "orders", ["o_orderkey"]),
    ("lineitem", "lineitem", ["l_orderkey", "l_linenumber"]),
    ("customer_segment", "customer", ["c_nationkey", "c_mktsegment"]),
]


def _grain_oracle(cases) -> str:
    parts = []
    for name, src, grain in cases:
        g = ", ".join(grain)
        parts.append(
            f"SELECT '{name}' AS check_name, CAST(count(*) AS BIGINT) AS \"rows\", "
            f"(SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT {g} FROM {src}) d) AS distinct_grain, "
            f"count(*) = (SELECT count(*) FROM (SELECT DISTINCT {g} FROM {src}) d) AS ok FROM {src}"
        )
    return "\nUNION ALL\n".join(parts)


def _grain_query(spark, frames, cases) -> DataFrame:
    out = None
    for name, src, grain in cases:
        g = verify.grain_counts(frames[src], grain).select(
            F.lit(name).alias("check_name"), "rows", "distinct_grain",
            (F.col("rows") == F.col("distinct_grain")).alias("ok"),
        )
        out = g if out is None else out.unionByName(g)
    return out


@register("verify_grain", _grain_oracle(GRAIN_CASES))
def q_verify_grain(spark, sf):
    frames = {s: table(spark, sf, s) for s in ("orders", "lineitem", "customer")}
    return _grain_query(spark, frames, GRAIN_CASES)


NULL_GRAIN_LI = "SELECT l_orderkey, nullif(l_linenumber, 1) AS ln FROM lineitem"
NULL_GRAIN_EV = "SELECT nullif(event_type, 'click') AS et, user_id FROM events"
VIOLATION_CASES = [
    ("lineitem_null_line", "li_null", ["l_orderkey", "ln"]),
    ("events_null_type", "ev_null", ["et", "user_id"]),
]


@register(
    "verify_grain_violation",
    _grain_oracle([(n, f"({NULL_GRAIN_LI}) s" if s == "li_null" else f"({NULL_GRAIN_EV}) s", g)
                   for n, s, g in VIOLATION_CASES]),
)
def q_verify_grain_violation(spark, sf):
    views(spark, sf, "lineitem", "events")
    frames = {"li_null": spark.sql(NULL_GRAIN_LI), "ev_null": spark.sql(NULL_GRAIN_EV)}
    return _grain_query(spark, frames, VIOLATION_CASES)


@register(
    "verify_bound",
    """
SELECT 'orders_bound@1' AS route, CAST(count(*) AS BIGINT) AS "rows",
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT o_orderkey FROM orders) d) AS distinct_grain,
       count(*) = (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM orders) d) AS ok
FROM orders
""",
)
def q_verify_bound(spark, sf):
    prod = Product(
        name="orders_bound",
        sources=raw_sources(sf, "orders"),
        transforms=[Transform(name="orders_count", sql="SELECT count(*) AS n FROM orders")],
        exports=[Export(name="orders_bound", version="1.0.0", bind="orders", grain=["o_orderkey"],
                        schema={"o_orderkey": ColumnSpec("bigint"), "o_orderdate": ColumnSpec("timestamp")})],
    )
    src = raw.read_raw(spark, prod.sources["orders"].uri)
    v = verify.verify_export(prod.exports[0], src)
    g = v.grain
    return spark.createDataFrame([(v.route, g["rows"], g["distinct_grain"], v.ok)],
                                 "route string, rows long, distinct_grain long, ok boolean")


# =====================================================================  2.G snapshots


@register(
    "snapshot_commit",
    """
SELECT CAST(1 AS BIGINT) AS version, 'nation' AS table_name, CAST(count(*) AS BIGINT) AS "rows" FROM nation
UNION ALL
SELECT CAST(1 AS BIGINT), 'region', CAST(count(*) AS BIGINT) FROM region
""",
)
def q_snapshot_commit(spark, sf):
    store = Store(spark, root_for(spark, "dims"))
    states = {}
    for t in ("nation", "region"):
        states[t] = strategy.land_replace(store, table(spark, sf, t), t).state
    store.commit(states, [], product="dims")
    m = store.manifests_df()
    return m.select("version", F.explode("tables").alias("t")).select(
        "version", F.col("t.name").alias("table_name"), F.col("t.rows").alias("rows")
    )


SNAP_V1 = f"SELECT {ORDER_COLS} FROM orders WHERE o_orderdate < TIMESTAMP '{ORDERS_V1} 00:00:00'"
SNAP_V2 = f"SELECT {ORDER_COLS} FROM orders"
SNAP_V3 = f"SELECT {ORDER_COLS} FROM orders WHERE o_orderdate >= TIMESTAMP '{ORDERS_REFRESH} 00:00:00'"


def _snap_product(sf: str, sql: str, contract: str = "supported") -> Product:
    return Product(
        name="orders_snap", sources=raw_sources(sf, "orders"),
        transforms=[Transform(name="orders_snap", sql=sql, path="sql/orders_snap.sql")],
        exports=[Export(name="orders_snap", version="1.0.0", grain=["o_orderkey"], contract=contract,
                        description="Orders as of the snapshot.",
                        schema={"o_orderkey": ColumnSpec("bigint"), "o_orderstatus": ColumnSpec("string")})],
    )


def _snap_store(spark, sf, name: str, release_v1: bool = False) -> Store:
    root = root_for(spark, name)
    run(spark, _snap_product(sf, SNAP_V1), root)
    if release_v1:
        snapshots.release(spark, root, _snap_product(sf, SNAP_V1))
    run(spark, _snap_product(sf, SNAP_V2), root)
    return Store(spark, root)


@register("snapshot_read", SNAP_V1)
def q_snapshot_read(spark, sf):
    store = _snap_store(spark, sf, "snap_read")
    return store.read_table("orders_snap", version=1)


@register(
    "attach",
    f"""
WITH a AS (SELECT o_orderstatus, count(*) AS n FROM ({SNAP_V1}) s GROUP BY o_orderstatus),
     b AS (SELECT o_orderstatus, count(*) AS n FROM ({SNAP_V2}) s GROUP BY o_orderstatus)
SELECT coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, a.n AS n_v1, b.n AS n_v2
FROM a FULL OUTER JOIN b ON a.o_orderstatus = b.o_orderstatus
""",
)
def q_attach(spark, sf):
    store = _snap_store(spark, sf, "snap_attach")
    snapshots.attach(spark, store.root, 1, prefix="v1_")
    snapshots.attach(spark, store.root, 2, prefix="v2_")
    return spark.sql("""
        WITH a AS (SELECT o_orderstatus, count(*) AS n FROM v1_orders_snap GROUP BY o_orderstatus),
             b AS (SELECT o_orderstatus, count(*) AS n FROM v2_orders_snap GROUP BY o_orderstatus)
        SELECT coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, a.n AS n_v1, b.n AS n_v2
        FROM a FULL OUTER JOIN b ON a.o_orderstatus = b.o_orderstatus""")


@register(
    "release_pins",
    f"""
SELECT 'orders_snap@1' AS route, CAST(1 AS BIGINT) AS pinned_version, CAST(2 AS BIGINT) AS latest_version,
       CAST(count(*) AS BIGINT) AS rows_at_pin
FROM ({SNAP_V1}) s
""",
)
def q_release_pins(spark, sf):
    store = _snap_store(spark, sf, "snap_release", release_v1=True)
    pins = store.releases()["routes"]
    rows = [(route, int(v), int(store.latest()), store.tables(v)["orders_snap"].rows) for route, v in pins.items()]
    return spark.createDataFrame(rows, "route string, pinned_version long, latest_version long, rows_at_pin long")


@register("read_pinned", SNAP_V1)
def q_read_pinned(spark, sf):
    store = _snap_store(spark, sf, "snap_pinned", release_v1=True)
    export = _snap_product(sf, SNAP_V2).exports[0]
    return snapshots.read_export_table(spark, store.root, export)


DESC_PREV = """
SELECT concat(n_name, '@1') AS route, '1.0.0' AS version, concat('Revenue for ', n_name) AS description,
       'USD' AS units, 'revenue summed per day' AS column_descriptions
FROM nation
"""
DESC_CUR = """
SELECT concat(n_name, '@1') AS route, '1.0.0' AS version,
       CASE WHEN n_regionkey = 2 THEN concat('Net revenue for ', n_name) ELSE concat('Revenue for ', n_name) END
         AS description,
       'USD' AS units, 'revenue summed per day' AS column_descriptions
FROM nation
"""


def _digest_sql(alias: str) -> str:
    return (f"sha256(concat_ws(chr(31), coalesce({alias}.description, ''), coalesce({alias}.units, ''), "
            f"coalesce({alias}.column_descriptions, '')))")


@register(
    "description_drift",
    f"""
SELECT c.route, c.version, {_digest_sql('p')} AS prev_digest, {_digest_sql('c')} AS digest
FROM ({DESC_CUR}) c JOIN ({DESC_PREV}) p ON c.route = p.route
WHERE c.version = p.version AND {_digest_sql('c')} <> {_digest_sql('p')}
""",
)
def q_description_drift(spark, sf):
    views(spark, sf, "nation")
    return snapshots.description_changes(spark.sql(DESC_PREV), spark.sql(DESC_CUR))


@register("rollback", SNAP_V2)
def q_rollback(spark, sf):
    store = _snap_store(spark, sf, "snap_rollback")
    run(spark, _snap_product(sf, SNAP_V3), store.root)  # version 3
    snapshots.rollback(spark, store.root)  # back to 2
    return store.read_table("orders_snap")


EXPIRE_VERSIONS = """
SELECT CAST(year(o_orderdate) AS BIGINT) AS version, max(o_orderdate) AS committed_at
FROM orders GROUP BY year(o_orderdate)
"""


@register(
    "expire_snapshots",
    f"""
WITH v AS ({EXPIRE_VERSIONS})
SELECT version, committed_at FROM v
WHERE committed_at < TIMESTAMP '2000-01-01 00:00:00' AND version <> 1997
  AND version <> (SELECT max(version) FROM v)
""",
)
def q_expire_snapshots(spark, sf):
    views(spark, sf, "orders")
    pins = spark.createDataFrame([(1997,)], "version long")
    return snapshots.select_expirable(spark.sql(EXPIRE_VERSIONS), pins, "2000-01-01 00:00:00")


@register("orphan_files")
def q_orphan_files(spark, sf):
    root = root_for(spark, "orphans")
    run(spark, _snap_product(sf, SNAP_V1), root)
    bad = _snap_product(sf, "SELECT o_custkey AS o_orderkey, o_orderstatus FROM orders")  # grain violated
    try:
        run(spark, bad, root)
    except Exception:
        pass  # verification refused the run; its directory is now unreferenced
    store = Store(spark, root)
    cutoff = datetime.now(timezone.utc) + timedelta(days=1)
    orphans = snapshots.orphan_files(store.data_files_df(), store.referenced_dirs_df(), cutoff)
    return orphans.groupBy(F.regexp_extract("dir", r"^data/([^/]+)/", 1).alias("table_name")).agg(
        F.countDistinct("dir").alias("n_dirs")
    )


# =====================================================================  2.H profiling and catalog

COVERAGE_EXPORT = Export(name="orders_by_day", version="1.0.0", grain=["order_date", "o_orderkey"])


@register(
    "probe_coverage",
    f"""
SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(min(order_date) AS VARCHAR) AS min_order_date,
       CAST(max(order_date) AS VARCHAR) AS max_order_date
FROM ({ORDERS_BY_DATE}) t
""",
)
def q_probe_coverage(spark, sf):
    views(spark, sf, "orders")
    return profile.probe_coverage(spark.sql(ORDERS_BY_DATE), COVERAGE_EXPORT)


def _values_oracle(col: str, src: str) -> str:
    n = f"(SELECT count(DISTINCT {col}) FROM {src})"
    return f"""
SELECT '{col}' AS column_name, value, true AS complete
FROM (SELECT DISTINCT {col} AS value FROM {src} WHERE {col} IS NOT NULL) h WHERE {n} <= 50
UNION ALL
SELECT '{col}', NULL, false WHERE {n} > 50"""


@register(
    "probe_values",
    _values_oracle("c_mktsegment", "customer") + "\nUNION ALL" + _values_oracle("c_name", "customer")
    + "\nUNION ALL" + _values_oracle("n_name", "nation"),
)
def q_probe_values(spark, sf):
    cust, nat = table(spark, sf, "customer"), table(spark, sf, "nation")
    out = None
    for col, df in (("c_mktsegment", cust), ("c_name", cust), ("n_name", nat)):
        p = profile.probe_values(df, col).select(F.lit(col).alias("column_name"), "value", "complete")
        out = p if out is None else out.unionByName(p)
    return out


@register(
    "probe_example",
    f"""
SELECT concat('orders_daily@2?order_date=', url_encode(CAST(order_date AS VARCHAR)), '&region=', url_encode(region), '&limit=10') AS example
FROM ({flagship.FLAGSHIP_ORACLE}) t
ORDER BY order_date NULLS LAST, region NULLS LAST LIMIT 1
""",
)
def q_probe_example(spark, sf):
    views(spark, sf, "orders", "customer", "nation")
    df = spark.sql(flagship.FLAGSHIP_ORACLE)
    export = flagship.orders_product(sf).export("orders_daily@2")
    first = df.orderBy(*[F.col(g).asc_nulls_last() for g in export.grain]).limit(1)
    return first.select(profile.example_request(export))


PROBE_EXPORT = Export(name="orders_seen", version="1.0.0", grain=["O_ORDERSTATUS", "order_date", "o_orderkey"])
PROBE_SQL = f"SELECT o_orderstatus, order_date, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM ({ORDERS_BY_DATE}) t"


@register(
    "probe_export",
    f"""
WITH t AS ({PROBE_SQL})
SELECT 'O_ORDERSTATUS' AS "column", o_orderstatus AS value, true AS complete, CAST(NULL AS BIGINT) AS "rows", NULL AS least,
       NULL AS greatest, NULL AS example
FROM (SELECT DISTINCT o_orderstatus FROM t WHERE o_orderstatus IS NOT NULL) d
UNION ALL SELECT 'o_orderkey', NULL, false, NULL, NULL, NULL, NULL
UNION ALL
SELECT NULL, NULL, NULL, count(*), CAST(min(order_date) AS VARCHAR), CAST(max(order_date) AS VARCHAR),
       (SELECT concat('orders_seen@1?O_ORDERSTATUS=', o_orderstatus, '&order_date=', CAST(order_date AS VARCHAR), '&o_orderkey=', o_orderkey, '&limit=10')
        FROM t ORDER BY o_orderstatus NULLS LAST, order_date NULLS LAST, o_orderkey NULLS LAST LIMIT 1)
FROM t
""",
)
def q_probe_export(spark, sf):
    """H1 to H3 in one job: grouping sets over the grain columns, named in another case than the table's."""
    views(spark, sf, "orders")
    found = profile.probe_export(spark.sql(PROBE_SQL.replace("VARCHAR", "STRING")), PROBE_EXPORT)
    bound = F.element_at("coverage", 1)
    return found.select("column", "value", "complete", "rows", bound["least"].alias("least"), bound["greatest"].alias("greatest"), "example")


def _catalog_products(sf: str) -> list[Product]:
    down = Product(
        name="orders_monthly",
        sources={"daily": Source(name="daily", kind="product", product="orders", root="unused", table="orders_daily")},
        transforms=[Transform(name="orders_monthly", sql=CHAIN_SQL, path="sql/orders_monthly.sql")],
        exports=[Export(name="orders_monthly", version="1.2.0", grain=["region", "month"], contract="experimental",
                        schema={"region": ColumnSpec("string"), "month": ColumnSpec("date"),
                                "revenue": ColumnSpec("decimal", unit="USD")})],
    )
    return [flagship.orders_product(sf), down]


@register("catalog_columns")
def q_catalog_columns(spark, sf):
    store, res = flagship.build_orders(spark, sf)
    cat_df = cat.catalog(spark, _catalog_products(sf))
    rows = F.lit(store.tables(res.version)["orders_daily"].rows).cast("long")
    return cat_df.withColumn("published_rows", F.when(F.col("product") == "orders", rows))


@register("catalog_status")
def q_catalog_status(spark, sf):
    store, res = flagship.build_orders(spark, sf)
    prods = _catalog_products(sf)
    rows = [cat.status(spark, store.root, prods[0]), cat.status(spark, root_for(spark, "never_built"), prods[1])]
    return spark.createDataFrame([(r["product"], r["status"], r["grain_verified"], r["execution"]) for r in rows],
                                 "product string, status string, grain_verified boolean, execution long")


@register("run_history")
def q_run_history(spark, sf):
    store, _ = flagship.build_orders(spark, sf)
    return cat.run_history(spark, store.root).drop("started_at", "finished_at", "seconds")


@register(
    "source_history",
    f"""
SELECT CAST(1 AS BIGINT) AS execution, 'success' AS outcome, 'events' AS source, 'raw' AS kind, 'bootstrap' AS mode, count(*) AS "rows"
FROM events WHERE ts <= TIMESTAMP '{TS_SPLIT}'
UNION ALL
SELECT 2, 'success', 'events', 'raw', 'delta', count(*) FROM events
WHERE ts > (SELECT max(ts) FROM events WHERE ts <= TIMESTAMP '{TS_SPLIT}')
""",
)
def q_source_history(spark, sf):
    """H6: what each of two runs read from its source, from the run summaries."""
    ev = table(spark, sf, "events")
    root = root_for(spark, "events_sources")
    for uri in (derived_copy(ev.where(F.col("ts") <= F.lit(TS_SPLIT).cast("timestamp_ntz")), "events_first"), f"{sf}/events.parquet"):
        run(spark, _events_product(uri), root)
    return cat.source_history(spark, root).select("execution", "outcome", "source", "kind", "mode", "rows")


@register("upstreams")
def q_upstreams(spark, sf):
    up_store, _ = flagship.build_orders(spark, sf)
    down = _chain_product(up_store.root)
    res = run(spark, down, root_for(spark, "orders_monthly"))
    return cat.upstreams(spark, down, res.summary).select("source", "product", "pinned", "execution",
                                                          F.col("data_as_of").isNotNull().alias("has_data_as_of"))


@register(
    "freshness_age",
    """
WITH s AS (SELECT event_id,
                  CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS secs
           FROM events),
p AS (SELECT event_id, greatest(secs, 0) AS s FROM s)
SELECT event_id,
       CASE WHEN s // 86400 > 0 THEN concat(CAST(s // 86400 AS VARCHAR), 'd ', CAST((s % 86400) // 3600 AS VARCHAR), 'h')
            WHEN (s % 86400) // 3600 > 0 THEN concat(CAST((s % 86400) // 3600 AS VARCHAR), 'h ',
                                                     CAST((s % 3600) // 60 AS VARCHAR), 'm')
            WHEN (s % 3600) // 60 > 0 THEN concat(CAST((s % 3600) // 60 AS VARCHAR), 'm')
            ELSE 'just now' END AS age
FROM p
""",
)
def q_freshness_age(spark, sf):
    ev = table(spark, sf, "events")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return ev.select("event_id", profile.freshness_age(F.col("ts"), now).alias("age"))


@register("fleet_manifest")
def q_fleet_manifest(spark, sf):
    prefix = scratch_path(spark, "fleet")
    up_store, _ = flagship.build_orders(spark, sf, root=prefix + "/orders")
    cat.write_catalog(spark, up_store.root, flagship.orders_product(sf))
    down = _chain_product(up_store.root)
    run(spark, down, prefix + "/orders_monthly")
    cat.write_catalog(spark, prefix + "/orders_monthly", down)
    from tessera.plans import fs

    fs.write_text(spark, prefix + "/legacy/catalog.json", '{"format": 99, "product": "legacy"}')
    return cat.fleet(spark, prefix)


# =====================================================================  2.I closed read

PAGE_EXPORT = Export(name="orders_page", version="1.0.0", grain=["o_orderkey"])
FILTER_EXPORT = Export(name="orders_status", version="1.0.0", grain=["o_orderstatus", "o_orderkey"],
                       schema={"o_orderstatus": ColumnSpec("string"), "o_orderkey": ColumnSpec("bigint"),
                               "o_totalprice": ColumnSpec("double")})
ALL_ORDER_SQL = "SELECT nullif(c_mktsegment, 'BUILDING') AS segment, c_custkey, c_name FROM customer"
ALL_ORDER_EXPORT = Export(name="customers", version="1.0.0")
JSON_EXPORT = Export(name="events_page", version="1.0.0", grain=["event_id"])


@register("read_page", "SELECT * FROM orders ORDER BY o_orderkey NULLS LAST LIMIT 100 OFFSET 200")
def q_read_page(spark, sf):
    return reader.read_export(table(spark, sf, "orders"), PAGE_EXPORT, {"offset": "200"})


DEEP_EXPORT = Export(name="lines", grain=["l_orderkey", "l_linenumber"], schema={
    "l_orderkey": ColumnSpec("bigint"), "l_linenumber": ColumnSpec("int"), "l_quantity": ColumnSpec("double")})


@register(
    "read_deep_page",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey NULLS LAST, l_linenumber NULLS LAST LIMIT 1000 OFFSET 5000",
)
def q_read_deep_page(spark, sf):
    """I4 by rank: ranges are counted until at most 512 skipped rows are left to carry."""
    return reader.read_export(table(spark, sf, "lineitem"), DEEP_EXPORT, {"offset": "5000", "limit": "1000"}, carried=512)


@register(
    "read_filter",
    "SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' "
    "ORDER BY o_orderstatus NULLS LAST, o_orderkey NULLS LAST LIMIT 1000",
)
def q_read_filter(spark, sf):
    return reader.read_export(table(spark, sf, "orders"), FILTER_EXPORT, {"o_orderstatus": "F", "limit": "5000"})


@register("read_all_order", f"SELECT * FROM ({ALL_ORDER_SQL}) t ORDER BY ALL NULLS LAST LIMIT 100 OFFSET 50")
def q_read_all_order(spark, sf):
    views(spark, sf, "customer")
    return reader.read_export(spark.sql(ALL_ORDER_SQL), ALL_ORDER_EXPORT, {"offset": "50"})


@register(
    "read_json",
    """
SELECT to_json(struct_pack(event_id := event_id, ts := CAST(ts AS VARCHAR), user_id := user_id,
                           event_type := event_type, value := value, props := props)) AS j
FROM (SELECT * FROM events ORDER BY event_id LIMIT 100) t
""",
)
def q_read_json(spark, sf):
    return reader.read_json(table(spark, sf, "events"), JSON_EXPORT, {})


# =====================================================================  2.J composition

CHAIN_SQL = """
SELECT region,
       CAST(date_trunc('MONTH', order_date) AS DATE) AS month,
       CAST(SUM(revenue) AS DECIMAL(18,2)) AS revenue
FROM daily
GROUP BY region, CAST(date_trunc('MONTH', order_date) AS DATE)
"""


def _chain_product(up_root: str) -> Product:
    return Product(
        name="orders_monthly",
        sources={"daily": Source(name="daily", kind="product", product="orders", root=up_root, table="orders_daily")},
        transforms=[Transform(name="orders_monthly", sql=CHAIN_SQL, path="sql/orders_monthly.sql")],
        exports=[Export(name="orders_monthly", version="1.2.0", grain=["region", "month"],
                        schema={"region": ColumnSpec("string"), "month": ColumnSpec("date"),
                                "revenue": ColumnSpec("decimal")})],
    )


@register(
    "chain_products",
    f"""
SELECT region, CAST(date_trunc('month', order_date) AS DATE) AS month, CAST(SUM(revenue) AS DECIMAL(18,2)) AS revenue
FROM ({flagship.FLAGSHIP_ORACLE}) daily
GROUP BY 1, 2
""",
)
def q_chain_products(spark, sf):
    up_store, _ = flagship.build_orders(spark, sf)
    root = root_for(spark, "orders_monthly")
    res = run(spark, _chain_product(up_store.root), root)
    return Store(spark, root).read_table("orders_monthly", res.version)


ROLLUP_SQL = """
SELECT event_type, count(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total
FROM events_acc
GROUP BY event_type
"""


@register(
    "accumulate_rollup",
    ROLLUP_SQL.replace("FROM events_acc", "FROM events"),
)
def q_accumulate_rollup(spark, sf):
    ev = table(spark, sf, "events")
    first = derived_copy(ev.where(F.col("ts") < F.lit(TS_SPLIT).cast("timestamp_ntz")), "events_head")
    root = root_for(spark, "events_rollup")
    run(spark, _events_product(first, lookback="1d", rollup=True), root)
    res = run(spark, _events_product(f"{sf}/events.parquet", lookback="1d", rollup=True), root)
    return Store(spark, root).read_table("events_rollup", res.version)


STATUS_ROLLUP = Rollup(of="orders_acc", by={"status": "o_orderstatus", "priority": "o_orderpriority"}, measures={
    "n": ("count", "*"), "priced": ("count", "CAST(o_totalprice AS DECIMAL(18,2))"),
    "total": ("sum", "CAST(o_totalprice AS DECIMAL(18,2))"), "customers": ("sum", "o_custkey"), "with_customer": ("count", "o_custkey")})


@register(
    "rollup_changes",
    f"""
SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(o_totalprice) AS priced,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total,
       CAST(SUM(o_custkey) AS BIGINT) AS customers, count(o_custkey) AS with_customer
FROM (SELECT {ORDER_COLS} FROM orders WHERE o_orderdate < TIMESTAMP '{ORDERS_OVERLAP} 00:00:00' UNION ALL {ORD_D_SQL}) t
GROUP BY o_orderstatus, o_orderpriority
""",
)
def q_rollup_changes(spark, sf):
    """J2 from changes: the second run moves orders between groups and adds new ones; the table is not read again."""
    root = root_for(spark, "orders_rollup")
    for sql in (ORD_T_SQL, ORD_D_SQL):
        product = _orders_keyed(sf, sql, "upsert")
        product.transforms.append(Transform(name="by_status", rollup=STATUS_ROLLUP))
        res = run(spark, product, root)
    got = Store(spark, root).read_table("by_status", res.version)
    return got.withColumn("total", F.col("total").cast("decimal(18,2)"))


# =====================================================================  2.K SQL surface (pass-through parity)


def _sql(key: str, spark_sql: str, duck_sql: str | None = None, tables=()):
    def q(spark, sf):
        # As a transform of a run over bound sources: parsed as one SELECT, in a session of its own.
        own = isolated(spark)
        for name, source in raw_sources(sf, *tables).items():
            read_source(own, source)[0].createOrReplaceTempView(name)
        return evaluate(own, Transform(name=key, sql=spark_sql, path=f"sql/{key}.sql"))

    register(key, duck_sql if duck_sql is not None else spark_sql)(q)


_sql(
    "sql_filter",
    """SELECT l_orderkey, l_linenumber, l_quantity,
              CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS disc_band
       FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_returnflag IN ('R', 'A')
         AND l_quantity BETWEEN 10 AND 40 AND NOT (l_linestatus = 'F' AND l_tax > 0.07)""",
    tables=("lineitem",),
)

_sql(
    "sql_values",
    """SELECT o.o_orderkey, s.status_name, s.weight
       FROM orders o JOIN (VALUES ('F', 'fulfilled', 1), ('O', 'open', 2), ('P', 'partial', 3))
            AS s(code, status_name, weight) ON o.o_orderstatus = s.code""",
    tables=("orders",),
)

_sql(
    "sql_group",
    """SELECT l_returnflag, l_linestatus,
              CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS sum_qty,
              CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS sum_price,
              CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))))
                   AS DECIMAL(20,4)) AS sum_disc_price,
              count(*) AS count_order, count(DISTINCT l_orderkey) AS n_orders
       FROM lineitem
       GROUP BY l_returnflag, l_linestatus
       HAVING count(*) > 10""",
    tables=("lineitem",),
)

_sql("sql_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer", tables=("customer",))

_sql(
    "sql_window_frame",
    """SELECT o_orderkey, o_custkey,
              CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                   ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS running3,
              count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth,
              row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS price_rank
       FROM orders""",
    tables=("orders",),
)

_JOINS_SPARK = """
SELECT 'inner' AS kind, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
UNION ALL SELECT 'left', count(*) FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey
UNION ALL SELECT 'right', count(*) FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey
UNION ALL SELECT 'full', count(*) FROM supplier s FULL OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey
UNION ALL SELECT 'semi', count(*) FROM customer c LEFT SEMI JOIN orders o ON o.o_custkey = c.c_custkey
UNION ALL SELECT 'anti', count(*) FROM customer c LEFT ANTI JOIN orders o ON o.o_custkey = c.c_custkey
"""
_JOINS_DUCK = """
SELECT 'inner' AS kind, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
UNION ALL SELECT 'left', count(*) FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey
UNION ALL SELECT 'right', count(*) FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey
UNION ALL SELECT 'full', count(*) FROM supplier s FULL OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey
UNION ALL SELECT 'semi', count(*) FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
UNION ALL SELECT 'anti', count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
"""
_sql("sql_joins", _JOINS_SPARK, _JOINS_DUCK, tables=("orders", "customer", "supplier", "nation"))

_sql(
    "sql_setops",
    """SELECT 'except_all' AS op, k, count(*) AS n FROM
         (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) t GROUP BY k
       UNION ALL SELECT 'union_all', k, count(*) FROM
         (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) t GROUP BY k
       UNION ALL SELECT 'union', k, count(*) FROM
         (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) t GROUP BY k
       UNION ALL SELECT 'intersect', k, count(*) FROM
         (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) t GROUP BY k
       UNION ALL SELECT 'except', k, count(*) FROM
         (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier) t GROUP BY k""",
    tables=("customer", "supplier", "nation"),
)

_sql(
    "sql_topk",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5""",
    tables=("orders",),
)

_sql(
    "sql_date",
    """SELECT CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS month, count(*) AS n,
              min(o_orderdate + INTERVAL 36 HOURS) AS first_plus,
              max(unix_timestamp(o_orderdate)) AS max_epoch,
              max(to_timestamp_ntz('2001-02-03 04:05:06')) AS parsed
       FROM orders GROUP BY CAST(date_trunc('MONTH', o_orderdate) AS DATE)""",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n,
              min(o_orderdate + INTERVAL 36 HOURS) AS first_plus,
              max(CAST(epoch(o_orderdate) AS BIGINT)) AS max_epoch,
              max(CAST(strptime('2001-02-03 04:05:06', '%Y-%m-%d %H:%M:%S') AS TIMESTAMP)) AS parsed
       FROM orders GROUP BY 1""",
    tables=("orders",),
)

_sql(
    "sql_scalar",
    """SELECT c_custkey, concat_ws('-', c_name, c_mktsegment) AS label, greatest(c_acctbal, 0.0) AS bal_pos,
              coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CAST(c_nationkey AS BIGINT) AS nk,
              c_name LIKE 'Customer#00000001%' AS like_prefix,
              c_mktsegment LIKE 'AUTO!_%' ESCAPE '!' AS like_escape,
              upper(substr(c_mktsegment, 1, 3)) AS seg3, length(c_name) AS name_len,
              abs(c_nationkey - 12) AS dist
       FROM customer""",
    """SELECT c_custkey, concat_ws('-', c_name, c_mktsegment) AS label, greatest(c_acctbal, 0.0) AS bal_pos,
              coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CAST(c_nationkey AS BIGINT) AS nk,
              c_name LIKE 'Customer#00000001%' AS like_prefix,
              c_mktsegment LIKE 'AUTO!_%' ESCAPE '!' AS like_escape,
              upper(substr(c_mktsegment, 1, 3)) AS seg3, length(c_name) AS name_len,
              abs(c_nationkey - 12) AS dist
       FROM customer""",
    tables=("customer",),
)

_sql(
    "sql_rollup",
    """SELECT l_returnflag, l_linestatus, count(*) AS n,
              CAST(grouping(l_returnflag) AS INT) AS g_flag, CAST(grouping(l_linestatus) AS INT) AS g_status
       FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    tables=("lineitem",),
)

_sql(
    "sql_subquery",
    """WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000)
       SELECT c.c_custkey,
              (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders,
              c.c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey) AS above_avg
       FROM customer c
       WHERE EXISTS (SELECT 1 FROM big b WHERE b.o_custkey = c.c_custkey)
         AND c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 1, 2))""",
    tables=("orders", "customer", "nation"),
)

_sql(
    "sql_nested",
    """SELECT vec_id, label, size(embedding) AS dim, CAST(embedding[0] AS DOUBLE) AS first,
              CAST(element_at(embedding, -1) AS DOUBLE) AS last,
              named_struct('id', vec_id, 'label', label).label AS via_struct,
              map('k', label)['k'] AS via_map,
              size(filter(embedding, x -> x > 0)) AS n_positive
       FROM embeddings""",
    """SELECT vec_id, label, len(embedding) AS dim, CAST(embedding[1] AS DOUBLE) AS first,
              CAST(embedding[-1] AS DOUBLE) AS last,
              struct_pack(id := vec_id, label := label).label AS via_struct,
              map(['k'], [label])['k'] AS via_map,
              len(list_filter(embedding, lambda x: x > 0)) AS n_positive
       FROM embeddings""",
    tables=("embeddings",),
)


# =====================================================================  oracles of the metadata keys
# Row counts come from the raw tables; names, versions and statements are what the products above declare.


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


_DAILY = f"(SELECT count(*) FROM ({flagship.FLAGSHIP_ORACLE}) d)"
_BEFORE_V1 = flagship.flagship_oracle(f"o.o_orderdate < TIMESTAMP '{ORDERS_V1} 00:00:00'")
_DAILY_V1 = f"(SELECT count(*) FROM ({_BEFORE_V1}) d)"
_STAGED = "(SELECT count(*) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"
_GRAMMAR = "grain equality filters; limit 0..1000 (default 100); offset 0..1000000; ordered by grain"

ORACLE.update({
    "upstream_as_of": f"""
SELECT CAST(1 AS BIGINT) AS version, true AS has_data_as_of, {_DAILY_V1} AS "rows"
UNION ALL SELECT CAST(2 AS BIGINT), true, {_DAILY}""",
    "run_history": f"""
SELECT CAST(1 AS BIGINT) AS execution, 'orders' AS product, 'success' AS outcome, false AS full_refresh, t."table", 'replace' AS strategy,
       t.n AS rows_written, t.n AS "rows", CAST(0 AS BIGINT) AS buckets_touched, CAST(0 AS BIGINT) AS rows_rewritten, t.statement
FROM (SELECT 'stg_orders' AS "table", {_STAGED} AS n, {_text("REPLACE stg_orders AS (" + flagship.STG_ORDERS.format(where="").strip() + ")")} AS statement
      UNION ALL SELECT 'orders_daily', {_DAILY}, {_text("REPLACE orders_daily AS (" + flagship.ORDERS_DAILY.strip() + ")")}) t""",
    "upstreams": """
SELECT 'daily' AS source, 'orders' AS product, CAST(NULL AS BIGINT) AS pinned, CAST(1 AS BIGINT) AS execution, true AS has_data_as_of
WHERE EXISTS (SELECT 1 FROM orders)""",
    "orphan_files": """
SELECT 'orders_snap' AS table_name, CAST(1 AS BIGINT) AS n_dirs
FROM (SELECT count(*) AS n, count(DISTINCT o_custkey) AS k FROM orders) t WHERE n > k""",
    "catalog_status": """
SELECT 'orders' AS product, 'verified' AS status, count(*) = count(DISTINCT (order_date, region)) AS grain_verified, CAST(1 AS BIGINT) AS execution
FROM (""" + flagship.FLAGSHIP_ORACLE + """) d
UNION ALL SELECT 'orders_monthly', 'draft', false, CAST(NULL AS BIGINT)""",
    "catalog_columns": f"""
SELECT product, route, export, version, contract, "column", type, unit, CAST(NULL AS VARCHAR) AS description, grain, '{_GRAMMAR}' AS grammar, upstreams,
       CASE WHEN product = 'orders' THEN {_DAILY} END AS published_rows
FROM (VALUES ('orders', 'orders_daily@2', 'orders_daily', '2.1.0', 'supported', 'order_date', 'date', NULL, 'order_date,region', ''),
             ('orders', 'orders_daily@2', 'orders_daily', '2.1.0', 'supported', 'region', 'string', NULL, 'order_date,region', ''),
             ('orders', 'orders_daily@2', 'orders_daily', '2.1.0', 'supported', 'revenue', 'decimal', 'USD', 'order_date,region', ''),
             ('orders_monthly', 'orders_monthly@1', 'orders_monthly', '1.2.0', 'experimental', 'region', 'string', NULL, 'region,month', 'orders@latest'),
             ('orders_monthly', 'orders_monthly@1', 'orders_monthly', '1.2.0', 'experimental', 'month', 'date', NULL, 'region,month', 'orders@latest'),
             ('orders_monthly', 'orders_monthly@1', 'orders_monthly', '1.2.0', 'experimental', 'revenue', 'decimal', 'USD', 'region,month', 'orders@latest')
     ) AS c(product, route, export, version, contract, "column", type, unit, grain, upstreams)""",
    "fleet_manifest": """
SELECT * FROM (VALUES ('legacy', false, NULL, NULL, NULL, NULL), ('orders', true, 'orders_daily@2', '2.1.0', 'supported', 'order_date,region'),
                      ('orders_monthly', true, 'orders_monthly@1', '1.2.0', 'experimental', 'region,month')
              ) AS f(product, readable, route, version, contract, grain)
WHERE EXISTS (SELECT 1 FROM orders)""",
})
