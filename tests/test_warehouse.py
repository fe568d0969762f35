"""Warehouse sources in a run, against a stand-in server that answers metadata and query texts over given tables."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigError, VerifyError
from tessera.model import ColumnSpec, Export, Incremental, Product, Source, Transform
from tessera.plans import catalog
from tessera.plans.run import run, verify_published
from tessera.plans.store import Store
from tessera.sources.warehouse import Warehouse, is_denied, is_query_error, metadata_query

CONN = {"type": "bigquery", "project": "acme"}


class Server:
    """Objects by ``dataset.name``: (object type, frame, native types, descriptions). Keeps what was asked."""

    def __init__(self, objects, denied=False):
        self.objects, self.denied = objects, denied
        self.metadata, self.queries, self.tables = [], [], []

    def __call__(self, spark, fmt, options):
        assert fmt == "bigquery"
        query = options.get("query")
        if query and "INFORMATION_SCHEMA" in query:
            self.metadata.append(query)
            if self.denied:
                raise RuntimeError("Access Denied: Permission bigquery.jobs.create")
            dataset = re.search(r"`acme\.(\w+)`", query)[1]
            rows = []
            for name in re.search(r"IN \(([^)]*)\)", query)[1].replace("'", "").split(", "):
                kind, _, types, about = self.objects.get(f"{dataset}.{name}", (None, None, {}, {}))
                rows += [("T", name, kind, None)] if kind else []
                rows += [("C", name, c, t) for c, t in types.items()] + [("D", name, c, d) for c, d in about.items()]
            return spark.createDataFrame(rows, "k string, n string, v1 string, v2 string")
        if query:
            self.queries.append(query)
            for name, (_, df, _, _) in self.objects.items():
                if f"`acme.{name}`" in query:
                    view = name.replace(".", "__")
                    df.createOrReplaceTempView(view)
                    query = query.replace(f"`acme.{name}`", view).replace("DATETIME '", "TIMESTAMP_NTZ '")
                    return df.sparkSession.sql(query)
            raise RuntimeError("Not found: Table acme:nowhere")
        self.tables.append((options["table"], options.get("filter")))
        kind, df, _, _ = self.objects[options["table"].removeprefix("acme.")]
        if kind == "VIEW":
            raise RuntimeError("request failed: non-table entities cannot be read with the storage API")
        return df.where(F.expr(options["filter"].replace("DATETIME '", "TIMESTAMP_NTZ '"))) if options.get("filter") else df


def source(name, table=None, **kw):
    return Source(name=name, kind="jdbc", connection=CONN, connection_name="bq", table=table, **kw)


@pytest.fixture
def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "value")


TYPES = {"event_id": "INT64", "ts": "DATETIME", "value": "FLOAT64"}


def events_product(lookback=None):
    return Product(
        name="p", sources={"ev": source("ev", "sales.ev_v", incremental=Incremental("ts", lookback=lookback))},
        transforms=[Transform(name="acc", sql="SELECT event_id, ts, value FROM ev", strategy="upsert", key=["event_id"], path="sql/acc.sql")],
    )


def test_one_metadata_read_routes_every_object(spark, sf, root):
    nation, region = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("nation", "region"))
    server = Server({"d.nation": ("BASE TABLE", nation, {}, {}), "d.nation_v": ("VIEW", nation, {}, {}), "d.region": ("EXTERNAL", region, {}, {}),
                     "e.region": ("SNAPSHOT", region, {}, {})})
    tables = {"a": "d.nation", "b": "d.nation_v", "c": "d.region", "x": "e.region"}
    product = Product(
        name="p", sources={n: source(n, t) for n, t in tables.items()},
        transforms=[Transform(name=f"t_{n}", sql=f"SELECT count(*) AS n FROM {n}") for n in tables],
    )
    res = run(spark, product, root, load=server)
    assert len(server.metadata) == 2  # one per dataset
    assert [t for t, _ in server.tables] == ["acme.d.nation", "acme.e.region"]
    assert server.queries == ["SELECT * FROM `acme.d.nation_v`", "SELECT * FROM `acme.d.region`"]
    assert [s["route"] for s in res.summary["sources"]] == ["table", "query", "query", "table"]
    assert {n: st.rows for n, st in res.tables.items()} == {f"t_{n}": 1 for n in tables}


def test_a_views_delta_carries_the_mark(spark, root, events):
    cut = sorted(r.ts for r in events.select("ts").collect())[events.count() // 2]
    first, later = events.where(F.col("ts") <= F.lit(cut)), events.withColumn("value", F.col("value") + 1)
    p = events_product(lookback="2h")
    server = Server({"sales.ev_v": ("VIEW", first, TYPES, {})})
    run(spark, p, root, load=server)
    assert server.queries == ["SELECT * FROM `acme.sales.ev_v`"]
    server = Server({"sales.ev_v": ("VIEW", later, TYPES, {})})
    res = run(spark, p, root, load=server)
    start = first.agg(F.max("ts") - F.expr("INTERVAL 2 HOURS")).first()[0]
    assert len(server.queries) == 1 and f" WHERE `ts` > DATETIME '{start:%Y-%m-%d %H:%M:%S}" in server.queries[0]
    assert res.summary["sources"][0]["pushed_mark"] == str(start)
    # The same delta over a file source: rows past the mark less lookback come anew.
    want = events.withColumn("value", F.when(F.col("ts") > F.lit(start), F.col("value") + 1).otherwise(F.col("value")))
    got = Store(spark, root).read_table("acc").select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    server = Server({"sales.ev_v": ("VIEW", later, TYPES, {})})
    run(spark, p, root, full_refresh=True, load=server)
    assert server.queries == ["SELECT * FROM `acme.sales.ev_v`"]


def test_a_tables_delta_and_cursors_that_cannot_be_rendered(spark, root, events):
    p = events_product()
    run(spark, p, root, load=Server({"sales.ev_v": ("BASE TABLE", events, TYPES, {})}))
    server = Server({"sales.ev_v": ("BASE TABLE", events, TYPES, {})})
    res = run(spark, p, root, load=server)
    assert server.queries == [] and res.summary["sources"][0]["rows"] == 0  # Spark pushes the filter to a storage read
    for types, words in (({**TYPES, "ts": "STRING"}, "has type STRING"), ({"event_id": "INT64"}, "not found")):
        with pytest.raises(ConfigError, match=words):
            run(spark, p, root, load=Server({"sales.ev_v": ("VIEW", events, types, {})}))
    for kind, words in ((None, "not among the objects"), ("MODEL", "unsupported")):
        with pytest.raises(ConfigError, match=words):
            run(spark, p, root, load=Server({"sales.ev_v": (kind, events, TYPES, {})}))


def test_a_denied_connection_is_asked_once(spark, sf, root):
    region = spark.read.parquet(f"{sf}/region.parquet")
    server = Server({"d.r": ("BASE TABLE", region, {}, {}), "e.r": ("BASE TABLE", region, {}, {}), "e.v": ("VIEW", region, {}, {})}, denied=True)
    tf = [Transform(name="t", sql="SELECT count(*) AS n FROM a")]
    res = run(spark, Product(name="p", sources={"a": source("a", "d.r"), "b": source("b", "e.r")}, transforms=tf), root, load=server)
    assert len(server.metadata) == 1 and [w for w in res.warnings if "bigquery.jobs.create" in w]
    with pytest.raises(Exception, match="non-table entities|bigquery.jobs.create"):
        run(spark, Product(name="p", sources={"a": source("a", "e.v")}, transforms=tf), root, load=server)
    assert is_denied(RuntimeError("Access Denied: x")) and not is_denied(RuntimeError("Permission Denied: Response too large to return"))


def bound_product(declared, profile="dev"):
    return Product(
        name="p", sources={"raw": source("raw", "sales.m")}, transforms=[Transform(name="n", sql="SELECT count(*) AS n FROM raw")],
        exports=[Export(name="m", bind="raw", grain=["id"], schema={"id": ColumnSpec("bigint"), "amount": ColumnSpec(declared)})], profile=profile,
    )


def test_native_types_decide_and_descriptions_are_recorded(spark, root):
    """A NUMERIC that arrives as text passes as decimal; the same column without native types does not."""
    df = spark.createDataFrame([(1, "1.50"), (2, "2.50")], "id bigint, amount string")
    about = {"amount": "What was paid", "id": "  "}
    server = Server({"sales.m": ("BASE TABLE", df, {"ID": "INT64", "amount": "NUMERIC"}, about)})
    p = bound_product("decimal")
    run(spark, p, root, load=server)
    assert all(v.ok for v in verify_published(spark, p, root, load=server))
    assert catalog.source_descriptions(spark, root, p) == {"raw": {"amount": "What was paid"}}
    assert catalog.source_check_fresh(spark, root, p)
    other = bound_product("decimal", profile="prod")  # a check under one profile attests no other
    assert not catalog.source_check_fresh(spark, root, other) and catalog.source_descriptions(spark, root, other) == {}
    before = Store(spark, root).latest()
    with pytest.raises(VerifyError, match="declared int but is NUMERIC"):
        run(spark, bound_product("int"), root, load=server)
    assert Store(spark, root).latest() == before  # a wrong native type refuses the commit
    with pytest.raises(VerifyError, match="declared decimal but is string"):
        run(spark, p, root, load=Server({"sales.m": ("BASE TABLE", df, {}, {})}))


def test_queries_are_analysed_before_any_read(spark, sf, root):
    reads = []

    def load(spark_, fmt, options):
        if "broken" in options["query"]:
            raise RuntimeError(options["query"])
        df = spark.range(3).mapInPandas(lambda it: it, "id bigint")
        reads.append(options["query"])
        return df

    q = lambda n, text: source(n, query=text)
    tf = [Transform(name="t", sql="SELECT count(*) AS n FROM good")]
    staged = Store(spark, root)
    for text in ("Syntax error: broken", "Unrecognized name: broken"):
        with pytest.raises(ConfigError, match="its query is not valid"):
            run(spark, Product(name="p", sources={"good": q("good", "SELECT 1"), "bad": q("bad", text)}, transforms=tf), root, load=load)
    assert staged.latest() is None
    assert is_query_error(RuntimeError("Not found: Table x")) and not is_query_error(RuntimeError("Connection reset by peer"))
    # Anything else only warns before the run; the read itself then decides.
    calls = []

    def flaky(spark_, fmt, options):
        calls.append(options["query"])
        if len(calls) == 1:
            raise RuntimeError("Service Unavailable")
        return spark.range(2)

    res = run(spark, Product(name="p", sources={"good": q("good", "SELECT 2")}, transforms=tf), root, load=flaky)
    assert len(calls) == 2 and [w for w in res.warnings if "could not be analysed" in w] and res.tables["t"].rows == 1


def test_metadata_query_text():
    text = metadata_query("acme", "sales", ["b", "a"])
    assert text.count("IN ('a', 'b')") == 3 and "field_path = column_name" in text
    with pytest.raises(ConfigError):
        metadata_query("acme", "sales", ["a'b"])
    house = Warehouse(None, {"a": source("a", "d.t"), "b": source("b", "d.u"), "q": source("q", query="SELECT 1")})
    assert house._siblings == {("bq", "d"): {"t", "u"}}
