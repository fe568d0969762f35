import pytest
from pyspark.sql import functions as F

from tessera.errors import ReadError
from tessera.model import ColumnSpec, Export
from tessera.operators import profile, reader

E = Export(name="o", grain=["o_orderstatus", "o_orderkey"],
           schema={"o_orderstatus": ColumnSpec("string"), "o_orderkey": ColumnSpec("bigint")})


def test_param_validation():
    with pytest.raises(ReadError, match="unknown parameter 'o_custkey'"):
        reader.validate_params(E, {"o_custkey": "1"})
    with pytest.raises(ReadError, match="limit must be an integer"):
        reader.validate_params(E, {"limit": "ten"})
    with pytest.raises(ReadError, match="offset must be an integer"):
        reader.validate_params(E, {"offset": "-1"})
    with pytest.raises(ReadError, match="maximum"):
        reader.validate_params(E, {"offset": "1000001"})
    p = reader.validate_params(E, {"limit": "5000", "o_orderkey": "3", "o_orderstatus": "F"})
    assert p.limit == 1000 and p.filters == [("o_orderstatus", "F"), ("o_orderkey", "3")]
    assert reader.validate_params(E, {}).limit == 100 and reader.validate_params(E, {"limit": "0"}).limit == 0


def test_filter_literal_cast_and_pushdown(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    page = reader.read_export(df, E, {"o_orderkey": "7"})
    assert [r.o_orderkey for r in page.collect()] == [7]
    assert "EqualTo(o_orderkey,7)" in page._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception):
        reader.read_export(df, E, {"o_orderkey": "x"}).collect()


def test_nulls_last_paging(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "g string, v int")
    e = Export(name="n")
    assert [r.g for r in reader.read_export(df, e, {}).collect()] == ["a", "b", None]


def test_json_keeps_nulls_and_renders_timestamps(spark):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, TIMESTAMP_NTZ '2024-01-01 00:00:00.25' AS t")
    j = reader.to_json_rows(df).first().j
    assert j == '{"a":1,"b":null,"t":"2024-01-01 00:00:00.25"}'


def test_probes(spark, sf):
    cust = spark.read.parquet(f"{sf}/customer.parquet")
    seg = profile.probe_values(cust, "c_mktsegment").collect()
    assert all(r.complete for r in seg) and [r.value for r in seg] == sorted(r.value for r in seg)
    names = profile.probe_values(cust, "c_name").collect()
    assert [tuple(r) for r in names] == [(None, False)]  # more values than the cap: none is listed
    e = Export(name="x", grain=["g", "h"])
    df = spark.createDataFrame([("a b", "x/y"), ("c", None)], "g string, h string")
    assert profile.probe_example(df, e) == f"{e.route}?g=a%20b&h=x%2Fy&limit=10"
    assert profile.probe_example(spark.createDataFrame([(None, "q")], "g string, h string"), e) is None
    assert df.orderBy("g").select(profile.example_column(["g", "h"])).first().example == "g=a%20b&h=x%2Fy"


def test_format_age(spark):
    rows = [(0,), (59,), (61,), (3 * 3600 + 120,), (86400 + 3 * 3600,), (-5,)]
    df = spark.createDataFrame(rows, "s long")
    got = [r.a for r in df.select(profile.format_age(F.col("s")).alias("a")).collect()]
    assert got == ["just now", "just now", "1m", "3h 2m", "1d 3h", "just now"]


def test_grainless_page_with_map_column(spark):
    df = spark.sql("SELECT id, map('k', id) AS m FROM range(5)")
    rows = reader.read_export(df, Export(name="maps"), {"limit": "2", "offset": "1"}).collect()
    assert [r.id for r in rows] == [1, 2]


def test_keyset_pages_follow_the_offset_pages(spark):
    rows = [(a, b) for a in ("x", "y", None) for b in (3, 1, None, 2)]
    df = spark.createDataFrame(rows, "g string, h int")
    e = Export(name="t", grain=["g", "h"])
    whole = [tuple(r) for r in reader.read_export(df, e).collect()]
    pages, last = [], None
    while True:
        page = reader.read_after(df, e, last, 5) if last else reader.read_export(df, e, {"limit": "5"})
        got = [tuple(r) for r in page.collect()]
        if not got:
            break
        pages += got
        last = {"g": got[-1][0], "h": None if got[-1][1] is None else str(got[-1][1])}
    assert pages == whole
    with pytest.raises(ReadError, match="each grain column"):
        reader.read_after(df, e, {"g": "x"})


@pytest.mark.parametrize("carried", [3, 40])
def test_deep_pages_by_rank(spark, carried):
    rows = [(a, None if b % 11 == 0 else b % 97) for a in ("x", "y", None, "z") for b in range(250)]
    df = spark.createDataFrame(rows, "g string, h int").repartition(4)
    for e in (Export(name="t", grain=["G", "H"]), Export(name="t")):
        whole = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or 0))
        for offset in (0, 41, 500, 777, 995, 1000, 5000):
            got = [tuple(r) for r in reader.read_export(df, e, {"offset": str(offset), "limit": "30"}, carried=carried).collect()]
            assert got == whole[offset : offset + 30], (e, offset)


def test_deep_pages_of_every_key_type(spark):
    df = spark.sql(
        "SELECT CAST(date_add(DATE '2024-01-01', CAST(id % 50 AS INT)) AS DATE) AS d, timestamp_micros(id * 1234567) AS t, "
        "CAST(id % 13 AS DECIMAL(9,2)) AS m, CAST(id AS DOUBLE) / 7 AS f, id FROM range(2000)"
    )
    for grain in (["d", "id"], ["t"], ["m", "t"], ["f"]):
        order = [F.col(c).asc_nulls_last() for c in grain]
        want = [r.id for r in df.orderBy(*order).offset(1200).limit(20).collect()]
        page = reader.read_export(df, Export(name="t", grain=grain), {"offset": "1200", "limit": "20"}, carried=50)
        assert [r.id for r in page.collect()] == want


def test_a_page_amid_equal_rows(spark):
    df = spark.createDataFrame([("a",)] * 300 + [("b",)] * 5 + [(None,)] * 400, "g string")
    e, read = Export(name="t"), reader.read_export
    assert [r.g for r in read(df, e, {"offset": "298", "limit": "10"}, carried=7).collect()] == ["a"] * 2 + ["b"] * 5 + [None] * 3
    assert [r.g for r in read(df, e, {"offset": "700", "limit": "10"}, carried=7).collect()] == [None] * 5


def test_the_deepest_page_carries_few_rows(spark):
    df = spark.range(1_100_000).select((F.col("id") * 7919 % 1_100_000).alias("k"))
    page = reader.read_export(df, Export(name="t", grain=["k"]), {"offset": "1000000", "limit": "5"})
    assert [r.k for r in page.collect()] == [1_000_000 + i for i in range(5)]
    import re

    plan = page._jdf.queryExecution().optimizedPlan().toString()
    kept = [int(n.replace(",", "")) for n in re.findall(r"(?:GlobalLimit|LocalLimit|Offset) (\d+)", plan)]
    assert kept and max(kept) <= reader.CARRIED + reader.MAX_LIMIT


def test_probes_in_one_pass(spark):
    rows = [("a b", "2024-01-02", f"u{i % 60}") for i in range(200)] + [(None, "2024-01-01", "u1"), ("c", None, None)]
    df = spark.createDataFrame(rows, "G string, d string, u string").withColumn("d", F.to_date("d"))
    e = Export(name="x", grain=["g", "D", "u"])  # other case than the table
    got = profile.probe_document(df, e)
    assert got["coverage"] == {"rows": 202, "min_D": "2024-01-01", "max_D": "2024-01-02"}
    assert got["values"] == {"g": {"values": ["a b", "c"], "complete": True}, "u": {"values": None, "complete": False}}
    assert got["example"] == f"{e.route}?g=a%20b&D=2024-01-02&u=u0&limit=10"
    assert profile.probe_coverage(df, e).first().rows == 202
    empty = profile.probe_document(df.limit(0), e)
    assert empty == {"coverage": {"rows": 0, "min_D": None, "max_D": None}, "example": None,
                     "values": {"g": {"values": [], "complete": True}, "u": {"values": [], "complete": True}}}
    assert profile.probe_document(df, Export(name="x")) == {"coverage": {"rows": 202}, "values": {}, "example": None}
