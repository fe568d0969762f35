from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.declared_types import declared_for, native_type_ok, type_ok, type_ok_col

DECLARED = ["string", "varchar", "text", "int", "integer", "bigint", "long", "decimal", "numeric", "double",
            "float", "bool", "boolean", "date", "timestamp", "binary", "array<int>", "short"]
ACTUAL = ["string", "varchar(10)", "int", "bigint", "decimal(18,2)", "double", "float", "boolean", "date",
          "timestamp", "timestamp_ntz", "binary", "array<int>", "smallint", "struct<a:int>"]


def test_type_rules():
    assert type_ok("int", T.IntegerType()) and not type_ok("int", T.LongType())
    assert type_ok("bigint", T.LongType()) and not type_ok("bigint", T.IntegerType())
    assert type_ok("decimal", T.DecimalType(38, 4)) and type_ok("timestamp", T.TimestampNTZType())
    assert type_ok("TEXT", T.StringType()) and type_ok("array<int>", T.ArrayType(T.IntegerType()))
    assert declared_for(T.TimestampNTZType()) == "timestamp" and declared_for(T.BinaryType()) is None
    assert native_type_ok("bigquery", "int", "INT64") and native_type_ok("bigquery", "bigint", "INT64")
    assert native_type_ok("bigquery", "timestamp", "DATETIME") and not native_type_ok("bigquery", "date", "DATETIME")
    assert native_type_ok("postgres", "int", "integer") is None


def test_column_form_agrees_with_python_form(spark):
    rows = [(d, a) for d in DECLARED for a in ACTUAL]
    df = spark.createDataFrame(rows, "declared string, actual string")
    got = {(r.declared, r.actual): r.ok for r in df.withColumn("ok", type_ok_col(F.col("declared"), F.col("actual"))).collect()}
    for d, a in rows:
        assert got[(d, a)] == type_ok(d, a), (d, a)


@settings(max_examples=50, deadline=None)
@given(st.sampled_from(DECLARED), st.sampled_from(ACTUAL))
def test_reverse_name_roundtrip(d, a):
    name = declared_for(a)
    if name is not None:
        assert type_ok(name, a)
