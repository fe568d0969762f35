"""The declared interface checked against actual output.

Schema checks need no job. The grain check is one two-level aggregate per
export: ``groupBy(grain).count()`` then ``sum``/``count`` of those groups,
which counts NULL grain values as values (``count(DISTINCT a, b)`` would drop
tuples holding a NULL and undercount).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import VerifyError
from tessera.model import Export
from tessera.declared_types import native_type_ok, native_type_ok_col, type_ok, type_ok_col

# Fixed value: the name recorded for the grain measurement.
GRAIN_CHECK = "grain_unique"


@dataclass
class Verification:
    route: str
    failures: list[str] = field(default_factory=list)
    grain: dict | None = None

    @property
    def ok(self) -> bool:
        return not self.failures


def _lookup(df: DataFrame, name: str):
    for f in df.schema.fields:
        if f.name.lower() == name.lower():
            return f
    return None


def check_schema(export: Export, df: DataFrame, native: dict[str, str] | None = None, connector: str | None = None) -> list[str]:
    """declared columns exist with a compatible type; grain columns exist."""
    fails = []
    for col, spec in export.schema.items():
        f = _lookup(df, col)
        if f is None:
            fails.append(f"{export.route}: declared column {col!r} is missing")
            continue
        nat = (native or {}).get(col.lower())
        ok = native_type_ok(connector, spec.type, nat) if (nat and connector) else None
        if ok is None:
            ok = type_ok(spec.type, f.dataType)
            actual = f.dataType.simpleString()
        else:
            actual = nat
        if not ok:
            fails.append(f"{export.route}: column {col!r} is declared {spec.type} but is {actual}")
    for g in export.grain:
        if _lookup(df, g) is None:
            fails.append(f"{export.route}: grain column {g!r} is missing")
    return fails


def grain_counts(df: DataFrame, grain: list[str]) -> DataFrame:
    """one row (rows, distinct_grain); NULLs count as grain values."""
    groups = df.groupBy(*grain).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("rows"),
        F.count(F.lit(1)).cast("long").alias("distinct_grain"),
    )


def verify_export(
    export: Export, df: DataFrame, native: dict[str, str] | None = None, connector: str | None = None,
    incremental: bool = False,
) -> Verification:
    """F1-F6 for one export. ``df`` is the whole export: its grain is counted, never inferred."""
    v = Verification(route=export.route, failures=check_schema(export, df, native, connector))
    if export.grain and not v.failures:
        r = grain_counts(df, export.grain).first()
        rows, distinct = int(r["rows"]), int(r["distinct_grain"])
        v.grain = {"check": GRAIN_CHECK, "route": export.route, "grain": list(export.grain), "rows": rows,
                   "distinct_grain": distinct}
        if rows != distinct:
            # With incremental sources the usual cause is a transform re-inserting a re-delivered delta.
            hint = (
                "; if this table consumes an incremental source, its transform is likely not replay-safe "
                "(land it with upsert or append on a key)" if incremental else ""
            )
            v.failures.append(
                f"{export.route}: grain {export.grain} is not unique: {rows} rows but {distinct} distinct grain "
                f"values{hint}"
            )
    return v


def verify_all(
    exports: list[Export], frames: dict[str, DataFrame], raise_on_failure: bool = True, incremental: bool = False,
    native: dict[str, dict[str, str]] | None = None, connectors: dict[str, str] | None = None,
) -> list[Verification]:
    """``native``: warehouse column types per bound source (lower-case names); ``connectors``: its connection type."""
    native, connectors = native or {}, connectors or {}

    def one(e: Export) -> Verification:
        df = frames[e.route] if e.route in frames else frames[e.bind or e.table]
        return verify_export(e, df, native.get(e.bind or ""), connectors.get(e.bind or ""), incremental=incremental)

    # Exports are independent jobs: submit them together so small ones share the cluster.
    if len(exports) > 1:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(max_workers=min(8, len(exports))) as pool:
            out = list(pool.map(one, exports))
    else:
        out = [one(e) for e in exports]
    fails = [f for v in out for f in v.failures]
    if fails and raise_on_failure:
        raise VerifyError("verification failed:\n  " + "\n  ".join(fails))
    return out


def schema_report(spark: SparkSession, exports: list[Export], frames: dict[str, DataFrame]) -> DataFrame:
    """F1/F2/F4 as rows: (route, column, role, declared, actual, ok), checked by one Column expression."""
    rows = []
    for e in exports:
        df = frames[e.bind or e.table]
        for col, spec in e.schema.items():
            f = _lookup(df, col)
            rows.append((e.route, col, "column", spec.type, f.dataType.simpleString() if f else None))
        for g in e.grain:
            f = _lookup(df, g)
            rows.append((e.route, g, "grain", None, f.dataType.simpleString() if f else None))
    rep = spark.createDataFrame(rows, "route string, column string, role string, declared string, actual string")
    ok = F.when(F.col("actual").isNull(), F.lit(False)).when(
        F.col("role") == "grain", F.lit(True)
    ).otherwise(type_ok_col(F.col("declared"), F.col("actual")))
    return rep.withColumn("ok", ok)


def native_type_report(
    declared: DataFrame, native: DataFrame, on: list[str] | None = None, connector: str = "bigquery"
) -> DataFrame:
    """declared (on..., declared, actual) left-joined to native (on..., native_type); the native rule wins.

    Column names match case-insensitively. Where no native type is known the
    local (Spark type) rule applies.
    """
    on = on or ["column"]
    d = declared.select("*", *[F.lower(F.col(c)).alias(f"__k{i}") for i, c in enumerate(on)])
    n = native.select(*[F.lower(F.col(c)).alias(f"__k{i}") for i, c in enumerate(on)], "native_type")
    keys = [f"__k{i}" for i in range(len(on))]
    j = d.join(n, keys, "left")
    ok = F.when(
        F.col("native_type").isNotNull(), native_type_ok_col(connector, F.col("declared"), F.col("native_type"))
    ).otherwise(type_ok_col(F.col("declared"), F.col("actual")))
    return j.drop(*keys).withColumn("ok", ok)
