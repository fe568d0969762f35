"""Catalog rows, status, run history, upstream lineage, digests, fleet manifest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.model import Product
from tessera.plans import fs
from tessera.plans.store import Store

# Catalog document format version, and the closed read grammar it advertises.
CATALOG_FORMAT = 1
READ_GRAMMAR = "grain equality filters; limit 0..1000 (default 100); offset 0..1000000; ordered by grain"

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("product", T.StringType()),
        T.StructField("route", T.StringType()),
        T.StructField("export", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("contract", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("grain", T.StringType()),
        T.StructField("grammar", T.StringType()),
        T.StructField("upstreams", T.StringType()),
    ]
)


def catalog_doc(product: Product) -> dict:
    ups = sorted({(s.product, s.version) for s in product.sources.values() if s.kind == "product"},
                 key=lambda x: (x[0], -1 if x[1] is None else x[1]))
    exports = []
    for e in sorted(product.exports, key=lambda e: e.route):
        if e.visibility == "private":
            continue
        exports.append({
            "route": e.route, "name": e.name, "version": e.version, "contract": e.contract,
            "description": e.description, "grain": list(e.grain), "freshness": e.freshness,
            "columns": [{"name": c, "type": s.type, "unit": s.unit, "description": s.description}
                        for c, s in e.schema.items()],
        })
    return {
        "format": CATALOG_FORMAT, "product": product.name, "description": product.description,
        "grammar": READ_GRAMMAR, "exports": exports,
        "upstreams": [{"product": p, "version": v} for p, v in ups],
    }


def catalog(spark: SparkSession, products: list[Product]) -> DataFrame:
    """H4: one row per (product, discoverable export, column), sorted by route."""
    rows = []
    for p in products:
        doc = catalog_doc(p)
        ups = ",".join(f"{u['product']}@{u['version'] if u['version'] is not None else 'latest'}" for u in doc["upstreams"])
        for e in doc["exports"]:
            for c in e["columns"] or [{"name": None, "type": None, "unit": None, "description": None}]:
                rows.append((p.name, e["route"], e["name"], e["version"], e["contract"], c["name"], c["type"],
                             c["unit"], c["description"], ",".join(e["grain"]), READ_GRAMMAR, ups))
    return spark.createDataFrame(rows, CATALOG_SCHEMA).orderBy("route", "product")


def interface_digest(product: Product) -> str:
    """H9: SHA-256 of the discoverable interface in a fixed order (environment-independent)."""
    doc = catalog_doc(product)
    return hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_catalog(spark: SparkSession, root: str, product: Product) -> str:
    path = fs.join(root, "catalog.json")
    fs.write_text(spark, path, json.dumps(catalog_doc(product)), overwrite=True)
    return path


def status(spark: SparkSession, root: str, product: Product, source_checked: bool = False) -> dict:
    """H5: verified (a run summary exists) > verified_at_source > draft; grain_verified needs grains everywhere."""
    store = Store(spark, root)
    latest = store.latest()
    has_run = latest is not None and fs.exists(spark, store.path("history", f"{latest}.json"))
    state = "verified" if has_run else ("verified_at_source" if source_checked else "draft")
    grain_ok = state != "draft" and all(e.grain for e in product.exports)
    return {"product": product.name, "status": state, "grain_verified": grain_ok, "execution": latest}


_TRANSFORM_RUN = "table string, strategy string, rows_written long, rows long, buckets_touched long, rows_rewritten long, seconds double, statement string"
_SOURCE_RUN = (
    "name string, kind string, mode string, route string, rows long, bytes long, estimated_bytes long, staged boolean, "
    "pushed_mark string, product string, version long, data_as_of string"
)
_RUN = ["execution", "product", "started_at", "finished_at", "outcome", "full_refresh"]


def _summaries(spark: SparkSession, root: str) -> DataFrame:
    """One row per run summary, failed runs included (their execution is NULL)."""
    schema = (
        "execution long, product string, started_at string, finished_at string, outcome string, full_refresh boolean, "
        f"transforms array<struct<{_typed(_TRANSFORM_RUN)}>>, sources array<struct<{_typed(_SOURCE_RUN)}>>"
    )
    return spark.read.schema(schema).option("multiLine", "true").json(Store(spark, root).path("history", "*.json"))


def _typed(fields: str) -> str:
    return ", ".join(":".join(f.split()) for f in fields.split(", "))


def run_history(spark: SparkSession, root: str) -> DataFrame:
    """H6: one row per (execution, transform) from the run summaries, read by Spark."""
    runs = _summaries(spark, root).select(*_RUN, F.explode_outer("transforms").alias("t"))
    return runs.select(*_RUN, "t.*")


def source_history(spark: SparkSession, root: str) -> DataFrame:
    """H6: one row per (execution, source): its kind, how it was read, and the rows and bytes that came.

    ``rows`` and ``bytes`` are counted where a source was staged or its delta measured, else NULL; ``estimated_bytes`` is
    the plan's estimate before the read. An upstream product's version and data time stand beside them.
    """
    runs = _summaries(spark, root).select(*_RUN, F.explode("sources").alias("s"))
    parts = [f.split()[0] for f in _SOURCE_RUN.split(", ")]
    renamed = {"name": "source", "product": "upstream"}
    return runs.select(*_RUN, *(F.col(f"s.{c}").alias(renamed.get(c, c)) for c in parts))


def upstreams(spark: SparkSession, product: Product, summary: dict | None) -> DataFrame:
    """H7: declared upstream refs (deduplicated, sorted) left-joined by source name to what the run read."""
    refs = sorted({(s.name, s.product, s.version) for s in product.sources.values() if s.kind == "product"},
                  key=lambda r: (r[1], -1 if r[2] is None else r[2], r[0]))
    decl = spark.createDataFrame(refs, "source string, product string, pinned long")
    seen = [(s.get("name"), s.get("version"), s.get("data_as_of")) for s in (summary or {}).get("sources", [])
            if s.get("kind") == "product"]
    obs = spark.createDataFrame(seen, "source string, execution long, data_as_of string")
    return decl.join(obs, "source", "left").orderBy("product", "pinned", "source")


def fleet(spark: SparkSession, prefix: str) -> DataFrame:
    """One row per (product, export) over every catalog under ``prefix``; unknown formats give the name only."""
    schema = T.StructType([
        T.StructField("format", T.LongType()), T.StructField("product", T.StringType()),
        T.StructField("exports", T.ArrayType(T.StructType([
            T.StructField("route", T.StringType()), T.StructField("version", T.StringType()),
            T.StructField("contract", T.StringType()), T.StructField("grain", T.ArrayType(T.StringType()))]))),
    ])
    docs = spark.read.schema(schema).option("multiLine", "true").json(fs.join(prefix, "*", "catalog.json"))
    known = F.coalesce(F.col("format") == F.lit(CATALOG_FORMAT), F.lit(False))
    # An unreadable document still names its product: the folder it sits in.
    name = F.coalesce(F.col("product"), F.regexp_extract(F.input_file_name(), r"([^/]+)/catalog\.json$", 1))
    exploded = docs.select(
        name.alias("product"), known.alias("readable"),
        F.explode_outer(F.when(known, F.col("exports"))).alias("e"),
    )
    return exploded.select(
        "product", "readable", F.col("e.route").alias("route"), F.col("e.version").alias("version"),
        F.col("e.contract").alias("contract"), F.array_join("e.grain", ",").alias("grain"),
    ).orderBy("product", "route")


def source_check_record(product: Product, verifications) -> dict:
    """what was verified, against which interface and profile."""
    return {
        "product": product.name,
        "profile": product.profile,
        "config_digest": interface_digest(product),
        "ok": all(v.ok for v in verifications),
        "grain": [v.grain for v in verifications if v.grain],
        "failures": [f for v in verifications for f in v.failures],
    }


def write_source_check(spark: SparkSession, root: str, product: Product, verifications) -> dict:
    rec = source_check_record(product, verifications)
    fs.write_text(spark, fs.join(root, "source_check.json"), json.dumps(rec), overwrite=True)
    return rec


def _fresh(spark: SparkSession, path: str, product: Product) -> dict | None:
    """A record written for this interface under this profile, else None."""
    if not fs.exists(spark, path):
        return None
    rec = json.loads(fs.read_text(spark, path))
    return rec if rec.get("config_digest") == interface_digest(product) and rec.get("profile") == product.profile else None


def source_check_fresh(spark: SparkSession, root: str, product: Product) -> bool:
    """Fresh only when both the interface digest and the profile match the recorded check."""
    return bool((_fresh(spark, fs.join(root, "source_check.json"), product) or {}).get("ok"))


def write_source_descriptions(spark: SparkSession, root: str, product: Product, described: dict[str, dict[str, str]]) -> None:
    """What the warehouse says about the columns of bound sources; nothing is written when it says nothing."""
    if described:
        rec = {"product": product.name, "profile": product.profile, "config_digest": interface_digest(product), "sources": described}
        fs.write_text(spark, fs.join(root, "source_descriptions.json"), json.dumps(rec), overwrite=True)


def source_descriptions(spark: SparkSession, root: str, product: Product) -> dict[str, dict[str, str]]:
    """Source -> column -> description, while the record is fresh for this interface and profile."""
    return (_fresh(spark, fs.join(root, "source_descriptions.json"), product) or {}).get("sources", {})
