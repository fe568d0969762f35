"""Product definitions: sources, transforms, exports, and every resolve-time check.

A product can be built in Python or loaded from YAML::

    product: orders
    sources:
      raw_orders: data/orders/*.parquet          # raw file(s)
      customers: {product: customers, table: dim_customers, version: 3}
      crm: {connection: crm, table: sales.accounts, incremental: {cursor: updated_at, lookback: 2h}}
    transforms:
      - sql/stg_orders.sql                       # bare path = replace
      - {sql: sql/fct_orders.sql, materialize: upsert, key: [order_id]}
      - {name: orders_by_day, rollup: {of: fct_orders, by: [order_date], measures: {n: {count: "*"}, top: {max: amount}}}}
    interface:
      - {name: orders_daily, version: 2.1.0, grain: [order_date, region],
         schema: {order_date: date, region: string, revenue: decimal}}

Checks done here need no data: names, strategies and keys, the replace-over-
delta gate, grain inheritance, bound exports, descriptions and prose caps.
Everything that needs a schema or rows runs later, as Spark jobs.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from typing import Any

import yaml

from tessera.errors import ConfigError
from tessera.functions.duration import parse_duration
from tessera.functions.env import expand

# The reserved table-name prefix for engine-owned tables, the closed
# strategy set, contract and visibility values, and the prose limits.
RESERVED_PREFIX = "__tessera_"
STRATEGIES = ("append", "upsert", "replace")
CONTRACTS = ("supported", "experimental")
VISIBILITIES = ("discoverable", "private")
MAX_PRODUCT_DESCRIPTION = 200
MAX_EXPORT_DESCRIPTION = 500
MAX_COLUMN_DESCRIPTION = 500
MAX_UNIT = 16

_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_SEMVER = re.compile(r"(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?")


@dataclass
class Incremental:
    cursor: str
    lookback: str | None = None

    def lookback_delta(self):
        return parse_duration(self.lookback) if self.lookback is not None else None


@dataclass
class Source:
    """A named input, bound as a temp view before the transforms run.

    kind ``raw``: ``uri`` (+ ``format``/``options``); ``product``: ``root`` of an
    upstream product store, ``table`` and optional ``version``; ``jdbc``:
    ``connection`` dict (url, driver, user, ...) plus exactly one of ``table``
    and ``query``.
    """

    name: str
    kind: str = "raw"
    uri: str | None = None
    format: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    schema: Any = None
    root: str | None = None
    product: str | None = None
    table: str | None = None
    version: int | None = None
    connection: dict[str, Any] | None = None
    connection_name: str | None = None
    query: str | None = None
    partition: dict[str, Any] | None = None  # a partitioned JDBC table read: column, partitions; lower and upper for equal strides
    incremental: Incremental | None = None
    columns: dict[str, str] = field(default_factory=dict)  # column descriptions (documented sources)

    def __post_init__(self):
        if self.kind not in ("raw", "product", "jdbc"):
            raise ConfigError(f"source {self.name!r}: unknown kind {self.kind!r}")
        if self.kind == "jdbc" and (self.table is None) == (self.query is None):
            raise ConfigError(f"source {self.name!r}: give exactly one of `table` and `query`")
        if self.partition is not None:
            if self.kind != "jdbc" or self.table is None:
                raise ConfigError(f"source {self.name!r}: `partition` needs a connection and a `table`")
            bounded = any(self.partition.get(k) is not None for k in ("lower", "upper"))  # neither: ranges are counted first
            lacking = [k for k in ("column", *(("lower", "upper") if bounded else ())) if self.partition.get(k) is None]
            if lacking:
                raise ConfigError(f"source {self.name!r}: `partition` lacks {', '.join(lacking)}")
        if self.kind == "jdbc" and self.query is not None and self.incremental is not None:
            raise ConfigError(
                f"source {self.name!r}: a `query` source is re-read in full every run; "
                "`incremental` is not allowed with it"
            )
        if self.kind == "product" and self.incremental is not None:
            raise ConfigError(f"source {self.name!r}: an upstream product table cannot be incremental")
        if self.kind == "raw" and not self.uri:
            raise ConfigError(f"source {self.name!r}: a raw source needs a uri")
        if self.incremental is not None and self.incremental.lookback is not None:
            parse_duration(self.incremental.lookback)


@dataclass
class Rollup:
    """A grouped aggregate of the keyed table ``of``, declared by parts so that a run can keep it up to date from changes.

    ``by`` names the group columns (a list of columns, or names with expressions over one row); ``measures`` gives
    each column its aggregate and the expression it aggregates (``"*"`` counts rows).
    """

    of: str
    by: list[str] | dict[str, str]
    measures: dict[str, tuple[str, str]]

    def __post_init__(self):
        if not isinstance(self.by, dict):
            self.by = {c: f"`{c}`" for c in self.by}
        if not self.by or not self.measures:
            raise ConfigError(f"a rollup of {self.of!r} needs group columns (`by`) and `measures`")
        names = [c.lower() for c in [*self.by, *self.measures]]
        if len(set(names)) < len(names):
            raise ConfigError(f"a rollup of {self.of!r} names a column twice")

    @property
    def sql(self) -> str:
        groups = ", ".join(f"{e} AS `{c}`" for c, e in self.by.items())
        measures = ", ".join(f"{fn}({e}) AS `{c}`" for c, (fn, e) in self.measures.items())
        return f"SELECT {groups}, {measures} FROM {self.of} GROUP BY {', '.join(self.by.values())}"


@dataclass
class Transform:
    """One SELECT whose result lands in the table ``name`` with a strategy.

    With ``rollup`` in place of ``sql`` the SELECT is the rollup's; the table is a ``replace`` table all the same.
    """

    name: str
    sql: str = ""
    strategy: str = "replace"
    key: list[str] = field(default_factory=list)
    path: str | None = None
    buckets: int | None = None
    rollup: Rollup | None = None

    def __post_init__(self):
        if self.rollup is not None:
            if self.sql or self.strategy != "replace":
                raise ConfigError(f"transform {self.label!r}: a rollup has neither `sql` nor a strategy of its own")
            self.sql = self.rollup.sql

    @property
    def label(self) -> str:
        return self.path or self.name


@dataclass
class ColumnSpec:
    type: str
    unit: str | None = None
    description: str | None = None


@dataclass
class Export:
    name: str
    version: str = "1.0.0"
    source: str | None = None
    bind: str | None = None
    grain: list[str] = field(default_factory=list)
    schema: dict[str, ColumnSpec] = field(default_factory=dict)
    description: str | None = None
    freshness: str | None = None
    visibility: str = "discoverable"
    contract: str = "experimental"
    grain_inherited: bool = False

    @property
    def table(self) -> str:
        return self.source or self.name

    @property
    def major(self) -> int:
        return int(self.version.split(".")[0])

    @property
    def route(self) -> str:
        return f"{self.name}@{self.major}"


@dataclass
class Product:
    name: str
    sources: dict[str, Source] = field(default_factory=dict)
    transforms: list[Transform] = field(default_factory=list)
    exports: list[Export] = field(default_factory=list)
    description: str | None = None
    directory: str = "."
    warnings: list[str] = field(default_factory=list)
    profile: str = "default"  # the environment it was loaded for: a check under one attests no other

    def __post_init__(self):
        self.resolve()

    # ------------------------------------------------------------ resolve checks

    def resolve(self) -> None:
        _check_prose(self)
        _check_transforms(self)
        _check_replace_gate(self)
        _check_sources_vs_tables(self)
        _check_exports(self)
        _inherit_grains(self)
        _check_descriptions(self)
        self.warnings.extend(no_grain_warnings(self))

    def incremental_sources(self) -> list[Source]:
        return [s for s in self.sources.values() if s.incremental is not None]

    def transform(self, name: str) -> Transform:
        for t in self.transforms:
            if t.name == name:
                return t
        raise KeyError(name)

    def export(self, name_or_route: str) -> Export:
        for e in self.exports:
            if name_or_route in (e.name, e.route):
                return e
        raise KeyError(name_or_route)


# ------------------------------------------------------------------ checks


def table_name_for(path: str) -> str:
    """Table name = file stem; it must be an identifier and not use the reserved prefix."""
    stem = os.path.splitext(os.path.basename(path))[0]
    if not _IDENT.fullmatch(stem):
        raise ConfigError(f"transform {path!r}: table name {stem!r} is not an identifier; rename the file")
    return stem


def _check_transforms(p: Product) -> None:
    if not p.transforms:
        raise ConfigError(f"product {p.name!r} has no transforms; there is nothing to run")
    seen: dict[str, str] = {}
    for t in p.transforms:
        if t.strategy == "never":
            raise ConfigError(f"transform {t.label!r}: `never` is not a strategy; use append, upsert or replace")
        if t.strategy not in STRATEGIES:
            raise ConfigError(f"transform {t.label!r}: unknown strategy {t.strategy!r}; use one of {STRATEGIES}")
        if t.strategy == "replace" and t.key:
            raise ConfigError(f"transform {t.label!r}: `key` is not allowed with replace (nothing to reconcile)")
        if t.strategy in ("append", "upsert") and not t.key:
            raise ConfigError(f"transform {t.label!r}: {t.strategy} needs a `key`")
        if not _IDENT.fullmatch(t.name):
            raise ConfigError(f"transform {t.label!r}: table name {t.name!r} is not an identifier")
        check_reserved([t.name])
        # Spark resolves names without regard to case, so tables that differ only in case are one.
        if t.name.lower() in seen:
            raise ConfigError(
                f"transforms {seen[t.name.lower()]!r} and {t.label!r} both build table {t.name!r}; rename one file"
            )
        if t.rollup is not None:
            earlier = {e.name.lower(): e for e in p.transforms[: p.transforms.index(t)]}
            base = earlier.get(t.rollup.of.lower())
            if base is None or base.strategy == "replace":
                raise ConfigError(
                    f"transform {t.label!r}: a rollup reads a table that an earlier transform appends or upserts; "
                    f"{t.rollup.of!r} is none"
                )
            t.rollup.of = base.name
        seen[t.name.lower()] = t.label


def check_reserved(names) -> None:
    """Output tables may not use the engine's reserved prefix."""
    for n in names:
        if n.lower().startswith(RESERVED_PREFIX):
            raise ConfigError(f"table {n!r} uses the reserved prefix {RESERVED_PREFIX!r}")


def mentions(text: str, name: str) -> bool:
    """Whole-word, case-sensitive mention of ``name`` (comments count)."""
    return re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", text) is not None


def _check_replace_gate(p: Product) -> None:
    """C4: a replace transform over an incremental source would drop history every run."""
    inc = [s.name for s in p.incremental_sources()]
    for t in p.transforms:
        if t.strategy != "replace":
            continue
        for name in inc:
            # Without regard to case: Spark would resolve EV to the delta view ev all the same.
            if mentions(t.sql.lower(), name.lower()):
                raise ConfigError(
                    f"transform {t.label!r} rebuilds with replace but reads incremental source {name!r}; "
                    "a delta is not the whole table. Land it with append or upsert and roll up from that table"
                )


def _check_sources_vs_tables(p: Product) -> None:
    for t in p.transforms:
        if t.name.lower() in {name.lower() for name in p.sources}:
            raise ConfigError(f"table {t.name!r} has the name of a source; the source view would shadow it")


def _check_exports(p: Product) -> None:
    seen = set()
    for e in p.exports:
        if not _SEMVER.fullmatch(e.version):
            raise ConfigError(f"export {e.name!r}: version {e.version!r} is not semver (MAJOR.MINOR.PATCH)")
        if e.route in seen:
            raise ConfigError(f"export route {e.route!r} is declared twice")
        seen.add(e.route)
        if e.contract not in CONTRACTS:
            raise ConfigError(f"export {e.name!r}: contract must be one of {CONTRACTS}")
        if e.visibility not in VISIBILITIES:
            raise ConfigError(f"export {e.name!r}: visibility must be one of {VISIBILITIES}")
        if e.bind is not None:
            if e.source is not None:
                raise ConfigError(f"export {e.name!r}: `bind` and `source` are exclusive")
            src = p.sources.get(e.bind)
            if src is None:
                raise ConfigError(f"export {e.name!r}: bound source {e.bind!r} is not declared")
            if src.kind == "product":
                raise ConfigError(f"export {e.name!r}: an upstream product table cannot be bound")
            if src.kind == "jdbc" and src.query is not None:
                raise ConfigError(f"export {e.name!r}: a `query` source cannot be bound")
        else:
            tables = {t.name for t in p.transforms}
            if e.table not in tables:
                raise ConfigError(f"export {e.name!r}: no transform builds table {e.table!r}")


def _inherit_grains(p: Product) -> None:
    """keyed tables give their key as grain; an explicit grain must contain it."""
    for e in p.exports:
        if e.bind is not None:
            continue
        t = next((t for t in p.transforms if t.name == e.table), None)
        if t is None or t.strategy == "replace":
            continue
        if not e.grain:
            e.grain = list(t.key)
            e.grain_inherited = True
        else:
            missing = [k for k in t.key if k.lower() not in {g.lower() for g in e.grain}]
            if missing:
                raise ConfigError(
                    f"export {e.name!r}: grain {e.grain} must contain the {t.strategy} key {t.key} "
                    f"(missing {missing})"
                )


def _check_descriptions(p: Product) -> None:
    """F8: a supported export needs a description, or a bound source with documented columns."""
    for e in p.exports:
        if e.contract != "supported" or e.description:
            continue
        if e.bind is not None and p.sources[e.bind].columns:
            continue
        raise ConfigError(f"export {e.name!r} is supported but has no description")


def _check_prose(p: Product) -> None:
    """caps on descriptions and units."""
    if p.description is not None:
        if len(p.description) > MAX_PRODUCT_DESCRIPTION or "\n" in p.description.strip():
            raise ConfigError(
                f"product description must be one line of at most {MAX_PRODUCT_DESCRIPTION} characters"
            )
    for e in p.exports:
        if e.description is not None and len(e.description) > MAX_EXPORT_DESCRIPTION:
            raise ConfigError(f"export {e.name!r}: description longer than {MAX_EXPORT_DESCRIPTION} characters")
        for c, spec in e.schema.items():
            if spec.description is not None and len(spec.description) > MAX_COLUMN_DESCRIPTION:
                raise ConfigError(f"export {e.name!r} column {c!r}: description too long")
            if spec.unit is not None and (len(spec.unit) > MAX_UNIT or re.search(r"\s", spec.unit)):
                raise ConfigError(
                    f"export {e.name!r} column {c!r}: unit must be at most {MAX_UNIT} characters, no spaces"
                )


def no_grain_warnings(p: Product) -> list[str]:
    """E5: an incremental source with no export carrying a grain leaves duplicates unseen."""
    if p.incremental_sources() and not any(e.grain for e in p.exports):
        return ["incremental sources are read but no export declares a grain; re-delivered rows go unchecked"]
    return []


# ------------------------------------------------------------------ YAML


def _column_spec(v: Any) -> ColumnSpec:
    if isinstance(v, str):
        return ColumnSpec(type=v)
    if isinstance(v, dict):
        unknown = set(v) - {"type", "unit", "description"}
        if unknown:
            raise ConfigError(f"column spec has unknown fields {sorted(unknown)}")
        return ColumnSpec(type=v["type"], unit=v.get("unit"), description=v.get("description"))
    raise ConfigError(f"column spec must be a type name or a mapping, got {v!r}")


_EXPORT_FIELDS = {
    "name", "version", "source", "bind", "grain", "schema", "description",
    "freshness", "visibility", "contract",
}


def _export(d: dict) -> Export:
    unknown = set(d) - _EXPORT_FIELDS
    if unknown:
        raise ConfigError(f"export {d.get('name')!r}: unknown fields {sorted(unknown)}")
    return Export(
        name=d["name"],
        version=str(d.get("version", "1.0.0")),
        source=d.get("source"),
        bind=d.get("bind"),
        grain=list(d.get("grain") or []),
        schema={k: _column_spec(v) for k, v in (d.get("schema") or {}).items()},
        description=d.get("description"),
        freshness=d.get("freshness"),
        visibility=d.get("visibility", "discoverable"),
        contract=d.get("contract", "experimental"),
    )


def resolve_uri(uri: str, directory: str) -> str:
    """A2: remote URIs untouched, ``file://`` stripped, relative paths under the product dir."""
    if uri.startswith("file://"):
        return uri[len("file://") :]
    if "://" in uri or os.path.isabs(uri):
        return uri
    return os.path.normpath(os.path.join(directory, uri))


def _source(name: str, v: Any, directory: str, profile: dict) -> Source:
    if isinstance(v, str):
        return Source(name=name, kind="raw", uri=resolve_uri(expand(v), directory))
    if not isinstance(v, dict):
        raise ConfigError(f"source {name!r}: expected a path or a mapping")
    inc = v.get("incremental")
    incremental = Incremental(cursor=inc["cursor"], lookback=inc.get("lookback")) if inc else None
    if "connection" in v:
        conn_name = v["connection"]
        conns = profile.get("connections", {})
        if conn_name not in conns:
            raise ConfigError(f"source {name!r}: connection {conn_name!r} is not in the profile")
        conn = {k: expand(str(x)) for k, x in conns[conn_name].items()}
        return Source(
            name=name, kind="jdbc", connection=conn, connection_name=conn_name,
            table=v.get("table"), query=v.get("query"), partition=v.get("partition"), incremental=incremental,
            columns=dict(v.get("columns") or {}),
        )
    if "product" in v or "cell" in v:
        up = v.get("product", v.get("cell"))
        roots = profile.get("products", {})
        root = v.get("root") or roots.get(up)
        if root is None:
            raise ConfigError(f"source {name!r}: no store root known for upstream product {up!r}")
        return Source(
            name=name, kind="product", product=up, root=resolve_uri(expand(root), directory),
            table=v["table"], version=v.get("version"),
        )
    return Source(
        name=name, kind="raw", uri=resolve_uri(expand(v["uri"]), directory), format=v.get("format"),
        options=dict(v.get("options") or {}), incremental=incremental, columns=dict(v.get("columns") or {}),
        schema=v.get("schema"),  # DDL string, e.g. "id BIGINT, ts TIMESTAMP": no inference pass over the files
    )


def _rollup(name: str, d: dict) -> Rollup:
    if set(d) != {"of", "by", "measures"}:
        raise ConfigError(f"transform {name!r}: a rollup takes `of`, `by` and `measures`")
    measures = {}
    for column, m in d["measures"].items():
        if not isinstance(m, dict) or len(m) != 1:
            raise ConfigError(f"transform {name!r}: measure {column!r} must be one aggregate with its expression")
        measures[column] = next((fn, str(e)) for fn, e in m.items())
    return Rollup(of=d["of"], by=d["by"], measures=measures)


def _transform(entry: Any, directory: str) -> Transform:
    if isinstance(entry, dict) and "rollup" in entry:
        return Transform(name=entry["name"], rollup=_rollup(entry["name"], entry["rollup"]), buckets=entry.get("buckets"))
    if isinstance(entry, str):
        path, strategy, key, buckets = entry, "replace", [], None
    elif isinstance(entry, dict):
        path = entry["sql"]
        strategy = entry.get("materialize", "replace")
        key = list(entry.get("key") or [])
        buckets = entry.get("buckets")
    else:
        raise ConfigError(f"transform entry {entry!r} must be a path or a mapping")
    full = resolve_uri(path, directory)
    with open(full, encoding="utf-8") as fh:
        sql = fh.read()
    return Transform(name=table_name_for(path), sql=sql, strategy=strategy, key=key, path=path, buckets=buckets)


def load_profile(path: str) -> dict:
    """An environment profile (YAML): ``connections`` by name, ``products`` (upstream name -> store root),
    ``storage`` (this product's store root), ``name`` (the file's stem if absent). Values may use ``${VAR}`` / ``${VAR:-default}``."""
    with open(path, encoding="utf-8") as fh:
        doc = yaml.safe_load(fh) or {}
    directory = os.path.dirname(os.path.abspath(path))
    out: dict = {"connections": {}, "products": {}}
    out["name"] = str(doc.get("name") or os.path.splitext(os.path.basename(path))[0])
    for name, conn in (doc.get("connections") or {}).items():
        out["connections"][name] = {k: expand(str(v)) for k, v in (conn or {}).items()}
    for name, root in (doc.get("products") or {}).items():
        out["products"][name] = resolve_uri(expand(str(root)), directory)
    if doc.get("storage") is not None:
        out["storage"] = resolve_uri(expand(str(doc["storage"])), directory)
    return out


def load_product(path: str, profile: dict | str | None = None) -> Product:
    """Load a product from YAML; ``profile`` (a dict or a profile file) supplies connections and upstream roots."""
    with open(path, encoding="utf-8") as fh:
        doc = yaml.safe_load(fh) or {}
    directory = os.path.dirname(os.path.abspath(path))
    profile = load_profile(profile) if isinstance(profile, str) else (profile or {})
    name = doc.get("product", doc.get("cell"))
    if not name:
        raise ConfigError(f"{path}: missing `product` name")
    sources = {n: _source(n, v, directory, profile) for n, v in (doc.get("sources") or {}).items()}
    transforms = [_transform(t, directory) for t in (doc.get("transforms") or [])]
    exports = [_export(e) for e in (doc.get("interface") or [])]
    return Product(
        name=name, sources=sources, transforms=transforms, exports=exports,
        description=doc.get("description"), directory=directory, profile=profile.get("name", "default"),
    )
