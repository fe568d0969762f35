"""A8, A10, A11, B11, F3, H11 inside a run: what a warehouse says about its objects, and the reads that follow from it.

One metadata relation per (connection, dataset) covers every table of the
product there: its rows (``k`` T/C/D, object, two values) are staged once and
folded by ``classify_objects``; the driver keeps the objects the product names.
The kind picks the route (storage read or query job), the native cursor type
renders the watermark into a query job's text, the native types are what
declared types are checked against, and the descriptions are recorded for bound
exports. A connection that may not run query jobs is asked once: its objects
then count as tables, with a warning, and reading a view that way names the
missing permission.

``load(spark, format, options)`` opens a connector's reader; a test or a
stand-in server passes its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import ConfigError
from tessera.functions.env import expand_connection
from tessera.model import Source
from tessera.operators.delta import apply_lookback, mark_for, validate_lookback
from tessera.sources import jdbc
from tessera.sources.classify import classify_objects
from tessera.sources.staging import Staged, stage_parquet

Load = Callable[[SparkSession, str, dict], DataFrame]

# Native cursor types and the cursor kind each one has.
CURSOR_KINDS = {"TIMESTAMP": "timestamp", "DATETIME": "timestamp", "DATE": "date", "INT64": "integer"}
# Texts by which the warehouse names a wrong query, a missing job permission, a view read as a table.
QUERY_ERRORS = ("Syntax error", "Invalid query", "Unrecognized name", "Not found: Table", "Not found: Dataset", "Duplicate column")
JOB_DENIED = ("bigquery.jobs.create", "access denied")
NOT_DENIED = "Response too large"
NOT_A_TABLE = "non-table entities"


@dataclass(frozen=True)
class ObjectInfo:
    """One classified object; column names as the warehouse writes them."""

    kind: str
    object_type: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)

    def native(self, column: str) -> str | None:
        return next((t for c, t in self.columns.items() if c.lower() == column.lower()), None)


#: What an object counts as when its connection may not ask.
ASSUMED = ObjectInfo("table")


def connector(src: Source) -> str:
    return str((src.connection or {}).get("type") or "jdbc").lower()


def metadata_query(project: str, dataset: str, tables: list[str]) -> str:
    """T/C/D rows of the named objects in one job; nested field paths are no columns."""
    for part in (project, dataset, *tables):
        if "`" in part or "'" in part:
            raise ConfigError(f"object name {part!r}: quotes and backticks are not accepted")
    where = f"WHERE table_name IN ({', '.join(repr(t) for t in sorted(tables))})"
    view = f"`{project}.{dataset}`.INFORMATION_SCHEMA"
    return (
        f"SELECT 'T' AS k, table_name AS n, table_type AS v1, CAST(NULL AS STRING) AS v2 FROM {view}.TABLES {where} "
        f"UNION ALL SELECT 'C', table_name, column_name, data_type FROM {view}.COLUMNS {where} "
        f"UNION ALL SELECT 'D', table_name, column_name, description FROM {view}.COLUMN_FIELD_PATHS {where} "
        "AND field_path = column_name"
    )


def is_denied(error: Exception) -> bool:
    """The connection may not run jobs. An oversized result mentions permissions too and is something else."""
    text = str(error)
    return NOT_DENIED not in text and any(t in text.lower() for t in JOB_DENIED)


def is_query_error(error: Exception) -> bool:
    """The query itself is wrong: running it again cannot help. Anything else (network, quota) may pass."""
    if isinstance(error, (AnalysisException, ParseException)):
        return True
    text = str(error)
    return any(t in text for t in QUERY_ERRORS) or "SQLSyntaxErrorException" in text


class Warehouse:
    """The connections of one run: metadata asked once, queries analysed before any read, reads by route."""

    def __init__(self, spark: SparkSession, sources: dict[str, Source], load: Load | None = None):
        self.spark = spark
        self.load = load or jdbc.load
        self.warnings: list[str] = []
        self.staged: list[Staged] = []
        self._siblings: dict[tuple[str, str], set[str]] = {}
        self._known: dict[tuple[str, str], dict[str, ObjectInfo]] = {}
        self._denied: set[str] = set()
        self._opened: dict[str, DataFrame] = {}
        for src in sources.values():
            if self._has_metadata(src):
                dataset, name = jdbc.split_table_path("bigquery", src.table)
                self._siblings.setdefault((self._name(src), dataset), set()).add(name)

    @staticmethod
    def _has_metadata(src: Source) -> bool:
        return src.kind == "jdbc" and src.table is not None and connector(src) == "bigquery"

    @staticmethod
    def _name(src: Source) -> str:
        return src.connection_name or json.dumps(src.connection, sort_keys=True, default=str)

    # ------------------------------------------------------------ metadata

    def info(self, src: Source) -> ObjectInfo | None:
        """A10: the classified object of a table source; None where the connector has no metadata."""
        if not self._has_metadata(src):
            return None
        conn = src.connection
        if conn.get("object_kind"):  # named by hand
            return ObjectInfo(str(conn["object_kind"]))
        name, (dataset, table) = self._name(src), jdbc.split_table_path("bigquery", src.table)
        if name in self._denied:
            return ASSUMED
        if (name, dataset) not in self._known:
            try:
                self._known[name, dataset] = self._ask(conn, dataset, sorted(self._siblings.get((name, dataset), {table})))
            except Exception as e:
                if not is_denied(e):
                    raise
                self._denied.add(name)
                self.warnings.append(
                    f"source {src.name!r}: its connection may not run query jobs ({e}); its objects are read as tables. "
                    "Grant bigquery.jobs.create so that views are found and read by a query job"
                )
                return ASSUMED
        return self._known[name, dataset].get(table, ObjectInfo("missing"))

    def _ask(self, conn: dict, dataset: str, tables: list[str]) -> dict[str, ObjectInfo]:
        query = metadata_query(conn["project"], dataset, tables)
        rows = self.load(self.spark, "bigquery", jdbc.bigquery_options(conn, query=query))
        staged = stage_parquet(rows.select(*(F.col(c).cast("string").alias(c) for c in ("k", "n", "v1", "v2"))))
        self.staged.append(staged)
        found = classify_objects(staged.df).where(F.col("object").isin(tables)).collect()  # the tables this product names
        return {r.object: ObjectInfo(r.kind, r.object_type, dict(r.columns), dict(r.descriptions)) for r in found}

    def native_types(self, sources: list[Source]) -> tuple[dict[str, dict[str, str]], dict[str, str]]:
        """per source its native column types (lower-case names), and its connector."""
        types, connectors = {}, {}
        for src in sources:
            info = self.info(src)
            if info is not None and info.columns:
                types[src.name] = {c.lower(): t for c, t in info.columns.items()}
                connectors[src.name] = connector(src)
        return types, connectors

    def descriptions(self, sources: list[Source]) -> dict[str, dict[str, str]]:
        """Per source its described columns; sources without any do not occur."""
        known = {src.name: info.descriptions for src in sources if (info := self.info(src)) is not None}
        return {name: d for name, d in known.items() if d}

    # ------------------------------------------------------------ reads

    def preflight(self, sources: list[Source]) -> None:
        """Every query source is analysed by its server before the first row of any source is read.

        A query that is itself wrong refuses the run; any other failure only warns, and the read decides.
        """
        for src in sources:
            if src.kind != "jdbc" or src.query is None:
                continue
            try:
                self._opened[src.name] = self.open(src)
            except ConfigError:
                raise
            except Exception as e:
                if is_query_error(e):
                    raise ConfigError(f"source {src.name!r}: its query is not valid: {e}") from e
                self.warnings.append(f"source {src.name!r}: its query could not be analysed before the run ({e})")

    def start(self, src: Source, marks: list[dict], full_refresh: bool) -> tuple[str, object] | None:
        """(native cursor type, mark less lookback) to render into the text of a query-routed object; else None.

        None as well at bootstrap and in a full refresh: the text then carries no predicate.
        """
        info = self.info(src) if src.incremental is not None else None
        if info is None or info.kind != "query" or full_refresh:
            return None
        cursor = src.incremental.cursor
        native = info.native(cursor)
        if native is None:
            if not info.columns:  # kind named by hand: no types to render with
                return None
            raise ConfigError(f"source {src.name!r}: cursor column {cursor!r} not found; columns are {', '.join(info.columns)}")
        kind = CURSOR_KINDS.get(native.upper())
        if kind is None:
            raise ConfigError(
                f"source {src.name!r}: cursor {cursor!r} has type {native}; a query job's delta takes {', '.join(CURSOR_KINDS)}"
            )
        mark = apply_lookback(mark_for(marks, src.name, kind), kind, validate_lookback(kind, src.incremental.lookback, src.name))
        return None if mark is None else (native, mark)

    def open(self, src: Source, start: tuple[str, object] | None = None) -> DataFrame:
        """The source's rows; with ``start`` only those past its mark, filtered by the server."""
        if src.name in self._opened:
            return self._opened[src.name]
        conn, kind = src.connection or {}, connector(src)
        query = expand_connection(src.name, src.query, conn.get("project")) if src.query else None
        if kind != "bigquery" or query is not None:
            return jdbc.read_connection(self.spark, conn, table=src.table, query=query, partition=src.partition, load=self.load)
        info = self.info(src)
        if info.kind == "missing":
            raise ConfigError(f"source {src.name!r}: {src.table} is not among the objects of its dataset")
        cursor = {} if start is None else {"cursor": src.incremental.cursor, "cursor_type": start[0], "mark": start[1]}
        return self.load(self.spark, "bigquery", jdbc.bigquery_read_options(conn, src.table, info.kind, **cursor))

    def named(self, src: Source, error: Exception) -> Exception:
        """A read's failure with its cause, where the warehouse's own text hides it."""
        if NOT_A_TABLE in str(error):
            return ConfigError(
                f"source {src.name!r}: {src.table} is a view or another object that cannot be read as a table. Views are read "
                "by a query job, which needs bigquery.jobs.create on the connection's project; grant it or name a table"
            )
        return error

    def cleanup(self) -> None:
        for s in self.staged:
            s.cleanup()
        self.staged.clear()
