"""One run of a product, from sources to a committed, verified snapshot.

    bind sources (incremental ones staged once, past their watermark)
    -> transforms in order, each landing with its strategy and re-registered
       as a view so later transforms read it
    -> watermarks merged -> shrink warnings -> verification -> optional replay
    -> one manifest commit (tables + watermarks together) -> run history

Verification runs on the written but uncommitted directories, so a failed
contract never moves LATEST. Directories of a failed run are unreferenced and
removed later by the orphan sweep.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import ConfigError, TesseraError
from tessera.model import Product, Source, Transform
from tessera.operators import checks
from tessera.operators.delta import (
    Advance,
    assert_unique_watermarks,
    mark_for,
    marks_to_json,
    pinned_delta,
    stage_delta,
    upsert_watermarks,
    validate_cursor,
    watermarks_df,
)
from tessera.operators.rollup import land_rollup
from tessera.operators.strategy import Changes, append_by_key, compact, land_keyed, land_replace, upsert_by_key
from tessera.operators.verify import Verification, verify_all
from tessera.plans.store import Store, TableState, iso, utc_now
from tessera.sources.product import data_as_of
from tessera.sources.raw import read_raw
from tessera.sources.staging import Staged, size_estimate, stage_parquet
from tessera.sources.warehouse import Load, Warehouse


@dataclass
class RunResult:
    version: int | None
    tables: dict[str, TableState]
    watermarks: list[dict]
    verifications: list[Verification] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    summary: dict = field(default_factory=dict)


def select_text(sql: str) -> str:
    """The transform wrapped as a subquery; DDL, DML or a trailing ``;`` fail to parse."""
    return f"SELECT * FROM (\n{sql}\n) AS __tessera_q"


def evaluate(spark: SparkSession, t: Transform) -> DataFrame:
    try:
        return spark.sql(select_text(t.sql))
    except Exception as e:
        hint = ""
        body = t.sql.strip()
        if body.endswith(";"):
            hint = " (remove the trailing ';': a transform is one SELECT)"
        elif not body.lower().lstrip("(").startswith(("select", "with", "values", "from", "--", "/*")):
            hint = " (a transform is one SELECT; no DDL or DML)"
        raise ConfigError(f"transform {t.label!r} is not a valid SELECT{hint}: {e}") from e


def statement_for(t: Transform) -> str:
    """The landing a transform stands for, recorded in the manifest."""
    if t.strategy == "replace":
        return f"REPLACE {t.name} AS ({t.sql.strip()})"
    verb = "UPSERT INTO" if t.strategy == "upsert" else "APPEND TO"
    return f"{verb} {t.name} KEY ({', '.join(t.key)}) FROM ({t.sql.strip()})"


def read_source(
    spark: SparkSession, src: Source, house: Warehouse | None = None, start: tuple[str, object] | None = None
) -> tuple[DataFrame, dict]:
    info: dict = {"name": src.name, "kind": src.kind}
    if src.kind == "raw":
        df = read_raw(spark, src.uri, src.format, src.options, src.schema)
    elif src.kind == "product":
        store = Store(spark, src.root)
        v = store.latest() if src.version is None else src.version
        df = store.read_table(src.table, v)
        info.update(product=src.product, table=src.table, version=v)
        as_of = data_as_of(spark, src.root, v)
        info["data_as_of"] = iso(as_of) if as_of else None
    else:
        house = house or Warehouse(spark, {src.name: src})
        df = house.open(src, start)
        described = house.info(src)
        info.update(route="query" if src.query or (described and described.kind == "query") else "table")
    return df, info


def isolated(spark: SparkSession) -> SparkSession:
    """A session of its own for one run: its views never meet the caller's, its settings are the caller's.

    A run binds sources and tables as temp views; in the caller's session that would replace and then drop views of
    the same names, and two runs at once would read each other's.
    """
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if (k.startswith("spark.sql.") or k == "spark.checkpoint.dir") and own.conf.get(k, None) != v and spark.conf.isModifiable(k):
            own.conf.set(k, v)
    return own


def run(
    spark: SparkSession,
    product: Product,
    root: str,
    full_refresh: bool = False,
    replay_check: bool = False,
    verify: bool = True,
    commit: bool = True,
    load: Load | None = None,
) -> RunResult:
    """One run. ``load`` opens a warehouse connector's reader in place of Spark's own."""
    spark = isolated(spark)
    store = Store(spark, root)
    parent = store.latest()
    manifest = store.manifest(parent) or {}
    current = store.tables(parent)
    old_marks = list(manifest.get("watermarks", []))
    assert_unique_watermarks(old_marks)
    started = utc_now()
    warnings = list(product.warnings)
    staged_all: list[Staged] = []
    advances: list[Advance] = []
    sources_info = []

    # Lake tables first (a source may not carry a table's name: refused at resolve). Only tables some
    # transform mentions are bound: binding lists a table's files, which is work at thousands of buckets.
    bound: set[str] = set()
    for name, st in current.items():
        if _mentioned(product.transforms, name):
            store.read_state(st).createOrReplaceTempView(name)
            bound.add(name)

    house = Warehouse(spark, product.sources, load)

    def clean() -> None:
        # The run's views point at staged scratch data that is removed here: drop them with it.
        for name in bound:
            spark.catalog.dropTempView(name)
        for s in staged_all:
            s.cleanup()
        house.cleanup()

    try:
        house.preflight(list(product.sources.values()))
        for src in product.sources.values():
            start = house.start(src, old_marks, full_refresh)
            df, info = read_source(spark, src, house, start)
            info["estimated_bytes"] = size_estimate(df)  # A11: reported before any read, from plan statistics
            if info["estimated_bytes"] is None:
                warnings.append(f"source {src.name!r}: no size estimate")
            if start is not None:
                info["pushed_mark"] = str(start[1])
            if src.incremental is not None:
                kind, warns = validate_cursor(df, src.incremental.cursor, src.name)
                warnings += warns
                mark = None if full_refresh else mark_for(old_marks, src.name, kind)
                if src.kind == "raw":
                    # Files are pinned at read: no copy needed for a consistent delta.
                    delta_df, adv = pinned_delta(df, src.incremental.cursor, mark, src.incremental.lookback, src.name)
                    info.update(staged=False)
                else:
                    # A live database can change between reads: stage the delta once.
                    try:
                        staged, adv = stage_delta(df, src.incremental.cursor, mark, src.incremental.lookback, src.name)
                    except Exception as e:
                        raise house.named(src, e) from e
                    staged_all.append(staged)
                    delta_df = spark.read.schema(staged.df.schema).parquet(staged.path)
                    info.update(staged=True, bytes=staged.bytes)
                advances.append(adv)
                delta_df.createOrReplaceTempView(src.name)
                bound.add(src.name)
                info.update(incremental=True, rows=adv.rows,
                            mode="full_refresh" if full_refresh else ("bootstrap" if mark is None else "delta"))
            else:
                info.update(incremental=False)
                if src.kind == "jdbc":
                    # A live database can change between reads: every transform and the replay see one copy.
                    try:
                        staged = stage_parquet(df)
                    except Exception as e:
                        raise house.named(src, e) from e
                    staged_all.append(staged)
                    df = spark.read.schema(staged.df.schema).parquet(staged.path)
                    info.update(staged=True, rows=staged.rows, bytes=staged.bytes)
                df.createOrReplaceTempView(src.name)
                bound.add(src.name)
            sources_info.append(info)
    except Exception:
        clean()
        raise
    warnings += house.warnings

    new_tables = dict(current)
    transforms_info = []
    changes: dict[str, Changes | None] = {}
    try:
        for t in product.transforms:
            t0 = time.monotonic()
            df = evaluate(spark, t)
            stmt = statement_for(t)
            if t.rollup is not None:
                landing = land_rollup(store, t, df, current, new_tables, changes.get(t.rollup.of), stmt)
            elif t.strategy == "replace":
                landing = land_replace(store, df, t.name, stmt)
            else:
                staged = stage_parquet(df)
                staged_all.append(staged)
                landing = land_keyed(
                    store, staged, t.name, t.key, t.strategy, current.get(t.name),
                    full_refresh=full_refresh, label=t.label, buckets=t.buckets, statement=stmt,
                )
                landing.state, n_compacted = compact(store, landing.state)
                if n_compacted:
                    warnings.append(f"table {t.name!r}: compacted {n_compacted} bucket(s)")
            changes[t.name] = landing.changes
            new_tables[t.name] = landing.state
            later = product.transforms[product.transforms.index(t) + 1:]
            if _mentioned(later, t.name) or (replay_check and _mentioned(product.transforms, t.name)):
                store.read_state(landing.state).createOrReplaceTempView(t.name)
                bound.add(t.name)
            transforms_info.append({
                "table": t.name, "strategy": t.strategy, "rows_written": landing.rows_written,
                "rows": landing.state.rows, "buckets_touched": landing.buckets_touched,
                "rows_rewritten": landing.rows_rewritten,
                "buckets": landing.buckets_total, "seconds": round(time.monotonic() - t0, 3),
                "statement": stmt,
            })

        # Watermarks: merged only when something advanced (or a full refresh rewrites them).
        marks = old_marks
        if advances and (full_refresh or any(a.new_max is not None for a in advances)):
            merged = upsert_watermarks(
                watermarks_df(spark, old_marks), watermarks_df(spark, [a.as_row() for a in advances]), full_refresh
            )
            marks = marks_to_json(merged.orderBy("source").collect())  # one row per source

        if product.incremental_sources():
            for name in sorted(current):
                before, after = current[name].rows, new_tables[name].rows
                if after < before:
                    warnings.append(f"table {name!r} shrank from {before} to {after} rows in this run")

        verifications: list[Verification] = []
        if verify and product.exports:
            frames = {
                e.route: spark.table(e.bind) if e.bind is not None else store.read_state(new_tables[e.table])
                for e in product.exports
            }
            native, connectors = house.native_types(_bound(product))
            verifications = verify_all(
                product.exports, frames, incremental=bool(product.incremental_sources()), native=native, connectors=connectors
            )

        if replay_check:
            replay(spark, store, product, new_tables, full_refresh)

        version = None
        if commit:
            extra = {"sources": sources_info}
            if manifest.get("stream_batches"):
                extra["stream_batches"] = manifest["stream_batches"]  # a stream into this store must still know its batches
            version = store.commit(new_tables, marks, product=product.name, parent=parent, extra=extra)
        finished = utc_now()
        summary = {
            "execution": version, "snapshot": version, "product": product.name,
            "started_at": iso(started), "finished_at": iso(finished), "outcome": "success",
            "full_refresh": full_refresh, "sources": sources_info, "transforms": transforms_info,
            "warnings": warnings,
            "verified": bool(verify and product.exports),
        }
        if version is not None:
            store.write_history(version, summary)
        return RunResult(version, new_tables, marks, verifications, warnings, summary)
    except Exception as e:
        if commit:
            # A refused run publishes nothing but still leaves a record of what it tried.
            store.write_failure({
                "execution": None, "snapshot": None, "product": product.name, "started_at": iso(started),
                "finished_at": iso(utc_now()), "outcome": f"failed: {type(e).__name__}: {e}",
                "full_refresh": full_refresh, "sources": sources_info, "transforms": transforms_info,
                "warnings": warnings, "parent": parent,
            })
        raise
    finally:
        clean()


def _bound(product: Product) -> list[Source]:
    """The sources that exports are bound to."""
    names = {e.bind for e in product.exports if e.bind is not None}
    return [s for s in product.sources.values() if s.name in names]


def _mentioned(transforms, name: str) -> bool:
    """Does any transform's text name ``name`` as a whole word (identifiers are case-insensitive)?"""
    pattern = re.compile(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", re.IGNORECASE)
    return any(pattern.search(t.sql) for t in transforms)


def verify_published(
    spark: SparkSession, product: Product, root: str, version: int | None = None, raise_on_failure: bool = True,
    load: Load | None = None,
) -> list[Verification]:
    """3.3 ``verify``: check the committed snapshot (bound exports against their live sources).

    Schema checks need no job; each export with a grain costs one aggregate.
    Writes a source-check record and the bound sources' column descriptions with
    the interface digest and the profile, so a reader can tell whether they are
    still fresh.
    """
    from tessera.plans.catalog import write_source_check, write_source_descriptions

    spark = isolated(spark)
    store = Store(spark, root)
    tables = store.tables(version)
    bound = _bound(product)
    house = Warehouse(spark, {s.name: s for s in bound}, load)
    live = {src.name: read_source(spark, src, house)[0] for src in bound}
    frames: dict[str, DataFrame] = {}
    for e in product.exports:
        frames[e.route] = live[e.bind] if e.bind is not None else store.read_state(tables[e.table])
    native, connectors = house.native_types(bound)
    out = verify_all(
        product.exports, frames, raise_on_failure=False, incremental=bool(product.incremental_sources()), native=native, connectors=connectors
    )
    write_source_check(spark, root, product, out)
    write_source_descriptions(spark, root, product, house.descriptions(bound))
    house.cleanup()
    fails = [f for v in out for f in v.failures]
    if fails and raise_on_failure:
        from tessera.errors import VerifyError

        raise VerifyError("verification failed:\n  " + "\n  ".join(fails))
    return out


def replay(spark: SparkSession, store: Store, product: Product, tables: dict[str, TableState], full_refresh: bool = False) -> None:
    """The whole pipeline once more on the same staged inputs; each table must come out as the same multiset.

    Nothing is written. Every replayed table takes its view's place, so a difference reaches the transforms after
    it as it would in a rerun. A full refresh rebuilds keyed tables from their SELECT alone: rows a rerun no longer
    returns count as a difference too.
    """
    for t in product.transforms:
        before = store.read_state(tables[t.name])
        again = evaluate(spark, t)
        if t.strategy == "replace" or full_refresh:
            after = again
        elif t.strategy == "upsert":
            after = upsert_by_key(before, again.select(*before.columns), t.key)
        else:
            after = append_by_key(before, again.select(*before.columns), t.key)
        if not checks.is_same_multiset(before, after):
            raise TesseraError(
                f"replay check failed: transform {t.label!r} gives different rows when run again on the same "
                "input; it is not replay-safe (a nondeterministic expression, or a delta read twice)"
            )
        after.createOrReplaceTempView(t.name)
