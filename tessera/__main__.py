"""Job entry point: ``python -m tessera <command> product.yaml [--profile p.yaml] [--root URI]``, or
``spark-submit --py-files tessera.zip tessera/__main__.py <command> …`` on a cluster.

Each command runs on the session the cluster provides (``getOrCreate``) and
prints one JSON document; ``read`` prints one page (at most 1000 rows).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tessera.api import DataProduct
from tessera.model import load_product, load_profile


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Build, verify and publish a data product on Spark.")
    sub = p.add_subparsers(dest="command", required=True)

    def cmd(name: str, help_text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help_text)
        c.add_argument("product", help="product YAML file")
        c.add_argument("--profile", help="profile YAML (connections, upstream roots, storage)")
        c.add_argument("--root", help="store root; defaults to the profile's storage")
        return c

    r = cmd("run", "build one snapshot")
    r.add_argument("--full-refresh", action="store_true")
    r.add_argument("--replay-check", action="store_true")
    cmd("verify", "check the published snapshot against the interface")
    cmd("release", "pin supported routes to the published snapshot")
    cmd("status", "build status and watermarks")
    cmd("context", "the discoverable interface as one document")
    cmd("history", "run history")
    rb = cmd("rollback", "point LATEST at an earlier version")
    rb.add_argument("--to", type=int)
    rd = cmd("read", "one page of an export (closed grammar)")
    rd.add_argument("route")
    rd.add_argument("params", nargs="*", help="grain=value, limit=N, offset=N")
    rd.add_argument("--after", nargs="*", metavar="grain=value", help="the page that follows this row")
    ex = cmd("expire", "expire old versions and sweep unreferenced files")
    ex.add_argument("--retention-days", type=int, default=30)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict | list:
    args = _parser().parse_args(argv)
    profile = load_profile(args.profile) if args.profile else {}
    root = args.root or profile.get("storage")
    if not root:
        raise SystemExit("no store root: pass --root or set `storage` in the profile")
    spark = spark or SparkSession.builder.appName(f"tessera-{args.command}").getOrCreate()
    dp = DataProduct(spark, load_product(args.product, profile), root)

    if args.command == "run":
        res = dp.run(full_refresh=args.full_refresh, replay_check=args.replay_check)
        out = {"version": res.version, "warnings": res.warnings, "transforms": res.summary.get("transforms"),
               "grain": [v.grain for v in res.verifications if v.grain]}
    elif args.command == "verify":
        out = [{"route": v.route, "ok": v.ok, "failures": v.failures, "grain": v.grain} for v in dp.verify()]
    elif args.command == "release":
        doc, warnings = dp.release()
        out = {"pins": doc["routes"], "warnings": warnings}
    elif args.command == "status":
        st = dp.status()
        st["watermarks"] = [r.asDict() for r in st["watermarks"].collect()]  # one row per declared source
        out = st
    elif args.command == "context":
        out = dp.context()
    elif args.command == "history":
        out = [r.asDict() for r in dp.history().drop("statement").collect()]  # one row per run and table
    elif args.command == "rollback":
        old, new, diff = dp.rollback(args.to)
        out = {"from": old, "to": new, "watermarks": [r.asDict() for r in diff.collect()]}
    elif args.command == "read":
        params = dict(p.split("=", 1) for p in args.params)
        after = dict(p.split("=", 1) for p in args.after) if args.after else None
        out = [json.loads(r.j) for r in dp.read(args.route, params, as_json=True, after=after).collect()]  # ≤ 1000 rows
    else:
        out = dp.expire(args.retention_days)
    print(json.dumps(out, default=str, indent=1))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
