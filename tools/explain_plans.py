"""Print the physical plans of the headline operators (the shapes PLANS.md describes).

usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tessera.model import ColumnSpec, Export  # noqa: E402
from tessera.operators import checks, delta, reader, strategy, verify  # noqa: E402
from tessera.plans.store import BUCKET_COL, Store, bucket_of, part_dir_of  # noqa: E402
from tessera.session import local_session, scratch_path  # noqa: E402
from tessera.sources.staging import stage_parquet  # noqa: E402


def show(title, df):
    print(f"\n===== {title}")
    df.explain("formatted")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    events = spark.read.parquet(f"{sf}/events.parquet")
    lineitem = spark.read.parquet(f"{sf}/lineitem.parquet")

    show("delta: typed watermark literal pushed to the scan",
         delta.delta_filter(events, "ts", datetime(2024, 1, 15, 12)).select("event_id", "ts"))
    e = Export(name="o", grain=["o_orderstatus", "o_orderkey"],
               schema={"o_orderstatus": ColumnSpec("string"), "o_orderkey": ColumnSpec("bigint")})
    show("closed read: projection + equality filter + ordered page", reader.read_export(orders, e, {"o_orderstatus": "F"}))

    store = Store(spark, scratch_path(spark, "explain"))
    base = strategy.land_keyed(store, stage_parquet(orders), "o", ["o_orderkey"], "upsert", None, buckets=16).state
    d = stage_parquet(orders.where("o_orderdate >= '2001-01-01'").withColumn("o_orderstatus", F.lit("U")))
    key, nb = ["o_orderkey"], 16
    show("guard: NULL keys + duplicate keys + touched buckets, one job",
         d.df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).agg(
             F.count_if(F.col("__n") > 1), F.collect_set(bucket_of(key, nb))))
    target = store.read_state(base)
    show("upsert step 1: which keys exist, where (key column + file path only)",
         target.select(*key, part_dir_of(F.col("_metadata.file_path")).alias("__dir"))
         .join(F.broadcast(d.df.select(*key)), key, "left_semi")
         .agg(F.count(F.lit(1)), F.collect_set("__dir")))
    kept = target.join(F.broadcast(d.df.select(*key)), key, "left_anti").withColumn(BUCKET_COL, bucket_of(key, nb))
    incoming = d.df.withColumn(BUCKET_COL, bucket_of(key, nb)).hint("rebalance", BUCKET_COL)
    show("upsert step 2, small delta: stored rows not shuffled, delta rebalanced by bucket",
         kept.unionByName(incoming))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a delta too big to broadcast
    kept = target.join(d.df.select(*key), key, "left_anti").withColumn(BUCKET_COL, bucket_of(key, nb))
    show("upsert step 2, large delta: Spark's own join partitioning, the write sized by rebalance, not by the bucket count",
         kept.hint("rebalance", BUCKET_COL).unionByName(incoming))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    show("keep_latest: partial aggregate before the shuffle (hot keys reduced per task)",
         strategy.keep_latest(lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate"]))
    show("grain verification: two-level aggregate, NULLs counted as values",
         verify.grain_counts(lineitem, ["l_orderkey", "l_linenumber"]))
    show("multiset diff: one signed-count aggregate",
         checks.multiset_diff(lineitem.where("l_returnflag = 'R'"), lineitem.where("l_returnflag = 'A'")))


if __name__ == "__main__":
    main()
