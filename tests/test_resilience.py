"""Task failures during a run (a lost executor looks like this to the job) must not change results.

Runs in a subprocess: task retries need a `local[N,F]` master, and one JVM holds one SparkContext.
"""

import json
import os
import subprocess
import sys
import tempfile

SCRIPT = r'''
import json, sys, tempfile
sys.path.insert(0, sys.argv[1])
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F, types as T
spark = (SparkSession.builder.master("local[4,3]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
spark.sparkContext.setLogLevel("WARN")
from tessera.session import ensure_checkpoint_dir
ensure_checkpoint_dir(spark, tempfile.mkdtemp())
from tessera.operators import strategy
from tessera.plans.store import Store
from tessera.sources.staging import stage_parquet

@F.udf(T.LongType())
def flaky(x):  # every task's first attempt dies on its first row
    ctx = TaskContext.get()
    if ctx is not None and ctx.attemptNumber() == 0:
        raise RuntimeError("injected task failure")
    return x

sf = sys.argv[2]
orders = spark.read.parquet(f"{sf}/orders.parquet").repartition(4)
store = Store(spark, tempfile.mkdtemp())
base = orders.where("o_orderkey < 1000").withColumn("o_orderkey", flaky("o_orderkey"))
a = strategy.land_keyed(store, stage_parquet(base), "o", ["o_orderkey"], "upsert", None, buckets=8)
delta = orders.where("o_orderkey >= 900").withColumn("o_orderstatus", F.lit("Z")).withColumn(
    "o_orderkey", flaky("o_orderkey"))
staged = stage_parquet(delta)
b = strategy.land_keyed(store, staged, "o", ["o_orderkey"], "upsert", a.state)
got = store.read_state(b.state)
print(json.dumps({"staged": staged.rows, "delta": orders.where("o_orderkey >= 900").count(),
                  "manifest_rows": b.state.rows, "table_rows": got.count(), "orders": orders.count(),
                  "distinct": got.select("o_orderkey").distinct().count(),
                  "z": got.where("o_orderstatus = 'Z'").count()}))
'''


def test_results_survive_task_failures(sf):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.NamedTemporaryFile("w", suffix=".py", delete=False) as fh:
        fh.write(SCRIPT)
    out = subprocess.run([sys.executable, fh.name, repo, sf], capture_output=True, text=True, timeout=600)
    line = [x for x in out.stdout.splitlines() if x.startswith("{")]
    assert line, out.stderr[-2000:]
    assert out.stderr.count("injected task failure") >= 2  # the failures really happened, and were retried
    r = json.loads(line[-1])
    assert r["staged"] == r["delta"]  # staging counted each row once despite failed attempts
    assert r["manifest_rows"] == r["table_rows"] == r["distinct"] == r["orders"]
    assert r["z"] == r["delta"]
