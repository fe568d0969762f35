"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregate (a minimum per vertex, combined before the shuffle)
and a join back, written to the shared checkpoint folder. No vertex's
neighbours are ever collected: a hub's edges stay separate rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v bigint) -> (vertex, root): root is the smallest vertex reachable. Only vertices with an edge occur."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour points at the smallest vertex seen
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # u itself may be the minimum; its larger neighbours already point at it
        large = written(large.where("u <> v"), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "small-star")
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("root"))).distinct()
