"""Exact top-k search: exhaustive term-at-a-time accumulation over blocks of sparse rows.

Rows are sparse integer vectors (``id``, ``pairs`` of term and weight). A task
turns a block of candidate rows into postings (term -> slots and weights). Every
query then scatters ``weight * posting`` term by term into one dense array of
scores, and a partition selection keeps its best k of the block; ties at the
boundary are all kept until ids order them. The best of all tasks are merged by
a window whose limit Spark applies before the shuffle, too.

**Scale.** Every query meets every row: a stated query set, in blocks. Queries
travel to the tasks in rounds of at most ``QUERY_BYTES`` (counted before, dealt
by a hash), so what is broadcast never grows with the table; a round scans the
prepared rows once. Tasks are sized by (queries x rows) and hold one block, the
round's queries and k results each. No key deals rows, so copies or a frequent
vector weigh on no single task.

Defined results: scores are exact integers (32-bit, 64-bit or Python integers,
as the largest weights of a block need; a score beyond 64 bits is clipped to the
nearest long). Rows without an id, with a null vector, or with a null, NaN or
infinite component take no part. Vectors may differ in length: a missing
component is zero, an empty vector scores 0 with all. Components are
``floor(1024 * x)`` clipped to a long. Repeated rows are candidates once each
and share ids in the result; equal query rows are one query; a query never meets
rows of its own id. Fewer rows than k give fewer ranks; an empty table gives an
empty result. Other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Bytes of queries a round broadcasts, at 16 bytes a pair.
QUERY_BYTES = 32 << 20
#: Candidate rows scored at a time: their scores and postings stay in a core's cache.
BLOCK = 4096
#: (query, row) pairs a task scores, unless that would be less than a block of rows.
WORK = 1 << 22
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_FOUND = "slot int, query_id long, vec_id long, score long"


def scaled_pairs(vector: Column, scale: int = 1024) -> Column:
    """Non-zero components ``floor(scale * x)`` of an array column as (term, weight) pairs; null if unusable."""
    infinite = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == infinite))
    pairs = F.transform(
        vector,
        lambda x, i: F.struct(i.alias("term"), F.floor(F.lit(float(scale)) * x.cast("double")).cast("long").alias("weight")),
    )
    return F.when(~bad, F.filter(pairs, lambda p: p["weight"] != 0))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, terms and weights of an array of pair lists."""
    size = np.diff(np.asarray(column.offsets))
    pairs = column.flatten()
    at = np.concatenate([[0], np.cumsum(size)])
    return at, pairs.field(0).to_numpy(zero_copy_only=False), pairs.field(1).to_numpy(zero_copy_only=False)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part.column(0).to_numpy(zero_copy_only=False), part.column(1)


def _postings(column: pa.Array, dtype) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    """term -> (slots or None for all slots in order, weights)."""
    at, terms, weights = _flat(column)
    slots = np.repeat(np.arange(len(column)), np.diff(at))
    order = np.argsort(terms, kind="stable")
    terms, slots, weights = terms[order], slots[order], weights[order].astype(dtype)
    names, start = np.unique(terms, return_index=True)
    ends = np.append(start[1:], len(terms))
    return {
        t: (None if e - s == len(column) else slots[s:e], weights[s:e])
        for t, s, e in zip(names.tolist(), start.tolist(), ends.tolist(), strict=True)
    }


def _dtype(largest_query: int, largest_row: int, terms: int):
    """The narrowest type whose range no score of these weights can leave."""
    bound = largest_query * largest_row * max(terms, 1)
    return np.int32 if bound < 1 << 31 else np.int64 if bound <= MOST else object


def _largest(weights: np.ndarray) -> int:
    return max(int(weights.max()), -int(weights.min())) if len(weights) else 0


def _first(scores, ids, k: int) -> list[tuple[int, int]]:
    """The k best (score, id): highest scores, ties to smaller ids."""
    return sorted(zip(scores, ids, strict=True), key=lambda e: (-e[0], e[1]))[:k]


def _chosen(acc: np.ndarray, ids: np.ndarray, own: int, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """``best`` merged with the block's scores."""
    at = np.flatnonzero(acc >= best[-1][0]) if len(best) == k else np.arange(len(acc))
    at = at[ids[at] != own]
    if len(at) > k:
        edge = np.partition(acc[at], len(at) - k)[len(at) - k]
        at = at[acc[at] >= edge]
        if len(at) > 2 * k:  # many ties at the edge: of those only the smallest ids can be chosen
            above, tied = at[acc[at] > edge], at[acc[at] == edge]
            at = np.concatenate([above, tied[np.argsort(ids[tied], kind="stable")[:k]]])
    if not len(at):
        return best
    return _first([s for s, _ in best] + acc[at].tolist(), [i for _, i in best] + ids[at].tolist(), k)


def _searcher(queries, k: int, block: int):
    """A mapInArrow function: the k best rows of its partition for every query of the round."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, terms, weights = queries.value
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        large_query, longest = _largest(weights), int(np.diff(at).max()) if len(ids) else 0
        asked = [list(zip(terms[s:e].tolist(), weights[s:e].tolist(), strict=True)) for s, e in zip(at, at[1:], strict=False)]
        for rows, column in _blocks(batches, block):
            dtype = _dtype(large_query, _largest(_flat(column)[2]), longest)
            postings = _postings(column, dtype)
            acc, part = np.zeros(len(rows), dtype), np.zeros(len(rows), dtype)
            for q, own in enumerate(ids.tolist()):
                acc[:] = 0
                for term, weight in asked[q]:
                    posting = postings.get(term)
                    if posting is None:
                        continue
                    slots, values = posting
                    if slots is None:
                        np.multiply(values, weight, out=part)
                        np.add(acc, part, out=acc)
                    else:
                        acc[slots] += values * weight
                if dtype is object:
                    acc = np.clip(acc, LEAST, MOST)
                best[q] = _chosen(acc, rows, own, best[q], k)
        found = [(q, int(ids[q]), i, s) for q, top in enumerate(best) for s, i in top]
        for start in range(0, len(found), 1 << 16):
            slot, query, row, score = zip(*found[start : start + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot, pa.int32()), *(pa.array(c, pa.int64()) for c in (query, row, score))],
                ["slot", "query_id", "vec_id", "score"],
            )

    return search


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of the highest inner product with each query.

    Both tables hold ``id`` long and ``pairs`` array<struct<term, weight>>, no term twice in a row; rows with a null in
    either take no part.
    """
    spark = rows.sparkSession
    usable = F.col("id").isNotNull() & F.col("pairs").isNotNull()
    rows = written(rows.select("id", "pairs").where(usable), "topk-rows")
    queries = written(queries.select("id", "pairs").where(usable).distinct(), "topk-queries")
    n_rows = rows.count()
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(16 * F.size("pairs") + 64), F.lit(0)).alias("b")).first()
    rounds = max(1, -(-size["b"] // QUERY_BYTES))
    tasks = max(1, min(-(-n_rows * -(-size["n"] // rounds) // WORK), -(-n_rows // BLOCK)))
    found = []
    for turn in range(rounds):
        asked = queries.where(F.pmod(F.xxhash64("id", "pairs"), F.lit(rounds)) == turn).toArrow().combine_chunks()
        if not asked.num_rows:
            continue
        at, terms, weights = _flat(asked["pairs"].chunk(0))
        sent = spark.sparkContext.broadcast((asked["id"].to_numpy(), at, terms, weights))
        part = rows.repartition(tasks).mapInArrow(_searcher(sent, k, BLOCK), _FOUND).withColumn("turn", F.lit(turn))
        found.append(written(part, "topk-found") if rounds > 1 else part)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0]
    for part in found[1:]:
        every = every.unionAll(part)
    place = Window.partitionBy("turn", "slot").orderBy(F.col("score").desc(), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_vectors(embeddings: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """The query: vectors whose id is divisible by ``every`` against all others."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), scaled_pairs(F.col("embedding"), scale).alias("pairs"))
    return exact_top_k(rows, rows.where(F.col("id") % every == 0), k)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT row_number() OVER () AS q, vec_id, c FROM (SELECT DISTINCT vec_id, c FROM v WHERE vec_id % 100 = 0)),
s AS (
  SELECT q.q, q.vec_id AS query_id, v.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.c, v.c), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) AS BIGINT) AS score
  FROM q, v WHERE q.vec_id <> v.vec_id),
t AS (SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 10
"""
