"""Exact top-k search against all pairs in plain Python."""

import math
import random

import pytest

from tessera.llm import topk_scan
from tessera.llm.topk_scan import exact_top_k, nearest_vectors

SCHEMA = "vec_id bigint, embedding array<float>, score int"


def brute(rows, every=100, k=10):
    usable = [
        (i, [min(max(math.floor(1024 * x), topk_scan.LEAST), topk_scan.MOST) for x in v])
        for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, v in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        scored = [(min(max(sum(a * b for a, b in zip(v, w)), topk_scan.LEAST), topk_scan.MOST), i) for i, w in usable if i != q]
        scored.sort(key=lambda e: (-e[0], e[1]))
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors(seed, n, size=6):
    rng = random.Random(seed)
    return [(i, [rng.choice([0.0, 0.25, -0.5, 0.125, 1.0]) for _ in range(size)], 1) for i in range(n)]


ODD = [
    (None, [0.5] * 6, 1), (1000, None, 1), (1001, [None, 1.0], 1), (1100, [float("nan")] * 6, 1), (1200, [float("inf")], 1),
    (1300, [], 1), (1400, [1.0, 2.0], 1), (1500, [3e38] * 3, 1), (1501, [-3e38] * 3, 1), (-100, [0.5] * 6, 1), (-7, [-0.0001] * 6, 1),
    (200, [0.5] * 6, 1), (200, [0.5] * 6, 1),
]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(topk_scan, "BLOCK", 32)
    monkeypatch.setattr(topk_scan, "WORK", 1 << 8)


def test_equals_brute_force(spark, small):
    for rows in (vectors(1, 700), vectors(2, 230) + ODD, [(i, [1.0, -1.0], 0) for i in range(300)]):
        got = sorted(tuple(r) for r in nearest_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
        assert got == brute(rows)


def test_rounds_give_the_same(spark, small, monkeypatch):
    rows = vectors(3, 900)
    monkeypatch.setattr(topk_scan, "QUERY_BYTES", 300)
    assert sorted(tuple(r) for r in nearest_vectors(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


def test_sparse_rows_of_a_large_vocabulary(spark, small):
    rng = random.Random(4)
    rows = [(i, [(t, rng.randint(-9, 9) or 1) for t in rng.sample(range(10**6 - 50, 10**6), 8)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, pairs array<struct<term:int,weight:bigint>>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in exact_top_k(df, df.where("id < 5"), 3).collect()}
    for q in range(5):
        mine = dict(rows[q][1])
        want = sorted(((-sum(mine.get(t, 0) * w for t, w in p), i) for i, p in rows if i != q))[:3]
        assert [got[q, n + 1] for n in range(3)] == [(i, -s) for s, i in want]


def test_no_rows(spark):
    empty = nearest_vectors(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0
    assert nearest_vectors(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)).count() == 0
    assert nearest_vectors(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).count() == 0
