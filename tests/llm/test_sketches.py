import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import sketches as S


def brute_next(rows):
    """Rows (id, text) in descending order of ids; each with the following row's text."""
    h = lambda t: (lambda v: v - (1 << 64) if v >> 63 else v)(xxhash.xxh64_intdigest((t or "").encode(), 42))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h(r[1]), r[1] or ""))
    return [(i, t or "", order[(n + 1) % len(order)][1] or "") for n, (i, t) in enumerate(order)]


def shingles(text, size=5):
    w = text.split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, following):
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["éa", "b", "日本", "the", "x🙂", "of"]) + str(rng.randint(0, 40)) for _ in range(n))
    out = [(rng.randint(-3000, 40000) * 3, say(rng.randint(0, 90))) for _ in range(300)]
    out = list(dict(out).items())
    return out + [(-77777, None), (90001, ""), (90004, "one two"), (90007, out[3][1])]


def test_whole_result(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "ORDERED_IN_ONE_TASK", 3)  # ranges of ranges
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, bucket string")
    got = {r.doc_id: r for r in S.edited_neighbours(df).collect()}
    assert len(got) == len(rows)
    for i, t, following in brute_next(rows):
        r, e = got[i], edited(t, following)
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        # below k distinct shingles every estimate is exact
        assert abs(r.near_edited - jaccard(t, e)) < 1e-9 and abs(r.near_next - jaccard(t, following)) < 1e-9
        assert r.distinct_shingles == len(shingles(t)) and len(r.fingerprint) == 16 * len(shingles(t))
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint


def test_estimates_beyond_k(spark):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[1000:5000])
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    sk = S.fingerprint(df, k=512)
    both = sk.where("doc_id = 1").select(F.col("sketch").alias("a")).join(sk.where("doc_id = 2").select(F.col("sketch").alias("b")))
    r = both.select(S.resemblance(F.col("a"), F.col("b"), 512).alias("j"), S.containment(F.col("a"), F.col("b"), 512).alias("c"), S.distinct_shingles(F.col("a"), 512).alias("n")).first()
    assert abs(r.j - 0.6) < 0.08 and abs(r.c - 0.75) < 0.1 and abs(r.n - 3996) < 600


def test_sketches_merge_across_parts(spark):
    rng = random.Random(2)
    parts = [(p % 2, " ".join(f"v{rng.randint(0, 3000)}" for _ in range(300))) for p in range(12)]
    df = spark.createDataFrame(parts, "doc_id bigint, text string")
    got = dict(S.merge_sketches(S.fingerprint(df, k=64), ["doc_id"], k=64).collect())
    full = {r.doc_id: r.s for r in S.fingerprint(df, k=10**6).select("doc_id", F.explode("sketch").alias("h")).groupBy("doc_id").agg(F.sort_array(F.collect_set("h")).alias("s")).collect()}
    assert got == {i: s[:64] for i, s in full.items()}


def test_empty_parts_take_no_place(spark):
    words = " ".join(f"v{i}" for i in range(500))
    parts = [(1, words), (1, None), (1, ""), (2, " "), (2, None), (None, words), (None, ""), (3, "a b")]
    sketches = S.fingerprint(spark.createDataFrame(parts, "doc_id bigint, text string"), k=64)
    got = dict(S.merge_sketches(sketches, ["doc_id"], k=64).collect())
    full = next(r.sketch for r in sketches.collect() if r.doc_id == 1 and r.sketch)
    assert len(full) == 64 and got[1] == got[None] == full and got[2] == [] and len(got[3]) == 1


def test_null_ids_and_repeats(spark):
    rows = [(4, "a b"), (4, "a b"), (None, "z y x w v u"), (None, None), (-5, "a b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in S.edited_neighbours(df).collect())
    # null ids are ordered among themselves by dealt ranges: any order of the two is one cycle through all five rows
    assert [g[:3] for g in got] == [(False, -5, 3), (False, 4, 3), (False, 4, 3), (True, 0, 0), (True, 0, 11)]
    one = S.edited_neighbours(df.limit(1)).first()
    assert one.near_next == 1.0  # the only row is its own next document
    assert S.edited_neighbours(df.limit(0)).count() == 0
