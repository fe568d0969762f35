import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash_index as S
from tessera.llm.components import connected_components


def brute_print(text, size=3):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        r = find(i)
        if ids[i] is not None:
            least[r] = min(ids[i], least.get(r, ids[i]))
    return [least.get(find(i)) for i in range(len(ids))]


def clustered(n, seed):
    """Fingerprints around few centres, so that many agree on long patterns."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(5)] + [0]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprints():
    texts = ["a b c d", "A  b\tC\x0bd", "one", "two words", "", None, " \n", "é É x x x x x x", "a\x1cb c d", "the of " * 40000]
    for t in texts:
        assert S.fingerprint(t) == brute_print(t)
    assert S.fingerprint("a b c d") == S.fingerprint("A  b\tC\x0bd")


def test_gray_rank_orders_the_code():
    codes = np.array([i ^ (i >> 1) for i in range(1000)], dtype=np.uint64)
    assert S.gray_rank(codes).tolist() == list(range(1000))


def test_pairs_equal_brute_force():
    for n in (0, 1, 2, 17, 400):
        bits = np.array(clustered(n, n), dtype=np.uint64) if n else np.zeros(0, np.uint64)
        bits = bits[np.argsort(S.gray_rank(bits))]
        for radius in (0, 2, 4):
            got = {(int(x), int(y)) for a, b in S.linked_pairs(bits, radius) for x, y in zip(a, b, strict=True)}
            near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
            assert got == {(int(x), int(y)) for x, y in zip(*np.nonzero(np.triu(near, 1)), strict=True)}


def test_components_whatever_the_leaf(spark):
    prints = clustered(500, 1)
    ids = list(range(500))
    want = brute_components(ids, prints)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in zip(ids, prints, strict=True)]
    df = spark.createDataFrame(rows, "id bigint, fingerprint bigint")
    for leaf in (4096, 12):
        got = dict(S.components(df, leaf=leaf).select("id", "component_id").collect())
        assert [got[i] for i in ids] == want


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1060)] + [(7, 7), (2000, 2001), (2001, 2000)]
    rng.shuffle(edges)
    got = dict(connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1060)}, 2000: 2000, 2001: 2000}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_rows(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base), (3, base), (9, base.upper()), (9, base), (11, base + " x"), (12, None), (13, ""), (13, ""), (None, "solo text"), (20, "q " * 50000), (None, base), (7, "Other thing entirely here")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id bigint, text string, component_id string")
    prints = [brute_print(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], brute_components([i for i, _ in rows], prints), strict=True), key=str)
    assert sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=str) == want
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_one_row_stays(spark):
    rows = [(5, "a b c d e", "p"), (3, "A b c d e", "q"), (3, "A b c d e", "q"), (None, "a b c d e", "r"), (8, "z y x w v", "s"), (None, None, "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k1 string")
    kept = S.one_per_component(df)
    assert kept.columns == df.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(3, "A b c d e", "q"), (8, "z y x w v", "s"), (None, None, "t")], key=str)
    assert S.one_per_component(df.limit(0)).count() == 0


def test_fixture_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    want = {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components([r.doc_id for r in rows], prints), strict=True)}
    assert {r[0]: (r[1], r[2]) for r in S.near_duplicates(docs).select(F.col("doc_id"), "fingerprint", "component_id").collect()} == want
