"""Runs against the definition, period by period, and the query's digests against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import word_runs
from tessera.llm.word_runs import find_runs, periodic_runs, run_report


def brute_runs(words, least=24, exponent=3):
    """Every maximal stretch of every period; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def by_operator(words, **how):
    return [tuple(r) for r in find_runs(np.array([*words, max(words, default=0) + 1]), **how).tolist()]


def nested(rng):
    """Texts whose periods hold periods: powers of words made of powers."""
    unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 4))]
    for _ in range(rng.randint(1, 3)):
        unit = unit * rng.randint(1, 9) + [rng.randint(0, 3) for _ in range(rng.randint(0, 3))]
    return ([rng.randint(0, 5) for _ in range(rng.randint(0, 9))] + unit * rng.randint(1, 6))[:700] + [rng.randint(0, 2) for _ in range(9)]


def test_equals_the_definition():
    rng, some = random.Random(5), 0
    for _ in range(400):
        words = nested(rng)
        want = brute_runs(words)
        assert by_operator(words) == want, words
        some += len(want)
    assert some > 300


def test_other_lengths_and_exponents():
    rng = random.Random(6)
    for least, exponent in ((6, 3), (3, 3), (40, 3), (24, 4), (12, 6)):
        for _ in range(60):
            words = nested(rng)
            assert by_operator(words, least=least, exponent=exponent) == brute_runs(words, least, exponent), (words, least, exponent)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120))
def test_binary_words(words):
    assert by_operator(words) == brute_runs(words)


def test_fibonacci_words_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    for words in (b, b * 3, [7] * 1000, [0] * 500 + [1] + [0] * 500, ([1] * 30 + [2]) * 20):
        assert by_operator(words) == brute_runs(words)


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


@pytest.mark.parametrize("budget", [64, 1 << 16])
def test_report_equals_plain_python(spark, monkeypatch, budget):
    monkeypatch.setattr(word_runs, "WORDS", budget)
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{x}" for x in nested(rng)), "x", 1) for i in range(150)]
    rows += [(200, None, "x", 1), (201, "", "x", 1), (202, " \t\n", "x", 1), (203, "one", "x", 1), (204, "é b\x1c c " * 40, "x", 1)]
    rows += [(i, " ".join(str(j) for j in range(300)), "x", 1) for i in range(300, 340)] + [(301, "a b " * 30, "x", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id int, text string, words string, period int").repartition(3)
    got = sorted((tuple(r) for r in run_report(df).collect()), key=str)
    assert got == sorted((brute_row(i, t) for i, t, _, _ in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows)


def test_general_result_and_no_rows(spark):
    df = spark.createDataFrame([(1, "x " + "a b c " * 9 + "y"), (None, "a " * 25)], "doc_id bigint, text string")
    got = {r.id: r for r in periodic_runs(df).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 27, 3)] and got[1].collapsed == "x a b c y" and got[1].n_words == 29
    assert got[None].collapsed == "a"
    assert run_report(df.limit(0)).count() == 0


def test_given_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = [(i, t) for i, t in docs if len(t or "") < 6000]
    got = {r.doc_id: tuple(r) for r in run_report(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert len(got) == len(docs) and [got[i] for i, _ in short] == [brute_row(i, t) for i, t in short]
