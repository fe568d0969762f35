import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import gated_lm as G


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+", low) + ["\n"]


def brute_base(rows):
    counts = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        ts = tokens(t)
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(ts), sum(counts[x] > 0 for x in ts), n, base))
    return out


def check_counts(got, rows):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(got, key=key), sorted(brute_base(rows), key=key), strict=True):
        assert tuple(g[:5]) == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


@pytest.fixture(scope="module")
def layout():
    words = {f"w{i}": 500 - i for i in range(300)}
    rest = {f"tail{i}ing": 2 for i in range(40)} | {f"r{i}": 1 for i in range(30)}
    head = [G.END, *sorted(list(words)[: G.HEAD - 1], key=lambda w: (w[-3:], w))]
    left = {w: n for w, n in (words | rest).items() if w not in head}
    endings = ["ing", "zzz"]
    groups = [[n for w, n in left.items() if w[-3:] == e] for e in endings]
    other = [n for w, n in left.items() if w[-3:] not in endings]
    counts = {w.encode(): n for w, n in (words | rest | {G.END: 90}).items()}
    return G.Layout(
        sum(counts.values()), len(counts), head, endings, counts,
        np.array([*map(sum, groups), sum(other)], float), np.array([*map(len, groups), len(other)], float),
    ), left


def test_probabilities_add_up(layout):
    v, left = layout
    net = G.Network(v)
    rng = np.random.default_rng(1)
    state = rng.normal(size=(1, G.HIDDEN)).astype(np.float32)
    numbers = np.arange(v.inputs - 1)
    states = np.repeat(state, len(numbers), axis=0)
    logp, _, _ = net.output(states, numbers, np.ones(len(numbers), bool))
    inside = v.class_total + 0.5 * (v.class_types + 1)
    mass = {k: 0.5 / inside[k - len(v.head)] for k in range(len(v.head), v.inputs - 1)}  # one unseen word each
    for w, n in left.items():
        mass[v.by_ending(w.encode())] += (n + 0.5) / inside[v.by_ending(w.encode()) - len(v.head)]
    assert np.exp(logp[: len(v.head)]).sum() + sum(math.exp(logp[k]) * mass[k] for k in mass) == pytest.approx(1, abs=1e-4)


def test_gradients(layout):
    v, _ = layout
    net = G.Network(v)
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    rng = np.random.default_rng(2)
    read, target = rng.integers(0, v.inputs, (3, 5)), rng.integers(0, v.inputs - 1, (3, 5))
    fresh, real = np.zeros((3, 5), bool), np.ones((3, 5), bool)
    fresh[:, 0], fresh[1, 3], real[2, 4] = True, True, False
    run = lambda: net.window(np.zeros((3, G.HIDDEN)), read, target, fresh, real, True)
    _, _, grads = run()
    for name in ("class", "class_bias", "word", "recur", "input"):
        dense = np.zeros_like(net.w[name])
        if name == "input":
            dense[grads[name][0]] = grads[name][1]
        else:
            dense = grads[name]
        for at in [np.unravel_index(i, dense.shape) for i in np.argsort(-np.abs(dense).ravel())[:3]]:
            was, eps = net.w[name][at], 1e-5
            net.w[name][at] = was + eps
            up = run()[0].sum()
            net.w[name][at] = was - eps
            down = run()[0].sum()
            net.w[name][at] = was
            assert -(up - down) / (2 * eps) == pytest.approx(dense[at], rel=1e-2, abs=1e-4)


def test_state_is_carried_through_whole_documents(layout):
    v, _ = layout
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, v.inputs - 1, n).astype(np.int32) for n in (1, 700, 3, 64, 65, 90, 2)]
    net = G.Network(v)
    alone = []
    for d in docs:  # one word at a time
        state, total = np.zeros((1, G.HIDDEN), np.float32), 0.0
        for t, word in enumerate(d):
            state, _ = net.step(state, np.array([d[t - 1] if t else v.inputs - 1]))
            total += float(net.output(state, np.array([word]), np.ones(1, bool))[0][0])
        alone.append(total)
    for lanes, steps in ((2, 16), (5, 64), (99, 7)):
        assert G.run_lanes(net, docs, steps, lanes) == pytest.approx(alone, rel=1e-4)


def test_rows(spark):
    rows = [(1, "The cat  sat\x0bon the cat"), (2, None), (3, ""), (4, "é É zz\x1cy the"), (4, "é É zz\x1cy the"), (None, "no id cat"), (6, "new words only"), (5, "the of " * 30000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, row int")
    got = [tuple(r) for r in G.scored(df).collect()]
    check_counts(got, rows)
    assert all(np.isfinite(r[6]) and r[6] < 0 for r in got)
    assert G.scored(df.limit(0)).count() == 0
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    only = spark.createDataFrame([(i, "a b") for i in held], "doc_id bigint, text string")
    assert [tuple(r)[2:] for r in G.scored(only).collect()] == [(3, 0, 0, 0.0, 0.0)] * 2  # nothing to learn from


def test_counted_words_do_not_change_the_result(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    a = sorted(tuple(r) for r in G.scored(df).collect())
    monkeypatch.setattr(G, "COUNTED", 300)
    b = sorted(tuple(r) for r in G.scored(df).collect())
    check_counts(a, rows)
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-6)


def test_better_than_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in G.scored(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held)


def test_fine_partitions_do_not_lower_the_score(spark, monkeypatch):
    monkeypatch.setattr(G, "REPLICA_TOKENS", 1 << 16, raising=False)  # several rounds
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    mean = lambda rows: sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    whole, fine = (mean(G.scored(d).where("held_out").collect()) for d in (docs.coalesce(1), docs.repartition(64)))
    print("held-out score per token:", whole, fine)
    assert fine > whole - 0.01


class Tasks:
    """Stands for a table; keeps the function that a task runs."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def groupBy(self, column):
        return self

    def agg(self, column):
        return self


ODD = ["The cat", None, "", " ", "\x0b\x0c\x1c\x1f\x00 b\x85c\u2028d \u00a0", "\tQ\r\n", "ÉÀ ǅ É", "a " * 50, "x"]


def test_words_of_odd_texts():
    texts = ["cut off", *ODD * 3, None]
    words, sizes = G.words_of(pa.array(texts, pa.string()).slice(1))
    want = [tokens(t)[:-1] for t in texts[1:]]
    assert words.to_pylist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    words, sizes = G.words_of(pa.array([None, " "], pa.string()))
    assert words.to_pylist() == [] and sizes.tolist() == [0, 0]


def test_read_and_counts_whatever_the_batches(spark, layout, monkeypatch):
    v, _ = layout
    texts = [*ODD, "w3 W3 newing newing xyzzy w299 xyzzy r1", *ODD, "w299 " * 40 + "newing"]
    rows = pa.table({"id": pa.array(range(len(texts))), "held_out": pa.array([False] * len(texts)), "text": pa.array(texts)})

    def run(size):
        task, counted = Tasks(), Tasks()
        G._read(task, v), G.count_words(counted)
        read = [r for b in task.run(rows.to_batches(max_chunksize=size)) for r in b.to_pylist()]
        counts = Counter()
        for b in counted.run(rows.select(["text"]).to_batches(max_chunksize=size)):
            for r in b.to_pylist():
                counts[r["word"]] += r["n"]
        return read, counts

    for size, piece in ((len(texts), 1 << 22), (3, 1 << 22), (3, 20), (len(texts), 1)):
        monkeypatch.setattr(G, "PIECE", piece)
        read, counts = run(size)
        assert [r["id"] for r in read] == [r["row"] for r in read] == list(range(len(texts)))
        assert counts == Counter(w for t in texts for w in tokens(t))
        for r, t in zip(read, texts, strict=True):
            ws = tokens(t)
            known = [w for w in ws if w.encode() in v.counts]
            lost = Counter(w for w in ws if w.encode() not in v.counts)
            assert np.frombuffer(r["numbers"], np.int32).tolist() == [v.number.get(w.encode(), v.by_ending(w.encode())) for w in ws[:-1]] + [0]
            assert (r["n_tokens"], r["known"]) == (len(ws), len(known))
            assert r["base"] == pytest.approx(sum(v.base(np.array([v.counts[w.encode()]]))[0] for w in known))
            assert sorted((x["word"], x["class"], x["n"]) for x in r["rest"]) == sorted((w, v.by_ending(w.encode()) - len(v.head), n) for w, n in lost.items())


def test_reading_costs_less_than_words_as_python_objects(spark, layout):
    v, _ = layout
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toPandas()["text"].tolist() * 4
    rows = pa.table({"id": pa.array(range(len(texts))), "held_out": pa.array([False] * len(texts)), "text": pa.array(texts)})

    def seconds(work):
        taken = []
        for _ in range(3):
            began = time.process_time()
            work()
            taken.append(time.process_time() - began)
        return min(taken)

    task = Tasks()
    G._read(task, v)
    plain = seconds(lambda: [Counter((t or "").encode().lower().split()) for t in texts])
    assert seconds(lambda: list(task.run(rows.to_batches()))) < 2 * plain
