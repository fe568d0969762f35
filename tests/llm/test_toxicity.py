import zlib

import numpy as np

from tessera.llm import toxicity as T


def auc(rows):
    pos, neg = (np.array([s for s, y in rows if y == k]) for k in (1, 0))
    return (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()


def test_label_model_finds_the_better_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(4000) < right, np.where(y, 1, -1), np.where(y, -1, 1))
    weak = vote(0.6)
    votes = np.column_stack([vote(0.9), vote(0.8), weak, weak, weak, weak, weak])
    model, p = T.fit_label_model(votes, np.where(votes[:, 0] > 0, 0.8, 0.2))
    accuracy = model.prior * model.table[:, 1, 2] + (1 - model.prior) * model.table[:, 0, 0]
    assert accuracy[0] > accuracy[1] > accuracy[2]
    assert model.weight[2] < 0.3 < model.weight[0]  # five copies of one voter count about once
    majority = ((votes.sum(axis=1) > 0) == y).mean()
    assert ((p > 0.5) == y).mean() > majority + 0.05


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = T.scored(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert auc([(r.score, r.toxic) for r in held]) > 0.95
    caught = [r.predicted for r in held if r.toxic]
    assert sum(caught) > 0.8 * len(caught)
    assert sum(r.predicted for r in held if not r.toxic) < 0.01 * len(held)


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(T.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(tuple(r) for r in T.scored(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_edges(spark):
    rows = [(1, "you are an idiot", 1), (2, None, 1), (3, "", 1), (None, "fine words here", 1), (4, "nice day " * 60000, 1), (4, "nice day", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = T.scored(docs, none).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].predicted == 1 and by[2].predicted == 0 and by[2].score == by[3].score
    assert T.scored(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (2, None), (77, 1)], "doc_id bigint, toxic int")
    kept = T.acceptable(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, None}


def test_the_bound_is_one_of_rows(spark):
    rows = [(1, f"text number {i % 400} you idiot") for i in range(6000)] + [(i, f"a calm text {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 60)], "doc_id bigint, toxic int")
    sample = T._sample(docs, labels, "doc_id", "text", 100)
    assert sample.count() == 100 and sample.distinct().count() == 100
    few = T._sample(docs, labels, "doc_id", "text", 10_000)
    held = docs.where(T.is_held_out(docs["doc_id"])).count()
    assert few.count() == docs.distinct().count() - held  # a repeated row is one


def brute_votes(text, found):
    """The votes stated once more, one voter at a time over the whole text."""
    tokens = set((text or "").lower().split())
    units = {w[:n] + ("*" if n < len(w) else "") for t in tokens for w in T.LETTERS.findall(t) for n in [*T.BEGINNINGS, len(w)] if n <= len(w)}
    words = [int(w in units) for w in T.LEXICON]
    run = (text or "").lower().split()
    repeats = int(any(len(set(run[i : i + 4])) == 1 for i in range(len(run) - 3)))
    patterns = [T.SHOUT, T.SYMBOLS, None, T.NAMES]
    said = [repeats if p is None else int(bool(p.search(text or ""))) for p in patterns]
    return words + [1 if any(words) else -1 if len(tokens) > 5 else 0] + said + [int(f in units) for f in found]


TEXTS = [None, "", "you are a total idiot", "calm words about the weather in spring today", "what the %&$#@! is this", "GO! NOW! RUN! quick",
         "bla bla bla bla blub", "Idiotic? no. he is such a FOOL", "worthless scum and some more words here", "fine day", "the idiot said idiot, twice over"]


def test_votes_equal_brute_force():
    found = ["idio*", "weather", "bla"]
    voters = T.Voters(found)
    for text in TEXTS:
        assert voters.votes(text).tolist() == brute_votes(text, found), text


def brute_em(votes, gold, weight_of, rounds):
    """EM row by row: every row unlabelled with weight ``share``, the labelled ones once more with their label."""
    n_lab = sum(g is not None for g in gold)
    share = min(1.0, n_lab / max(len(votes) - n_lab, 1))
    rows = [(v, None, share) for v, g in zip(votes, gold, strict=True) if g is None]
    rows += [(v, g, 1.0) for v, g in zip(votes, gold, strict=True) if g is not None]

    def posterior(v, g, prior, table, weight):
        odds = np.log(prior / (1 - prior)) + sum(w * np.log(t[1][x + 1] / t[0][x + 1]) for x, t, w in zip(v, table, weight, strict=True))
        p = 1 / (1 + np.exp(-odds))
        right = 1.0 if g is None else T.GOLD if g else 1 - T.GOLD
        wrong = 1.0 if g is None else 1 - right
        return p * right / (p * right + (1 - p) * wrong)

    def sums(p):
        total, seen = np.zeros(2), np.zeros((len(votes[0]), 2, 3))
        for (v, _, times), q in zip(rows, p, strict=True):
            for c, share_of in ((0, 1 - q), (1, q)):
                total[c] += times * share_of
                for j, x in enumerate(v):
                    seen[j, c, x + 1] += times * share_of
        return total, seen

    p = [0.0 if g is None else T.GOLD if g else 1 - T.GOLD for _, g, _ in rows]
    rows_first = rows
    rows = [(v, g, t if g is not None else 0.0) for v, g, t in rows]
    for r in range(rounds + 1):
        total, seen = sums(p)
        overall = (seen.sum(axis=1) + 0.01) / (total.sum() + 0.03)
        table = seen + overall[:, None, :]
        table /= table.sum(axis=2, keepdims=True)
        prior = min(max(total[1] / total.sum(), 0.005), 0.995)
        rows = rows_first
        p = [posterior(v, g, prior, table, weight_of(r)) for v, g, _ in rows]
    return prior, table


def test_label_model_over_all_documents_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "CACHE_PATTERNS", 3)
    monkeypatch.setattr(T, "CORRELATE", -1)
    rng = np.random.default_rng(5)
    texts = [TEXTS[i] for i in rng.integers(0, len(TEXTS), 300)]
    found = ["idio*", "weather"]
    gold = [None if i >= 60 else int(bool(t) and ("idiot" in t or "scum" in t)) for i, t in enumerate(texts)]
    patterns = T.vote_patterns(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), found)
    votes = [brute_votes(t, found) for t in texts]
    assert {bytes(r.votes): r.n for r in patterns.collect()} == {
        np.array(v, np.int8).tobytes(): votes.count(v) for v in votes
    }
    labelled = np.array(votes[:60], np.int8)
    model = T.label_model(patterns, 300, labelled, np.array(gold[:60]))
    prior, table = brute_em(votes, gold, lambda r: model.weight, T.ROUNDS)
    assert abs(model.prior - prior) < 1e-3
    assert np.abs(model.table - table).max() < 2e-3


def test_weights_and_sums_do_not_depend_on_layout(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS * 30], "text string")
    model = T.believed(T.Voters([]).size)
    flats = [T.pattern_sums(T.vote_patterns(docs.repartition(n), []), model, True).flat().tolist() for n in (1, 7)]
    assert flats[0] == flats[1]
    votes = np.array([T.Voters([]).votes(t) for t in TEXTS * 30])
    assert flats[0] == T.Sums.of(votes, np.ones(len(votes)), model.posterior(votes), True).flat().tolist()


def test_unlabelled_documents_and_patterns_count(spark):
    calm = [(i, f"a quiet walk along the river number {i} in the early morning") for i in range(1, 400)]
    rude = [(i, f"%&$#@! text {i} with symbols, what a day") for i in range(400, 440)]
    docs = spark.createDataFrame(calm + rude, "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in T.scored(docs, none).collect()}
    assert min(got[i] for i in range(400, 440)) > 0.5 > max(got[i] for i in range(1, 400))
    labels = spark.createDataFrame([(i, int(i >= 400)) for i in range(1, 440)], "doc_id bigint, toxic int")
    loud = [(i, "GO! " * 4 + f"and read item {i} of the list now please") for i in range(400, 440)]
    shouting = T.scored(spark.createDataFrame(calm + loud, "doc_id bigint, text string"), labels).collect()
    assert all((r.score > 0.5) == (r.doc_id >= 400) for r in shouting)
    # A symbol run of words never seen is caught by the pattern alone.
    model = T.fit(docs, none)
    assert T.Scorer(model.features, model.weights, model.bias).score("zzz $$$$#### qqq") > 0.5
