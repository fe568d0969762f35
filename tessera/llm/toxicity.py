"""Toxicity scores by weak supervision (operator 9).

1. **Voters.** Each lexicon word, each word or word beginning found to go with
   toxic labels, and each pattern (shouting, symbol runs, repeated words, name
   calling) votes toxic, clean or abstains on a text.
2. **Label model.** Every document votes: one scan writes how many documents
   share each vote pattern. A generative model gives every voter its vote
   probabilities under either class, by expectation maximisation whose sums are
   Spark aggregates over those patterns; the driver holds voters x voters
   numbers and no documents beyond the bounded sample. The labels of that sample take part as one more fallible
   voter that abstains everywhere else. Unlabelled documents count together at
   most as much as the labelled ones, so a large corpus does not move the
   classes away from the labels. Voters that agree beyond what the class
   explains are correlated: each voter's evidence is divided by its correlated
   weight, so near-copies of one voter do not outvote the rest.
3. **Classifier.** Logistic regression over words, word beginnings and the
   patterns is fitted to the posterior labels of the labelled rows (of a bounded
   sample of all rows where there are no labels) and scores every whole text.

Labels are read only for ids whose crc32 modulo ``HELD_OUT`` is not 0. The
classifier is fitted on at most ``MAX_LABELLED`` labelled rows, the ones with
the smallest hash of their id; without labels on the ``MAX_LABELLED`` rows with
the smallest hash of their text. These bounded samples do not depend on order or
layout. The sums of the label model are whole numbers, so they do not
depend on it either. Scoring needs the text alone, is one narrow stage, and a
text of any length contributes all its words.

Defined results: null and empty texts get the score of a text without words;
rows without an id are scored and never held out; several labels of one id
count as toxic if any is; null labels are ignored; without labels the label
model starts from what the lexicon and the patterns are believed to say; an empty table gives an empty result; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import python_rows, written

HELD_OUT = 5
#: Bounds of the fit: labelled rows, classifier features, found voters.
MAX_LABELLED = 10_000
MAX_FEATURES = 4096
MAX_VOTERS = 96
#: Documents a feature must occur in to count.
MIN_SUPPORT = 4
BEGINNINGS = range(3, 9)
#: A lexicon word's weight before any label is seen.
LEXICON_WEIGHT = 5.0
CACHE_WORDS = 300_000
#: Vote patterns a task counts before it passes them on.
CACHE_PATTERNS = 50_000
#: Sums in one row.
CHUNK = 4096
#: Posteriors are rounded to 1 / SCALE, so their sums are whole numbers.
SCALE = 1 << 16
#: Rounds of expectation maximisation, and the one that measures correlations over all documents.
ROUNDS, CORRELATE = 8, 3
#: How often a label is believed to be right.
GOLD = 0.97

LEXICON = (
    "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage worthless pathetic disgusting clown "
    "ugly hate jerk creep freak liar coward imbecile dimwit vermin filth parasite lowlife degenerate"
).split()

LETTERS = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"(?:\b[A-Z]{2,}[,.]?!+\s*){3}")
SYMBOLS = re.compile(r"[%&*$#@!]{4,}")
NAMES = re.compile(r"\b(?:you|he|she|they)(?:'re|'s| are| is)? (?:an? |such an? )?(?:complete |total |absolute )?(?:" + "|".join(LEXICON) + r")\b", re.I)
#: Pattern voters, and their weight in the classifier before any text is seen. Shouting and repeats are common in
#: harmless texts too: they start at none and get what the posterior labels give them.
PATTERNS = {"shouting": 0.0, "symbols": LEXICON_WEIGHT, "repeats": 0.0, "name-calling": LEXICON_WEIGHT}


def patterns_of(text: str, names: bool) -> list[int]:
    """1 or 0 per pattern; ``names`` says whether a lexicon word occurs, without which nobody is called one."""
    repeats = 0
    tokens = text.split()
    if len(tokens) > 3:
        lowered = text.lower().split()
        repeats = int(any(a == b == c == d for a, b, c, d in zip(lowered, lowered[1:], lowered[2:], lowered[3:], strict=False)))
    shouting = int(text.count("!") > 2 and SHOUT.search(text) is not None)
    return [shouting, int(SYMBOLS.search(text) is not None), repeats, int(names and NAMES.search(text) is not None)]


def features_of(token: str) -> list[str]:
    """Words in a blank-separated token, and their beginnings (marked by a star)."""
    out = []
    for word in LETTERS.findall(token):
        out.append(word)
        out += [word[:n] + "*" for n in BEGINNINGS if len(word) > n]
    return out


def tokens_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


class Voters(dict):
    """token -> numbers of the word voters it fires; a bounded cache per worker.

    Votes are in the order lexicon words, the lexicon as a whole, patterns, found
    features: 1 toxic, -1 clean, 0 abstains.
    """

    def __init__(self, found: list[str]):
        super().__init__()
        at = len(LEXICON) + 1 + len(PATTERNS)
        self.size = at + len(found)
        self.numbers: dict[str, list[int]] = {}
        for n, f in [*enumerate(LEXICON), *enumerate(found, at)]:
            self.numbers.setdefault(f, []).append(n)

    def __missing__(self, token: str) -> tuple:
        fired = tuple(n for f in features_of(token) for n in self.numbers.get(f, ()))
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(token) <= 64:
            self[token] = fired
        return fired

    def votes(self, text: str | None) -> np.ndarray:
        out = np.zeros(self.size, np.int8)
        tokens = tokens_of(text)
        fired = set().union(*map(self.__getitem__, tokens))
        out[list(fired)] = 1
        whole = len(LEXICON)
        said = bool(out[:whole].any())
        out[whole] = 1 if said else -1 if len(tokens) > 5 else 0
        out[whole + 1 : whole + 1 + len(PATTERNS)] = patterns_of(text or "", said)
        return out


@dataclass
class LabelModel:
    """P(vote | class) per voter, and how far each voter's evidence counts."""

    prior: float
    table: np.ndarray  # voters x 2 classes x 3 votes (clean, abstain, toxic)
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.table)
        n, m = votes.shape
        at = np.arange(m)
        score = np.full(n, np.log(self.prior / (1 - self.prior)))
        for j in at:
            score += self.weight[j] * (logs[j, 1] - logs[j, 0])[votes[:, j] + 1]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


@dataclass
class Sums:
    """Posterior sums in units of 1 / SCALE: documents per class, clean and toxic votes per voter and class, products of votes per class."""

    total: np.ndarray  # 2 classes
    votes: np.ndarray  # 2 classes x 2 votes (clean, toxic) x voters
    pairs: np.ndarray | None = None  # 2 classes x voters x voters

    @staticmethod
    def of(votes: np.ndarray, count: np.ndarray, p: np.ndarray, pairs: bool) -> Sums:
        toxic = np.rint(p * SCALE)
        v = votes.astype(float)
        by_class = [(SCALE - toxic) * count, toxic * count]
        each = np.stack([np.stack([(v < 0).T @ w, (v > 0).T @ w]) for w in by_class])
        return Sums(np.array([w.sum() for w in by_class]), each, np.stack([(v * w[:, None]).T @ v for w in by_class]) if pairs else None)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.total, self.votes, self.pairs) if x is not None])

    @staticmethod
    def unflat(x: np.ndarray, m: int) -> Sums:
        return Sums(x[:2], x[2 : 2 + 4 * m].reshape(2, 2, m), x[2 + 4 * m :].reshape(2, m, m) if len(x) > 2 + 4 * m else None)

    def plus(self, other: Sums, times: float = 1.0) -> Sums:
        both = self.pairs is not None and other.pairs is not None
        return Sums(self.total + times * other.total, self.votes + times * other.votes, self.pairs + times * other.pairs if both else None)

    def weight(self) -> np.ndarray:
        """1 / (1 + variance shared with the other voters beyond what the class explains): m equal voters count as one."""
        shared = 0.0
        for n, (clean, toxic), pairs in zip(self.total, self.votes, self.pairs, strict=True):
            mean = (toxic - clean) / max(n, 1.0)
            shared = shared + pairs - n * np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(shared), 0)) + 1e-6
        r = shared / np.outer(scale, scale)
        np.fill_diagonal(r, 0)
        return 1 / (1 + np.where(np.abs(r) > 0.2, r * r, 0).sum(axis=1))

    def model(self, weight: np.ndarray) -> LabelModel:
        n, votes = self.total / SCALE, self.votes / SCALE
        onehot = np.stack([votes[:, 0], n[:, None] - votes.sum(axis=1), votes[:, 1]], axis=2).transpose(1, 0, 2)
        # Smoothed towards a voter's votes overall, so a voter that never votes is evidence for neither class.
        overall = (onehot.sum(axis=1) + 0.01) / (n.sum() + 0.03)
        table = np.maximum(onehot, 0) + overall[:, None]
        table /= table.sum(axis=2, keepdims=True)
        return LabelModel(float(np.clip(n[1] / max(n.sum(), 1e-9), 0.005, 0.995)), table, weight)


def believed(voters: int) -> LabelModel:
    """The label model before any label: toxic votes are rare, and much rarer on clean texts; half the toxic texts hold no lexicon word."""
    table = np.tile(np.array([[0.002, 0.996, 0.002], [0.002, 0.898, 0.1]]), (voters, 1, 1))
    # A toxic text fires few of the words, so the silence of one says little.
    table[: len(LEXICON)] = [[0.0001, 0.9996, 0.0003], [0.0001, 0.9799, 0.02]]
    for j, trusted in enumerate(PATTERNS.values(), len(LEXICON) + 1):
        table[j] = [[0.0001, 0.9994, 0.0005], [0.0001, 0.8999, 0.1]] if trusted else [[0.0001, 0.9799, 0.02], [0.0001, 0.9499, 0.05]]
    table[len(LEXICON)] = [[0.9, 0.09, 0.01], [0.5, 0.1, 0.4]]
    return LabelModel(0.05, table, np.ones(voters))


def maximise(first: Sums, step: Callable[[LabelModel, bool], Sums], rounds: int = ROUNDS) -> LabelModel:
    """EM from the sums ``first`` (with pairs); ``step`` gives the sums under a model, with pairs where asked."""
    weight = first.weight()
    model = first.model(weight)
    for r in range(rounds):
        sums = step(model, r == CORRELATE)
        weight = weight if sums.pairs is None else sums.weight()
        model = sums.model(weight)
    return model


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[LabelModel, np.ndarray]:
    """EM over votes in memory from the starting posterior ``start``; returns the model and the posterior labels."""
    one = np.ones(len(votes))
    model = maximise(Sums.of(votes, one, start, True), lambda m, pairs: Sums.of(votes, one, m.posterior(votes), pairs), rounds)
    return model, model.posterior(votes)


def with_labels(posterior: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """The posterior after the label of a row, right with probability ``GOLD``, has voted as well."""
    right = np.where(gold > 0, GOLD, 1 - GOLD)
    return posterior * right / (posterior * right + (1 - posterior) * (1 - right))


def vote_patterns(docs: DataFrame, found: list[str], text_col: str = "text") -> DataFrame:
    """(votes, n): how many rows of ``docs`` share each vote pattern; counted per task before the shuffle."""
    schema = pa.schema([("votes", pa.binary()), ("n", pa.int64())])

    def run(batches):
        voters, seen = Voters(found), Counter()
        for rows in python_rows(batches):
            seen.update(voters.votes(text).tobytes() for (text,) in rows)
            if len(seen) >= CACHE_PATTERNS:
                yield pa.record_batch([list(seen), list(seen.values())], schema=schema)
                seen.clear()
        yield pa.record_batch([list(seen), list(seen.values())], schema=schema)

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "votes binary, n bigint")
    return counted.groupBy("votes").agg(F.sum("n").alias("n"))


def pattern_sums(patterns: DataFrame, model: LabelModel, pairs: bool) -> Sums:
    """Posterior sums over all documents behind ``patterns``: whole numbers, as many as the voters need.

    A task passes its sums on in a few rows of ``CHUNK`` numbers; they meet per chunk.
    """
    m = len(model.weight)
    schema = pa.schema([("chunk", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        total = None
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                votes = np.frombuffer(b"".join(part.column(0).to_pylist()), np.int8).reshape(-1, m)
                flat = Sums.of(votes, np.array(part.column(1)), model.posterior(votes), pairs).flat()
                flat = np.rint(flat).astype(np.int64)
                total = flat if total is None else total + flat
        if total is not None:
            parts = [total[k : k + CHUNK] for k in range(0, len(total), CHUNK)]
            yield pa.record_batch([list(range(len(parts))), parts], schema=schema)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "sums": [np.sum(np.stack(rows["sums"]), axis=0)]})

    fields = "chunk int, sums array<bigint>"
    rows = patterns.select("votes", "n").mapInArrow(run, fields).groupBy("chunk").applyInPandas(add, fields).collect()
    flat = np.zeros(2 + 4 * m + (2 * m * m if pairs else 0))
    for r in rows:
        flat[r.chunk * CHUNK : r.chunk * CHUNK + len(r.sums)] = r.sums
    return Sums.unflat(flat, m)


def fit_linear(rows: list[np.ndarray], before: np.ndarray, target: np.ndarray, rounds: int = 300, l2: float = 0.2) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of feature numbers with soft targets, shrunk towards the weights ``before``."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    width = len(before)
    w, b = before.copy(), float(np.log((target.sum() + 1) / (len(target) - target.sum() + 10)))
    seen, seen_b = np.full(width, 1e-3), 1e-3
    for _ in range(rounds):
        z = b + np.bincount(doc, w[col], len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.bincount(col, error[doc], width) + l2 * (w - before)
        seen += g**2
        seen_b += error.sum() ** 2
        w -= 0.5 * g / np.sqrt(seen)
        b -= 0.5 * error.sum() / np.sqrt(seen_b)
    return w, b


#: A blank keeps them apart from every word.
PATTERN_FEATURES = [f"pattern {name}" for name in PATTERNS]


class Scorer(dict):
    """token -> numbers of its known features; a bounded cache per worker."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, bias: float):
        super().__init__()
        self.features, self.weights, self.bias = features, weights.tolist(), bias
        self.lexicon = {features[w] for w in LEXICON}

    def __missing__(self, token: str) -> tuple:
        known = tuple(n for f in features_of(token) if (n := self.features.get(f)) is not None)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(token) <= 64:
            self[token] = known
        return known

    def numbers(self, text: str | None) -> set[int]:
        out = set().union(*map(self.__getitem__, tokens_of(text)))
        said = not out.isdisjoint(self.lexicon)
        return out.union(self.features[f] for f, hit in zip(PATTERN_FEATURES, patterns_of(text or "", said), strict=True) if hit)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[n] for n in sorted(self.numbers(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


@dataclass
class ToxicityModel:
    features: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, text: Column) -> Column:
        """Score of a text column, 0 to 1."""
        features, weights, bias = self.features, self.weights, self.bias

        @F.pandas_udf("double")
        def run(parts: pd.Series) -> pd.Series:
            scorer = _SCORERS.get(id(features)) or _SCORERS.setdefault(id(features), Scorer(features, weights, bias))
            return pd.Series([scorer.score(t) for t in parts], dtype="float64")

        return run(text)


_SCORERS: dict[int, Scorer] = {}


def is_held_out(id_col: Column, modulus: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, bound: int) -> DataFrame:
    """At most ``bound`` rows (id, text, toxic) for learning."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").alias("toxic")).where("id is not null and toxic is not null")
    known = known.where(~is_held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    # The smallest hashes, cut to little more than the bound before they are ordered: one task orders no more.
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 31))
    share = 1.25 * bound / max(known.count(), 1)
    near = known.withColumn("place", place).where(F.col("place") < F.lit(int((1 << 31) * min(share, 1.0))))
    chosen = near.orderBy("place", "id").limit(bound).drop("place")  # a bounded table: broadcast
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    # The bound is one of rows: repeats of a row are one, and of many texts under the chosen ids the smallest hashes stay.
    rows = rows.withColumn("print", F.xxhash64("id", "text"))
    one = rows.groupBy("id", "print").agg(F.min(F.struct("text", "toxic")).alias("r"))
    return one.orderBy("print", "id").limit(bound).select("id", "r.text", "r.toxic")


def _feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of each class per feature, combined per slice before the shuffle."""
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches):
        for rows in python_rows(batches):
            sides = (Counter(), Counter())
            for text, toxic in rows:
                sides[1 - toxic].update({f for t in tokens_of(text) for f in features_of(t)})
            names = list(sides[0] | sides[1])
            yield pa.record_batch([names, [sides[0][f] for f in names], [sides[1][f] for f in names]], schema=schema)

    counted = sample.select("text", "toxic").mapInArrow(run, "feature string, toxic bigint, clean bigint")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    sample = written(_sample(docs, labels, id_col, text_col, max_labelled), "labelled")
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    t, c = F.col("toxic"), F.col("clean")
    odds = F.log((t + 0.5) / (pos + 1.0)) - F.log((c + 0.5) / (neg + 1.0))
    evidence = F.abs(odds) / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    counts = _feature_counts(sample).where(t + c >= MIN_SUPPORT).select("feature", "toxic", "clean", odds.alias("odds"), evidence.alias("evidence"))
    top = counts.orderBy(F.desc("evidence"), "feature").limit(MAX_FEATURES).collect()
    names = list(dict.fromkeys([*LEXICON, *PATTERN_FEATURES, *(r.feature for r in top)]))
    features = {f: n for n, f in enumerate(names)}
    before = np.array([LEXICON_WEIGHT] * len(LEXICON) + list(PATTERNS.values()) + [0.0] * (len(names) - len(LEXICON) - len(PATTERNS)))
    # A found voter is right on at least four of five documents it votes on.
    found = [r.feature for r in top if r.odds > 0 and r.toxic >= 4 * max(r.clean, 1)][:MAX_VOTERS]
    patterns = written(vote_patterns(docs, found, text_col), "votes")
    documents = patterns.agg(F.sum("n")).first()[0] or 0
    if not documents:
        return ToxicityModel(features, before, -LEXICON_WEIGHT / 2)
    rows = _observed(sample, features, found)
    gold = np.array([r[0] for r in rows])
    model = label_model(patterns, documents, np.array([r[1] for r in rows], np.int8).reshape(len(rows), Voters(found).size), gold)
    if not rows:
        rows = _observed(_unlabelled(docs, id_col, text_col, documents, max_labelled), features, found)
    posterior = model.posterior(np.array([r[1] for r in rows], np.int8))
    weights, bias = fit_linear([r[2] for r in rows], before, with_labels(posterior, gold) if len(gold) else posterior)
    return ToxicityModel(features, weights, bias)


def label_model(patterns: DataFrame, documents: int, votes: np.ndarray, gold: np.ndarray) -> LabelModel:
    """The label model over all ``documents`` behind ``patterns``, of which the rows ``votes`` carry the labels ``gold``."""
    n, one = len(gold), np.ones(len(gold))
    if not n:
        start = believed(Voters([]).size)
        return maximise(pattern_sums(patterns, start, True), lambda m, pairs: pattern_sums(patterns, m, pairs))
    share = min(1.0, n / max(documents - n, 1))

    def step(model: LabelModel, pairs: bool) -> Sums:
        p = model.posterior(votes)
        labelled = Sums.of(votes, one, with_labels(p, gold), pairs)
        # The labelled rows are among all rows: what they add without their labels is taken off again.
        unlabelled = pattern_sums(patterns, model, pairs).plus(Sums.of(votes, one, p, pairs), -1.0)
        return labelled.plus(unlabelled, share)

    return maximise(Sums.of(votes, one, np.where(gold > 0, GOLD, 1 - GOLD), True), step)


def _unlabelled(docs: DataFrame, id_col: str, text_col: str, documents: int, bound: int) -> DataFrame:
    """At most ``bound`` different texts (id, text, toxic null), those of the smallest hashes."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("print", F.xxhash64("text")).withColumn("place", F.pmod("print", F.lit(1 << 31)))
    # Copies share a print, so the cut by place is repeated with a wider share until it holds enough prints or all.
    share = min(1.0, 1.25 * bound / documents)
    while share < 1.0 and _near(rows, share).select("print").distinct().count() < bound:
        share = min(1.0, 4 * share)
    one = _near(rows, share).groupBy("place", "print").agg(F.min(F.struct("text", "id")).alias("r"))
    return one.orderBy("place", "print").limit(bound).select("r.id", "r.text", F.lit(None).cast("int").alias("toxic"))


def _near(rows: DataFrame, share: float) -> DataFrame:
    return rows.where(F.col("place") < F.lit(int((1 << 31) * share)))


def _observed(sample: DataFrame, features: dict[str, int], found: list[str]) -> list[tuple]:
    """(label, votes, feature numbers) of a bounded sample, computed on the executors."""
    schema = pa.schema([("toxic", pa.int32()), ("votes", pa.binary()), ("numbers", pa.binary())])

    def run(batches):
        scorer, voters = Scorer(features, np.zeros(len(features)), 0.0), Voters(found)
        for rows in python_rows(batches):
            out = []
            for text, toxic in rows:
                numbers = np.array(sorted(scorer.numbers(text)), dtype=np.int32)
                out.append((toxic, voters.votes(text).tobytes(), numbers.tobytes()))
            yield pa.record_batch(list(map(list, zip(*out, strict=True))), schema=schema)

    ordered = sample.orderBy("id", F.xxhash64("text")).select("text", "toxic")
    got = ordered.mapInArrow(run, "toxic int, votes binary, numbers binary").collect()
    return [(r.toxic, np.frombuffer(bytes(r.votes), np.int8), np.frombuffer(bytes(r.numbers), np.int32)) for r in got]


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``."""
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), model.score(F.col(text_col)).alias("score"))
    return rows.select(
        F.col("id").alias(id_col), is_held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def acceptable(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns kept."""
    return docs.where(fit(docs, labels, id_col, text_col).score(docs[text_col]) < 0.5)
