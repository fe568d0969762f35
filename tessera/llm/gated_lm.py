"""Language-model scores from a gated recurrent network (operator 10).

**Counts** of all training tokens come from one aggregate that is combined per
task before the shuffle. They give the unigram base, the vocabulary and the
output classes.

**Model.** A gated recurrent unit reads words; its output is factored:
P(word) = P(class | state) * P(word | class). The ``HEAD`` most frequent words
lie in small classes with a softmax of their own over the state. All other
words, known or not, fall into classes by their ending and are distributed
inside a class by their counts with one place for unseen words, so the model
covers an open vocabulary and its probabilities add up to one.

**Training** is truncated backpropagation in numpy over every training
document in synchronised rounds. Documents are dealt evenly into replicas of a
fixed number of tokens, however the table is partitioned. The replicas of a
round start from the same weights, run once over their own documents with the
state carried from window to window, and are averaged by tokens in a Spark
aggregate, parameter by parameter; the next round starts from the average. There
are as many rounds as replicas in a round, so updates grow with the corpus.

**Reading** turns every text into numbers once; training and scoring start from those. Words are cut, counted and looked
up as Arrow arrays of many texts, never as Python objects one by one.

**Scoring** carries the state through the whole document. The frequent words'
counts (``COUNTED`` of them, a bound) travel to every task; the counts of all
other words are joined to the documents' remaining words, so nothing that grows
with the vocabulary is broadcast, and no word of the join is frequent.

Defined results: null and empty texts are one end token; rows without an id are
never held out; repeated rows are scored each; without training tokens every
word is unseen and the score is the base score; an empty table gives an empty
result; other columns are ignored whatever their names; texts are read whole.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import python_rows, written

HELD_OUT, REMAINDER = 5, 1
#: Words with an output of their own, words per head class, classes of endings, letters of an ending.
HEAD = 256
CLASS_WORDS = 16
ENDINGS = 24
ENDING = 3
#: Frequent words whose counts every task holds.
COUNTED = 1 << 17
HIDDEN = 16
LANES = 256
WINDOW = 16
RATE, SEEN = 0.04, 0.03
#: Words after which training starts a long document's state anew, so that one document does not hold up all lanes.
PART = 2048
#: Training tokens of a replica of the network in one round.
REPLICA_TOKENS = 1 << 19
#: Documents turned into lanes at a time, and words held by a task before it counts them and gives the counts out.
SLICE = 6144
HELD_WORDS = 3_000_000
#: Bytes of text cut into words at a time; a longer text goes alone.
PIECE = 1 << 22
END = "\n"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, between ASCII blanks with A-Z lowered, and their number per text.

    The end is not among them.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes, words = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten()
    # A text that starts or ends with a blank, or is empty, gives empty words.
    full = pc.greater(pc.binary_length(words), 0)
    empty = np.flatnonzero(~full.to_numpy(zero_copy_only=False))
    if len(empty):
        sizes -= np.bincount(np.searchsorted(np.cumsum(sizes), empty, "right"), minlength=len(sizes))
        words = words.filter(full)
    return words, sizes


def _pieces(batches, column: int):
    """Record batches with up to ``PIECE`` bytes in the text ``column``, or one longer text, whatever the batches are."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, before + PIECE - size, "right"))
            if to == at and held:
                yield pa.concat_batches(held)
                held, size = [], 0
                continue
            to = max(to, at + 1)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
    if held:
        yield pa.concat_batches(held)


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % HELD_OUT == REMAINDER, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``texts`` (text), the end among the words."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out(words: list[pa.Array], rows: int):
        found = pa.chunked_array(words, pa.string()).value_counts()
        word, n = found.field("values"), found.field("counts")
        return pa.record_batch([pa.concat_arrays([word, pa.array([END])]), pa.concat_arrays([n, pa.array([rows])])], schema=schema)

    def run(batches):
        held, size, rows = [], 0, 0
        for piece in _pieces(batches, 0):
            words, _ = words_of(piece.column(0))
            held.append(words)
            size, rows = size + len(words), rows + piece.num_rows
            if size >= HELD_WORDS:
                yield out(held, rows)
                held, size, rows = [], 0, 0
        if rows:
            yield out(held, rows)

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Layout:
    """Words and classes: what a task needs to know about the vocabulary. Every part is bounded."""

    total: int
    types: int
    head: list[str]  # the end first, then by ending
    endings: list[str]
    counts: dict[bytes, int]  # of the most frequent words
    class_total: np.ndarray  # training tokens per ending class, without head words
    class_types: np.ndarray
    number: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        self.head_classes = -(-len(self.head) // CLASS_WORDS)
        self.classes = self.head_classes + len(self.endings) + 1
        self.inputs = len(self.head) + len(self.endings) + 2  # head words, endings, other endings, start
        self.ending_number = {e: len(self.head) + i for i, e in enumerate(self.endings)}
        self.number = {w.encode("utf-8"): i for i, w in enumerate(self.head)}
        for w in self.counts:
            self.number.setdefault(w, self.by_ending(w))

    def by_ending(self, word: bytes) -> int:
        return self.ending_number.get(word.decode("utf-8")[-ENDING:], len(self.head) + len(self.endings))

    def by_endings(self, words: pa.Array) -> np.ndarray:
        """Input numbers by the endings of words that are not counted."""
        at = pc.index_in(pc.utf8_slice_codeunits(words, -ENDING), value_set=pa.array(self.endings, pa.string()))
        return len(self.head) + at.fill_null(len(self.endings)).to_numpy()

    def class_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers < len(self.head), numbers // CLASS_WORDS, numbers - len(self.head) + self.head_classes)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.total + 0.5 * (self.types + 1)))


def _frequent(counts: DataFrame) -> list:
    """All words from some count on, at most ``COUNTED``; always the end.

    The count comes from a histogram of counts in steps of a sixteenth of a doubling, a table of bounded size, so
    neither a task nor the driver sees more than the words that are kept, however many partitions there are.
    """
    step = F.floor(F.log2("n") * 16)
    held, lowest = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.step):
        held += r.words
        if held > COUNTED - 1:
            break
        lowest = r.step
    frequent = step >= lowest if lowest is not None else F.lit(False)
    return counts.where(frequent | (F.col("word") == END)).collect()


def layout_of(counts: DataFrame) -> Layout:
    """Reads the bounded parts of the counts: the most frequent words, endings and class totals."""
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = sorted(_frequent(counts), key=lambda r: (-r.n, r.word))
    frequent = [r.word for r in top if r.word != END][: HEAD - 1]
    head = [END, *sorted(frequent, key=lambda w: (w[-ENDING:], w))]
    rest = counts.where(~F.col("word").isin(head))
    ending = F.substring("word", -ENDING, ENDING).alias("ending")
    per_ending = written(rest.groupBy(ending).agg(F.sum("n").alias("n"), F.count("*").alias("types")), "endings")
    largest = per_ending.orderBy(F.desc("n"), "ending").limit(ENDINGS - 1).collect()
    endings = [r.ending for r in largest]
    others = per_ending.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    n, k = [r.n for r in largest], [r.types for r in largest]
    return Layout(
        total, types, head, endings, {r.word.encode("utf-8"): r.n for r in top},
        np.array([*n, others[0] - sum(n)], dtype=float), np.array([*k, others[1] - sum(k)], dtype=float),
    )


class Network:
    """Gated recurrent unit with a class-factored softmax. ``w`` maps parameter names to float32 arrays."""

    def __init__(self, layout: Layout, w: dict[str, np.ndarray] | None = None):
        self.layout = layout
        self.w = w or self._start()

    def _start(self) -> dict[str, np.ndarray]:
        """Small fixed random weights; output biases say what the counts say."""
        v, rng, h = self.layout, np.random.default_rng(7), HIDDEN
        head = np.array([v.counts.get(w.encode("utf-8"), 0) for w in v.head], dtype=float)
        padded = np.full(v.head_classes * CLASS_WORDS, -30.0)
        padded[: len(head)] = np.log(head + 0.5)
        inside = padded.reshape(v.head_classes, CLASS_WORDS)
        mass = np.concatenate([np.log(np.exp(inside).sum(axis=1)), np.log(v.class_total + 0.5 * (v.class_types + 1))])
        w = {
            "input": rng.normal(0, 0.3, (v.inputs, 3 * h)),
            "recur": rng.normal(0, 0.3, (h, 3 * h)),
            "class": rng.normal(0, 0.05, (h, v.classes)),
            "class_bias": mass - np.log(np.exp(mass - mass.max()).sum()) - mass.max(),
            "word": rng.normal(0, 0.05, (v.head_classes, h, CLASS_WORDS)),
            "word_bias": inside,
        }
        return {k: x.astype(np.float32) for k, x in w.items()}

    def step(self, state: np.ndarray, read: np.ndarray):
        """One unit step from words: new state, and what the way back needs."""
        state, *memo = self._step(state.T, self.w["input"][read].T, self.w["recur"].T)
        return state.T, memo

    def _step(self, state: np.ndarray, x: np.ndarray, recur: np.ndarray):
        """New state, gates, candidate state and its recurrent part; features x lanes."""
        h = HIDDEN
        u = recur @ state
        gates = x[: 2 * h] + u[: 2 * h]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        new = gates[:h] * u[2 * h :]
        new += x[2 * h :]
        np.tanh(new, out=new)
        after = state - new
        after *= gates[h:]
        after += new
        return after, gates, new, u[2 * h :]

    def output(self, states: np.ndarray, target: np.ndarray, real: np.ndarray, learn: bool = False):
        """Natural-log probability of each target given its state (0 where not ``real``); the way back if ``learn``."""
        logp, grads, back = self._output(states.T, target, real, learn)
        return logp, grads, None if back is None else back.T

    def _output(self, states: np.ndarray, target: np.ndarray, real: np.ndarray, learn: bool):
        """``output`` over features x states, so that sums over classes run along the states."""
        v, w = self.layout, self.w
        cls = v.class_of(target).astype(np.int16)
        at = np.arange(len(target))
        p = w["class"].T @ states
        p += w["class_bias"][:, None]
        p -= p.max(axis=0)
        logp = p[cls, at]
        np.exp(p, out=p)
        total = p.sum(axis=0)
        logp -= np.log(total)
        grads, back = {}, None
        if learn:
            p *= real / total
            p[cls, at] -= real
            grads["class"], grads["class_bias"] = states @ p.T, p.sum(axis=1)
            back = w["class"] @ p
            grads["word"], grads["word_bias"] = np.zeros_like(w["word"]), np.zeros_like(w["word_bias"])
        # States of the head words by class: a product per class, everything else at once.
        cls[~real] = v.head_classes
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(v.head_classes + 1))
        order = order[: edges[-1]]
        s, word, k = states.T[order], target[order] % CLASS_WORDS, at[: len(order)]
        inner = w["word_bias"][cls[order]]
        spans = [(c, slice(edges[c], edges[c + 1])) for c in range(v.head_classes) if edges[c] < edges[c + 1]]
        for c, rows in spans:
            inner[rows] += s[rows] @ w["word"][c]
        inner -= inner.max(axis=1, keepdims=True)
        picked = inner[k, word]
        np.exp(inner, out=inner)
        sums = inner @ np.ones(CLASS_WORDS, inner.dtype)
        logp[order] += picked - np.log(sums)
        if learn:
            inner /= sums[:, None]
            inner[k, word] -= 1
            way = np.empty_like(s)
            for c, rows in spans:
                grads["word"][c], grads["word_bias"][c] = s[rows].T @ inner[rows], inner[rows].sum(axis=0)
                np.matmul(inner[rows], w["word"][c].T, out=way[rows])
            back[:, order] += way.T
        logp[~real] = 0
        return logp, grads, back

    def window(self, state: np.ndarray, read: np.ndarray, target: np.ndarray, fresh: np.ndarray, real: np.ndarray, learn: bool):
        """Lanes x steps. ``fresh``: a document begins, the state starts anew. Returns (log p, last state, gradients)."""
        lanes, steps = read.shape
        h, kind = HIDDEN, self.w["input"].dtype
        state, recur = state.T, np.ascontiguousarray(self.w["recur"].T)
        words, goes_on, inputs = np.ascontiguousarray(read.T), (~fresh.T).astype(kind), np.ascontiguousarray(self.w["input"].T)
        # A feature's lanes lie side by side.
        states = np.empty((h, steps, lanes), kind)
        if learn:
            shape = (steps, h, lanes)
            before, new, un = np.empty(shape, kind), np.empty(shape, kind), np.empty(shape, kind)
            gates = np.empty((steps, 2 * h, lanes), kind)
        for t in range(steps):
            state = state * goes_on[t]
            x = inputs.take(words[t], axis=1)
            if learn:
                before[t] = state
                state, gates[t], new[t], un[t] = self._step(state, x, recur)
            else:
                state = self._step(state, x, recur)[0]
            states[:, t] = state
        logp, grads, back = self._output(states.reshape(h, -1), target.T.ravel(), real.T.ravel(), learn)
        logp = logp.reshape(steps, lanes).T
        if not learn:
            return logp, state.T, None
        back = back.reshape(h, steps, lanes)
        # Everything that does not depend on the way back, for all steps at once.
        reset, keep = gates[:, :h], gates[:, h:]
        to_new = (1 - keep) * (1 - new * new)
        to_reset = un * reset * (1 - reset)
        to_keep = (before - new) * keep * (1 - keep)
        d_in = np.empty((steps, lanes, 3 * h), kind)
        du = np.empty((3 * h, lanes), kind)
        grads["recur"] = np.zeros_like(self.w["recur"])
        d = np.zeros((h, lanes), kind)
        for t in reversed(range(steps)):
            d = d + back[:, t]
            np.multiply(d, to_new[t], out=du[2 * h :])
            np.multiply(d, to_keep[t], out=du[h : 2 * h])
            np.multiply(du[2 * h :], to_reset[t], out=du[:h])
            d_in[t] = du.T
            du[2 * h :] *= reset[t]
            grads["recur"] += before[t] @ du.T
            d *= keep[t]
            d += self.w["recur"] @ du
            d *= goes_on[t]
        words = words.ravel()
        order = np.argsort(words.astype(np.int16) if self.layout.inputs < 1 << 15 else words, kind="stable")
        first = np.flatnonzero(np.diff(words[order], prepend=-1))
        grads["input"] = (words[order][first], np.add.reduceat(d_in.reshape(-1, 3 * h)[order], first, axis=0))
        return logp, state.T, grads


def lanes_of(documents: list[np.ndarray], lanes: int, start: int):
    """Documents dealt over lanes, longest first: (read, target, fresh, document) arrays, lanes by falling length."""
    heap, dealt = [(0, k) for k in range(min(lanes, len(documents)))], [[] for _ in range(min(lanes, len(documents)))]
    for d in sorted(range(len(documents)), key=lambda i: -len(documents[i])):
        size, k = heapq.heappop(heap)
        dealt[k].append(d)
        heapq.heappush(heap, (size + len(documents[d]), k))
    dealt.sort(key=lambda ds: -sum(len(documents[d]) for d in ds))
    lengths = np.array([sum(len(documents[d]) for d in ds) for ds in dealt])
    shape = (len(dealt), int(lengths[0]) if len(dealt) else 0)
    target, read, owner = np.zeros(shape, np.int32), np.full(shape, start, np.int32), np.zeros(shape, np.int32)
    fresh = np.zeros(shape, bool)
    for k, ds in enumerate(dealt):
        at = 0
        for d in ds:
            n = len(documents[d])
            target[k, at : at + n] = documents[d]
            read[k, at + 1 : at + n] = documents[d][:-1]
            owner[k, at : at + n] = d
            fresh[k, at] = True
            at += n
    return read, target, fresh, owner, lengths


def run_lanes(net: Network, documents: list[np.ndarray], steps: int, lanes: int = LANES, learn=None) -> np.ndarray:
    """Natural-log probability of each document, its state carried across windows. ``learn`` receives each window's gradients."""
    read, target, fresh, owner, lengths = lanes_of(documents, lanes, net.layout.inputs - 1)
    total = np.zeros(len(documents))
    state = np.zeros((len(lengths), HIDDEN), np.float32)
    at = 0
    while at < read.shape[1]:
        # Lanes that have ended are left out from the next window on; inside a window their steps do not count.
        active = int((lengths > at).sum())
        to = min(at + steps, read.shape[1])
        cut = (slice(0, active), slice(at, to))
        real = np.arange(at, to) < lengths[:active, None]
        logp, state, grads = net.window(state[:active], read[cut], target[cut], fresh[cut], real, learn is not None)
        total += np.bincount(owner[cut].ravel(), logp.ravel().astype(float), len(documents))
        if learn is not None:
            learn(grads, int(real.sum()))
        at = to
    return total


class Adagrad:
    def __init__(self, net: Network):
        self.w, self.seen = net.w, {k: np.full_like(x, SEEN) for k, x in net.w.items()}
        self.tokens = 0

    def __call__(self, grads: dict, tokens: int) -> None:
        self.tokens += tokens
        scale = 1 / max(tokens, 1) ** 0.5
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            g = g * scale
            self.seen[k][at] += g * g
            self.w[k][at] -= RATE * g / np.sqrt(self.seen[k][at])


def _slices(batches):
    """Lists of up to ``SLICE`` rows across Arrow batches."""
    held: list[tuple] = []
    for rows in python_rows(batches):
        held += rows
        if len(held) >= SLICE:
            yield held
            held = []
    if held:
        yield held


def _dealt(texts: DataFrame, replicas: int, rounds: int) -> DataFrame:
    """(numbers, replica, round): read documents in parts of at most ``PART`` words, dealt evenly over the replicas whatever the files are."""
    size = 4 * PART  # bytes of a part
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("numbers") - 1) / size).cast("int"))
    part = F.explode(F.transform(starts, lambda i: F.substring("numbers", i * size + 1, F.lit(size))))
    dealt = texts.select(part.alias("numbers")).repartition(replicas).withColumn("replica", F.spark_partition_id())
    return written(dealt.withColumn("round", F.col("replica") % rounds), "lm-parts", "round")


def _replicas(batches):
    """Lists of a replica's parts; a replica is one file, so its rows follow one another."""
    held, at = [], None
    for rows in python_rows(batches):
        for numbers, replica in rows:
            if replica != at and held:
                yield held
                held = []
            at = replica
            held.append(np.frombuffer(numbers, np.int32))
    if held:
        yield held


def train(texts: DataFrame, layout: Layout) -> dict[str, np.ndarray]:
    """Weights after one pass over all documents (``numbers``) in synchronised rounds.

    The corpus is dealt into replicas of about ``REPLICA_TOKENS``, these into as many rounds as a round has replicas.
    Each round starts from the average (by tokens) of the round before, step sizes included.
    """
    w = Network(layout).w
    if not layout.total:
        return w
    replicas = -(-layout.total // REPLICA_TOKENS)
    rounds = math.ceil(replicas**0.5)
    parts = _dealt(texts, replicas, rounds)
    slim = replace(layout, counts={}, number={})
    seen = {k: np.full_like(x, SEEN) for k, x in w.items()}
    for r in range(rounds):
        w, seen = _round(parts.where(F.col("round") == r).select("numbers", "replica"), slim, w, seen)
    return w


def _round(parts: DataFrame, layout: Layout, w: dict[str, np.ndarray], seen: dict[str, np.ndarray]) -> tuple[dict, dict]:
    """Average weights and squared gradients of the replicas of one round; as given without any parts."""
    names = list(w)

    def run(batches):
        tokens, total = 0, 0.0  # of all replicas of this task
        for documents in _replicas(batches):
            learner = Adagrad(Network(layout, {k: x.copy() for k, x in w.items()}))
            learner.seen = {k: x.copy() for k, x in seen.items()}
            run_lanes(Network(layout, learner.w), documents, WINDOW, learn=learner)
            flat = np.concatenate([x[k].ravel() for x in (learner.w, learner.seen) for k in names]).astype(np.float64)
            tokens, total = tokens + learner.tokens, total + flat * learner.tokens
        if tokens:
            yield pa.record_batch([pa.array([tokens], pa.int64()), pa.array([total])], names=["tokens", "weights"])

    trained = written(parts.mapInArrow(run, "tokens bigint, weights array<double>"), "lm-replicas")
    tokens = trained.agg(F.sum("tokens")).first()[0]
    if not tokens:
        return w, seen
    # One row per parameter and task is summed; the driver gets one row per parameter, as many as the network has.
    summed = trained.select(F.posexplode("weights").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    flat = summed.orderBy("at").select("x").toPandas()["x"].to_numpy() / tokens
    out, at = ({}, {}), 0
    for held in out:
        for k in names:
            held[k] = flat[at : at + w[k].size].reshape(w[k].shape).astype(np.float32)
            at += w[k].size
    return out


READ = (
    "row bigint, id bigint, held_out boolean, n_tokens bigint, known bigint, base double, model double, numbers binary, "
    "rest array<struct<word: string, class: int, n: int>>"
)


def _read(docs: DataFrame, layout: Layout) -> DataFrame:
    """Every text turned into numbers, once: the network's input numbers, the frequent words' part of the counts, and
    the other words listed."""

    def run(batches):
        counts = dict(layout.counts)
        known_end = int(END.encode() in counts)
        counts.setdefault(END.encode(), 0)
        place = {w: i for i, w in enumerate(counts)}
        n = np.array(list(counts.values()), dtype=float)
        number = np.array([layout.number.get(w, 0) for w in counts], np.int32)
        base_of = layout.base(n)
        inside, n_head = layout.class_total + 0.5 * (layout.class_types + 1), len(layout.head)
        k = number - n_head
        model_of = np.where(k < 0, 0.0, np.log10((n + 0.5) / inside[np.maximum(k, 0)]))
        end = place[END.encode()]
        words_of_counts = pa.array([w.decode("utf-8") for w in counts], pa.string())
        row = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
        for piece in _pieces(batches, 2):
            words, sizes = words_of(piece.column(2))
            # Every text's words and its end, one text after the other.
            ends = np.cumsum(sizes + 1) - 1
            starts = ends - sizes
            is_word = np.ones(int(ends[-1]) + 1, bool)
            is_word[ends] = False
            at = np.full(len(is_word), end, np.int32)
            at[is_word] = pc.index_in(words, value_set=words_of_counts).fill_null(-1).to_numpy()
            lost = np.flatnonzero(at < 0)
            numbers = number[at].astype(np.int32)
            base, model = base_of[at], model_of[at]
            base[lost], model[lost] = 0, 0
            rest = words.take(pa.array(lost - np.searchsorted(ends, lost))).dictionary_encode()
            distinct, code = rest.dictionary, rest.indices.to_numpy()
            by_ending = layout.by_endings(distinct)
            numbers[lost] = by_ending[code]
            # Lost words once per text, with their number.
            owner = np.searchsorted(ends, lost)
            pairs, times = np.unique(owner * max(len(distinct), 1) + code, return_counts=True)
            owner, code = np.divmod(pairs, max(len(distinct), 1))
            offsets = np.searchsorted(owner, np.arange(piece.num_rows + 1)).astype(np.int32)
            listed = pa.StructArray.from_arrays(
                [distinct.take(pa.array(code)), pa.array((by_ending[code] - n_head).astype(np.int32)), pa.array(times.astype(np.int32))], names=["word", "class", "n"]
            )
            known = sizes + known_end - np.bincount(np.searchsorted(ends, lost), minlength=piece.num_rows)
            bytes_at = np.append(0, 4 * (ends + 1)).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, pa.py_buffer(bytes_at), pa.py_buffer(numbers)])
            arrays = [
                pa.array(np.arange(row, row + piece.num_rows)), piece.column(0), piece.column(1), pa.array(sizes + 1), pa.array(known),
                pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(model, starts)), binary,
                pa.ListArray.from_arrays(pa.array(offsets), listed),
            ]
            row += piece.num_rows
            yield pa.record_batch(arrays, names=["row", "id", "held_out", "n_tokens", "known", "base", "model", "numbers", "rest"])

    return docs.select("id", "held_out", "text").mapInArrow(run, READ)


def _network_scores(texts: DataFrame, layout: Layout, weights: dict[str, np.ndarray]) -> DataFrame:
    """The read texts with the network's log10 probability added to ``model``."""
    slim = replace(layout, counts={}, number={})
    names = ["row", "id", "held_out", "n_tokens", "known", "base", "model"]

    def run(batches):
        net = Network(slim, weights)
        for rows in _slices(batches):
            scores = run_lanes(net, [np.frombuffer(r[7], np.int32) for r in rows], 4 * WINDOW) / np.log(10)
            columns = [list(c) for c in zip(*(r[:7] for r in rows), strict=True)]
            columns[6] = [m + s for m, s in zip(columns[6], scores.tolist(), strict=True)]
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return texts.select(*names, "numbers").mapInArrow(run, READ.split(", numbers")[0])


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    training = rows.where("not held_out").select("text")
    counts = written(count_words(training), "word-counts")
    layout = layout_of(counts)
    read = written(_read(rows, layout), "lm-read")
    weights = train(read.where("not held_out").select("numbers"), layout)
    first = _network_scores(read, layout, weights)
    # Words outside the frequent ones: none of them is hot, their counts come by a join.
    rest = read.select("row", F.inline("rest"))
    rest = rest.join(counts.withColumnRenamed("n", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    within = F.element_at(F.array(*map(F.lit, (layout.class_total + 0.5 * (layout.class_types + 1)).tolist())), F.col("class") + 1)
    everywhere = F.lit(layout.total + 0.5 * (layout.types + 1))
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_rest"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / everywhere)).alias("base_rest"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / within)).alias("model_rest"),
    )
    joined = first.join(rest, "row", "left")
    base = F.col("base") + F.coalesce("base_rest", F.lit(0.0))
    score = F.col("model") + F.coalesce("model_rest", F.lit(0.0)) if layout.total else base
    return joined.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("known_rest", F.lit(0))).alias("n_known"),
        F.lit(layout.total).cast("bigint").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
    )
