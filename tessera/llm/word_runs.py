"""Periodic run detection: internal pattern matching over dyadic blocks of words.

A run is a stretch of words with smallest period q, at least ``EXPONENT`` periods
and ``LEAST`` words long, that no neighbouring word extends.

**Method.** Prefix doubling ranks the word sequence: level k gives every place the
class of the 2^k words from there, the last level the suffix array. A run of
period q in [m, 2m), m = 2^k, holds an aligned block of m words in its first 2m
words, and the same words q later. So each aligned block that is no one's only
copy asks for its occurrences in the neighbouring window: the block's class is a
range of the suffix array, and a wavelet tree over that array answers how many
places of the range lie in the window and which comes next (range successor).
Occurrences of a block that start within its own length form an arithmetic
progression: two or fewer are candidate periods themselves; for more, the
progression lies in one stretch of a smaller period, and only a shift that
carries an end of the stretch around the block to the same end of that stretch
can be the period. Periods below the first level's block are read off that
block's occurrences within its length. Candidates are verified and extended by
longest common extensions over the ranks; of equal stretches the smallest period stays.

**Scale.** A document is one row and the work O(n log^2 n) at worst, a few levels
for ordinary text. A task reads documents in batches of about ``WORDS`` words
joined by unique separators, so short texts share the vectorised steps and no run
crosses a border; only a longer text is handled alone. Memory is O(w log w) for a
batch of w words. The job has no shuffle, so no key or group of copies matters.

Defined results: words are cut at ASCII blanks, kept as they are. A null or blank
text has no words and no runs. ``runs`` is ordered by start, then period, and
empty, never null; ``collapsed`` is never null. Repeated rows give repeated rows;
null ids stay null; an empty table gives an empty result; other columns are
ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import python_rows

LEAST = 24
EXPONENT = 3
#: Words of a batch; a longer document is a batch of its own.
WORDS = 1 << 16
_BLANKS = r"[\x20\x09-\x0D]+"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Ranks:
    """Classes of all substrings of 2^k words, and the suffix array. The last word must be unique."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n = n
        order = np.argsort(words)
        key = words[order]
        place = np.arange(n)
        group = place  # sorted places that are still in a class of several
        self.levels: list[np.ndarray] = []
        rank = np.zeros(n, np.int32)
        width = 0
        while True:
            new = np.ones(len(group), bool)
            new[1:] = key[1:] != key[:-1]
            rank = rank.copy()
            rank[order[group]] = np.maximum.accumulate(np.where(new, group, 0))
            alone = new & np.append(new[1:], True)
            group = group[~alone]
            if not len(group):
                break
            # The class of a place past the end never equals one: the last word is unique.
            self.levels.append(np.append(rank, np.int32(-1)))
            width = 2 * width or 1
            part = order[group]
            key = rank[part].astype(np.int64) * (n + 1) + rank[np.minimum(part + width, n - 1)]
            sort = np.argsort(key)
            order[group], key = part[sort], key[sort]
        self.suffixes = order

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i < j <= n."""
        at, to = i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            step = (level[at] == level[to]).astype(np.int64) << k
            at += step
            to += step
        return at - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of the prefixes that end with i < j."""
        at, to = i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, back = self.levels[k], (1 << k) - 1
            same = (at >= back) & (level[np.maximum(at - back, 0)] == level[np.maximum(to - back, 0)])
            step = same.astype(np.int64) << k
            at -= step
            to -= step
        return i - at


class Wavelet:
    """Wavelet tree (one bit array a level) over the places of a suffix array."""

    def __init__(self, places: np.ndarray):
        self.bits = int(len(places)).bit_length()
        self.zeros: list[np.ndarray] = []
        now = places
        for bit in range(self.bits - 1, -1, -1):
            one = (now >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            now = np.concatenate([now[~one], now[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many entries of [lo, hi) are places before x."""
        count = np.zeros(len(lo), np.int64)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            left, right = zeros[lo], zeros[hi]
            one = (x >> bit) & 1 == 1
            count += np.where(one, right - left, 0)
            lo = np.where(one, zeros[-1] + lo - left, left)
            hi = np.where(one, zeros[-1] + hi - right, right)
        return count

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest place of [lo, hi), from 0; with ``below`` the successor of any place."""
        value = np.zeros(len(lo), np.int64)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            left, right = zeros[lo], zeros[hi]
            small = right - left
            one = n >= small
            value |= one.astype(np.int64) << bit
            n = np.where(one, n - small, n)
            lo = np.where(one, zeros[-1] + lo - left, left)
            hi = np.where(one, zeros[-1] + hi - right, right)
        return value


def _candidates(ranks: Ranks, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places b and periods q to verify; among them one for every run."""
    n, first = ranks.n, max(0, (least // exponent).bit_length() - 1)
    places: list[np.ndarray] = []
    periods: list[np.ndarray] = []
    tree = None

    def add(at: np.ndarray, period: np.ndarray, ok: np.ndarray) -> None:
        places.append(at[ok])
        periods.append(period[ok])

    for k in range(first, len(ranks.levels)):
        m = 1 << k
        rank = ranks.levels[k][:-1]
        size = np.bincount(rank, minlength=n)
        at = np.arange(0, n - m + 1, m)
        at = at[size[rank[at]] > 1]
        if not len(at):
            continue
        tree = tree or Wavelet(ranks.suffixes)
        lo = rank[at].astype(np.int64)
        hi = lo + size[lo]
        for near, far in ([(1, m), (m, 2 * m)] if k == first else [(m, 2 * m)]):
            before = tree.below(lo, hi, np.minimum(at + near, n))
            count = tree.below(lo, hi, np.minimum(at + far, n)) - before
            # Below the first block's own length every occurrence is a candidate, else at most two.
            for j in range(min(int(count.max()), m if near < m else 2)):
                some = count > j
                add(at[some], tree.nth(lo[some], hi[some], before[some] + j) - at[some], np.ones(int(some.sum()), bool))
            some = count > 2
            if near == m and some.any():
                b, low, high, skip = at[some], lo[some], hi[some], before[some]
                f = tree.nth(low, high, skip)
                g = tree.nth(low, high, skip + 1) - f
                right = f + ranks.ahead(f, f + g) - (b + ranks.ahead(b, b + g))
                left = (f - ranks.behind(f - 1, f + g - 1)) - (b - ranks.behind(b - 1, b + g - 1))
                for period in (right, left):
                    add(b, period, (period >= m) & (period < 2 * m) & (b + period < n))
    if not places:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate(places), np.concatenate(periods)


def find_runs(words: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of numbers, by start, then period. The last must be unique."""
    ranks = Ranks(words)
    at, period = _candidates(ranks, least, exponent)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    end = at + period + ranks.ahead(at, at + period)
    start = at - ranks.behind(at - 1, at + period - 1)
    keep = end - start >= np.maximum(least, exponent * period)
    rows = np.unique(np.stack([start, end, period], 1)[keep], axis=0)
    # A stretch that has a smaller period was found with that one, too.
    same = np.zeros(len(rows), bool)
    same[1:] = (rows[1:, :2] == rows[:-1, :2]).all(1)
    rows = rows[~same]
    rows = np.stack([rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words outside runs and those of each run's first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _handled(part: list[tuple], texts: list[list[bytes]], least: int, exponent: int) -> pa.RecordBatch:
    number: dict[bytes, int] = {}
    numbers: list[int] = []
    starts = [0]
    for i, words in enumerate(texts):
        numbers += [number.setdefault(w, len(number)) for w in words]
        numbers.append(-1 - i)  # a separator that occurs once
        starts.append(len(numbers))
    runs = find_runs(np.array(numbers, np.int64), least, exponent)
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    collapsed = []
    for i, words in enumerate(texts):
        lo, hi = edges[i], edges[i + 1]
        if hi > lo:
            runs[lo:hi, 0] -= starts[i]
            words = _kept(words, runs[lo:hi])
        collapsed.append(b" ".join(words).decode())
    fields = [pa.array(runs[:, c], pa.int64()) for c in range(3)]
    found = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_RUN)))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in part], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), found, pa.array(collapsed, pa.string())],
        ["id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(id, n_words, runs, collapsed) per row: its runs, and its words without the repeats in them, joined by one space."""

    budget = WORDS

    def map_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, texts, size = [], [], 0
        for rows in python_rows(batches):
            for row in rows:
                words = (row[1] or "").encode().split()
                if part and size + len(words) > budget:
                    yield _handled(part, texts, least, exponent)
                    part, texts, size = [], [], 0
                part.append(row)
                texts.append(words)
                size += len(words) + 1
        if part:
            yield _handled(part, texts, least, exponent)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(map_texts, schema)


def _planted(doc_id: Column, text: Column) -> Column:
    """The text the query looks at: one document in ten, by crc32 of its id, gets a periodic end."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, _BLANKS), lambda w: w != "")

    def ended(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        unit = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        tail = F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int"))), " ")

    # The words are bound once as a lambda's argument, not evaluated at each use.
    edited = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, ended(w))), 1)
    return F.when(h % 10 == 0, F.coalesce(edited, text)).otherwise(text)


def run_report(docs: DataFrame) -> DataFrame:
    """The query: runs of every document (one in ten with a planted periodic end) as numbers and digests."""
    planted = docs.select("doc_id", _planted(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("text"))
    found = periodic_runs(planted)

    def better(x: Column, y: Column) -> Column:
        # Greatest length / period, exactly; runs come by start, then period, so the first of equals stays.
        return F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x)

    best = F.when(F.size("runs") > 0, F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.element_at("runs", 1), better))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
