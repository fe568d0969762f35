"""Benchmark decontamination by a prefix-filtered set join (operator 4). DataFrame functions only.

A window is ``window`` consecutive words of an item (all words of a shorter
item). A document is contaminated where a window occurs in it, word for word.

1. Windows are split into shingles of up to ``shingle`` words. All documents are
   counted for these shingles: that orders them by rarity.
2. Containment of a whole window needs all its shingles, so its necessary prefix
   is one shingle, the rarest. A window whose rarest shingle occurs nowhere is
   dropped; the others are joined to the documents' shingles on it.
3. A candidate start follows from the shingle's place in the window; it must lie
   inside the document with the whole window behind it (positional and length
   bounds). Then the words themselves are compared.

The shingle table grows with the benchmark, not with the documents. It is
broadcast only if its counted rows are within ``broadcast_rows``; then
documents never move and the words are compared where they are exploded.
Beyond that, only (document, place, shingle) rows are shuffled, and candidates
meet their documents' words in a second join.

Items that share windows are listed once per distinct set of windows, not once
per document, so one passage in a third of all documents costs one listing.

Defined results: null and empty texts have no words and no hits; a null item
has no window; repeated document rows get equal results each; an item's null id
hits but is not listed; equal ids with different texts are kept apart by a hash of the
text; empty tables give no hits; other columns are ignored whatever their names.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

WINDOW = 10
SHINGLE = 3
#: Shingle rows of the benchmark up to which the table is broadcast (about 200 bytes each with its words).
BROADCAST_ROWS = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # a word before A-Z are lowered


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lowered, other letters as they are."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    at = lambda i: F.xxhash64(*(F.get(words, i + F.lit(k)) for k in range(size)), F.lit(size))
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - F.lit(size)), at)).otherwise(
        F.array().cast("array<bigint>")
    )


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, window: array<string>), distinct."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - F.lit(window), F.lit(0))
    starts = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.slice("words", i, F.lit(window)))
    return words.select("item_id", F.explode(starts).alias("window")).distinct()


class Decontaminator:
    """The windows of one benchmark, prepared for one corpus."""

    def __init__(
        self,
        docs: DataFrame,
        items: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        item_id: str = "item_id",
        item_text: str = "text",
        window: int = WINDOW,
        shingle: int = SHINGLE,
        broadcast_rows: int = BROADCAST_ROWS,
    ):
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.shingle, self.broadcast_rows = shingle, broadcast_rows
        listed = item_windows(items, item_id, item_text, window)
        with_id = listed.select("item_id", F.xxhash64("window", F.lit(1)).alias("w1"), F.xxhash64("window", F.lit(2)).alias("w2"), "window")
        self.listed = written(with_id, "benchmark-windows")
        #: Lengths of shingles in use: the full one, and the lengths of shorter windows. At most ``shingle`` values.
        sizes = self.listed.select(F.least(F.size("window"), F.lit(shingle)).alias("s")).distinct().collect()
        self.sizes = sorted(r.s for r in sizes) or [shingle]  # an empty benchmark matches nothing
        self.prefixes = self._prefixes()

    def _exploded(self, *keep: str) -> DataFrame:
        """(id, text_hash, n_words, place, shingle, + keep) for every shingle of every document."""
        docs = self.docs.select("id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
        places = lambda s: F.transform(_shingles(F.col("words"), s), lambda h, i: F.struct(i.alias("place"), h.alias("shingle")))
        if len(self.sizes) == 1:
            each = F.posexplode(_shingles(F.col("words"), self.sizes[0])).alias("place", "shingle")
            return docs.select("id", "text_hash", F.size("words").alias("n_words"), *keep, each)
        each = F.inline(reduce(F.concat, (places(s) for s in self.sizes)))
        return docs.select("id", "text_hash", F.size("words").alias("n_words"), *keep, each)

    def _small(self, df: DataFrame) -> tuple[DataFrame, bool]:
        small = df.count() <= self.broadcast_rows
        return (F.broadcast(df) if small else df.hint("shuffle_hash")), small

    def _prefixes(self) -> DataFrame:
        """(shingle, offset, window, w1, w2): each window with its rarest shingle that occurs in the documents."""
        distinct = self.listed.select("window", "w1", "w2").distinct()
        by_size = [
            distinct.where(F.least(F.size("window"), F.lit(self.shingle)) == s).select(
                "w1", "w2", "window", F.posexplode(_shingles(F.col("window"), s)).alias("offset", "shingle")
            )
            for s in self.sizes
        ]
        tokens = written(reduce(DataFrame.union, by_size), "benchmark-shingles")
        vocabulary, small = self._small(tokens.select("shingle").distinct())
        if small:
            counts = self._exploded().select("shingle").join(vocabulary, "shingle").groupBy("shingle").agg(F.count("*").alias("n"))
        else:
            counts = self._exploded().groupBy("shingle").agg(F.count("*").alias("n")).join(vocabulary, "shingle")
        counts = written(counts, "benchmark-rarity")
        rarest = F.min_by(F.struct("shingle", "offset", "window"), F.struct("n", "shingle", "offset"))
        # A shingle that occurs nowhere rules its windows out: they lack a count for at least one shingle.
        ranked = tokens.join(counts, "shingle", "left").groupBy("w1", "w2").agg(
            rarest.alias("p"), F.count("n").alias("present"), F.count("*").alias("shingles")
        )
        return written(ranked.where("present = shingles").select("p.shingle", "p.offset", "p.window", "w1", "w2"), "benchmark-prefixes")

    def matches(self) -> DataFrame:
        """(id, text_hash, start, end, w1, w2): every occurrence of a window; words start..end-1 (from 0) are hit."""
        prefixes, small = self._small(self.prefixes)
        start = F.col("place") - F.col("offset")
        bounds = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
        same = F.slice("words", start + 1, F.size("window")) == F.col("window")
        keep = ["id", "text_hash", start.alias("start"), (start + F.size("window")).alias("end"), "w1", "w2"]
        if small:
            return self._exploded("words").join(prefixes, "shingle").where(bounds & same).select(*keep).distinct()
        found = self._exploded().join(prefixes, "shingle").where(bounds).select("id", "text_hash", "place", "offset", "window", "w1", "w2")
        docs = self.docs.select("id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
        on = [F.col("f.id").eqNullSafe(F.col("d.id")), F.col("f.text_hash") == F.col("d.text_hash")]
        both = found.alias("f").join(docs.alias("d"), on).select("f.*", "words")
        return both.where(same).select(*keep).distinct()

    def hits(self) -> DataFrame:
        """(id, text_hash, n_hit, windows): one row per contaminated document, its hit words and sorted window set."""
        spans = self.matches().groupBy("id", "text_hash").agg(
            F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"),
            F.array_sort(F.collect_set(F.struct("w1", "w2"))).alias("windows"),
        )
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
        covered = F.aggregate(
            "spans",
            zero,
            lambda a, x: F.struct(
                (a.n + F.greatest(x.end - F.greatest(x.start, a.upto), F.lit(0))).alias("n"), F.greatest(a.upto, x.end).alias("upto")
            ),
            lambda a: a.n.cast("bigint"),
        )
        return spans.select("id", "text_hash", covered.alias("n_hit"), "windows")

    def report(self) -> DataFrame:
        """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every document row."""
        hits = written(self.hits().withColumn("set", F.sha2(F.to_json("windows"), 256)), "benchmark-hits")
        sets = hits.groupBy("set").agg(F.first("windows").alias("windows")).select("set", F.explode("windows").alias("w"))
        owners = self.listed.where("item_id is not null").select("w1", "w2", F.col("item_id").cast("string").alias("item"))
        items = sets.select("set", "w.w1", "w.w2").join(owners, ["w1", "w2"]).select("set", "item").distinct()
        items = items.groupBy("set").agg(F.array_sort(F.collect_list("item")).alias("items"))
        none = F.array().cast("array<string>")
        per_doc = hits.join(items, "set", "left").select("id", "text_hash", "n_hit", F.coalesce("items", none).alias("items"))
        n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(CASED_WORD)).cast("bigint")
        docs = self.docs.select("id", F.xxhash64("text").alias("text_hash"), n_words.alias("n_words"))
        on = [F.col("d.id").eqNullSafe(F.col("h.id")), F.col("d.text_hash") == F.col("h.text_hash")]
        joined = docs.alias("d").join(per_doc.alias("h"), on, "left")
        return joined.select(
            "d.id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept."""
    found = Decontaminator(docs, items, id_col, text_col, **options).hits().select("id", "text_hash")
    found = written(found, "contaminated")
    on = [docs[id_col].eqNullSafe(found["id"]), F.xxhash64(docs[text_col]) == found["text_hash"]]
    return docs.join(found, on, "left_anti")


#: DuckDB statement of the registered query (window 10).
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, win, len(win) AS l FROM (
    SELECT item_id, unnest(list_transform(generate_series(1, greatest(len(w) - 9, 1)), lambda i: w[i:least(i + 9, len(w))])) AS win
    FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, l, i, w[i:i + l - 1] AS win FROM (
    SELECT doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
m AS (SELECT doc_id, i, places.l, item_id FROM places JOIN win USING (l, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
