"""Document fingerprints: bottom-k sketches of shingle hashes (operator 1). DataFrame functions only.

A sketch holds the ``k`` smallest distinct XXH64 hashes of a text's
``shingle``-word shingles, sorted. The smallest ``k`` of the union of two
sketches are the sketch of the united texts, so sketches of parts merge in any
order, and three estimates follow:

* distinct shingles: exact below ``k``, else (k - 1) / (the k-th hash as a fraction of the hash range);
* resemblance: of the smallest ``k`` hashes of the union, the share that both texts have;
* containment: below the bound to which both sketches are complete, the share of one text's hashes that the other has.

Defined results: null is the empty text; texts of fewer words than a shingle
have one shingle, all their words; texts without words have the empty sketch,
which is like another empty one (1.0) and unlike any other (0.0). Equal ids
follow one another by a hash of their texts, null ids come after all others;
repeated rows are neighbours like any other rows. An empty table gives an empty
result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

K = 128
SHINGLE = 5
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
#: Ids per window partition (a power of two), and keys that one task may order.
BUCKET_BITS = 7
ORDERED_IN_ONE_TASK = 1 << 14
HASH_RANGE = float(1 << 64)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def sketch_of(words: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Bottom-k sketch of a column of word arrays. Give a plain column: it is read once per shingle."""
    hash_at = lambda i: F.xxhash64(*(F.get(words, i + F.lit(j)) for j in range(shingle)))
    many = F.transform(F.sequence(F.lit(0), F.size(words) - F.lit(shingle)), hash_at)
    one = F.array(F.xxhash64(F.array_join(words, " ")))
    none = F.array().cast("array<bigint>")
    hashes = F.when(F.size(words) >= shingle, many).when(F.size(words) > 0, one).otherwise(none)
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts taken together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(sketches: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group of rows. Rows are folded in bounded sub-groups first, so no group meets in one task whole."""
    exploded = sketches.select(*keys, F.explode(sketch_col).alias("_h")).distinct()
    # The k smallest of a sub-group contain all of its hashes that can be among the k smallest of the group.
    salted = exploded.withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(256)))
    first = Window.partitionBy(*keys, "_salt").orderBy("_h")
    second = Window.partitionBy(*keys).orderBy("_h")
    kept = salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    kept = kept.withColumn("_r", F.row_number().over(second)).where(F.col("_r") <= k)
    # Groups without any hash have only the null, which collect_list leaves out.
    every = sketches.select(*keys).distinct().withColumn("_h", F.lit(None).cast("bigint"))
    kept = kept.select(*keys, "_h").unionByName(every)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    share = (F.element_at(sketch, -1).cast("double") + F.lit(HASH_RANGE / 2)) / F.lit(HASH_RANGE)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = merged(a, b, k)
    bound = F.element_at(union, -1)
    both = F.size(F.filter(F.array_intersect(a, b), lambda h: h <= bound))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of ``a``'s shingles that ``b`` has; 1.0 for an empty ``a``."""
    top = F.lit((1 << 63) - 1)
    reach = lambda x: F.when(F.size(x) < k, top).otherwise(F.element_at(x, -1))
    bound = F.least(reach(a), reach(b))
    mine = F.size(F.filter(a, lambda h: h <= bound))
    shared = F.size(F.filter(F.array_intersect(a, b), lambda h: h <= bound))
    return F.when(mine == 0, F.lit(1.0)).otherwise(shared / mine)


def as_text(sketch: Column) -> Column:
    """Lowercase hex, 16 digits per hash, smallest first."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(id, sketch: array<bigint>) per row; one narrow stage."""
    words = docs.select(F.col(id_col), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("_words"))
    return words.select(id_col, sketch_of(F.col("_words"), k, shingle).alias("sketch"))


def next_lower(keys: DataFrame) -> DataFrame:
    """``keys`` (key bigint, distinct) -> (key, next): the next smaller key; after the smallest the largest.

    Keys are ordered in ranges of 4096; the largest keys of the ranges are linked the same way, up to a level
    whose counted keys fit into one task.
    """
    n, last = keys.agg(F.count("*"), F.max("key")).first()
    if n <= ORDERED_IN_ONE_TASK:
        following = F.lead("key").over(Window.orderBy(F.desc("key")))
        return keys.select("key", F.coalesce(following, F.lit(last)).alias("next"))
    ranged = keys.select("key", F.shiftright("key", 12).alias("range"))
    tops = ranged.groupBy("range").agg(F.max("key").alias("top"))
    order = next_lower(written(tops.select(F.col("range").alias("key")), "ranges"))
    after = order.join(tops, order["next"] == tops["range"]).select(order["key"].alias("range"), F.col("top").alias("_after"))
    following = F.lead("key").over(Window.partitionBy("range").orderBy(F.desc("key")))
    linked = ranged.withColumn("_next", following).join(after, "range")
    return linked.select("key", F.coalesce("_next", "_after").alias("next"))


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text, of its edited text, and the likeness to both the edited text's and the next document's.

    The next document is the one that follows in descending order of ids. Texts are shuffled once, by ranges of ids;
    within a range the next row is read from a window, and the last row of a range joins the first row of the next
    range that has rows. The edited text ends with the beginning of the next document in place of its last third.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    # Null ids are dealt over ranges of their own below all others.
    least = F.lit(-(1 << 62))
    place = F.when(F.col("id").isNull(), least - F.pmod("h", F.lit(1 << 20))).otherwise(F.shiftright("id", BUCKET_BITS))
    rows = source.withColumn("bucket", place).repartition("bucket")
    order = Window.partitionBy("bucket").orderBy(F.desc("id"), "h", "text")

    buckets = written(docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("h")).select(place.alias("key")).distinct(), "id-ranges")
    heads = rows.withColumn("r", F.row_number().over(order)).where("r = 1").select("bucket", "text")
    follows = next_lower(buckets).withColumnRenamed("key", "at")
    # Null-safe, so no filter is inferred below the exchange: both readers of ``rows`` then share one shuffle.
    heads = follows.join(heads, follows["next"].eqNullSafe(heads["bucket"])).select("at", F.col("text").alias("head"), words_of(F.col("text")).alias("w"))
    heads = heads.select("at", "head", sketch_of(F.col("w"), k, shingle).alias("head_sketch"))

    own = rows.withColumn("w", words_of(F.col("text")))
    own = own.select("id", "h", "text", "bucket", sketch_of(F.col("w"), k, shingle).alias("sketch"))
    own = own.withColumns({"next": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)})
    joined = own.join(heads, (own["bucket"] == heads["at"]) & own["next"].isNull(), "left")
    n_chars = F.char_length("text").cast("bigint")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    joined = joined.select(
        "id", "text", "sketch", n_chars.alias("n_chars"), F.coalesce("next", "head").alias("next"),
        F.coalesce("next_sketch", "head_sketch").alias("next_sketch"),
    )
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next", F.lit(1), cut))
    edits = joined.select("id", "n_chars", "sketch", "next_sketch", edited.alias("edited"))
    edits = edits.select("id", "n_chars", "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), words_of(F.col("edited")).alias("w"))
    edits = edits.select("id", "n_chars", "sketch", "next_sketch", "edited_sha256", sketch_of(F.col("w"), k, shingle).alias("edited_sketch"))
    s, e, n = (F.col(c) for c in ("sketch", "edited_sketch", "next_sketch"))
    return edits.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(s).alias("fingerprint"),
        as_text(e).alias("edited_fingerprint"),
        resemblance(s, e, k).alias("near_edited"),
        resemblance(s, n, k).alias("near_next"),
        distinct_shingles(s, k).alias("distinct_shingles"),
        containment(e, s, k).alias("edited_contained"),
    )
