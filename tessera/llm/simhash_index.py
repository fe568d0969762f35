"""SimHash near-duplicates through a Gray-order hierarchical index (operator 6).

A fingerprint has one bit per majority vote of a document's shingle hashes.
Distinct fingerprints that differ in at most ``radius`` bits are linked;
documents of linked fingerprints form components.

**Upper nodes.** Two such fingerprints agree on at least one of ``radius + 1``
parts of the bits. An upper node is a mask and the pattern its members share
there, so differences are only left in the free bits. A node with more than
``leaf`` members is factored again: its free bits are cut into ``radius + 1``
parts and each member goes to one child per part. Free bits shrink by a third
per level, and few free bits allow few distinct members, so every node ends
below the bound: no pair within the radius is lost and no node grows with the
data, whatever patterns are frequent.

**Inside a node** members are sorted by Gray rank (neighbours share long bit
patterns), consecutive runs are folded into groups that know the bits all their
members agree on, and two groups are compared by the differences accumulated in
those bits: beyond the radius the whole pair of groups is pruned.

A node emits a spanning forest of its links, never its pairs. Equal texts share
a fingerprint and are one vertex, so groups of copies cost one row.

Defined results: null, empty and blank texts have fingerprint zero, linked like
any other; the component of documents without any id is null, otherwise null
ids are never smallest; repeated rows are one vertex, returned each; an empty
table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import python_rows, written
from tessera.llm.components import connected_components

SHINGLE = 3
RADIUS = 2
#: Members of a node that one task compares.
LEAF = 4096
FAN = 16
BITS = 64
#: Shingle hashes whose bits are counted at a time.
BLOCK = 1 << 15


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of all ``size``-word shingles, repeats included; zero without words."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, blanks are \x20 \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
        hashes = map(xxhash.xxh64_intdigest, (line[a:b] for a, b in spans), repeat(42))
        n = len(words) - size + 1
    else:
        hashes, n = iter([xxhash.xxh64_intdigest(line, 42)]), 1
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = np.fromiter(hashes, dtype="<u8", count=min(BLOCK, n - at))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, keep: dict | None = None) -> DataFrame:
    """(id, fingerprint: bigint with the unsigned bits, + ``keep``: name -> bigint column) per row; one narrow stage."""
    keep = keep or {}
    names = list(keep)

    def run(batches):
        for rows in python_rows(batches):
            kept = list(zip(*(r[2:] for r in rows), strict=True)) if names else []
            prints = np.array([fingerprint(r[1], size) for r in rows], dtype=np.uint64).view(np.int64)
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array(prints), *(pa.array(c, pa.int64()) for c in kept)]
            yield pa.record_batch(columns, names=["id", "fingerprint", *names])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *(c.alias(n) for n, c in keep.items()))
    return narrow.mapInArrow(run, "id bigint, fingerprint bigint" + "".join(f", {n} bigint" for n in keep))


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the binary-reflected Gray code."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _folded(pattern: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of ``FAN`` neighbours: the bits all of them agree on and their values there."""
    at = np.arange(0, len(pattern), FAN)
    every, some = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
    shared = np.bitwise_and.reduceat(agree, at) & ~(every ^ some)
    return every & shared, shared


def linked_pairs(bits: np.ndarray, radius: int = RADIUS):
    """Yields index arrays (a, b), a before b: all pairs of the Gray-sorted ``bits`` within ``radius``."""
    levels = [(bits, np.full(len(bits), ~np.uint64(0)))]
    while len(levels[-1][0]) > FAN:
        levels.append(_folded(*levels[-1]))
    top = len(levels) - 1
    a, b = np.triu_indices(len(levels[top][0]))
    todo = [(top, a, b)]
    while todo:
        level, a, b = todo.pop()
        pattern, agree = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & agree[a] & agree[b]) <= radius
        a, b = a[near], b[near]
        if not level:
            inside = a < b
            if inside.any():
                yield a[inside], b[inside]
            continue
        width = len(levels[level - 1][0])
        steps = np.arange(FAN)
        for at in range(0, len(a), 2048):
            x = (a[at : at + 2048, None, None] * FAN + steps[:, None] + np.zeros(FAN, np.int64)).ravel()
            y = (b[at : at + 2048, None, None] * FAN + steps[None, :] + np.zeros((FAN, 1), np.int64)).ravel()
            real = (x <= y) & (y < width)
            todo.append((level - 1, x[real], y[real]))


def spanning_links(bits: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct ``bits``: (root, member) of every linked member but the roots."""
    bits = bits[np.argsort(gray_rank(bits), kind="stable")]
    root = np.arange(len(bits))
    for a, b in linked_pairs(bits, radius):
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    member = np.flatnonzero(root != np.arange(len(bits)))
    return bits[root[member]], bits[member]


def _parts(mask: int, radius: int) -> list[int]:
    """Masks of the children of a node: ``mask`` and one of ``radius + 1`` parts of its free bits."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:], strict=False) if i < j]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def near_links(prints: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """``prints`` (fingerprint, distinct) -> edges (u, v) whose components are those of all links within ``radius``."""
    spark = prints.sparkSession
    masks = _parts(0, radius)
    members = prints.select("fingerprint", F.explode(F.array(*(F.lit(_signed(m)).cast("bigint") for m in masks))).alias("mask"))
    edges = None
    while True:
        members = written(members.withColumn("pattern", F.col("fingerprint").bitwiseAND(F.col("mask"))), "nodes")
        sizes = written(members.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where("n > 1"), "node-sizes")
        small = members.join(sizes.where(F.col("n") <= leaf), ["mask", "pattern"])
        found = written(_searched(small, radius), "links")
        edges = found if edges is None else edges.unionByName(found)
        large = sizes.where(F.col("n") > leaf).select("mask", "pattern")
        if large.isEmpty():
            return edges
        # (radius + 1) ** level masks at most: a bounded table made from the bit layout alone
        children = [(_signed(m), _signed(c)) for m in masks for c in _parts(m, radius)]
        masks = sorted({c for m in masks for c in _parts(m, radius)})
        layout = spark.createDataFrame(children, "mask bigint, child bigint")
        members = members.join(large, ["mask", "pattern"]).select("fingerprint", "mask").join(F.broadcast(layout), "mask")
        members = members.select("fingerprint", F.col("child").alias("mask"))


def _searched(members: DataFrame, radius: int) -> DataFrame:
    """Spanning links of all nodes; a task streams its nodes in order and holds one at a time."""

    def run(frames):
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            edge = (frame["mask"].to_numpy()[1:] != frame["mask"].to_numpy()[:-1]) | (frame["pattern"].to_numpy()[1:] != frame["pattern"].to_numpy()[:-1])
            starts = np.concatenate(([0], np.flatnonzero(edge) + 1))
            rest = frame.iloc[starts[-1] :]
            yield _links_of(frame, starts[:-1], starts[1:], radius)
        if rest is not None:
            yield _links_of(rest.reset_index(drop=True), [0], [len(rest)], radius)

    nodes = members.select("mask", "pattern", "fingerprint").repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    return nodes.mapInPandas(run, "u bigint, v bigint").distinct()


def _links_of(frame: pd.DataFrame, starts, ends, radius: int) -> pd.DataFrame:
    bits = frame["fingerprint"].to_numpy().view(np.uint64)
    found = [spanning_links(bits[i:j], radius) for i, j in zip(starts, ends, strict=True)]
    u, v = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64) for k in (0, 1))
    return pd.DataFrame({"u": u, "v": v})


def components(prints: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """``prints`` (id, fingerprint, ...) with component_id: the smallest id reachable over links."""
    classes = written(prints.groupBy("fingerprint").agg(F.min("id").alias("first_id")), "fingerprint-classes")
    roots = written(connected_components(near_links(classes.select("fingerprint"), radius, leaf)), "fingerprint-roots")
    classes = classes.join(roots, classes["fingerprint"] == roots["vertex"], "left")
    classes = classes.select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(smallest, "root").select("fingerprint", "root", "component_id")
    return prints.join(written(named, "fingerprint-components"), "fingerprint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint: 16 hex digits, component_id) for every row of ``docs``."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return components(prints, radius).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: its smallest id (nulls last, then by a hash of the text). All columns kept."""
    k1, k2 = F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col))
    prints = written(fingerprints(docs, id_col, text_col, keep={"k1": k1, "k2": k2}), "fingerprints")
    order = F.struct(F.col("id").isNull(), "id", "k1", "k2")
    kept = components(prints, radius).groupBy("root").agg(F.min(order).alias("kept")).select("kept.k1", "kept.k2")
    names = [c for c in docs.columns]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), k1.alias("k1"), k2.alias("k2"))
    one = keyed.join(written(kept, "kept"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return one.select(*(F.col("row").getField(c).alias(c) for c in names))
