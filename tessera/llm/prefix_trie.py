"""Conversation prefix trie: a minimal-perfect-hash node table, accumulated through parent slots in depth order.

**Digests.** Turns are ranked inside their conversation by a range sort over
(conversation, turn, content). A prefix has the digest ``q = q' * X + t`` modulo a
127-bit prime, ``t`` being 128 bits of the turn's SHA-256. Such chains compose, so
a task chains its range alone and the ranges of a conversation that spans several
tasks are joined by one row a range (at most two rows a task reach the driver).
A digest is trusted only after verification: every row of a node names the same
parent digest, turn and depth; by induction from the root equal digests are then
equal prefixes. A clash raises ``ArithmeticError``.

**Slots.** Distinct digests are counted once (partial sums before the shuffle) and
carry the number of node rows below them. Subtrees of at most ``LIMIT`` rows are
dealt whole to shards. A shard gives its digests slots by a minimal perfect hash
(levels of collision-free bits), verified against the stored digests, scatters
children, leaves and saved tokens into flat numpy arrays through the parent slots,
deepest first, and emits its nodes. The few nodes above (at most rows / ``LIMIT`` a
depth) receive the sums of the subtrees below them and are summed by pointer
doubling: after j rounds a node holds everything up to 2^j levels below it, so a
long conversation costs log(depth) rounds.

**Scale.** Texts are read once and never shuffled. No window or group holds a
conversation, a first turn or a node's members whole; identical turns share ranges
by a random last key. Member lists are digested in order from pieces joined range
by range, streamed in constant memory (SHA-256 is sequential for one node). Tables
are broadcast only below ``BROADCAST_ROWS`` counted rows, else salted.

Defined results: turns are ordered by turn (null first), then by content; a null
role or text is empty; rows without a conversation id are left out; repeated rows
are turns of their own; ``%`` and ``-`` on ids are SQL's. A table without
conversations has no nodes, not even a root. Other columns are ignored whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Conversations of one block share the opening of its first.
BLOCK = 20
#: Most rows below the top of a subtree that goes to a shard whole.
LIMIT = 1 << 15
#: Rows a task chains, and turns of a conversation joined under one key.
RANGE, STRIDE = 1 << 16, 1 << 12
BROADCAST_ROWS, SALT = 1 << 17, 16
#: Members written into one piece of a node's list.
PIECE = 1 << 13
P = (1 << 127) - 1
X = 0x5DEECE66D1CE4E5B9A3C1F0B7D2E8A47
X_BACK = pow(X, -1, P)
ROOT = bytes(16)
_ROWS = "digest binary, depth long, conv_id long, length long, parent binary, turn binary, words long"
_NODES = (
    "digest binary, conv_id long, depth long, parent binary, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long"
)


def _int(b: bytes | None) -> int:
    return int.from_bytes(b or b"", "big")


def _bytes(n: int) -> bytes:
    return n.to_bytes(16, "big")


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 of a turn; the length keeps role and text apart."""
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def opening(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its block."""
    return F.crc32(conv_id.cast("string")) % 4


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and chain the turns of one range; the last row of its first and of its last conversation are edges."""
    part = TaskContext.get().partitionId()
    conv, i, q, held, first = None, 0, 0, None, True

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        names = ["part", "conv_id", "i", "q", "turn", "words", "edge"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for b in batches:
        out = []
        for c, t, w in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
            if held is not None:
                ended = c != conv
                out.append((*held, first and ended))
                first = first and not ended
            if c != conv:
                conv, i, q = c, 0, 0
            i, q = i + 1, (q * X + _int(t)) % P
            held = (part, c, i, _bytes(q), t, w)
        if out:
            yield batch(out)
    if held is not None:
        yield batch([(*held, True)])


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, n, q, turn, words): the n-th turn of each conversation and the digest of its first n turns."""
    parts = max(1, -(-turns.count() // RANGE))
    order = ["conv_id", F.col("at").asc_nulls_first(), "turn"]
    ranged = turns.withColumn("any", F.rand(1)).repartitionByRange(parts, *order, "any").sortWithinPartitions(*order)
    schema = "part long, conv_id long, i long, q binary, turn binary, words long, edge boolean"
    local = written(ranged.select("conv_id", "turn", "words").mapInArrow(_chained, schema), "trie-ranges")
    # Two rows a task at most: where a conversation goes on, and from which state.
    edges = local.where("edge").select("part", "conv_id", "i", "q").collect()
    went: dict[tuple[int, int], tuple[int, int]] = {}
    conv, n, state = None, 0, 0
    for e in sorted(edges, key=lambda e: (e.part, e.conv_id)):
        if e.conv_id == conv:
            went[e.part, e.conv_id] = (n, state)
            n, state = n + e.i, (state * pow(X, e.i, P) + _int(e.q)) % P
        else:
            conv, n, state = e.conv_id, e.i, _int(e.q)
    if not went:
        return local.select("conv_id", F.col("i").alias("n"), "q", "turn", "words")

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, q = [], []
            for part, conv, i, digest in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
                before = went.get((part, conv))
                n.append(i + before[0] if before else i)
                q.append(_bytes((before[1] * pow(X, i, P) + _int(digest)) % P) if before else digest)
            columns = [b.column(1), pa.array(n, pa.int64()), pa.array(q, pa.binary()), b.column(4), b.column(5)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "n", "q", "turn", "words"])

    return local.select("part", "conv_id", "i", "q", "turn", "words").mapInArrow(
        carried, "conv_id long, n long, q binary, turn binary, words long"
    )


def _appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of rebuilt prefixes: own turns after the h-th, behind k turns of the block's first conversation."""
    for b in batches:
        conv, n, q, turn, words, h, k, length, own, lent = (b.column(j).to_pylist() for j in range(10))
        digest, parent, depth = [], [], []
        for i in range(b.num_rows):
            d = (_int(q[i]) + (_int(lent[i]) - _int(own[i])) * pow(X, n[i] - h[i], P)) % P
            digest.append(_bytes(d))
            parent.append(_bytes((d - _int(turn[i])) * X_BACK % P))
            depth.append(k[i] + n[i] - h[i])
        columns = [pa.array(digest, pa.binary()), pa.array(depth, pa.int64()), b.column(0), b.column(7), pa.array(parent, pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [*columns, b.column(3), b.column(4)], ["digest", "depth", "conv_id", "length", "parent", "turn", "words"]
        )


def _prefixes(conversations: DataFrame) -> DataFrame:
    """One row per prefix of every rebuilt conversation, the root included."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("at"),
        turn_digest(role, text).alias("turn"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    numbered = _numbered(turns)
    opened = [
        F.max(F.when(F.col("n") == j, F.struct("q", "turn", "words"))).alias(f"s{j}") for j in (1, 2, 3)
    ]
    convs = written(numbered.groupBy("conv_id").agg(F.count("*").alias("n_turns"), *opened), "trie-conversations")
    base = convs.where(F.col("conv_id") % BLOCK == 0).select(
        F.col("conv_id").alias("base"), F.col("n_turns").alias("lent_turns"), *(F.col(f"s{j}").alias(f"b{j}") for j in (1, 2, 3))
    )
    zero = F.lit(ROOT)

    def state(of: str, at: Column) -> Column:
        return F.coalesce(*(F.when(at == j, F.col(f"{of}{j}.q")) for j in (1, 2, 3)), zero)

    rebuilt = (
        convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK)
        .join(base, "base", "left")
        .withColumn("h", opening(F.col("conv_id")))
        .withColumn("k", F.least(F.col("h"), F.coalesce("lent_turns", F.lit(0))))
        .withColumn("length", F.col("k") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0)))
    )
    heads = [F.struct(zero.alias("digest"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"),
                      F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("words"))]
    for j in (1, 2, 3):
        before = zero if j == 1 else F.col(f"b{j - 1}.q")
        heads.append(F.when(F.col("k") >= j, F.struct(
            F.col(f"b{j}.q").alias("digest"), F.lit(j).cast("long").alias("depth"), before.alias("parent"),
            F.col(f"b{j}.turn").alias("turn"), F.col(f"b{j}.words").alias("words"))))
    lent = rebuilt.select("conv_id", "length", F.explode(F.filter(F.array(*heads), lambda s: s.isNotNull())).alias("s")).select(
        "s.digest", "s.depth", "conv_id", "length", "s.parent", "s.turn", "s.words"
    )
    # A long conversation meets its row under one key per STRIDE turns.
    block = F.floor(F.col("n") / STRIDE)
    states = rebuilt.where(F.col("n_turns") > F.col("h")).select(
        "conv_id", "h", "k", "length", state("s", F.col("h")).alias("own"), state("b", F.col("k")).alias("lent"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_turns") / STRIDE))).alias("block"),
    )
    own = (
        numbered.where(F.col("n") > opening(F.col("conv_id")))
        .withColumn("block", block)
        .join(states, ["conv_id", "block"])
        .select("conv_id", "n", "q", "turn", "words", "h", "k", "length", "own", "lent")
        .mapInArrow(_appended, _ROWS)
    )
    return written(lent.unionByName(own), "trie-prefixes")


def _beside(rows: DataFrame, small: DataFrame, size: int, on: str, how: str) -> DataFrame:
    """Join where ``on`` may be hot in ``rows`` and is unique in ``small``: broadcast below a counted bound, else salted."""
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), on, how)
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALT)).cast("int")).join(copies, [on, "salt"], how).drop("salt")


class Slots:
    """Minimal perfect hash of distinct 128-bit keys: slots 0 to n - 1, each verified against its stored key."""

    def __init__(self, keys: np.ndarray):
        self.tables: list[tuple[np.ndarray, int]] = []
        rest, given = keys, 0
        self.keys = np.zeros_like(keys)
        while len(rest):
            size = 2 * len(rest) + 1
            at = self._place(rest, len(self.tables), size)
            alone = np.bincount(at, minlength=size) == 1
            # rank of a bit = slots given before it
            self.tables.append((np.where(alone, given + np.cumsum(alone) - 1, -1), size))
            mine = alone[at]
            self.keys[self.tables[-1][0][at[mine]]] = rest[mine]
            rest, given = rest[~mine], given + int(alone.sum())
            if len(self.tables) > 64:
                raise ArithmeticError("equal prefix digests in one shard")

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15 + 2 * level))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * level)
        return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the table."""
        slot = np.full(len(keys), -1, np.int64)
        for level, (table, size) in enumerate(self.tables):
            open_ = np.flatnonzero(slot < 0)
            slot[open_] = table[self._place(keys[open_], level, size)]
        found = np.flatnonzero(slot >= 0)
        slot[found[(self.keys[slot[found]] != keys[found]).any(1)]] = -1
        return slot


def _keys(column) -> np.ndarray:
    """Two 64-bit words per digest; a root's missing parent reads as all ones."""
    data = b"".join(v if v is not None else b"\xff" * 16 for v in column.to_pylist())
    return np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, 2)


def _shard(table: pa.Table) -> pa.Table:
    """Whole subtrees: slots, scattered counts, sums through parent slots from the deepest level up."""
    keys, parents = _keys(table["digest"]), _keys(table["parent"])
    depth, convs, conv_id, words = (table[c].to_numpy() for c in ("depth", "n_convs", "conv_id", "words"))
    slots = Slots(keys)
    n = len(keys)
    at, up = slots.of(keys), slots.of(parents)
    if not np.array_equal(np.sort(at), np.arange(n)):
        raise ArithmeticError("a prefix digest has no slot of its own")
    parent, level, saved, children, leaves, owner = (np.zeros(n, np.int64) for _ in range(6))
    parent[at], level[at], saved[at], owner[at] = up, depth, (convs - 1) * words, conv_id
    np.add.at(children, up[up >= 0], 1)
    leaves[children == 0] = 1
    order = np.argsort(-level, kind="stable")
    edges = np.flatnonzero(np.diff(level[order])) + 1
    for now in np.split(order, edges):
        now = now[parent[now] >= 0]
        np.add.at(leaves, parent[now], leaves[now])
        np.add.at(saved, parent[now], saved[now])
    inside = up >= 0
    columns = {
        "digest": table["digest"], "conv_id": table["conv_id"], "depth": table["depth"], "parent": table["parent"],
        "parent_conv_id": pa.array(np.where(inside, owner[up], 0), pa.int64(), mask=~inside),
        "n_convs": table["n_convs"],
        **{name: pa.array(a[at], pa.int64()) for name, a in (("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved))},
    }
    return pa.table(columns)


def _upper(big: DataFrame, size: int, deepest: int, below: DataFrame) -> DataFrame:
    """The nodes above all shards: sums of what hangs below each, by pointer doubling over at most ``deepest`` levels."""
    kids = big.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias("big_children"))
    start = (
        big.join(below.withColumnRenamed("parent", "digest"), "digest", "left")
        .join(kids.withColumnRenamed("parent", "digest"), "digest", "left")
        .na.fill(0, ["children", "leaves", "saved", "big_children"])
        .withColumn("n_children", F.col("children") + F.col("big_children"))
        .withColumn("n_leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long"))
        .withColumn("saved_tokens", F.col("saved") + (F.col("n_convs") - 1) * F.col("words"))
    )
    owner = big.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    sums = _beside(start, owner, size, "parent", "left").withColumn("up", F.col("parent"))
    keep = ["digest", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children"]
    sums = written(sums.select(*keep, "n_leaves", "saved_tokens", "up"), "trie-upper")
    reach = 1
    while reach <= deepest:
        sent = (
            sums.where(F.col("up").isNotNull())
            .groupBy(F.col("up").alias("digest"))
            .agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        )
        further = sums.select(F.col("digest").alias("up"), F.col("up").alias("next"))
        moved = _beside(sums.join(sent, "digest", "left"), further, size, "up", "left")
        sums = written(
            moved.select(
                *keep,
                (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
                F.col("next").alias("up"),
            ),
            "trie-upper",
        )
        reach *= 2
    return sums.drop("up")


def _pieces(most: int):
    """A mapInArrow function: sorted (digest, conv_id) rows to joined lists of at most ``most`` ids each."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, out = None, [], []

        def flushed() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            types = (pa.binary(), pa.int64(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["digest", "first", "ids"])
            out.clear()
            return made

        for b in batches:
            for digest, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest != now or len(ids) == most:
                    if ids:
                        out.append((now, ids[0], ",".join(map(str, ids))))
                    now, ids = digest, []
                ids.append(conv)
                if len(out) >= 1 << 10:
                    yield flushed()
        if ids:
            out.append((now, ids[0], ",".join(map(str, ids))))
        if out:
            yield flushed()

    return pieces


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (digest, first) to one SHA-256 per digest, one piece in memory at a time."""
    now, state = None, None
    done: list[tuple[bytes, str]] = []

    def made() -> pa.RecordBatch:
        columns = zip(*done, strict=True)
        types = (pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["digest", "ends_sha256"])

    for b in batches:
        for digest, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if digest != now:
                if state:
                    done.append((now, state.hexdigest()))
                now, state = digest, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(done) >= 1 << 14:
            yield made()
            done = []
    if state:
        done.append((now, state.hexdigest()))
    if done:
        yield made()


def _ends(prefixes: DataFrame, rows: int) -> DataFrame:
    """(digest, ends_sha256) of the nodes where conversations end."""
    ends = prefixes.where(F.col("depth") == F.col("length")).select("digest", "conv_id")
    parts = max(1, -(-rows // RANGE))
    pieces = ends.repartitionByRange(parts, "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    pieces = pieces.mapInArrow(_pieces(PIECE), "digest binary, first long, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashed, "digest binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, with what its subtree holds."""
    prefixes = _prefixes(conversations)
    spread = [e for c in ("depth", "parent", "turn") for e in (F.min(c).alias(f"{c}_0"), F.max(c).alias(f"{c}_1"))]
    nodes = prefixes.groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("rows"),
        F.max("words").alias("words"),
        *spread,
    )
    clash = F.lit(False)
    for c in ("depth", "parent", "turn"):
        clash = clash | ~F.col(f"{c}_0").eqNullSafe(F.col(f"{c}_1"))
    nodes = written(
        nodes.select("digest", "conv_id", "n_convs", "rows", "words", F.col("depth_0").alias("depth"), F.col("parent_0").alias("parent"), clash.alias("clash")),
        "trie-nodes",
    )
    above = F.col("rows") > limit
    seen = nodes.agg(
        F.coalesce(F.max("clash"), F.lit(False)).alias("clash"),
        F.coalesce(F.max("rows"), F.lit(0)).alias("rows"),
        F.count_if(above).alias("big"),
        F.coalesce(F.max(F.when(above, F.col("depth"))), F.lit(0)).alias("deepest"),
    ).first()
    if seen.clash:
        raise ArithmeticError("two prefixes share a digest")
    small = nodes.where(~above)
    if seen.big:
        big = written(nodes.where(above).drop("clash", "rows"), "trie-big")
        marks = big.select("digest", F.lit(True).alias("big"))
        # A conversation's top: its first prefix below the big ones.
        tops = (
            _beside(prefixes.select("digest", "depth", "conv_id"), marks, seen.big, "digest", "left")
            .groupBy("conv_id")
            .agg(F.min(F.when(F.col("big").isNull(), F.struct("depth", "digest"))).alias("top"))
        )
        shards = -(-seen.rows // limit)
        small = small.join(tops, "conv_id").withColumn("shard", F.pmod(F.xxhash64("top.digest"), F.lit(shards)))
    else:
        small = small.withColumn("shard", F.lit(0).cast("long"))
    columns = ["shard", "digest", "conv_id", "depth", "parent", "n_convs", "words"]
    inner = written(small.select(*columns).groupBy("shard").applyInArrow(_shard, _NODES), "trie-shards")
    if seen.big:
        below = inner.where(F.col("parent_conv_id").isNull()).groupBy("parent").agg(
            F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
        )
        owner = big.select(F.col("digest").alias("parent"), F.col("conv_id").alias("big_conv"))
        inner = _beside(inner, owner, seen.big, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "big_conv"))
        inner = inner.drop("big_conv").unionByName(_upper(big, seen.big, seen.deepest, below))
    empty = F.sha2(F.lit(""), 256)
    return inner.join(_ends(prefixes, seen.rows), "digest", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


#: Subtrees by path prefixes, crc32 bit by bit: for small tables only.
ORACLE = """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
             lambda x: list_concat([CAST(ascii(x) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (
  SELECT v.c, o.n AS place, 0 AS part, role, text FROM convs v JOIN own o ON o.c = v.c - v.c % 20 AND o.n <= h
  UNION ALL SELECT v.c, o.n, 1, role, text FROM convs v JOIN own o ON o.c = v.c AND o.n > h),
turns AS (
  SELECT c, row_number() OVER w AS d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
         string_agg(sha256(role || chr(31) || text), '/') OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, place)),
prefixes AS (
  SELECT c, 0 AS d, 0 AS words, '' AS path FROM convs UNION ALL SELECT c, d, words, '/' || path FROM turns),
lengths AS (SELECT c, max(d) AS l FROM prefixes GROUP BY c),
nodes AS (
  SELECT path, min(p.c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE d = l), '')) AS ends_sha256
  FROM prefixes p JOIN lengths USING (c) GROUP BY path),
up AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.path AS parent
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 65)),
kids AS (SELECT parent, count(*) AS k FROM up WHERE parent IS NOT NULL GROUP BY parent),
sized AS (SELECT up.*, coalesce(k, 0) AS n_children FROM up LEFT JOIN kids ON kids.parent = up.path)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, a.parent_conv_id, a.n_convs, a.n_children,
       CAST(sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
       CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM sized a JOIN sized b ON starts_with(b.path, a.path)
GROUP BY a.path, a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256
"""
