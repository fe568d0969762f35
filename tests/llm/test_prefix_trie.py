"""The prefix trie against dictionaries over whole prefixes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import prefix_trie as T

SCHEMA = "conv_id bigint, turn int, role string, text string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, T_digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
        for d in range(len(full) + 1):
            members.setdefault(tuple(full[:d]), []).append(c)
        ends.setdefault(tuple(full), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        own_saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + own_saved
        if p:
            for total, part in ((kids, 1), (leaves, leaves[p]), (saved, saved[p])):
                total[p[:-1]] = total.get(p[:-1], 0) + part
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
          hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items()),
        key=str,
    )


def T_digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def trie(spark, rows, **how):
    df = T.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), **how)
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def talk(seed, n=130):
    """Conversations of few different turns, so that prefixes are shared deeply; some of one common first turn."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        same = rng.random() < 0.3
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", "hello there" if same and turn < 4 else rng.choice(["a b", "c", "", "d e f"]), 1))
    return rows


ODD = [
    (500, None, "user", "first", 1), (500, 1, None, "x y", 1), (500, 1, "user", None, 1), (500, 1, None, "x y", 1), (500, 2, None, None, 1),
    (None, 1, "user", "lost", 1), (-20, 1, "user", "minus", 1), (-19, 1, "user", "minus", 1), (-19, 2, "u", "minus", 1), (521, 1, "ab", "c", 1), (522, 1, "a", "bc", 1),
]


def test_equals_brute_force(spark):
    rows = talk(1) + ODD
    assert trie(spark, rows) == brute(rows)


@pytest.mark.parametrize("limit", [1, 7, 60])
def test_shards_and_doubling(spark, monkeypatch, limit):
    monkeypatch.setattr(T, "RANGE", 40)
    rows = talk(2)
    assert trie(spark, rows, limit=limit) == brute(rows)


def test_salted_joins(spark, monkeypatch):
    monkeypatch.setattr(T, "BROADCAST_ROWS", 0)
    rows = talk(3, 60)
    assert trie(spark, rows, limit=20) == brute(rows)


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    """A third of all rows in one conversation, some of its turns equal: no task holds it whole."""
    monkeypatch.setattr(T, "RANGE", 30)
    monkeypatch.setattr(T, "STRIDE", 8)
    monkeypatch.setattr(T, "PIECE", 3)
    rows = talk(4, 60) + [(7, 50 + i // 3, "user", f"turn {i // 3}", 1) for i in range(150)]
    rows += [(600 + i, 1, "user", "same", 1) for i in range(70)]
    assert trie(spark, rows, limit=25) == brute(rows)


def test_no_rows(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "user", "x", 1)]) == []


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 63, (5000, 2), dtype=np.uint64), axis=0)
    slots = T.Slots(keys)
    assert sorted(slots.of(keys).tolist()) == list(range(len(keys)))
    assert (slots.of(keys + np.uint64(1)) == -1).all()
    with pytest.raises(ArithmeticError):
        T.Slots(np.concatenate([keys, keys[:1]]))


def test_a_digest_clash_is_seen(spark, monkeypatch):
    a, b, c = (bytes([x]) * 16 for x in (1, 2, 3))
    rows = [(T.ROOT, 0, 1, 1, None, None, 0), (T.ROOT, 0, 2, 1, None, None, 0), (a, 1, 1, 1, T.ROOT, b, 1), (a, 1, 2, 1, T.ROOT, c, 1)]
    monkeypatch.setattr(T, "_prefixes", lambda _: spark.createDataFrame(rows, T._ROWS))
    with pytest.raises(ArithmeticError):
        T.prefix_trie(None)
