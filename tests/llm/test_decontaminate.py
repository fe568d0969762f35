import hashlib
import random
import re

import duckdb
import pytest

from tessera.llm import decontaminate
from tessera.llm.decontaminate import Decontaminator, clean_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            for win in {tuple(b[k : k + 10]) for k in range(max(1, len(b) - 9))} if b else ():
                for at in range(len(w) - len(win) + 1):
                    if tuple(w[at : at + len(win)]) == win:
                        hit |= set(range(at, at + len(win)))
                        if item is not None:
                            found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def fixture():
    rng = random.Random(3)
    vocab = ["the", "of", "Été", "x1", "ÀB", "日本", "tion", "Zed", "q", "re"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.randint(12, 30))) for k in range(8)] + [(20, "the of"), (21, "q"), (22, None), (23, "  "), (24, "Tion RE q x1"), (None, say(15)), (10, "uniqueword alone")]
    items += [(30, items[0][1]), (31, items[0][1] + " more " + items[1][1])]
    docs = [(n, say(rng.randint(0, 60))) for n in range(40)]
    docs += [(100 + n, say(9) + ", " + body + " " + say(5)) for n, (_, body) in enumerate(items) if body]
    docs += [(200, None), (201, ""), (202, "the,of"), (202, "the,of"), (202, "other text"), (None, items[1][1]), (203, items[2][1].upper())]
    return docs, items


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
@pytest.mark.parametrize("shingle", [1, 3])
def test_equals_brute_force(spark, fixture, broadcast_rows, shingle):
    docs, items = fixture
    d = spark.createDataFrame([(i, t, 7, "n") for i, t in docs], "doc_id bigint, text string, n_words int, place string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(r) for r in Decontaminator(d, b, broadcast_rows=broadcast_rows, shingle=shingle).report().collect()), key=str)
    assert got == brute(docs, items)


def test_clean_documents_keep_their_columns(spark, fixture):
    docs, items = fixture
    d = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id bigint, text string, windows int")
    kept = clean_documents(d, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == d.columns
    dirty = {(r[0], t) for r, (i, t) in zip(brute([(k, t) for k, (_, t) in enumerate(docs)], items), sorted(((k, t) for k, (_, t) in enumerate(docs)), key=str), strict=True) if r[5]}
    assert sorted(str(r) for r in kept.select("doc_id", "text").collect()) == sorted(
        str(r) for r in d.select("doc_id", "text").collect() if (r.text not in {t for _, t in dirty})
    )


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "the of")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r)[:4] for r in Decontaminator(d, none).report().collect()] == [(1, 2, 0, 0)]
    items = spark.createDataFrame([(1, "of")], "item_id bigint, text string")
    assert Decontaminator(d.limit(0), items).report().count() == 0
    assert clean_documents(d, none).count() == 1


def test_sql(spark, fixture):
    docs, items = fixture
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark(item_id BIGINT, text VARCHAR)")
    once = [x for x in dict(docs).items() if x[0] is not None]
    listed = [x for x in items if x[0] is not None]
    con.executemany("INSERT INTO documents VALUES (?, ?)", once)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", listed)
    assert sorted(con.execute(decontaminate.ORACLE).fetchall(), key=str) == brute(once, listed)
