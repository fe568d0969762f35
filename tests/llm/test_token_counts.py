import random

import pytest

P = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from tessera.llm.token_counts import ChunkedEncoder, count_tokens  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed):
    rng = random.Random(seed)
    alphabets = ["ab ", "a", " ", "\n ", "0123 ", "it's we've ' ", "é日本語 ", "!?.'s ", "the of and tion ", "x<|endoftext|> ", "\x1c\x1f \u0085a", "日", "'", "=", "0"]
    for _ in range(60):
        yield "".join("".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 40))) * rng.randint(1, 4) for _ in range(6))
    for a in alphabets:
        yield "".join(rng.choice(a) for _ in range(900))
    for a in ("abcdefghijklmnop", "etaoinshr", "0123456789", "#-=*_", "éàüß日本"):
        yield "".join(rng.choice(a) for _ in range(2000))
    yield " " * 700 + "x" + "\n" * 300
    yield ""


def test_chunked_counts_equal_the_library(library):
    small = ChunkedEncoder(PATH, chunk=64, overlap=8)
    for seed in range(4):
        for t in texts(seed):
            assert small.count(t) == len(library.encode(t, add_special_tokens=False).ids), t
    assert small.widened > 0  # the fixture holds overlaps that had to grow


def test_rows(spark, library):
    rows = [(1, "the cat's <|endoftext|> hat", 5), (2, None, 5), (3, "", 5), (4, "ab " * 20000, 5), (4, "ab " * 20000, 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted(tuple(r) for r in count_tokens(df, PATH, limit=1024).collect() if r[0] is not None)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((i, len((t or "").encode()), n(t), n(t) > 1024) for i, t, _ in rows if i is not None)
    assert count_tokens(df.limit(0), PATH, limit=1).count() == 0
