import hashlib
import random
import struct
import unicodedata

import pytest

P = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from tessera.llm.bpe_transducer import Decoder, Encoder, Vocabulary, decode, encode, round_trip, sufficient_lookahead  # noqa: E402

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


def ids_of(encoder, text):
    raw = b"".join(encoder.encode(text))
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def texts(seed):
    rng = random.Random(seed)
    parts = ["the ", "Straße ", "İstanbul ", "ΟΔΟΣ ", "it's we'VE ", "42 ", "été ", "日本語", "\x1c\x1dx ", "<|endoftext|>", "<|startoftext|>a ",
             "!!!###", "\u0085 x", "́", "ﬁ ", "a​b ", "tionthble ", "🙂🙂 ", "\n\n\t", "ＡＢ "]
    for _ in range(150):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
    yield ""


def test_lookahead_of_a_chain():
    # "abcd": the last merge can undo what the first symbol would have joined
    assert sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3
    assert sufficient_lookahead([("a", "b")]) == 1


def test_equals_the_library(library, vocabulary):
    encoder = Encoder(vocabulary, block=16)
    for seed in range(3):
        for t in texts(seed):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids_of(encoder, t) == want, t
            d = Decoder(vocabulary)
            got = "".join(d.feed(p) for p in encoder.encode(t)) + d.finish()
            assert got == library.decode(want, skip_special_tokens=False), t


def test_pieces_far_beyond_the_lookahead(library, vocabulary):
    rng = random.Random(7)
    encoder = Encoder(vocabulary, step=64)
    assert vocabulary.lookahead < 1500
    for alphabet in ("ab", "a", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "#!$", "éü日"):
        t = "".join(rng.choice(alphabet) for _ in range(6000))
        assert ids_of(encoder, t) == library.encode(t, add_special_tokens=False).ids


def test_text_comes_back(spark):
    rows = [(1, "Hello  wörld, it's 42 日本!"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    back = dict(tuple(r) for r in decode(encode(df, PATH), PATH).collect())
    squeeze = lambda t: "".join((t or "").lower().split())
    assert {i: squeeze(t) for i, t in back.items()} == {i: squeeze(unicodedata.normalize("NFC", t or "")) for i, t in rows}


def test_rows(spark, library):
    rows = [(1, "the cat's hat", "x"), (2, None, "y"), (3, "", "z"), (4, "ab " * 30000, "z"), (4, "ab " * 30000, "z"), (None, "q", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids_sha256 string")
    got = sorted((tuple(r) for r in round_trip(df, PATH).collect()), key=str)

    def want(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False).encode())

    assert got == sorted((want(i, t) for i, t, _ in rows), key=str)
    assert round_trip(df.limit(0), PATH).count() == 0
