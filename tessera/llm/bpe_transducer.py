"""BPE encoding and decoding as bounded-lookahead streaming transducers (operator 2).

**Sufficient lookahead.** Merges apply in rank order. Compare two texts with a
common prefix; before any merge they share a token boundary at the prefix's
end. A merge ``(u, v)`` can move the last shared boundary only to the left, by
``u``, and only if the token right of that boundary, ``v``, starts with the
text passed over by the previous move. So boundaries move along chains of
merges of rising rank in which each ``v`` starts with the last ``u``, and the
longest chain, measured in symbols of its ``u``, bounds the move for every
continuation. ``sufficient_lookahead`` is that longest chain, found in one pass
over the merge list. Tokens that end this far before the last read symbol are
stable whatever follows, so the encoder emits them and forgets their symbols:
its memory is the lookahead plus one block, however long a piece is.

**Decoding** is an incremental state machine over token ids: bytes go through
an incremental UTF-8 decoder, so a character split between tokens waits for its
rest. Files without a decoder section are decoded as the library does then:
token strings joined by blanks.

Defined results: null and empty texts have no tokens and decode to the empty
text; repeated rows are encoded each; an empty table gives an empty result;
other columns are ignored whatever their names; texts are read whole.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import python_rows
from tessera.llm.token_counts import byte_alphabet

#: Characters of text normalised and split at a time, and symbols the transducer takes beyond its lookahead.
BLOCK = 1 << 16
STEP = 1024
#: Cached words per worker, and the longest cached word.
CACHE_WORDS = 400_000
CACHE_LENGTH = 64


def sufficient_lookahead(merges: Iterable[tuple[str, str]], length: Callable[[str], int] = len) -> int:
    """Symbols of right context after which no token boundary can change any more (see the module text)."""
    longest = 0
    chain_of: dict[str, int] = {}  # u -> longest chain that ends with a merge whose left part is u
    for u, v in merges:
        chain = length(u) + max((chain_of.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
        chain_of[u] = max(chain_of.get(u, 0), chain)
        longest = max(longest, chain)
    return longest


class Vocabulary:
    """A word-level BPE file: normaliser NFC, blanks, lower case; word-end suffix on the last symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.end = model["end_of_word_suffix"]
        self.decoder = spec.get("decoder")
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = {(vocab[u], vocab[v]): (rank, vocab[u + v]) for rank, (u, v) in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges, lambda u: len(u.removesuffix(self.end)))
        alphabet = byte_alphabet()
        self.symbol = [0] * 256
        self.last_symbol = [0] * 256
        for c, b in alphabet.items():
            self.symbol[b], self.last_symbol[b] = vocab[c], vocab[c + self.end]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        #: Symbols of each token; a special token's string is never a symbol.
        self.width = np.array([len(t.removesuffix(self.end)) for t in self.names], dtype=np.int64)
        self.alphabet = alphabet


class Transducer:
    """Encodes one piece, symbol by symbol; ``feed`` and ``finish`` return the ids that became stable."""

    def __init__(self, vocabulary: Vocabulary, step: int = STEP):
        self.v, self.step, self.held = vocabulary, step, []

    def feed(self, raw: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(raw), self.step):
            self.held += raw[at : at + self.step]
            # The newest byte may still turn out to be the word's last; it stays within the lookahead.
            stable = len(self.held) - 1 - self.v.lookahead
            if stable < self.step:
                continue
            ids = self._merge([self.v.symbol[b] for b in self.held[:-1]])
            ends = np.cumsum(self.v.width[ids])
            n = int(np.searchsorted(ends, stable, side="right"))
            if n:
                out += ids[:n]
                del self.held[: int(ends[n - 1])]
        return out

    def finish(self) -> list[int]:
        if not self.held:
            return []
        symbols = [self.v.symbol[b] for b in self.held[:-1]] + [self.v.last_symbol[self.held[-1]]]
        self.held = []
        return self._merge(symbols)

    def _merge(self, ids: list[int]) -> list[int]:
        return _merge_short(self.v.pairs, ids) if len(ids) <= 48 else _merge_long(self.v.pairs, ids)


#: Stands for a pair without a merge.
NONE = (1 << 62, -1)


def _merge_short(pairs: dict, ids: list[int]) -> list[int]:
    """Applies the lowest-ranked merge until none is left; ``ids`` is changed."""
    get = pairs.get
    ranks = [get(p, NONE) for p in zip(ids, ids[1:], strict=False)]
    while ranks:
        best = min(ranks)
        if best is NONE:
            break
        i = ranks.index(best)
        ids[i] = best[1]
        del ids[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = get((best[1], ids[i + 1]), NONE)
        if i:
            ranks[i - 1] = get((ids[i - 1], best[1]), NONE)
    return ids


def _merge_long(pairs: dict, ids: list[int]) -> list[int]:
    """The same merges with a heap over a linked list."""
    n = len(ids)
    after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

    def push(i: int) -> None:
        if 0 <= i and after[i] < n and (r := pairs.get((ids[i], ids[after[i]]))):
            heapq.heappush(heap, (r[0], i, ids[i], ids[after[i]], r[1]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = new, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        push(before[i])
        push(i)
    return [t for t in ids if t >= 0]


class Encoder(dict):
    """Encodes whole texts block by block. The mapping part is a bounded cache: word -> its ids as bytes."""

    def __init__(self, vocabulary: Vocabulary, block: int = BLOCK, step: int = STEP):
        super().__init__()
        import regex

        self.v, self.block, self.step = vocabulary, block, step
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.ascii_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
        self.known: dict[str, bytes] = {}  # the same for pieces
        self.words = regex.compile(r"\P{White_Space}+")
        self.separators = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the vocabulary does not
        self.marks = re.compile("|".join(map(re.escape, vocabulary.special))) if vocabulary.special else None

    def __missing__(self, word: str) -> bytes:
        find = (self.ascii_pieces if word.isascii() else self.pieces).findall
        out = b"".join(map(self._piece, find(word)))
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out

    def _piece(self, piece: str) -> bytes:
        known = self.known.get(piece)
        if known is not None:
            return known
        raw = piece.encode("utf-8")
        if len(raw) <= self.v.lookahead:  # nothing can be stable before the piece ends
            symbols = [self.v.symbol[b] for b in raw]
            symbols[-1] = self.v.last_symbol[raw[-1]]
            ids = _merge_short(self.v.pairs, symbols) if len(raw) <= 48 else _merge_long(self.v.pairs, symbols)
        else:
            transducer = Transducer(self.v, self.step)
            ids = transducer.feed(raw) + transducer.finish()
        out = np.array(ids, dtype="<u4").tobytes()
        if len(piece) <= CACHE_LENGTH:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[piece] = out
        return out

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of the whole text as little-endian unsigned 32-bit integers, in parts."""
        at = 0
        for m in self.marks.finditer(text) if self.marks else ():
            yield from self._plain(text[at : m.start()])
            yield np.array([self.v.special[m.group()]], dtype="<u4").tobytes()
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[bytes]:
        for block in blocks(text, self.block):
            if not block.isascii():
                # Lower case character by character: no final sigma.
                block = unicodedata.normalize("NFC", block).replace("Σ", "σ")
            block = block.lower()
            words = self.words.findall(block) if self.separators.search(block) else block.split()
            yield b"".join(map(self.__getitem__, words))


def blocks(text: str, size: int) -> Iterator[str]:
    """Parts of at least ``size`` characters that begin with a blank; normalisation never reaches across one."""
    at = 0
    while len(text) - at > size:
        cut = min((p for c in " \n\t" if (p := text.find(c, at + size)) >= 0), default=-1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:] if at else text


class Decoder:
    """Ids to text, part by part. ``as_library``: what the library returns for a file without a decoder."""

    def __init__(self, vocabulary: Vocabulary, as_library: bool = True):
        if as_library and vocabulary.decoder is not None:
            raise ValueError("this vocabulary file names a decoder")
        self.v, self.as_library, self.begun = vocabulary, as_library, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: bytes) -> str:
        if not ids:
            return ""
        names = map(self.v.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())
        if self.as_library:
            text = " ".join(names)
            lead, self.begun = " " if self.begun else "", True
            return lead + text
        raw = bytearray()
        for name in names:
            if name in self.v.special:
                raw += name.encode("utf-8")
                continue
            stem = name.removesuffix(self.v.end)
            raw += bytes(map(self.v.alphabet.__getitem__, stem))
            if stem != name:
                raw += b" "
        return self.utf8.decode(bytes(raw))

    def finish(self) -> str:
        return "" if self.as_library else self.utf8.decode(b"", final=True)


_LOADED: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _narrow(df: DataFrame, id_col: str, col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(col).alias("value"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text. ``path`` must be readable on every executor."""

    def run(batches):
        encoder = Encoder(_vocabulary(path))
        for rows in python_rows(batches):
            ids = [np.frombuffer(b"".join(encoder.encode(t or "")), dtype="<u4").astype(np.int32) for _, t in rows]
            yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return _narrow(docs, id_col, text_col).mapInArrow(run, "id bigint, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", as_library: bool = False) -> DataFrame:
    """(id, text): the text of every id list; null ids decode to the empty text."""

    def run(batches):
        vocabulary = _vocabulary(path)
        for rows in python_rows(batches):
            texts = []
            for _, ids in rows:
                d = Decoder(vocabulary, as_library)
                texts.append(d.feed(np.array(ids or [], dtype="<u4").tobytes()) + d.finish())
            yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])

    return _narrow(encoded, id_col, ids_col).mapInArrow(run, "id bigint, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): both transducers over every whole text, part by part.

    Neither the ids nor the decoded text of a document is ever held whole. One narrow stage without a shuffle.
    """
    out = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        vocabulary = _vocabulary(path)
        encoder = Encoder(vocabulary)
        for rows in python_rows(batches):
            found = []
            for i, text in rows:
                n, ids, decoded, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(vocabulary)
                for part in encoder.encode(text or ""):
                    n += len(part) // 4
                    ids.update(part)
                    decoded.update(decoder.feed(part).encode("utf-8"))
                found.append((i, n, ids.hexdigest(), decoded.hexdigest()))
            yield pa.record_batch(list(map(list, zip(*found, strict=True))), schema=out)

    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _narrow(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
