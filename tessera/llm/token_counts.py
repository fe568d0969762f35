"""Token counts of whole texts by overlap resynchronisation (operator 3).

A text is encoded in overlapping chunks with token offsets. Two neighbouring
chunks are spliced at a common boundary that is proven to be a token boundary
of the whole text, so counts equal those of one call over the whole text:

* **class rule**: byte-level pre-tokenisation never joins a non-space character
  to a following character of another class (letter, digit, space, other),
  except across an apostrophe (contractions). Such a position ends a
  pre-token whatever stands around it.
* **common token**: inside one run of a single class both chunks cut the same
  pre-token. A sequence of tokens is the encoding of its text exactly if every
  adjacent pair is; if both encodings contain the same token at the same place
  past the first one, all pairs of the spliced sequence occur in one of them.

If an overlap holds neither, it is doubled until one is found or the text ends.
A worker holds one chunk and its tokens, never the encoding of a whole text.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted each; an empty table gives an empty result; other columns of the
input are ignored whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import python_rows

CHUNK = 8192
OVERLAP = 256


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: character -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _kind(c: str) -> str:
    major = unicodedata.category(c)[0]
    if major in "LN":
        return major
    return "S" if c.isspace() and not "\x1c" <= c <= "\x1f" else "O"


def class_rule(text: str, p: int) -> bool:
    """True if a pre-token ends at ``p`` whatever the rest of the text is."""
    left, right = text[p - 1], text[p]
    kind = _kind(left)
    return kind != "S" and left != "'" and kind != _kind(right)


class ChunkedEncoder:
    """Counts tokens of byte-level BPE texts chunk by chunk."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not 0 < overlap < chunk:
            raise ValueError("the overlap must be positive and shorter than a chunk")
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["model"]["type"] != "BPE":
            raise ValueError("only byte-level BPE without normaliser or prefix space can be counted in chunks")
        to_byte = byte_alphabet()
        as_bytes = lambda token: bytes(map(to_byte.__getitem__, token))
        # Only the order of the merges matters for counts: bytes first, then each merge's result.
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pieces = dict.fromkeys([bytes([b]) for b in range(256)] + [as_bytes(a) + as_bytes(b) for a, b in pairs])
        ranks = {piece: i for i, piece in enumerate(pieces)}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.sizes = np.fromiter(map(len, ranks), dtype=np.int64, count=len(ranks))
        self.codec = tiktoken.Encoding(
            "byte-level",
            pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
            mergeable_ranks=ranks,
            special_tokens={},
        )
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0  # how often an overlap had to grow

    def count(self, text: str) -> int:
        """Tokens of the whole text; strings of special tokens count as one token each."""
        return sum(1 if s else self._count(part) for part, s in self._parts(text))

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        while True:
            found = [(p, -len(s), s) for s in self.specials if (p := text.find(s, at)) >= 0]
            if not found:
                break
            p, _, special = min(found)
            yield text[at:p], False
            yield special, True
            at = p + len(special)
        yield (text[at:] if at else text), False

    def _count(self, text: str) -> int:
        if len(text) <= self.chunk + self.overlap:
            return len(self.codec.encode_ordinary(text))
        total, overlap = 0, self.overlap
        now = _Chunk(self, text, 0, self.chunk + overlap)
        while now.end < len(text):
            start = max(now.counted_from, now.end - overlap)
            if start == now.counted_from:  # the overlap has swallowed the chunk: encode a longer one
                now = _Chunk(self, text, start, self.chunk + 2 * overlap)
                start = max(start + 1, now.end - overlap)
                if now.end == len(text):
                    break
            after = _Chunk(self, text, start, self.chunk + overlap)
            cut = now.splice(after)
            if cut is None:
                self.widened += 1
                overlap *= 2
                continue
            tokens, after.first, after.counted_from = cut
            total += tokens
            now, overlap = after, self.overlap
        return total + len(now.ids) - now.first


class _Chunk:
    """Encoding of text[start:end]; tokens from ``first`` on (character ``counted_from``) are not counted yet."""

    def __init__(self, encoder: ChunkedEncoder, text: str, start: int, size: int):
        self.text, self.start, self.end = text, start, min(len(text), start + size)
        part = text[start : self.end]
        self.raw = part.encode("utf-8")
        self.ids = encoder.codec.encode_ordinary(part)
        self.ends = np.cumsum(encoder.sizes[self.ids])
        self.first, self.counted_from = 0, start

    def bytes_to(self, p: int) -> int:
        return len(self.text[self.start : p].encode("utf-8"))

    def splice(self, after: _Chunk) -> tuple[int, int, int] | None:
        """(tokens of this chunk to count, first token of ``after`` to count, its character), or None without proof."""
        text, low, high = self.text, after.start, min(self.end, after.end)
        for p in range(high - 1, max(low, self.counted_from), -1):
            if class_rule(text, p):
                mine, its = (int(np.searchsorted(c.ends, c.bytes_to(p))) + 1 for c in (self, after))
                return mine - self.first, its, p
        run = text[low : high + 1]
        if "'" in run or len(set(map(_kind, run))) > 1:
            return None
        base = self.bytes_to(low)
        mine = {(int(e) - base, i): k for k, (e, i) in enumerate(zip(self.ends, self.ids, strict=True)) if e > base and k >= self.first}
        for n, (e, i) in enumerate(zip(after.ends.tolist(), after.ids, strict=True)):
            whole = e == len(after.raw) or after.raw[e] & 0xC0 != 0x80
            if whole and (k := mine.get((e, i))) is not None and n + 1 < len(after.ids):
                return k + 1 - self.first, n + 1, low + len(after.raw[:e].decode("utf-8"))
        return None


def count_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    limit: int | None = None,
) -> DataFrame:
    """(id, n_bytes, n_tokens[, over_limit]) per row; ``path`` is a byte-level BPE vocabulary file.

    The vocabulary is read by every worker from ``path``, so the file must lie where all executors see it.
    One narrow stage: no shuffle, a lost task counts its own rows again.
    """
    out = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        encoder = ChunkedEncoder(path, chunk, overlap)
        for rows in python_rows(batches):
            texts = [t or "" for _, t in rows]
            yield pa.record_batch(
                [[i for i, _ in rows], [len(t.encode("utf-8")) for t in texts], [encoder.count(t) for t in texts]], schema=out
            )

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    counted = narrow.mapInArrow(run, "id bigint, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
    return counted if limit is None else counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
