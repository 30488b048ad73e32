"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A rank file becomes a tokenizers model: bytes are written in the byte-to-character alphabet, and every way to put a token
together from two others is a merge, in order of the token's rank. Texts are cut by the pattern; each distinct piece of a batch
is encoded once by encode_batch. Pieces repeat, and so do the stretches between spaces, so both are remembered in a worker, up to a
bound that costs time only, not results. A text may be cut before any space that a character other than white space follows: no
piece of the pattern reaches over such a place, nor does its look-ahead, so long texts are encoded in parts.

Decoding turns the alphabet around: ids to token strings to bytes. Ids that stand for a slice of a text may begin or end within a
character; characters() keeps those bytes apart, so that neighbouring slices can be put together again.

Offsets are places of tokens in code points of the text, end exclusive; tokens that share a character all cover it.

Defined cases: null and empty texts have no ids and decode to nothing; repeated rows, ties and null ids are rows of their own; an
empty table gives an empty result; the strings of special tokens are ordinary text; other columns are kept in the struct `own`,
whatever their names; null ids decode to null, and ids that the vocabulary does not have raise. A text without any place to cut is
encoded in one go, and so is one piece of the pattern, however long.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from .common import quoted

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Characters of a text encoded at once, characters of a stretch worth remembering, stretches and pieces remembered.
PART, SHORT, REMEMBERED = 1 << 20, 64, 200_000
_CUT = re.compile(r" (?=\S)")


def byte_alphabet() -> list[str]:
    """The character of each byte: visible ones of Latin-1 stand for themselves, the others are numbered from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Bpe:
    """An encoder and decoder made of the bytes of a rank file."""

    def __init__(self, data: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        letter = byte_alphabet()
        spelled = {t: "".join(letter[b] for b in t) for t in ranks}
        splits = ((ranks[t], ranks[t[:i]], ranks[t[i:]], t[:i], t[i:]) for t in ranks for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        merges = [(spelled[a], spelled[b]) for *_, a, b in sorted(splits)]
        self.model = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False)
        self.pattern = regex.compile(pattern)
        byte = {c: b for b, c in enumerate(letter)}
        self.bytes_of = {i: bytes(byte[c] for c in t) for t, i in self.model.get_vocab().items()}
        self.pieces: dict[str, bytes] = {}  # ids of a piece
        self.stretches: dict[str, bytes] = {}  # ids of a space and a stretch up to the next cut

    def _cut(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, a bounded number at a time."""
        if len(text) <= PART:
            yield self.pattern.findall(text)
            return
        found = (m[0] for m in self.pattern.finditer(text))
        while some := list(islice(found, 100_000)):
            yield some

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        new = [p for p in set(pieces) if p not in self.pieces]
        for p, e in zip(new, self.model.encode_batch_fast(new), strict=True):
            self.pieces[p] = np.array(e.ids, "<u4").tobytes()
        return self.pieces

    def _plain(self, text: str) -> bytes:
        return b"".join(b"".join(map(self._learn(some).__getitem__, some)) for some in self._cut(text))

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART and (cut := _CUT.search(text, at + PART)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for part in self._parts(text or ""):
            first, *rest = _CUT.split(part)
            if len(self.stretches) > REMEMBERED:
                self.stretches.clear()
            long = {s: self._plain(" " + s) for s in set(rest) if len(s) > SHORT}
            new = [s for s in set(rest) if s not in self.stretches and s not in long]
            cut = [self.pattern.findall(" " + s) for s in new]
            known = self._learn([p for some in cut for p in some])
            self.stretches |= {s: b"".join(map(known.__getitem__, some)) for s, some in zip(new, cut, strict=True)}
            out.append(self._plain(first))
            out += map((self.stretches | long if long else self.stretches).__getitem__, rest)
        return b"".join(out)

    def spans(self, text: str | None) -> np.ndarray:
        """(3, n): ids, starts and ends of a text's tokens."""
        at, out = 0, [np.zeros((3, 0), np.int64)]
        for some in self._cut(text or ""):
            distinct = list(set(some))
            made = {p: np.array([e.ids, *zip(*e.offsets, strict=True)], np.int64) for p, e in zip(distinct, self.model.encode_batch(distinct), strict=True)}
            for p in some:
                out.append(made[p] + np.array([[0], [at], [at]]))
                at += len(p)
        return np.concatenate(out, axis=1)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def edges(data: bytes) -> tuple[int, int]:
    """Where the whole characters of a slice of UTF-8 begin and end."""
    start = 0
    while start < min(3, len(data)) and data[start] & 0xC0 == 0x80:
        start += 1
    for back in range(1, min(3, len(data) - start) + 1):
        lead = data[-back]
        if lead & 0xC0 != 0x80:
            need = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return start, len(data) - back if need > back else len(data)
    return start, len(data)


_MADE: dict[str, Bpe] = {}


def _worker(key: str, data: bytes, pattern: str) -> Bpe:
    """Made once in a worker."""
    if key not in _MADE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's to share out
        _MADE.clear()
        _MADE[key] = Bpe(data, pattern)
    return _MADE[key]


class Codec:
    """Column functions of one vocabulary, whose file (of 1 MB) is broadcast."""

    def __init__(self, docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        held, key = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes()), uuid.uuid4().hex
        self._bpe = lambda: _worker(key, held.value, pattern)

    def ids(self, text: Column) -> Column:
        bpe = self._bpe

        @F.arrow_udf("binary")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield pa.array((bpe().encode(t.as_py()) for t in texts), pa.binary(), size=len(texts))

        return run(text)

    def spans(self, text: Column) -> Column:
        """Structs of three arrays: ids, starts, ends."""
        bpe = self._bpe

        @F.arrow_udf("struct<ids:array<long>,starts:array<long>,ends:array<long>>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            kind = pa.struct([(k, pa.list_(pa.int64())) for k in ("ids", "starts", "ends")])
            for texts in batches:
                yield pa.array((dict(zip(("ids", "starts", "ends"), bpe().spans(t.as_py()), strict=True)) for t in texts), kind, size=len(texts))

        return run(text)

    def bytes(self, ids: Column) -> Column:
        bpe = self._bpe

        @F.arrow_udf("binary")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for rows in batches:
                yield pa.array((None if not x.is_valid else bpe().decode(x.as_py()) for x in rows), pa.binary(), size=len(rows))

        return run(ids)


def characters(data: Column) -> Column:
    """struct(head, body, tail) of decoded bytes: the bytes of a character that a slice before began, text, those of one begun here.

    What is no UTF-8 within the body is replaced by U+FFFD."""

    @F.arrow_udf("struct<head:binary,body:string,tail:binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("head", pa.binary()), ("body", pa.string()), ("tail", pa.binary())])

        def one(x: bytes | None) -> dict | None:
            if x is None:
                return None
            start, end = edges(x)
            return {"head": x[:start], "body": x[start:end].decode("utf-8", "replace"), "tail": x[end:]}

        for rows in batches:
            yield pa.array((one(x.as_py()) for x in rows), kind, size=len(rows))

    return run(data)


def encode(docs: DataFrame, text_col: str = "text", codec: Codec | None = None, spans: bool = False) -> DataFrame:
    """(own, n_tokens, ids): own holds the other columns of docs; ids is binary. With spans, starts and ends are arrays beside it."""
    codec = codec or Codec(docs)
    others = [c for c in docs.columns if c != text_col]
    own = F.struct(*map(quoted, others)) if others else F.lit(None).cast("int")
    out = docs.select(own.alias("own"), codec.ids(quoted(text_col)).alias("ids"), *([codec.spans(quoted(text_col)).alias("s")] if spans else []))
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return out.select("own", n, "ids", *(["s.starts", "s.ends"] if spans else []))


def decode(encoded: DataFrame, codec: Codec, ids_col: str = "ids") -> DataFrame:
    """encoded with `decoded`, the bytes that its ids stand for."""
    return encoded.withColumn("decoded", codec.bytes(quoted(ids_col)))


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    codec = Codec(docs)
    both = decode(encode(docs, codec=codec), codec)
    return both.select(F.col("own.doc_id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
