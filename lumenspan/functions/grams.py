"""Names looked for in texts by runs of tokens: a token is a run of ASCII word characters, or any other character by itself.

A run is told by a polynomial hash of its bytes, found for all runs of a stretch of text at once from running sums. What a set of bits,
made of the names, lets through is told as text, so that an equality join decides."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Tokens of a name that are looked for as one run.
MOST = 16
#: Bits of the set that runs are tried against, as a power of two; bytes of text looked at in one go.
BITS, PART = 26, 1 << 20
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_END = 255  # no byte of UTF-8; stands after each text
_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"]] = True


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
    return up(_BASE), up(pow(_BASE, -1, 1 << 64))


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each with its end; where each starts."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.insert(data, offsets[1:] - offsets[0], _END), offsets[:-1] - offsets[0] + np.arange(len(texts))


def _tokens(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token starts, and the end of all; which tokens are words."""
    word = _WORD[flat]
    first = np.where(word, ~np.r_[False, word[:-1]], (flat & 0xC0) != 0x80)
    starts = np.flatnonzero(first)
    return np.r_[starts, len(flat)], np.r_[word[starts], False]


def _sums(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(len(flat), PART).bit_length()
    up, down = _powers(size)
    return np.r_[np.uint64(0), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)])], down


def _bit(sums: np.ndarray, down: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The place in the set of each run of bytes from lo to hi."""
    return ((sums[hi] - sums[lo]) * down[lo] * np.uint64(_MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def _texts_at(flat: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    sizes = hi - lo
    ends = np.cumsum(sizes)
    data = flat[np.repeat(lo - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
    return pa.Array.from_buffers(pa.large_string(), len(lo), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data)])


KEYS = "name string, gram string, tokens int, whole boolean, bit long"


def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name) to KEYS: the first tokens of a name, MOST at most; whether these are all; their place in the set."""
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, begin = _flat(batch.column(0))
        starts, _ = _tokens(flat)
        first = np.searchsorted(starts, begin)
        n = np.diff(np.r_[first, len(starts) - 1]) - 1  # without the end
        last = first + np.minimum(n, MOST)
        sums, down = _sums(flat)
        at = starts[first], starts[last]
        yield pa.record_batch([batch.column(0).cast(pa.string()), _texts_at(flat, *at).cast(pa.string()), pa.array(last - first, pa.int32()), pa.array(n <= MOST), pa.array(_bit(sums, down, *at))], names=["name", "gram", "tokens", "whole", "bit"])


def finder(lengths: Sequence[int], longest: int, bits: np.ndarray):
    """(key, text) to (key, gram, closed): the runs of these numbers of tokens, of no more than `longest` bytes, that the set of bits
    lets through and that begin at a boundary of words; closed: they end at one. Of those shorter than MOST only closed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, begin = _flat(batch.column(1))
            starts, word = _tokens(flat)
            for lo in range(0, len(flat), PART):
                hi = min(lo + PART + longest, len(flat))  # a run that ends beyond is longer than any name
                sums, down = _sums(flat[lo:hi])
                a, b, c = np.searchsorted(starts, [lo, min(lo + PART, len(flat)), hi + 1])
                for n in lengths:
                    to = min(b, c - n)
                    if to <= a:
                        continue
                    bit = _bit(sums, down, starts[a:to] - lo, starts[a + n : to + n] - lo)
                    i = a + np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    opened = word[i] | np.where(i > 0, word[i - 1], False)
                    closed = word[i + n - 1] | word[i + n]
                    which = np.searchsorted(begin, starts[i], "right") - 1
                    kept = opened & (closed | (n == MOST)) & (which == np.searchsorted(begin, starts[i + n] - 1, "right") - 1) & (flat[starts[i + n] - 1] != _END)
                    if kept.any():
                        i = i[kept]
                        yield pa.record_batch([batch.column(0).take(pa.array(which[kept])), _texts_at(flat, starts[i], starts[i + n]).cast(pa.string()), pa.array(closed[kept])], names=[batch.schema.names[0], "gram", "closed"])

    return run
