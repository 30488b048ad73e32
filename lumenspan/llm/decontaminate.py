"""Benchmark decontamination: pigeonhole edit matching.

Texts and items are reduced to lower-case runs of letters and digits, one space apart. An item of n characters may differ by
k = floor(rate * n) edits; it is cut into k + 1 pieces, of which an occurrence with k edits must hold one unchanged. All
pieces of a block of items are looked up at once by an Aho-Corasick automaton; the places where they hit, shifted by where
the piece stands in the item, give windows; overlapping windows become one, and Myers' bit-parallel search settles whether
the item occurs in it with k edits or fewer, and where it ends and starts. Every document is searched whole.

The items are the stated query set, against all rows. Up to BLOCK_CHARS characters of items are one automaton, broadcast, and
one pass over the documents. More items are not: their pieces become a table by hash, and the documents' substrings of the
pieces' lengths meet them by an equi-join, after a bitmap of the pieces' hashes (BITMAP_BITS at most) has left out nearly all
that meet none. The places of hits give the same windows; only windows travel to the items' texts, and are verified there.
Texts are told apart by 128 bits of hash, so equal ones are searched once. Both ways give the same rows.

Defined cases: null and empty texts hold nothing; an item without letters or digits matches nothing; a null item id is
reported as null; ids that are no integers raise at once; repeated items and rows are reported as rows of their own; other
columns are ignored by find_leaks and kept by leak_free.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, whole_id, written

ERROR_RATE = 0.08
#: Characters of items in one automaton: about 100 bytes of memory each. Beyond, pieces are joined.
BLOCK_CHARS = 1_000_000
#: Bits for each piece in the bitmap, and bits of it at most (16 MB, broadcast). A fuller bitmap only lets more by to the join.
PIECE_BITS, BITMAP_BITS = 32, 1 << 27
_RUNS = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(_RUNS.findall((text or "").lower()))


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edits of the pattern against any stretch of text, where the first such stretch ends)."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = ones, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        right, left = down | (ones & ~(h | up)), up & h
        if right & top:
            score += 1
        elif left & top:
            score -= 1
            if score < best:
                best, end = score, j
        right = right << 1 & ones
        up = (left << 1 & ones) | (ones & ~(v | right))
        down = right & v
    return best, end


def pieces_of(s: str, rate: float) -> list[tuple[int, int]]:
    """The cuts (start, end) of a normal form into one piece more than it may have edits."""
    k = int(rate * len(s))
    cuts = [len(s) * i // (k + 1) for i in range(k + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def windows(starts: Iterable[int], n: int, k: int) -> Iterator[tuple[int, int]]:
    """Where an item of n characters may stand, given the starts that hits tell: overlapping stretches become one."""
    low = high = None
    for a in sorted(starts):
        if high is not None and a - k <= high:
            high = a + n + k
            continue
        if high is not None:
            yield max(0, low), high
        low, high = a - k, a + n + k
    if high is not None:
        yield max(0, low), high


@lru_cache(10_000)
def _both_masks(pattern: str) -> tuple[dict[str, int], dict[str, int]]:
    return _masks(pattern), _masks(pattern[::-1])


def verified(pattern: str, k: int, window: str) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of a pattern in a window, if it has k edits or fewer."""
    if (at := window.find(pattern)) >= 0:
        return 0, at, at + len(pattern)
    masks, back = _both_masks(pattern)
    edits, end = myers(masks, len(pattern), window)
    if edits > k:
        return None
    width = myers(back, len(pattern), window[max(0, end - len(pattern) - k) : end][::-1])[1]
    return edits, end - width, end


class Matcher:
    """A block of items, searched together."""

    def __init__(self, items: Iterable[tuple[int | None, str | None]], rate: float = ERROR_RATE):
        self.items, pieces = [], defaultdict(list)
        for item_id, text in items:
            s = normal(text)
            if not s:
                continue
            self.items.append((item_id, s, int(rate * len(s))))
            for a, b in pieces_of(s, rate):
                pieces[s[a:b]].append((len(self.items) - 1, b))
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, at)
        if pieces:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> Iterator[tuple[int | None, int, int, int]]:
        """(item id, edits, start, end) of the best occurrence of each item in the normal form of text."""
        s = normal(text)
        if not s or not self.items:
            return
        starts: dict[int, set[int]] = defaultdict(set)
        for last, at in self.automaton.iter(s):
            for i, end in at:
                starts[i].add(last + 1 - end)
        for i, found in sorted(starts.items()):
            item_id, pattern, k = self.items[i]
            best = None
            for low, high in windows(found, len(pattern), k):
                got = verified(pattern, k, s[low:high])
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], low + got[1], low + got[2])
                    if not got[0]:
                        break
            if best:
                yield (item_id, *best)


def _block(items: DataFrame, item_id: Column, text: str) -> list[tuple] | None:
    """The items, if they are one block."""
    size = items.agg(F.sum(F.length(text)).alias("n"), F.count(F.lit(1)).alias("m")).first()
    if (size["n"] or 0) + size["m"] > BLOCK_CHARS:
        return None
    return [(r[0], r[1]) for r in items.select(item_id, text).collect()]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)])[:n]


def _mixed(x: np.ndarray, n: int) -> np.ndarray:
    x = (x ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def substring_hashes(s: str, lengths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length, the hashes of all substrings of that length, by where they start: polynomials over prefix sums."""
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sums = np.r_[np.uint64(0), np.cumsum(codes * _powers(_BASE, len(codes)), dtype=np.uint64)]
    back = _powers(_BACK, len(codes))
    for n in lengths:
        if 0 < n <= len(codes):
            yield n, _mixed((sums[n:] - sums[:-n]) * back[: len(codes) - n + 1], n)


def _pieces(rate: float):
    """Batches of (item, text) to (key, item, off, n, size): a row for each piece, by the hash of its characters."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = normal(text)
                cuts = pieces_of(s, rate) if s else []
                hashes = dict(substring_hashes(s, {b - a for a, b in cuts}))
                rows += [(int(hashes[b - a][a].view(np.int64)), item, a, len(s), b - a) for a, b in cuts]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["key", "item", "off", "n", "size"])

    return run


def _joined(docs: DataFrame, items: DataFrame, rate: float) -> DataFrame:
    """docs (h, g, text) and items (item, text) to (h, g, item, edits, start, end), by joined pieces."""
    pieces = written(items.mapInArrow(_pieces(rate), "key long, item long, off int, n int, size int"))
    lengths = sorted(r["size"] for r in pieces.select("size").distinct().collect())  # some twenty
    bits = min(BITMAP_BITS, 1 << max(15, (pieces.count() * PIECE_BITS).bit_length()))
    # The functions count bits from 1.
    found = pieces.select((F.col("key").bitwiseAND(F.lit(bits - 1)) + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b")).collect()  # BITMAP_BITS at most
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in found:
        at, part = (r["k"] - 1) * 4096, np.frombuffer(bytes(r["b"]), np.uint8)
        bitmap[at : at + len(part)] |= part[: len(bitmap) - at]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def hits(batches):
        known = shared.value
        for batch in batches:
            for h, g, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = normal(text)
                keys, at = [], []
                for _, x in substring_hashes(s, lengths):
                    p = x & np.uint64(bits - 1)
                    i = np.flatnonzero(known[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1)
                    keys.append(x[i].view(np.int64))
                    at.append(i)
                n = sum(map(len, keys))
                if n:
                    cols = [pa.array(np.full(n, h)), pa.array(np.full(n, g)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(at).astype(np.int32))]
                    for i in range(0, n, 50_000):
                        yield pa.record_batch([c[i : i + 50_000] for c in cols], names=["h", "g", "key", "at"])

    met = docs.select("h", "g", "text").mapInArrow(hits, "h long, g long, key long, at int").join(pieces.drop("size"), "key")
    # As many starts as an item's pieces have places in a text.
    starts = met.groupBy("h", "g", "item", "n").agg(F.collect_set(F.col("at") - F.col("off")).alias("starts"))
    asked = written(starts.groupBy("h", "g").agg(F.collect_list(F.struct("item", "n", "starts")).alias("asked")))

    def cut(batches):
        for batch in batches:
            for h, g, asked_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = normal(text)
                rows = [(h, g, a["item"], low, s[low:high]) for a in asked_ for low, high in windows(a["starts"], a["n"], int(rate * a["n"]))]
                for i in range(0, len(rows), 10_000):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)], names=["h", "g", "item", "low", "window"])

    def check(batches):
        for batch in batches:
            rows = []
            for h, g, item, low, window, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pattern = normal(text)
                if got := verified(pattern, int(rate * len(pattern)), window):
                    rows.append((h, g, item, got[0], low + got[1], low + got[2]))
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["h", "g", "item", "edits", "start", "end"])

    of_docs = asked.join(docs, ["h", "g"]).select("h", "g", "asked", "text").mapInArrow(cut, "h long, g long, item long, low long, window string")
    told = of_docs.join(items, "item").select("h", "g", "item", "low", "window", "text").mapInArrow(check, "h long, g long, item long, edits long, start long, end long")
    return told.groupBy("h", "g", "item").agg(F.min(F.struct("edits", "start", "end")).alias("m")).select("h", "g", "item", "m.*")


def _digests(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)


def _by_join(docs: DataFrame, items: DataFrame, rate: float, text: str, item: Column, item_text: str) -> tuple[DataFrame, DataFrame]:
    """Leaks (h, g, item number, edits, start, end) of distinct texts, and items (item, item_id, text)."""
    numbered = written(items.select(item.alias("item_id"), quoted(item_text).alias("text")).withColumn("item", F.monotonically_increasing_id()))
    h, g = _digests(quoted(text))
    texts = docs.where(quoted(text).isNotNull()).select(h.alias("h"), g.alias("g"), quoted(text).alias("text"))
    one = texts.groupBy("h", "g").agg(F.first("text").alias("text"))
    return written(_joined(one, numbered.select("item", "text"), rate)), numbered


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start, end): one row for each item that a document holds; places are of the normal form."""
    ids = whole_id(docs, doc_id)
    block = _block(items, whole_id(items, item_id), item_text)
    if block is None:
        leaks, numbered = _by_join(docs, items, rate, text, whole_id(items, item_id), item_text)
        h, g = _digests(quoted(text))
        met = docs.select(ids.alias("doc_id"), h.alias("h"), g.alias("g")).join(leaks, ["h", "g"]).join(numbered.select("item", "item_id"), "item")
        return met.select("doc_id", "item_id", "edits", "start", "end")
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        matcher = Matcher(shared.value, rate)
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matcher.search(t)]
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "edits", "start", "end"])

    return docs.select(ids, quoted(text)).mapInArrow(run, "doc_id long, item_id long, edits long, start long, end long")


def leak_free(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, text: str = "text", item_text: str = "text") -> DataFrame:
    """The documents that hold no item; rows and columns stay as they are."""
    none = F.lit(None).cast("long")
    block = _block(items, none, item_text)
    if block is None:
        leaks, _ = _by_join(docs, items, rate, text, none, item_text)
        h, g = _digests(quoted(text))
        whole = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), h.alias("h"), g.alias("g"))
        return whole.join(leaks.select("h", "g").distinct(), ["h", "g"], "left_anti").select("doc.*")
    shared = docs.sparkSession.sparkContext.broadcast(block)

    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(shared.value, rate)
        for texts in batches:
            yield pa.array([next(matcher.search(t), None) is not None for t in texts.to_pylist()], pa.bool_())

    return docs.where(~holds(quoted(text)))


def op10_leaks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
