"""SimHash near-duplicates: one-wildcard segment variants, equality join, verification, components.

Fingerprints of max_distance bits or fewer apart, cut into max_distance // 2 + 1 segments, have one segment that differs by
one bit at most; with two bits that is two segments of 32. Each distinct fingerprint (copies count once) is put under its
variants: a segment with one bit deleted, for every segment and bit, 64 in all. Fingerprints that meet under a variant are
compared in full, and a link is told by the first variant that the two share, so it comes out once.

A variant shared by more than CROWD fingerprints is not compared pair by pair. Its members are looked up exactly in another
way: two fingerprints are 2 bits apart or fewer just if some value is one bit or less from both, so each crowded fingerprint
is put under its 65 values at distance 0 and 1, and those under the same value (65 at most) are linked in a star. Crowds
within one batch are already set aside before the shuffle, so a hot variant sends no more than CROWD rows from each batch.
No group is collected whole and no cap drops a link.

Defined cases: null and empty texts and texts of white space have fingerprint zero, linked like any other; repeated rows and
ids stay rows of their own; a null id is never the smallest unless its component has no other; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.operators.components import components

from .common import quoted, whole_id, written

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 2
#: Fingerprints under one variant that are still compared pair by pair.
CROWD = 32


def fingerprint_of(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash, as unsigned integer, of the shingles of the ASCII-lower-cased words."""
    words = (text or b"").lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    grams = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
    ones, total = np.zeros(64, np.int64), 0
    hashes = np.fromiter((h(b" ".join(g), SEED) for g in zip(*grams, strict=False)), np.uint64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def simhash(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column as a signed long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t, shingle) for t in texts.cast(pa.large_binary()).to_pylist()], np.uint64).view(np.int64), pa.int64())

    return run(text)


def _segments(max_distance: int) -> list[tuple[int, int]]:
    n = max_distance // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _variants(max_distance: int):
    """Batches of fp to (pos, part, fp, crowded): crowded rows without fp mark a variant, those with fp a fingerprint of one."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            pos, part, who, crowd = [], [], [], []
            set_aside = np.zeros(len(fp), bool)
            for lo, hi in _segments(max_distance):
                seg = fp >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1)
                for j in range(hi - lo):
                    low = np.uint64((1 << j) - 1)
                    key = seg & low | (seg >> np.uint64(1)) & ~low
                    order = np.argsort(key, kind="stable")
                    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, int)
                    size = np.diff(np.r_[first, len(key)])
                    many = np.zeros(len(key), bool)
                    many[order] = np.repeat(size > CROWD, size)
                    set_aside |= many
                    marks = key[order][first[size > CROWD]]
                    here = np.r_[key[~many], marks]
                    pos.append(np.full(len(here), lo + j, np.int32))
                    part.append(here)
                    who.append(np.r_[fp[~many], np.zeros(len(marks), np.uint64)])
                    crowd.append(np.r_[np.zeros(len(here) - len(marks), bool), np.ones(len(marks), bool)])
            aside = fp[set_aside]
            pos.append(np.full(len(aside), -1, np.int32))
            part.append(aside)
            who.append(aside)
            crowd.append(np.ones(len(aside), bool))
            cols = [np.concatenate(pos), np.concatenate(part).view(np.int64), np.concatenate(who).view(np.int64), np.concatenate(crowd)]
            for i in range(0, len(cols[0]), 100_000):
                yield pa.record_batch([pa.array(c[i : i + 100_000]) for c in cols], names=["pos", "part", "fp", "crowded"])

    return run


def _first_shared(a: np.ndarray, b: np.ndarray, max_distance: int) -> np.ndarray:
    """The first variant position under which a and b meet."""
    out = np.full(len(a), -1, np.int32)
    for lo, hi in reversed(_segments(max_distance)):
        diff = (a ^ b) >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1)
        at = np.bitwise_count(np.maximum(diff, np.uint64(1)) - np.uint64(1)).astype(np.int32)  # the index of a single bit
        meet = np.bitwise_count(diff) <= 1
        out[meet] = lo + at[meet]
    return out


def _verified(max_distance: int):
    """Batches sorted by (pos, part) to links (a, b), and (fp, null) for members of crowded variants.

    A run of more than CROWD rows is streamed, never held."""

    def run(batches):
        key, held, crowded = None, np.zeros(0, np.uint64), False
        for batch in batches:
            pos, part = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            mark = batch.column(3).to_numpy(zero_copy_only=False)
            if not len(pos):
                continue
            first = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (part[1:] != part[:-1])])
            last = np.r_[first[1:], len(pos)]
            a, b, alone = [], [], []

            def close(k, members, crowd, a=a, b=b, alone=alone):
                if crowd:
                    alone.append(members)
                elif len(members) > 1:
                    i, j = np.triu_indices(len(members), 1)
                    x, y = members[i], members[j]
                    ok = (np.bitwise_count(x ^ y) <= max_distance) & (_first_shared(x, y, max_distance) == k[0])
                    a.append(x[ok])
                    b.append(y[ok])

            whole = slice(None)
            if key is not None and (pos[0], part[0]) == key:  # the run goes on from the batch before
                here = mark[: last[0]]
                crowded = crowded or bool(here.any())
                more = fp[: last[0]][~here] if key[0] >= 0 else fp[: last[0]]
                held = np.r_[held, more]
                if crowded or len(held) > CROWD:
                    crowded = True
                    alone.append(held)
                    held = np.zeros(0, np.uint64)
                whole = slice(1, None)
            if whole == slice(None) or len(first) > 1:
                if key is not None:
                    close(key, held, crowded)
                first, last = first[whole], last[whole]
                size = last - first
                marked = np.logical_or.reduceat(mark, first)
                two = (size[:-1] == 2) & ~marked[:-1]
                x, y = fp[first[:-1][two]], fp[first[:-1][two] + 1]
                ok = (np.bitwise_count(x ^ y) <= max_distance) & (_first_shared(x, y, max_distance) == pos[first[:-1][two]])
                a.append(x[ok])
                b.append(y[ok])
                for r in np.flatnonzero(((size[:-1] > 2) | marked[:-1])):
                    f, t = first[r], last[r]
                    members = fp[f:t][~mark[f:t]] if pos[f] >= 0 else fp[f:t]
                    close((pos[f], part[f]), members, bool(marked[r]) or len(members) > CROWD)
                f = first[-1]
                key, crowded = (pos[f], part[f]), bool(marked[-1])
                held = fp[f:][~mark[f:]] if pos[f] >= 0 else fp[f:]
                if crowded or len(held) > CROWD:
                    crowded = True
                    alone.append(held)
                    held = np.zeros(0, np.uint64)
            yield from _links(a, b, alone)
        if key is not None:
            a, b, alone = [], [], []
            if crowded:
                alone.append(held)
            elif len(held) > 1:
                i, j = np.triu_indices(len(held), 1)
                ok = (np.bitwise_count(held[i] ^ held[j]) <= max_distance) & (_first_shared(held[i], held[j], max_distance) == key[0])
                a, b = [held[i][ok]], [held[j][ok]]
            yield from _links(a, b, alone)

    return run


def _links(a: list, b: list, alone: list):
    a, b, alone = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b, alone))
    n = len(a) + len(alone)
    if n:
        yield pa.record_batch([pa.array(np.r_[a, alone]), pa.array(np.r_[b, alone], mask=np.r_[np.zeros(len(a), bool), np.ones(len(alone), bool)])], names=["a", "b"])


def _ball(batches):
    """fp to (point, fp) for the 65 values at distance 0 and 1."""
    flips = np.r_[np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)]
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fp), 2_000):
            part = fp[i : i + 2_000]
            yield pa.record_batch([pa.array((part[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(part, 65).view(np.int64))], names=["point", "fp"])


def fingerprint_links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Distinct fingerprints (column fp, long) to edges (a, b) whose components are those of all links."""
    if not 0 <= max_distance <= 2:
        raise ValueError("max_distance is 0, 1 or 2: beyond, crowded variants have no exact way")
    # The table is small and its fan-out is not: it is spread over as many tasks as a shuffle has.
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    variants = spread.mapInArrow(_variants(max_distance), "pos int, part long, fp long, crowded boolean")
    met = written(variants.repartition("pos", "part").sortWithinPartitions("pos", "part").mapInArrow(_verified(max_distance), "a long, b long"))
    links = met.where("b is not null")
    if max_distance == 0:
        return links.where(F.lit(False))
    near = met.where("b is null").select(F.col("a").alias("fp")).distinct().mapInArrow(_ball, "point long, fp long")
    under = near.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    if max_distance == 1:
        under = under.where(F.array_contains("fps", F.col("point"))).select(F.col("point").alias("b"), F.explode("fps").alias("a"))
    else:
        under = under.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a"))
    return links.unionByName(under.where("a <> b").select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, fp, component): one row per document; component is the smallest id that its links reach."""
    marked = written(docs.select(quoted(id_col).alias("id"), simhash(F.col(text_col), shingle).alias("fp")))
    fps = written(marked.groupBy("fp").agg(F.min("id").alias("least")))
    tree = components(fingerprint_links(fps, max_distance), written)
    named = written(tree.join(fps.select(F.col("fp").alias("node"), "least"), "node").unionByName(tree.select("root").distinct().join(fps.select(F.col("fp").alias("root"), "least"), "root").select(F.col("root").alias("node"), "root", "least")).distinct())
    best = named.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = fps.join(named.join(best, "root").select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return marked.join(of_fp, "fp", "left").select("id", "fp", "component")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


# Near copies further apart, found exactly: two texts whose sets of five-word shingles are SIMILARITY or more alike share one
# of the first n - ceil(SIMILARITY * n) + 1 shingles of both (n, the size of the set), in whatever order all texts use.
WIDE_SHINGLE = 5
SIMILARITY = 0.8
#: Ids up to this many (16 bytes each) are broadcast to pick their rows out; beyond, the rows are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: One row in SAMPLED, by a hash of its content, tells which shingles are common; those it has LEAST_COMMON times go last in the
#: order. This only makes groups small: any order finds the same pairs, so the bound on their number (8 bytes each) loses none.
SAMPLED, LEAST_COMMON, MOST_COMMON = 32, 3, 100_000
#: Shingles that the sample has HOT times have SALTS leaders, each of its own part (1 to SALTS, 255 at most) of the rows.
HOT, SALTS = 64, 64
#: Groups under a shingle up to this size are compared pair by pair; beyond, what is not led is compared with the others.
SMALL = 128
#: Parities of shingles kept for a document at least, and those carried with its rows.
PARITIES, FOLDED = 2048, 256


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct 64-bit hashes, in order, of the WIDE_SHINGLE-word shingles; a text with fewer words is one shingle."""
    words = (text or b"").lower().split()
    own = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    h = np.fromiter((own[w] for w in words), np.uint64, len(words))
    out = np.full(1, len(words), np.uint64)
    if len(words) >= WIDE_SHINGLE:
        out = np.full(len(words) - WIDE_SHINGLE + 1, WIDE_SHINGLE, np.uint64)
    for k in range(min(WIDE_SHINGLE, len(words))):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def prefix(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles that a text is put under: enough of the first, the common ones (sorted) last."""
    n = len(grams) - math.ceil(SIMILARITY * len(grams) - 1e-9) + 1
    if not len(common):
        return grams[:n]
    late = _among(grams, common)
    return np.r_[grams[~late], grams[late]][:n]


def _among(x: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which of x are among those, which are in order."""
    if not len(those):
        return np.zeros(len(x), bool)
    return those[np.minimum(np.searchsorted(those, x), len(those) - 1)] == x


def parity(grams: np.ndarray) -> bytes:
    """Parities of classes of shingles, PARITIES or as many as there are shingles (a power of two): two texts' differ in no more
    of them than in shingles, and those of unrelated texts in about half."""
    most = max(PARITIES, 1 << max(0, len(grams) - 1).bit_length())
    odd = np.bincount((grams >> np.uint64(7) & np.uint64(most - 1)).astype(np.int64), minlength=most) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _words(bits: list[bytes], of: int) -> np.ndarray:
    """Parities as rows of 64-bit words, folded (still parities, of larger classes) to so many bits."""
    out = np.empty((len(bits), of // 64), np.uint64)
    sizes = np.fromiter(map(len, bits), np.int64, len(bits))
    for n in np.unique(sizes):
        here = np.flatnonzero(sizes == n)
        for i in range(0, len(here), 1_000):
            some = here[i : i + 1_000]
            rows = np.frombuffer(b"".join(bits[k] for k in some), np.uint64).reshape(len(some), n * 8 // of, of // 64)
            out[some] = np.bitwise_xor.reduce(rows, axis=1)
    return out


def _all_shingles(batches):
    for batch in batches:
        for text in batch.column(0).cast(pa.large_binary()).to_pylist():
            yield pa.record_batch([pa.array(shingles(text).view(np.int64))], names=["key"])


def _spread(common: np.ndarray, hot: np.ndarray):
    """Batches of (doc_id, row, text) to (key, doc_id, row, m): a row for each shingle of the prefix.

    m holds the number of shingles and, in its lower 8 bits, the part that the row belongs to if the key is hot, else 0."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            rows = batch.column(1).to_numpy()
            parts = np.fromiter((1 + xxhash.xxh32_intdigest(str(d), SEED) % SALTS for d in batch.column(0).to_pylist()), np.int64, len(texts))
            for i in range(0, len(texts), 500):
                sets = [shingles(t) for t in texts[i : i + 500]]
                keys = [prefix(g, common) for g in sets]
                which = np.repeat(np.arange(i, i + len(sets)), [len(k) for k in keys])
                n = np.array([len(g) for g in sets], np.int64)[which - i]
                keys = np.concatenate(keys)
                m = n << 8 | np.where(_among(keys, hot), parts[which], 0)
                ids = batch.column(0).take(pa.array(which))
                for j in range(0, len(which), 100_000):
                    part = slice(j, j + 100_000)
                    yield pa.record_batch([pa.array(keys[part].view(np.int64)), ids[part], pa.array(rows[which[part]]), pa.array(m[part])], names=["key", "doc_id", "row", "m"])

    return run


def _led(batches):
    """Batches sorted by key, part, doc_id and row to (key, row, n, leader, leader_n) without the keys of one row (but for some
    at the ends of batches and those of hot keys): the first row of a part of a key leads the others."""
    key = part = leader = leader_n = None
    for batch in batches:
        keys, row, m = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        if not len(keys):
            continue
        parts, n = m & 255, (m >> 8).astype(np.int32)
        new = np.r_[key is None or keys[0] != key or parts[0] != part, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])]
        first = np.flatnonzero(new)
        head, head_n = row[first], n[first]
        if not len(first) or first[0]:  # the batch goes on with what was before
            first, head, head_n = np.r_[0, first], np.r_[leader, head], np.r_[leader_n, head_n]
        size = np.diff(np.r_[first, len(keys)])
        lead, lead_n = np.repeat(head, size), np.repeat(head_n, size).astype(np.int32)
        key, part, leader, leader_n = keys[-1], parts[-1], lead[-1], lead_n[-1]
        met = ~new | np.r_[~new[1:], True] | (parts > 0)
        yield pa.record_batch([pa.array(x[met]) for x in (keys, row, n, lead, lead_n)], names=["key", "row", "n", "leader", "leader_n"])


def _close(n, m):
    """Whether sets of n and m can be SIMILARITY alike."""
    return np.minimum(n, m) >= SIMILARITY * np.maximum(n, m) - 1e-9


def _met(batches):
    """Batches of (key, n, row, doc_id, led, parity) sorted by key and n to pairs (x, y) of rows under one key, x behind y and not
    led, that sizes and parities don't rule out.

    A key's rows, some 60 bytes each, are held until it ends; its pairs are streamed."""
    least = (1 - SIMILARITY) / (1 + SIMILARITY)

    def told(i, j, n, row, none, ids, led, bits):
        """Of places i and j, the pairs to be compared."""
        behind = np.where(none[i] != none[j], none[i], np.where(ids[i] != ids[j], ids[i] > ids[j], row[i] > row[j]))
        x, y = np.where(behind, i, j), np.where(behind, j, i)
        ok = ~led[x] & (row[x] != row[y])
        x, y = x[ok], y[ok]
        ok = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1) <= (n[x] + n[y]) * least + 1e-6
        return pa.record_batch([pa.array(row[x[ok]]), pa.array(row[y[ok]])], names=["x", "y"])

    def pairs(keys, n, *rest):
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[first, len(keys)])
        i, d = np.flatnonzero(np.repeat(size <= SMALL, size)), 0
        while len(i):
            d += 1
            i = i[i + d < len(keys)]
            i = i[(keys[i] == keys[i + d]) & _close(n[i], n[i + d])]
            for k in range(0, len(i), 50_000):
                yield told(i[k : k + 50_000], i[k : k + 50_000] + d, n, *rest)
        led = rest[3]
        for f, t in zip(first[size > SMALL], (first + size)[size > SMALL], strict=True):
            for x in f + np.flatnonzero(~led[f:t]):  # in a large group, few are not led
                lo, hi = f + np.searchsorted(n[f:t], [SIMILARITY * n[x] - 1e-6, n[x] / SIMILARITY + 1e-6])
                for k in range(lo, hi, 50_000):
                    y = np.arange(k, min(hi, k + 50_000))
                    yield told(np.full(len(y), x), y, n, *rest)

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(3)
        held.append((*(batch.column(k).to_numpy() for k in range(3)), ids.is_null().to_numpy(False), ids.fill_null(0).to_numpy(), batch.column(4).to_numpy(False), _words(batch.column(5).to_pylist(), FOLDED)))
        if held[0][0][0] == held[-1][0][-1]:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        end = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1
        yield from pairs(*(c[:end] for c in cols))
        held = [tuple(c[end:] for c in cols)]
    if held:
        yield from pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    known: dict[bytes, np.ndarray] = {}  # pairs of one leader follow each other

    def of(text: bytes | None) -> np.ndarray:
        if (text or b"") not in known:
            if len(known) >= 16:
                known.clear()
            known[text or b""] = shingles(text)
        return known[text or b""]

    return pa.array([similarity(of(y), shingles(x)) >= SIMILARITY for x, y in zip(a.cast(pa.large_binary()).to_pylist(), b.cast(pa.large_binary()).to_pylist(), strict=True)], pa.bool_())


def _parities(texts: pa.Array) -> pa.Array:
    return pa.array([parity(shingles(t)) for t in texts.cast(pa.large_binary()).to_pylist()], pa.binary())


def _folded(bits: pa.Array) -> pa.Array:
    return pa.array([x.tobytes() for x in _words(bits.to_pylist(), FOLDED)], pa.binary())


def _possible(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
    a, b, n = a.to_pylist(), b.to_pylist(), n.to_numpy()
    least = np.fromiter((min(len(x), len(y)) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    ok = np.zeros(len(a), bool)
    for size in np.unique(least):
        at = np.flatnonzero(least == size)
        for k in range(0, len(at), 1_000):
            here = at[k : k + 1_000]
            far = np.bitwise_count(_words([a[i] for i in here], int(size) * 8) ^ _words([b[i] for i in here], int(size) * 8)).sum(axis=1)
            ok[here] = far <= n[here] * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
    return pa.array(ok)


def _picked(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs (with row) that are among ids (row), or are not."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "row", how)


def near_copies(rows: DataFrame) -> DataFrame:
    """rows (row, a number of its own; doc_id, long; text; h, a hash of its content) to the rows (row) that are SIMILARITY or
    more like any document before them (by doc_id, a null one last; rows of one id by their numbers).

    Documents are put under the shingles of their prefixes. Each is first compared with the one of least id under each of its
    shingles (under a hot shingle, with that of its part): so large groups of copies go by linear work. What is not led by any
    is compared with all documents before it that are under one of its shingles and whose sizes and parities allow it, set by
    set. Sample, parts and order only spread the work: what goes does not depend on them, nor on partitions."""
    told = rows.where(F.pmod(F.col("h"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(_all_shingles, "key long").groupBy("key").count()
    told = told.where(F.col("count") >= LEAST_COMMON).orderBy(F.desc("count"), "key").limit(MOST_COMMON).toArrow()  # MOST_COMMON at most
    keys, counts = told["key"].to_numpy().view(np.uint64), told["count"].to_numpy()
    common, hot = np.sort(keys), np.sort(keys[counts >= HOT])
    spread = rows.select("doc_id", "row", "text").mapInArrow(_spread(common, hot), "key long, doc_id long, row long, m long")
    part = F.col("m").bitwiseAND(F.lit(255))
    met = written(spread.repartition(F.col("key"), part).sortWithinPartitions("key", part, F.asc_nulls_last("doc_id"), "row").mapInArrow(_led, "key long, row long, n int, leader long, leader_n int"))
    near = F.least("n", "leader_n") >= SIMILARITY * F.greatest("n", "leader_n") - 1e-9
    pairs = written(met.where((F.col("row") != F.col("leader")) & near).select(F.col("row").alias("x"), F.col("leader").alias("y")).distinct())
    # Of a hot key, a row that leads alone has still to be compared with those of other parts.
    ids = written(met.select(F.explode(F.array("row", "leader")).alias("row")).distinct())
    sizes = met.select("row", F.col("n").cast("long").alias("n")).distinct()
    marks = written(_picked(rows.select("row", "doc_id", "text"), ids, "left_semi").select("row", "doc_id", F.arrow_udf(_parities, "binary")("text").alias("bits")).join(sizes, "row"))

    def copies_of(pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) that are alike: by parities first, then by the sets of shingles."""
        of = lambda k: marks.select(F.col("row").alias(k), F.col("bits").alias(f"bits_{k}"), F.col("n").alias(f"n_{k}"))
        left = written(pairs.join(of("x"), "x").join(of("y"), "y").where(F.arrow_udf(_possible, "boolean")("bits_x", "bits_y", F.col("n_x") + F.col("n_y"))).select("x", "y"))
        texts = written(_picked(rows.select("row", "text"), left.select(F.explode(F.array("x", "y")).alias("row")).distinct(), "left_semi"))
        told = lambda k: texts.select(F.col("row").alias(k), F.col("text").alias(f"text_{k}"))
        return left.join(told("x"), "x").join(told("y"), "y").where(F.arrow_udf(_alike, "boolean")("text_x", "text_y")).select("x", "y")

    led = written(copies_of(pairs).select(F.col("x").alias("row")).distinct())
    rest = met.select("key", "row", "n").join(marks.select("row", "doc_id", F.arrow_udf(_folded, "binary")("bits").alias("bits")).join(led.withColumn("led", F.lit(True)), "row", "left").withColumn("led", F.col("led").isNotNull()), "row")
    left = rest.select("key", "n", "row", "doc_id", "led", "bits").repartition("key").sortWithinPartitions("key", "n", "row").mapInArrow(_met, "x long, y long")
    more = copies_of(written(left.distinct())).select(F.col("x").alias("row"))
    return written(led.unionByName(more).distinct())


def _content(docs: DataFrame, salt: int) -> Column:
    """A 64-bit hash of a whole row; maps count as their JSON."""
    kinds = {f.name: f.dataType for f in docs.schema}
    parts = [F.to_json(F.struct(quoted(c))) if "map<" in kinds[c].simpleString() or "variant" in kinds[c].simpleString() else quoted(c) for c in docs.columns]
    return F.xxhash64(F.lit(salt), *parts)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies, as it is.

    Of each group of linked fingerprints the row of least id stays (none is the least of all; then the least hash of the whole
    row, of rows equal in every column any one); of those, what near_copies tells goes too. Rows are told apart by their id and
    a 128-bit hash of the whole row, later by a number of their own that is written with them, so no two are taken for one."""
    doc_id = whole_id(docs, id_col)
    key = F.struct(doc_id.alias("id"), _content(docs, 1).alias("h"), _content(docs, 2).alias("g"))
    keyed = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), key.alias("key"))
    found = near_duplicates(keyed.select("key", F.col("doc").getField(text_col).alias("text")), id_col="key")
    kept = written(found.where(F.col("id") == F.col("component")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(F.col("id.h").alias("k_h"), F.col("id.g").alias("k_g"), F.col("id.id").alias("k_id"), "n"))
    met = keyed.join(kept, (F.col("key.h") == F.col("k_h")) & (F.col("key.g") == F.col("k_g")) & F.col("key.id").eqNullSafe(F.col("k_id")))
    one = met.where("n = 1").select("doc", "key")
    if not kept.where("n > 1").isEmpty():
        one = one.unionByName(met.where("n > 1").groupBy("k_h", "k_g", "k_id").agg(F.first("doc").alias("doc"), F.first("key").alias("key")).select("doc", "key"))
    rows = written(one.select("doc", F.col("key.id").alias("doc_id"), F.col("key.h").alias("h"), F.monotonically_increasing_id().alias("row")))
    copies = near_copies(rows.select("row", "doc_id", "h", F.col("doc").getField(text_col).alias("text")))
    return _picked(rows.select("row", "doc"), copies, "left_anti").select("doc.*")
