"""LM scoring: prediction by partial matching over byte contexts, and word counts beside it.

Training counts, over all training documents, how often each byte (A-Z lower-cased) and the end of the text follow each ORDER
bytes before them, across words; before a text stands the boundary. The counts of shorter contexts are sums of these. That is a
trie of all contexts of up to ORDER bytes that the corpus holds; it has no bound and is a table. A byte is told by the longest
context that was seen: with n counts of N and d different symbols there it has n / (N + d); one not seen there costs the escape
d / (N + d) (method C) and is told by the next shorter context, with all that the longer one has seen excluded: its counts are
divided by R + D, for R counts of D symbols left. Below the shortest, the symbols never seen share alike. A text's score is the
sum of the logarithms over all of it and its end; nothing is cut.

What a gram (context and symbol) costs depends on the gram alone. So texts are cut into blocks of about BLOCK bytes, each block
asks once for each gram and each word that it holds, and the trie answers by equality joins: a gram with its own counts
and those of its context, then, order by order, with the answer of the gram that is one byte shorter. Answers and texts
then come to a task sorted by block, answers first, and are added up. A hot gram or word has a row for each block, not for each place; a block holds BLOCK bytes or one
text, and no more grams than that, so copies of a text, hot sources and the like spread over blocks. Nothing is broadcast or
collected but totals. Texts are looked at PART bytes at a time, within a text as well.

Defined cases: null and empty texts consist of the end alone; without training documents N and V are 0 and all symbols are
alike; repeated rows and null ids are rows of their own; ids that are no integers raise at once; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, freed, quoted, whole_id, written

ORDER = 5  # six at most: a gram is a long
EDGE = 255  # the boundary symbol: no byte of UTF-8
SYMBOLS = 256
FOLDS = 10
END = "\n"  # the end token; no word holds white space
BLOCK = 48 << 20
PART = 1 << 20
#: Different grams or words that a task keeps before it hands them on.
FLUSH = 4_000_000
ROWS = 100_000
#: Answers that are packed at a time, into one row for each block among them.
PACKED = 500_000
_LOWER = np.arange(SYMBOLS, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[EDGE] = EDGE - 1


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, lower-cased, each after ORDER boundaries and before one; and where each text starts."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lengths = np.diff(offsets)
    starts = np.r_[0, np.cumsum(lengths + ORDER + 1)]
    out = np.full(starts[-1], EDGE, np.uint8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for start, at, n in zip(starts, offsets, lengths, strict=False):
        out[start + ORDER : start + ORDER + n] = _LOWER[data[at : at + n]]
    return out, starts[:-1]


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first, texts from there on), no more than PART bytes at a time as far as they can be told apart."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).to_numpy(False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def _grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which text, gram) of every symbol. In a gram, the byte just before the symbol is the highest and the symbol the lowest."""
    for first, part in _parts(texts):
        flat, starts = _flat(part)
        told = np.ones(len(flat), bool)
        for i in range(ORDER):
            told[starts + i] = False
        for lo in range(ORDER, len(flat), PART):
            hi = min(lo + PART, len(flat))
            gram = flat[lo - 1 : hi - 1].astype(np.int64)
            for i in range(2, ORDER + 1):
                gram = gram << 8 | flat[lo - i : hi - i]
            kept = told[lo:hi]
            a, b = np.searchsorted(starts, (lo, hi - 1), "right")  # the texts a - 1 to b - 1 have symbols here
            many = np.add.reduceat(kept, np.r_[0, starts[a:b] - lo], dtype=np.int64)
            yield np.repeat(first + np.arange(a - 1, b), many), (gram << 8 | flat[lo:hi])[kept]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


class _Counts:
    """Words and grams of the texts seen, handed on as rows (block, word, gram, n)."""

    def __init__(self):
        self.words: Counter[bytes] = Counter()
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.merged = self.size = 0

    def add(self, texts: pa.Array) -> bool:
        """Takes the texts; says whether it is full."""
        for t in texts.cast(pa.large_binary()).to_pylist():
            self.words.update(_words(t))
        self.words[END.encode()] += len(texts)
        for _, g in _grams(texts):
            self.grams.append(np.unique(g, return_counts=True))
            self.size += len(self.grams[-1][0])
            if self.size > self.merged + FLUSH // 2:
                self.grams = [_merged(self.grams)]
                self.size = self.merged = len(self.grams[0][0])
        return len(self.words) > FLUSH or self.merged > FLUSH

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        words, grams = list(self.words.items()), _merged(self.grams) if self.grams else ([], [])
        self.__init__()

        def told(words: pa.Array, grams: pa.Array, n) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(n), block)), words, grams, pa.array(n, pa.int64())], names=["block", "word", "gram", "n"])

        for i in range(0, len(words), ROWS):
            w, n = zip(*words[i : i + ROWS], strict=True)
            yield told(pa.array([x.decode() for x in w]), pa.nulls(len(n), pa.int64()), n)
        for i in range(0, len(grams[0]), ROWS):
            n = grams[1][i : i + ROWS]
            yield told(pa.nulls(len(n), pa.string()), pa.array(grams[0][i : i + ROWS]), n)


_FOUND = "block long, word string, gram long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, text), the rows of a block together, to the words and grams of each block and their counts."""
    seen, block = _Counts(), None
    for batch in batches:
        blocks = batch.column(0).to_numpy(False)
        for lo, hi in _runs(blocks):
            if block is not None and block != blocks[lo]:
                yield from seen.rows(block)
            block = int(blocks[lo])
            if seen.add(batch.column(1).slice(lo, hi - lo)):
                yield from seen.rows(block)
    if block is not None:
        yield from seen.rows(block)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of its block to each row; a block ends with the text that fills it."""
    first, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        if batch.num_rows:
            sizes = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_binary())), 0).to_numpy(False)
            ends = size + np.cumsum(sizes)
            yield batch.append_column("block", pa.array(first + (ends - sizes) // BLOCK))
            size = int(ends[-1])


class Model:
    """The trie: grams (k, gram, n), contexts (k, context, total, kinds, above), for each order k; words (word, n) and totals."""

    def __init__(self, grams: DataFrame, contexts: DataFrame, words: DataFrame, n: int, v: int):
        self.grams, self.contexts, self.words, self.n, self.v = grams, contexts, words, n, v


def _of_order(name: str = "gram"):
    """The gram with its context cut to k bytes."""
    return F.expr(f"shiftleft(shiftright({name}, 8 * ({ORDER} - k) + 8), 8) | ({name} & 255)").alias("gram")


def _orders(grams: DataFrame, *more: str) -> DataFrame:
    return grams.select("gram", *more, F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")).select("k", _of_order(), *more)


#: The gram that is one byte shorter.
PARENT = "shiftleft(shiftright(gram, 16), 8) | (gram & 255)"


def train(docs: DataFrame, text_col: str = "text") -> Model:
    found = docs.select(F.lit(0).cast("long").alias("block"), quoted(text_col)).mapInArrow(_count, _FOUND)
    with freed(docs.sparkSession):
        counts = written(found.groupBy("word", "gram").agg(F.sum("n").alias("n")))
    words = counts.where("word is not null").select("word", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    with freed(docs.sparkSession):
        grams = written(_orders(counts.where("gram is not null"), "n").groupBy("k", "gram").agg(F.sum("n").alias("n")))
    shorter = grams.select((F.col("k") + 1).alias("k"), F.col("gram").alias("parent"), F.col("n").alias("over"))
    met = grams.withColumn("parent", F.expr(PARENT)).join(shorter, ["k", "parent"], "left")
    contexts = met.groupBy("k", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("over").alias("above"))
    with freed(docs.sparkSession):
        contexts = written(contexts)
    return Model(grams, contexts, words, total.n, total.v)


def costs(asked: DataFrame, model: Model) -> DataFrame:
    """(gram, cost): log10 of the probability of every different gram of asked, after its whole context."""
    grams = _orders(asked.select("gram").distinct()).distinct().withColumn("context", F.shiftright("gram", 8))
    known = written(grams.join(model.grams, ["k", "gram"], "left").join(model.contexts, ["k", "context"], "left").withColumn("parent", F.expr(PARENT)))
    n, total, kinds = F.col("n"), F.col("total"), F.col("kinds")
    escape = F.log10(kinds / (total + kinds))
    # as_first: the cost where the search starts in this context; as_next: after an escape from it.
    as_next = -F.log10(F.lit(SYMBOLS) - F.coalesce(kinds, F.lit(0)))
    as_first = F.when(total.isNull(), as_next).when(n.isNotNull(), F.log10(n / (total + kinds))).otherwise(escape + as_next)
    told = known.where("k = 0").select(F.col("gram").alias("parent"), n.alias("p_n"), total.alias("p_total"), kinds.alias("p_kinds"), as_first.alias("p_first"), as_next.alias("p_next"))
    left, new = F.col("p_total") - F.col("above"), F.col("p_kinds") - kinds
    for k in range(1, ORDER + 1):
        passed = F.when(new > 0, F.log10(new / (left + new))).otherwise(0.0) + F.col("p_next")
        as_next = F.when(F.col("p_n").isNotNull(), F.log10(F.try_divide("p_n", left + new))).otherwise(passed)
        as_first = F.when(total.isNull(), F.col("p_first")).when(n.isNotNull(), F.log10(n / (total + kinds))).otherwise(escape + as_next)
        told = known.where(F.col("k") == k).join(told, "parent").select(F.col("gram").alias("parent"), n.alias("p_n"), total.alias("p_total"), kinds.alias("p_kinds"), as_first.alias("p_first"), as_next.alias("p_next"))
    return told.select(F.col("parent").alias("gram"), F.col("p_first").cast("float").alias("cost"))


_ANSWERS = "block long, grams binary, costs binary, words binary, n binary"
_DOC = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


class _Told:
    """What each gram of a block costs and how often each of its words was seen."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.seen: dict[bytes, int] = {}
        self.keys, self.cost, self.base, self.unseen = None, None, None, None

    def add(self, rows: pa.RecordBatch) -> None:
        for grams, costs, words, n in zip(*(rows.column(c).to_pylist() for c in ("grams", "costs", "words", "n")), strict=True):
            if grams is not None:
                self.parts.append((_open(grams), np.frombuffer(costs, np.float32)))
            if words is not None:
                self.seen.update(zip(words.split(b" "), np.frombuffer(n, np.int64).tolist(), strict=True))

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.keys is None:
            keys, cost = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts, order = [], np.argsort(keys, kind="stable")
            order = order[np.r_[True, np.diff(keys[order]) > 0]]
            self.keys, self.cost = pd.Index(keys[order]), cost[order]
        score = np.zeros(len(texts))
        for which, gram in _grams(texts):
            coded = pa.array(gram).dictionary_encode()  # each different gram is looked up once
            at = self.keys.get_indexer(coded.dictionary.to_numpy())
            if len(at) and at.min() < 0:
                raise LookupError("a block holds a gram that it has not asked for")
            score += np.bincount(which, self.cost[at][coded.indices.to_numpy()], len(texts))
        return score

    def counted(self, texts: list[bytes | None], floor: float) -> Iterator[tuple[int, int, float]]:
        """(tokens, known ones, base score) of each text."""
        if self.base is None:
            self.base = {w: math.log10(c + 0.1) - floor for w, c in self.seen.items()}
            self.unseen = {w for w, c in self.seen.items() if not c}
        for text in texts:
            words = [*_words(text), END.encode()]
            yield len(words), len(words) - sum(map(self.unseen.__contains__, words)), sum(map(self.base.__getitem__, words))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each run of equal values starts and ends."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True) if len(values) else iter(())


def _shut(grams: np.ndarray) -> bytes:
    """Ascending grams as their steps, the bytes of one place together, compressed."""
    steps = np.diff(grams, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8)
    return len(grams).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(steps.T).tobytes(), "zstd", asbytes=True)


def _open(shut: bytes) -> np.ndarray:
    n = int.from_bytes(shut[:8], "little")
    places = np.frombuffer(pa.decompress(shut[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(places.T).view(np.int64).ravel())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram, cost, word, n) to _ANSWERS, one row for each block among PACKED of them. Words are parted by spaces, which none holds."""
    kept: list[pa.RecordBatch] = []

    def flush():
        rows = pa.Table.from_batches(kept)
        kept.clear()
        blocks = rows.column("block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        blocks, costs, n = blocks[order], rows.column("cost").fill_null(0).to_numpy()[order], rows.column("n").fill_null(0).to_numpy()[order]
        grams, words = rows.column("gram").fill_null(0).to_numpy()[order], rows.column("word").take(pa.array(order)).cast(pa.binary())
        is_word = words.is_valid().to_numpy()
        out = []
        for lo, hi in _runs(blocks):
            w = is_word[lo:hi]
            row = [int(blocks[lo]), None, None, None, None]
            if not w.all():
                at = np.argsort(grams[lo:hi][~w], kind="stable")
                row[1:3] = _shut(grams[lo:hi][~w][at]), costs[lo:hi][~w][at].tobytes()
            if w.any():
                row[3:] = b" ".join(words.slice(lo, hi - lo).drop_null().to_pylist()), n[lo:hi][w].tobytes()
            out.append(row)
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)], names=["block", "grams", "costs", "words", "n"])

    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            if sum(k.num_rows for k in kept) >= PACKED:
                yield flush()
    if kept:
        yield flush()


def _add(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block: first what is told of it, then its texts."""
        block, told = None, _Told()
        for batch in batches:
            blocks = batch.column("block").to_numpy(False)
            for lo, hi in _runs(blocks):
                if blocks[lo] != block:
                    block, told = blocks[lo], _Told()
                rows = batch.slice(lo, hi - lo)
                cut = int(np.searchsorted(rows.column("is_text").to_numpy(False), 1))
                if cut:
                    told.add(rows.slice(0, cut))
                texts = rows.slice(cut)
                if texts.num_rows:
                    scores = told.scores(texts.column("text"))
                    n, known, base = zip(*told.counted(texts.column("text").cast(pa.large_binary()).to_pylist(), floor), strict=True)
                    yield pa.record_batch([texts.column("doc_id"), texts.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, held_out, text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) for every document."""
    rows = docs.select(whole_id(docs).alias("doc_id"), held_out.alias("held_out"), quoted(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Fewer tasks make larger blocks, and those ask less often for the same.
    tasks = max(math.ceil(size / BLOCK), docs.sparkSession.sparkContext.defaultParallelism)
    with freed(docs.sparkSession):
        texts = written(rows.coalesce(tasks).mapInArrow(_blocks, "doc_id long, held_out boolean, text string, block long"), "zstd")
        asked = written(texts.select("block", "text").mapInArrow(_count, _FOUND).select("block", "word", "gram"), "zstd")
        answers = written(costs(asked.where("gram is not null"), model), "zstd")
    none = lambda kind: F.lit(None).cast(kind)
    grams = asked.where("gram is not null").select("block", "gram").join(answers, "gram").select("block", "gram", "cost", none("string").alias("word"), none("long").alias("n"))
    words = asked.where("word is not null").select("block", "word").join(model.words, "word", "left").select("block", none("long").alias("gram"), none("float").alias("cost"), "word", F.coalesce("n", F.lit(0)).alias("n"))
    told = grams.mapInArrow(_packed, _ANSWERS).unionByName(words.mapInArrow(_packed, _ANSWERS)).withColumn("is_text", F.lit(0))
    met = told.unionByName(texts.withColumn("is_text", F.lit(1)), allowMissingColumns=True)
    floor = math.log10(model.n + 0.1 * (model.v + 1))
    return met.repartition("block").sortWithinPartitions("block", "is_text").mapInArrow(_add(floor), _DOC)


def op7_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = bucket(F.col("doc_id"), FOLDS) == 0
    model = train(docs.where(~held_out))
    return score(docs, model, held_out).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
