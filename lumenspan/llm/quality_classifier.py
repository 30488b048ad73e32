"""Compression classifier of quality.

Two zstandard dictionaries are built, one from text labelled good and one from text labelled bad. A text is compressed in
blocks of BLOCK bytes, each block alone, with either dictionary and with none, the whole text through; the difference of the
two sizes over the text's length, with the sizes themselves and the length, goes through a logistic calibration fitted on
labelled rows that took no part in the dictionaries. Labels, languages, sources and ids are never part of a score.

What is fitted on is a sample of the labelled rows, bounded by SAMPLE_ROWS rows and SAMPLE_BYTES bytes for each class and
picked by a hash of the id. Everything else runs over all rows. The model (two dictionaries of DICT_BYTES and 15 numbers) is
all that the executors are sent.

Defined cases: null and empty texts are scored as texts of length 0; labels that are null or neither 0 nor 1, or name no
document, are left out; where a class has no labelled text its dictionary is empty, and where only one class or none is
labelled the score is the share of good labels (0.5 without any); repeated rows and null ids are rows of their own;
ids that are no integers raise at once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, whole_id, written

BLOCK = 512
DICT_BYTES = 32_768
LEVEL = 3
SAMPLE_ROWS = 5_000
SAMPLE_BYTES = 8_000_000
#: A score from here on predicts label 1.
KEEP_FROM = 0.3
FOLDS = 5


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float] | None
    centre: list[float]
    scale: list[float]
    prior: float


class Scorer:
    """A model, ready to compress; made once for a task."""

    def __init__(self, model: Model):
        self.model = model
        self.good, self.bad, self.plain = (self._compressor(d) for d in (model.good, model.bad, b""))

    @staticmethod
    def _compressor(data: bytes):
        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False}
        if data:
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            options["dict_data"] = d
        return zstandard.ZstdCompressor(**options)

    def features(self, text: bytes | None) -> list[float]:
        text = text or b""
        n, g, b, p = max(1, len(text)), 0, 0, 0
        for i in range(0, len(text), BLOCK):
            block = text[i : i + BLOCK]
            g += len(self.good.compress(block))
            b += len(self.bad.compress(block))
            p += len(self.plain.compress(block))
        return [(b - g) / n, g / n, p / n, math.log1p(n)]

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        m = self.model
        if m.weights is None:
            return np.full(len(texts), m.prior)
        x = _terms(np.array([self.features(t) for t in texts], float).reshape(len(texts), 4))
        return _sigmoid(((x - np.array(m.centre)) / np.array(m.scale)) @ np.array(m.weights))


def _terms(x: np.ndarray) -> np.ndarray:
    """1, the features and their products."""
    return np.column_stack([np.ones(len(x)), x, *(x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i + 1))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        s = _sigmoid(x @ w)
        w -= np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (s - y) + ridge * w)
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself is the dictionary
        return b"".join(blocks)[-DICT_BYTES:]


def fit(rows: list[tuple[int, bytes, int]]) -> Model:
    """(id, text, label) rows to a model: one half, by a hash of the id, for the dictionaries, the other for the calibration."""
    half = lambda r: zlib.crc32(f"half-{r[0]}".encode()) % 2
    good, bad = (_dictionary([r[1] for r in rows if r[2] == q and not half(r)]) for q in (1, 0))
    rest = [r for r in rows if half(r)]
    prior = sum(r[2] for r in rows) / len(rows) if rows else 0.5
    model = Model(good, bad, None, [], [], prior)
    y = np.array([r[2] for r in rest], float)
    if len(set(y)) == 2:
        scorer = Scorer(model)
        x = _terms(np.array([scorer.features(r[1]) for r in rest]))
        centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        centre[0], scale[0] = 0, 1
        model = Model(good, bad, _logistic((x - centre) / scale, y).tolist(), centre.tolist(), scale.tolist(), prior)
    return model


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, bytes, int]]:
    """The labelled rows to fit on: of each class the first SAMPLE_ROWS by hash, as far as SAMPLE_BYTES go; no held-out ones."""
    whole_id(docs), whole_id(labels)  # others than integers raise here
    seen = labels.where("doc_id is not null and quality in (0, 1)").where(bucket(F.col("doc_id"), FOLDS) != 0)
    seen = seen.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.count_distinct("quality").alias("n")).where("n = 1").drop("n")
    # Of a repeated id the text of least hash counts; its size is known before any text is collected.
    labelled = docs.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes")).join(seen, "doc_id")
    sized = written(labelled.groupBy("doc_id", "quality").agg(F.min(F.struct("h", "bytes")).alias("t")).select("doc_id", "quality", "t.*"))
    chosen = []
    for q in (0, 1):
        left = SAMPLE_BYTES
        for r in sized.where(F.col("quality") == q).orderBy(F.crc32(F.concat(F.lit("sample-"), F.col("doc_id").cast("string"))), "doc_id").limit(SAMPLE_ROWS).collect():
            if 0 < r.bytes <= left:
                chosen.append((r.doc_id, q, r.h))
                left -= r.bytes
    if not chosen:
        return []
    picked = docs.sparkSession.createDataFrame(sorted(chosen), "doc_id long, quality int, h long")  # bounded by SAMPLE_ROWS
    found = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(picked), ["doc_id", "h"]).groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    return sorted((r.doc_id, r.text.encode(), r.quality) for r in found)


def quality_score(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for texts in batches:
            yield pa.array(scorer.scores(texts.cast(pa.large_binary()).to_pylist()), pa.float64())

    return run(text)


def keep_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents whose score is keep_from or more; rows and columns stay as they are."""
    model = fit(sample(docs, labels))
    return docs.where(quality_score(model, F.col("text")) >= keep_from)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")))
    scored = docs.select("doc_id", (bucket(F.col("doc_id"), FOLDS) == 0).alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))
