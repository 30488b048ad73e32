"""Token-ID output in training order.

Texts become token ids, with the end-of-text id behind each, cut into sequences of SEQ_LEN ids; a text's last sequence may be
shorter. The sequences are numbered through in an order that the data alone decides: documents by a hash of id and text (ties
by id and token ids, so that only equal rows tie, and those are interchangeable), each one's sequences in a row. Documents go
to as many partitions as the session shuffles to, by ranges of the hash, are sorted there, and a running number within plus
what the ranges before hold is the number; neither files, splits, cores nor the number of ranges change it. A keyed Feistel
permutation sends each number to its global slot: it permutes the least even power of two that holds all numbers, and walks
on along its cycle until it lands below their count, so it is a permutation of exactly the slots. Slots are dense, so their
ranges are known without sampling: each range becomes one shard of records of one fixed stride; a task sorts and writes one, or
a few where there are more shards than the session has shuffle partitions.
Slot s stands in shard s // per_shard at byte (s % per_shard) * stride: any place can be read or resumed by a seek, one epoch
in order is one sequential read. The same documents and key give the same shards, so what was written can be resumed.

Texts are tokenised once; their ids are written as a table, so a lost executor costs no tokenising twice.

Record: doc_id int64, seq_no int32, n_tokens int32, then SEQ_LEN unsigned ids of 2 bytes (4 for vocabularies over 65,536),
little-endian, unused ones 0. A null doc_id is the least int64.

Copies of one row (id and text alike) share a range of the hash, since nothing tells their places apart; their ids are streamed
through its task, sorted on disk.

Defined cases: null and empty texts have one sequence, of the end-of-text id alone; repeated rows and null ids are rows of
their own; ids that are no integers raise at once; an empty table gives no record and no shard; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import atexit
import base64
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.operators.store import remove, shared_dir

from .common import freed, whole_id, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary cuts text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEQ_LEN = 512
HEADER = np.dtype([("doc_id", "<i8"), ("seq_no", "<i4"), ("n_tokens", "<i4")])
SHARD_BYTES = 32 << 20
KEY = 20_240_229
ROUNDS = 6
NO_ID = -(1 << 63)
#: Records read from a shard at once.
READ = 5_000
#: Rounds in which shards are written.
PARTS = 4


class Tokens:
    """A tokeniser, made of the bytes of its vocabulary file."""

    def __init__(self, data: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        self.end = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        return np.array([*self.encoding.encode_ordinary(text or ""), self.end], self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode([int(x) for x in ids if x != self.end])


_MADE: dict[str, Tokens] = {}


def _tokens(key: str, data: bytes) -> Tokens:
    """Made once in a worker."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Tokens(data)
    return _MADE[key]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of indices below n: a keyed Feistel permutation of [0, n), by cycle-walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix(np.uint64(key % (1 << 64)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        return left << shift | right

    out = once(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _sizes(cells: pa.Array) -> np.ndarray:
    """Bytes of each cell of a binary column."""
    return np.diff(np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]).astype(np.int64)


def sequences(docs: DataFrame, vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN, key: int = KEY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(slot, shard, at, doc_id, seq_no, n_tokens, record): every sequence at its slot; each partition holds whole shards, in order."""
    shards, records = numbered(docs, vocabulary, seq_len, key, shard_bytes)
    return records(0, shards)


def numbered(docs: DataFrame, vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN, key: int = KEY, shard_bytes: int = SHARD_BYTES) -> tuple[int, Callable[[int, int], DataFrame]]:
    """The number of shards, and a function that gives the rows of shards first to last - 1, from texts tokenised once."""
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())  # one file, of 1 MB
    name = uuid.uuid4().hex
    dtype = Tokens(vocab.value).dtype
    width = seq_len * dtype.itemsize
    stride = HEADER.itemsize + width

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(name, vocab.value)
        for batch in batches:
            ids = [tokens.encode(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["h", "doc_id", "ids"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0  # the range before, and what it holds so far
        for batch in batches:
            if not batch.num_rows:
                continue
            part, n = batch.column(0).to_numpy(), -(-_sizes(batch.column(2)) // width)
            before = np.cumsum(n) - n
            starts = np.flatnonzero(np.r_[part[0] != last, part[1:] != part[:-1]])
            base = np.full(len(n), held if part[0] == last else 0)
            for at in starts:
                base[at:] = -before[at]
            firsts = before + base
            last, held = part[-1], int(firsts[-1] + n[-1])
            yield pa.record_batch([batch.column(0), pa.array(firsts, pa.int64()), pa.array(n), batch.column(1), batch.column(2)], names=["part", "first", "n", "doc_id", "ids"])

    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The hash's upper 31 bits, as a share of 2^31, tell the range.
    part = F.shiftright(F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(NO_ID)), 33) * ranges, 31).cast("int")
    keyed = docs.select(F.xxhash64(whole_id(docs), "text").alias("h"), whole_id(docs).alias("doc_id"), "text").mapInArrow(tokenise, "h long, doc_id long, ids binary")
    sorted_ = keyed.withColumn("part", part).repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "h", "doc_id", "ids")
    with freed(spark):
        made = written(sorted_.select("part", "doc_id", "ids").mapInArrow(number, "part int, first long, n long, doc_id long, ids binary"), compression="zstd")
    counts = sorted((r.part, r.n) for r in made.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row for each range
    before, total = {}, 0
    for k, n in counts:
        before[k], total = total, total + n
    per_shard = max(1, shard_bytes // stride)

    def place(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if not rows:
                continue
            index = np.concatenate([before[p] + f + np.arange(n) for p, f, n, _, _ in rows])
            slots = permute(index, total, key)
            taken = (slots >= low) & (slots < high)
            if not taken.any():
                continue
            every = ((d, k, ids) for _, _, n, d, ids in rows for k in range(n))
            pieces = [(d, k, ids[k * width : (k + 1) * width]) for (d, k, ids), t in zip(every, taken.tolist(), strict=True) if t]
            slots = slots[taken]
            doc_id, seq_no, ids = zip(*pieces, strict=True)
            for i in range(0, len(slots), 5_000):
                s = slice(i, i + 5_000)
                yield pa.record_batch([pa.array(slots[s]), pa.array((slots[s] // per_shard).astype(np.int32)), pa.array(doc_id[s], pa.int64()), pa.array(seq_no[s], pa.int32()), pa.array(ids[s], pa.binary())], names=["slot", "shard", "doc_id", "seq_no", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(0).to_numpy()
            ids = batch.column(4).to_pylist()
            n = [len(x) // dtype.itemsize for x in ids]
            head = np.empty(len(n), HEADER)
            head["doc_id"], head["seq_no"], head["n_tokens"] = batch.column(2).fill_null(NO_ID).to_numpy(), batch.column(3).to_numpy(), n
            raw = head.tobytes()
            records = [raw[i * HEADER.itemsize : (i + 1) * HEADER.itemsize] + x.ljust(stride - HEADER.itemsize, b"\0") for i, x in enumerate(ids)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(slots % per_shard * stride), batch.column(2), batch.column(3), pa.array(n, pa.int32()), pa.array(records, pa.binary())], names=["slot", "shard", "at", "doc_id", "seq_no", "n_tokens", "record"])

    def records(first: int, last: int) -> DataFrame:
        within = lambda batches: place(batches, first * per_shard, last * per_shard)
        each = -(-max(1, last - first) // ranges)  # shards of a task, one after the other: no more tasks than the session shuffles to
        dealt = made.mapInArrow(within, "slot long, shard int, doc_id long, seq_no int, ids binary")
        dealt = dealt.repartitionById(-(-max(1, last - first) // each), F.floor((F.col("shard") - first) / each).cast("int"))
        return dealt.sortWithinPartitions("slot").mapInArrow(pack, "slot long, shard int, at long, doc_id long, seq_no int, n_tokens int, record binary")

    return -(-total // per_shard), records


def write_all(docs: DataFrame, uri: str, parts: int = PARTS, **options) -> list[dict]:
    """write_shards() of sequences(docs, **options), a range of shards after the other, in `parts` rounds of about the same size.

    Each round reads the numbered ids again and moves its own share alone, so 1 / parts of the records are in a shuffle."""
    shards, records = numbered(docs, **options)
    ends = [shards * k // parts for k in range(parts + 1)]
    return write_shards([records(a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b] or [records(0, 0)], uri)


def write_shards(records: DataFrame | list[DataFrame], uri: str) -> list[dict]:
    """Writes each shard of sequences() to uri/shard-NNNNN.bin and the manifest beside them; returns the manifest's shards.
    A list of tables of different shards is written one after the other.

    A task writes under a name of its own and moves the whole file into place, so repeated and lost attempts leave no half
    shard. uri is a folder that executors share, or any store that pyarrow.fs opens."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(top, recursive=True)
        shard, out, path, told = None, None, "", []

        def close():
            out[0].close()
            fs.move(path, f"{top}/shard-{shard:05d}.bin")
            told.append((shard, *out[1:4], out[4].hexdigest()))

        for batch in batches:
            for slot, s, record in zip(batch.column("slot").to_pylist(), batch.column("shard").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if s != shard:
                    if out:
                        close()
                    shard, path = s, f"{top}/.shard-{s:05d}-{uuid.uuid4().hex}"
                    out = [fs.open_output_stream(path), slot, 0, len(record), hashlib.sha256()]
                out[0].write(record)
                out[2] += 1
                out[4].update(record)
        if out:
            close()
        cols = list(zip(*told, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["shard", "first_slot", "n", "stride", "sha256"])

    tables = records if isinstance(records, list) else [records]
    with freed(tables[0].sparkSession):
        told = [r.asDict() for t in tables for r in t.mapInArrow(write, "shard int, first_slot long, n long, stride long, sha256 string").collect()]  # a row for each shard
    told.sort(key=lambda s: s["shard"])  # here, since an ordered query would run the tasks once more to sample their rows
    fs, top = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/manifest.json") as f:
        f.write(json.dumps({"shards": told}).encode())
    return told


def read_shards(uri: str, vocabulary: str = VOCABULARY, start: int = 0) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(slot, doc_id, seq_no, ids) from slot start on, in order."""
    dtype = Tokens(Path(vocabulary).read_bytes()).dtype
    fs, top = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(f"{top}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]
    for s in shards:
        if s["first_slot"] + s["n"] <= start:
            continue
        with fs.open_input_file(f"{top}/shard-{s['shard']:05d}.bin") as f:
            first = max(start, s["first_slot"])
            f.seek((first - s["first_slot"]) * s["stride"])
            for slot in range(first, s["first_slot"] + s["n"]):
                record = f.read(s["stride"])
                head = np.frombuffer(record[: HEADER.itemsize], HEADER)[0]
                yield slot, int(head["doc_id"]), int(head["seq_no"]), np.frombuffer(record[HEADER.itemsize :], dtype)[: head["n_tokens"]]


def shard_rows(spark: SparkSession, uri: str) -> DataFrame:
    """(slot, shard, at, doc_id, seq_no, n_tokens, record) of the shards in uri, as sequences() gave them to write_shards().

    A task reads one shard front to back, READ records at a time. The least int64 as doc_id is null; a shard that is shorter
    than the manifest says, or of another digest, raises."""
    fs, top = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(f"{top}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]
    told = spark.createDataFrame([tuple(s[c] for c in ("shard", "first_slot", "n", "stride", "sha256")) for s in shards], "shard int, first_slot long, n long, stride long, sha256 string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for shard, first, n, stride, want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path, digest = f"{top}/shard-{shard:05d}.bin", hashlib.sha256()
                with fs.open_input_file(path) as f:
                    for k in range(0, n, READ):
                        m = min(READ, n - k)
                        data = f.read(m * stride)
                        digest.update(data)
                        if len(data) < m * stride or (k + m == n and digest.hexdigest() != want):
                            raise OSError(f"{path} is not what the manifest says")
                        head = np.frombuffer(data, np.uint8).reshape(m, stride)[:, : HEADER.itemsize].copy().view(HEADER)[:, 0]
                        ids, seq_no, n_tokens = (np.ascontiguousarray(head[c]) for c in HEADER.names)
                        at = np.arange(k, k + m)
                        cells = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer((np.arange(m + 1) * stride).astype(np.int32)), pa.py_buffer(data)])
                        yield pa.record_batch([pa.array(first + at), pa.array(np.full(m, shard, np.int32)), pa.array(at * stride), pa.array(ids, mask=ids == NO_ID), pa.array(seq_no), pa.array(n_tokens), cells], names=["slot", "shard", "at", "doc_id", "seq_no", "n_tokens", "record"])

    tasks = min(max(1, len(shards)), max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    each = told.repartitionById(tasks, F.col("shard") % tasks)
    return each.mapInArrow(read, "slot long, shard int, at long, doc_id long, seq_no int, n_tokens int, record binary")


def _shard_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, removed when the driver exits."""
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    if path.startswith("/"):
        return f"file://{path}"
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def materialised(docs: DataFrame, **options) -> DataFrame:
    """The rows of shards that it writes, with their manifest, to a new place in the shared folder."""
    folder = _shard_folder(docs.sparkSession)
    write_all(docs, folder, **options)
    return shard_rows(docs.sparkSession, folder)


def op2_token_order(spark, sf_dir: str) -> DataFrame:
    """Writes the shards of documents; the rows are read from there."""
    return materialised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
