"""The rolling window over followed tables, as keyed state: what came in, once each, and what left when its time was over.

The stream of source.follow() is grouped by table and by a bucket of the id, so that a hot table is many keys. A key's state, in the
state store of the query's checkpoint, is: the ids told that may be read again (those above mark - grace; older ones are forgotten
as the mark moves on), the rows of the window, packed by the batches they came in, and the mark. Timers by processing time take rows out. A round that is run again
begins with the state of the round before, so it tells the same rows.

The result is a stream of changes: a row with change "in" when it is met first, with change "out" when it leaves. current() makes the
window of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "env string, db string, table string, id long, mark long, seen_at timestamp, columns array<string>, values array<string>, change string"
KEYS = ["env", "db", "table", "bucket"]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


ROWS = pa.schema([("id", pa.int64()), ("columns", pa.list_(pa.string())), ("values", pa.list_(pa.string()))])


def _packed(rows: pd.DataFrame) -> bytes:
    """ROWS as one value."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(pa.record_batch([pa.array(rows[f.name].tolist(), f.type) for f in ROWS], schema=ROWS))
    return out.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(rows)).read_pandas()


class _Ids:
    """A set of ids: sorted arrays, each at least twice as long as the one after it."""

    def __init__(self, ids: np.ndarray):
        self._runs = [np.sort(ids)] if len(ids) else []

    def lacks(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for run in self._runs:
            out &= run[np.minimum(np.searchsorted(run, ids), len(run) - 1)] != ids
        return out

    def add(self, ids: np.ndarray) -> None:
        while self._runs and len(self._runs[-1]) < 2 * len(ids):
            ids = np.concatenate([self._runs.pop(), ids])
        self._runs.append(np.sort(ids))


class ArrivalWindow(StatefulProcessor):
    """A call of the state store takes as long as hundreds of rows, so there is one for a batch of rows, not for each row: a batch is
    one value of the window, and of the ids told only those that may be read again are written, once a round has ended."""

    def __init__(self, window_ms: int, grace: int):
        self._window, self._grace = window_ms, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._told = handle.getMapState("told", "id long", "seen long")
        self._rows = handle.getMapState("batches", "seen long, part long", "rows binary")
        self._mark = handle.getValueState("mark", "last_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = self._mark.get()[0] if self._mark.exists() else 0
        had = [i for (i,) in self._told.keys()]  # noqa: SIM118
        part = 1 + max((p for _, p in self._rows.keys()), default=-1)  # noqa: SIM118
        met, near, timers = _Ids(np.array(had, np.int64)), {}, set()
        for some in rows:
            mark = max(mark, int(some["mark"].max()))
            new = some[~some["id"].duplicated().to_numpy() & met.lacks(some["id"].to_numpy())]
            if new.empty:
                continue
            met.add(new["id"].to_numpy())
            near = {i: seen for i, seen in near.items() if i > mark - self._grace}
            for seen, batch in new.groupby(new["seen_at"].astype("datetime64[ms]").astype("int64").to_numpy()):
                self._rows.updateValue((int(seen), part), (_packed(batch),))
                part += 1
                near |= dict.fromkeys(batch["id"][batch["id"] > mark - self._grace].tolist(), int(seen))
                if seen not in timers:
                    timers.add(seen)
                    self._handle.registerTimer(int(seen) + self._window + 1)  # a row as old as the window is in it still
            yield self._frame(key, new, "in")
        self._mark.update((mark,))
        for i in had:
            if i <= mark - self._grace:
                self._told.removeKey((i,))
        for i, seen in near.items():
            if i > mark - self._grace:
                self._told.updateValue((i,), (seen,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        edge = expiredTimerInfo.getExpiryTimeInMs() - self._window
        mark = self._mark.get()[0]
        for seen, part in sorted(k for k in self._rows.keys() if k[0] < edge):  # noqa: SIM118
            gone = _unpacked(self._rows.getValue((seen, part))[0])
            self._rows.removeKey((seen, part))
            yield self._frame(key, gone.assign(mark=mark, seen_at=pd.Timestamp(seen, unit="ms")), "out")

    def _frame(self, key, rows: pd.DataFrame, change: str) -> pd.DataFrame:
        told = dict(zip(KEYS[:3], key, strict=False))
        return rows.assign(**told, change=change)[["env", "db", "table", "id", "mark", "seen_at", "columns", "values", "change"]]

    def close(self) -> None:
        pass


def keyed_window(rows: DataFrame, minutes: float = 10, grace: int = 0, buckets: int = 64) -> DataFrame:
    """The changes of the window over a stream of source.follow(), which has to read with no more grace than this."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    return keyed.groupBy(*KEYS).transformWithStateInPandas(ArrivalWindow(int(minutes * 60_000), grace), CHANGES, "Append", "ProcessingTime")


def start(changes: DataFrame, to: str, checkpoint: str, **trigger):
    """Starts the query that appends the changes to a folder of Parquet files; Spark's file sink tells each round once."""
    return changes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", to).trigger(**trigger).start()


def changes_in(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CHANGES).parquet(folder)


def current(changes: DataFrame) -> DataFrame:
    """The rows that are in the window: those that came in and have not left."""
    key = ["env", "db", "table", "id"]
    return changes.where("change = 'in'").join(changes.where("change = 'out'").select(*key), key, "left_anti").drop("change")


def marks(changes: DataFrame) -> DataFrame:
    """(env, db, table, last_id, last_seen_at) of the tables that told rows."""
    return changes.where("change = 'in'").groupBy("env", "db", "table").agg(F.max("mark").alias("last_id"), F.max("seen_at").alias("last_seen_at"))
