"""Following append-only tables: a high-water mark for each (env, db, table), pages above it, a rolling window by arrival time.

poll() is one round over all tables. Its state (marks and buffered rows) lives in two Parquet folders of numbered versions;
a round writes version n + 1 and only then moves the pointer, so a round that fails leaves the state as it was. follow() runs
rounds on a schedule; stream() does the same with Structured Streaming, whose checkpoint holds the marks.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLL_SECONDS = 30


def mark(table: DataFrame, id_column: str) -> DataFrame:
    """(last_id): the highest id so far, 0 for an empty table; one row."""
    return table.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long").alias("last_id"))


def page(table: DataFrame, id_column: str, after: int, limit: int) -> DataFrame:
    """The next rows above a mark in order of id; filter, order and limit reach a database that can do them."""
    return table.where(F.col(id_column) > after).orderBy(id_column).limit(limit)


_NAME = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?")


def _quoted(name: str) -> str:
    """A table's or column's name for a statement; only plain ones are let in."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no name")
    return ".".join(f'"{p}"' for p in name.split("."))


@dataclass
class Watched:
    """A table to follow: read(spark) gives it whole and lazily.

    Where the source can page by itself (a database), statement(sql) reads what a statement gives, and the two statements of a
    round, the highest id and the next page, run there: Spark's reader pushes filters down, but no order and limit."""

    env: str
    db: str
    table: str
    read: Callable[[SparkSession], DataFrame]
    id_column: str = "id"
    limit: int = 1000
    bootstrap: str = "latest"
    statement: Callable[[SparkSession, str], DataFrame] | None = None

    def newest(self, spark: SparkSession) -> int:
        if self.statement:
            return int(self.statement(spark, f"SELECT COALESCE(MAX({_quoted(self.id_column)}), 0) AS last_id FROM {_quoted(self.table)}").first()[0])
        return mark(self.read(spark), self.id_column).first()[0]

    def next_page(self, spark: SparkSession, after: int) -> DataFrame:
        if self.statement:
            key = _quoted(self.id_column)
            return self.statement(spark, f"SELECT * FROM {_quoted(self.table)} WHERE {key} > {int(after)} ORDER BY {key} LIMIT {int(self.limit)}").orderBy(self.id_column)
        return page(self.read(spark), self.id_column, after, self.limit)

    @property
    def key(self) -> tuple[str, str, str]:
        return self.env, self.db, self.table


@dataclass
class State:
    """Marks by (env, db, table), and the rows of the window, all values as text."""

    version: int = 2
    marks: dict[str, dict] = field(default_factory=dict)
    rows: list[dict] = field(default_factory=list)

    @classmethod
    def load(cls, text: str | None) -> State:
        return cls(**json.loads(text)) if text and text.strip() else cls()

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)


def _stamp(now: datetime) -> str:
    return now.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, datetime):
        return value.isoformat()
    return str(value).lower() if isinstance(value, bool) else str(value)


def poll(spark: SparkSession, tables: list[Watched], state: State, now: datetime, window: timedelta = timedelta(minutes=10)) -> tuple[State, list[dict]]:
    """One round: (the new state, the new rows). An error in any table leaves the old state to be used again.

    The first round over a table with bootstrap "latest" sets its mark and tells nothing; with "all" it starts at 0. Rows
    carry the time of their round, not of their commit; those older than the window are dropped, a stamp equal to its edge
    stays, and one that can't be read stays too. A page is at most `limit` rows, so what is buffered is bounded.
    """
    stamp, marks, new = _stamp(now), dict(state.marks), []
    for t in tables:
        key = "/".join(t.key)
        if key not in marks:
            if t.bootstrap == "latest":
                marks[key] = {"last_id": t.newest(spark), "last_seen_at": stamp}
                continue
            marks[key] = {"last_id": 0, "last_seen_at": stamp}
        found = t.next_page(spark, marks[key]["last_id"])
        got, names = found.collect(), found.columns
        for r in got:
            new.append({"env": t.env, "db": t.db, "table": t.table, "id": r[t.id_column], "seen_at": stamp, "columns": names, "values": [_text(v) for v in r]})
        if got:
            marks[key] = {"last_id": got[-1][t.id_column], "last_seen_at": stamp}
    return State(state.version, marks, prune([*state.rows, *new], now, window)), new


def prune(rows: list[dict], now: datetime, window: timedelta) -> list[dict]:
    edge = now.astimezone(UTC) - window

    def stays(r: dict) -> bool:
        try:
            return datetime.strptime(r["seen_at"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC) >= edge.replace(microsecond=0)
        except ValueError:
            return True

    return [r for r in rows if stays(r)]


def arrived(rows: DataFrame, time_column: str, window: str) -> DataFrame:
    """The rows of a table that came within a window before its newest one, the edge included."""
    newest = rows.agg(F.max(time_column).alias("__now"))  # one row
    return rows.join(F.broadcast(newest), F.col(time_column) >= F.col("__now") - F.expr(f"INTERVAL {window}")).drop("__now")


def by_table(rows: DataFrame, tables: DataFrame, key: str, *counts) -> DataFrame:
    """Aggregates (columns) of rows by the table they come from, with those of the polled tables that had no rows."""
    return tables.select(key).distinct().join(rows.groupBy(key).agg(*counts), key, "left")


def poll_every(seconds: list[int]) -> int:
    """The least of the tables' intervals, no more than 30 s."""
    return min([*(s for s in seconds if s > 0), POLL_SECONDS])


def follow(spark: SparkSession, tables: list[Watched], load: Callable[[], str | None], save: Callable[[str], None], rounds: int | None = None, every: int = POLL_SECONDS, clock: Callable[[], datetime] = lambda: datetime.now(UTC), sleep: Callable[[float], None] = time.sleep, **kw):
    """Rounds of poll(), each of which saves its state after all tables; yields the new rows of each round."""
    n = 0
    while rounds is None or n < rounds:
        state, new = poll(spark, tables, State.load(load()), clock(), **kw)
        save(state.dump())
        yield new
        n += 1
        if rounds is None or n < rounds:
            sleep(every)


def stream(spark: SparkSession, folder: str, schema, window_minutes: int = 10) -> DataFrame:
    """A folder that tables are appended to, as a stream with `seen_at`, the time of arrival."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("seen_at", F.current_timestamp())


def append_new(batch: DataFrame, to: str, keys: list[str]) -> None:
    """For foreachBatch: appends rows whose keys are not there yet, so a batch that is run again adds nothing twice."""
    spark = batch.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        batch = batch.join(spark.read.parquet(to).select(*keys), keys, "left_anti")
    batch.dropDuplicates(keys).write.mode("append").parquet(to)


def windowed(events: DataFrame, time_column: str, late: str, width: str, *keys: str, slide: str | None = None) -> DataFrame:
    """An extension for tables with a time of their own: counts by window and keys, with a watermark for late rows."""
    frame = F.window(time_column, width, slide) if slide else F.window(time_column, width)
    return events.withWatermark(time_column, late).groupBy(frame.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time_column: str, late: str, gap: str, *keys: str) -> DataFrame:
    """An extension: counts by session and keys; a session ends after a gap."""
    return events.withWatermark(time_column, late).groupBy(F.session_window(time_column, gap).alias("session"), *keys).agg(F.count(F.lit(1)).alias("n"))
