"""Append-only tables as a streaming source of Structured Streaming, by high-water marks.

    spark.dataSource.register(AppendOnlyTables)
    spark.readStream.format("append-only-tables").option("tables", described(...)).load()

The offset is {env/db/table: {first, last_id, late}}. A round reads the ids above the mark of the round before, up to the newest, in
tasks of a stated number of ids, so nothing passes through the driver. Offsets are in the query's log before a round runs, so a
round that was killed is read again with the same bounds.

Ids are given out before transactions commit, so a row can turn up below a mark. With `grace`, a round also reads the ids in
(mark - grace, mark], and `late` counts the rows there: a late one changes the offset, which starts a round. What was told before
is read again by that; keyed_window() in streaming/state.py tells each once. Nothing at or below `first`, the mark at the first round
of a table with bootstrap "latest", is ever read.

Tables are Parquet files or folders, or lie in a database with a DB-API module (address dbapi:module:what to connect to).
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "append-only-tables"
SCHEMA = "env string, db string, table string, id long, mark long, columns array<string>, values array<string>"
_NAME = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?")


@dataclass(frozen=True)
class Table:
    """A table to follow. address: the path of Parquet files, or dbapi:module:what to connect to."""

    env: str
    db: str
    table: str
    address: str
    id_column: str = "id"
    bootstrap: str = "latest"

    @property
    def key(self) -> str:
        return f"{self.env}/{self.db}/{self.table}"

    def reader(self) -> ParquetRows | DatabaseRows:
        if m := re.match(r"dbapi:(\w+):(.*)", self.address, re.S):
            return DatabaseRows(m[1], m[2], self.table, self.id_column)
        return ParquetRows(self.address, self.id_column)


class ParquetRows:
    """Statements over Parquet files; row groups outside the range are not read."""

    def __init__(self, path: str, id_column: str):
        import pyarrow.dataset

        self._field, self._column = pyarrow.dataset.field, id_column
        self._data = pyarrow.dataset.dataset(path.removeprefix("file://"), format="parquet", exclude_invalid_files=True)

    def _between(self, low: int, high: int):
        f = self._field(self._column)
        return (f > low) & (f <= high)

    def newest(self) -> int:
        found = (b.column(0) for b in self._data.to_batches(columns=[self._column]))
        return max((int(c.drop_null().to_numpy(zero_copy_only=False).max()) for c in found if len(c) > c.null_count), default=0)

    def count(self, low: int, high: int) -> int:
        return self._data.count_rows(filter=self._between(low, high))

    def rows(self, low: int, high: int) -> Iterator[tuple[list[str], list]]:
        for batch in self._data.to_batches(filter=self._between(low, high)):
            names = batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield names, list(row)


class DatabaseRows:
    """Statements over a database's table, by a module of the Python database interface."""

    def __init__(self, module: str, target: str, table: str, id_column: str):
        for name in (table, id_column):
            if not _NAME.fullmatch(name):
                raise ValueError(f"{name!r} is no name")
        self._connect = lambda: importlib.import_module(module).connect(target)
        quote = lambda name: ".".join(f'"{p}"' for p in name.split("."))
        self._table, self._column = quote(table), quote(id_column)

    def _run(self, what: str, where: str = "") -> Iterator[tuple[list[str], list]]:
        held = self._connect()
        try:
            cursor = held.cursor()
            cursor.execute(f"SELECT {what} FROM {self._table}{where}")
            names = [c[0] for c in cursor.description]
            while some := cursor.fetchmany(1000):
                for row in some:
                    yield names, list(row)
        finally:
            held.close()

    def _between(self, low: int, high: int) -> str:
        return f" WHERE {self._column} > {int(low)} AND {self._column} <= {int(high)}"

    def newest(self) -> int:
        return int(next(self._run(f"COALESCE(MAX({self._column}), 0)"))[1][0])

    def count(self, low: int, high: int) -> int:
        return int(next(self._run("COUNT(*)", self._between(low, high)))[1][0])

    def rows(self, low: int, high: int) -> Iterator[tuple[list[str], list]]:
        return self._run("*", self._between(low, high) + f" ORDER BY {self._column}")


def as_text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, datetime | date):
        return value.isoformat()
    return str(value).lower() if isinstance(value, bool) else str(value)


class Ids(InputPartition):
    """A range of a table's ids for one task, the lower end not included."""

    def __init__(self, table: Table, low: int, high: int, mark: int):
        self.table, self.low, self.high, self.mark = table, low, high, mark


class MarkReader(DataSourceStreamReader):
    """Marks of a round. Spark tells partitions() where a query stands before it asks for the newest offset, after a restart as well,
    so where each table began is known from the offsets."""

    def __init__(self, tables: list[Table], grace: int, ids: int):
        self._tables, self._grace, self._ids = tables, grace, ids
        self._first: dict[str, int] = {}

    def _begin(self, t: Table) -> int:
        if t.key not in self._first:
            self._first[t.key] = 0 if t.bootstrap == "all" else t.reader().newest()
        return self._first[t.key]

    def initialOffset(self) -> dict:  # noqa: N802
        return {t.key: {"first": n, "last_id": n, "late": 0} for t in self._tables for n in [self._begin(t)]}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for t in self._tables:
            rows, low = t.reader(), self._begin(t)
            last = max(rows.newest(), low)
            late = rows.count(max(last - self._grace, low), last) if self._grace else 0
            out[t.key] = {"first": low, "last_id": last, "late": late}
        return out

    def partitions(self, start: dict, end: dict) -> list[Ids]:
        self._first |= {k: x["first"] for k, x in end.items()}
        out = []
        for t in self._tables:
            now = end.get(t.key)
            if now is None or start.get(t.key) == now:
                continue
            was = start.get(t.key) or {"last_id": now["first"]}  # a table that was added to the query
            low = max(was["last_id"] - self._grace, now["first"])
            out += [Ids(t, a, min(a + self._ids, now["last_id"]), now["last_id"]) for a in range(low, now["last_id"], self._ids)]
        return out

    def read(self, partition: Ids) -> Iterator[tuple]:
        t = partition.table
        for names, row in t.reader().rows(partition.low, partition.high):
            yield t.env, t.db, t.table, int(row[names.index(t.id_column)]), partition.mark, names, [as_text(v) for v in row]


class AppendOnlyTables(DataSource):
    """Options: tables (as described() gives them), grace (ids below a mark that are read again), ids (of a task)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> MarkReader:  # noqa: N802
        tables = [Table(**x) for x in json.loads(self.options["tables"])]
        return MarkReader(tables, int(self.options.get("grace", 0)), int(self.options.get("ids", 100_000)))


def described(*tables: Table) -> str:
    """Tables as an option."""
    return json.dumps([asdict(t) for t in tables])


def follow(spark: SparkSession, *tables: Table, grace: int = 0, ids: int = 100_000) -> DataFrame:
    """The tables as one stream: SCHEMA and seen_at, the time of the round."""
    spark.dataSource.register(AppendOnlyTables)
    made = spark.readStream.format(FORMAT).option("tables", described(*tables)).option("grace", grace).option("ids", ids).load()
    return made.withColumn("seen_at", F.current_timestamp())
