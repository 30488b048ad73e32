"""The streaming source and its keyed state: restarts, killed rounds, late ids, rows that leave."""

import sqlite3
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenspan.streaming import source, state


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "data.db")
    con = sqlite3.connect(path)
    con.execute("create table events (id integer primary key, kind text, amount real)")
    con.commit()

    def insert(*ids):
        con.executemany("insert into events values (?, ?, ?)", [(i, f"k{i % 3}", i / 2) for i in ids])
        con.commit()

    return f"dbapi:sqlite3:{path}", insert


def rounds(spark, tmp_path, *tables, grace=0, minutes=10.0, ids=3, **trigger):
    changes = state.keyed_window(source.follow(spark, *tables, grace=grace, ids=ids), minutes, grace, buckets=4)
    return state.start(changes, str(tmp_path / "out"), str(tmp_path / "checkpoint"), **(trigger or {"availableNow": True}))


def run(spark, tmp_path, *tables, **kw):
    rounds(spark, tmp_path, *tables, **kw).awaitTermination()
    return state.changes_in(spark, str(tmp_path / "out"))


def told(changes):
    return sorted(r.id for r in changes.where("change = 'in'").collect())


def test_restarts_lose_and_repeat_nothing(spark, tmp_path, db):
    address, insert = db
    t = source.Table("dev", "d", "events", address)
    insert(1)
    assert told(run(spark, tmp_path, t)) == []  # "latest" tells nothing at first
    insert(2, 3)
    assert told(run(spark, tmp_path, t)) == [2, 3]
    assert told(run(spark, tmp_path, t)) == [2, 3]
    insert(*range(4, 20))
    changes = run(spark, tmp_path, t)
    assert told(changes) == list(range(2, 20))
    row = changes.where("id = 7").first()
    assert (row.env, row.db, row.table, list(row.columns), list(row["values"])) == ("dev", "d", "events", ["id", "kind", "amount"], ["7", "k1", "3.5"])
    assert [(r.table, r.last_id) for r in state.marks(changes).collect()] == [("events", 19)]


def test_a_killed_round_is_read_again_with_its_bounds(spark, tmp_path, db):
    """A round fails after its offsets were logged; rows that come meanwhile wait for the round after it."""
    address, insert = db
    t = source.Table("dev", "d", "events", address, bootstrap="all")
    insert(1, 2, 3)
    seen = []

    def broken(batch, n):
        seen.append((n, sorted(r.id for r in batch.select("id").collect())))
        if len(seen) == 1:
            raise RuntimeError("killed")

    def start():
        stream = source.follow(spark, t)
        return stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(broken).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    insert(4, 5)
    start().awaitTermination()
    start().awaitTermination()  # with availableNow, Spark only ends the round that was begun
    assert seen == [(0, [1, 2, 3]), (0, [1, 2, 3]), (1, [4, 5])]


def test_a_killed_round_with_state_tells_once(spark, tmp_path, db):
    address, insert = db
    t = source.Table("dev", "d", "events", address, bootstrap="all")
    insert(*range(1, 9))
    first = told(run(spark, tmp_path, t, grace=5))
    assert first == list(range(1, 9))
    newest = max((tmp_path / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()  # as if the driver had died before it noted the end of the round
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    insert(9, 10)
    for _ in range(2):
        changes = run(spark, tmp_path, t, grace=5)
    assert told(changes) == list(range(1, 11))


def test_late_ids_come_once(spark, tmp_path, db):
    address, insert = db
    t = source.Table("dev", "d", "events", address)
    insert(10)
    assert told(run(spark, tmp_path, t, grace=6)) == []
    insert(12, 13, 16)
    assert told(run(spark, tmp_path, t, grace=6)) == [12, 13, 16]
    insert(11)  # committed late, and nothing above the mark comes with it
    assert told(run(spark, tmp_path, t, grace=6)) == [11, 12, 13, 16]
    insert(15, 14, 20)
    assert told(run(spark, tmp_path, t, grace=6)) == [11, 12, 13, 14, 15, 16, 20]
    insert(9)  # below the mark that the table began at
    insert(30)
    assert told(run(spark, tmp_path, t, grace=6)) == [11, 12, 13, 14, 15, 16, 20, 30]
    insert(18)  # later than the grace allows
    assert told(run(spark, tmp_path, t, grace=6)) == [11, 12, 13, 14, 15, 16, 20, 30]


def test_what_is_told_is_forgotten_below_the_grace(spark, tmp_path, db):
    address, insert = db
    t = source.Table("dev", "d", "events", address, bootstrap="all")
    for k in range(3):
        insert(*range(k * 20 + 1, k * 20 + 21))
        run(spark, tmp_path, t, grace=4)
    held = spark.read.format("statestore").option("stateVarName", "told").load(str(tmp_path / "checkpoint"))
    ids = sorted(r[0] for r in held.select(F.expr("user_map_key.id")).collect())
    assert set(range(57, 61)) <= set(ids) and len(ids) < 20  # a bucket without rows in a round keeps what it had


def test_rows_leave_when_their_time_comes(spark, tmp_path, db):
    address, insert = db
    t = source.Table("dev", "d", "events", address, bootstrap="all")
    insert(1, 2)
    query = rounds(spark, tmp_path, t, minutes=8 / 60, processingTime="1 second")
    try:
        at = time.time() + 90
        while time.time() < at and (not (tmp_path / "out/_spark_metadata").exists() or not told(state.changes_in(spark, str(tmp_path / "out")))):
            time.sleep(0.5)
        assert sorted(r.id for r in state.current(state.changes_in(spark, str(tmp_path / "out"))).collect()) == [1, 2]
        while time.time() < at and state.current(state.changes_in(spark, str(tmp_path / "out"))).count():
            time.sleep(0.5)
    finally:
        query.stop()
    changes = state.changes_in(spark, str(tmp_path / "out"))
    assert sorted((r.id, r.change) for r in changes.collect()) == [(1, "in"), (1, "out"), (2, "in"), (2, "out")]
    assert state.current(changes).count() == 0


def test_several_tables_and_one_added_later(spark, tmp_path, db):
    address, insert = db
    folder = tmp_path / "rows"
    folder.mkdir()
    pq.write_table(pa.table({"n": [1, 2, 2], "v": [None, True, False]}), folder / "a.parquet")
    one = source.Table("dev", "d", "events", address, bootstrap="all")
    two = source.Table("dev", "d", "rows", str(folder), "n", "all")
    insert(1)
    assert told(run(spark, tmp_path, one)) == [1]
    changes = run(spark, tmp_path, one, two)
    assert sorted((r.table, r.id) for r in changes.collect()) == [("events", 1), ("rows", 1), ("rows", 2)]  # an id is told once
    pq.write_table(pa.table({"n": [3, None], "v": [True, None]}), folder / "b.parquet")
    assert sorted((r.table, r.id) for r in run(spark, tmp_path, one, two).collect())[-1] == ("rows", 3)


def test_names_are_checked():
    with pytest.raises(ValueError):
        source.Table("e", "d", "x; drop table y", "dbapi:sqlite3:y").reader()


def test_the_state_store_is_called_for_batches_not_for_rows():
    """Ids, rows and timers of a key at hand: duplicates in and between batches, rows of two times, what leaves and what is kept."""
    import pandas as pd

    calls = []

    class Map(dict):
        def updateValue(self, k, v):  # noqa: N802
            calls.append(k)
            self[k] = v

        def getValue(self, k):  # noqa: N802
            return self[k]

        def containsKey(self, k):  # noqa: N802
            calls.append(k)
            return k in self

        def removeKey(self, k):  # noqa: N802
            calls.append(k)
            del self[k]

        def keys(self):
            return iter(list(super().keys()))

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    class Handle:
        def getMapState(self, *_):  # noqa: N802
            return Map()

        def getValueState(self, *_):  # noqa: N802
            return Value()

        def registerTimer(self, at):  # noqa: N802
            calls.append(at)

    class Expired:
        def getExpiryTimeInMs(self):  # noqa: N802
            return 1000 + 60_000 + 1

    def rows(ids, mark, seen):
        return pd.DataFrame({"id": ids, "mark": mark, "seen_at": pd.Timestamp(seen, unit="ms"), "columns": [["a", "b"]] * len(ids), "values": [[str(i), None] for i in ids]})

    window = state.ArrivalWindow(60_000, 5)
    window.init(Handle())
    told = lambda found: sorted(i for f in found for i in f["id"])
    first = list(window.handleInputRows(("e", "d", "t", 0), iter([rows([*range(1, 2001), 7], 3000, 1000), rows(range(1500, 3001), 3000, 1000)]), None))
    assert told(first) == list(range(1, 3001)) and len(calls) < 20
    again = list(window.handleInputRows(("e", "d", "t", 0), iter([rows([2999, 3000, 3001, 3001], 3001, 2000)]), None))
    assert told(again) == [3001] and again[0].iloc[0].tolist() == ["e", "d", "t", 3001, 3001, pd.Timestamp(2000, unit="ms"), ["a", "b"], ["3001", None], "in"]
    assert sorted(k for k, in window._told.keys()) == list(range(2997, 3002))
    gone = list(window.handleExpiredTimer(("e", "d", "t", 0), None, Expired()))
    assert told(gone) == list(range(1, 3001)) and {c for f in gone for c in f["change"]} == {"out"} and [k[0] for k in window._rows.keys()] == [2000]
