"""The lens over watched tables: one round of polling, and the rolling window as rows of text.

With a folder as `checkpoint`, the round is one of the streaming source, and marks and window are kept in its state store."""

from __future__ import annotations

import csv
import io
import json
import re
from datetime import UTC, datetime, timedelta
from pathlib import Path

from lumenspan.operators.store import stored
from lumenspan.streaming import source, state, watch

from .lens import Fact, Piece, Projection

_IDENT = re.compile(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)?$")


def csv_line(values: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values)
    return out.getvalue()


def tables_of(c) -> list[watch.Watched]:
    """connections: {env: url} or {env: {db: url}}; tables: a comma list. Parquet folders and JDBC databases can be followed."""
    names = [t.strip() for t in c.lens.need("tables", "watch").split(",") if t.strip()]
    for t in names:
        if not _IDENT.match(t):
            raise ValueError(f"postgres-watch: {t!r} is no table name")
    get = c.lens.get
    made = lambda env, db, url, t: watch.Watched(env, db, t, _reader(url, t), get("id_column", default="id"), int(get("limit", default="1000")), get("bootstrap", default="latest"), _statement(url))
    return [made(env, db, url, t) for env, db, url in _databases(c) for t in names]


def _databases(c) -> list[tuple[str, str, str]]:
    raw = json.loads(c.lens.need("connections", "environments", "envs", "dsn"))
    envs = {e: d if isinstance(d, dict) else {"default": d} for e, d in raw.items() if not c.lens.get("env") or e == c.lens.get("env")}
    return [(env, db, url) for env, dbs in sorted(envs.items()) for db, url in sorted(dbs.items())]


def _urls(c) -> list[str]:
    """The address of each of tables_of()."""
    n = len([t for t in c.lens.need("tables", "watch").split(",") if t.strip()])
    return [url for _, _, url in _databases(c) for _ in range(n)]


def _jdbc(url: str) -> str | None:
    """A database's address as JDBC wants it; None for a folder."""
    if url.startswith("jdbc:"):
        return url
    m = re.match(r"^postgres(?:ql)?://(?:([^:@/]+)(?::([^@/]*))?@)?([^?]*)(?:\?(.*))?$", url)
    if not m:
        return None
    args = [x for x in (f"user={m[1]}" if m[1] else "", f"password={m[2]}" if m[2] else "", m[4] or "") if x]
    return f"jdbc:postgresql://{m[3]}" + ("?" + "&".join(args) if args else "")


def _reader(url: str, table: str):
    if to := _jdbc(url):
        return lambda spark: spark.read.format("jdbc").option("url", to).option("dbtable", ".".join(f'"{p}"' for p in table.split("."))).load()
    return lambda spark: spark.read.parquet(f"{url.rstrip('/')}/{table}.parquet")


def _statement(url: str):
    to = _jdbc(url)
    return (lambda spark, sql: spark.read.format("jdbc").option("url", to).option("query", sql).load()) if to else None


def _followed(c) -> list[source.Table]:
    """The lens's tables for the streaming source."""
    return [source.Table(t.env, t.db, t.table, url if url.startswith("dbapi:") else f"{url.rstrip('/')}/{t.table}.parquet", t.id_column, t.bootstrap) for t, url in zip(tables_of(c), _urls(c), strict=True)]


def streamed(c, checkpoint: str, minutes: int) -> tuple[list[dict], list[dict], dict[tuple, int]]:
    """One round of the streaming source into the folder `checkpoint`: (rows of the window, new rows, marks)."""
    grace, to = int(c.lens.get("grace", default="0")), f"{checkpoint}/changes"
    had = _told(c, to)
    changes = state.keyed_window(source.follow(c.spark, *_followed(c), grace=grace), minutes, grace, int(c.lens.get("buckets", default="64")))
    state.start(changes, to, f"{checkpoint}/state", availableNow=True).awaitTermination()
    kept = state.changes_in(c.spark, to)
    key = ["env", "db", "table", "id"]
    shown = lambda df: [r.asDict() | {"seen_at": r.seen_at.strftime("%Y-%m-%dT%H:%M:%SZ")} for r in df.collect()]
    new = kept.where("change = 'in'").join(had.select(*key), key, "left_anti")
    marks = {(r.env, r.db, r.table): r.last_id for r in state.marks(kept).collect()}
    return shown(state.current(kept)), shown(new), marks


def _told(c, folder: str):
    """What the rounds before told, as rows that later rounds don't change."""
    there = c.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_spark_metadata")
    if not there.getFileSystem(c.spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return c.spark.createDataFrame([], state.CHANGES)
    return stored(state.changes_in(c.spark, folder))


def project(c, now: datetime | None = None) -> Projection:
    now = now or datetime.now(UTC)
    path = Path(c.config.root) / c.lens.get("state", default=f"{c.config.projections_dir}/.{c.lens.name or 'postgres-watch'}.state.json")
    minutes = int(c.lens.get("window_minutes", default="10"))
    tables = tables_of(c)
    if checkpoint := c.lens.get("checkpoint"):
        held, new, last = streamed(c, checkpoint, minutes)
    else:
        was, new = watch.poll(c.spark, tables, watch.State.load(path.read_text() if path.exists() else None), now, timedelta(minutes=minutes))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.with_suffix(".tmp").write_text(was.dump())
        path.with_suffix(".tmp").replace(path)
        held, last = was.rows, {tuple(k.split("/", 2)): m["last_id"] for k, m in was.marks.items()}
    by: dict[tuple, list[dict]] = {t.key: [] for t in tables}
    for r in sorted(held, key=lambda r: (r["seen_at"], r["env"], r["db"], r["table"], r["id"])):
        by.setdefault((r["env"], r["db"], r["table"]), []).append(r)
    pieces, facts = [], []
    for (env, db, table), rows in sorted(by.items()):
        names = next((r["columns"] for r in rows), [])
        shown = [csv_line(["seen_at", "env", "db", "table", *names]), *(csv_line([r["seen_at"], env, db, table, *r["values"]]) for r in rows)]
        pieces.append(Piece(f"{env}.{db}.{table}", "model", "window", "postgres-watch", shown))
        count = sum((r["env"], r["db"], r["table"]) == (env, db, table) for r in new)
        facts.append(Fact(f"{env}.{db}.{table}", f"new_rows={count} last_id={last.get((env, db, table), 0)} window={minutes}m", "postgres-watch"))
    return Projection(pieces=pieces, facts=facts)
