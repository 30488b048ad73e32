"""Incremental rebuilds: snapshots of a tree's content hashes, and recomputing only the files that changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.operators import relate
from lumenspan.operators.store import stored


def snapshot(files: DataFrame) -> DataFrame:
    return files.select("path", "content_hash")


def refresh(files: DataFrame, old: DataFrame, old_hashes: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(table, changes): the table that compute makes of files, with the rows of unchanged files taken over from old."""
    changes = relate.manifest_diff(old_hashes, snapshot(files), key, "content_hash")
    todo = files.join(changes.where("change <> 'removed'").select(key), key, "left_semi")
    kept = old.join(changes.select(key), key, "left_anti")
    return kept.unionByName(compute(todo)), changes


#: What indexed() made last, by application, name and paths: hashes and table. In the session's memory, as tables in the shared folder.
_KNOWN: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def indexed(files: DataFrame, name: str, compute: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("path",)) -> DataFrame:
    """What compute makes of files, a row or more for each; of a tree indexed under that name before, only changed files are computed."""
    key = F.concat_ws("\x00", *keys)
    now = stored(files.select(key.alias("__file"), "content_hash"))
    at = files.sparkSession.sparkContext.applicationId, name
    if at not in _KNOWN:
        table = stored(compute(files).withColumn("__file", key))
    else:
        hashes, old = _KNOWN[at]
        changes = stored(relate.manifest_diff(hashes, now, "__file", "content_hash"))
        if changes.isEmpty():
            table = old
        else:
            todo = files.withColumn("__file", key).join(changes.where("change <> 'removed'").select("__file"), "__file", "left_semi").drop("__file")
            table = stored(old.join(changes.select("__file"), "__file", "left_anti").unionByName(compute(todo).withColumn("__file", key)))
    _KNOWN[at] = now, table
    return table.drop("__file")


def counts(changes: DataFrame) -> dict[str, int]:
    got = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
    return {k: got.get(k, 0) for k in ("added", "modified", "removed")}


def without(table: DataFrame, paths: list[str], key: str = "path") -> DataFrame:
    """A table without the rows of some files."""
    return table.where(~F.col(key).isin(*paths)) if paths else table
