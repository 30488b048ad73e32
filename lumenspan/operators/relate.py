"""Joins with a rule: interval, innermost, default, longest prefix, full outer difference, decisions, ordered limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


#: Spans of one key up to which each of its points is compared with each of them.
FEW_SPANS = 32
_LEVELS, _FAN = 21, 3  # blocks of 8 to the power of 0 to 20


def _shifted(c: Column, level: Column, up: bool = False) -> Column:
    """c divided by the size of a level's blocks, rounded down (or up)."""
    by = lambda x: F.call_function("shiftright", x, (level * _FAN).cast("int"))
    return -by(-c) if up else by(c)


def _blocks(start: Column, end: Column) -> Column:
    """The fewest (level, block) that make up a span: at most 14 a level, each span's blocks being apart."""
    past = F.least(end.cast("long"), F.lit(1 << 59)) + 1
    start = F.greatest(start.cast("long"), F.lit(-(1 << 59)))

    def of(level: Column) -> Column:
        low, high = _shifted(start, level, up=True), _shifted(past, level)
        inner, outer = _shifted(start, level + 1, up=True) * 8, _shifted(past, level + 1) * 8
        some = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        parts = F.when(inner < outer, F.concat(some(low, inner), some(outer, high))).otherwise(some(low, high))
        return F.transform(parts, lambda x: F.struct(level.cast("int").alias("level"), x.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS - 1)), of))


def span_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Points inside spans of the same key, ends included.

    Where no key has more than FEW_SPANS, this is a hash join on the key with the range as a residual. Otherwise each span is cut into
    blocks of 8^k numbers, and a point meets, by equality, its own block of each size that spans have: every pair meets once, and
    pairs that don't fit never do. Places that are no integers are compared."""
    held = F.col(at).between(F.col(start), F.col(end))
    if not all(isinstance(df.schema[c].dataType, IntegralType) for df, c in ((points, at), (spans, start), (spans, end))):
        return points.join(spans, list(keys)).where(held)
    levels = F.transform(_blocks(F.col(start), F.col(end)), lambda x: F.call_function("shiftleft", F.lit(1), x["level"]))
    used = spans.select(*keys, F.aggregate(levels, F.lit(0), lambda s, x: s.bitwiseOR(x)).alias("__levels"))
    got = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bit_or("__levels").alias("l")).agg(F.max("n").alias("n"), F.bit_or("l").alias("l")).first()
    if (got.n or 0) <= FEW_SPANS:
        return points.join(spans, list(keys)).where(held)
    own = F.array(*(F.struct(F.lit(k).alias("level"), _shifted(F.col(at).cast("long"), F.lit(k)).alias("block")) for k in range(_LEVELS) if got.l >> k & 1))
    cut = spans.where(F.col(start) <= F.col(end)).withColumn("__block", F.explode(_blocks(F.col(start), F.col(end))))
    return points.where(F.col(at).isNotNull()).withColumn("__block", F.explode(own)).join(cut, [*keys, "__block"]).drop("__block")


def innermost(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """For each point (distinct rows) the span that holds it and starts last (then ends first), as columns of the span."""
    held = span_join(points, spans, keys, at, start, end)
    rest = [c for c in spans.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(start), -F.col(end)))
    return held.groupBy(*points.columns).agg(best.alias("__span")).select(*points.columns, *(F.col(f"__span.{c}").alias(c) for c in rest))


def left_with_default(left: DataFrame, right: DataFrame, on: Column, value: Column, default: Column, name: str, note: str, found: str, guessed: str) -> DataFrame:
    """left with name = value where right has a match, else default, and note saying which."""
    return left.join(right, on, "left").withColumns({name: F.coalesce(value, default), note: F.when(value.isNotNull(), found).otherwise(guessed)})


def longest_prefix(paths: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """paths with the longest root (column root of roots) that is the path itself or a folder above it, else null.

    Each path is spread into its own prefixes, which meet roots by equality; no path is compared with every root."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    keyed = paths.select(path).distinct()
    met = keyed.select(path, F.explode(above).alias("__prefix")).join(roots.select(F.col(root).alias("__root")).distinct(), F.col("__prefix") == F.col("__root"))
    best = met.groupBy(path).agg(F.max_by("__root", F.length("__root")).alias(root))
    return paths.join(best, path, "left")


def manifest_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed or modified rows of two snapshots; equal ones are left out."""
    o, n = old.select(F.col(key), F.col(digest).alias("__old")), new.select(F.col(key), F.col(digest).alias("__new"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def sync_decision(edited: Column, changed: Column) -> Column:
    """What two-way sync does: edited says that the projection's block differs from its anchor, changed that the source does."""
    return F.when(edited & changed, "conflict").when(edited, "to_source").when(changed, "to_projection").otherwise("unchanged")


def argmax_by(df: DataFrame, key: str, ties: Sequence[str]) -> DataFrame:
    """The most frequent value of key, ties by their place in the list, then by value: one row."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ties)), F.col(key)), F.lit(0)), F.lit(len(ties) + 1))
    return df.where(F.col(key).isNotNull()).groupBy(key).count().orderBy(F.desc("count"), rank, key).limit(1)


def search_symbols(df: DataFrame, name: str, query: str, order: Sequence[str], limit: int) -> DataFrame:
    """Case-insensitive substring search, the first `limit` rows by order."""
    return df.where(F.contains(F.lower(F.col(name)), F.lit(query.lower()))).orderBy(*order).limit(limit)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key, the first by order; aggregated on the map side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*(F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns))


def common_directory(paths: DataFrame, path: str) -> DataFrame:
    """(directory): the longest directory that all paths lie under, "." if there is none; one row.

    What the least and the greatest directory share, all between them share."""
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "/")).otherwise("")
    ends = paths.agg(F.min(folder).alias("a"), F.max(folder).alias("b")).select(F.split("a", "/").alias("a"), F.split("b", "/").alias("b"))
    same = F.transform(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda k: F.slice("a", F.lit(1), k) == F.slice("b", F.lit(1), k))
    shared = F.array_join(F.slice("a", F.lit(1), F.size(F.filter(same, lambda x: x))), "/")
    return ends.select(F.coalesce(F.nullif(F.regexp_replace(shared, "/+$", ""), F.lit("")), F.lit(".")).alias("directory"))


def ends_with(paths: DataFrame, path: str, refs: DataFrame, ref: str) -> DataFrame:
    """paths with the refs (column ref of refs) that they end in, at a slash or as a whole: an equi-join on each path's endings."""
    parts = F.split(F.col(path), "/")
    n = F.size(parts)
    endings = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "/"))
    return paths.withColumn(ref, F.explode(endings)).join(refs.select(ref).distinct(), ref).select(*paths.columns, ref)


def without(rows: DataFrame, stop: DataFrame, key: str) -> DataFrame:
    """rows whose key is not in a stop set."""
    return rows.join(stop.select(key).distinct(), key, "left_anti")
