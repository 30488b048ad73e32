"""Order-dependent operators. Groups that are bounded (a file's lines, a conversation) use windows; groups that aren't (a hot
user) are ranged over partitions by key and order, scanned where they lie, and joined with what the ranges before them hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored


def _ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with __part: its rows by ranges of key and order, so that a hot key lies in several parts, one after the other."""
    return stored(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))


def _carried(parts: DataFrame, keys: list[str], held: Column, name: str, combined: Column) -> DataFrame:
    """parts with name: what the parts before hold of a row's key; held is one part's, combined those of several, by __part.

    Only the first key of a part can have begun before it, so what is carried over is a row for each part at most."""
    w = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    each = parts.groupBy(*keys, "__part").agg(held.alias("__held"))
    over = each.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__p"), combined.over(w).alias(name), F.lag(F.lit(1)).over(Window.partitionBy(*keys).orderBy("__part")).alias("__begun"))
    over = F.broadcast(over.where("__begun = 1").drop("__begun"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return parts.join(over, same, "left").drop("__p", *(f"__k{i}" for i in range(len(keys))))


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value so far that isn't null, by order within keys; order tells the rows of a key apart. No task holds a whole key."""
    parts = _ranged(df.withColumn("__value", value), keys, order)
    rank = F.struct(*order)
    met = _carried(parts, keys, F.max_by("__value", F.when(F.col("__value").isNotNull(), rank)), "__before", F.last("__held", ignorenulls=True))
    w = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = F.last("__value", ignorenulls=True).over(w)
    return met.withColumn(name, F.coalesce(here, F.col("__before"))).select(*df.columns, name)


def running_depth(lines: DataFrame, keys: list[str], opens: Column, closes: Column, name: str = "depth", order: str = "line") -> DataFrame:
    """Openings less closings on all lines before. No task holds a whole key."""
    parts = _ranged(lines.withColumn("__step", (opens - closes).cast("long")), keys, [order])
    met = _carried(parts, keys, F.sum("__step"), "__before", F.sum("__held"))
    w = Window.partitionBy("__part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum("__step").over(w), F.lit(0)) + F.coalesce("__before", F.lit(0))
    return met.withColumn(name, depth.cast("long")).select(*lines.columns, name)


def look_back(lines: DataFrame, keys: list[str], test: Column, rows: int, name: str, order: str = "line") -> DataFrame:
    """The nearest line among the rows before on which test holds, else null. No task holds a whole key.

    Within a part a row sees the rows before it; the first `rows` of a key in a part see the last ones of the parts before, which
    together are few."""
    parts = _ranged(lines.withColumn("__line", F.when(test, F.col(order))), keys, [order])
    local = Window.partitionBy("__part", *keys).orderBy(order)
    placed = parts.withColumns({"__at": F.row_number().over(local), "__left": F.count(F.lit(1)).over(Window.partitionBy("__part", *keys)), name: F.max("__line").over(local.rowsBetween(-rows, -1))})
    placed = stored(placed)
    split = placed.groupBy(*keys).agg(F.count_distinct("__part").alias("__parts")).where("__parts > 1")  # one fewer than the parts at most
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    edge = placed.where((F.col("__at") <= rows) | (F.col("__at") > F.col("__left") - rows))
    edge = edge.join(F.broadcast(split), same(edge, split), "left_semi")
    seen = edge.withColumn("__far", F.max("__line").over(Window.partitionBy(*keys).orderBy("__part", order).rowsBetween(-rows, -1))).where(F.col("__at") <= rows)
    seen = seen.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__p"), F.col("__at").alias("__a"), "__far")
    on = (F.col("__part") == F.col("__p")) & (F.col("__at") == F.col("__a"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(seen, on, "left").withColumn(name, F.coalesce(F.greatest(name, "__far"), name, "__far")).select(*lines.columns, name)


def k_of_n(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with k, the row's place in its key by order (from 1), and n, the key's rows; no task holds a whole key.

    order should tell the rows of a key apart; ties get places in no stated order."""
    parts = stored(df.repartitionByRange(F.col(key), F.col(order)).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__c"))  # a row for each key and range it reaches into
    w = Window.partitionBy(key).orderBy("__part")
    before = counts.select(F.col(key).alias("__key"), F.col("__part").alias("__p"), F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__c").over(Window.partitionBy(key)).alias("n"))
    here = F.row_number().over(Window.partitionBy("__part", key).orderBy(order))
    placed = parts.withColumn("__here", here).join(before, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")))
    return placed.withColumn("k", (F.col("__before") + F.col("__here")).cast("long")).withColumn("n", F.col("n").cast("long")).drop("__part", "__here", "__key", "__p", "__before")


def previous(df: DataFrame, order: str, value: str, name: str, key_range: int = 100_000) -> DataFrame:
    """The value on the row before, in the order of a dense integer column: a self-join on order - 1, not a global window.

    order must be gap-free and unique; then this equals lag() over the whole table, without one task that sorts it all."""
    before = df.select((F.col(order) + 1).alias(order), F.col(value).alias(name))
    return df.join(before, order, "left")
