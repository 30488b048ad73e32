"""Mixing sources to target weights: repetition rates and hash-seeded copies, in DataFrame functions.

Sizes are summed per source; targets share a total by weight, stop at `most` times their source's size, and what is cut off is
shared again among the rest by weight until none is above. A document comes floor(rate) times, and once more if a uniform
number made of a seed, its id and its text is below the rest of the rate, so that reruns agree and no row depends on another.

Sources are counted, ranked and weighed as a table: the share-out takes a few rounds of two sums, not a list on the driver.

Defined cases: a null text has size 0; a null source is a source of its own, the last; sources of size 0 have target and rate
0, and their documents are not taken; repeated rows are rows of their own, with equal draws where id and text are equal; an
empty table gives an empty result; mix keeps all columns, whatever their names, and plan_mix replaces those named like its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, quoted, written

# The weights in order of source, the share of all sizes, the most a source may be repeated.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
OWN = ("size", "source_size", "target", "rate", "copies")
#: Up to this many sources the rates are broadcast (below 0.1 kB a row, so 10 MB); beyond, AQE splits the hot ones of a shuffled join.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def uniform(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) made of 52 bits of MD5; engines agree on it."""
    key = F.concat_ws("\x1f", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def ranked(sources: DataFrame, by: str) -> DataFrame:
    """sources with `k`, the row's place from 0 in ascending order of by, nulls last; no task holds more than a range."""
    parts = sources.repartitionByRange(F.col(by).asc_nulls_last()).withColumn("__part", F.spark_partition_id())
    parts = written(parts)
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(by).asc_nulls_last()))
    return parts.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn("k", (F.col("__before") + F.col("__place") - 1).cast("long")).drop("__part", "__place", "__before")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate)."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))
    rows = written(ranked(sources, "source").withColumn("weight", weight).withColumn("cap", F.col("source_size") * most))
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    full: Column = F.lit(False)
    level, n_full = 0.0, -1
    while True:
        got = rows.agg(F.sum(F.when(full, F.col("cap"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("w"), F.count_if(full).alias("n")).first()
        if got["w"] is None or got["n"] == n_full:
            break
        n_full, level = got["n"], max(0.0, total - (got["held"] or 0.0)) / got["w"]
        full = F.col("weight") * level > F.col("cap")
    target = F.when(full, F.col("cap")).otherwise(F.col("weight") * level)
    return rows.select("source", "source_size", target.cast("double").alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _planned(docs: DataFrame, seed: str, **shares) -> DataFrame:
    """(doc, size, source_size, target, rate, copies): doc holds the row whole, so that no name of its columns can clash."""
    whole = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"))
    sized = whole.withColumn("size", size_of(F.col("doc.text")))
    sums = sized.groupBy(F.col("doc.source").alias("source")).agg(F.sum("size").alias("source_size"))
    rates = written(targets(sums, **shares))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    extra = (uniform(seed, F.col("doc.doc_id"), F.col("doc.text")) < F.col("rate") - F.floor("rate")).cast("long")
    out = sized.join(rates, F.col("doc.source").eqNullSafe(F.col("source")), "left").drop("source")
    return out.withColumn("copies", F.floor("rate") + extra)


def plan_mix(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """docs with size, source_size, target, rate and copies (how often the mix takes the document)."""
    own = [c for c in docs.columns if c.lower() not in OWN]
    return _planned(docs, seed, **shares).select(*(F.col("doc").getField(c).alias(c) for c in own), *OWN)


def mix(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the columns of docs as they are."""
    taken = _planned(docs, seed, **shares).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def op6_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


SQL_OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM r),
l AS (SELECT (total - held) / w AS level FROM c WHERE weight * ((total - held) / w) <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM l))::DOUBLE AS target FROM r),
u AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix-1' || chr(31) || coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM u
"""
