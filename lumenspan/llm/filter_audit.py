"""Filter interaction audit: an incidence matrix product over masks of failed filters.

Every document becomes a mask of five bits, one for each filter that it fails. Documents are counted by part (source) and mask: all of
them, those labelled good, those labelled toxic. The histograms, 32 counts each, are the rows of a matrix; products with integer
matrices of 32 by 600 (a column for each of the 120 orders and 5 steps; a row for each mask) give how many documents a step keeps
and removes, how many of those it would remove went before, and how many it alone removes. No order is run over the documents.

What a step does to a document depends on its mask alone, so the matrices are made once, of the orders; Shapley values are a
32-by-5 matrix of the same kind: in how many orders a filter is the first that a mask fails.

The filter of identical texts needs the table: among the rows of a text (told apart by 128 bits of hash) those with the least id
pass it. Copies are never gathered: rows are first counted by text, id and part, which spreads any group of copies by its ids;
the least id of a text is a map-side minimum; and the rows that hold it are found by joining on text and id. All other rows
with an id fail: all rows less those. The labels meet rows by id, and a group's rows of null id take no part in that.

Defined cases: a null text is the empty text; a null part counts as the empty one; a null id is identical to none and makes none
identical; rows that share the least id of a text all pass; repeated rows count as rows of their own; a document is good (toxic) if
any label row of its id says so; labels of null id tell nothing; an empty table has no parts and no rows; other columns are
ignored; ids other than integers raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WORD, quoted, whole_id, written

# The filters and what they ask for.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, r"[#$%&*|]"
N = len(FILTERS)
MASKS = 1 << N
ORDERS = list(permutations(range(N)))
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def matrices() -> dict[str, np.ndarray]:
    """By outcome, (masks, orders * steps): 1 where a document of that mask has that outcome at that step of that order."""
    mask = np.arange(MASKS)[:, None, None]
    order = np.array(ORDERS)[None]
    bit = 1 << order
    before = np.cumsum(bit, axis=2) - bit  # of the filters applied before a step
    fails, gone = (mask & bit) > 0, (mask & before) > 0
    made = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": (mask == bit) & fails}
    return {k: x.reshape(MASKS, -1).astype(np.int64) for k, x in made.items()}


def shapley() -> np.ndarray:
    """(masks, filters): the number of orders in which the filter is the one that removes a document of that mask."""
    removed = matrices()["removed"].reshape(MASKS, len(ORDERS), N)
    out = np.zeros((MASKS, N), np.int64)
    for k, order in enumerate(ORDERS):
        out[:, list(order)] += removed[:, k]
    return out


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at a text alone: A to D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    few = lambda w: F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w), 2).otherwise(0)
    a_b = F.element_at(F.transform(F.array(words), few), 1)  # the words are found once
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    c = F.when(100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"), 4).otherwise(0)
    return a_b + c + F.when(text.rlike(SIGNS), 8).otherwise(0)


def histograms(docs: DataFrame, labels: DataFrame, text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask of failed filters."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = docs.select(whole_id(docs).alias("doc_id"), F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), text_mask(F.col("text")).alias("mask"))
    rows = written(rows.groupBy("t1", "t2", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    least = rows.where("doc_id is not null").groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id"))
    first = rows.join(least, ["t1", "t2", "doc_id"], "left_semi").unionByName(rows.where("doc_id is null"))
    told = labels.where("doc_id is not null").groupBy(whole_id(labels).alias("doc_id")).agg(*(F.max(F.when(F.col(k) == 1, 1).otherwise(0)).alias(k) for k in ("quality", "toxic")))
    told = told.where("quality = 1 or toxic = 1")
    # All rows count as failing the filter of identical texts; those that pass it are taken from there to their mask without its bit.
    same = 1 << (N - 1)
    moved = F.inline(F.array(*(F.struct((F.col("mask") + bit).alias("mask"), (sign * F.col("n")).alias("n")) for bit, sign in ((same, -1), (0, 1)))))
    signed = rows.select("doc_id", "part", (F.col("mask") + same).alias("mask"), "n").unionByName(first.select("doc_id", "part", moved))
    met = signed.where("doc_id is not null").join(told, "doc_id", "left").select("part", "mask", "n", "quality", "toxic")
    met = met.unionByName(signed.where("doc_id is null").select("part", "mask", "n", F.lit(0).alias("quality"), F.lit(0).alias("toxic")))
    count = lambda of: F.coalesce(F.sum(F.when(of == 1, F.col("n"))), F.lit(0))
    return met.groupBy("part", "mask").agg(F.sum("n").alias("n"), count(F.col("quality")).alias("good"), count(F.col("toxic")).alias("toxic"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, n, good, toxic), lists of 32 counts, to a row for each part, order and step."""
    m, worth = matrices(), shapley()
    names = ["".join(FILTERS[i] for i in order) for order in ORDERS]
    letters = np.array(ORDERS).ravel()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            p = some.num_rows
            stacked = np.vstack([c.flatten().to_numpy(zero_copy_only=False).reshape(p, MASKS) for c in some.columns[1:]])
            whole = {k: stacked[:p] @ m[k] for k in OUTCOMES}
            lost = stacked[p:] @ m["removed"]
            made = [*(whole[k] for k in OUTCOMES), lost[:p], lost[p:], (stacked[:p] @ worth)[:, letters]]
            columns = [pa.array(np.repeat(np.arange(p), len(letters)))] + [pa.array(x.ravel()) for x in made]
            order = pa.array(np.tile(np.repeat(np.arange(len(names)), N), p))
            step = pa.array(np.tile(np.arange(1, N + 1, dtype=np.int32), p * len(names)))
            yield pa.record_batch([some.column(0).take(columns[0]), pa.array(names).take(order), step, *columns[1:]], names=["part", "filter_order", "step", *COLUMNS])


def audit(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of (part, mask, n, good, toxic)."""
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # 32 at most
    row = lambda of: F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda k: F.coalesce(F.try_element_at("m", k)[of], F.lit(0))).alias(of)
    stacked = counts.groupBy("part").agg(by_mask.alias("m")).select("part", row("n"), row("good"), row("toxic"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in COLUMNS)
    return stacked.mapInArrow(_products, schema)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(histograms(docs, labels))


SQL_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, map(['A', 'B', 'C', 'D', 'E'],
        [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)]) AS f FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
g AS (SELECT part, good, toxic, f, count(*) AS n FROM m GROUP BY ALL),
r AS (SELECT part, n, good, toxic, o, step, o[step] AS x, f[o[step]] AS fails, len(list_filter(o[1:step - 1], lambda y: f[y])) > 0 AS gone, len(list_filter(o, lambda y: f[y])) AS k FROM g, s),
c AS (SELECT part, array_to_string(o, '') AS filter_order, step::INT AS step, any_value(x) AS x,
        coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails AND k = 1), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (fails AND NOT gone AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic = 1), 0)::BIGINT AS toxic_lost
      FROM r GROUP BY part, o, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM c
"""
