"""Line scans: single and labelled patterns, first-match classification, distinct kinds, table references.

Patterns are literals, so each is compiled once for a task; a pattern table never becomes a nested-loop join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from lumenspan.functions import grams

from . import relate
from .store import counted

Patterns = Sequence[tuple[str, str]]


def to_lines(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, line, line_text): the \\n-split lines of each text, numbered from 1. A null text has none."""
    return docs.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line_text")).select(*keys, (F.col("pos") + 1).cast("long").alias("line"), "line_text")


def grep(lines: DataFrame, regex: str, text: str = "line_text") -> DataFrame:
    return lines.where(F.col(text).rlike(regex))


def labelled_hits(lines: DataFrame, patterns: Patterns, text: str = "line_text") -> DataFrame:
    """One row for each (line, pattern) that match: a line that fits k patterns appears k times, with ordinal and label."""
    tests = [F.when(F.col(text).rlike(regex), F.struct(F.lit(i).cast("long").alias("ord"), F.lit(label).alias("label"))) for i, (label, regex) in enumerate(patterns)]
    hits = lines.withColumn("__hit", F.explode(F.array_compact(F.array(*tests))))
    return hits.select(*lines.columns, F.col("__hit.ord").alias("ord"), F.col("__hit.label").alias("label"))


def first_match(text: Column, markers: Sequence[tuple[str, str, str]]) -> Column:
    """struct(kind, label) of the first marker (kind, label, regex) that fits, else null."""
    return F.coalesce(*(F.when(text.rlike(regex), F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"))) for kind, label, regex in markers))


def all_kinds(text: Column, markers: Sequence[tuple[str, str, str]]) -> Column:
    """The distinct kinds of all markers that fit, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(text.rlike(regex), F.lit(kind)) for kind, _, regex in markers)))))


def kinds_by(lines: DataFrame, keys: Sequence[str], markers: Sequence[tuple[str, str, str]], text: str = "line_text") -> DataFrame:
    """(keys, kinds): the sorted distinct kinds over all lines of a key, comma-joined; keys without any are left out."""
    found = lines.select(*keys, F.explode(all_kinds(F.col(text), markers)).alias("kind"))
    return found.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))  # as many as there are kinds


def captures(lines: DataFrame, regex: str, name: str, group: int = 1, text: str = "line_text") -> DataFrame:
    """One row for each match of the pattern, with a group's text."""
    return lines.withColumn(name, F.explode(F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(group))))


_WORD = "0-9A-Za-z_"


def names_in(texts: DataFrame, names: DataFrame, key: str = "id", text: str = "text", name: str = "name") -> DataFrame:
    """(key, name): the names that stand in a text between word boundaries (of ASCII words), whatever characters a name has.

    A run of word characters in a name is a whole word of any text that holds the name there: inside the name by what stands
    beside it, at its ends by the boundary. So a name stands where its tokens (words, and other characters) do, with a word on one
    side of each end, and runs of as many tokens as names have are looked for in one pass over each text. Those that a set of bits of
    all names lets through meet the names by equality. Names of more than MOST tokens meet texts by their first MOST; these are then
    verified by the name as a pattern. A null or empty name stands nowhere."""
    spark = texts.sparkSession
    kept = names.select(F.col(name).cast("string").alias("name")).where("name <> ''").distinct()
    keys, of = counted(kept.mapInArrow(grams.keys, grams.KEYS), lengths=F.collect_set("tokens"), longest=F.max(F.octet_length("gram")), beyond=F.count_if(~F.col("whole")))
    set_of = keys.select((F.col("bit") + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = np.zeros((1 << grams.BITS) // 8, np.uint8)
    for r in set_of.toLocalIterator():  # 8 MB, however many names there are
        bits[(r.at - 1) * len(r.bits) : r.at * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    held = spark.sparkContext.broadcast(bits)
    lengths, longest = sorted(of["lengths"] or []), of["longest"] or 0
    find = lambda batches: grams.finder(lengths, longest, held.value)(batches)
    rows = texts.select(F.col(key), F.col(text).cast("string").alias("__text"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows.where("__text <> ''").repartition(tasks, key, "__text").mapInArrow(find, StructType([rows.schema[key], StructField("gram", StringType()), StructField("closed", BooleanType())]))
    met = found.join(keys.select("gram", "name", "whole"), "gram")
    there = met.where("closed and whole").select(key, F.col("name").alias("__name"))
    if of["beyond"]:
        side = lambda char, ahead: F.when(char.rlike(f"^[{_WORD}]"), f"(?{ahead}![{_WORD}])").otherwise(f"(?{ahead}=[{_WORD}])")
        quoted = F.concat(F.lit(r"\Q"), F.replace("name", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        pattern = F.concat(side(F.substring("name", 1, 1), "<"), quoted, side(F.substring("name", -1, 1), ""))
        asked = met.where("not whole").select(key, "name").distinct().withColumn("__pattern", pattern).join(rows, key)
        there = there.unionByName(asked.where(F.regexp("__text", F.col("__pattern"))).select(key, F.col("name").alias("__name")))
    return there.distinct().withColumnRenamed("__name", name)


def call_edges(tokens: DataFrame, spans: DataFrame, defined: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """(caller, callee, path, line) from call tokens (path, line, callee), function spans (path, name, start, end) and the
    names defined: tokens inside a span that name a defined function, neither a stop word nor the span's own name, once for
    each line and caller's span."""
    inside = relate.span_join(tokens, spans, ["path"], "line")
    kept = inside.where((F.col("callee") != F.col("name")) & ~F.col("callee").isin(list(stop) or [""]))
    known = kept.join(defined.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi")
    return known.select(F.col("name").alias("caller"), "callee", "path", "line", "start").distinct().drop("start")
