"""Line provenance from version control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_porcelain(spark: SparkSession, text: str) -> DataFrame:
    """(commit, author, date, line, code) of `git blame --porcelain` of one file."""
    return lines_of(spark.createDataFrame([(i, s) for i, s in enumerate(text.split("\n")) if s], "n long, s string"))


def lines_of(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, commit, author, date, line, code) of the lines (keys, n, s) of blame output, for each key by n.

    A commit's author and date are told with its first line only, so they are carried from there to its other lines."""
    head = r"^([0-9a-f]{7,64}) \d+ (\d+)"
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # a file's
    code = F.startswith("s", F.lit("\t"))
    last = lambda x: F.last(x, ignorenulls=True).over(w)
    found = rows.select(
        *keys, "n", code.alias("is_code"), F.substring("s", 2, 1 << 30).alias("code"),
        last(F.when(~code & F.col("s").rlike(head), F.regexp_extract("s", head, 1))).alias("commit"),
        last(F.when(~code & F.col("s").rlike(head), F.regexp_extract("s", head, 2))).cast("long").alias("line"),
        F.when(~code, F.nullif(F.regexp_extract("s", "^author (.*)$", 1), F.lit(""))).alias("a"),
        F.when(~code, F.nullif(F.regexp_extract("s", r"^author-time (\d+)$", 1), F.lit(""))).cast("long").alias("t"),
    )
    commits = found.groupBy(*keys, "commit").agg(F.max("a").alias("author"), F.max("t").alias("t"))
    return found.where("is_code").drop("a", "t").join(commits, [*keys, "commit"]).select(*keys, "commit", "author", F.date_format(F.from_unixtime("t").cast("timestamp"), "yyyy-MM-dd").alias("date"), "line", "code")


def lines_by_author(lines: DataFrame) -> DataFrame:
    return lines.groupBy("author").agg(F.count(F.lit(1)).alias("n"))
