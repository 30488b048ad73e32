"""Flow of values over methods: reachability along edges within methods, from arguments to parameters and from returns to
results, in which a return only goes back to the site whose call was entered.

Tables: within (src, dst); calls and returns (site, src, dst). What a call does to its arguments is told by summary edges, from an
argument of a site to a result of it. They and the paths within methods that they are made of and extend are one
fixpoint: each round joins what is new with all that is known, so recursive methods come to an end and no method has a job of its own.
With summaries, a way that matches its calls and returns first only leaves methods and then only enters them: two plain searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .store import counted, stored

#: Parts of a growing table that are kept before they are written as one.
PARTS = 8


def summaries(within: DataFrame, calls: DataFrame, returns: DataFrame) -> DataFrame:
    """(src, dst): from what a site hands over to what it gets back, where the parameter reaches the return."""
    step = stored(within.select(F.col("src").alias("node"), "dst").dropna().distinct())
    enter = stored(calls.select("site", F.col("src").alias("given"), F.col("dst").alias("start")).dropna().distinct())
    leave = stored(returns.select("site", F.col("src").alias("node"), F.col("dst").alias("result")).dropna().distinct())
    new, got = counted(enter.select("start").distinct().withColumn("node", F.col("start")))
    paths, known, parts = new, step.select(F.col("node").alias("src"), "dst").where(F.lit(False)), 1
    while got["n"]:
        over = new.join(leave, "node").join(enter, ["site", "start"]).select(F.col("given").alias("src"), F.col("result").alias("dst")).distinct()
        fresh, more = counted(over.join(known, ["src", "dst"], "left_anti"))
        edges = step.unionByName(known.select(F.col("src").alias("node"), "dst"))
        longer = new.join(edges, "node").select("start", "dst")
        if more["n"]:  # what is new of the summaries lengthens the paths of all rounds
            longer = longer.unionByName(paths.join(fresh.withColumnRenamed("src", "node"), "node").select("start", "dst"))
            known = known.unionByName(fresh)
        found = longer.withColumnRenamed("dst", "node").distinct().join(paths, ["start", "node"], "left_anti")
        new, got = counted(found)
        paths, parts = paths.unionByName(new), parts + 1
        if parts > PARTS:
            paths, known, parts = stored(paths), stored(known), 1
    return known.distinct()


def matched_reach(within: DataFrame, calls: DataFrame, returns: DataFrame, seeds: DataFrame, backward: bool = False) -> DataFrame:
    """(node, depth): what flows from the seeds (column node), or with backward what flows into them; depth is of the last search."""
    pairs = ["src", "dst"]
    flat = within.select(*pairs).unionByName(summaries(within, calls, returns))
    src, dst = ("dst", "src") if backward else ("src", "dst")
    out_of, into = (calls, returns) if backward else (returns, calls)
    left = graph.reach(flat.unionByName(out_of.select(*pairs)), seeds, src, dst)
    return graph.reach(flat.unionByName(into.select(*pairs)), left.select("node"), src, dst)
