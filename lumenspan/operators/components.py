"""Connected components of an edge list, by contraction: every node hooks to its least neighbour, chains are halved until
they are flat, edges between the roots go into the next round. A round at least halves the nodes that have edges. Hubs cost
no task: least neighbours are aggregated on the map side first, and the joins on hub nodes are ones that AQE can split."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _forest(batches):
    """(a, b) batches to (node, least node of its tree) for what each partition alone connects."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:  # bounded: what is known so far goes out, and may be told again
            yield from _pairs(parent, root)
            parent.clear()
    yield from _pairs(parent, root)


def _pairs(parent: dict[int, int], root: Callable[[int], int]):
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.record_batch({"a": pa.array(np.array(part, np.int64)), "b": pa.array(np.array([root(x) for x in part], np.int64))})


def components(edges: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b) long edges to (node, root), for every node that has an edge to another; root is the least node of its component.

    store materialises a DataFrame where a lost executor can't take it away (a checkpoint or a written table). Null ends and
    loops are no edges; repeated edges don't matter; an empty edge list gives an empty result.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = store(edges.mapInArrow(_forest, "a long, b long"))
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = store(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("root")))
        while True:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("top"))
            flat = store(tree.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            moved = not flat.where("moved").isEmpty()
            tree = flat.drop("moved")
            if not moved:
                break
        rounds.append(tree)
        ends = edges.join(tree.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").select("ra", "b")
        ends = ends.join(tree.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").select(F.least("ra", "rb").alias("b"), F.greatest("ra", "rb").alias("a"))
        edges = store(ends.where("a <> b").distinct().select("a", "b"))
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0]
    for later in rounds[1:]:
        out = out.join(later.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out
