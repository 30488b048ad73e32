"""What keeps queries within their limits on large tables, at small size."""

import random
import re

from pyspark.sql import functions as F

from lumenspan.operators import graph, store
from lumenspan.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_not_broadcast_however_small_their_files(spark):
    like = lambda n: store.stored(spark.range(n).select(F.col("id").alias("k"), F.lit("the same in every row").alias("v")))
    large, small = like(store.LARGE + 1), like(10)
    other = spark.range(store.LARGE * 100).select(F.col("id").alias("k"))
    for table, shuffled in ((large, True), (large.where("v <> ''").select("k").distinct(), True), (small, False)):
        assert ("SortMergeJoin" in plan(other.join(table, "k"))) == shuffled
        assert ("BroadcastHashJoin" in plan(other.join(table, "k"))) != shuffled
    assert other.join(large, "k").count() == store.LARGE + 1


def test_files_of_one_partition_are_scanned_by_many_tasks(spark):
    text = F.concat(F.lit("class C"), "id", F.lit(" { void run() { a.set(1); } }"))
    rows = spark.range(200).coalesce(1).select(F.lit("r").alias("repo"), F.concat("id", F.lit(".java")).alias("path"), F.lit("java").alias("lang"), text.alias("text"))
    found = files.parsed(rows)
    used = found.select(F.spark_partition_id().alias("p"), F.explode("functions.name").alias("n")).groupBy("p").count().collect()
    assert len(used) > 4 and sum(r["count"] for r in used) == 200


def pairs_by_search(edges, starts=None):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for s in after if starts is None else starts:
        had, now, depth = set(), {s}, 0
        while now:
            depth += 1
            now = {b for a in now for b in after.get(a, ())} - had
            had |= now
            out |= {(s, n, depth) for n in now}
    return out


def test_closure_of_packed_starts_over_cycles_and_single_ways(spark):
    rng = random.Random(5)
    edges = [(i, 2 * i + k) for i in range(1, 150) for k in (0, 1)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(60)] + [(7, 7), (2, 1)]
    table = spark.createDataFrame(edges, "src long, dst long")
    want = pairs_by_search(edges)
    assert {tuple(r) for r in graph.closure(table).collect()} == want and graph.closure(table).count() == len(want)
    starts = sorted({a for a, _ in edges})[::2]
    found = graph.closure(table, starts=spark.createDataFrame([(s,) for s in [*starts, 999]], "start long"))
    assert len(starts) > graph.BITS and sorted(tuple(r) for r in found.collect()) == sorted(pairs_by_search(edges, starts))
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert graph.closure(ring).count() == 9 and graph.closure(ring, max_depth=2).count() == 6
    assert graph.closure(ring, starts=spark.createDataFrame([("x",), (None,)], "start string")).count() == 0


def test_a_node_with_one_way_in_is_never_compared_with_what_was_seen(spark, monkeypatch):
    """Trees need no memory of pairs: no round of theirs joins what earlier rounds found."""
    written = []
    real = graph.counted
    monkeypatch.setattr(graph, "counted", lambda df, **k: (written.append(plan(df)), real(df, **k))[1])
    tree = spark.createDataFrame([(i, 2 * i + k) for i in range(1, 60) for k in (0, 1)] + [(2, 1)], "src long, dst long").where("dst <> 2 or src = 1")
    assert graph.closure(tree).count() == len(pairs_by_search([tuple(r) for r in tree.collect()]))
    assert len(written) > 4 and not any("LeftAnti" in p or "LeftOuter" in p for p in written)


def test_lines_of_single_ways_are_told_in_rounds_that_double(spark, monkeypatch):
    """A line of 200 nodes takes no 200 rounds, and neither do those that come round again or go on below a node with two ways in."""
    written = []
    real = graph.counted
    monkeypatch.setattr(graph, "counted", lambda df, **k: (written.append(1), real(df, **k))[1])
    line = [(i, i + 1) for i in range(200)] + [(50, 1000), (1000, 1001)]
    table = spark.createDataFrame(line, "src long, dst long")
    assert {tuple(r) for r in graph.closure(table).collect()} == pairs_by_search(line) and len(written) < 12
    assert graph.closure(table, max_depth=5).where("depth > 5").count() == 0 and len(written) < 20
    assert graph.closure(table, max_depth=5).count() == sum(d <= 5 for _, _, d in pairs_by_search(line))
    written.clear()
    ended = [*line, (199, 3000), (1001, 3000), (3000, 3001), *((4000 + i, 4000 + (i + 1) % 40) for i in range(40)), (4007, 5000)]
    found = [tuple(r) for r in graph.closure(spark.createDataFrame([e for e in ended if e[0] > 185 or e[0] < 20], "src long, dst long")).collect()]
    want = pairs_by_search([e for e in ended if e[0] > 185 or e[0] < 20])
    assert len(found) == len(want) and set(found) == want


def test_closures_of_many_small_graphs(spark):
    """Trees, rings with tails, and nodes with several ways in above and below them: 60 graphs in one table."""
    rng = random.Random(11)
    single = [(f"{g}-{rng.randrange(12)}", f"{g}-{n}") for g in range(60) for n in range(12) if rng.random() < 0.9]
    several = [(f"{g}-{rng.randrange(12)}", f"{g}-{rng.randrange(12)}") for g in range(60) for _ in range(rng.randrange(6, 15))]
    for edges in (single, single + several[:40], several):
        table = spark.createDataFrame(edges, "src string, dst string")
        want = sorted(pairs_by_search(edges))
        assert sorted(tuple(r) for r in graph.closure(table).collect()) == want
        assert sorted(tuple(r) for r in graph.closure(table, max_depth=3).collect()) == [x for x in want if x[2] <= 3]


def test_pairs_that_follow_from_those_of_a_parent_are_not_looked_for(spark, monkeypatch):
    """Over a tree with ways up, all rows that are written are few beside the pairs: these are made when the result is read."""
    written = []
    real = graph.counted
    monkeypatch.setattr(graph, "counted", lambda df, **k: (got := real(df, **k), written.append(got[1]["n"]))[0])
    edges = [(k, t) for k in range(1, 700) for t in (2 * k, 2 * k + 1, k // 3) if 1 <= t < 700]
    found = graph.closure(spark.createDataFrame(edges, "src long, dst long"), starts=spark.range(1, 700).select(F.col("id").alias("start")))
    assert sorted(tuple(r) for r in found.collect()) == sorted(pairs_by_search(edges)) and sum(written) < 699 * 699 / 20


def test_pairs_told_by_a_forest_and_its_exceptions(spark, monkeypatch):
    """Trees with other edges, rings, grids and parts apart, as many as 40 graphs in one table, whatever edges the forest leaves open."""
    monkeypatch.setattr(graph, "OPEN_SHARE", 10)
    monkeypatch.setattr(graph, "FEW", 1)
    rng = random.Random(17)
    tree = [(f"{g:02}-{rng.randrange(n):02}", f"{g:02}-{n:02}") for g in range(40) for n in range(1, 14) if rng.random() < 0.9]
    other = [(f"{g:02}-{rng.randrange(14):02}", f"{g:02}-{rng.randrange(14):02}") for g in range(40) for _ in range(rng.randrange(12))]
    grid = [(f"{x}.{y}", f"{u}.{v}") for x in range(7) for y in range(7) for u, v in ((x + 1, y), (x, y + 1)) if u < 7 and v < 7]
    told, real = [], graph._told_by_forest
    monkeypatch.setattr(graph, "_told_by_forest", lambda *a: (told.append(1), real(*a))[1])
    for block, near, edges in ((3, 8, tree + other), (64, 1, tree + other[:60] + grid)):
        monkeypatch.setattr(graph, "BLOCK", block)
        monkeypatch.setattr(graph, "NEAR", near)
        starts = [*sorted({a for a, _ in edges})[::2], "99-99"]
        found = graph.closure(spark.createDataFrame(edges, "src string, dst string"), starts=spark.createDataFrame([(s,) for s in starts], "start string"))
        assert sorted(tuple(r) for r in found.collect()) == sorted(pairs_by_search(edges, starts))
    assert len(told) == 2
    line = [(i, i + 1) for i in range(70)] + [(10, 200), (200, 201)]
    found = graph.closure(spark.createDataFrame(line, "src long, dst long"), starts=spark.createDataFrame([(5,), (60,)], "start long"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(pairs_by_search(line, [5, 60])) and len(told) == 2


def test_names_that_share_a_frequent_word_move_no_text_for_each(spark):
    """Names of a few tokens are told by equality; only longer ones are looked at as patterns, where their first tokens stand."""
    from lumenspan.operators import search

    names = [f"{chr(0x100 + i)}the" for i in range(300)] + ["a, the", "the", " "]
    long = ["x" + "-x" * k for k in (7, 8, 15)] + ["-x" * 9 + "-"]
    texts = ["the a, the b"] * 3 + [f"x{n} and {n}y" for n in names[:40]] + [n + s for n in long for s in ("", "-x", "x", "-")] + ["y" + long[-1] + "y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for some in (names, names + long):
        found = search.names_in(rows, spark.createDataFrame([(n,) for n in some], "name string"))
        assert ("RLIKE" in plan(found)) == (some is not names)
        assert sorted(tuple(r) for r in found.collect()) == sorted((i, n) for i, t in enumerate(texts) for n in some if re.search(rf"\b{re.escape(n)}\b", t, re.A))


def test_names_are_found_over_the_ends_of_stretches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lumenspan.functions import grams

    names = ["b c", "éa-b", "-", "a", "é", "bb cc", "漢 b"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", "c", " ", "-", "é", "漢", "bb cc"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    (keys,) = grams.keys(iter([pa.record_batch([pa.array(names)], names=["name"])]))
    bits = np.zeros((1 << grams.BITS) // 8, np.uint8)
    for b in keys.column("bit").to_pylist():
        bits[b >> 3] |= 1 << (b & 7)
    lengths = sorted(set(keys.column("tokens").to_pylist()))
    want = {(i, n) for i, t in enumerate(texts) for n in names if re.search(rf"\b{re.escape(n)}\b", t, re.A)}
    batch = pa.record_batch([pa.array(range(300)), pa.array([*["skipped"] * 100, *texts])], names=["id", "text"]).slice(100)
    for part in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(grams, "PART", part)
        got = {(i - 100, g) for out in grams.finder(lengths, 8, bits)(iter([batch])) for i, g in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
        assert {(i, g) for i, g in got if g in names} == want
