import re
from datetime import UTC, datetime, timedelta

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenspan.functions import flow
from lumenspan.functions.code import Source, Statements, blank, functions, lines_of, types
from lumenspan.functions.languages import LANGUAGES, language_of
from lumenspan.functions.regex import glob_to_regex, to_java
from lumenspan.operators import components, graph, program, relate, windows
from lumenspan.operators.store import stored
from lumenspan.plans import manifest
from lumenspan.plans.lenses import parse_patterns
from lumenspan.sources import files as source
from lumenspan.streaming import watch
from lumenspan.streaming.trees import follow_tree

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("e", "d"), ("x", "y"), (None, "a")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string")


def test_reach_against_sql(spark, edges):
    con = duckdb.connect()
    con.execute("create table e(src varchar, dst varchar)")
    con.executemany("insert into e values (?, ?)", EDGES)
    for seed in ("a", "e", "nobody"):
        want = con.execute("with recursive r as (select ? n, 0 d union select dst, d + 1 from r join e on src = n where d < 9) select n, min(d) from r group by n", [seed]).fetchall()
        got = graph.reach(edges, spark.createDataFrame([(seed,)], "node string")).collect()
        assert {tuple(r) for r in got} == set(want)


def test_closure_paths_and_impact(spark, edges):
    every = {(r.start, r.node) for r in graph.closure(edges).collect()}
    assert ("a", "a") in every and ("e", "d") in every and ("d", "a") not in every
    only = {(r.start, r.node) for r in graph.closure(edges, starts=spark.createDataFrame([("a",)], "start string")).collect()}
    assert only == {p for p in every if p[0] == "a"}
    seed = spark.createDataFrame([("a",)], "node string")
    assert sorted(r.path for r in graph.simple_paths(edges, seed).collect()) == [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]]
    assert [r.path for r in graph.simple_paths(edges, seed, graph.F.col("node") == "c").collect()] == [["a", "b", "c"]]
    calls = edges.toDF("caller", "callee")
    assert {(r.node, r.depth) for r in graph.impact_set(calls, spark.createDataFrame([("d",)], "node string")).collect()} == {("c", 1), ("e", 1), ("b", 2), ("a", 3)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 40), st.integers(-5, 40)), max_size=60))
def test_components(spark, pairs):
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long").repartition(3), stored).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    lone = {x for x in parent if all(a == b for a, b in pairs if x in (a, b))}
    assert got == {x: root(x) for x in parent if x not in lone}


def test_k_of_n_of_a_hot_key(spark):
    df = spark.range(2000).selectExpr("id", "if(id % 3 = 0, null, if(id % 10 < 8, 1, id)) AS key")
    rows = windows.k_of_n(df, "key", "id").collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.id):
        by.setdefault(r.key, []).append(r)
    assert len(rows) == 2000 and all([x.k for x in v] == list(range(1, len(v) + 1)) and {x.n for x in v} == {len(v)} for v in by.values())


def test_relate(spark):
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string"), spark.createDataFrame([("b", "2"), ("c", "1"), ("d", "1")], "path string, content_hash string")
    assert {tuple(r) for r in relate.manifest_diff(old, new, "path", "content_hash").collect()} == {("a", "removed"), ("b", "modified"), ("d", "added")}
    points, spans = spark.createDataFrame([("f", 5), ("f", 50), ("g", 5)], "path string, line long"), spark.createDataFrame([("f", 1, 10), ("f", 4, 6), ("f", 5, 5)], "path string, start long, end long")
    assert {(r.path, r.line, r.start) for r in relate.innermost(points, spans, ["path"], "line").collect()} == {("f", 5, 5)}
    roots = spark.createDataFrame([("a",), ("a/b",), ("ab",)], "root string")
    paths = spark.createDataFrame([("a/b/c",), ("a/x",), ("abc",), ("ab",)], "path string")
    assert {tuple(r) for r in relate.longest_prefix(paths, "path", roots, "root").select("path", "root").collect()} == {("a/b/c", "a/b"), ("a/x", "a"), ("abc", None), ("ab", "ab")}
    assert relate.argmax_by(spark.createDataFrame([("js",), ("go",), (None,)], "lang string"), "lang", ["java", "go", "js"]).first()["lang"] == "go"


def test_incremental_refresh(spark):
    texts = {"a.java": "class A {\n void a() {\n }\n}\n", "b.java": "class B {\n void b() {\n }\n}\n"}
    files = source.from_texts(spark, texts)
    table = stored(source.explode(source.parsed(files), "functions"))
    hashes = stored(manifest.snapshot(files))
    new = source.from_texts(spark, {"a.java": texts["a.java"], "b.java": "class B {\n void c() {\n }\n}\n", "d.java": "class D {\n void d() {\n }\n}\n"})
    seen = []

    def compute(f):
        seen.extend(r.path for r in f.select("path").collect())
        return source.explode(source.parsed(f), "functions")

    got, changes = manifest.refresh(new, table, hashes, compute)
    assert sorted(r["name"] for r in got.collect()) == ["a", "c", "d"] and sorted(seen) == ["b.java", "d.java"]
    assert manifest.counts(changes) == {"added": 1, "modified": 1, "removed": 0}


CASES = [(r"\bla\b", "éla", True), (r"\bla\b", "xla", False), (r"(?i)é", "É", True), (r"a$", "a\n", False), (r"a.b", "a\rb", True), (r"a\sb", "a\x0bb", False), (r"[\s]x", "\tx", True), (r"[[]", "[", True), (r"[^]a]", "b", True), (r"\bx\B", "xy", True)]


@pytest.mark.parametrize(("pattern", "text", "want"), CASES)
def test_dialect(spark, pattern, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(df["t"].rlike(to_java(pattern))).first()[0] is want


def test_patterns_and_globs(spark):
    assert glob_to_regex("*kafka*.send") == r"[A-Za-z0-9_.$]*kafka[A-Za-z0-9_.$]*\.send" and glob_to_regex("a+(") == r"a\+\("
    assert parse_patterns("a=x=y; @B ;") == [("a", "x=y"), ("@B", "@B")]
    df = spark.createDataFrame([("x",)], "t string")
    for lang in LANGUAGES.values():  # every marker compiles in both dialects
        for _, _, rx in lang.markers:
            re.compile(rx)
            df.select(df["t"].rlike(to_java(rx))).collect()
    assert language_of("a/b.TSX") == "js" and language_of("Makefile") is None


def test_blanking_and_lines():
    text = 'a = "{ // \\" no"; // } gone\n/* { */ b = \'}\'; `x\n{`;\n'
    assert len(blank(text)) == len(text) and "{" not in blank(text) and "}" not in blank(text) and blank(text).count("\n") == 3
    assert lines_of("a\r\nb\n") == ["a", "b"] and lines_of("") == [] and lines_of("a\n\n") == ["a", ""]


JAVA = """package q;
/** void fake() { */
public abstract class Outer<T extends Comparable<T>> extends Base<T, Long> implements Runnable, Map<String, T> {
    private final List<String> names = new ArrayList<>();
    static int N;
    String text = "void g() {";
    @Override
    @RequestMapping({"/a", "/b"})
    public <X> void run(int a,
            Map<String, X> b) throws IOException, E {
        Runnable r = () -> { inner(); };
        if (a > 1) return;
        else if (a < 0) {
            throw new E();
        }
        for (int i = 0; i < 3; i++) {
            if (i == 2) { break; }
        }
        last();
    }
    abstract void none();
    static class Inner {
        void deep() { x(); }
    }
}
interface Small {}
"""


def test_java_source():
    src = Source(JAVA)
    assert [(f.name, f.owner, f.start, f.end, f.annotations) for f in functions(src)] == [("run", "Outer", 9, 20, ["@Override", '@RequestMapping({"/a", "/b"})']), ("deep", "Inner", 23, 23, [])]
    ts = {t.name: t for t in types(src).values()}
    assert set(ts) == {"Outer", "Inner", "Small"} and ts["Outer"].abstract and ts["Small"].abstract and not ts["Inner"].abstract
    assert (ts["Outer"].extends, ts["Outer"].extends_args, ts["Outer"].implements, ts["Outer"].package) == ("Base", ["T", "Long"], ["Runnable", "Map"], "q")
    assert [(n, t) for n, t, _ in ts["Outer"].fields] == [("names", "List"), ("text", "String")]


def test_ways_and_guards():
    src = Source(JAVA)
    run = functions(src)[0]
    body = Statements(src).body(run.open, run.close)
    assert flow.ways_to(body, 19) == [[(12, "a > 1", False), (13, "a < 0", False)]]
    assert flow.guards_at(body, 14) == ["!(a > 1)", "a < 0"]
    assert flow.guards_at(body, 17) == ["for(int i = 0; i < 3; i++)", "i == 2"]
    assert flow.evaluate("n >= 3", {"n": "4"}) is True and flow.evaluate('s.equals("a")', {"s": "b"}) is False and flow.evaluate("f(x)", {}) is None and flow.evaluate("n > 1", {"n": "x"}) is None
    assert flow.values_in('a.b(c, "d e", f.g) + this.h') == ["a", "c", "f"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="{}()\"'/*\n;ifels e=x@", max_size=80), st.sampled_from(["java", "go", "js"]))
def test_scanner_takes_anything(text, lang):
    src = Source(text, lang)
    for f in functions(src):
        assert 1 <= f.start <= f.end
        body = Statements(src).body(f.open, f.close)
        assert all(n.start <= n.end for n in flow.flat(body))
        flow.guards_at(body, f.end)
    source.scan("p", lang, text)


def test_other_languages():
    go = Source("package m\n\nfunc (s *S) Do(a int) (int, error) {\n\tif x := f(); x > 1 {\n\t\treturn 1, nil\n\t} else {\n\t\tg()\n\t}\n\treturn 0, nil\n}\n", "go")
    fn = functions(go)[0]
    assert (fn.name, fn.start, fn.end) == ("Do", 3, 10)
    assert flow.guards_at(Statements(go).body(fn.open, fn.close), 7) == ["!(x > 1)"]
    js = Source("export class K {\n  async load(a) {\n    if (a) {\n      go();\n    }\n  }\n}\nconst f = async (x) => {\n  return x;\n};\nfunction g() {}\n", "js")
    assert [(f.name, f.owner, f.start, f.end) for f in functions(js)] == [("load", "K", 2, 6), ("f", "", 8, 10), ("g", "", 11, 11)]


def test_dispatch_falls_back_to_the_declared_type(spark):
    texts = {"A.java": "abstract class A {\n void make() {\n  step();\n }\n abstract void step();\n}\n", "B.java": "class B extends A {\n void step() {\n }\n}\n", "C.java": "class C {\n A a;\n void go() {\n  a.make();\n }\n}\n"}
    made = stored(source.parsed(source.from_texts(spark, texts, "r")))
    ms, ts = program.methods(made), program.types(made)
    got = {(e.caller, e.callee, e.di) for e in program.dispatch_edges(program.call_sites(made, ms, ts), ms, ts).collect()}
    assert got == {("r::C.go#3", "r::A.make#2", False), ("r::A.make#2", "r::B.step#2", True)}


def test_poll(spark):
    rows, now = [], datetime(2025, 1, 1, tzinfo=UTC)
    t = watch.Watched("dev", "d", "t", lambda s: s.createDataFrame(rows, "id long, v string"), limit=2)
    every = watch.Watched("dev", "d", "all", lambda s: s.createDataFrame(rows, "id long, v string"), limit=2, bootstrap="all")
    rows.append((1, "a"))
    state, new = watch.poll(spark, [t, every], watch.State(), now)
    assert [(r["table"], r["id"]) for r in new] == [("all", 1)] and state.marks["dev/d/t"]["last_id"] == 1
    rows += [(2, None), (3, "c"), (4, "d")]
    state, new = watch.poll(spark, [t], watch.State.load(state.dump()), now + timedelta(minutes=1))
    assert [(r["id"], r["values"]) for r in new] == [(2, ["2", ""]), (3, ["3", "c"])]
    later, new = watch.poll(spark, [t], state, now + timedelta(minutes=11))
    assert [r["id"] for r in new] == [4] and [r["id"] for r in later.rows] == [2, 3, 4]  # a stamp on the edge stays
    bad = watch.Watched("dev", "d", "bad", lambda s: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        watch.poll(spark, [t, bad], later, now)
    assert watch.State.load("  ") == watch.State() and watch.poll_every([60, 5]) == 5 and watch.poll_every([]) == 30
    assert watch.prune([{"seen_at": "?"}], now, timedelta(0)) == [{"seen_at": "?"}]


def test_statements_run_at_the_source(spark):
    from lumenspan.plans.watching import _jdbc

    said = []

    def statement(s, sql):
        said.append(sql)
        return s.createDataFrame([(7,)], "last_id long") if "MAX" in sql else s.createDataFrame([(9, "b"), (8, "a")], "id long, v string")

    t = watch.Watched("dev", "d", "app.t", lambda s: 1 / 0, limit=2, statement=statement)
    state, new = watch.poll(spark, [t], watch.State(), datetime(2025, 1, 1, tzinfo=UTC))
    assert not new and state.marks["dev/d/app.t"]["last_id"] == 7
    state, new = watch.poll(spark, [t], state, datetime(2025, 1, 1, tzinfo=UTC))
    assert [r["id"] for r in new] == [8, 9] and state.marks["dev/d/app.t"]["last_id"] == 9
    assert said == ['SELECT COALESCE(MAX("id"), 0) AS last_id FROM "app"."t"', 'SELECT * FROM "app"."t" WHERE "id" > 7 ORDER BY "id" LIMIT 2']
    with pytest.raises(ValueError):
        watch.poll(spark, [watch.Watched("e", "d", "x; drop", t.read, statement=statement)], watch.State(), datetime(2025, 1, 1, tzinfo=UTC))
    assert _jdbc("postgres://u:p@h:5432/app?sslmode=disable") == "jdbc:postgresql://h:5432/app?user=u&password=p&sslmode=disable" and _jdbc("/data") is None


def test_stream_restarts_and_writes_once(spark, tmp_path):
    schema = "id long, ts timestamp, kind string"
    put = lambda a, b: spark.range(a, b).selectExpr("id", "timestamp_seconds(id * 60) ts", "concat('k', id % 2) kind").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    to = f"file://{tmp_path}/out"

    def go():
        s = watch.stream(spark, str(tmp_path / "in"), schema).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: watch.append_new(b, to, ["id"])).trigger(availableNow=True).start()
        s.awaitTermination()

    put(0, 5)
    go()
    put(3, 8)  # 3 and 4 come again
    go()
    go()
    got = spark.read.parquet(to)
    assert sorted(r.id for r in got.collect()) == list(range(8)) and "seen_at" in got.columns


def test_event_time_windows(spark, tmp_path):
    spark.range(0, 30).selectExpr("timestamp_seconds(id * 60) ts", "'k' kind").coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, made in (("w", lambda s: watch.windowed(s, "ts", "1 minute", "10 minutes", "kind")), ("s", lambda s: watch.sessions(s, "ts", "1 minute", "5 minutes", "kind"))):
        q = made(spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [10, 10, 10]


def test_following_a_tree(spark, tmp_path):
    from lumenspan.plans.lens import Config, Lens

    (tmp_path / "projections").mkdir()
    (tmp_path / "A.java").write_text("class A {\n  int one() {\n    return 1;\n  }\n}\n")
    config = Config(root=str(tmp_path), projections_dir="projections", lenses=[Lens("references", "refs", params={"name": "one"})])
    steps = iter([lambda: (tmp_path / "projections/d.projection").write_text("A.java:2-4\n"), lambda: (tmp_path / "projections/d.projection").write_text((tmp_path / "projections/d.projection").read_text().replace("return 1;", "return 7;"))])
    done = list(follow_tree(spark, config, rounds=2, sleep=lambda _: next(steps)()))
    assert done[0]["drop_ins"] and list(done[1]["synced"]) == ["projections/d.projection"] and done[1]["changed"] == ["A.java"]
    assert "return 7;" in (tmp_path / "A.java").read_text() and (tmp_path / "projections/refs.projection").exists()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from lumenspan import cli

    (tmp_path / "A.java").write_text("class A {\n  int one() {\n    return 1;\n  }\n}\n")
    monkeypatch.chdir(tmp_path)
    assert cli.main(["run", "--analyzer", "references", "name=one"]) == 0
    assert "int one() {" in capsys.readouterr().out
    assert cli.main(["workspace", "add", "p", "."]) == 0
    assert cli.main(["perf"]) == 0
    assert '"flows": 0' in capsys.readouterr().out


def test_paths_end_after_as_many_as_asked(spark):
    """Twelve layers of four nodes, each linked to all of the next and back: millions of simple paths, of which five are asked for."""
    layers = [[f"n{i:02d}{j}" for j in range(4)] for i in range(12)]
    pairs = [(a, b) for x, y in zip(layers, layers[1:], strict=False) for a in x for b in y]
    pairs += [(b, a) for a, b in pairs] + [("s", n) for n in layers[0]] + [(n, "t") for n in layers[-1]] + [("s", "trap"), ("trap", "s")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    got = [r.path for r in graph.simple_paths(edges, one("s"), ends=one("t"), most=5, open_most=50).collect()]
    want = [["s", *(f"n{i:02d}0" for i in range(11)), f"n11{j}", "t"] for j in range(4)] + [["s", *(f"n{i:02d}0" for i in range(10)), "n101", "n110", "t"]]
    assert got == want
    assert graph.simple_paths(edges, one("s"), ends=one("nowhere"), most=5).count() == 0
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert [r.path for r in graph.simple_paths(ring, one("a"), ends=one("d"), most=9).collect()] == [["a", "b", "c", "d"]]
    assert [r.path for r in graph.simple_paths(ring, one("a"), ends=one("d").union(one("b")), most=1, longest=True).collect()] == [["a", "b"]]


def test_an_index_computes_what_changed(spark):
    from lumenspan.plans import manifest
    from lumenspan.sources import files as source

    done = []

    def compute(files):
        done.append(sorted(r.path for r in files.select("path").collect()))
        return files.selectExpr("path", "length(text) AS n")

    def index(texts):
        return {r.path: r.n for r in manifest.indexed(source.from_texts(spark, texts), "t", compute).collect()}

    assert index({"a.go": "x", "b.go": "yy"}) == {"a.go": 1, "b.go": 2}
    assert index({"a.go": "x", "b.go": "yy"}) == {"a.go": 1, "b.go": 2}
    assert index({"a.go": "xxx", "c.go": "z"}) == {"a.go": 3, "c.go": 1}
    assert done == [["a.go", "b.go"], ["a.go", "c.go"]]


def test_no_folder_of_one_machine_on_a_cluster():
    from lumenspan.operators import store

    class Cluster:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Cluster()  # noqa: N815
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        store.shared_dir(Session())


def test_common_directory_and_endings(spark):
    from lumenspan.operators import relate

    common = lambda *paths: relate.common_directory(spark.createDataFrame([(p,) for p in paths], "path string"), "path").first()[0]
    assert common("a/b/c.go", "a/b/d/e.go") == "a/b" and common("a/bc/x", "a/bd/x") == "a" and common("x.go", "a/y.go") == "." and common("a/x") == "a"
    paths, refs = spark.createDataFrame([("a/b/c.go",), ("xb/c.go",)], "path string"), spark.createDataFrame([("b/c.go",), ("c.go",), ("a/b/c.go",)], "ref string")
    got = {tuple(r) for r in relate.ends_with(paths, "path", refs, "ref").collect()}
    assert got == {("a/b/c.go", "b/c.go"), ("a/b/c.go", "c.go"), ("a/b/c.go", "a/b/c.go"), ("xb/c.go", "c.go")}


def test_a_scanner_of_ones_own(spark):
    from lumenspan.sources import files as source

    files = source.from_texts(spark, {"a.go": "x", "b.java": "class B {}"})
    got = {r.path: r for r in source.parsed(files, {"go": lambda path, lang, text: {"symbols": [{"name": text, "kind": "func", "line": 1}]}}).collect()}
    assert [tuple(x) for x in got["a.go"].symbols] == [("x", "func", 1)] and got["a.go"].functions == []
    assert [t.name for t in got["b.java"].types] == ["B"]


def test_names_of_any_characters_stand_in_texts(spark):
    import re

    from lumenspan.operators import search

    names = ["get-order", "listOrders", "/orders/{id}", "order", "a.b", "a", "{id}", "/", "-x-", "é", "éa", "x+", "$", r"\Ea", "get", "a b", "\n", ""]
    texts = ["call('get-order')", "x.get-orders()", "listOrders", "alistOrders", "api/orders/{id}x", "/orders/{id}", "(get-order)", "a.b a_b aXb", "1/2", "/", "y-x-z -x-", "aéa é", "x+y", "a$b", r"1\Ea", None, "", "a\nb", "a b", "order-get", "é a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.name) for r in search.names_in(rows, spark.createDataFrame([(n,) for n in [*names, None, "get"]], "name string")).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in names if n and re.search(rf"\b{re.escape(n)}\b", t or "", re.A)}
    assert search.names_in(rows.limit(0), spark.createDataFrame([("a",)], "name string")).count() == 0


def paths_by_hand(pairs, seeds, ends, most, hops=None):
    out, todo = [], [[s] for s in seeds]
    while todo:
        p = todo.pop()
        for a, b in pairs:
            if a == p[-1] and b not in p and (hops is None or len(p) <= hops):
                (out if b in ends else todo).append([*p, b])
    return sorted(out, key=lambda p: (len(p), p))[:most]


def test_shortest_paths_equal_brute_force(spark):
    import random

    rng = random.Random(8)
    for case in range(4):
        nodes = [f"n{i}" for i in range(8)]
        pairs = list({(rng.choice(nodes), rng.choice(nodes)) for _ in range(22)})
        seeds, ends = rng.sample(nodes, 2), rng.sample(nodes, 2)
        frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "node string")
        edges = spark.createDataFrame(pairs, "node string, next string").distinct()
        want = paths_by_hand(pairs, seeds, ends, 9, hops := None if case % 2 else 5)
        assert [r.path for r in graph.shortest_paths(edges, frame(seeds), frame(ends), 9, hops).collect()] == want
        if case < 2:
            assert [r.path for r in graph.deviations(edges, frame(seeds), frame(ends), 9, hops).collect()] == want


def test_dead_ends_hide_no_path(spark):
    """From s by v to e; v leads to 6,000 nodes that only lead back to it; the second path is longer than what those can hold."""
    pairs = [("s", "v"), ("v", "e"), *((a, b) for i in range(6000) for a, b in (("v", f"d{i}"), (f"d{i}", "v")))]
    chain = ["s", *(f"w{i}" for i in range(1, 6)), "e"]
    edges = spark.createDataFrame([*pairs, *zip(chain, chain[1:], strict=False)], "src string, dst string")
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    assert [r.path for r in graph.simple_paths(edges, one("s"), ends=one("e"), most=2).collect()] == [["s", "v", "e"], chain]


def test_points_in_many_spans_of_one_key(spark):
    """A hot key whose spans nest and touch, one beyond all points, some empty; every pair comes once."""
    import random

    from lumenspan.operators import relate

    rng = random.Random(3)
    spans = [("f", a, a + rng.choice([0, 1, 7, 8, 63, 500, 4000])) for a in (rng.randint(-20, 3000) for _ in range(200))]
    spans += [("f", 1, 1 << 62), ("f", 0, 7), ("f", 8, 15), ("f", 9, 3), ("f", None, 5), ("g", 2, 4), (None, 1, 9)]
    points = [("f", p) for p in [*range(-30, 3100, 7), 1 << 40, None]] + [("g", 3), ("g", 5), (None, 3)]
    s, p = spark.createDataFrame(spans, "path string, start long, end long"), spark.createDataFrame(points, "path string, line long")
    got = sorted(((r.path, r.line, r.start, r.end) for r in relate.span_join(p, s, ["path"], "line").collect()))
    assert got == sorted((k, x, a, b) for k, x in points if k and x is not None for j, a, b in spans if j == k and a is not None and a <= x <= b)


def test_many_lines_of_one_path_in_linear_work(spark):
    from lumenspan.operators import relate

    spans = spark.range(100_000).selectExpr("'p' AS path", "id * 10 AS start", "id * 10 + 9 AS end").union(spark.range(1).selectExpr("'p'", "0L", "999999L"))
    points = spark.range(1_000_000).selectExpr("'p' AS path", "id AS line")
    joined = relate.span_join(points, spans, ["path"], "line")  # all pairs would be 10^11
    assert joined.count() == 2_000_000 and relate.innermost(points.where("line % 1000 = 7"), spans, ["path"], "line").where("start = line - 7").count() == 1000


@pytest.fixture
def many_parts(spark):
    """Small tables keep all their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans_of_a_hot_key_equal_windows(spark, many_parts):
    """A key with nearly all rows lies in several parts; results are those of a window over whole keys."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from lumenspan.operators import windows

    rows = spark.range(4000).selectExpr("CASE WHEN id % 50 = 0 THEN 'cold' || id % 7 WHEN id % 401 = 1 THEN NULL ELSE 'hot' END AS k", "id AS line", "CASE WHEN xxhash64(id) % 900 = 0 THEN id END AS v", "int(xxhash64(id) % 3) AS o", "int(xxhash64(id, 1) % 3) AS c")
    rows = rows.cache()
    w = Window.partitionBy("k").orderBy("line")
    want = rows.select("line", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("a"), F.coalesce(F.sum(F.col("o") - F.col("c")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.max(F.when(F.col("v").isNotNull(), F.col("line"))).over(w.rowsBetween(-600, -1)).alias("d"), F.max(F.when(F.col("o") == 1, F.col("line"))).over(w.rowsBetween(-8, -1)).alias("e"))
    got = windows.carry_forward(rows, ["k"], ["line"], F.col("v"), "a")
    got = got.join(windows.running_depth(rows, ["k"], F.col("o"), F.col("c"), "b").select("line", "b"), "line")
    got = got.join(windows.look_back(rows, ["k"], F.col("v").isNotNull(), 600, "d").select("line", "d"), "line")
    got = got.join(windows.look_back(rows, ["k"], F.col("o") == 1, 8, "e").select("line", "e"), "line")
    assert windows._ranged(rows, ["k"], ["line"]).where("k = 'hot'").select("__part").distinct().count() > 1
    assert sorted(map(tuple, got.select("line", "a", "b", "d", "e").collect())) == sorted(map(tuple, want.collect()))


def test_flows_match_calls_with_returns(spark):
    """Random methods with recursion against a search over explicit call stacks of bounded depth."""
    import random

    from lumenspan.operators import flows

    rng = random.Random(11)
    for _ in range(3):
        node = lambda m: f"m{m}.{rng.choice('pabr')}"
        within = list({(node(m), node(m)) for m in range(5) for _ in range(4)})
        sites = [(s, rng.randrange(5), rng.randrange(5)) for s in range(8)]
        calls = [(s, f"m{a}.{rng.choice('pab')}", f"m{b}.p") for s, a, b in sites]
        returns = [(s, f"m{b}.r", f"m{a}.{rng.choice('abr')}") for s, a, b in sites]
        seeds = [node(0)]

        def reached(start, back=False):
            edges = [(x, y, None, None) for x, y in within] + [(x, y, s, None) for s, x, y in calls] + [(x, y, None, s) for s, x, y in returns]
            if back:
                edges = [(y, x, pop, push) for x, y, push, pop in edges]
            seen, todo = set(), [(n, ()) for n in start]
            while todo:
                n, stack = state = todo.pop()
                if state in seen or len(stack) > 6:
                    continue
                seen.add(state)
                for x, y, push, pop in edges:
                    if x == n and push is not None:
                        todo.append((y, (*stack, push)))
                    elif x == n and pop is None:
                        todo.append((y, stack))
                    elif x == n and (not stack or stack[-1] == pop):
                        todo.append((y, stack[:-1]))
            return {n for n, _ in seen}

        frame = lambda rows, names: spark.createDataFrame(rows, names)
        tables = frame(within, "src string, dst string"), frame(calls, "site int, src string, dst string"), frame(returns, "site int, src string, dst string")
        start = frame([(s,) for s in seeds], "node string")
        assert {r.node for r in flows.matched_reach(*tables, start).collect()} == reached(seeds)
        assert {r.node for r in flows.matched_reach(*tables, start, backward=True).collect()} == reached(seeds, True)


def test_a_value_comes_back_to_its_own_caller_only(spark):
    from lumenspan.operators import flows

    within = spark.createDataFrame([("id.p", "id.r")], "src string, dst string")
    calls = spark.createDataFrame([(1, "f.x", "id.p"), (2, "g.y", "id.p")], "site int, src string, dst string")
    returns = spark.createDataFrame([(1, "id.r", "f.z"), (2, "id.r", "g.w")], "site int, src string, dst string")
    got = flows.matched_reach(within, calls, returns, spark.createDataFrame([("f.x",)], "node string"))
    assert {r.node for r in got.collect()} == {"f.x", "id.p", "id.r", "f.z"}
    assert {tuple(r) for r in flows.summaries(within, calls, returns).collect()} == {("f.x", "f.z"), ("g.y", "g.w")}


def test_a_line_too_long_is_an_error(spark):
    from lumenspan.sources import files as source

    fits = source.from_texts(spark, {"a.go": "x" * ((1 << 20) - 1) + "\ny"})
    assert [(r.line, len(r.text)) for r in source.lines(fits).orderBy("line").collect()] == [(1, (1 << 20) - 1), (2, 1)]
    with pytest.raises(Exception, match=r"line too long: b\.go:2"):
        source.lines(source.from_texts(spark, {"b.go": "x\n" + "y" * (1 << 20)})).collect()


def test_routes_with_hyphens_and_slashes_reach_their_callers(spark):
    from lumenspan.operators import program
    from lumenspan.sources import files as source

    go = 'package api\n\nfunc Routes(rb R) {\n\trb.AddRoute("get-order", deps.GetOrder)\n\trb.AddRoute("/orders/{id}", deps.One)\n\trb.AddRoute("listOrders", deps.List)\n}\n'
    handlers = "package api\n\nfunc (d D) GetOrder(c C) {}\n\nfunc (d D) One(c C) {}\n\nfunc (d D) List(c C) {}\n"
    ts = {"web/a.ts": "call('get-order'); call('get-orders')", "web/b.ts": "fetch(`v1/orders/{id}x`); listOrders()", "web/c.ts": "relistOrders(); fetch('/orders/{id}')"}
    files = source.from_texts(spark, {"api/routes.go": go, "api/handlers.go": handlers} | ts)
    services = spark.createDataFrame([("api", "api", "go"), ("web", "web", "ts")], "name string, root string, service_lang string")
    _, edges = program.file_graph(files, services, spark.createDataFrame([], "pkg string, root string"))
    got = {(r["from"], r.label) for r in edges.where("kind = 'api-call'").collect()}
    assert got == {("web::web/a.ts", "get-order"), ("web::web/b.ts", "/orders/{id}"), ("web::web/b.ts", "listOrders")}
