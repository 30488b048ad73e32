from lumenspan.plans import views
from lumenspan.plans.lens import Config, Lens
from lumenspan.plans.lenses import run
from lumenspan.sources import files as source

CODE = {"A.java": "class A {\n  int total;\n  int sum(int n) {\n    int x = 1;\n    if (n > 2) {\n      x = x + n;\n    }\n    for (int i = 0; i < n; i++) {\n      x += i;\n    }\n    return x;\n  }\n}\n"}


def program(spark, tmp_path, **params):
    (tmp_path / "A.java").write_text(CODE["A.java"])
    return run(spark, Config(root=str(tmp_path)), Lens("unrolled-program", params={"file": "A.java", "method": "sum", **params}))


def test_program_lines_and_timeline(spark, tmp_path):
    p = program(spark, tmp_path)
    lines = views.program_lines(p)
    assert [x["tag"] for x in lines] == ["", "guard", "", "loop", "", "exit"]
    assert lines[2]["guards"] == ["n > 2"] and lines[1]["branch"] and lines[0]["origin"] == "A.java:4"
    assert [(x["n"], x["k"], x["of"]) for x in views.write_timeline(lines) if x["var"] == "x"] == [(1, 1, 3), (3, 2, 3), (5, 3, 3)]
    told = views.assumptions(p, 5)
    assert told["identifiers"]["x"] == "write 2 of 3 at line 3" and told["guards"] == ["for(int i = 0; i < n; i++)"]
    assert views.choices(program(spark, tmp_path, branch_select="1"))[0]["cond"] == "n > 2"


def test_writes():
    assert views.writes('a = b; c.put(1); d == e; "f = 1"; g++; h += 2; i.size()') == ["a", "c", "g", "h"]


def test_suggestions(spark):
    texts = {**CODE, "x/main.go": "package m\n\nfunc main() {\n}\n", "y/h.go": "package m\n\nfunc HandleIt() {\n}\n"}
    made = source.parsed(source.from_texts(spark, texts))
    assert views.suggest_entry(source.explode(made, "functions")).first()["name"] == "main"
    assert views.variables(made, "A.java") == []
    assert [x.analyzer for x in views.starting_lenses("go", "src")] == ["entrypoints", "exitpoints", "side-effects"]


def test_graph_filter():
    g = {"nodes": [{"id": "a", "label": "Alpha", "effects": ["db"]}, {"id": "b", "label": "Beta"}, {"id": "c", "label": "Gamma"}], "edges": [{"from": "a", "to": "b", "cross": True}, {"from": "b", "to": "c"}]}
    ids = lambda **kw: [n["id"] for n in views.filter_graph(g, **kw)["nodes"]]
    assert ids() == ["a", "b", "c"] and ids(text="alp") == ["a", "b"] and ids(cross_only=True) == ["a", "b"] and ids(effects=["db"]) == ["a"]


def test_export(spark, tmp_path):
    views.export_edges(spark.createDataFrame([("1", "2", "CALL"), ("1", "3", "OTHER")], "src string, dst string, kind string"), "kind", str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == [("1", "2", "CALL")]


def test_bands():
    code = ["int total = 0;", "for (int i = 0; i < n; i++) {", "    if (i == 3) {", "        continue;", "    }", "    total += i;", "    box.setTotal(total);", "}", "if (total > 3) {", "    total = 3;", "}", "try {", "    go();", "} catch (Exception e) {", "    total = -1;", "}"]
    tag = lambda c: next((n for n, rx in views._TAGS if rx.search(c)), "")
    got = views.bands([{"n": k, "code": c, "tag": tag(c)} for k, c in enumerate(code, 1)])
    assert [(b["kind"], b["from"], b["to"]) for b in got] == [("loop", 2, 7), ("guard", 3, 4), ("catch", 14, 15)]
    assert got[0]["writes"] == {"total": 1, "box": 1} and got[2]["writes"] == {"total": 1}
