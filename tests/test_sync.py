import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenspan.plans import report, specs, sync, workspace
from lumenspan.plans.lens import Config, Fact, Lens, Piece, Projection, Repo, located, noted, row
from lumenspan.plans.lenses import REGISTRY, bookmark_of, run

CODE = "class A {\n  int one() {\n    return 1;\n  }\n  int two() {\n    return 2;\n  }\n}\n"


@pytest.fixture
def config(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "projections").mkdir()
    (tmp_path / "src/A.java").write_text(CODE)
    return Config(root=str(tmp_path), projections_dir="projections")


def marked(config, a, b, name="b"):
    to = f"{config.root}/projections/{name}.projection"
    text = (open(f"{config.root}/src/A.java").read()).split("\n")[:-1]
    bookmark_of(text, "src", "A.java", a, b).finish(Lens("bookmark", name)).write(to)
    return to


def change(path, old, new):
    text = open(path).read()
    assert old in text
    open(path, "w").write(text.replace(old, new))


def test_edit_goes_to_the_source_once(config):
    to = marked(config, 2, 4)
    change(to, "return 1;", "return 10;")
    assert (r := sync.sync(config, to)).to_source == 1 and not r.conflicts
    assert "return 10;" in open(f"{config.root}/src/A.java").read()
    assert (r := sync.sync(config, to)) == sync.Result()
    assert open(to).read().count("@@ ") == 1


def test_block_may_grow(config):
    to = marked(config, 2, 4)
    change(to, "    return 1;\n", "    int x = 1;\n    return x;\n")
    assert sync.sync(config, to).to_source == 1
    assert "A.java:2-5" in open(to).read()
    assert sync.sync(config, to) == sync.Result()


def test_growing_blocks_do_not_move_each_other(config):
    text = open(f"{config.root}/src/A.java").read().split("\n")[:-1]
    to = f"{config.root}/projections/two.projection"
    p = bookmark_of(text, "src", "A.java", 2, 4)
    p.pieces += bookmark_of(text, "src", "A.java", 5, 7).pieces
    p.finish(Lens("bookmark", "two")).write(to)
    change(to, "    return 1;\n", "    int x = 1;\n    return x;\n")
    change(to, "    return 2;\n", "    int y = 2;\n    return y;\n")
    assert sync.sync(config, to).to_source == 2
    got = open(f"{config.root}/src/A.java").read()
    assert got == CODE.replace("    return 1;\n", "    int x = 1;\n    return x;\n").replace("    return 2;\n", "    int y = 2;\n    return y;\n")
    assert "A.java:6-9" in open(to).read()
    assert sync.sync(config, to) == sync.Result()


def test_conflict_leaves_both(config):
    to = marked(config, 2, 4)
    change(to, "return 1;", "return 10;")
    change(f"{config.root}/src/A.java", "return 1;", "return 11;")
    assert len(sync.sync(config, to).conflicts) == 1
    assert "return 11;" in open(f"{config.root}/src/A.java").read() and "return 10;" in open(to).read()


def test_source_change_refreshes(config):
    to = marked(config, 2, 4)
    change(f"{config.root}/src/A.java", "return 1;", "return 11;")
    assert sync.sync(config, to).to_projection == 1
    assert "return 11;" in open(to).read()


def test_header_points_elsewhere(config):
    to = marked(config, 2, 4)
    change(to, "#A.java:2-4", "#A.java:5-7")
    assert sync.sync(config, to).to_projection == 1
    assert "return 2;" in open(to).read()


def test_drop_in(config):
    to = f"{config.root}/projections/d.projection"
    open(to, "w").write("src/A.java:4-2\n")
    assert [str(x) for x in sync.expand_drop_ins(config)] == [to]
    assert "A.java:2-4" in open(to).read()
    assert sync.expand_drop_ins(config) == []
    for bad in ("../x.java", "/etc/passwd"):
        with pytest.raises(ValueError):
            sync.resolve(config, bad)


def test_scattered_lines(spark, config):
    (open(f"{config.root}/src/B.java", "w")).write("class B {\n  int three() {\n    int r = new A().one();\n    return r;\n  }\n}\n")
    p = run(spark, config, Lens("unrolled-program", source_root="src", params={"file": "B.java", "method": "three"}))
    to = f"{config.root}/projections/u.projection"
    p.write(to)
    assert "int r = new A().one();" not in p.body()
    n = next(k for k, x in enumerate(p.pieces[0].lines, 1) if "1" in x)
    with pytest.raises(ValueError, match="edited twice"):
        sync.edit_lines(config, marked_twice(config, p), {1: "a", 2: "b"})
    before = open(f"{config.root}/src/B.java").read()
    assert before == open(f"{config.root}/src/B.java").read() and n


def marked_twice(config, p):
    to = f"{config.root}/projections/twice.projection"
    q = Projection(pieces=[Piece("x", "f", "unrolled", "t", [p.pieces[0].lines[0]] * 2, origins=[p.pieces[0].origins[0]] * 2, sync="two-way")])
    q.finish(Lens("unrolled-program", "twice")).write(to)
    return to


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="ascii", exclude_characters="\r\n"), max_size=20), min_size=1, max_size=8), st.data())
def test_read_back_and_sync_settle(tmp_path_factory, lines, data):
    lines = [x for x in lines if x != "@@"] or ["x"]
    top = tmp_path_factory.mktemp("s")
    (top / "f.txt").write_text("\n".join(lines) + "\n")
    config = Config(root=str(top))
    a = data.draw(st.integers(1, len(lines)))
    b = data.draw(st.integers(a, len(lines)))
    to = top / "p.projection"
    bookmark_of(lines, "", "f.txt", a, b).finish(Lens("bookmark", "p")).write(to)
    got = sync.parse(to.read_text()).pieces[0]
    assert got.lines == lines[a - 1 : b] and got.src[:3] == ("f.txt", a, b)
    assert sync.sync(config, to) == sync.Result()
    assert (top / "f.txt").read_text() == "\n".join(lines) + "\n"


def test_text_form():
    p = Projection(pieces=[Piece("b", "z.java", "m", "t", ["x"], ["f"]), Piece("a", "a.java", "m", "t", ["y"])], facts=[Fact("branch-2", "2", "t"), Fact("branch-10", "10", "t"), Fact("n", "none")])
    body = p.finish(Lens("references", "r")).body()
    assert body.index("a.java#a") < body.index("z.java#b") and body.index("branch-10") < body.index("branch-2")
    assert "=> b: f\n" in body and "=> n: none\n" in body and "@@ a.java#a [t.m hash=" in body
    assert p.body() == body and "# lens: r" in p.render()
    assert located("é", "a/b.java", 7) == "é" + " " * 138 + "b.java:7"
    assert located("x" * 150, "b", 1) == "x" * 150 + "  b:1"
    assert noted("\tx", "n") == "\tx" + " " * 51 + "// n"
    assert row("{label}:{line}", "f", 3, "L", "c") == "L:3"


def test_specs_and_questions():
    assert specs.SPECS.keys() == REGISTRY.keys()
    for q in specs.QUESTIONS:
        assert q.analyzer in REGISTRY
        assert set(q.blanks) == {x.strip("{}") for x in __import__("re").findall(r"\{\w+\}", q.template)}
    lens, level = specs.compile_question("ways-to-save", "src", sink="*.save")
    assert lens.params == {"sinks": "*.save"} and level == "lexical"
    assert specs.compile_question("who-changed", file="a")[0].params == {"file": "a"}
    with pytest.raises(KeyError):
        specs.compile_question("nope")
    assert specs.check_params(Lens("references")) == ["name"]


def test_ask(spark, config):
    got = specs.ask(spark, config, "where-defined", "src", name="two")
    assert got["confidence"] == "lexical" and "int two() {" in got["body"]


def test_config_round_trip(tmp_path):
    c = Config(root=str(tmp_path), projects={"p": [Repo("a", "a"), Repo("lib", "lib", "library")]}, active_project="p", lenses=[Lens("references", "x", params={"name": "n"})])
    c.save(tmp_path / "config.json")
    d = Config.load(tmp_path / "config.json")
    assert d == c and [r.name for r in d.repos(include_libraries=False)] == ["a"]
    (tmp_path / "raw.json").write_text(json.dumps({"lenses": [{"name": "g", "analyzer": "service-graph", "params": {"services": [{"name": "a"}]}}]}))
    assert Config.load(tmp_path / "raw.json").lenses[0].params["services"] == '[{"name":"a"}]'


def test_report():
    g = {"services": [], "nodes": [{"id": "a", "label": "A<", "service": "s", "effects": ["db"]}, {"id": "b", "label": "B", "service": "t"}, {"id": "c", "label": "C", "service": "t"}], "edges": [{"from": "a", "to": "b", "cross": True, "label": "x"}, {"from": "b", "to": "c"}]}
    p = Projection(pieces=[Piece("service-graph", "", "graph", "service-graph", ["head"])], facts=[Fact("graph", json.dumps(g))])
    assert [n["id"] for n in report.effect_subgraph(g)["nodes"]] == ["a", "b"]
    page = report.page(p, "# Title\n- one\n- `two`\n\n**b**")
    assert "A&lt;" in page and "<li>db: 1</li>" in page and '<h1 id="title">Title</h1>' in page and "http" not in page.replace("http://www.w3.org/2000/svg", "")
    assert "n0 -.->|x| n1" in report.mermaid(g)


def test_workspace(spark, tmp_path):
    for name, text in (("shop", 'group = "com.acme.shop"\nimplementation "com.acme.billing:lib:1"\nimplementation "com.other:x:1"\nimplementation project(":tools")\n'), ("billing", "group 'com.acme.billing'\n"), ("tools", "group 'org.tools.x'\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "build.gradle").write_text(text)
    c = Config(root=str(tmp_path))
    for n in ("shop", "billing", "tools"):
        workspace.add(c, "all", n)
    got = {tuple(r) for r in workspace.dependencies(spark, c).collect()}
    assert got == {("shop", "billing"), ("shop", "tools"), ("billing", "shop")} - {("billing", "shop")}
    assert workspace.normal_url("acme/shop") == "https://github.com/acme/shop.git"
    workspace.remove(c, "all", "tools")
    assert [r.name for r in c.repos("all")] == ["shop", "billing"]
