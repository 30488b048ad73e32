import json
import re

import pytest

from lumenspan.plans.lens import Config, Lens, Repo
from lumenspan.plans.lenses import REGISTRY, run

SHOP = {
    "src/main/java/shop/CheckoutController.java": """package shop;

/** calls nothing() in a comment { */
@RestController
@RequestMapping("/carts")
public class CheckoutController {

    private final CartRepository cartRepository;
    private AbstractBilling billing;

    @PostMapping("/buy")
    public String buy(@RequestBody Cart cart, String channel, BindingResult result) {
        if (result.hasErrors()) {
            return "invalid";
        }
        if (cart.isGift()) {
            cart.setLabel("gift { not a brace");
        } else {
            cart.setLabel("plain");
        }
        if (channel.equals("web")) {
            cart.setOrigin("web");
        }
        this.cartRepository.save(cart);
        billing.charge(cart);
        return "done";
    }

    @PostMapping("/later")
    public String later(Cart cart) {
        return store(cart);
    }

    private String store(Cart cart) {
        cartRepository.save(cart);
        return "stored";
    }
}
""",
    "src/main/java/shop/Cart.java": """package shop;

@Entity
@Table(name = "cart_rows")
public class Cart {
    private Long id;
    private String label;
    private String origin;

    public void setLabel(String label) { this.label = label; }
    public void setOrigin(String origin) { this.origin = origin; }
    public boolean isGift() { return false; }
}
""",
    "src/main/java/shop/CartRepository.java": """package shop;

public interface CartRepository extends JpaRepository<Cart, Long> {
    Cart findByLabel(String label);
}
""",
    "src/main/java/shop/CardBilling.java": """package shop;

public class CardBilling extends AbstractBilling {
    private Journal journal;

    @Override
    public void charge(Cart cart) {
        if (cart.isGift()) {
            return;
        }
        journal.append(cart);
    }
}
""",
    "src/main/java/shop/Journal.java": """package shop;

public class Journal {
    private CartRepository cartRepository;

    public void append(Cart cart) {
        for (int i = 0; i < 2; i++) {
            cartRepository.save(cart);
        }
    }
}
""",
    "src/main/resources/db/migration/V1__cart.sql": "CREATE TABLE IF NOT EXISTS public.\"cart_rows\" (\n  id bigint\n);\n",
    "queries/report.sql": "SELECT * FROM cart_rows c JOIN buyers b ON 1=1;\nINSERT INTO audit_log VALUES (1);\nSELECT 1 FROM cart_rows;\n",
    "build.gradle": 'group = "com.acme.shop"\nimplementation "com.acme.billing:billing-lib:1.0"\nimplementation "org.other:thing:2"\n',
}
BILLING = {
    "src/AbstractBilling.java": "package billing;\n\npublic abstract class AbstractBilling {\n    public abstract void charge(Cart cart);\n}\n",
    "build.gradle": "group 'com.acme.billing'\n",
}
STAGES = {
    "app/Main.java": """package app;

public class Main {
    static String label(int amount) {
        String out = new Tier().of(amount);
        if (amount > 1000) {
            out = "whale";
        }
        return out;
    }
}
""",
    "app/Tier.java": """package app;

public class Tier {
    String of(int amount) {
        String tier;
        if (amount >= 100) {
            tier = "gold";
        } else {
            tier = "base";
        }
        return tier;
    }
}
""",
}
GO = {
    "main.go": 'package main\n\ntype Store struct {\n\tn int\n}\n\nfunc main() {\n\tx := load("a")\n\tif x > 1 {\n\t\tsave(x)\n\t}\n\tload("b")\n}\n\nfunc load(s string) int {\n\treturn len(s)\n}\n\nfunc (s *Store) put(x int) {\n\tsave(x)\n}\n\nfunc save(x int) {\n\t// load(1)\n\tos.WriteFile("load(2)", nil, 0)\n}\n',
    "main_test.go": "package main\n\nfunc TestX() {\n\tmain()\n}\n",
}
JS = {
    "core.js": 'export function start(bus) {\n  bus.emit("state:changed", 1);\n  bus.on("state:changed", run);\n}\nexport class Core {}\nexport const VERSION = 1;\nfunction helper() {\n  return fetch("/x");\n}\nconst go = async (x) => {\n  helper();\n};\ncore.registerAction("jump", go);\n',
}


def tree(tmp_path, texts):
    for p, t in texts.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    return Config(root=str(tmp_path))


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    top = tmp_path_factory.mktemp("ws")
    tree(top / "shop", SHOP)
    tree(top / "billing", BILLING)
    return Config(root=str(top), projects={"all": [Repo("shop", "shop", "app"), Repo("billing", "billing", "library")]}, active_project="all")


def ask(spark, config, analyzer, root="shop", **params):
    return run(spark, config, Lens(analyzer, name="t", source_root=root, params=params))


def shown(p):
    return [x for piece in p.pieces for x in piece.lines]


def test_registry_is_whole():
    assert len(REGISTRY) == 29


def test_unknown_analyzer(spark, shop):
    with pytest.raises(ValueError, match="unknown analyzer"):
        ask(spark, shop, "nope")


def test_entrypoints(spark, shop):
    p = ask(spark, shop, "entrypoints", patterns="mapping=@(Post|Request)Mapping;rest=@RestController")
    assert [x.split()[0] for x in shown(p)] == ["@RestController", '@RequestMapping("/carts")', '@PostMapping("/buy")', '@PostMapping("/later")']
    assert shown(p)[0][140:] == "CheckoutController.java:4"
    again = ask(spark, shop, "entrypoints", patterns="@RestController", line_format="{label}|{line}|{code}")
    assert shown(again) == ["@RestController|4|@RestController"]


def test_exitpoints(spark, shop):
    assert [x.split("  ")[0] for x in shown(ask(spark, shop, "exitpoints", sinks="*repository*.save"))] == ["this.cartRepository.save(cart);", "cartRepository.save(cart);", "cartRepository.save(cart);"]


@pytest.mark.parametrize(("analyzer", "params", "n"), [("references", {"name": "Journal"}, 2), ("callers", {"name": "append"}, 2), ("constructions", {"type": "Tier"}, 0), ("writes-to", {"var": "label"}, 3)])
def test_queries(spark, shop, analyzer, params, n):
    p = ask(spark, shop, analyzer, **params)
    assert p.fact("count") == f"{n} matches"
    assert p.fact("confidence").startswith("lexical")


def test_sql_tables(spark, shop):
    p = ask(spark, shop, "sql-tables", file="report.sql")
    assert [f.text for f in p.facts if f.id.startswith("table-")] == ["audit_log: 1 refs", "buyers: 1 refs", "cart_rows: 2 refs"]


def test_side_effects(spark, shop, tmp_path):
    p = ask(spark, shop, "side-effects", markers="audit=journal")
    assert p.fact("count-db") == "db: 3"
    assert p.fact("count-audit") == "audit: 2"
    js = run(spark, tree(tmp_path, JS), Lens("side-effects"))
    assert js.fact("count-network") == "network: 1"


def test_call_graph(spark, tmp_path):
    config = tree(tmp_path, GO)
    p = run(spark, config, Lens("call-graph-callers", params={"name": "load"}))
    assert p.fact("count") == "2 call sites from 1 distinct functions"
    assert "no function named" in shown(run(spark, config, Lens("call-graph-callers", params={"name": "zzz"})))[0]
    impact = run(spark, config, Lens("impact-set", params={"name": "save"}))
    assert impact.fact("blast") == "3 functions transitively reach save (max depth 2)"
    with pytest.raises(ValueError, match="no function named"):
        run(spark, config, Lens("impact-set", params={"name": "zzz"}))


def test_go_symbols(spark, tmp_path):
    p = run(spark, tree(tmp_path, GO), Lens("go-symbols"))
    by = {x.id: x.lines for x in p.pieces}
    assert by["types"] == ["struct Store lines=3-5 :: type Store struct"]
    assert by["functions"][0] == "func main() lines=7-13 calls=load,save"
    assert by["main-callgraph"] == ["-> main", "  -> load", "  -> save"]


def test_control_flow(spark, shop):
    p = ask(spark, shop, "control-flow", file="src/main/java/shop/CheckoutController.java", line="24")
    assert len(p.extra) == 4
    first = next(iter(p.extra.values())).pieces[0].lines
    assert [x.split("  ")[0] for x in first] == ["public String buy(@RequestBody Cart cart, String channel, BindingResult result) {", "!(result.hasErrors())", "cart.isGift()", 'channel.equals("web")', "this.cartRepository.save(cart);"]


def test_data_flow(spark, shop):
    p = ask(spark, shop, "data-flow", file="src/main/java/shop/CheckoutController.java", line="24", var="cart")
    assert "// <- mutates cart" in shown(p)[4] or any("// <- mutates cart" in x for x in shown(p))
    assert shown(p)[0].endswith("// <- source: parameter feeding cart")
    assert shown(p)[-1].endswith("// <- final use of cart")
    assert "mutation: cart.setLabel" in p.pieces[0].facts
    q = ask(spark, shop, "joern-var-flow", file="src/main/java/shop/CheckoutController.java", method="buy", var="cart")
    assert shown(q)[1].startswith("// enclosing method buy")


def test_flow(spark, shop):
    p = ask(spark, shop, "flow", entry="@PostMapping", sink=r"\.save\(")
    assert [x.id for x in p.pieces] == ["CheckoutController.buy", "CheckoutController.later"]
    assert "helper: later calls store, which reaches the sink" in p.pieces[1].facts


def test_unroll(spark, tmp_path):
    config = tree(tmp_path, STAGES)
    p = run(spark, config, Lens("unrolled-program", params={"file": "app/Main.java", "method": "label", "inputs": "amount=50"}))
    text = "\n".join(shown(p))
    assert "base" in text and "gold" not in text and "whale" not in text
    line = next(k for k, x in enumerate(shown(p)) if "base" in x)
    assert p.pieces[0].origins[line].file == "app/Tier.java"
    assert p.pieces[0].guards[line] == ["!(amount >= 100)"]
    flat = run(spark, config, Lens("unrolled-program", params={"file": "app/Main.java", "method": "label", "inputs": "amount=50", "inline_depth": "0"}))
    assert "new Tier().of(amount)" in "\n".join(shown(flat))
    chosen = run(spark, config, Lens("unrolled-program", params={"file": "app/Main.java", "method": "label", "branch_select": "1", "branches": "app/Tier.java:6=else"}))
    assert "base" in "\n".join(shown(chosen)) and "gold" not in "\n".join(shown(chosen))
    assert json.loads(chosen.fact("choice-1"))["sides"] == ["then", "else"]


def test_unroll_go(spark, tmp_path):
    p = run(spark, tree(tmp_path, GO), Lens("unrolled-program", params={"file": "main.go", "method": "main"}))
    assert any("os.WriteFile" in x for x in shown(p))
    assert p.fact("se-summary") == "io-write=1"


def test_trace_across_repositories(spark, shop):
    p = ask(spark, shop, "trace-to-line", symbol="Journal.append")
    lines = [x for e in p.extra.values() for piece in e.pieces for x in piece.lines]
    assert any("DI: AbstractBilling.charge is abstract → dispatched to CardBilling.charge" in x for x in lines)
    assert "    assume: !(cart.isGift())" in lines
    assert any(x.startswith("    loop: for(int i = 0") for x in lines)
    assert p.fact("confidence").startswith("structural (di)")


def test_trace_to_table(spark, shop):
    p = ask(spark, shop, "trace-to-line", symbol="cart_rows")
    text = "\n".join(shown(p))
    assert "entity Cart · mapping: @Table(name)" in text
    assert "migration: src/main/resources/db/migration/V1__cart.sql (shop)" in text
    assert "Journal.append" in text and "CheckoutController.buy → writes cart_rows" in text


def test_service_graph_of_types(spark, shop):
    g = json.loads(ask(spark, shop, "service-graph").fact("graph"))
    edges = {(e["from"], e["to"], e["kind"]): e for e in g["edges"]}
    assert edges["shop::CheckoutController", "shop::CardBilling", "api-call"]["label"] == "DI→CardBilling"
    assert ("shop::CartRepository", "table::cart_rows", "writes-to") in edges
    node = {n["id"]: n for n in g["nodes"]}["shop::CheckoutController"]
    assert node["kind"] == "entrypoint" and node["op"] == "CheckoutController.buy, CheckoutController.later"


def test_service_graph_of_files(spark, tmp_path):
    config = tree(tmp_path, {
        "api/routes.go": 'package api\n\nfunc Routes(rb R) {\n\trb.AddRoute("getCart", deps.GetCart)\n}\n',
        "api/cart.go": "package api\n\nfunc (d *Deps) GetCart(w W) {\n\tdb.Query(1)\n}\n",
        "web/src/page.ts": 'import { call } from "./client";\nimport { x } from "@acme/shared";\ncall("getCart");\n',
        "web/src/client.ts": "export const call = (x) => fetch(x);\n",
        "shared/index.ts": "export const x = 1;\n",
    })
    services = json.dumps([{"name": "api", "root": "api", "lang": "go"}, {"name": "web", "root": "web", "lang": "ts"}, {"name": "shared", "root": "shared", "lang": "ts"}])
    g = json.loads(run(spark, config, Lens("service-graph", params={"services": services, "packages": '{"@acme/shared":"shared"}'})).fact("graph"))
    edges = {(e["from"], e["to"], e["kind"]) for e in g["edges"]}
    assert edges == {("web::web/src/page.ts", "web::web/src/client.ts", "import"), ("web::web/src/page.ts", "shared::shared/index.ts", "import"), ("api::api/routes.go", "api::api/cart.go", "registers"), ("web::web/src/page.ts", "api::api/cart.go", "api-call")}
    assert {n["id"]: n.get("effects") for n in g["nodes"]}["web::web/src/client.ts"] == ["network"]


def test_entry_to_exit(spark, shop):
    p = ask(spark, shop, "entry-to-exit", entry="@PostMapping", exit=r"\.save\(")
    assert p.fact("count") == "3 flows"
    assert any("CheckoutController.buy → Journal.append (2 steps)" in x for x in shown(p))


def test_object_flow(spark, tmp_path):
    config = tree(tmp_path, {"Cart.java": SHOP["src/main/java/shop/Cart.java"], "Maker.java": "class Maker {\n  Cart make(boolean b) {\n    Cart c = new Cart();\n    c.setLabel(\"a\");\n    if (b) {\n      c.setLabel(\"b\");\n    }\n    return c;\n  }\n}\n"})
    p = run(spark, config, Lens("object-flow", params={"type": "Cart"}))
    facts = {f.id: f.text for f in p.facts}
    assert facts["Maker.make.c.label"] == "set 2 times: MORE THAN ONCE"
    assert facts["Maker.make.c.origin"] == "NEVER set"
    assert "// if b" in shown(p)[1]
    (tmp_path / "Stage.java").write_text("class Stage {\n  void apply(int n, Cart target) {\n    target.setOrigin(\"s\");\n  }\n}\n")
    (tmp_path / "Flow.java").write_text("class Flow {\n  void go() {\n    Cart c = new Cart();\n    new Stage().apply(1, c);\n  }\n}\n")
    q = run(spark, config, Lens("object-flow", params={"type": "Cart"}))
    facts = {f.id: f.text for f in q.facts}
    assert facts["Flow.go.c.label"] == "NEVER set" and "Flow.go.c.origin" not in facts
    assert any("through new Stage().apply(1, c);" in x and x.endswith("Stage.java:3") for x in shown(q))


def test_cpg_methods_and_structure(spark, shop):
    assert any("Journal.append lines=6-10 calls=save" in x for x in shown(ask(spark, shop, "cpg-methods", file="Journal.java")))
    assert len(shown(ask(spark, shop, "ast-grep", pattern="$A.save($B)", lang="java"))) == 3


def test_structural_names_agree_and_brackets_nest(spark, tmp_path):
    go = "package a\n\nfunc F() {\n\tif (x == x) {}\n\tif (x == y) {}\n\tif (f(1) == f(1)) {}\n\tset(a, a, b)\n\tset(a, b, b)\n\tput(f(g(h(i(j(k[l[1]]))))), 2)\n\tput(1, 2)\n}\n"
    config = tree(tmp_path, {"a.go": go})
    at = lambda pattern: sorted(int(x.rpartition(":")[2]) for x in shown(run(spark, config, Lens("ast-grep", params={"pattern": pattern, "lang": "go"}))) if ":" in x)
    assert at("if ($A == $A)") == [4, 6]
    assert at("if ($A == $B)") == [4, 5, 6]
    assert at("if ($_ == $_)") == [4, 5, 6]
    assert at("set($A, $A, $B)") == [7] and at("set($A, $B, $B)") == [8]
    assert at("put($A, 2)") == [9, 10] and at("put(f($$$), 2)") == [9]


def test_js_events(spark, tmp_path):
    by = {x.id: x for x in run(spark, tree(tmp_path, JS), Lens("js-events")).pieces}
    assert 'emit state:changed line=2 :: bus.emit("state:changed", 1);' in by["events"].lines
    assert any(x.startswith("registerAction jump line=13") for x in by["registrations"].lines)
    assert by["summary"].lines[:4] == ["files scanned: 1", "event emits/dispatches: 1", "event listeners/subscriptions: 1", "registrations: 1"]
    assert any(x.startswith("export value VERSION") for x in by["surface"].lines)


def test_jsonl(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"kind":"block","id":"b","file":"f","mode":"m","lines":["x"]}\n\n{"kind":"fact","id":"z","text":"t"}\n')
    p = run(spark, Config(root=str(tmp_path)), Lens("jsonl", input="t.jsonl"))
    assert "@@ f#b [jsonl.m hash=" in p.body() and "=> jsonl.z: t" in p.body()
    (tmp_path / "bad.jsonl").write_text('{"kind":"what"}\n')
    with pytest.raises(ValueError, match="unknown kind"):
        run(spark, Config(root=str(tmp_path)), Lens("jsonl", input="bad.jsonl"))


def test_git_blame(spark, tmp_path):
    import subprocess

    (tmp_path / "a.txt").write_text("one\ntwo\n")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init")
    git("add", ".")
    git("commit", "-m", "x")
    (tmp_path / "a.txt").write_text("one\nTWO\nthree\n")
    subprocess.run(["git", "-c", "user.name=Bob", "-c", "user.email=b@b", "commit", "-am", "y"], cwd=tmp_path, check=True, capture_output=True)
    p = run(spark, Config(root=str(tmp_path)), Lens("git-blame", params={"file": "a.txt"}))
    assert {f.id: f.text for f in p.facts if f.id.startswith("author")} == {"author-Ann": "Ann: 1 lines", "author-Bob": "Bob: 2 lines"}
    assert re.search(r"TWO +[0-9a-f]{8} \d{4}-\d\d-\d\d Bob:2$", shown(p)[1])


def test_watch_lens(spark, tmp_path):
    write = lambda n: spark.range(1, n + 1).selectExpr("id", "'a,b' AS kind", "if(id = 2, null, id * 10) AS amount").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "db/events.parquet"))
    lens = Lens("postgres-watch", name="w", params={"connections": json.dumps({"dev": str(tmp_path / "db")}), "tables": "events"})
    config = Config(root=str(tmp_path))
    write(1)
    assert shown(run(spark, config, lens)) == ["seen_at,env,db,table"]
    write(3)
    p = run(spark, config, lens)
    assert p.fact("dev.default.events") == "new_rows=2 last_id=3 window=10m"
    assert [x.split(",", 4)[4] for x in shown(p)] == ["id,kind,amount", '2,"a,b",', '3,"a,b",30']
    assert run(spark, config, lens).fact("dev.default.events").startswith("new_rows=0")


def test_watch_lens_by_stream(spark, tmp_path):
    import sqlite3

    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("create table events (id integer primary key, kind text)")
    con.execute("insert into events values (1, 'a,b')")
    con.commit()
    params = {"connections": json.dumps({"dev": f"dbapi:sqlite3:{tmp_path}/x.db"}), "tables": "events", "checkpoint": str(tmp_path / "cp"), "grace": "5", "buckets": "2"}
    lens, config = Lens("postgres-watch", name="w", params=params), Config(root=str(tmp_path))
    assert run(spark, config, lens).fact("dev.default.events").startswith("new_rows=0")
    con.execute("insert into events values (2, 'a,b'), (4, null)")
    con.commit()
    p = run(spark, config, lens)
    assert p.fact("dev.default.events") == "new_rows=2 last_id=4 window=10m"
    assert [x.split(",", 4)[4] for x in shown(p)] == ["id,kind", '2,"a,b"', "4,"]
    con.execute("insert into events values (3, 'late')")
    con.commit()
    p = run(spark, config, lens)
    assert p.fact("dev.default.events") == "new_rows=1 last_id=4 window=10m" and len(shown(p)) == 4


FLOW = {
    "src/A.java": """class A {
    private B b;
    void go(int seed) {
        int start = seed + 1;
        Parcel parcel = new Parcel();
        b.pack(parcel, start);
    }
}
""",
    "src/B.java": """class B {
    private C c;
    void pack(Parcel box, int weight) {
        int total = weight * 2;
        c.seal(box, total);
        box.setWeight(total);
    }
}
""",
    "src/C.java": """class C {
    void seal(Parcel thing, int grams) {
        int half = part(grams);
        thing.setGrams(half);
        seal(thing, half);
        finish(thing);
    }
    int part(int whole) {
        int result = whole / 2;
        return result;
    }
    void finish(Parcel last) {
        last.setDone(1);
    }
}
""",
    "src/Parcel.java": "class Parcel {\n    private int weight;\n    private int grams;\n    private int done;\n    private int never;\n}\n",
}


def test_variables_are_followed_over_methods(spark, tmp_path):
    config = tree(tmp_path, FLOW)
    p = run(spark, config, Lens("joern-var-flow", params={"file": "src/C.java", "line": "4", "var": "half"}))
    heads = [x.lines[0] for x in p.pieces[1:]]
    assert heads[0].startswith("// ") and any("return of part: result" in h for h in heads)
    assert any("argument grams of seal: total at src/B.java:5" in h for h in heads)
    assert any("argument weight of pack: start at src/A.java:6" in h for h in heads)
    assert any("int start = seed + 1;" in x for x in shown(p))


def test_objects_are_followed_through_any_number_of_calls(spark, tmp_path):
    p = run(spark, tree(tmp_path, FLOW), Lens("object-flow", params={"type": "Parcel"}))
    facts = {f.id: f.text for f in p.facts}
    assert facts["A.go.parcel.never"] == "NEVER set" and "A.go.parcel.done" not in facts and "A.go.parcel.grams" not in facts
    assert sum("setDone" in x for x in shown(p)) == 1 and sum("setGrams" in x for x in shown(p)) == 1


def test_structures_over_several_lines(spark, tmp_path):
    config = tree(tmp_path, {"a.go": "package a\n\nfunc f() {\n\tsave(\n\t\tx,\n\t\ty(1))\n\tsave(z, w)\n}\n", "b.go": "package a\n\nfunc g() { load(1) }\n"})
    p = run(spark, config, Lens("ast-grep", params={"pattern": "save( $A, $B )", "lang": "go"}))
    assert len(shown(p)) == 2
    assert any("save( x, y(1))" in x and x.endswith("a.go:4") for x in shown(p)) and any(x.endswith("a.go:7") for x in shown(p))


def test_paths_to_a_line_with_many_ways(spark, tmp_path):
    """Eight layers of four classes, each calling all of the next: 4 ** 8 ways from the entry, of which eight are told."""
    layers = 8
    texts = {"src/Top.java": "class Top {\n" + "".join(f"    private L0x{j} f{j};\n" for j in range(4)) + '    @PostMapping("/x")\n    void start() {\n' + "".join(f"        f{j}.step();\n" for j in range(4)) + "    }\n}\n"}
    for i in range(layers):
        for j in range(4):
            fields = "".join(f"    private L{i + 1}x{k} f{k};\n" for k in range(4 if i < layers - 1 else 1))
            calls = "".join(f"        f{k}.step();\n" for k in range(4 if i < layers - 1 else 1))
            texts[f"src/L{i}x{j}.java"] = f"class L{i}x{j} {{\n{fields}    void step() {{\n{calls}    }}\n}}\n"
    texts[f"src/L{layers}x0.java"] = f"class L{layers}x0 {{\n    void step() {{\n        int x = 1;\n    }}\n}}\n"
    config = tree(tmp_path, texts)
    p = run(spark, config, Lens("trace-to-line", params={"symbol": f"L{layers}x0.step", "repos": json.dumps([{"name": "r", "path": "src"}])}))
    assert len(p.extra) == 8
