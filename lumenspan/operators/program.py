"""Programs as relations: call graphs, dispatch across type hierarchies, database models, service graphs.

Input are the tables that sources.files makes of source trees; every operator is joins and aggregates over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.languages import CALL_KEYWORDS, JAVA_MARKERS, READ_VERBS, REPOSITORY_BASES, SPRING_ENTRY, WRITE_VERBS
from lumenspan.functions.regex import to_java
from lumenspan.sources.files import explode

from . import graph, relate, search
from .store import stored

# What names a table in a migration, an annotation and an import.
CREATE_TABLE = r"""(?i)\b(?:create|alter)\s+table\s+(?:if\s+not\s+exists\s+)?["`]?([A-Za-z_][A-Za-z0-9_."`]*)"""
TABLE_NAME = r"""@Table\s*\(\s*(?:[A-Za-z]+\s*=\s*[^,)]+,\s*)*name\s*=\s*"([^"]+)\""""
TS_IMPORT = r"""(?m)(?:import|export)\s[^'"]*from\s*["']([^"']+)["']|import\s*["']([^"']+)["']|import\(\s*["']([^"']+)["']\s*\)"""
GO_ROUTE = r"""AddRoute\(\s*["']([^"']+)["']\s*,\s*(?:deps\.)?([A-Za-z_][A-Za-z0-9_]*)"""
GO_RECEIVER = r"^\s*func\s*\([^)]*\)\s*([A-Za-z_][A-Za-z0-9_]*)\s*\("


def call_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions, edges) of parsed files: functions (repo, path, name, start, end), edges (caller, callee, path, line).

    A call counts inside a known function's body if it names a function declared in the same tree; a function's calls of its
    own name are no edges, and several calls of a name on a line are one."""
    funcs = explode(parsed, "functions").select("repo", "path", "name", "start", "end")
    tokens = explode(parsed, "calls").select("path", "line", "callee")
    return funcs, search.call_edges(tokens, funcs.select("path", "name", "start", "end"), funcs.select("name"), CALL_KEYWORDS)


def ambiguous(funcs: DataFrame) -> DataFrame:
    """Names declared more than once."""
    return funcs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def caller_counts(edges: DataFrame) -> DataFrame:
    """(callee, sites, callers): call sites of each callee, and the distinct functions they are in."""
    return edges.groupBy("callee").agg(F.count(F.lit(1)).alias("sites"), F.count_distinct("caller").alias("callers"))


def calls_of(parsed: DataFrame) -> DataFrame:
    """(path, name, owner, start, end, calls): functions with the distinct names they call, sorted."""
    funcs = explode(parsed, "functions").select("path", "name", "owner", "start", "end")
    calls = explode(parsed, "calls").select("path", "line", "callee").where(~F.col("callee").isin(*CALL_KEYWORDS))
    inside = relate.span_join(calls, funcs, ["path"], "line").where(F.col("callee") != F.col("name"))
    names = inside.groupBy("path", "name", "start").agg(F.array_join(F.array_sort(F.collect_set("callee")), ", ").alias("calls"))
    return funcs.join(names, ["path", "name", "start"], "left").withColumn("calls", F.coalesce("calls", F.lit("")))


def methods(parsed: DataFrame) -> DataFrame:
    """(repo, path, type, name, start, end, sig, entry, key) of Java methods; entry is the annotation that makes one an entrypoint."""
    m = explode(parsed.where("lang = 'java'"), "functions")
    entry = F.element_at(F.filter(F.transform("annotations", lambda a: F.regexp_extract(a, to_java(SPRING_ENTRY), 1)), lambda a: a != ""), 1)
    entry = F.when(F.exists("annotations", lambda a: a.rlike(to_java(SPRING_ENTRY))), F.concat(F.lit("@"), entry))
    key = F.concat(F.col("repo"), F.lit("::"), F.col("owner"), F.lit("."), F.col("name"), F.lit("#"), F.col("start").cast("string"))
    return m.where("owner <> ''").select("repo", "path", F.col("owner").alias("type"), "name", "start", "end", "sig", entry.alias("entry"), key.alias("key"))


def types(parsed: DataFrame) -> DataFrame:
    return explode(parsed.where("lang = 'java'"), "types")


def inherits(types_: DataFrame) -> DataFrame:
    """(src, dst): from a type's name to those of its direct subtypes."""
    ups = F.concat(F.when(F.col("extends") != "", F.array("extends")).otherwise(F.array().cast("array<string>")), F.col("implements"))
    return types_.select(F.explode(ups).alias("src"), F.col("name").alias("dst")).where("src <> ''").distinct()


def call_sites(parsed: DataFrame, methods_: DataFrame, types_: DataFrame) -> DataFrame:
    """(key, repo, path, type, line, code, recv, callee): calls in methods with the declared type of their receiver.

    A receiver is, in this order: this or nothing (the method's own type), a local variable, a field, a type of that name."""
    spans = methods_.select("repo", "path", "key", "type", "start", "end")
    calls = explode(parsed.where("lang = 'java'"), "calls").drop("lang").join(spans, ["repo", "path"]).where(F.col("line").between(F.col("start"), F.col("end"))).where("qualifier <> '.'")
    local = explode(parsed.where("lang = 'java'"), "locals").drop("lang").withColumnRenamed("type", "ltype").join(spans.select("repo", "path", "key", "start", "end"), ["repo", "path"]).where(F.col("line").between(F.col("start"), F.col("end")))
    local = local.groupBy("key", F.col("name").alias("qualifier")).agg(F.max_by("ltype", "line").alias("ltype"))
    fields = types_.select("repo", F.col("name").alias("type"), F.explode("fields").alias("f")).groupBy("repo", "type", F.col("f.name").alias("qualifier")).agg(F.min("f.type").alias("ftype"))
    named = types_.select(F.col("name").alias("tname")).distinct()
    title = F.concat(F.upper(F.substring("qualifier", 1, 1)), F.substring("qualifier", 2, 10_000))
    out = calls.join(local, ["key", "qualifier"], "left").join(fields, ["repo", "type", "qualifier"], "left").join(named, title == F.col("tname"), "left")
    recv = F.when(F.col("qualifier").isin("", "this"), F.col("type")).otherwise(F.coalesce("ltype", "ftype", "tname"))
    return out.withColumn("recv", recv).where("recv is not null").select("key", "repo", "path", "type", "line", "code", "recv", "callee")


def dispatch(pairs: DataFrame, methods_: DataFrame, types_: DataFrame) -> DataFrame:
    """(recv, callee) to (recv, callee, target, di): the concrete methods a call of a declared type may run.

    These are the ones of that name on the type itself and all below it, as far as not abstract; if there is none, the
    declared type's own. di marks a call whose declared type has no such concrete method itself."""
    pairs = pairs.select("recv", "callee").distinct()
    below = graph.closure(inherits(types_), starts=pairs.select(F.col("recv").alias("start"))).select(F.col("start").alias("recv"), F.col("node").alias("type"))
    below = below.unionByName(types_.select(F.col("name").alias("recv"), F.col("name").alias("type"))).distinct()
    concrete = types_.where("not abstract").select(F.col("name").alias("type")).distinct()
    have = methods_.select("type", F.col("name").alias("callee"), F.col("key").alias("target"))
    runs = pairs.join(below, "recv").join(concrete, "type", "left_semi").join(have, ["type", "callee"]).select("recv", "callee", "target").distinct()
    own = pairs.join(have.select(F.col("type").alias("recv"), "callee"), ["recv", "callee"]).join(concrete.select(F.col("type").alias("recv")), "recv")
    own = own.select("recv", "callee", F.lit(True).alias("own")).distinct()
    runs = runs.join(own, ["recv", "callee"], "left").select("recv", "callee", "target", F.col("own").isNull().alias("di"))
    rest = pairs.join(runs, ["recv", "callee"], "left_anti").join(have.withColumnRenamed("type", "recv"), ["recv", "callee"])
    return runs.unionByName(rest.select("recv", "callee", "target", F.lit(False).alias("di")))


def dispatch_edges(sites: DataFrame, methods_: DataFrame, types_: DataFrame) -> DataFrame:
    """(caller, callee, line, code, di, recv) between methods, by key; one for each pair and line."""
    edges = sites.join(dispatch(sites, methods_, types_), ["recv", "callee"]).where("key <> target")
    picked = edges.groupBy(F.col("key").alias("caller"), F.col("target").alias("callee"), "line").agg(F.min("code").alias("code"), F.min("di").alias("di"), F.min("recv").alias("recv"))
    return picked


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)([A-Z])", "_$1"))


def table_name(c: Column) -> Column:
    """A table's name without quotes and schema, in lower case."""
    return F.lower(F.regexp_replace(F.element_at(F.split(F.regexp_replace(c, '["`]', ""), r"\."), -1), r"\s", ""))


def db_model(types_: DataFrame, sql_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, access): tables (name, entity, entity_repo, migrations, mig_repo, map_note), and which repository types manage
    which table (repo, repo_type, table, writes, reads). sql_lines: (repo, path, line, text) of .sql files."""
    entity = types_.where(F.exists("annotations", lambda a: a.rlike(to_java(r"@Entity\b"))))
    named = F.get(F.filter(F.transform("annotations", lambda a: F.regexp_extract(a, to_java(TABLE_NAME), 1)), lambda x: x != ""), F.lit(0))
    entities = entity.groupBy("name").agg(F.min_by(F.struct("repo", named.alias("given")), "repo").alias("e")).select(F.col("name").alias("entity"), F.col("e.repo").alias("entity_repo"), F.coalesce("e.given", snake(F.col("name"))).alias("table"), F.when(F.col("e.given").isNotNull(), "@Table(name)").otherwise("default (snake_case of entity)").alias("note"))
    repos = types_.where(F.col("extends").isin(*REPOSITORY_BASES) & (F.size("extends_args") > 0)).select("repo", F.col("name").alias("repo_type"), F.col("extends_args")[0].alias("entity"))
    access = relate.left_with_default(repos, entities.select("entity", "table"), "entity", F.col("table"), snake(F.col("entity")), "of", "how", "entity", "guess")
    access = access.select("repo", "repo_type", "entity", F.col("of").alias("table"), "how", F.lit(True).alias("writes"), F.lit(True).alias("reads"))
    mapped = entities.select(F.col("table").alias("name"), "entity", "entity_repo", "note").unionByName(access.where("how = 'guess'").select(F.col("table").alias("name"), "entity", F.lit("").alias("entity_repo"), F.lit("default (entity not in workspace)").alias("note")).distinct())
    mapped = mapped.groupBy("name").agg(F.min_by(F.struct("entity", "entity_repo", "note"), F.struct(F.col("entity_repo") == "", "entity")).alias("m")).select("name", "m.*")
    made = sql_lines.where(F.lower("path").rlike(r"db/migration|db/changelog|migration")).select("repo", "path", table_name(F.regexp_extract("text", to_java(CREATE_TABLE), 1)).alias("name")).where("name <> ''")
    made = made.groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("migrations"), F.max_by("repo", F.struct("repo", "path")).alias("mig_repo"))
    tables = mapped.join(made, "name", "full_outer").select("name", F.coalesce("entity", F.lit("")).alias("entity"), F.coalesce("entity_repo", F.lit("")).alias("entity_repo"), F.coalesce("migrations", F.array().cast("array<string>")).alias("migrations"), F.coalesce("mig_repo", F.lit("")).alias("mig_repo"), F.coalesce("note", F.lit("from migration")).alias("map_note"))
    return tables, access.select("repo", "repo_type", "table", "writes", "reads")


def access_sites(sites: DataFrame, access: DataFrame) -> DataFrame:
    """(table, key, path, line, code, write): calls of repositories that write or read a table; writing wins."""
    verb = F.when(F.col("callee").rlike(to_java(WRITE_VERBS)), True).when(F.col("callee").rlike(to_java(READ_VERBS)), False)
    return sites.join(access.select(F.col("repo_type").alias("recv"), "table").distinct(), "recv").withColumn("write", verb).where("write is not null").select("table", "key", "repo", "path", "line", "code", "write").distinct()


def type_graph(parsed: DataFrame, sql_lines: DataFrame, body_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a project: a node for each type and table; an edge for each pair of types of which one calls the other,
    and from repositories to their tables. body_lines: (repo, path, line, text), for the effects of methods."""
    ms, ts = stored(methods(parsed)), stored(types(parsed))
    sites = stored(call_sites(parsed, ms, ts))
    tables, access = (stored(x) for x in db_model(ts, sql_lines))
    effects = body_lines.join(ms.select("repo", "path", "type", "start", "end"), ["repo", "path"]).where(F.col("line").between(F.col("start"), F.col("end")))
    markers = [(k, lb, to_java(r)) for k, lb, r in JAVA_MARKERS]
    effects = effects.select("repo", "type", F.explode(search.all_kinds(F.split_part("text", F.lit("//"), F.lit(1)), markers)).alias("kind")).groupBy("repo", F.col("type").alias("name")).agg(F.array_sort(F.collect_set("kind")).alias("effects"))
    entries = ms.where("entry is not null").groupBy("repo", F.col("type").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.concat_ws(".", "type", "name").alias("op")))), lambda x: x["op"]), ", ").alias("op"), F.min_by("name", "start").alias("method"))
    first = relate.first_wins(ts.select("repo", "name", "path", "line"), ["repo", "name"], ["path", "line"])
    nodes = first.join(entries, ["repo", "name"], "left").join(effects, ["repo", "name"], "left").select(
        F.concat_ws("::", "repo", "name").alias("id"), F.col("name").alias("label"), F.col("repo").alias("service"), F.lit("java").alias("lang"), F.when(F.col("op").isNotNull(), "entrypoint").otherwise("file").alias("kind"),
        F.col("path").alias("file"), "line", F.coalesce("op", F.lit("")).alias("op"), F.coalesce("method", F.lit("")).alias("method"), F.coalesce("effects", F.array().cast("array<string>")).alias("effects"))
    owner = F.when(F.col("entity_repo") != "", F.col("entity_repo")).otherwise(F.col("mig_repo"))
    nodes = nodes.unionByName(tables.select(F.concat(F.lit("table::"), "name").alias("id"), F.concat(F.lit("▱ "), "name").alias("label"), owner.alias("service"), F.lit("sql").alias("lang"), F.lit("table").alias("kind"), F.coalesce(F.get("migrations", F.lit(0)), F.lit("")).alias("file"), F.lit(0).cast("long").alias("line"), F.lit("").alias("op"), F.col("name").alias("method"), F.array(F.lit("db")).alias("effects")))
    end = lambda k: ms.select(F.col("key").alias(k), F.concat_ws("::", "repo", "type").alias(f"{k}_id"), F.col("repo").alias(f"{k}_repo"), F.col("type").alias(f"{k}_type"))
    calls = dispatch_edges(sites, ms, ts).join(end("caller"), "caller").join(end("callee"), "callee").where("caller_id <> callee_id")
    calls = calls.groupBy(F.col("caller_id").alias("from"), F.col("callee_id").alias("to")).agg(F.min_by(F.struct("di", "callee_type", "caller_repo", "callee_repo"), F.struct("caller", "line")).alias("c"))
    edges = calls.select("from", "to", F.lit("api-call").alias("kind"), F.when(F.col("c.di"), F.concat(F.lit("DI→"), "c.callee_type")).otherwise("").alias("label"), (F.col("c.caller_repo") != F.col("c.callee_repo")).alias("cross"))
    of = tables.select(F.col("name").alias("table"), F.when(F.col("mig_repo") != "", F.col("mig_repo")).otherwise(F.col("entity_repo")).alias("owner"))
    uses = access.join(of, "table", "left").select(F.concat_ws("::", "repo", "repo_type").alias("from"), F.concat(F.lit("table::"), "table").alias("to"), F.coalesce((F.col("owner") != "") & (F.col("owner") != F.col("repo")), F.lit(False)).alias("cross"))
    for kind, label in (("writes-to", "writes"), ("reads-from", "reads")):
        edges = edges.unionByName(uses.select("from", "to", F.lit(kind).alias("kind"), F.lit(label).alias("label"), "cross"))
    return nodes, edges


def file_graph(files: DataFrame, services: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of services (name, root, lang) whose files lie under their roots: imports, route registrations, and the
    calls of routes by name from scripts. packages: (pkg, root) of workspace packages."""
    spread = relate.longest_prefix(files.where(~F.col("path").rlike(r"\.d\.ts$|_test\.go$|\.(test|spec)\.tsx?$")), "path", services, "root").where("root is not null").join(services, "root")
    kept = stored(spread.where(((F.col("lang") == "js") & F.col("ext").isin(".ts", ".tsx") & (F.col("service_lang") == "ts")) | ((F.col("lang") == "go") & (F.col("service_lang") == "go"))).select("path", "text", "service_lang", F.col("name").alias("service"), F.concat_ws("::", "name", "path").alias("id"), F.substring("path", F.length("root") + 2, F.lit(10_000)).alias("label")))
    at = kept.select(F.col("path").alias("cand"), F.col("id").alias("to"), F.col("service").alias("to_service"))
    specs = kept.where("service_lang = 'ts'")
    for g in (1, 2, 3):
        part = specs.select("id", "path", "service", F.explode(F.regexp_extract_all("text", F.lit(TS_IMPORT), F.lit(g))).alias("spec")).where("spec <> ''")
        found = part if g == 1 else found.unionByName(part)
    found = found.withColumn("n", F.monotonically_increasing_id())
    found = stored(found)
    cand = lambda base: F.array(*(F.concat(base, F.lit(x)) for x in ("", ".ts", ".tsx", "/index.ts", "/index.tsx")), F.regexp_replace(base, r"\.js$", ".ts"))
    joined = F.concat(F.regexp_replace("path", r"[^/]*$", ""), F.col("spec"))
    near = found.where(F.startswith("spec", F.lit("."))).select("n", "id", "service", F.posexplode(cand(_normal(joined))).alias("p", "cand"))
    pkg = found.where(~F.startswith("spec", F.lit("."))).select("n", "id", "service", F.explode(_prefixes(F.col("spec"))).alias("pkg")).join(packages, "pkg").select("n", "id", "service", F.posexplode(F.array(F.concat("root", F.lit("/index.ts")), F.concat("root", F.lit("/index.tsx")))).alias("p", "cand"))
    imports = near.unionByName(pkg).join(at, "cand").groupBy("n", "id", "service").agg(F.min_by(F.struct("to", "to_service"), "p").alias("t")).select(F.col("id").alias("from"), F.col("t.to").alias("to"), F.lit("import").alias("kind"), F.lit("").alias("label"), (F.col("service") != F.col("t.to_service")).alias("cross"))
    go = kept.where("service_lang = 'go'")
    routes = go.select("id", "service", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(GO_ROUTE), F.lit(1)).alias("op"), F.regexp_extract_all("text", F.lit(GO_ROUTE), F.lit(2)).alias("handler"))).alias("r")).select("id", "service", "r.*")
    defs = search.to_lines(go.select("id", "service", "path", "text"), "id", "service", "path").withColumn("handler", F.regexp_extract("line_text", to_java(GO_RECEIVER), 1)).where("handler <> ''")
    defs = defs.groupBy("service", "handler").agg(F.min_by(F.struct("id", "line"), F.struct("path", "line")).alias("d")).select("service", "handler", F.col("d.id").alias("to"), F.col("d.line").alias("at"))
    registers = stored(routes.join(defs, ["service", "handler"]))
    edges = imports.unionByName(registers.select(F.col("id").alias("from"), "to", F.lit("registers").alias("kind"), F.col("op").alias("label"), F.lit(False).alias("cross")))
    named = search.names_in(kept.where("service_lang = 'ts'"), registers, name="op")
    edges = edges.unionByName(named.join(registers.select("op", "to").distinct(), "op").select(F.col("id").alias("from"), "to", F.lit("api-call").alias("kind"), F.col("op").alias("label"), F.lit(True).alias("cross")))
    handlers = registers.groupBy(F.col("to").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("op")), ", ").alias("op"), F.min_by("handler", "at").alias("method"), F.min("at").alias("line"))
    routers = registers.select("id").distinct().withColumn("router", F.lit(True))
    nodes = kept.join(handlers, "id", "left").join(routers, "id", "left").select("id", "label", "service", F.col("service_lang").alias("lang"), F.when(F.col("op").isNotNull(), "entrypoint").when(F.col("router"), "router").otherwise("file").alias("kind"), F.col("path").alias("file"), F.coalesce("line", F.lit(0)).cast("long").alias("line"), F.coalesce("op", F.lit("")).alias("op"), F.coalesce("method", F.lit("")).alias("method"))
    return nodes, edges


def _prefixes(spec: Column) -> Column:
    parts = F.split(spec, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def _normal(path: Column) -> Column:
    """A path without . and .. parts."""
    drop = lambda s: F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda s, x: F.when(x == "..", drop(s)).when(x.isin(".", ""), s).otherwise(F.array_append(s, x)))
    return F.array_join(parts, "/")


def flow_calls(parsed: DataFrame) -> DataFrame:
    """(path, line, args, to_path, to_start): calls of Java methods with the methods that they may run."""
    java = parsed.where("lang = 'java'")
    ms, ts = methods(java), types(java)
    sites = call_sites(java, ms, ts).select("key", "path", "line", "recv", "callee")
    runs = sites.join(dispatch(sites, ms, ts), ["recv", "callee"]).join(ms.select(F.col("key").alias("target"), F.col("path").alias("to_path"), F.col("start").alias("to_start")), "target")
    args = explode(java, "calls").select("path", "line", "callee", "args")
    return runs.join(args, ["path", "line", "callee"]).select("path", "line", "args", "to_path", "to_start").distinct()


def object_flow(parsed: DataFrame, type_name: str) -> DataFrame:
    """(scope, var, path, at, set_path, line, field, code): setters of instances of a type, by the method that makes one.

    at is the line in that method: of the setter itself, or of the call that hands the instance to a method which sets it, or
    which hands it on to one that does, however far; methods that hand it round in a circle are met once."""
    java = parsed.where("lang = 'java'")
    ms, ts = stored(methods(java)), stored(types(java))
    spans = ms.select("repo", "path", "key", "start", "end")
    within = F.col("line").between(F.col("start"), F.col("end"))
    made = explode(java, "locals").drop("lang").where(F.col("type") == type_name).join(spans, ["repo", "path"]).where(within)
    made = stored(made.select("repo", "path", "key", F.col("name").alias("var"), "start", "end").distinct())
    field = F.concat(F.lower(F.substring("callee", 4, 1)), F.substring("callee", 5, 10_000))
    calls = explode(java, "calls").drop("lang")
    sets = calls.where(F.col("callee").rlike("^set[A-Z_]")).select("repo", "path", F.col("qualifier").alias("var"), "line", "callee", "code")
    own = sets.join(made, ["repo", "path", "var"]).where(within).select(F.col("key").alias("scope"), "var", "path", F.col("line").alias("at"), F.col("path").alias("set_path"), "line", field.alias("field"), "code")
    # Which variable of a method goes to which parameter of another: (key, var, line) to place, the other's key and the number.
    sites = stored(call_sites(java, ms, ts).select("key", "line", "recv", "callee"))
    place = F.concat_ws("\x00", "target", F.col("n").cast("string"))
    given = calls.select("repo", "path", "line", "callee", F.posexplode("args").alias("n", "var")).join(spans, ["repo", "path"]).where(within)
    given = stored(given.join(sites, ["key", "line", "callee"]).join(dispatch(sites, ms, ts), ["recv", "callee"]).select("key", "path", "line", "var", place.alias("place")).distinct())
    params = spans.join(explode(java, "functions").select("repo", "path", "start", F.posexplode("params").alias("n", "var")), ["repo", "path", "start"]).withColumnRenamed("key", "target")
    params = stored(params.select("repo", "path", F.col("target").alias("key"), "start", "end", "var", place.alias("of")))
    handed = stored(given.join(made.select("key", "var"), ["key", "var"]))
    onward = given.join(params.select("key", "var", "of"), ["key", "var"]).select(F.col("of").alias("src"), F.col("place").alias("dst"))
    far = graph.closure(onward, starts=handed.select(F.col("place").alias("start"))).select("start", "node")
    far = far.unionByName(handed.select(F.col("place").alias("start"), F.col("place").alias("node"))).distinct()
    inner = params.join(sets, ["repo", "path", "var"]).where(within).select(F.col("of").alias("node"), F.col("path").alias("set_path"), F.col("line").alias("set_line"), field.alias("field"), "code")
    passed = handed.join(far, F.col("place") == F.col("start")).join(inner, "node").select(F.col("key").alias("scope"), "var", "path", F.col("line").alias("at"), "set_path", F.col("set_line").alias("line"), "field", "code")
    return own.unionByName(passed).distinct()


def set_counts(sets: DataFrame, fields: list[str]) -> DataFrame:
    """(scope, var, field, n, note): how often each instance has each of its type's fields set, never included, and other names set."""
    had = sets.groupBy("scope", "var", "field").agg(F.count(F.lit(1)).alias("n"))
    every = sets.select("scope", "var").distinct().withColumn("field", F.explode(F.array(*map(F.lit, fields)).cast("array<string>")))
    told = every.join(had, ["scope", "var", "field"], "full_outer").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return told.withColumn("note", F.when(F.col("n") == 0, "never set").when(F.col("n") > 1, "more than once").otherwise("once"))
