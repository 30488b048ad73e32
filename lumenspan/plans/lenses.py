"""The lenses: each a plan over the source tables, and the rendering of what it finds.

A lens whose answer is rows has a plan (a lazy DataFrame) that the rendering collects in order; what comes to the driver is
the answer itself. Lenses about one method read that file alone.
"""

from __future__ import annotations

import json
import re
import shutil
import subprocess
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions import flow
from lumenspan.functions.code import Function, Source, Statements, functions, types
from lumenspan.functions.languages import CALL_KEYWORDS, JAVA_MARKERS, LANGUAGES, ORDER
from lumenspan.functions.regex import glob_to_regex, to_java
from lumenspan.operators import graph, program, relate, search
from lumenspan.operators.store import stored
from lumenspan.sources import blame, files as source
from lumenspan.session import ship

from . import manifest
from .lens import Config, Fact, Lens, Origin, Piece, Projection, Repo, confidence, digest, located, noted, row

MAX_PATHS, MAX_BRANCHES, MAX_PAIRS = 8, 16, 200


class Context:
    """A session, a configuration, and the tables of the tree a lens looks at, made when first needed."""

    def __init__(self, spark: SparkSession, config: Config, lens: Lens, tables: dict[str, DataFrame] | None = None):
        self.spark, self.config, self.lens, self._given = ship(spark), config, lens, tables or {}

    def tree(self, root: str, repo: str = "") -> DataFrame:
        base = root if root.startswith("/") or "://" in root else f"{self.config.root.rstrip('/')}/{root}".rstrip("/")
        if base.rstrip("/.") in self._given:
            return self._given[base.rstrip("/.")]
        extra = {"exclude": self.config.exclude_dirs} if self.config.exclude_dirs else {}
        return source.read_tree(self.spark, base, repo, **extra)

    @cached_property
    def files(self) -> DataFrame:
        return self.tree(self.lens.source_root or ".")

    @cached_property
    def lines(self) -> DataFrame:
        return source.lines(self.files.where("ext <> '.sql'"))

    @cached_property
    def parsed(self) -> DataFrame:
        return manifest.indexed(self.files, f"{self.config.root}|{self.lens.source_root}|{self.config.exclude_dirs}", source.parsed)

    @cached_property
    def language(self) -> str:
        """The tree's most frequent language; of equals the first of java, go, js."""
        got = relate.argmax_by(self.files, "lang", ORDER).first()
        return self.lens.get("lang") or (got["lang"] if got else "java")

    def file(self, path: str) -> Source:
        if path.startswith("/") or ".." in path.split("/"):
            raise ValueError(f"{self.lens.analyzer}: {path} is outside the source root")
        exact = self.files.where(F.col("path") == path).select("text", "lang").first()
        got = exact or self.files.where(F.endswith("path", F.lit("/" + path))).orderBy("path").select("text", "lang").first()
        if got is None:
            raise FileNotFoundError(f"{self.lens.analyzer}: no file {path} under {self.lens.source_root or '.'}")
        return Source(got["text"] or "", got["lang"] or "java")

    def file_path(self, path: str) -> str:
        """The path below the source root of a file told by its path or its end."""
        got = self.files.where((F.col("path") == path) | F.endswith("path", F.lit("/" + path))).orderBy(F.col("path") != path, "path").select("path").first()
        return got["path"] if got else path

    def method(self, src: Source, file: str) -> tuple[Function, int]:
        """The method named, or the one around the line; and the line aimed at, a method's end where none is given."""
        name, line = self.lens.get("method"), int(self.lens.get("line", default="0") or 0)
        for f in functions(src):
            if (name and f.name == name) or (not name and f.start <= line <= f.end):
                return f, line or f.end
        raise ValueError(f"no enclosing method found for {file}:{line} method={name}")


Analyzer = Callable[[Context], Projection]
REGISTRY: dict[str, Analyzer] = {}
PLANS: dict[str, Callable[[Context], DataFrame]] = {}


def lens(*names: str):
    def add(f: Analyzer) -> Analyzer:
        REGISTRY.update(dict.fromkeys(names, f))
        return f

    return add


def plan(*names: str):
    def add(f):
        PLANS.update(dict.fromkeys(names, f))
        return f

    return add


def run(spark: SparkSession, config: Config, lens_: Lens, tables: dict[str, DataFrame] | None = None) -> Projection:
    if lens_.analyzer not in REGISTRY:
        raise ValueError(f"unknown analyzer {lens_.analyzer!r}")
    return REGISTRY[lens_.analyzer](Context(spark, config, lens_, tables)).finish(lens_)


def run_all(spark: SparkSession, config: Config) -> list[str]:
    """Every configured lens, one after the other; all analyzers are known before the first runs."""
    for x in config.lenses:
        if x.analyzer not in REGISTRY:
            raise ValueError(f"lens {x.name}: unknown analyzer {x.analyzer!r}")
    return [str(p) for x in config.lenses for p in run(spark, config, x).write(f"{config.root}/{config.out(x)}")]


def _block(id_: str, mode: str, tool: str, lines: list[str], file: str = "model", **kw) -> Piece:
    return Piece(id_, file, mode, tool, lines, **kw)


# --- searches -------------------------------------------------------------------------------------------------------


def parse_patterns(s: str) -> list[tuple[str, str]]:
    """label=pattern;label=pattern; a pattern alone is its own label."""
    parts = [p.strip() for p in s.split(";") if p.strip()]
    return [(a.strip(), b.strip()) if (b := p.partition("=")[2]) and (a := p.partition("=")[0]) else (p, p) for p in parts]


def _patterns(c: Context) -> list[tuple[str, str]]:
    if c.lens.analyzer == "entrypoints":
        return parse_patterns(c.lens.need("patterns"))
    return [(s.strip(), "(?i)" + glob_to_regex(s.strip()) + r"\s*\(") for s in c.lens.need("sinks").split(",") if s.strip()]


@plan("entrypoints", "exitpoints")
def labelled_plan(c: Context) -> DataFrame:
    return search.labelled_hits(c.lines, [(label, to_java(p)) for label, p in _patterns(c)], "text").orderBy("path", "line", "ord")


@lens("entrypoints", "exitpoints")
def labelled(c: Context) -> Projection:
    shown = [row(c.lens.get("line_format"), r.path, r.line, r.label, r.text.strip()) for r in labelled_plan(c).collect()]
    name = c.lens.analyzer
    return Projection(pieces=[_block(name, name, name, shown or [f"// no matches under {c.lens.source_root or '.'}"])])


def _title(s: str) -> str:
    return s[:1].upper() + s[1:]


def _query(c: Context) -> tuple[str, str]:
    """Pattern and note of a search for one name."""
    kind = c.lens.analyzer
    n = c.lens.need({"constructions": "type", "writes-to": "var"}.get(kind, "name"))
    q = re.escape(n)
    if kind == "references":
        return rf"\b{q}\b", f"textual references to {n} (same-named symbols on other types also match)"
    if kind == "callers":
        return rf"\b{q}\s*\(", f"call sites of {n}() by name (no type resolution; def line may appear)"
    if kind == "constructions":
        return rf"(\bnew\s+{q}\b|\b{q}\s*\{{|&{q}\s*\{{|\b{q}\.new\b)", f"construction sites of {n} (new/composite-literal/factory)"
    ways = [rf"\b{q}\s*(=|\+=|-=|\*=|/=|\|=|&=|\^=)[^=]", rf"\b{q}\s*(\+\+|--)", rf"\.\s*set{re.escape(_title(n))}\s*\(", rf"\b{q}\.\s*(set|add|put|remove)\w*\s*\("]
    return "(" + "|".join(ways) + ")", f"writes/mutations of {n} (assign, ++/--, setter)"


@plan("references", "callers", "constructions", "writes-to")
def query_plan(c: Context) -> DataFrame:
    return search.grep(c.lines, to_java(_query(c)[0]), "text").orderBy("path", "line")


@lens("references", "callers", "constructions", "writes-to")
def query(c: Context) -> Projection:
    hits, kind = query_plan(c).collect(), c.lens.analyzer
    shown = [located(r.text.strip(), r.path, r.line) for r in hits] or [f"// no matches under {c.lens.source_root or '.'}"]
    return Projection(pieces=[_block(kind, kind, kind, shown)], facts=[confidence("lexical", _query(c)[1]), Fact("count", f"{len(hits)} matches", kind)])


SQL_TARGET = r"""(?i)\b(?:from|join|into|update)\s+([a-z_][a-z0-9_."]*)"""


@plan("sql-tables")
def sql_plan(c: Context) -> DataFrame:
    found = source.lines(c.files.where("ext = '.sql'"))
    if want := c.lens.get("file"):
        found = found.where((F.col("path") == want) | (F.element_at(F.split("path", "/"), -1) == want))
    found = search.captures(found, to_java(SQL_TARGET), "target", text="text")
    return found.withColumn("target", F.regexp_replace(F.lower("target"), '^"+|"+$', ""))


@lens("sql-tables")
def sql_tables(c: Context) -> Projection:
    hits = stored(sql_plan(c))
    shown = [located(r.text.strip(), r.path, r.line) for r in hits.orderBy("path", "line").collect()]
    counts = hits.groupBy("target").count().orderBy("target").collect()
    facts = [Fact(f"table-{r.target}", f"{r.target}: {r['count']} refs", "sql-tables") for r in counts]
    none = f"// no SQL table references under {c.lens.source_root or '.'}"
    return Projection(pieces=[_block("sql-tables", "sql-tables", "sql-tables", shown or [none])], facts=[*facts, confidence("lexical", "FROM/JOIN/INTO/UPDATE targets in .sql files")])


def markers_of(c: Context) -> list[tuple[str, str, str]]:
    """The language's markers, then the lens's own (kind=pattern;...)."""
    own = [(k, k, p) for k, p in (parse_patterns(c.lens.get("markers")) if c.lens.get("markers") else []) if k != p]
    known = list(LANGUAGES[c.language].markers) if c.language in LANGUAGES else []
    if not known and not own:
        raise ValueError(f"side-effects: no markers for language {c.language!r}")
    return [(k, label, to_java(p)) for k, label, p in [*known, *own]]


@plan("side-effects")
def effects_plan(c: Context) -> DataFrame:
    code = F.split_part("text", F.lit("//"), F.lit(1))
    hits = c.lines.where("lang is not null and not is_test").withColumn("hit", search.first_match(code, markers_of(c))).where("hit is not null")
    return hits.select("path", "line", "text", "hit.kind", "hit.label")


@lens("side-effects")
def side_effects(c: Context) -> Projection:
    by: dict[str, list[str]] = {}
    for r in effects_plan(c).orderBy("kind", "path", "line").collect():
        by.setdefault(r.kind, []).append(located(r.text.strip(), r.path, r.line))
    pieces = [_block(k, "side-effects", "side-effects", v) for k, v in by.items()]
    none = _block("none", "side-effects", "side-effects", [f"// no side effects detected under {c.lens.source_root or '.'}"])
    return Projection(pieces=pieces or [none], facts=[Fact(f"count-{k}", f"{k}: {len(v)}", "side-effects") for k, v in by.items()])


@lens("ast-grep")
def structural(c: Context) -> Projection:
    """Structural patterns: $NAME stands for a balanced expression, the same wherever the name is, $$$ for any number of arguments,
    white space for any."""
    pattern, lang = c.lens.need("pattern"), c.lens.need("lang")
    want = {"ts": "js", "tsx": "js"}.get(lang, lang)
    shown = [row(c.lens.get("line_format"), r.path, r.line, c.lens.get("label", default="match"), r.text) for r in structural_plan(c, pattern, want).collect()]
    return Projection(pieces=[_block("ast-grep", "ast-grep", "ast-grep", sorted(shown) or [f"// no ast-grep matches under {c.lens.source_root or '.'}"])])


#: Brackets within brackets that a structural pattern's $NAME may hold.
BRACKETS = 16


def _nested(opening: str, closing: str, depth: int = BRACKETS) -> str:
    """A regular expression of a balanced pair of brackets."""
    other = f"[^\\{opening}\\{closing}]++"
    return rf"\{opening}(?:{other}{'|' + _nested(opening, closing, depth - 1) if depth > 1 else ''})*+\{closing}"


def structural_regex(pattern: str) -> str:
    """The pattern as a regular expression: a name's first place is a group, its others are what stood there; $_ names nothing."""
    balanced = rf"(?:[^()\[\]{{}},;]|{_nested('(', ')')}|{_nested('[', ']')})+?"
    names, out = [], []
    for p in re.split(r"(\$\$\$\w*|\$[A-Z_]\w*|\s+)", pattern):
        if p.startswith("$$$"):
            out.append(rf"(?:[^()]|{_nested('(', ')')})*?")
        elif p.startswith("$_"):
            out.append(balanced)
        elif p.startswith("$") and p in names:
            out.append(rf"(?:\{names.index(p) + 1})")
        elif p.startswith("$") and len(p) > 1:
            names.append(p)
            out.append(f"({balanced})")
        else:
            out.append(r"\s*" if p.isspace() else re.escape(p))
    return "".join(out)


def structural_plan(c: Context, pattern: str, lang: str) -> DataFrame:
    rx = structural_regex(pattern)
    texts = c.files.where((F.col("lang") == lang) & F.col("text").isNotNull()).select("path", F.regexp_replace("text", "\r\n", "\n").alias("text"))
    hits, pieces = F.regexp_extract_all("text", F.lit(rx), F.lit(0)), F.split("text", rx, -1)
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    # The lines before a match: line ends in the pieces before it and the matches before it, and in its own leading white space.
    cut = texts.select("path", hits.alias("h"), pieces.alias("p")).where(F.size("h") > 0)
    before = F.aggregate(F.zip_with(F.slice("p", F.lit(1), F.col("k") + 1), F.slice("h", F.lit(1), F.col("k")), lambda a, b: newlines(a) + F.coalesce(newlines(b), F.lit(0))), F.lit(0), lambda s, x: s + x)
    found = cut.select("path", "h", "p", F.posexplode("h").alias("k", "m"))
    head = newlines(F.regexp_extract("m", r"^\s*", 0))
    return found.select("path", (before + head + 1).cast("long").alias("line"), F.regexp_replace(F.trim(F.regexp_replace("m", r"^\s+|\s+$", "")), r"\s*\n\s*", " ").alias("text"))


# --- call graphs ----------------------------------------------------------------------------------------------------


def _ambiguity(funcs: DataFrame, name: str) -> str:
    n = funcs.where(F.col("name") == name).count()
    return f"scope-resolved by name; {name} is declared {n} times, so edges may mix them" if n > 1 else "scope-resolved by name (no type checking)"


@plan("call-graph-callers")
def callers_plan(c: Context) -> DataFrame:
    return program.call_graph(c.parsed)[1].where(F.col("callee") == c.lens.need("name")).orderBy("path", "line", "caller")


@lens("call-graph-callers")
def graph_callers(c: Context) -> Projection:
    name, (funcs, _) = c.lens.need("name"), program.call_graph(c.parsed)
    if funcs.where(F.col("name") == name).isEmpty():
        none = [f"// no function named {name} is declared in this source root"]
        return Projection(pieces=[_block("callers", "callers", "call-graph", none)], facts=[confidence("structural", "no declaration found; lexical `callers` may still match text")])
    edges = callers_plan(c).collect()
    n = program.caller_counts(callers_plan(c)).first()
    shown = [located(f"{e.caller} → {name}()", e.path, e.line) for e in edges]
    none = f"// {name} is declared but has no resolved callers (entrypoint, dead, or called via interface/reflection)"
    count = Fact("count", f"{n.sites if n else 0} call sites from {n.callers if n else 0} distinct functions", "call-graph")
    return Projection(pieces=[_block("callers", "callers", "call-graph", shown or [none])], facts=[confidence("structural", _ambiguity(funcs, name)), count])


@plan("impact-set")
def impact_plan(c: Context) -> DataFrame:
    funcs, edges = program.call_graph(c.parsed)
    reached = graph.impact_set(edges, c.spark.createDataFrame([(c.lens.need("name"),)], "node string"))
    first = relate.first_wins(funcs, ["name"], ["path", "start"])
    return reached.join(first, F.col("node") == F.col("name"), "left").select("node", "depth", "path", "start")


@lens("impact-set")
def impact(c: Context) -> Projection:
    name, (funcs, _) = c.lens.need("name"), program.call_graph(c.parsed)
    if funcs.where(F.col("name") == name).isEmpty():
        raise ValueError(f"impact-set: no function named {name} declared in this source root")
    by: dict[int, list] = {}
    for r in impact_plan(c).orderBy("depth", "node").collect():
        by.setdefault(r.depth, []).append(r)
    shown = [x for d, rows in by.items() for x in (f"// ── {'direct callers' if d == 1 else f'depth {d}'} ({len(rows)}) ──", *(located(r.node, r.path or "", r.start or 0) for r in rows))]
    none = f"// nothing calls {name} — changing it affects only itself (entrypoint or dead code)"
    blast = Fact("blast", f"{sum(map(len, by.values()))} functions transitively reach {name} (max depth {max(by, default=0)})", "call-graph")
    return Projection(pieces=[_block("impact", "impact-set", "call-graph", shown or [none])], facts=[confidence("structural", _ambiguity(funcs, name)), blast])


@plan("cpg-methods")
def methods_plan(c: Context) -> DataFrame:
    """(path, name, owner, start, end, calls) of the functions of a file or name."""
    parsed = c.parsed
    if want := c.lens.get("file"):
        parsed = parsed.where(F.endswith("path", F.lit(want)))
    found = program.calls_of(parsed)
    if want := c.lens.get("method"):
        found = found.where(F.col("name") == want)
    return found.orderBy("path", "start")


@lens("cpg-methods")
def cpg_methods(c: Context) -> Projection:
    by: dict[str, list[str]] = {}
    for r in methods_plan(c).collect():
        by.setdefault(r.path, []).append(f"{r.owner + '.' if r.owner else ''}{r.name} lines={r.start}-{r.end} calls={r.calls}")
    return Projection(pieces=[Piece("methods", p, "methods", "cpg-methods", v) for p, v in by.items()], facts=[confidence("structural", "methods and the names they call, from the source scanner")])


@lens("go-symbols")
def go_symbols(c: Context) -> Projection:
    files = c.files.where("lang = 'go' and not is_test")
    if c.lens.include:
        files = files.where(F.col("path").isin(*c.lens.include) | F.element_at(F.split("path", "/"), -1).isin(*(i.rpartition("/")[2] for i in c.lens.include)))
    made = stored(source.parsed(files))
    pieces = []
    found = source.explode(made, "symbols").where("kind = 'type'").join(source.lines(files).select("path", "line", "text"), ["path", "line"])
    for r in found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "text"))).alias("t")).orderBy("path").collect():
        src = c.file(r.path)
        ends = {src.line(b.open): src.line(b.close) for b in src.blocks}
        pieces.append(Piece("types", r.path, "types", "go-symbols", [f"{(x.text.split() + ['', '', ''])[2].rstrip('{')} {x.name} lines={x.line}-{ends.get(x.line, x.line)} :: {x.text.partition('{')[0].strip()}" for x in r.t]))
    funcs, edges = program.call_graph(made)
    calls = {r.caller: r.c for r in edges.groupBy("caller").agg(F.array_sort(F.collect_set("callee")).alias("c")).collect()}
    for r in source.explode(made, "functions").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "name", "sig"))).alias("f")).orderBy("path").collect():
        pieces.append(Piece("functions", r.path, "functions", "go-symbols", [f"{f.sig} lines={f.start}-{f.end} calls={','.join(calls.get(f.name, []))}" for f in r.f]))
    pieces.append(_block("main-callgraph", "callgraph", "go-symbols", call_tree("main", calls)))
    facts = [Fact("core", "Run -> ExecuteLens -> Analyzer -> RenderProjection is the generic path.", "go-symbols"), Fact("adapters", "Language/tool-specific behavior lives behind analyzer adapters registered in DefaultRegistry.", "go-symbols")]
    return Projection(pieces=pieces, facts=facts)


def call_tree(root: str, calls: dict[str, list[str]]) -> list[str]:
    """Calls from a root, depth first, each function's own calls once."""
    out, seen, todo = [], set(), [(root, 0)]
    while todo:
        name, depth = todo.pop()
        out.append("  " * depth + f"-> {name}" + " (seen)" * (name in seen))
        if name not in seen:
            seen.add(name)
            todo += [(x, depth + 1) for x in sorted(calls.get(name, []), reverse=True)]
    return out


# --- one method -----------------------------------------------------------------------------------------------------


def _class(src: Source) -> str:
    return next((t.name for t in types(src).values()), "Java")


def _place(c: Context) -> tuple[str, Source, Function, int]:
    file = c.lens.need("file")
    if not c.lens.get("line") and not c.lens.get("method"):
        raise ValueError("params.line or params.method is required")
    src = c.file(file)
    return file, src, *c.method(src, file)


@lens("control-flow")
def control_flow(c: Context) -> Projection:
    file, src, fn, line = _place(c)
    ways = flow.ways_to(Statements(src).body(fn.open, fn.close), line)[: int(c.lens.get("max_branches", default=str(MAX_BRANCHES)))]
    stem = c.config.out(c.lens).removesuffix(".projection").rpartition("/")[2]
    out, index = Projection(), []
    for k, way in enumerate(ways, 1):
        index.append(f"branch {k} -> {stem}.branch-{k}.projection")
        shown = [located(src.line_text(fn.start).strip(), file, fn.start), *(located(cond if truth else flow.negated(cond), file, n) for n, cond, truth in way), located(src.line_text(line).strip(), file, line)]
        out.extra[f"{stem}.branch-{k}.projection"] = Projection(pieces=[Piece(f"{fn.name}.branch-{k}", file, "cfg-path", "control-flow", shown)])
    out.pieces = [Piece("control-flow", file, "index", "control-flow", index or [f"// no path found from {fn.name} entry to {file}:{line}"])]
    return out


@lens("data-flow", "joern-var-flow")
def data_flow(c: Context) -> Projection:
    var, tool = c.lens.need("var"), c.lens.analyzer
    file, src, fn, line = _place(c)
    s = flow.shape(src, fn, var, line)
    id_, names = f"{_class(src)}.{fn.name}:{var}@{line}", Fact("contributors", ", ".join(sorted(s.names)), tool)
    target = Fact("target", f"{fn.name} {file}:{line} variable {var}", tool)
    if tool == "data-flow":
        shown = [noted(src.line_text(n), flow.NOTES.get(why, "<- " + why).format(var)) for n, why in sorted(s.hits.items())]
        return Projection(pieces=[Piece(id_, file, "dataflow-inline", tool, shown, s.facts)], facts=[target, names])
    shown = [f"// target variable {var} at {file}:{line}", f"// enclosing method {fn.name} lines={fn.start}-{fn.end}", *(x for n, why in sorted(s.hits.items()) for x in (f"// line {n}: {why}", src.line_text(n)))]
    limits = Fact("limits", "lexical within a method, with object mutations; across methods by arguments and returns of resolved calls", tool)
    return Projection(pieces=[Piece(id_, file, "var-flow", "joern-var-flow:fallback", shown, s.facts), *_flow_pieces(c, id_, file, fn, s, line)], facts=[target, names, limits])


def _flow_pieces(c: Context, id_: str, file: str, fn: Function, s: flow.Slice, line: int) -> list[Piece]:
    """What feeds a slice from other methods: the arguments of calls of its method where a parameter takes part, and the returns of
    methods it calls; each of those sliced and followed in turn, once."""
    calls = stored(program.flow_calls(c.parsed))
    out: list[tuple] = []
    seen: set[tuple] = set()
    todo = [(c.file_path(file), fn, s, line)]
    while todo:
        path, f, slice_, upto = todo.pop(0)
        fed = [(k, p) for k, p in enumerate(flow.parameters(f.sig)) if p in slice_.names]
        told = sorted(n for n in slice_.hits if n <= upto)
        rows = calls.where(((F.col("to_path") == path) & (F.col("to_start") == f.start)) | ((F.col("path") == path) & F.col("line").isin(told or [0]) & F.col("line").between(f.start, f.end))).orderBy("path", "line", "to_path", "to_start").collect()
        for r in rows:
            if (r.to_path, r.to_start) == (path, f.start):
                for k, p in fed:
                    arg = r.args[k] if k < len(r.args) else ""
                    for name in flow.values_in(arg):
                        todo += _follow(c, r.path, r.line, name, f"argument {p} of {f.name}", seen, out)
            if r.path == path and r.line in told and slice_.hits[r.line] in ("assignment", "object mutation", "target line"):
                src = c.file(r.to_path)
                for g in functions(src):
                    if g.start == r.to_start:
                        for n in range(g.start, g.end + 1):
                            if m := re.match(r"\s*return\b(.*)", src.code_line(n)):
                                for name in flow.values_in(m[1]):
                                    todo += _follow(c, r.to_path, n, name, f"return of {g.name}", seen, out)
    return [Piece(f"{id_}#{k:03d}", file, "var-flow", "joern-var-flow:fallback", shown, facts) for k, (shown, facts) in enumerate(out, 1)]


def _follow(c: Context, path: str, line: int, name: str, why: str, seen: set, out: list[tuple]) -> list[tuple]:
    if (path, line, name) in seen:
        return []
    seen.add((path, line, name))
    src = c.file(path)
    f = next((f for f in functions(src) if f.start <= line <= f.end), None)
    if f is None:
        return []
    s = flow.shape(src, f, name, line)
    shown = [f"// {why}: {name} at {path}:{line}", *(x for n, w in sorted(s.hits.items()) for x in (f"// {path}:{n}: {w}", src.line_text(n)))]
    out.append((shown, s.facts))
    return [(path, f, s, line)]


@lens("unrolled-program")
def unrolled(c: Context) -> Projection:
    file, name, get = c.lens.need("file"), c.lens.need("method"), c.lens.get
    pairs = lambda s: dict((a.strip(), b.strip().strip('"')) for a, _, b in (p.partition("=") for p in s.split(",")) if a.strip() and b)
    opened: dict[str, Source | None] = {}

    def files(path: str) -> Source | None:
        if path not in opened:
            try:
                opened[path] = c.file(path)
            except FileNotFoundError:
                opened[path] = None
        return opened[path]

    def everywhere(callee: str) -> tuple[str, None] | None:
        got = source.explode(c.parsed, "functions").where((F.col("name") == callee) & (F.col("lang") == lang)).orderBy("path", "start").first()
        return (got.path, None) if got else None

    lang = get("lang") or (c.file(file).lang if file else c.language)
    depth = get("inline_depth")
    u = flow.Unroller(files, lambda at, t: f"{at.rpartition('/')[0]}/{t}.java".lstrip("/"), lang, pairs(get("inputs")), get("branch_select") == "1", pairs(get("branches")),
                      min(10, max(0, int(depth))) if depth.lstrip("-").isdigit() else 8, {s.strip() for s in get("inline_skips").split(",") if s.strip()}, everywhere if lang != "java" else lambda _: None)
    got = u.run(file, name)
    base = c.lens.source_root.strip("/")
    at = lambda f: f"{base}/{f}" if base and base != "." else f
    lines = [x.code for x in got] or ["// no executable path found"]
    piece = Piece(name, file, "unrolled", "unrolled-program", lines, origins=[Origin(at(x.file), x.line, digest(x.code + "\n")) for x in got], guards=[x.guards for x in got], sync="two-way")
    tool, facts = "unrolled-program", []
    add = lambda id_, text: facts.append(Fact(id_, text, tool))
    add("scope", "editable straight-line path; each line syncs back to its original source line")
    for k, d in enumerate(u.decisions, 1):
        add(f"branch-{k}", d)
    if not get("inputs") and get("branch_select") != "1":
        add("branching", "no params.inputs supplied; unknown conditions include both branches")
    for kind, found in (("choice", u.choices), ("call", u.calls)):
        for k, x in enumerate(found.values(), 1):
            add(f"{kind}-{k}", json.dumps({**x, "origin": at(x["origin"])}, separators=(",", ":")))
    counts: dict[str, int] = {}
    marks = [(k, label, re.compile(rx)) for k, label, rx in (LANGUAGES[lang].markers if lang in LANGUAGES else ())]
    for k, x in enumerate(got, 1):
        if x.guards:
            add(f"lguard-{k}", " && ".join(x.guards))
        hit = next(((kind, label) for kind, label, rx in marks if rx.search(x.code.partition("//")[0])), None)
        if hit:
            counts[hit[0]] = counts.get(hit[0], 0) + 1
            add(f"se-line-{k}", f"{hit[0]} ({hit[1]}) {at(x.file)}:{x.line}")
    if counts:
        add("se-summary", " ".join(f"{k}={n}" for k, n in sorted(counts.items())))
    return Projection(pieces=[piece], facts=facts, sync="two-way")


@lens("bookmark", "extract")
def bookmark(c: Context) -> Projection:
    file = c.lens.need("file")
    src = c.file(file)
    if name := c.lens.get("method"):
        f = next((f for f in functions(src) if f.name == name), None)
        if f is None:
            raise ValueError(f"bookmark: method {name!r} not found in {file}")
        a, b = f.start, f.end
    else:
        a, _, b = c.lens.need("lines").partition("-")
        a, b = int(a), int(b or a)
    return bookmark_of(src.lines, c.lens.source_root, file, a, b)


def bookmark_of(lines: list[str], root: str, file: str, a: int, b: int) -> Projection:
    if not 1 <= a <= b <= len(lines):
        raise ValueError(f"bookmark: invalid line range {a}-{b} for {file} ({len(lines)} lines)")
    span = lines[a - 1 : b]
    at = f"{root.strip('/')}/{file}" if root.strip("/.") else file
    piece = Piece(f"{file.rpartition('/')[2]}:{a}-{b}", file, "bookmark", "bookmark", span, sync="two-way", src=(at, a, b, digest("\n".join(span) + "\n")))
    return Projection(pieces=[piece], facts=[Fact("sync", "two-way: edits inside the block sync back to source on `watch` or `sync`", "bookmark")], sync="two-way")


@lens("flow", "java-post-to-save")
def flow_lens(c: Context) -> Projection:
    """Entry methods that reach a sink themselves or through one helper of the same file."""
    entry, sink = to_java(c.lens.need("entry")), to_java(c.lens.need("sink"))
    mode, tool = c.lens.get("mode", default="flow"), c.lens.get("tool", default="flow")
    stop = {"if", "for", "while", "switch", "return", "equals", "new", *(s.strip() for s in c.lens.get("stop_calls").split(","))}
    java = c.parsed.where("lang = 'java'")
    if suffix := c.lens.get("file_suffix"):
        java = java.where(F.endswith("path", F.lit(suffix)))
    fns = source.explode(java, "functions")
    sinks = search.grep(c.lines.where("lang = 'java'"), sink, "text").select("path", "line")
    hits = relate.span_join(sinks, fns.select("path", "name", "start", "end"), ["path"], "line").select("path", "name", "start").distinct()
    calls = source.explode(java, "calls").where(F.col("callee").rlike("^[a-z]") & ~F.col("callee").isin(*stop)).select("path", "line", "callee")
    entries = fns.where(F.exists("annotations", lambda a: a.rlike(entry)) | F.col("sig").rlike(entry)).select("path", "name", "owner", "start", "end", "annotations")
    last = hits.groupBy("path", F.col("name").alias("callee")).agg(F.max("start").alias("h_start"))  # of overloads, the last
    helped = relate.span_join(calls, entries.select("path", "name", "start", "end"), ["path"], "line").where("callee <> name").join(last, ["path", "callee"]).groupBy("path", "name", "start").agg(F.array_sort(F.collect_set(F.struct("callee", "h_start"))).alias("helpers"))
    found = entries.join(hits.withColumn("direct", F.lit(True)), ["path", "name", "start"], "left").join(helped, ["path", "name", "start"], "left").where("direct or helpers is not null")
    pieces = []
    for r in found.orderBy("path", "start").collect():
        src = c.file(r.path)
        by = {f.start: f for f in functions(src)}
        label = next((a for a in r.annotations if re.search(c.lens.need("entry"), a)), c.lens.need("entry"))
        shown = [f"// entry {label}", f"// source {r.path}:{r.start}-{r.end}", *src.lines[r.start - 1 : r.end]]
        facts, at_sink = [], _sinks(src, r.path, by[r.start], c.lens.need("sink"))
        for h in r.helpers or []:
            f = by[h.h_start]
            shown += ["", f"// helper reached from {r.name}; source {r.path}:{f.start}-{f.end}", *src.lines[f.start - 1 : f.end]]
            facts += [f"helper: {r.name} calls {h.callee}, which reaches the sink", *(f"helper.{h.callee}: {x}" for x in _body_facts(src, f))]
            at_sink += _sinks(src, r.path, f, c.lens.need("sink"))
        facts = list(dict.fromkeys([*facts, f"entry: {r.owner}.{r.name} {label}", *_body_facts(src, by[r.start]), *at_sink]))
        pieces.append(Piece(f"{r.owner}.{r.name}", r.path, mode, tool, shown, facts))
    return Projection(pieces=pieces)


def _sinks(src: Source, path: str, f: Function, sink: str) -> list[str]:
    return [f"sink: {path}:{n} `{src.line_text(n).strip()}`" for n in range(f.start, f.end + 1) if re.search(sink, src.line_text(n))]


def _body_facts(src: Source, f: Function) -> list[str]:
    out, nodes = [], Statements(src).body(f.open, f.close)
    around = lambda n: next((x.cond for x in reversed([x for x in flow.flat(nodes) if x.kind == "if" and x.start <= n.start <= x.end])), None)
    for n in flow.flat(nodes):
        if n.kind == "if":
            out.append(f"condition: if {n.cond}")
            if "hasErrors()" in n.cond:
                out.append(f"required-before-save: {n.cond} must be false")
        elif n.kind == "stmt" and ("rejectValue(" in n.text or n.text.startswith("return")):
            what = "can-set-error" if "rejectValue(" in n.text else "early-return" if around(n) else "return"
            out.append(f"{what}: " + (f"if ({around(n)}) -> " if around(n) else "") + n.text + ";")
    return out


# --- across types and repositories ----------------------------------------------------------------------------------


class Project:
    """The repositories a trace or graph spans, as tables."""

    def __init__(self, c: Context):
        self.c = c
        raw, keep = c.lens.get("repos"), c.lens.get("include_libraries") not in ("false", "0")
        repos = [Repo(r["name"], r["path"], r.get("role") or "app") for r in json.loads(raw)] if raw else c.config.repos(c.lens.get("project"), keep)
        if raw and not keep and any(r.role == "app" for r in repos):
            repos = [r for r in repos if r.role == "app"]
        if not repos:
            raise ValueError(f"{c.lens.analyzer}: no repos in scope — add a project first")
        self.repos = repos
        files = None
        for r in repos:
            part = c.tree(r.path, r.name)
            files = part if files is None else files.unionByName(part)
        self.files = stored(files)
        self.lines = stored(source.lines(self.files).select("repo", "path", "lang", "line", "text"))
        self.parsed = manifest.indexed(self.files, "|".join([c.config.root, *(f"{r.name}={r.path}" for r in repos)]), source.parsed, ["repo", "path"])

    @cached_property
    def methods(self) -> DataFrame:
        return stored(program.methods(self.parsed))

    @cached_property
    def types(self) -> DataFrame:
        return stored(program.types(self.parsed))

    @cached_property
    def sites(self) -> DataFrame:
        return stored(program.call_sites(self.parsed, self.methods, self.types))

    @cached_property
    def edges(self) -> DataFrame:
        return stored(program.dispatch_edges(self.sites, self.methods, self.types))

    @cached_property
    def database(self) -> tuple[DataFrame, DataFrame]:
        tables, access = program.db_model(self.types, self.lines.where("path like '%.sql'"))
        return stored(tables), stored(access)

    @cached_property
    def access(self) -> DataFrame:
        return stored(program.access_sites(self.sites, self.database[1]))

    def source(self, repo: str, path: str) -> Source:
        got = self.files.where((F.col("repo") == repo) & (F.col("path") == path)).first()
        return Source(got.text or "", got.lang or "java")

    def paths(self, key: str, most: int) -> tuple[list[list], dict]:
        """Paths of edges from entrypoints to a method, shortest first; without any, the longest chains of callers. Also the methods on them."""
        seed = self.c.spark.createDataFrame([(key,)], "node string")
        up = self.edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
        # Only what reaches the target takes part, so the search grows with the answer and not with the project.
        near = stored(graph.reach(up, seed).select("node"))
        up = stored(up.join(near.withColumnRenamed("node", "src"), "src", "left_semi"))
        near = near.withColumnRenamed("node", "key")
        entries = stored(self.methods.where("entry is not null").join(near, "key", "left_semi").select(F.col("key").alias("node")).where(F.col("node") != key))
        found = [] if entries.isEmpty() else graph.simple_paths(up, seed, ends=entries, most=most).collect()
        if not found:
            heads = near.select(F.col("key").alias("node")).join(up.select(F.col("src").alias("node")), "node", "left_anti")
            found = graph.simple_paths(up, seed, ends=heads, most=most, longest=True).collect()
        chains = [list(reversed(r.path)) for r in found]
        keys = sorted({k for ch in chains for k in ch} | {key})
        nodes = {r.key: r for r in self.methods.where(F.col("key").isin(*keys)).collect()}
        pairs = self.edges.where(F.col("caller").isin(*keys) & F.col("callee").isin(*keys)).orderBy("line").collect()
        first: dict = {}
        for e in pairs:
            first.setdefault((e.caller, e.callee), e)
        return [[first[a, b] for a, b in zip(ch, ch[1:], strict=False)] for ch in chains], nodes


def _guards(p: Project, m, line: int) -> list[str]:
    src = p.source(m.repo, m.path)
    f = next((f for f in functions(src) if f.start == m.start), None)
    return flow.guards_at(Statements(src).body(f.open, f.close), line) if f else []


def _label(m) -> str:
    return f"{m.type}.{m.name}"


def _render_path(p: Project, path: list, nodes: dict, target, line: int) -> tuple[list[str], bool, bool]:
    head = nodes[path[0].caller] if path else target
    note = head.entry or "(no entrypoint annotation — call context only)"
    out, di, cross = [f"[entry] {_label(head)}   {head.repo}/{head.path}   @{note.removeprefix('@')}"], False, False
    for e in path:
        a, b = nodes[e.caller], nodes[e.callee]
        out += [f"    assume: {g}" for g in _guards(p, a, e.line)]
        out.append(located("  → " + e.code.removesuffix(";"), a.path, e.line))
        if e.di:
            di = True
            out.append(f"      ↳ DI: {e.recv}.{b.name} is abstract → dispatched to {_label(b)} ({b.repo}/{b.path})")
        if a.repo != b.repo:
            cross = True
            out.append(f"    ═══ crosses repo boundary: {a.repo} → {b.repo} ═══")
        out.append(f"  {_label(b)}   {b.repo}/{b.path}")
    held = _guards(p, target, line)
    out += [f"    assume: {g}" for g in held]
    out += [f"    loop: {g} (reached 0..N times)" for g in held if g.startswith(("for(", "while("))][:1]
    out.append(located("★ " + p.source(target.repo, target.path).line_text(line).strip(), target.path, line))
    return out, di, cross


def _headline(path: list, nodes: dict, target) -> str:
    return " → ".join([_label(nodes[path[0].caller] if path else target), *(_label(nodes[e.callee]) + "*" * bool(e.di) for e in path)])


@lens("trace-to-line")
def trace(c: Context) -> Projection:
    """Ways from entrypoints, across repositories and through abstract types, to a symbol, a line or a database table."""
    symbol, file, line = c.lens.get("symbol"), c.lens.get("file"), int(c.lens.get("line", default="0") or 0)
    if not symbol and (not file or line <= 0):
        raise ValueError("trace-to-line: params.symbol (or file+line) is required")
    most = int(c.lens.get("max_paths", default="0") or 0) or MAX_PATHS
    p = Project(c)
    if symbol and (table := p.database[0].where(F.col("name") == symbol.strip('"`').rpartition(".")[2].lower()).first()):
        return _trace_table(c, p, table, most)
    target, line = _target(p, symbol, c.lens.get("repo"), file, line)
    paths, nodes = p.paths(target.key, most)
    code = p.source(target.repo, target.path).line_text(line).strip()
    summary = [f"// target: {code}  ({target.repo}/{target.path})", f"// {len(paths)} path(s) from an entrypoint reach this line"]
    answers = [(*_render_path(p, path, nodes, target, line), _headline(path, nodes, target)) for path in paths]
    return _answers(c, "trace-to-line", summary, answers, f"{len(answers)} path(s); scope-resolved by type+method name")


def _answers(c: Context, mode: str, summary: list[str], answers: list[tuple], note: str) -> Projection:
    stem = c.config.out(c.lens).removesuffix(".projection").rpartition("/")[2]
    out = Projection(pieces=[_block("trace", mode, "trace", [*summary, *(f"//   answer {k}: {a[3]}" for k, a in enumerate(answers, 1))])])
    level = lambda di: "structural (di)" if di else "structural"
    for k, (shown, di, _, head) in enumerate(answers, 1):
        out.extra[f"{stem}.answer-{k}.projection"] = Projection(pieces=[_block(f"answer-{k}", "trace-path", "trace", shown)], facts=[confidence(level(di), head)])
    bits = [note, *(["includes dependency-inversion hops (abstract→concrete override)"] if any(a[1] for a in answers) else []), *(["crosses repo boundaries"] if any(a[2] for a in answers) else [])]
    out.facts.append(confidence(level(any(a[1] for a in answers)), "; ".join(bits)))
    if not answers:
        out.facts.append(Fact("hint", "no entrypoint path found — the method may be an entrypoint itself, dead, or only reached via reflection/proxy", "trace"))
    return out


def _target(p: Project, symbol: str, repo: str, file: str, line: int):
    """The method a trace aims at, and the line in it."""
    ms = p.methods
    if not symbol:
        near = ms.where(F.endswith("path", F.lit(file)) & F.lit(line).between(F.col("start"), F.col("end")))
        near = near.where(F.col("repo") == repo) if repo else near
        got = near.orderBy(F.desc("start"), "key").first()
        if got is None:
            raise ValueError(f"trace-to-line: could not locate {file}:{line}")
        return got, line
    owner, _, name = symbol.rpartition(".")
    order = [F.col("entry").isNotNull(), F.col("type"), F.col("key")]
    got = ms.where((F.col("name") == name) & ((F.col("type") == owner.rpartition(".")[2]) if owner else F.lit(True))).orderBy(*order).first() or ms.where(F.col("type") == name).orderBy(*order).first()
    if got is None:
        raise ValueError(f"trace-to-line: no method/type named {symbol!r} in the selected project")
    src = p.source(got.repo, got.path)
    body = range(got.start, got.end + 1)
    marks = [re.compile(rx) for _, _, rx in JAVA_MARKERS]
    telling = next((n for n in body if any(rx.search(src.code_line(n)) for rx in marks)), None) or next((n for n in body if n > got.start and re.search(r"[\w$]\s*\.\s*[\w$]+\s*\(", src.code_line(n))), got.start)
    return got, telling


def _trace_table(c: Context, p: Project, table, most: int) -> Projection:
    summary = [f"// target table: {table.name}"]
    if table.entity:
        summary.append(f"// entity {table.entity} · mapping: {table.map_note}")
    if table.migrations:
        summary.append(f"// migration: {table.migrations[0]} ({table.mig_repo})")
    answers = []
    for s in p.access.where(F.col("table") == table.name).orderBy("key", "line").collect():
        verb = "writes" if s.write else "reads"
        paths, nodes = p.paths(s.key, most)
        owner = nodes[s.key]
        for path in paths:
            shown, di, cross = _render_path(p, path, nodes, owner, s.line)
            answers.append(([*shown, f"      ↳ {verb} table {table.name}"], di, cross, f"{_headline(path, nodes, owner)} → {verb} {table.name}"))
        if not paths:
            guards = [f"    assume: {g}" for g in _guards(p, owner, s.line)]
            answers.append(([f"  {_label(owner)}   {owner.repo}/{owner.path}", *guards, located("  → " + s.code.removesuffix(";"), owner.path, s.line), f"★ {verb} {table.name}"], False, False, f"{_label(owner)} → {verb} {table.name}"))
    answers = answers[:most]
    if not answers:
        summary.append("// no repository call sites write/read this table in scope")
        return Projection(pieces=[_block("trace", "trace-to-table", "trace", summary)], facts=[confidence("structural", f"table known from {table.map_note}, but no code accesses it in scope")])
    return _answers(c, "trace-to-table", [*summary, f"// {len(answers)} path(s) reach this table"], answers, f"{len(answers)} path(s) to table {table.name}")


@lens("service-graph")
def service_graph(c: Context) -> Projection:
    raw = c.lens.get("services", default="[]")
    services = json.loads(raw)
    if not services:
        p = Project(c)
        nodes, edges = program.type_graph(p.parsed, p.lines.where("path like '%.sql'"), p.lines)
        services = [{"name": r.name, "root": r.path, "lang": "java"} for r in p.repos]
        return _graph(services, nodes, edges, "service-graph (cross-repo)", "repos", "types", "cross-repo")
    spark = c.spark
    roots = spark.createDataFrame([(s["name"], s["root"].strip("/"), s["lang"]) for s in services], "name string, root string, service_lang string")
    packages = spark.createDataFrame(list(json.loads(c.lens.get("packages", default="{}")).items()) or [("", "")], "pkg string, root string")
    nodes, edges = program.file_graph(c.files, roots, packages)
    code = source.lines(c.files).select("path", "lang", F.split_part("text", F.lit("//"), F.lit(1)).alias("text"))
    for lang in ("js", "go"):
        marks = [(k, label, to_java(rx)) for k, label, rx in LANGUAGES[lang].markers]
        part = search.kinds_by(code.where(F.col("lang") == lang), ["path"], marks, "text")
        kinds = part if lang == "js" else kinds.unionByName(part)
    nodes = nodes.join(kinds, F.col("file") == F.col("path"), "left").drop("path").withColumn("effects", F.when(F.col("kinds").isNotNull(), F.split("kinds", ",")).otherwise(F.array().cast("array<string>"))).drop("kinds")
    return _graph(services, nodes, edges, "service-graph", "services", "files", "cross-service")


def _graph(services: list[dict], nodes: DataFrame, edges: DataFrame, title: str, many: str, what: str, over: str) -> Projection:
    ns = [{k: v for k, v in r.asDict().items() if v not in ("", 0, [], None)} for r in nodes.orderBy("id").collect()]
    es = [{k: v for k, v in r.asDict().items() if v not in ("", False)} for r in edges.orderBy("from", "to", "kind", "label").collect()]
    count = lambda s: sum(n["service"] == s["name"] for n in ns)
    shown = [f"{title}: {len(services)} {many}, {len(ns)} {what}, {len(es)} edges ({sum('cross' in e for e in es)} {over})", *(f"  {s['name']:<12} {s['lang']:<4} {s['root']}  ({count(s)} {what})" for s in services)]
    told = json.dumps({"services": services, "nodes": ns, "edges": es}, ensure_ascii=False, separators=(",", ":"))
    return Projection(pieces=[Piece("service-graph", "", "graph", "service-graph", shown)], facts=[Fact("graph", told, "service-graph")])


@lens("entry-to-exit")
def entry_to_exit(c: Context) -> Projection:
    """Entrypoints from which a method with an exit call is reached, with the number of steps, for all pairs."""
    pairs = entry_to_exit_plan(c).limit(int(c.lens.get("max_pairs", default=str(MAX_PAIRS)))).collect()
    shown = [located(f"{r.entry} → {r.exit_method} ({r.steps} steps): {r.code}", r.path, r.line) for r in pairs]
    return Projection(pieces=[_block("entry-to-exit", "flows", "entry-to-exit", shown or ["// no entrypoint reaches an exit"])], facts=[Fact("count", f"{len(pairs)} flows", "entry-to-exit"), confidence("structural", "call graph scope-resolved by type+method name")])


@plan("entry-to-exit")
def entry_to_exit_plan(c: Context) -> DataFrame:
    parsed = c.parsed
    ms, ts = stored(program.methods(parsed)), stored(program.types(parsed))
    marked = source.explode(parsed.where("lang = 'java'"), "functions").where(F.exists("annotations", lambda a: a.rlike(to_java(c.lens.need("entry")))))
    entries = marked.select("path", "start").join(ms, ["path", "start"]).select("key", F.concat_ws(".", "type", "name").alias("entry_name"))
    if want := c.lens.get("entry_name"):
        entries = entries.where(F.endswith("entry_name", F.lit(want)))
    hits = search.grep(c.lines.where("lang = 'java'"), to_java(c.lens.need("exit")), "text")
    if want := c.lens.get("exit_file"):
        hits = hits.where(F.endswith("path", F.lit(want)))
    exits = stored(relate.span_join(hits.select("path", "line", F.trim("text").alias("code")), ms.select("path", "key", "type", "name", "start", "end"), ["path"], "line"))
    edges = program.dispatch_edges(program.call_sites(parsed, ms, ts), ms, ts)
    # From each exit method back over callers; all exits at once.
    up = stored(edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst")))
    back = graph.closure(up, starts=exits.select(F.col("key").alias("start")))
    reach = back.select(F.col("start").alias("key"), F.col("node").alias("from"), "depth").unionByName(exits.select("key", F.col("key").alias("from"), F.lit(0).cast("long").alias("depth")).distinct())
    found = reach.join(entries.select(F.col("key").alias("from"), F.col("entry_name").alias("entry")), "from").join(exits.select("key", "path", "line", "code", F.concat_ws(".", "type", "name").alias("exit_method")), "key")
    return found.select("entry", "exit_method", F.col("depth").alias("steps"), "path", "line", "code").distinct().orderBy("path", "line", "steps", "entry")


@lens("object-flow")
def object_flow(c: Context) -> Projection:
    """The setters called on instances of a type where they are made, in order; fields never set, or set more than once."""
    name, field = c.lens.need("type", "var"), c.lens.get("field", "method")
    sets = stored(program.object_flow(c.parsed, name))
    sets = sets.where(F.col("field") == field) if field else sets
    fields = [r[0] for r in program.types(c.parsed).where(F.col("name") == name).select(F.explode("members")).distinct().orderBy("col").collect()]
    pieces, facts, by = [], [], {}
    counted: dict = {}
    for r in program.set_counts(sets, fields).orderBy("scope", "var", "field").collect():
        counted.setdefault((r.scope, r.var), {})[r.field] = r.n
    for r in sets.orderBy("scope", "var", "at", "set_path", "line").collect():
        by.setdefault((r.scope, r.var, r.path), []).append(r)
    for (scope, var, path), rows in by.items():
        src = c.file(path)
        shown = []
        for r in rows:
            held = _held(src, r["at"])
            through = "" if r.set_path == path else f"   // through {src.line_text(r['at']).strip()}"
            shown.append(located(r.code + through + (f"   // if {' && '.join(held)}" if held else ""), r.set_path, r.line))
        label = scope.partition("::")[2].partition("#")[0]
        pieces.append(Piece(f"{label}.{var}", path, "object-flow", "object-flow", shown))
        n = counted[scope, var]
        facts += [Fact(f"{label}.{var}.{f}", "NEVER set" if not k else f"set {k} times: MORE THAN ONCE", "object-flow") for f, k in n.items() if k != 1 and (not field or f == field)]
        facts += [Fact(f"{label}.{var}.{f}.name", f"setter names no declared field of {name}", "object-flow") for f in n if fields and f not in fields]
    return Projection(pieces=pieces or [_block("object-flow", "object-flow", "object-flow", [f"// no method makes a {name} and sets it"])], facts=[*facts, confidence("structural", f"setters of {name} by variable, where it is allocated")])


def _held(src: Source, line: int) -> list[str]:
    f = next((f for f in functions(src) if f.start <= line <= f.end), None)
    return flow.guards_at(Statements(src).body(f.open, f.close), line) if f else []


# --- other sources --------------------------------------------------------------------------------------------------


@lens("jsonl")
def jsonl(c: Context) -> Projection:
    path = c.lens.input or c.lens.need("input")
    path = path if path.startswith("/") or "://" in path else f"{c.config.root}/{path}"
    rows, out = source.read_jsonl(c.spark, path if "://" in path else f"file://{path}").orderBy("n").collect(), Projection()
    for k, r in enumerate(rows, 1):
        if r.kind == "block":
            out.pieces.append(Piece(r.id or "", r.file or "", r.mode or "", r.tool or "jsonl", list(r.lines or []), list(r.facts or [])))
        elif r.kind == "fact":
            out.facts.append(Fact(r.id or "", r.text or "", r.tool or "jsonl"))
        else:
            raise ValueError(f"{path}:{k} " + (f"unknown kind {r.kind!r}" if r.kind is not None else "is no record"))
    return out


@lens("js-events")
def js_events(c: Context) -> Projection:
    rows = stored(surface_plan(c))
    pieces = []
    for r in rows.groupBy("path", "section").agg(F.array_sort(F.collect_list(F.struct("line", "ord", "shown"))).alias("x")).orderBy("path", "section").collect():
        shown = list(dict.fromkeys(x.shown for x in r.x))
        pieces.append(Piece(r.section, r.path, r.section, "js-events", shown, [f"event surface: {len(r.x)} events/listeners in {r.path}"] if r.section == "events" else []))
    n = surface_counts(rows).first()
    summary = [f"files scanned: {_scripts(c).count()}", f"event emits/dispatches: {n.emits}", f"event listeners/subscriptions: {n.listens}", f"registrations: {n.regs}", "use this lens to see composable event-driven working surface without opening full files"]
    return Projection(pieces=[*pieces, _block("summary", "summary", "js-events", summary)])


def surface_counts(rows: DataFrame) -> DataFrame:
    """(emits, listens, regs) of a surface; one row."""
    return rows.agg(F.count_if(F.col("kind").isin("emit", "dispatch")).alias("emits"), F.count_if(F.col("kind").isin("listen", "subscribe")).alias("listens"), F.count_if(F.col("section") == "registrations").alias("regs"))


def _scripts(c: Context) -> DataFrame:
    files = c.files.where("lang = 'js'")
    if c.lens.include:
        files = files.where(F.col("path").isin(*c.lens.include) | F.element_at(F.split("path", "/"), -1).isin(*(i.rpartition("/")[2] for i in c.lens.include)))
    return files


# What counts as an export, class, function, event and registration of a script.
NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)"
QUOTE = r"""['"`]"""
SURFACE = [
    ("surface", "export function", rf"^export\s+(?:async\s+)?function\s+{NAME}\s*\("),
    ("surface", "export class", rf"^export\s+class\s+{NAME}"),
    ("surface", "export value", rf"^export\s+(?!(?:async\s+)?function\b|class\b)(?:default\s+)?(?:const|let|var|type|interface|enum)?\s*{NAME}"),
    ("surface", "class", rf"^class\s+{NAME}"),
    ("surface", "function", rf"^(?:async\s+)?function\s+{NAME}\s*\("),
    ("surface", "function", rf"^(?:export\s+)?(?:const|let|var)\s+{NAME}\s*=\s*(?:async\s*)?\(?[^=]*?\)?\s*=>"),
    ("events", "emit", rf"(?:\.|\b)emit\s*\(\s*{QUOTE}([^'\"`]+){QUOTE}"),
    ("events", "dispatch", rf"(?:\.|\b)dispatchEvent\s*\(\s*(?:new\s+CustomEvent\s*\()?{QUOTE}([^'\"`]+){QUOTE}"),
    ("events", "subscribe", rf"(?:\.|\b)(?:on|once)\s*\(\s*{QUOTE}([^'\"`]+){QUOTE}"),
    ("events", "listen", rf"(?:\.|\b)addEventListener\s*\(\s*{QUOTE}([^'\"`]+){QUOTE}"),
    *(("registrations", k, rf"\b(?:core\.)?{k}\s*\(\s*{QUOTE}?([^,'\"`)\s]+)") for k in ("registerAction", "registerScene", "registerCharacter", "registerItem", "registerStat", "registerQuest", "registerMiniGame", "registerHotkey", "registerMod")),
    ("registrations", "mods.register", rf"\bmods\.register\s*\(\s*{QUOTE}?([^,'\"`)\s]+)"),
]


@plan("js-events")
def surface_plan(c: Context) -> DataFrame:
    return surface(_scripts(c))


def surface(scripts: DataFrame) -> DataFrame:
    """(path, section, kind, line, ord, shown) of scripts; functions at the left margin only."""
    lines = source.lines(scripts).withColumn("code", F.trim("text")).where("code <> '' and not startswith(code, '//')")
    found = None
    for k, (section, kind, rx) in enumerate(SURFACE):
        part = lines.where(~F.col("text").rlike(r"^\s")) if kind == "function" else lines
        part = part.select("path", "line", F.explode(F.regexp_extract_all("code", F.lit(rx), F.lit(1))).alias("name"), "code")
        head = F.trim(F.split_part("code", F.lit("{"), F.lit(1))) if section == "surface" else F.col("code")
        shown = F.concat(F.lit(kind + " "), "name", F.lit(" line="), F.col("line").cast("string"), F.lit(" :: "), head)
        part = part.select("path", F.lit(section).alias("section"), F.lit(kind).alias("kind"), "line", F.lit(k).alias("ord"), shown.alias("shown"))
        found = part if found is None else found.unionByName(part)
    return found


@lens("git-blame")
def git_blame(c: Context) -> Projection:
    file = c.lens.need("file")
    if not shutil.which("git"):
        raise RuntimeError("git-blame: git not found in PATH")
    span = c.lens.get("lines")
    a, _, b = span.partition("-")
    cut = ["-L", f"{a},{b or a}"] if a.isdigit() and (b or a).isdigit() and int(b or a) >= int(a) > 0 else []
    got = subprocess.run(["git", "blame", "--porcelain", *cut, "--", file], cwd=f"{c.config.root}/{c.lens.source_root or '.'}", capture_output=True, text=True)
    if got.returncode:
        raise RuntimeError(f"git-blame failed: {got.stderr.strip()[:200]}")
    rows = blame.from_porcelain(c.spark, got.stdout)
    shown = [located(r.code, f"{r.commit[:8]} {r.date} {r.author}", r.line) for r in rows.orderBy("line").collect()]
    authors = blame.lines_by_author(rows).orderBy("author").collect()
    return Projection(pieces=[Piece("git-blame", file, "git-blame", "git-blame", shown or [f"// no blame output for {file}"])], facts=[*(Fact(f"author-{r.author}", f"{r.author}: {r.n} lines", "git-blame") for r in authors), confidence("exact", "git blame --porcelain")])


@lens("postgres-watch")
def postgres_watch(c: Context) -> Projection:
    from . import watching

    return watching.project(c)
