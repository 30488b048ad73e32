"""Views over answers: lines of a straight-line program with what they do, write timelines, suggestions, graph filters, exports."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.code import blank
from lumenspan.functions.flow import values_in
from lumenspan.functions.languages import LANGUAGES, TEST_PATH

from .lens import Lens, Projection

_BRANCH = re.compile(r"^\s*(if|else if|switch|while|for|case)\b")
_TAGS = (("exit", re.compile(r"^\s*(return|throw)\b")), ("guard", re.compile(r"^\s*(\}?\s*else\s+)?if\b")), ("loop", re.compile(r"^\s*(for|while|do)\b")), ("catch", re.compile(r"^\s*\}?\s*(catch|finally)\b")), ("struct", re.compile(r"^\s*(try|switch|case|else)\b")))
_WRITE = re.compile(r"(?<![\w.$])([A-Za-z_$][\w$]*)\s*(?:[-+*/|&^]?=(?!=)|\+\+|--|\.(?:set|add|put|remove)\w*\s*\()")
# The kinds of edges that are exported.
EXPORTED = ("AST", "CALL", "CONTAINS", "INHERITS_FROM", "REF", "BINDS_TO", "ARGUMENT", "RECEIVER", "CFG", "SOURCE_FILE", "EVAL_TYPE")
# What names of functions score as starting points, in Go and elsewhere.
GO_STARTS = {"run": 120, "main": 100, "executelens": 90, "analyze": 80, "handle": 70, "build": 60}
STARTS = {"summary": 100, "main": 90, "handle": 80, "process": 70, "checkout": 60, "build": 50, "run": 40}


def program_lines(p: Projection) -> list[dict]:
    """The lines of a straight-line program: number, code, origin, whether it branches, its conditions, its effect, its tag."""
    effect = {int(f.id.removeprefix("se-line-")): f.text.split(" ")[0] for f in p.facts if f.id.startswith("se-line-")}
    out = []
    for piece in p.pieces:
        for k, code in enumerate(piece.lines):
            o = piece.origins[k] if k < len(piece.origins) else None
            n = len(out) + 1
            tag = next((name for name, rx in _TAGS if rx.search(code)), "")
            out.append({"n": n, "code": code.rstrip(), "origin": f"{o.file}:{o.line}" if o and o.file else "", "branch": bool(_BRANCH.match(code)), "guards": piece.guards[k] if k < len(piece.guards) else [], "effect": effect.get(n, ""), "tag": tag})
    return out


def writes(code: str) -> list[str]:
    """The variables a line writes, once each."""
    return list(dict.fromkeys(m[1] for m in _WRITE.finditer(blank(code))))


def write_timeline(lines: list[dict]) -> list[dict]:
    """Each write with its place among the writes of its variable: k of n."""
    found = [(x["n"], v) for x in lines for v in writes(x["code"])]
    seen: dict[str, int] = {}
    out = []
    for n, v in found:
        seen[v] = seen.get(v, 0) + 1
        out.append({"n": n, "var": v, "k": seen[v]})
    return [{**x, "of": seen[x["var"]]} for x in out]


_LEAVES = re.compile(r"\b(?:return|throw|break|continue)\b")


def bands(lines: list[dict]) -> list[dict]:
    """Loops, guards and catch blocks of a straight-line program, as bands of lines: from the line that opens one to the last
    that is indented deeper. A guard is an if whose band, or whose own line, leaves; writes counts the writes in a band."""
    out: list[dict] = []
    open_: list[tuple[int, dict]] = []
    for x in lines:
        code = x["code"]
        if not code.strip():
            continue
        indent = len(code) - len(code.lstrip())
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        for _, band in open_:
            band["to"] = x["n"]
            for v in writes(code):
                band["writes"][v] = band["writes"].get(v, 0) + 1
            band["leaves"] = band["leaves"] or bool(_LEAVES.search(blank(code)))
        if x["tag"] in ("loop", "guard", "catch"):
            band = {"kind": x["tag"], "from": x["n"], "to": x["n"], "writes": {}, "leaves": bool(_LEAVES.search(blank(code)))}
            out.append(band)
            open_.append((indent, band))
    return [{k: v for k, v in b.items() if k != "leaves"} for b in out if b["kind"] != "guard" or b["leaves"]]


def assumptions(p: Projection, n: int) -> dict:
    """What one line takes for granted: its conditions, and for each identifier the last write before it, k of n."""
    lines = program_lines(p)
    line, told = lines[n - 1], write_timeline(lines)
    last = {x["var"]: x for x in told if x["n"] < n}
    return {"line": line["code"], "guards": line["guards"], "identifiers": {v: (f"write {last[v]['k']} of {last[v]['of']} at line {last[v]['n']}" if v in last else "not written before") for v in values_in(line["code"])}}


def choices(p: Projection, kind: str = "choice") -> list[dict]:
    """The branches (choice) or calls (call) that can be switched."""
    return [json.loads(f.text) for f in p.facts if re.fullmatch(rf"{kind}-\d+", f.id)]


def variables(parsed: DataFrame, path: str) -> list[str]:
    """Names for completion in a file: local variables and fields, distinct and sorted."""
    one = parsed.where(F.col("path") == path)
    names = one.select(F.explode("locals.name").alias("name")).unionByName(one.select(F.explode(F.flatten("types.fields")).alias("f")).select(F.col("f.name").alias("name")))
    return [r["name"] for r in names.distinct().orderBy("name").collect()]


def suggest_entry(functions: DataFrame, language: str = "java") -> DataFrame:
    """The function a reader would start with, outside tests: by its name, and for controllers, main.go and handlers; one row."""
    points = lambda test, n: F.when(test, n).otherwise(0)
    file = F.lower(F.element_at(F.split("path", "/"), -1))
    score = points(F.contains(file, F.lit("controller")), 10) + points(file == "main.go", 20) + points(F.col("name").rlike("^Handle|Handler$"), 15)
    for name, n in (GO_STARTS if language == "go" else STARTS).items():
        score = score + points(F.lower("name") == name, n)
    return functions.where(~F.lower("path").rlike(TEST_PATH)).withColumn("score", score).orderBy(F.desc("score"), "path", "start").limit(1)


def filter_graph(g: dict, text: str = "", cross_only: bool = False, effects: Sequence[str] = ()) -> dict:
    """A graph cut down to edges that cross services, nodes that hold a text and their neighbours, nodes with some effects."""
    nodes, edges = g["nodes"], [e for e in g["edges"] if e.get("cross") or not cross_only]
    keep = {n["id"] for n in nodes if (not effects or set(effects) & set(n.get("effects", []))) and text.lower() in (n["label"] + n.get("file", "")).lower()}
    if text:
        keep |= {e["to"] for e in edges if e["from"] in keep} | {e["from"] for e in edges if e["to"] in keep}
    if cross_only:
        keep &= {e[k] for e in edges for k in ("from", "to")}
    return {**g, "nodes": [n for n in nodes if n["id"] in keep], "edges": [e for e in edges if e["from"] in keep and e["to"] in keep]}


def starting_lenses(language: str, root: str) -> list[Lens]:
    """Lenses to begin with for a tree of a language."""
    lang = LANGUAGES.get(language, LANGUAGES["java"])
    return [Lens("entrypoints", "entrypoints", root, params={"patterns": lang.entrypoints}), Lens("exitpoints", "exitpoints", root, params={"sinks": lang.sinks}), Lens("side-effects", "side-effects", root)]


def export_edges(edges: DataFrame, kind: str, path: str, kinds: Sequence[str] = EXPORTED) -> None:
    """Edges of the kinds that are exported, as compressed CSV with a header."""
    edges.where(F.col(kind).isin(*kinds)).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
