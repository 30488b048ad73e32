"""A service graph as a page of its own, as Mermaid text, and cut down to what has effects."""

from __future__ import annotations

import html
import json
import re

from .lens import Projection


def graph_of(p: Projection) -> dict:
    return json.loads(p.fact("graph") or '{"services":[],"nodes":[],"edges":[]}')


def effect_subgraph(g: dict) -> dict:
    """Nodes with effects, and those one edge away."""
    core = {n["id"] for n in g["nodes"] if n.get("effects")}
    near = core | {e["to"] for e in g["edges"] if e["from"] in core} | {e["from"] for e in g["edges"] if e["to"] in core}
    return {"services": g["services"], "nodes": [n for n in g["nodes"] if n["id"] in near], "edges": [e for e in g["edges"] if e["from"] in near and e["to"] in near]}


def legend(g: dict) -> dict[str, int]:
    out: dict[str, int] = {}
    for n in g["nodes"]:
        for k in n.get("effects", []):
            out[k] = out.get(k, 0) + 1
    return dict(sorted(out.items()))


def mermaid(g: dict) -> str:
    ids = {n["id"]: f"n{k}" for k, n in enumerate(g["nodes"])}
    quote = lambda s: s.replace('"', "'")
    out = ["graph LR"]
    for s in sorted({n.get("service", "") for n in g["nodes"]}):
        out.append(f'  subgraph "{quote(s)}"')
        out += [f'    {ids[n["id"]]}["{quote(n["label"])}"]' for n in g["nodes"] if n.get("service", "") == s]
        out.append("  end")
    out += [f"  {ids[e['from']]} {'-.->' if e.get('cross') else '-->'}{('|' + quote(e['label']) + '|') if e.get('label') else ''} {ids[e['to']]}" for e in g["edges"] if e["from"] in ids and e["to"] in ids]
    return "\n".join(out) + "\n"


def svg(g: dict) -> str:
    """Services as columns, nodes down each, edges as curves."""
    services = sorted({n.get("service", "") for n in g["nodes"]})
    at, depth = {}, dict.fromkeys(services, 0)
    for n in sorted(g["nodes"], key=lambda n: n["id"]):
        s = n.get("service", "")
        at[n["id"]] = (40 + services.index(s) * 280, 60 + depth[s] * 36)
        depth[s] += 1
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{80 + 280 * len(services)}" height="{100 + 36 * max(depth.values(), default=0)}" font-family="sans-serif" font-size="12">']
    for e in g["edges"]:
        if e["from"] in at and e["to"] in at:
            (a, b), (c, d) = at[e["from"]], at[e["to"]]
            out.append(f'<path d="M{a + 200},{b} C{a + 240},{b} {c - 40},{d} {c},{d}" fill="none" stroke="{"#c33" if e.get("cross") else "#999"}"/>')
    out += [f'<text x="{40 + k * 280}" y="30" font-weight="bold">{html.escape(s)}</text>' for k, s in enumerate(services)]
    for n in g["nodes"]:
        x, y = at[n["id"]]
        out.append(f'<rect x="{x}" y="{y - 12}" width="200" height="24" rx="4" fill="{"#fde" if n.get("effects") else "#eef"}" stroke="#668"/><text x="{x + 8}" y="{y + 4}">{html.escape(n["label"][:28])}</text>')
    return "".join(out) + "</svg>"


def markdown(text: str) -> str:
    """Headings, lists, code fences, bold and code of Markdown as HTML."""
    out, fence, items = [], None, False
    inline = lambda s: re.sub(r"\*\*(.+?)\*\*", r"<b>\1</b>", re.sub(r"`([^`]+)`", r"<code>\1</code>", html.escape(s, quote=False)))
    for line in text.splitlines():
        if line.startswith("```"):
            out += ["<pre>" + html.escape("\n".join(fence)) + "</pre>"] if fence is not None else []
            fence = [] if fence is None else None
            continue
        if fence is not None:
            fence.append(line)
            continue
        item = re.match(r"\s*[-*] (.*)", line)
        if items and not item:
            out.append("</ul>")
        if item:
            out += [*(["<ul>"] if not items else []), f"<li>{inline(item[1])}</li>"]
        elif m := re.match(r"(#+) (.*)", line):
            slug = re.sub(r"[^a-z0-9]+", "-", m[2].lower()).strip("-")
            out.append(f'<h{len(m[1])} id="{slug}">{inline(m[2])}</h{len(m[1])}>')
        elif line.strip():
            out.append(f"<p>{inline(line)}</p>")
        items = bool(item)
    return "\n".join([*out, *(["</ul>"] if items else [])])


def page(p: Projection, notes: str = "") -> str:
    """A page that needs nothing else: the graph drawn, its legend, notes, and the data."""
    g = graph_of(p)
    rows = "".join(f"<li>{html.escape(k)}: {n}</li>" for k, n in legend(g).items())
    data = json.dumps(g, ensure_ascii=False).replace("</", "<\\/")
    head = html.escape(p.pieces[0].lines[0] if p.pieces else "")
    return f'<!doctype html><html><head><meta charset="utf-8"><title>Service graph</title></head><body><h1>Service graph</h1><p>{head}</p><ul>{rows}</ul>{svg(g)}{markdown(notes)}<script type="application/json" id="graph">{data}</script></body></html>'
