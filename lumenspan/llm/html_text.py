"""HTML extraction by wrapper induction.

Pages are parsed leniently into trees of blocks, each with a label (tag and class). A page's shape is its tree of labels, with
neighbours of one shape as one repeated node. The shapes of a host are counted over all its pages; up to SEEDS of them, the
commonest that are unlike each other, are what its pages are aligned with. Every page is aligned, by simple tree matching,
with the seed most like it: two trees match by their labels, the children of matched nodes by the best order-preserving
alignment. Over all pages of a host that makes, for each node of a seed, the texts that stand there:

* a text that SHARE or more of the pages with that node agree on is template;
* the rest of a node's text is a slot. From the root down, the main container is found by where the text in slots is: the
  walk goes on while one child holds most of it, and stops above a heading that varies, which belongs to what it heads.
  Text in links counts for nothing here, so a menu is never the container, whatever it is made of;
* nodes inside the container that vary without being the article (adverts, comments, boxes to sign up) are told by their
  labels, once for the node and by most of its pages.

A page's main text are the blocks of the container, in page order, without template texts and such nodes. Only a page that has
no wrapper, or whose tree lacks its container, is read by the tags and class names of its own.

Pages that share the longest blocks, up to half of their text, are copies and count once, so that copies of an article do not
erase each other. Nothing is sampled: all pages are counted, on the map side first; a host is a group of shapes and of node
statistics only, never of pages, so a host with a third of all rows is no large group. Children of a node are at most WIDE
after neighbours of one shape are merged (beyond, all of one label are), so a matching costs no more than WIDE ** 2 for a pair
of nodes, and pages of a shape seen before are not matched again.

Defined cases: a null page is an empty one, with empty text; a null URL or one without a host belongs to the host ''; hosts
of fewer than LEAST_PAGES different pages have no wrapper; repeated rows stay rows of their own; other columns are kept, but
the HTML, and `main_text` is replaced.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, written
from .urls import host_and_path

#: Shapes of a host that its pages are aligned with; shapes looked at for them; how alike two seeds may be.
SEEDS, CANDIDATES, ALIKE = 4, 32, 0.7
#: Different pages that a wrapper is made of at least, and that agree on a template text inside the main container.
LEAST_PAGES, LEAST_INSIDE = 3, 8
#: Share of the pages with a node that makes a text template; share of the text in slots that the walk to the container follows.
SHARE, MOST = 0.5, 0.6
#: Wrappers of all hosts together up to this many bytes are broadcast; beyond, they are joined by shuffle, and AQE splits hot hosts.
BROADCAST_BYTES = 32_000_000
DEPTH, WIDE = 60, 48

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_DIGIT = re.compile(r"\d")
_PART = re.compile(r"[a-z]+")
RAW = {"script", "style", "title", "textarea", "iframe", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "template", "noscript", "svg", "object", "canvas", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
HEADINGS = ("h1", "h2", "h3")
ASIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "sidebar", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "login",
    "signup", "search", "masthead", "copyright", "disqus", "replies", "reply", "respond", "alert", "skip", "hidden",
}
_CLOSES_P = {"address", "article", "aside", "blockquote", "details", "dd", "div", "dl", "dt", "fieldset", "figure", "figcaption", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "tr", "td", "th", "ul", "body"}
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    """A block element: its label, what is in it in order (text pieces, nodes and None where a block ends), whether its tag and
    names tell that it is beside the main text, and whether they tell a root of it."""

    __slots__ = ("aside", "groups", "id", "kids", "label", "root")

    def __init__(self, label: str, aside: bool, root: bool):
        self.label, self.aside, self.root, self.kids, self.groups, self.id = label, aside, root, [], None, 0


class Link(str):
    """A piece of text in a link."""

    __slots__ = ()


@lru_cache(4096)
def _kind(tag: str, attrs: str, inside: bool) -> tuple[str, bool, bool]:
    """(label, beside the main text, a root of main text) of an element, by its tag, attributes and whether a root is around."""
    label, names, role, hidden, body = tag, set(), "", False, False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id"):
            names.update(_PART.findall(value))
            if key == "class":
                label += "".join(f".{w}" for w in sorted({*value.split()}) if not _DIGIT.search(w))
        elif key == "role":
            role = value
        elif key == "itemprop":
            body = value == "articlebody"
        else:
            hidden = hidden or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", ""))
    aside = tag in ASIDE or role in ROLES or hidden or (tag == "header" and not inside)
    if tag not in ("html", "body") and not names & {"has", "with", "no", "without"}:
        aside = aside or bool(names & ASIDE_NAMES) or (not inside and "header" in names)
    return label, aside, tag in ("article", "main") or role == "main" or body


def parse(text: str | None) -> Node:
    top = Node("", False, False)
    # Open elements: tag, block, beside, inside a root, in a link, in something inline that is hidden or a widget, blocks around.
    stack: list[tuple[str, Node, bool, bool, bool, bool, int]] = [("", top, False, False, False, False, 0)]
    pos, text = 0, text or ""
    while m := _TOKEN.match(text, pos):
        pos = m.end()
        tag = m[2]
        _, node, aside, inside, link, mute, depth = stack[-1]
        if tag is None:
            s = m[0]
            if not mute and not s.startswith(("<!", "<?")):
                s = entities.unescape(s) if "&" in s else s
                node.kids.append(Link(s) if link else s)
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    _close(stack, i)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(text, pos)
            pos = len(text) if end is None else end.start()
            if end is not None:
                close = text.find(">", pos)
                pos = len(text) if close < 0 else close + 1
            continue
        if tag == "br":
            node.kids.append(" ")
        if tag in VOID and tag != "hr":
            continue
        if tag in _CLOSES:
            close, stop = _CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in stop:
                    break
                if stack[i][0] in close:
                    _close(stack, i)
                    break
        elif tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    _close(stack, i)
                    break
                if stack[i][0] in ("td", "th", "li", "div", "article", "section", "body", "button"):
                    break
        _, node, aside, inside, link, mute, depth = stack[-1]
        if tag == "hr":
            node.kids.append(None)
            continue
        label, beside, root = _kind(tag, m[3], inside)
        if tag not in INLINE:
            if depth < DEPTH:
                block = Node(label, aside or beside, root and not (aside or beside))
                node.kids.append(block)
                node = block
            else:
                node.kids.append(None)
            depth += 1
        else:
            mute = mute or beside
        if m[3].endswith("/") and tag in INLINE:
            continue
        stack.append((tag, node, aside or beside, inside or root, link or tag == "a", mute, depth))
    return top


def _close(stack: list, i: int) -> None:
    """Ends the open elements from the i-th on; a block too deep to be a node of its own ends the text before it."""
    for _, node, *_, depth in stack[i:]:
        if depth > DEPTH:
            node.kids.append(None)
    del stack[i:]


def shaped(top: Node) -> tuple | None:
    """The shape (label, shapes of children) of a tree, whose nodes are told their place in it, counted from the top in order;
    None of a tree without text."""
    shape = _shape(top)
    if shape is not None:
        _place([top], shape, 0)
    return shape


def _shape(node: Node) -> tuple | None:
    """The shape of a node; None if there is no text in it. Sets which of its children are one node of the shape."""
    groups: list[list] = []  # shape, nodes
    text = False
    for kid in node.kids:
        if not isinstance(kid, Node):
            text = text or bool(kid and not kid.isspace())
        elif (s := _shape(kid)) is not None:
            if groups and groups[-1][0] == s:
                groups[-1][1].append(kid)
            else:
                groups.append([s, [kid]])
    if not text and not groups:
        return None
    if len(groups) > WIDE:  # what is below them is no longer told apart
        for of in (lambda n: n.label, lambda n: n.label.partition(".")[0]):
            by: dict[str, list] = defaultdict(list)
            for _, nodes in groups:
                for n in nodes:
                    by[of(n)].append(n)
            groups = [[(k, ()), nodes] for k, nodes in by.items()]
            if len(groups) <= WIDE:
                break
    node.groups = groups
    return (node.label, tuple(s for s, _ in groups))


def _place(nodes: list[Node], shape: tuple, at: int) -> int:
    """Tells nodes of one shape, and those below, their number; returns the next number."""
    for n in nodes:
        n.id = at
    at += 1
    for k, kid in enumerate(shape[1]):
        at = _place([x for n in nodes for x in n.groups[k][1]], kid, at)
    if not shape[1]:
        for n in nodes:
            _sink(n, n.id)
    return at


def _sink(node: Node, at: int) -> None:
    todo = [node]
    while todo:
        n = todo.pop()
        n.id = at
        todo += [k for k in n.kids if isinstance(k, Node)]


def blocks(top: Node) -> list[tuple[Node, str, int, tuple[int, ...]]]:
    """(node, text, characters of it in links, roots around) of the blocks, in page order; a block that holds others is cut
    where they stand."""
    out: list[tuple[Node, str, int, tuple[int, ...]]] = []
    todo: list[tuple[Node, int, tuple[int, ...]]] = [(top, 0, ())]
    n_roots = 0
    while todo:
        node, at, roots = todo.pop()
        pieces: list[str] = []

        def told(node=node, roots=roots, pieces=pieces):
            if pieces and (s := " ".join("".join(pieces).split())):
                out.append((node, s, min(len(s), sum(len(x) for x in pieces if isinstance(x, Link))), roots))
            pieces.clear()

        for i in range(at, len(node.kids)):
            kid = node.kids[i]
            if kid is None:
                told()
            elif isinstance(kid, str):
                pieces.append(kid)
            else:
                told()
                todo.append((node, i + 1, roots))
                around = roots
                if kid.root:
                    around, n_roots = (*roots, n_roots), n_roots + 1
                todo.append((kid, 0, around))
                break
        else:
            told()
    return out


def _digest(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def identity(texts: list[str]) -> int:
    """Digest of the longest texts, as many as make up half of all."""
    half, held = sum(map(len, texts)) / 2, 0
    longest = sorted(texts, key=lambda s: (-len(s), s))
    for k, s in enumerate(longest):
        held += len(s)
        if held >= half:
            return _digest("\n".join(sorted(longest[: k + 1])))
    return _digest("")


@lru_cache(100_000)
def size(shape: tuple) -> int:
    return 1 + sum(map(size, shape[1]))


def match(a: tuple, b: tuple) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two shapes with equal labels at the top: (matched nodes, their pairs, by place)."""

    def run(a: tuple, at_a: int, b: tuple, at_b: int) -> tuple[int, list]:
        x, y = a[1], b[1]
        xs, ys = _places(a, at_a), _places(b, at_b)
        score = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        taken: dict[tuple[int, int], list] = {}
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                best = max(score[i - 1][j], score[i][j - 1])
                if x[i - 1][0] == y[j - 1][0]:
                    n, below = run(x[i - 1], xs[i - 1], y[j - 1], ys[j - 1])
                    if score[i - 1][j - 1] + n > best:
                        best, taken[i, j] = score[i - 1][j - 1] + n, below
                score[i][j] = best
        out, i, j = [(at_a, at_b)], len(x), len(y)
        while i and j:
            if score[i][j] == score[i - 1][j]:
                i -= 1
            elif score[i][j] == score[i][j - 1]:
                j -= 1
            else:
                out += taken[i, j]
                i, j = i - 1, j - 1
        return score[-1][-1] + 1, out

    return run(a, 0, b, 0)


def _places(shape: tuple, at: int) -> list[int]:
    out, at = [], at + 1
    for kid in shape[1]:
        out.append(at)
        at += size(kid)
    return out


def likeness(a: tuple, b: tuple) -> float:
    """Matched nodes, as a share of those of both trees."""
    return 2 * match(a, b)[0] / (size(a) + size(b))


@lru_cache(2048)
def aligned(shape: tuple, seeds: tuple) -> tuple[int, dict[int, int]]:
    """(seed most like the shape, the place in it of each matched node of the shape)."""
    k = max(range(len(seeds)), key=lambda k: (likeness(shape, seeds[k]), -k))
    return k, dict(match(shape, seeds[k])[1])


def _tuples(shape: list) -> tuple:
    return (shape[0], tuple(map(_tuples, shape[1])))


def pick_seeds(shapes: list[tuple[tuple, int]]) -> list[tuple]:
    """Of a host's shapes with their numbers of pages: the commonest that are unlike each other."""
    out: list[tuple] = []
    for shape, _ in sorted(shapes, key=lambda x: (-x[1], json.dumps(x[0]))):
        if len(out) < SEEDS and all(likeness(shape, s) < ALIKE for s in out):
            out.append(shape)
    return out


def induce(seeds: list[tuple], texts: list[dict], nodes: list[dict]) -> dict:
    """The wrapper of a host: for each seed its shape, of which the nodes without slots are template, as are the template texts
    by node; where the slots are; the main container; and the nodes beside the main text.

    texts: seed, node, digest, n (different pages that have the text there), of those that LEAST_PAGES or more have; nodes:
    seed, node, pages, and chars, link and aside, the characters of all its texts, those in links, those told to be beside."""
    out = []
    for k, seed in enumerate(seeds):
        own = {r["node"]: r for r in nodes if r["seed"] == k}
        pages = own.get(-1, {}).get("pages", 0)
        if pages < LEAST_PAGES:
            out.append(None)
            continue
        same = defaultdict(list)
        fixed: Counter[int] = Counter()
        for r in texts:
            if r["seed"] == k and r["n"] >= max(LEAST_PAGES, SHARE * own[r["node"]]["pages"]):
                same[r["node"]].append(r)
                fixed[r["node"]] += r["chars"] - r["link"]
        beside = {i for i, r in own.items() if i >= 0 and 2 * r["aside"] > r["chars"]}
        slot = lambda i: 0 if i in beside or i not in own else max(0, own[i]["chars"] - own[i]["link"] - fixed[i])
        main = _container(seed, slot)
        inside = {i for i in range(main, main + size(_at(seed, main)))}
        template = {i: sorted(r["digest"] for r in rs if r["n"] >= (LEAST_INSIDE if i in inside else LEAST_PAGES)) for i, rs in same.items()}
        slots = [i for i in range(size(seed)) if slot(i)]
        out.append({"shape": seed, "slots": slots, "main": main, "template": {str(i): t for i, t in sorted(template.items()) if t}, "beside": sorted(beside)})
    return {"seeds": out} if any(out) else {}


def _at(shape: tuple, place: int) -> tuple:
    while place:
        k, at = max((k, at) for k, at in enumerate(_places(shape, 0)) if at <= place)
        shape, place = shape[1][k], place - at
    return shape


def _container(seed: tuple, slot) -> int:
    """The place of the node that the walk along the text in slots ends at."""

    @lru_cache(None)
    def mass(shape: tuple, at: int) -> int:
        return slot(at) + sum(mass(s, p) for s, p in zip(shape[1], _places(shape, at), strict=True))

    shape, at = seed, 0
    while shape[1]:
        kids = list(zip(shape[1], _places(shape, at), strict=True))
        best, place = max(kids, key=lambda x: (mass(*x), -x[1]))
        heads = any(s[0].partition(".")[0] in HEADINGS and slot(p) for s, p in kids)
        # A node without blocks below is the text itself: what holds it is the container.
        if heads or not best[1] or mass(best, place) < MOST * mass(shape, at) or not mass(best, place):
            break
        shape, at = best, place
    return at


@lru_cache(512)
def _wrapper(told: str) -> tuple[tuple, list]:
    """(shapes of the seeds that have a wrapper, those as (main, places inside, template, beside))."""
    made = [s for s in json.loads(told).get("seeds", []) if s]
    shapes = tuple(_tuples(s["shape"]) for s in made)
    return shapes, [(s["main"], range(s["main"], s["main"] + size(_at(shape, s["main"]))), {int(i): frozenset(t) for i, t in s["template"].items()}, frozenset(s["beside"])) for s, shape in zip(made, shapes, strict=True)]


def main_text(page: str | None, wrapper: str = "{}") -> str:
    """The main text of a page by the wrapper of its host; by the page's own tags where that has none for it."""
    top = parse(page)
    shapes, seeds = _wrapper(wrapper)
    found = blocks(top)
    if shapes and found:
        k, places = aligned(shaped(top), shapes)
        main, inside, template, beside = seeds[k]
        if main in places.values():
            at = _inherited(top, places)
            kept = []
            for node, s, _, _ in found:
                place, exact = at[id(node)]
                if place in inside and _digest(s) not in template.get(place, ()) and not (place in beside if exact else node.aside):
                    kept.append(s)
            if kept:
                return " ".join(kept)
    return _by_tags(found)


def _inherited(top: Node, places: dict[int, int]) -> dict[int, tuple[int, bool]]:
    """For each node its place in the seed, or that of the nearest node around it which has one, and which of the two it is."""
    out: dict[int, tuple[int, bool]] = {}
    todo = [(top, 0, True)]
    while todo:
        node, place, _ = todo.pop()
        exact = node.id in places
        place = places.get(node.id, place)
        out[id(node)] = place, exact
        todo += [(k, place, exact) for k in node.kids if isinstance(k, Node)]
    return out


def _by_tags(found: list[tuple[Node, str, int, tuple[int, ...]]]) -> str:
    """The text of the largest article or main element, or else of all blocks, that tags and names don't tell to be beside it."""
    found = [x for x in found if not x[0].aside]
    held: Counter[int] = Counter()
    for _, s, _, roots in found:
        for r in roots:
            held[r] += len(s)
    if held:
        root = max(held, key=lambda r: (held[r], -r))
        found = [x for x in found if root in x[3]]
    return " ".join(s for _, s, _, _ in found)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to (host, shape as JSON, pages), counted in the task."""
    counts: Counter[tuple[str, str]] = Counter()

    def told():
        if counts:
            keys, n = zip(*counts.items(), strict=True)
            yield pa.record_batch([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(n, pa.int64())], names=["host", "shape", "n"])
            counts.clear()

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (s := shaped(parse(page))) is not None:
                counts[host, json.dumps(s, separators=(",", ":"), ensure_ascii=False)] += 1
        if len(counts) > 10_000:
            yield from told()
    yield from told()


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [json.dumps([s for s in pick_seeds([(_tuples(json.loads(x["shape"])), x["n"]) for x in shapes])], separators=(",", ":"), ensure_ascii=False) for shapes in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(told, pa.string())], names=["s_host", "seeds"])


@lru_cache(512)
def _seeds(told: str) -> tuple:
    return tuple(map(_tuples, json.loads(told)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, seeds) to (host, seed, node, digest, ident, chars, link, aside): a row for each text at a node of a seed, and one
    of node -1 for the page."""
    for batch in batches:
        cols: list[list] = [[] for _ in range(8)]
        for host, page, seeds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            top = parse(page)
            if (shape := shaped(top)) is None:
                continue
            k, places = aligned(shape, _seeds(seeds))
            found = blocks(top)
            ident = identity([s for _, s, _, _ in found])
            rows: dict[tuple[int, int], tuple] = {(-1, 0): (0, 0, 0)}
            for node, s, link, _ in found:
                if node.id in places:
                    rows[places[node.id], _digest(s)] = (len(s), link, len(s) if node.aside else 0)
            for (place, digest), counted in rows.items():
                for c, v in zip(cols, (host, k, place, digest, ident, *counted), strict=True):
                    c.append(v)
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        for i in range(0, len(cols[0]), 50_000):
            yield pa.record_batch([pa.array(c[i : i + 50_000], t) for c, t in zip(cols, kinds, strict=True)], names=["host", "seed", "node", "digest", "ident", "chars", "link", "aside"])


def _induced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [json.dumps(induce(list(_seeds(seeds)), texts or [], nodes or []), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for _, seeds, texts, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(told, pa.string())], names=["w_host", "wrapper"])


def _near(rows: DataFrame, host: Column) -> DataFrame:
    """rows of hosts, to join: broadcast if they are few bytes."""
    told = [c for c in rows.columns if not c.endswith("host")][0]
    n = rows.agg(F.sum(F.octet_length(told) + F.octet_length(host))).first()[0] or 0
    return F.broadcast(rows) if n <= BROADCAST_BYTES else rows


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, html) to (w_host, wrapper as JSON), one row a host."""
    pages = pages.where("html is not null")
    shapes = pages.mapInArrow(_shapes, "host string, shape string, n long").groupBy("host", "shape").agg(F.sum("n").alias("n"))
    common = shapes.withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "shape"))).where(F.col("k") <= CANDIDATES)
    seeds = written(common.groupBy("host").agg(F.collect_list(F.struct("shape", "n")).alias("shapes")).mapInArrow(_picked, "s_host string, seeds string"))  # CANDIDATES at most
    met = pages.join(_near(seeds, F.col("s_host")), F.col("host") == F.col("s_host")).select("host", "html", "seeds")
    kinds = "host string, seed int, node int, digest long, ident long, chars long, link long, aside long"
    at = ["host", "seed", "node"]
    # Each text of a page at a node once, copies of the page included.
    each = met.mapInArrow(_texts, kinds).groupBy(*at, "digest", "ident").agg(*(F.max(c).alias(c) for c in ("chars", "link", "aside")))
    each = written(each)
    texts = each.where("node >= 0").groupBy(*at, "digest").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("link").alias("link")).where(F.col("n") >= LEAST_PAGES)
    nodes = each.groupBy(*at).agg(F.count_distinct("ident").alias("pages"), *(F.sum(c).alias(c) for c in ("chars", "link", "aside")))
    # Few texts of a node can be on half of its pages or more; the others are never collected.
    texts = texts.join(nodes.select(*at, "pages"), at).where(F.col("n") >= SHARE * F.col("pages")).drop("pages")
    own = lambda rows: F.collect_list(F.struct(*(c for c in rows.columns if c != "host")))
    told = seeds.join(nodes.groupBy(F.col("host").alias("s_host")).agg(own(nodes).alias("nodes")), "s_host").join(texts.groupBy(F.col("host").alias("s_host")).agg(own(texts).alias("texts")), "s_host", "left")
    return told.select("s_host", "seeds", "texts", "nodes").mapInArrow(_induced, "w_host string, wrapper string")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages without the HTML, with `main_text`."""
    own = [c for c in pages.columns if c != html_col and c.lower() != "main_text"]
    base = pages.select(F.struct(*map(quoted, own)).alias("own"), host_and_path(F.col(url_col))[0].alias("host"), F.col(html_col).alias("html"))
    made = written(wrappers(base.select("host", "html")))

    @F.arrow_udf("string")
    def run(html: pa.Array, wrapper: pa.Array) -> pa.Array:
        return pa.array([main_text(h, w) for h, w in zip(html.to_pylist(), wrapper.to_pylist(), strict=True)], pa.string())

    met = base.join(_near(made, F.col("w_host")), F.col("host") == F.col("w_host"), "left")
    return met.select("own", run(F.col("html"), F.coalesce("wrapper", F.lit("{}"))).alias("main_text")).select("own.*", "main_text")


def op8_main_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
