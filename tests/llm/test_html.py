"""Wrapper induction against plain versions of its parts, and what the wrapper alone decides."""

import random
import re
from collections import defaultdict
from functools import lru_cache

import pandas as pd
import pytest

from lumenspan.llm import html_text as H

PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a><li>About</ul></nav><div id=wrap class="page has-sidebar">
<header><h2>Site</h2></header><script>var x = "<p>no</p>";</script><div class="content"><h1>{t} &amp; more</h1><p>First <b>bold</b>text
of&nbsp;it<br>line {t}<p>Second &lt;tag&gt;<!-- <p>gone</p> --><ul><li>one<li>two {t}</ul></div><div class="sidebar">Other things to see</div><div class=ad>Buy {t}!</div>
<section id="comments"><article class="comment"><p>Nice one</p></article></section><div class="blurb">About this site and its makers</div></div><form><p>Send</p></form><footer>(c)</footer></body></html>"""
WANT = "{t} & more First boldtext of it line {t} Second <tag> one two {t}"


def test_html_of_a_host(spark):
    names = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    rows = [(i, f"http://h.org/{t}", PAGE.format(t=t)) for i, t in enumerate(names)] + [(90, None, None), (91, "http://h.org/", ""), (92, "x", "plain <b>text"), (0, "http://h.org/alpha", PAGE.format(t="alpha"))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, main_text2 int")
    got = sorted(H.extract(df).collect(), key=str)
    by = defaultdict(set)
    for r in got:
        by[r.page_id].add(r.main_text)
    assert len(got) == len(rows)
    for i, t in enumerate(names):
        assert by[i] == {WANT.format(t=t)}
    assert by[90] == {""} and by[91] == {""} and by[92] == {"plain text"}
    assert H.extract(df.limit(0)).count() == 0


def test_article_and_its_asides():
    page = "<body><nav>menu</nav><main><article><header><h1>Title</h1></header><p>Body one.</p><aside>See also</aside><div class='share-buttons'>Share</div><p>Body two.</p><div hidden>x</div></article><div class=comments><p>hm</p></div></main></body>"
    assert H.main_text(page) == "Title Body one. Body two."
    assert H.main_text("<div>" * 3000 + "deep" + "</p></div>") == "deep"
    assert H.main_text("a < b & c &lt; d <") == "a < b & c < d <"


def test_copies_of_an_article_stay(spark):
    same = "<body><nav>m{n}</nav><article><h1>Same</h1><p>Same text.</p></article></body>"
    rows = [(i, "http://c.org/", same.format(n=i)) for i in range(12)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.main_text for r in got} == {"Same Same text."}


def induced(pages):
    """host -> wrapper as JSON, from (host, html) rows by plain loops."""
    shapes, out = defaultdict(lambda: defaultdict(int)), {}
    for host, page in pages:
        if (s := H.shaped(H.parse(page))) is not None:
            shapes[host][s] += 1
    for host, counts in shapes.items():
        most = sorted(counts.items(), key=lambda x: (-x[1], H.json.dumps(x[0], separators=(",", ":"), ensure_ascii=False)))[: H.CANDIDATES]
        seeds = H.pick_seeds(most)
        at, pages_with = defaultdict(dict), defaultdict(set)
        for h, page in pages:
            top = H.parse(page)
            if h != host or (shape := H.shaped(top)) is None:
                continue
            k, places = H.aligned(shape, tuple(seeds))
            found = H.blocks(top)
            ident = H.identity([s for _, s, _, _ in found])
            pages_with[k, -1].add(ident)
            for node, s, link, _ in found:
                if node.id in places:
                    pages_with[k, places[node.id]].add(ident)
                    had = at[k, places[node.id]].get((s, ident), (0, 0, 0))
                    at[k, places[node.id]][s, ident] = tuple(map(max, had, (len(s), link, len(s) if node.aside else 0)))
        nodes, texts = [], []
        for (k, node), idents in pages_with.items():
            rows = at[k, node]
            nodes.append({"seed": k, "node": node, "pages": len(idents), **{c: sum(v[i] for v in rows.values()) for i, c in enumerate(("chars", "link", "aside"))}})
            by = defaultdict(list)
            for (s, _), v in rows.items():
                by[s].append(v)
            texts += [{"seed": k, "node": node, "digest": H._digest(s), "n": len(v), "chars": sum(x[0] for x in v), "link": sum(x[1] for x in v)} for s, v in by.items() if len(v) >= max(H.LEAST_PAGES, H.SHARE * len(idents))]
        out[host] = H.json.dumps(H.induce(seeds, texts, nodes), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return out


def table(sf):
    p = pd.read_parquet(f"{sf}/pages.parquet")
    return [(re.match(r"[^/?#]*", u.partition("://")[2])[0].lower(), h) for u, h in zip(p.url, p.html, strict=True)]


def article(page):
    """The text of a page of the tables, by what is known of how they are made."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", inner)
    return " ".join(x for x in (" ".join(H.entities.unescape(re.sub(r"<!--.*?-->", "", re.sub("<br>", " ", y)).replace("<b>", "").replace("</b>", "")).split()) for y in parts) if x)


def test_wrappers_like_plain_ones(spark, sf_dir):
    pages = table(sf_dir.replace("sf0.001", "sf0.01")) + [("many.org", PAGE.format(t=t)) for t in "abcdefghijkl"] + [("none.org", "")]
    want = induced(pages)
    got = {r.w_host: r.wrapper for r in H.wrappers(spark.createDataFrame(pages, "host string, html string").repartition(5)).collect()}
    assert got == want


def test_text_comes_by_the_wrapper(sf_dir, monkeypatch):
    """With tags and names told nothing, the wrappers of the tables alone find the article; without them, much else stays."""
    pages = table(sf_dir.replace("sf0.001", "sf0.1"))
    kind = H._kind
    monkeypatch.setattr(H, "_kind", lambda *x: (kind(*x)[0], False, False))
    made = induced(pages)
    want = [article(h) for _, h in pages]
    right = sum(H.main_text(h, made[host]) == w for (host, h), w in zip(pages, want, strict=True))
    assert right >= 0.99 * len(pages)
    assert sum(H.main_text(h) == w for (_, h), w in zip(pages, want, strict=True)) == 0
    assert sum(len(H.json.loads(w)["seeds"][0]["shape"]) > 0 for w in made.values() if w != "{}") == len(made)


PLAIN = """<html><body><div><p>Our site</p><p><a href=/>Home</a> <a href=/n>News</a></p></div><div><div><p>Read this first, as all of our many readers do.</p></div>
<div><h1>{h}</h1><p>{a}</p><p>Tell your friends about us today.</p><p>{b}</p>{extra}</div><div><p>{small}</p></div></div><div><p>Made by us, all rights are with us and only us.</p></div></body></html>"""


def test_ablation(spark):
    """A host without telling tags or names: only the wrapper cuts what its pages share, and what varies beside the article."""
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    told = [(text(4), text(40), text(30), text(3), f"<ul><li>{text(9)}</li></ul>" if i % 3 else "") for i in range(20)]
    pages = [(i, "http://plain.org/x", PLAIN.format(h=h, a=a, b=b, small=small, extra=e)) for i, (h, a, b, small, e) in enumerate(told)]
    got = {x.page_id: x.main_text for x in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, (h, a, b, small, e) in enumerate(told):
        assert got[i] == " ".join(x for x in (h, a, b, re.sub("<[^>]*>", "", e)) if x)
        without = H.main_text(pages[i][2])
        assert without != got[i] and small in without and "Home" in without and "Tell your friends" in without


def test_two_layouts_and_a_notice_on_most_pages(spark):
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    one = "<body><div><p>Top of it</p></div><div><h1>{h}</h1><p>{a}</p>{n}<p>{b}</p></div><div><ul><li><a>{s}</a><li><a>x{s}</a></ul></div></body>"
    two = "<body><table><tr><td><span><a>{s}</a></span></td></tr></table><section><div><p>{s}</p></div><div><h2>{h}</h2><blockquote>{a}</blockquote>{n}<blockquote>{b}</blockquote></div></section><div><p>End of it</p></div></body>"
    rows, want = [], {}
    for i in range(60):
        h, a, b, s = text(3), text(40), text(20), text(2)
        tag = "p" if i % 2 else "blockquote"
        n = f"<{tag}>We hope that you like what you read</{tag}>" if i % 10 else ""
        rows.append((i, "http://two.org/", (one if i % 2 else two).format(h=h, a=a, b=b, s=s, n=n)))
        want[i] = f"{h} {a} {b}"
    got = {x.page_id: x.main_text for x in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def brute_match(a, b):
    """Most nodes that can be matched: any order-preserving choice of pairs of children, tried one by one."""
    @lru_cache(None)
    def best(x, y):
        if not x or not y:
            return 0
        out = max(best(x[1:], y), best(x, y[1:]))
        if x[0][0] == y[0][0]:
            out = max(out, brute_match(x[0], y[0]) + best(x[1:], y[1:]))
        return out

    return 1 + best(a[1], b[1])


def test_tree_matching_against_brute_force():
    r = random.Random(9)

    def tree(depth):
        return (r.choice("ab"), tuple(tree(depth - 1) for _ in range(r.randint(0, 4))) if depth else ())

    def walk(t, at=0):
        yield at, t
        for s, p in zip(t[1], H._places(t, at), strict=True):
            yield from walk(s, p)

    for _ in range(200):
        a, b = ("", tree(3)[1]), ("", tree(3)[1])
        n, pairs = H.match(a, b)
        assert n == len(pairs) == brute_match(a, b)
        x, y = dict(walk(a)), dict(walk(b))
        assert len({p for p, _ in pairs}) == len({q for _, q in pairs}) == n
        assert all(x[p][0] == y[q][0] and x[p] == H._at(a, p) for p, q in pairs)


def test_wide_and_deep_pages_stay_cheap():
    wide = "<body><div><h1>{t}</h1>" + "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}><p>{{t}} {i}</p><ul><li>x</ul></div><p>y</p>" for i in range(20_000)) + "</div></body>"
    shapes = [H.shaped(H.parse(wide.format(t=t))) for t in "ab"]
    assert H.size(shapes[0]) < 200 and H.likeness(*shapes) == 1.0
    assert H.main_text("<div>" * 3000 + "deep" + "</div>" * 2990 + "er") == "deep er"
    top = H.parse("<div>a" * 100 + "<p>b" + "</div>c" * 100)
    assert " ".join(s for _, s, _, _ in H.blocks(top)) == " ".join(["a"] * 100 + ["b"] + ["c"] * 100)
    assert H.shaped(top) is not None


@pytest.mark.parametrize("bound", [32_000_000, -1])
def test_clashing_columns(spark, monkeypatch, bound):
    monkeypatch.setattr(H, "BROADCAST_BYTES", bound)
    rows = [(i, "http://h.org/", PAGE.format(t=t), 1, "w", "x") for i, t in enumerate(("alpha", "beta", "gamma", "delta"))]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, own int, wrapper string, host string"))
    assert got.columns == ["page_id", "url", "own", "wrapper", "host", "main_text"]
    assert {r.main_text for r in got.collect()} == {WANT.format(t=t) for t in ("alpha", "beta", "gamma", "delta")}
