import random

import pytest

from lumenspan.llm import decontaminate as D


def distance_in(pattern, text):
    """Least edits of pattern against any stretch of text, by the plain table."""
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(prev[j - 1] + (c != t), prev[j] + 1, row[-1] + 1))
        prev = row
    return min(prev)


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        i = r.randrange(len(s))
        kind = r.randrange(3)
        if kind == 0:
            s[i] = r.choice("abcde ")
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, r.choice("abcde "))
    return "".join(s)


@pytest.mark.parametrize("seed", range(6))
def test_same_as_plain_table(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.randint(1, 30))) for i in range(12)]
    matcher = D.Matcher(items, 0.1)
    for _ in range(40):
        s = text(40) + " " + edited(r, r.choice(items)[1], r.randint(0, 12)) + " " + text(10)
        want = {}
        for i, t in items:
            p, n = D.normal(t), D.normal(s)
            if (d := distance_in(p, n)) <= int(0.1 * len(p)):
                want[i] = d
        got = {i: d for i, d, a, b in matcher.search(s)}
        assert got.keys() == want.keys()
        assert all(got[i] == want[i] for i in got)
        for i, d, a, b in matcher.search(s):
            assert distance_in(D.normal(items[i][1]), D.normal(s)[a:b]) == d


@pytest.mark.parametrize("block", [1_000_000, -1])
def test_defined_cases(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_CHARS", block)
    item = "The quick brown fox jumps over the lazy dog and then it sleeps for a while."
    docs = spark.createDataFrame(
        [(1, "x " + item.upper() + " y", 0), (1, "x " + item.upper() + " y", 0), (None, item.replace("lazy", "lazzy"), 0), (3, None, 0), (4, "", 0), (5, "word " * 100_000 + item, 0), (6, "the quick brown fox", 0)],
        "doc_id long, text string, item_id int",
    )
    items = spark.createDataFrame([(7, item), (7, item), (None, item), (8, "..."), (9, None)], "item_id long, text string")
    got = D.find_leaks(docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0, r.edits) for r in got) == sorted((d, i, e) for d, e in ((1, 0), (1, 0), (0, 1), (5, 0)) for i in (7, 7, 0))
    assert sorted(r.doc_id for r in D.leak_free(docs, items).collect()) == [3, 4, 6]
    assert D.find_leaks(docs, items.limit(0)).count() == 0
    assert D.leak_free(docs, items.limit(0)).count() == 7
    assert D.find_leaks(docs.limit(0), items).count() == 0
    with pytest.raises(TypeError):
        D.find_leaks(docs.selectExpr("cast(doc_id as string) as doc_id", "text"), items)


def test_blocks_find_the_same(spark, sf_dir, monkeypatch):
    whole = sorted(map(tuple, D.op10_leaks(spark, sf_dir).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 2_000)
    assert sorted(map(tuple, D.op10_leaks(spark, sf_dir).collect())) == whole


def test_joined_pieces_find_what_the_automaton_finds(spark, monkeypatch):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i if i % 9 else None, text(r.randint(1, 40))) for i in range(60)] + [(100, "é" * 30 + " x"), (101, "..."), (102, None)]
    docs = []
    for i in range(150):
        s = text(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            s += " " + edited(r, r.choice(items[:61])[1], r.randint(0, 8)) + " " + text(5)
        docs.append((i if i % 7 else None, s))
    docs += docs[:5] + [(900, None), (901, "")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want, free = sorted(map(str, D.find_leaks(d, q).collect())), sorted(map(str, D.leak_free(d, q).collect()))
    matcher = D.Matcher(items)
    assert len(want) == sum(len(list(matcher.search(t))) for _, t in docs) > 100
    monkeypatch.setattr(D, "BLOCK_CHARS", -1)
    assert sorted(map(str, D.find_leaks(d, q).collect())) == want
    assert sorted(map(str, D.leak_free(d, q).collect())) == free
    wide = d.selectExpr("*", "1 AS h", "2 AS g", "3 AS item")
    assert D.leak_free(wide, q).columns == wide.columns and D.leak_free(wide, q).count() == len(free)
