import random
import re

import numpy as np
import pytest
import xxhash

from lumenspan.llm import simhash as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(fps, distance):
    u = sorted(set(fps))
    parent = {x: x for x in u}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(u, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= distance):
            x, y = root(u[i]), root(u[i + 1 + int(j)])
            if x != y:
                parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in u}


def clouds(seed):
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(300)}
    for near, n in ((1, 60), (2, 400), (3, 300), (5, 500)):
        centre = r.getrandbits(64)
        for _ in range(n):
            x = centre
            for b in r.sample(range(64), r.randint(0, near)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_links_reach_what_brute_force_reaches(spark, seed, distance):
    fps = clouds(seed)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    tree = S.components(S.fingerprint_links(df, distance), S.written).collect()
    got = {r.node: r.root for r in tree}
    want = brute(fps, distance)
    as_unsigned = lambda x: int(np.int64(x).view(np.uint64))
    groups = {}
    for s, u in zip(signed, fps, strict=True):
        groups.setdefault(as_unsigned(got.get(s, s)), set()).add(u)
    expected = {}
    for u, r in want.items():
        expected.setdefault(r, set()).add(u)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_fingerprint_bits():
    assert S.fingerprint_of(None) == S.fingerprint_of(b" \t\n") == 0
    assert S.fingerprint_of(b"One TWO") == xxhash.xxh64_intdigest(b"one two", 42)
    hs = [xxhash.xxh64_intdigest(x, 42) for x in (b"a b a", b"b a b", b"a b a", b"b a c")]
    want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > 4)
    assert S.fingerprint_of(b"a b a b a c") == want


def test_unicode_spaces_and_capitals_stay():
    assert S.fingerprint_of("É x".encode()) == xxhash.xxh64_intdigest("É x".encode(), 42)


def test_defined_cases(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, None), (8, ""), (8, " \n"), (1, "long " * 200_000), (None, "alone here too")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component", "3 as id")
    got = sorted(S.near_duplicates(df).collect(), key=str)
    assert len(got) == len(rows)
    by = {(r.id, r.component) for r in got}
    assert {(5, 3), (3, 3), (None, 3), (9, 8), (8, 8), (1, 1), (None, None)} == by
    assert S.near_duplicates(df.limit(0)).count() == 0


def jaccard(a, b):
    """Of five-word shingles, by plain sets of tuples."""
    sets = []
    for t in (a, b):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def near_groups(r, groups, size, words, changed):
    """(id, text) of groups whose members differ from their first one in `changed` words."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    rows = []
    for g in range(groups):
        base = [word() for _ in range(words)]
        for k in range(size):
            w = list(base)
            for i in r.sample(range(words), changed if k else 0):
                w[i] = word()
            rows.append((None if g == groups - 1 and k % 2 else 100 * k + g, " ".join(w)))
    return rows


@pytest.mark.parametrize("words,changed,common,small", [(120, 2, False, 128), (60, 1, False, 128), (300, 4, True, 128), (3, 1, False, 128), (120, 2, True, 4), (60, 1, True, 4)])
def test_what_goes_is_what_is_like_something_before_it(spark, monkeypatch, words, changed, common, small):
    """Against all pairs; with hot shingles in parts, and with groups beyond those compared pair by pair."""
    monkeypatch.setattr(S, "SMALL", small)
    if common:
        monkeypatch.setattr(S, "SAMPLED", 1)
        monkeypatch.setattr(S, "HOT", 5)
    rows = near_groups(random.Random(words), 8, 20, words, changed) + [(5000, None), (5001, ""), (5002, "of its own")]
    df = spark.createDataFrame([(*x, i, i * 7919) for i, x in enumerate(rows)], "doc_id long, text string, row long, h long").repartition(3)
    order = [i for _, i in sorted(((d is None, d or 0, i), i) for i, (d, _) in enumerate(rows))]
    want = {i for k, i in enumerate(order) if any(jaccard(rows[i][1], rows[j][1]) >= 0.8 for j in order[:k])}
    assert {r.row for r in S.near_copies(df).collect()} == want
    assert len(want) > (60 if words > 3 else 0)


def test_one_of_each_has_a_way_with_odd_rows(spark):
    rows = [(1, "one two three four five six", 7, "x", {"a": 1}), (2, "one two three four five six", 8, "y", {"a": 1}), (3, None, 8, "y", None), (None, "", 8, "y", {}), (9, "seven words that no other row has got", 1, "z", {"b": 2})]
    df = spark.createDataFrame(rows + rows[-1:] * 3, "doc_id long, text string, row long, `k.id` string, doc map<string,int>")
    got = S.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, [r for r in df.dropDuplicates(["doc_id"]).collect() if r.doc_id in (None, 1, 9)]))
    assert S.one_of_each(df.limit(0)).count() == 0
    with pytest.raises(TypeError):
        S.one_of_each(df.selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_parities_never_rule_out_copies():
    """Of texts of very different lengths: parities differ in no more classes than the texts in shingles, however they are folded."""
    r = random.Random(2)
    sets = [np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64)) for n in (1, 5, 300, 2048, 2049, 9000)]
    sets += [np.unique(np.r_[s[: max(1, len(s) * 9 // 10)], np.array([r.getrandbits(64) for _ in range(len(s) // 20)], np.uint64)]) for s in sets]
    for a in sets:
        for b in sets:
            x, y = S.parity(a), S.parity(b)
            size = min(len(x), len(y)) * 8
            far = int(np.bitwise_count(S._words([x], size) ^ S._words([y], size)).sum())
            assert far <= len(np.setxor1d(a, b))
            alike = S.similarity(a, b) >= 0.8
            assert not alike or S._possible(S.pa.array([x]), S.pa.array([y]), S.pa.array([len(a) + len(b)])).to_pylist() == [True]
    unrelated = S._possible(S.pa.array([S.parity(sets[5])]), S.pa.array([S.parity(np.unique(np.array([r.getrandbits(64) for _ in range(9000)], np.uint64)))]), S.pa.array([18000]))
    assert unrelated.to_pylist() == [False]
