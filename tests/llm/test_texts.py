import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard

from lumenspan.llm import lm_scoring as L
from lumenspan.llm import mixing as M
from lumenspan.llm import quality_classifier as C
from lumenspan.llm import quality_rules as Q
from lumenspan.llm import token_output as T

DOCS = "doc_id long, text string, lang string, source string"


def odd_rows():
    prose = "the cat and the dog went to see what was on the hill by the old mill in spring and then they sat down at last near water " * 4
    return [(1, None, "en", "a"), (2, "", None, None), (None, prose, "en", "a"), (None, prose, "en", "a"), (5, " \n\t", "xx", "b"), (6, "word " * 60_000, "en", "b"), (7, "é\xa0ü\u2003ß", "de", None), (8, prose.upper(), "en", "a"), (8, prose + "more", "fr", "c")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(*r, 0, 0) for r in odd_rows()], DOCS + ", own int, lang2 int")


def base_counts(text):
    text = (text or "").encode()
    w = text.split()
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.decode().split("\n") if x.strip(" \t\n\v\f\r")]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text.decode()), dup, len(hit)


def test_quality_rules_counts(spark, sf_dir, odd):
    for rows, df in ((odd_rows(), odd), ([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()], spark.read.parquet(f"{sf_dir}/documents.parquet"))):
        got = Q.divergence(df.select("doc_id", "text", "lang")).collect()
        key = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert sorted((str(r.own.doc_id), key(r)) for r in got) == sorted((str(r[0]), base_counts(r[1])) for r in rows)
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
        assert not any(r.kept and r.base_failed for r in got)
    assert Q.divergence(odd.limit(0).select("doc_id", "text", "lang")).count() == 0


def test_distance():
    p, q = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]]), np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])
    assert Q.js_distance(p, q).tolist() == [0.0, 1.0]
    r = np.random.default_rng(1).dirichlet([1] * 5, 2)
    m = r.mean(axis=0)
    want = math.sqrt(sum((r * np.log2(r / m)).sum(axis=1)) / 2)
    assert abs(Q.js_distance(r[:1], r[1:])[0] - want) < 1e-12


def test_quality_rules_keep_labelled_good(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in Q.op3_quality_rules(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    good, bad = ([r.kept for r in got if labels[r.doc_id] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.25


def test_foreign_and_wordless_texts_fail(spark, sf_dir):
    """A long text told to be of another language than it is, and one without common words, fail; the same text of its own passes."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "lang")
    kept = {r.own.doc_id: r.kept for r in Q.divergence(docs).collect()}
    some = [r for r in docs.orderBy("doc_id").collect() if kept[r.doc_id] and 150 <= len(r.text.split()) <= 2000]
    other = {"en": "de", "de": "fr", "fr": "en", "es": "en"}
    again = [(10**6 + r.doc_id, r.text, other[r.lang]) for r in some[:40]]
    bare = [(2 * 10**6 + r.doc_id, " ".join(w for w in r.text.split() if w.strip(".,;:!?\"'()[]").lower() not in set(Q.WORDS)), r.lang) for r in some[:40]]
    bare = [x for x in bare if len(x[1].split()) >= 50]
    got = {r.own.doc_id: r.kept for r in Q.divergence(docs.unionByName(spark.createDataFrame(again + bare, docs.schema))).collect()}
    lost = [(3 * 10**6 + r.doc_id, r.text, "xx" if r.doc_id % 2 else None) for r in some[:40]]
    assert all(r.kept for r in Q.divergence(docs.unionByName(spark.createDataFrame(lost, docs.schema))).collect() if r.own.doc_id >= 3 * 10**6)
    assert len(again) == 40 and len(bare) > 20
    assert not any(got[x[0]] for x in again + bare) and all(got[r.doc_id] for r in some[:40])


def test_word_limit():
    q = np.array([[0.2, 0.3, 0.5], [0.0, 0.0, 1.0], [0.6, 0.4, 0.0]])
    want = Q.js_distance(np.array([[0.0, 0.0, 1.0]] * 3), q)
    assert np.allclose(Q.word_limits(q[:, -1]), Q.WORD_SHARE * want)


def test_classifier(spark, sf_dir, odd):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in C.op5_quality(spark, sf).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in out) / len(out) > 0.97
    model = C.fit([])
    assert [x for (x,) in odd.select(C.quality_score(model, odd["text"])).collect()] == [0.5] * 9
    one = C.fit([(i, b"text of a kind", 1) for i in range(9)])
    assert set(C.Scorer(one).scores([None, b"", b"x"])) == {1.0}
    none = spark.createDataFrame([(None, 1), (1, None), (77, 1), (8, 5)], "doc_id long, quality int")
    assert C.keep_good(odd, none).count() == 9
    assert C.keep_good(odd.limit(0), none).count() == 0


def quality_by_hand(docs, labels):
    """doc_id -> score, by plain loops: sample, dictionaries, sizes, and a logistic fit by Newton steps on its penalised likelihood."""
    by = defaultdict(set)
    for d, q in labels:
        if d is not None and q in (0, 1) and zlib.crc32(str(d).encode()) % 5:
            by[d].add(q)
    text = {}
    for d, t in docs:
        if d is not None and t is not None:
            text[d] = min(text.get(d, t.encode()), t.encode(), key=lambda x: np.uint64(xxhash.xxh64_intdigest(x, 42)).view(np.int64))
    rows = []
    for q in (0, 1):
        left, some = 8_000_000, sorted((d for d in text if by.get(d) == {q}), key=lambda d: (zlib.crc32(f"sample-{d}".encode()), d))[:5_000]
        for d in some:
            if 0 < len(text[d]) <= left:
                rows.append((d, text[d], q))
                left -= len(text[d])
    blocks = lambda t: [t[i : i + 512] for i in range(0, len(t), 512)]
    half = lambda d: zlib.crc32(f"half-{d}".encode()) % 2
    rows.sort()
    made = {q: zstandard.train_dictionary(32_768, [b for d, t, k in rows if k == q and not half(d) for b in blocks(t)]) for q in (1, 0)}
    tools = [zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, **({"dict_data": x} if x else {})) for x in (made[1], made[0], None)]

    def terms(t):
        g, b, p = (sum(len(c.compress(x)) for x in blocks(t)) for c in tools)
        n = max(1, len(t))
        f = [(b - g) / n, g / n, p / n, math.log1p(n)]
        return [1.0, *f, *(f[i] * f[j] for i in range(4) for j in range(i + 1))]

    fit = [(terms(t), q) for d, t, q in rows if half(d)]
    x, y = np.array([r[0] for r in fit]), np.array([r[1] for r in fit], float)
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], dev[0] = 0, 1
    x = (x - mean) / dev
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.inv(x.T @ np.diag(p * (1 - p)) @ x + 0.1 * np.eye(len(w))) @ (x.T @ (p - y) + 0.1 * w)
    return {d: float(1 / (1 + np.exp(-np.clip((np.array(terms((t or "").encode())) - mean) / dev @ w, -30, 30)))) for d, t in docs}


def test_classifier_by_hand(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    want = quality_by_hand(docs, labels)
    got = {r.doc_id: r.score for r in C.op5_quality(spark, sf).collect()}
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in want) < 1e-6
    # A repeated id counts once; contradicting labels do not count.
    odd = docs[:300] + [(docs[0][0], "zzz " * 500_000), (docs[1][0], "0")]
    twice = labels + [(docs[2][0], 0), (docs[2][0], 1), (None, 1), (docs[3][0], 7)]
    rows = C.sample(spark.createDataFrame(odd, "doc_id long, text string"), spark.createDataFrame(twice, "doc_id long, quality int"))
    assert len({r[0] for r in rows}) == len(rows) and docs[2][0] not in {r[0] for r in rows}


def mix_by_hand(sizes, weights=M.WEIGHTS, share=M.SHARE, most=M.MOST):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        per = left / sum(w[s] for s in open_)
        over = {s for s in open_ if per * w[s] > most * sizes[s]}
        if not over:
            out |= {s: per * w[s] for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix(spark, odd):
    plan = M.plan_mix(odd).collect()
    assert len(plan) == 9
    size = lambda t: len((t or "").encode().split())
    sums = defaultdict(int)
    for _, t, _, s in odd_rows():
        sums[s] += size(t)
    want = mix_by_hand(sums)
    for r in plan:
        assert r.size == size(r.text) and r.source_size == sums[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) and r.copies <= 2
    assert sorted(map(str, M.plan_mix(odd).collect())) == sorted(map(str, plan))
    mixed = M.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in plan)
    assert M.mix(odd.limit(0)).count() == 0


def test_mix_many_sources_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    docs = spark.range(3000).selectExpr("id AS doc_id", "'a b c' AS text", "if(id % 3 = 0, null, concat('s', id % 700)) AS source")
    got = M.plan_mix(docs).select("source", "target").distinct().collect()
    sums = Counter({None: 3000})
    for i in range(3000):
        if i % 3:
            sums[f"s{i % 700}"] += 3
    want = mix_by_hand(sums)
    assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in want.items()}


def scorer_by_hand(train, order=L.ORDER):
    """Text to the logarithm of its probability: dicts of what follows each context, and the rule written out symbol by symbol."""
    seen = defaultdict(Counter)

    def places(t):
        s = [None] * order + list(t.lower()) + [None]
        return [(s[i - order : i], s[i]) for i in range(order, len(s))]

    for t in train:
        for before, c in places(t):
            for k in range(order + 1):
                seen[tuple(before[order - k :])][c] += 1

    def prob(before, c):
        p, gone = 1.0, set()
        for k in range(order, -1, -1):
            here = {x: n for x, n in seen.get(tuple(before[order - k :]), {}).items() if x not in gone}
            if not here:
                continue
            n = sum(here.values()) + len(here)
            if c in here:
                return p * here[c] / n
            p, gone = p * len(here) / n, gone | set(here)
        return p / (256 - len(gone))

    return lambda t: sum(math.log10(prob(before, c)) for before, c in places(t))


@pytest.mark.parametrize("block", [L.BLOCK, 1000])
def test_lm_scores(spark, odd, monkeypatch, block):
    """Scores are those of a plain trie, whatever the blocks and parts; tokens and base scores are those of plain counts."""
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "PART", block)
    strange = [(20, "zebra quartz", "en", "a", 0, 0), (21, "the cat and the d\u00f6g", "en", "a", 0, 0), (None, "the mill went to the cat \U0001f600", "en", "a", 0, 0)]
    docs = odd.unionByName(spark.createDataFrame(strange, odd.schema))
    model = L.train(odd.where("doc_id is not null"))
    got = L.score(docs, model, docs["doc_id"].isNull()).collect()
    train = [(r[1] or "").encode() for r in odd_rows() if r[0] is not None]
    counts = Counter(w for t in train for w in [*t.lower().split(), b"\n"])
    n, v, log = sum(counts.values()), len(counts), scorer_by_hand(train)
    assert (model.n, model.v) == (n, v)
    want = []
    for d, t, *_ in [*odd_rows(), *strange]:
        t = (t or "").encode()
        w = [*t.lower().split(), b"\n"]
        want.append((str(d), d is None, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 3), round(log(t), 4)))
    have = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 3), round(r.score, 4)) for r in got]
    for a, b in zip(sorted(have, key=str), sorted(want, key=str), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-2 and abs(a[5] - b[5]) < 1e-5 * abs(b[5]) + 1e-3


def test_lm_scores_of_held_out_documents(spark, sf_dir):
    """The table's own documents, held-out ones against the plain trie; contexts help to tell them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    out = [zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in docs]
    learnt = [(r.text or "").encode() for r, o in zip(docs, out, strict=True) if not o]
    log, alone = scorer_by_hand(learnt), scorer_by_hand(learnt, 0)
    want = {r.doc_id: log((r.text or "").encode()) for r, o in zip(docs, out, strict=True) if o}
    got = {r.doc_id: r for r in L.op7_lm_scores(spark, str(sf_dir)).collect()}
    assert len(got) == len(docs) and {d for d, r in got.items() if r.held_out} == set(want)
    assert all(abs(got[d].score - x) < 1e-5 * abs(x) + 1e-3 for d, x in want.items())
    assert sum(want.values()) > 0.7 * sum(alone((r.text or "").encode()) for r in docs if r.doc_id in want)


def test_lm_is_a_distribution_and_may_be_empty(spark, odd, monkeypatch):
    """After any context, seen or not, the probabilities of all symbols add up to one (where symbols are left to escape to)."""
    monkeypatch.setattr(L, "PART", 64)
    model = L.train(odd.where("doc_id is not null"))
    for before in (b"the c", b"zzzzz", b"e cat", b"qx th", bytes([L.EDGE] * 5)):
        context = int.from_bytes(before[::-1], "big")
        asked = spark.createDataFrame([(context << 8 | s,) for s in range(256)], "gram long")
        total = sum(10.0**r.cost for r in L.costs(asked, model).collect())
        assert abs(total - 1) < 1e-4, before
    model = L.train(odd.limit(0))
    got = L.score(odd, model, odd["doc_id"].isNull()).collect()
    assert len(got) == 9 and all(abs(r.base_score) < 1e-9 and r.n_known == 0 for r in got)
    assert abs(next(r.score for r in got if r.doc_id == 2) + math.log10(256)) < 1e-4
    assert L.score(odd.limit(0), model, odd["doc_id"].isNull()).count() == 0


def test_permutation():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        assert sorted(T.permute(np.arange(n), n, key=3).tolist()) == list(range(n))
    assert T.permute(np.arange(50), 50, 1).tolist() != T.permute(np.arange(50), 50, 2).tolist()


def test_shards_round_trip(spark, odd, tmp_path):
    records = T.sequences(odd, seq_len=16, shard_bytes=4_000).cache()
    n = records.count()
    told = T.write_shards(records, f"file://{tmp_path}/s")
    assert sum(s["n"] for s in told) == n and len(told) > 1
    assert all((tmp_path / f"s/shard-{s['shard']:05d}.bin").stat().st_size == s["n"] * s["stride"] for s in told)
    tokens = T.Tokens(open(T.VOCABULARY, "rb").read())
    read = list(T.read_shards(f"file://{tmp_path}/s"))
    assert [r[0] for r in read] == list(range(n))
    assert [(a, b, c, d.tolist()) for a, b, c, d in T.read_shards(f"file://{tmp_path}/s", start=n // 2)] == [(a, b, c, d.tolist()) for a, b, c, d in read[n // 2 :]]
    want = Counter((d if d is not None else T.NO_ID, k) for d, t, _, _ in odd_rows() for k in range(-(-len(tokens.encode(t)) // 16)))
    assert Counter((d, k) for _, d, k, _ in read) == want
    whole = {d: [ids for _, x, _, ids in sorted((r for r in read if r[1] == d), key=lambda r: r[2])] for d in (1, 6, 7)}
    assert {d: tokens.decode(np.concatenate(x)) for d, x in whole.items()} == {d: t or "" for d, t, _, _ in odd_rows() if d in (1, 6, 7)}
    assert sorted(map(str, T.sequences(odd, seq_len=16, shard_bytes=4_000).collect())) == sorted(map(str, records.collect()))
    assert T.sequences(odd.limit(0)).count() == 0


def test_rows_come_from_the_shards(spark, sf_dir, odd, tmp_path, monkeypatch):
    """What is read from the shards is what was written; the query reads its own."""
    monkeypatch.setattr(T, "READ", 7)
    plain = lambda df: sorted((r.slot, r.shard, r.at, r.doc_id, r.seq_no, r.n_tokens, bytes(r.record)) for r in df.collect())
    records = T.sequences(odd, seq_len=16, shard_bytes=4_000)
    T.write_shards(records, f"file://{tmp_path}/s")
    again = T.shard_rows(spark, f"file://{tmp_path}/s")
    assert plain(again) == plain(records) and [f.dataType for f in again.schema] == [f.dataType for f in records.schema]
    T.write_all(odd, f"file://{tmp_path}/parts", parts=3, seq_len=16, shard_bytes=4_000)
    assert plain(T.shard_rows(spark, f"file://{tmp_path}/parts")) == plain(records)
    T.write_all(odd.limit(0), f"file://{tmp_path}/none")
    assert plain(T.shard_rows(spark, f"file://{tmp_path}/none")) == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert plain(T.op2_token_order(spark, sf_dir)) == plain(T.sequences(docs))
    with open(tmp_path / "s/shard-00000.bin", "r+b") as f:
        f.write(b"?")
    with pytest.raises(Exception, match="not what the manifest says"):
        T.shard_rows(spark, f"file://{tmp_path}/s").collect()


def slots_by_hand(rows, seq_len, key=T.KEY):
    """slot -> (doc_id, seq_no, ids): documents in the order of XXH64 over id and text, then id and ids, their sequences numbered."""
    tokens, made = T.Tokens(open(T.VOCABULARY, "rb").read()), []
    for d, t in rows:
        h = 42 if d is None else xxhash.xxh64_intdigest(struct.pack("<q", d), 42)
        h = h if t is None else xxhash.xxh64_intdigest(t.encode(), h)
        made.append((h - (1 << 64) if h >> 63 else h, -(1 << 63) if d is None else d, tokens.encode(t).tobytes(), d))
    out = []
    for _, _, ids, d in sorted(made, key=lambda x: x[:3]):
        out += [(d, k, ids[i : i + 2 * seq_len]) for k, i in enumerate(range(0, len(ids), 2 * seq_len))]
    slots = T.permute(np.arange(len(out)), len(out), key)
    return dict(zip(slots.tolist(), out, strict=True))


def test_slots_by_hand_whatever_the_files(spark, sf_dir, odd, tmp_path):
    """The same records at the same slots for any files, splits and numbers of ranges."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    docs = spark.createDataFrame([tuple(r) for r in docs.collect()], "doc_id long, text string")
    want = slots_by_hand([tuple(r) for r in docs.collect()], 32)
    found = {}
    for k, (files, split, ranges) in enumerate([(1, "128m", "3"), (7, "16k", "11"), (3, "4k", "1")]):
        docs.repartition(files).write.parquet(f"{tmp_path}/{k}")
        had = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")}
        try:
            for c, v in zip(had, (split, ranges), strict=True):
                spark.conf.set(c, v)
            rows = T.sequences(spark.read.parquet(f"{tmp_path}/{k}"), seq_len=32, shard_bytes=4_000).collect()
        finally:
            for c, v in had.items():
                spark.conf.set(c, v)
        found[k] = {r.slot: (r.doc_id, r.seq_no, bytes(r.record)[16 : 16 + 2 * r.n_tokens]) for r in rows}
        assert len(rows) == len(found[k]) and all(r.at == r.slot % (4_000 // 80) * 80 and r.shard == r.slot // (4_000 // 80) for r in rows)
    assert found[0] == found[1] == found[2] == want


def test_ids_have_to_be_integers(spark):
    with pytest.raises(TypeError):
        T.sequences(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_dotted_columns_and_ids_of_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    wide = docs.selectExpr("*", "doc_id AS `a.b`", "1 AS own", "2 AS f")
    key = lambda r: (r.own.doc_id, r.n_words, r.kept)
    got = Q.divergence(wide).collect()
    assert sorted(map(key, got)) == sorted(map(key, Q.divergence(docs).collect())) and all(r.own["a.b"] == r.own.doc_id for r in got)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with pytest.raises(TypeError):
        C.sample(docs.selectExpr("string(doc_id) AS doc_id", "text"), labels)


def test_shards_of_few_tasks(spark, sf_dir, tmp_path):
    """More shards than shuffle partitions: a task writes several, and the rows are the same."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    key = lambda r: (r.slot, r.doc_id, r.seq_no, bytes(r.record))
    had = spark.conf.get("spark.sql.shuffle.partitions")
    small = T.materialised(docs, shard_bytes=40_000)
    want = [(r.slot, r.shard, *key(r)[1:]) for r in small.orderBy("slot").collect()]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        few = T.materialised(docs, shard_bytes=40_000)
        assert few.rdd.getNumPartitions() == 2
        assert [(r.slot, r.shard, *key(r)[1:]) for r in few.orderBy("slot").collect()] == want and want[-1][1] > 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)


def test_answers_of_grams_and_words_come_in_one_row_for_each_block():
    import numpy as np
    import pyarrow as pa

    rows = [(b, g, g / 8, None, None) for b in (1, 0) for g in (9, 1 << 47, 5)] + [(0, None, None, "é", 3), (0, None, None, L.END, 4), (2, None, None, "x", 0)]
    kinds = pa.schema([("block", pa.int64()), ("gram", pa.int64()), ("cost", pa.float32()), ("word", pa.string()), ("n", pa.int64())])
    batch = pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
    (out,) = L._packed(iter([batch.slice(0, 0), batch]))
    told = {r["block"]: r for r in out.to_pylist()}
    assert sorted(told) == [0, 1, 2] and told[1]["words"] is None and told[2]["grams"] is None
    assert L._open(told[0]["grams"]).tolist() == [5, 9, 1 << 47] and np.frombuffer(told[0]["costs"], np.float32).tolist() == [5 / 8, 9 / 8, (1 << 47) / 8]
    kept = L._Told()
    kept.add(out)
    assert kept.seen == {"é".encode(): 3, b"\n": 4, b"x": 0} and [(n, k) for n, k, _ in kept.counted(["é é x x".encode(), None], 0.0)] == [(5, 3), (1, 1)]
