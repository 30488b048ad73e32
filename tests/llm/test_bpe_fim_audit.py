"""Byte-level BPE, fill-in-middle and the filter audit against other libraries and brute force."""

import hashlib
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenspan.llm import byte_bpe as B
from lumenspan.llm import fill_middle as M
from lumenspan.llm import filter_audit as A

DATA = open(B.VOCABULARY, "rb").read()
BPE = B.Bpe(DATA)


@pytest.fixture(scope="module")
def reference():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    return np.frombuffer(BPE.encode(text), "<u4").tolist()


ODD = [None, "", " ", "   a  b\n\n c\t\t d ", "a\u0085 b  c", "\x1c a\x1d  b", "né€😀 👩‍👩‍👧 日本語 ğ", "<|endoftext|> it's I'LL 'tis", "x" * 5000, "aaab" * 900, "\n" * 3000 + "a", "a" + " " * 3000, "1 000,00 ---- ===", "�￾"]


def test_ids_are_those_of_the_rank_library(reference):
    rng = random.Random(4)
    texts = ODD[1:] + ["".join(rng.choice("ab cé\n\t '1😀-") for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(500)]
    for t in texts:
        assert ids(t) == reference.encode_ordinary(t), t
        assert BPE.decode(BPE.encode(t)) == t.encode()


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text(t):
    assert BPE.decode(BPE.encode(t)) == t.encode() and BPE.spans(t)[0].tolist() == ids(t)


def test_parts_of_long_texts_change_nothing(monkeypatch, reference):
    rng = random.Random(5)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "é", "12", ".", " 'll", "😀"]) for _ in range(4000))
    monkeypatch.setattr(B, "PART", 50)
    monkeypatch.setattr(B, "REMEMBERED", 20)
    small = B.Bpe(DATA)
    assert np.frombuffer(small.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
    assert small.spans(text)[0].tolist() == reference.encode_ordinary(text)
    assert len(small.pieces) < 300 and len(small.stretches) < 300


def test_offsets_cover_the_text(reference):
    for t in ["né€😀x  日本 \n it's", "", "👩‍👩‍👧" * 5]:
        found, starts, ends = BPE.spans(t)
        known = reference.decode_with_offsets(reference.encode_ordinary(t))[1] if t else []
        assert starts.tolist() == known
        assert all(a < b for a, b in zip(starts, ends, strict=True)) and (not t or (starts[0] == 0 and ends[-1] == len(t)))
        for k, i in enumerate(found):  # a token's bytes are bytes of the characters that it covers
            assert BPE.bytes_of[i] in t[starts[k] : ends[k]].encode()


def test_split_characters(spark):
    data = "a né€😀 x".encode()
    for i in range(len(data) + 1):
        for j in range(i, len(data) + 1):
            start, end = B.edges(data[i:j])
            body = data[i:j][start:end]
            assert body.decode("utf-8") == body.decode("utf-8", "replace")
            assert start <= 3 and j - i - end <= 3
    cut = spark.createDataFrame([(k, bytearray(data[a:b])) for k, (a, b) in enumerate([(0, 4), (4, 7), (7, 11), (11, len(data))])] + [(9, None)], "k int, d binary")
    got = {r.k: r.c for r in cut.select("k", B.characters(F.col("d")).alias("c")).collect()}
    assert got[9] is None
    again = b"".join(bytes(got[k].head) + got[k].body.encode() + bytes(got[k].tail) for k in range(4))
    assert again == data


def test_encode_and_decode_frames(spark, reference):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "again", None, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `a.b` int")
    codec = B.Codec(docs)
    got = B.decode(B.encode(docs, codec=codec, spans=True), codec).collect()
    assert len(got) == len(rows)
    by_id = {r.own.doc_id: r for r in got}
    for i, t in enumerate(ODD):
        want = reference.encode_ordinary(t or "")
        r = by_id[i]
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and bytes(r.decoded).decode() == (t or "")
        assert len(r.starts) == len(r.ends) == len(want) and r.own.ids == "x" and r.own["a.b"] == 1
    assert [r.n_tokens for r in got if r.own.doc_id is None] == [len(reference.encode_ordinary("again"))] * 2
    assert B.encode(docs.limit(0), codec=codec).count() == 0
    assert spark.createDataFrame([(None,)], "ids binary").select(codec.bytes(F.col("ids")).alias("b")).first().b is None


def test_op12_against_the_rank_library(spark, sf_dir, reference):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = B.op12_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = np.array(reference.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def fim_by_hand(doc_id, text, units=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    cut = re.findall(units, text, re.S)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(cut) + 1), h2 % (len(cut) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(cut), "plain", None, None, text
    p, m, s = "".join(cut[:a]), "".join(cut[a:b]), "".join(cut[b:])
    return len(cut), "spm" if h4 % 100 < 50 else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"


FIM = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "é€😀\n" * 7 + "😀", "has <P>\nin it", "<S", "<P\n>\n<M\n", "S>\n" * 5, "<" * 9 + "\n<", "\r\n x \r\n", "z" * 100_000, "l\n" * 20_000]


def test_fill_middle_by_hand(spark):
    rows = [(i * 7 + k, t, 1, 2, 3) for i, t in enumerate(FIM) for k in range(6)] + [(None, t, 1, 2, 3) for t in FIM] * 2 + [(5, "same\nrow\n", 1, 2, 3)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 int, first int, `n.m` int")
    got = M.fill_middle(docs).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    shown = lambda i, n, form, p, m, out: (str(i), n, form, p, m, out)
    size = lambda x: None if x is None else len(x)
    have = sorted((shown(r.own.doc_id, r.n, r.form, size(r.prefix), size(r.middle), r.output) for r in got), key=str)
    assert have == sorted((shown(r[0], *fim_by_hand(r[0], r[1])) for r in rows), key=str)
    assert sorted(r.back for r in got) == sorted(r[1] or "" for r in rows)
    assert all(r.own.k1 == 1 and r.own["n.m"] == 3 for r in got)
    assert M.fill_middle(docs.limit(0)).count() == 0
    chars = {r.own.doc_id: r for r in M.fill_middle(docs.where("doc_id is not null and doc_id < 60"), units="(?s).").collect()}
    for i, r in chars.items():
        assert (r.n, r.form, r.output) == tuple(np.array(fim_by_hand(i, {x[0]: x[1] for x in rows if x[0] is not None}[i], "."), object)[[0, 1, 4]])
    with pytest.raises(TypeError):
        M.fill_middle(docs.selectExpr("'x' AS doc_id", "text"))


def test_rates_of_forms(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('a', char(10), 'b', char(10), id) AS text")
    n = {r.form: r["count"] for r in M.fill_middle(docs, rate=60, spm=25).groupBy("form").count().collect()}
    assert abs(n["plain"] - 800) < 100 and abs(n["spm"] - 300) < 80 and abs(n["psm"] - 900) < 100


def test_sums_of_units_come_before_texts_move(spark):
    """Shuffles below the offsets hold lengths, never texts; the join with the texts is one that can be split."""
    docs = spark.createDataFrame([(i, "a\nb\n" * i) for i in range(50)], "doc_id long, text string")
    plan = M.fill_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan


def audit_by_hand(docs, labels):
    """All orders run over all documents, one step after the other."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = {
        "A": lambda i, t, w: len(w) < 200, "B": lambda i, t, w: 100 * len(set(w)) < 50 * len(w), "C": lambda i, t, w: 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
        "D": lambda i, t, w: re.search(r"[#$%&*|]", t) is not None, "E": lambda i, t, w: i is not None and i > least[t],
    }
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows = [(p or "", i, {f for f in "ABCDE" if fails[f](i, t or "", re.findall("[^ \t-\r]+", t or ""))}) for i, t, p in docs]
    out = {}
    for part in {p for p, *_ in rows}:
        shap = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [(i, m) for p, i, m in rows if p == part]
            gone = []
            for k, f in enumerate(order, 1):
                removed = [(i, m) for i, m in left if f in m]
                redundant = sum(f in m for _, m in gone)
                left = [(i, m) for i, m in left if f not in m]
                gone += removed
                unique = sum(m == {f} for p, _, m in rows if p == part)
                out[part, "".join(order), k] = [len(left), len(removed), redundant, unique, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed), f]
                shap[f] += len(removed)
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shap[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def audit_rows():
    long = " ".join(f"w{i}" for i in range(200))
    texts = [None, "", long, long.upper(), "same " * 300, long + " #", "A" * 300, "é " * 199, "\x1ca\x85b", long]
    return [(i % 23 if i % 11 else None, texts[i % len(texts)], [None, "", "a", "a", "b"][i % 5]) for i in range(150)] + [(3, long, "a")] * 4 + [(3, long, "b")]




LABELS = [(1, 1, 0), (1, 0, 1), (2, 0, 0), (3, 1, 1), (None, 1, 1), (4, None, 1), (99, 1, 1)]


def test_audit_by_hand_and_sql(spark):
    docs, want = audit_rows(), audit_by_hand(audit_rows(), LABELS)
    frame = spark.createDataFrame([(i, t, p, 1, 2) for i, t, p in docs], "doc_id int, text string, source string, mask int, `t.1` int")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = A.audit(A.histograms(frame, labels)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[k] for k in A.COLUMNS) for r in got} == want and len(got) == len(want)
    con = duckdb.connect()
    d, l = frame.select("doc_id", "text", "source").toPandas(), labels.toPandas()  # noqa: E741, F841
    con.execute("create table documents as select doc_id::BIGINT AS doc_id, text, source from d; create table labels as select doc_id::BIGINT AS doc_id, quality, toxic from l")
    cur = con.execute(A.SQL_OP11)
    names = [c[0] for c in cur.description]
    sql = {(x["part"], x["filter_order"], x["step"]): tuple(x[k] for k in A.COLUMNS) for x in (dict(zip(names, r, strict=True)) for r in cur.fetchall())}
    assert sql == want
    assert A.audit(A.histograms(frame.limit(0), labels)).count() == 0
    assert A.audit(A.histograms(frame, labels.limit(0))).agg(F.sum("good_lost")).first()[0] == 0


def test_matrices():
    m, worth = A.matrices(), A.shapley()
    assert all(x.shape == (32, 600) and x.dtype == np.int64 and set(np.unique(x)) <= {0, 1} for x in m.values())
    for mask in range(32):
        assert worth[mask].sum() == (120 if mask else 0)
        assert m["removed"][mask].sum() == (120 if mask else 0)
        steps = (m["kept"] + m["removed"])[mask].reshape(120, 5)  # what is there at a step was kept by the step before
        assert (steps[:, 1:] == m["kept"][mask].reshape(120, 5)[:, :-1]).all() and (steps[:, 0] == 1).all()
        assert ((m["removed"] + m["redundant"])[mask].reshape(120, 5).sum(axis=1) == bin(mask).count("1")).all()
