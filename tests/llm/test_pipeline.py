"""The pipeline against a plain version of each stage, on the smallest tables and on a few odd rows; and the SQL of the queries."""

import hashlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P
from lumenspan.llm import decontaminate as D
from lumenspan.llm import mixing as M
from lumenspan.llm import quality_classifier as C
from lumenspan.llm import registry, simhash
from lumenspan.llm import token_output as T
from tests.llm.test_simhash import brute, jaccard
from tests.llm.test_texts import mix_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(spark, docs, sf_dir):
    """(doc_id, seq_no, ids) of run(), made without Spark from the rows of documents; what each stage kept on the way."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    scorer = C.Scorer(C.fit(C.sample(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), labels)))
    kept = [d for d in docs if scorer.scores([(d[1] or "").encode()])[0] >= 0.3]
    told = [len(kept)]
    fp = [simhash.fingerprint_of((d[1] or "").encode()) for d in kept]
    root, groups = brute(fp, 2), defaultdict(list)
    for d, f in zip(kept, fp, strict=True):
        groups[root[f]].append(d)
    least = {g: min((d[0] is not None, d[0] or 0) for d in v) for g, v in groups.items()}
    kept = [next(d for d in v if (d[0] is not None, d[0] or 0) == least[g]) for g, v in groups.items()]
    kept.sort(key=lambda d: (d[0] is None, d[0] or 0))
    kept = [d for k, d in enumerate(kept) if not any(jaccard(d[1], e[1]) >= 0.8 for e in kept[:k])]
    told.append(len(kept))
    matcher = D.Matcher(items)
    kept = [d for d in kept if next(matcher.search(d[1]), None) is None and not any(D.normal(t) and D.normal(t) in D.normal(d[1]) for _, t in items)]
    told.append(len(kept))
    size = lambda t: len((t or "").encode().split())
    sums = Counter()
    for d in kept:
        sums[d[3]] += size(d[1])
    goal, out = mix_by_hand(sums), Counter()
    for d in kept:
        rate = goal[d[3]] / sums[d[3]] if sums[d[3]] else 0
        key = "\x1f".join([M.SEED, "" if d[0] is None else str(d[0]), d[1] or ""])
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        out[d] += int(rate) + (u < rate - int(rate))
    told.append(sum(out.values()))
    tokens = T.Tokens(Path(T.VOCABULARY).read_bytes())
    made = Counter()
    for d, n in out.items():
        ids = tokens.encode(d[1])
        for k in range(0, len(ids), T.SEQ_LEN):
            made[str(d[0]), k // T.SEQ_LEN, ids[k : k + T.SEQ_LEN].tobytes()] += n
    return +made, told


def staged(spark, docs, sf_dir, tmp_path):
    df, told = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), []
    for k, (_, f) in enumerate(P.STAGES):
        out = f(spark, df, sf_dir)
        if k < len(P.STAGES) - 1:
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        told.append(df.count())
    return df.collect(), told


def records(rows):
    ids = lambda r: bytes(r.record)[T.HEADER.itemsize : T.HEADER.itemsize + 2 * r.n_tokens]
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    return Counter((str(r.doc_id), r.seq_no, ids(r)) for r in rows)


def test_stages_like_plain_ones(spark, sf_dir, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    odd = [(900_001, None, None, None, None), (900_002, "", "en", None, 0), (None, docs[0][1], "en", "zz", 1), (900_003, docs[1][1] + " " + item, "en", "zz", 1), docs[2], docs[2], (docs[3][0], docs[4][1], "en", "zz", 1)]
    rows, told = staged(spark, docs + odd, sf_dir, tmp_path)
    want, steps = plain(spark, docs + odd, sf_dir)
    assert told[:4] == steps
    assert records(rows) == want


def test_run_agrees_with_stages(spark, sf_dir, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    rows, _ = staged(spark, docs, sf_dir, tmp_path)
    assert records(P.run(spark, sf_dir).collect()) == records(rows)


def test_empty_documents(spark, sf_dir, tmp_path):
    assert staged(spark, [], sf_dir, tmp_path) == ([], [0] * 5)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, tmp_path, name):
    sf, con = sf_dir.replace("sf0.001", "sf0.01"), duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    if name == "op1_secrets":  # more cases than the tables hold
        from tests.llm.test_secrets_urls import SECRET_40, TRIPLES
        from tests.llm.test_secrets_urls import TEXTS as PLAIN_TEXTS

        TEXTS = PLAIN_TEXTS + [t.format(SECRET_40) for t, _ in TRIPLES] + ["a\x01pwd: \x02abcdef\n \nlogin=bob token=abcd@x host: db.x"]  # noqa: N806

        con.execute("drop view documents")
        con.execute("create table documents(doc_id bigint, text varchar)")
        con.executemany("insert into documents values (?, ?)", list(enumerate(TEXTS)))
        spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        sf = str(tmp_path)
    if name == "op3_quality_rules":  # with languages that have no reference
        con.execute("drop view documents")
        con.execute(f"create table documents as select doc_id, text, case when doc_id % 7 = 0 then null when doc_id % 11 = 0 then 'xx' else lang end as lang from '{sf}/documents.parquet'")
        con.execute(f"copy documents to '{tmp_path}/documents.parquet' (format parquet)")
        sf = str(tmp_path)
    got = registry.QUERIES[name](spark, sf)
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted((tuple(value(r[c]) for c in names) for r in got.collect()), key=str) == sorted((tuple(map(value, r)) for r in cur.fetchall()), key=str)


CLASH = ["size", "target", "rate", "copies", "source_size", "doc", "key", "row", "h", "g", "n", "k", "id", "__copy", "__h", "__n", "__k", "__d", "__key", "k.id", "component", "fp", "shard", "Rate"]


@pytest.mark.parametrize("stage", range(5))
def test_clashing_columns_stay(spark, sf_dir, stage):
    """Every stage gives the rows that it gives without the columns, and all but the last give those as they came."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    more = [f"concat('{c}', doc_id) AS `{c}x`" for c in CLASH[:-1]]
    wide = docs.selectExpr("*", *more).toDF(*COLUMNS, *CLASH[:-1]) if stage < 4 else docs.selectExpr("*", "1 AS slot", "2 AS record", "3 AS h", "4 AS part", "5 AS ids", "6 AS n")
    f = P.STAGES[stage][1]
    got, want = f(spark, wide, sf_dir), f(spark, docs, sf_dir)
    if stage == 4:
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        return
    assert got.columns == wide.columns
    rows = got.collect()
    assert sorted(str(tuple(r)[:5]) for r in rows) == sorted(str(tuple(r)) for r in want.collect())
    assert all(v == f"{c}{r.doc_id}" for r in rows for c, v in zip(CLASH, tuple(r)[5:], strict=False))


def test_near_copies_of_odd_rows(spark, sf_dir):
    rows = [(1, "one two three four five six", 7, "x", 9), (2, "one two three four five six", 8, "y", 9), (3, None, 8, "y", 9), (None, "", 8, "y", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h long, id string, n long")
    assert sorted(map(str, P.near_duplicates(spark, df, sf_dir).collect())) == sorted(map(str, df.where("doc_id = 1 or doc_id is null").collect()))


def test_planted_copies_and_clean_ones(spark, sf_dir, tmp_path):
    """Exact copies all go but one, whatever their number; documents of their own stay."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    own = [(i, " ".join(word() for _ in range(120)), "en", "s", 1) for i in range(150)]
    copies = [(1000 + i, own[0][1].upper() if i % 2 else own[0][1], "en", "s", 1) for i in range(400)]
    df = spark.createDataFrame(own + copies, "doc_id long, text string, lang string, source string, n_chars long")
    near = []
    for i in range(300):  # two words in 120 changed
        w = own[1][1].split()
        for k in rng.choice(120, 2, replace=False):
            w[k] = word()
        near.append((2000 + i, " ".join(w), "en", "s", 1))
    df = df.unionByName(spark.createDataFrame(near, df.schema))
    got = sorted(r.doc_id for r in P.near_duplicates(spark, df, sf_dir).collect())
    assert got[:150] == list(range(150))
    text = [x[1] for x in near]
    new = [2000 + i for i, t in enumerate(text) if jaccard(t, own[1][1]) < 0.8 and not any(jaccard(t, u) >= 0.8 for u in text[:i])]
    assert got[150:] == new and len(new) < 15
