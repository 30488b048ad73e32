"""Each query of the catalogue against its SQL on a second engine."""

import datetime
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from lumenspan.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_as_sql(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=str)
    have = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=str)
    assert have == want
    assert want or name in ("never",)
