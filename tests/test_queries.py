"""Registered queries against their SQL on the smallest tables, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from querylens.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    want = sorted(tuple(canon(r[cols.index(n)]) for n in names) for r in cur.fetchall())
    assert sorted(tuple(canon(r[n]) for n in names) for r in got.collect()) == want


def test_contract(spark):
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and set(QUERIES) <= set(known)
    assert entry.entry(spark).count() > 0
