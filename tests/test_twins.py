"""Every registered query against its SQL twin on the smallest data."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from check import TABLES, TYPES, _norm
from marketframe.plans import catalog

SF = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.001")
QUERIES, TWINS = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    res = db.execute(TWINS[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert {d[0]: str(d[1]) for d in res.description} == {c: TYPES[t] for c, t in df.dtypes}
    want = Counter(tuple(_norm(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall())
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    assert got == want
