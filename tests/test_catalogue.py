"""Every catalogue query gives the rows and types that its SQL gives in DuckDB."""

import os

import duckdb
import pytest

from framelake.plans import catalogue

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_sql(spark, sf, db, name):
    df = catalogue.queries()[name](spark, sf)
    rel = db.sql(catalogue.oracle_sql()[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types), strict=True))
    cols = sorted(df.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    ours = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    theirs = sorted(db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({catalogue.oracle_sql()[name]})").fetchall(), key=key)
    assert ours == theirs
    assert ours


def test_flagship_is_a_permutation(spark, sf):
    rows = catalogue.flagship(spark, sf).collect()
    tracks = {}
    for r in rows:
        tracks.setdefault(r.user_id, []).append(r)
    for t in tracks.values():
        assert sorted(r.pos for r in t) == list(range(len(t))) == sorted(r.idx for r in t)
        assert all(r.held >= 1 for r in t)
