"""Corpus queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["op5_near_dedup", "op8_topk_search", "op9_embedding_dedup"])
def test_corpus_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    df = entry.queries()[name](spark, sf)
    rows = con.sql(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda r: tuple(round(x, 5) if isinstance(x, float) else x for x in r)
    assert rows and sorted(map(plain, df.collect()), key=str) == sorted(map(plain, rows), key=str)
