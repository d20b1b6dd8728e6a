from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata"
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="the test tables are missing")


@pytest.mark.parametrize("name, sf", [("p2_found", "sf0.001"), ("p2_found", "sf0.01"), ("p2_found", "sf0.1"), ("p2_recall", "sf0.01"), ("p4_found", "sf0.001"), ("p8_decoded", "sf0.001"), ("p9_found", "sf0.01"), ("p4_described", "sf0.01")])
def test_queries_equal_their_sql(spark, name, sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(f"{DATA}/{sf}"):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{sf}/{f}'")
    mine = entry.queries()[name](spark, f"{DATA}/{sf}")
    theirs = c.sql(entry.oracle_sql()[name])
    order = sorted(mine.columns)
    assert order == sorted(theirs.columns)
    pick = [theirs.columns.index(o) for o in order]
    assert sorted(map(repr, (tuple(r) for r in mine.select(*order).collect()))) == sorted(repr(tuple(r[i] for i in pick)) for r in theirs.fetchall())
