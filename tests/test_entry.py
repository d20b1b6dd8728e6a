from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are missing")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["tenant_id", "id", "vec_seq", "meta_seq"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p6_found", "p7_found", "q_knn_join_l2", "q_filter_and_range", "q_tenant_stats", "q_ivf_rerank", "q_seq_gaps"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    mine = entry.queries()[name](spark, SMALL)
    theirs = c.sql(entry.oracle_sql()[name])
    order = sorted(mine.columns)
    assert order == sorted(theirs.columns)
    pick = [theirs.columns.index(o) for o in order]
    assert sorted(map(repr, (tuple(r) for r in mine.select(*order).collect()))) == sorted(repr(tuple(r[i] for i in pick)) for r in theirs.fetchall())


def test_trained_searches_have_their_recall(spark):
    got = {r["search"]: r["recall"] for r in entry.queries()["q_recall_trained"](spark, SMALL.replace("sf0.001", "sf0.1")).collect()}
    assert set(got) == {"q_pq_search_trained", "q_pq_rerank_trained", "q_ivf_search_trained", "q_ivf_rerank_trained"} and min(got.values()) >= 0.9, got
