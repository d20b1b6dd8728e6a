from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.operators import search
from tests.conftest import rows


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
@pytest.mark.parametrize("kind", ["bigint", "string", "decimal(20,0)"])
def test_knn_join_ties_go_to_the_smallest_ids(spark, metric, kind):
    same = spark.range(60).select(F.col("id").cast(kind).alias("id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("vec")).repartition(7)
    q = spark.createDataFrame([(7, [1.0, 2.0]), (8, [3.0, 1.0])], "query_id int, vec array<float>")
    got = rows(search.knn_join(q, same, 5, metric).select("query_id", "rank", F.col("id").cast("string")))
    first = sorted(map(str, range(60)))[:5] if kind == "string" else list(map(str, range(5)))
    assert got == sorted((i, r, x) for i in (7, 8) for r, x in enumerate(first, 1))


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_knn_join_equals_brute_force_in_tiles_and_pieces(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (900, 4)).astype(np.float64)  # many ties and zero vectors
    q = rng.integers(-2, 3, (50, 4)).astype(np.float64)
    monkeypatch.setattr(search, "MAX_KEPT_ROWS", 100)
    monkeypatch.setattr(search, "TILE_NUMBERS", 500)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 4), (1000, None), (1001, [1.0])], "id bigint, vec array<float>").repartition(3)
    got = {}
    for r in search.knn_join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, vec array<float>"), c, 6, metric).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for i in range(50):
        if metric == "l2":
            d = ((x - q[i]) ** 2).sum(1)
        else:
            d = -(x @ q[i])
            if metric == "cosine":
                n = np.linalg.norm(x, axis=1) * np.linalg.norm(q[i])
                d = np.where(n > 0, 1 + d / np.where(n > 0, n, 1), 1.0)
        mine = d[got[i]]
        assert np.allclose(mine, np.sort(d)[:6], atol=1e-12)
        if metric != "cosine":
            assert got[i] == np.lexsort((np.arange(900), d))[:6].tolist()


def test_many_queries_take_bounded_memory():
    """Products come in tiles: the whole matrix would take 800 MB."""
    import tracemalloc

    rng = np.random.default_rng(1)
    best = search.KBest(rng.standard_normal((20_000, 8)), 10, "l2")
    tracemalloc.start()
    for _ in range(2):
        best.take(rng.standard_normal((5_000, 8)), rng.integers(0, 1 << 40, 5_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(best.query) == 200_000 and peak < 400 << 20


def test_lengths_of_every_size_and_masses_of_ties():
    """A few huge vectors leave no room for others, and ten million tied pairs stay within tiles."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 8)) * 10.0 ** rng.integers(-3, 6, (3000, 1))
    best = search.KBest(x[:200], 5, "l2")
    best.take(x, np.arange(3000))
    want = [np.lexsort((np.arange(3000), ((x - q) ** 2).sum(1)))[:5].tolist() for q in x[:200]]
    assert best.ids.reshape(200, 5).tolist() == want
    same = search.KBest(np.ones((2000, 4)), 3, "cosine")
    for k in (1, 0):
        same.take(np.ones((5000, 4)), np.arange(5000) + 5000 * k)
    assert (same.ids.reshape(2000, 3) == [0, 1, 2]).all()


def test_failed_shards_are_reported(spark):
    c = spark.range(20).select("id", F.array(F.col("id").cast("float")).alias("vec"))
    q = spark.createDataFrame([(0, [3.2])], "query_id int, vec array<float>")
    calls = []

    def broken():
        calls.append(1)
        raise OSError("gone")

    got, failed = search.search_shards(q, {0: lambda: c.where("id % 2 = 0"), 1: broken}, 2, "l2")
    assert [r[2] for r in rows(got.select("query_id", "rank", "id"))] == [4, 2] and list(failed) == [1] and len(calls) == 2
    whole, failed = search.search_shards(q, {i: (lambda i=i: c.where(f"id % 2 = {i}")) for i in (0, 1)}, 2, "l2")
    assert [r[2] for r in rows(whole.select("query_id", "rank", "id"))] == [3, 4] and not failed
    with pytest.raises(search.ShardsFailed):
        search.search_shards(q, {1: broken}, 2, "l2")
