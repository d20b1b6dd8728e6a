from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.functions import metrics, text
from quiverlake.functions.filters import Clause
from quiverlake.functions.tenants import valid_tenant
from quiverlake.operators import hnsw, planner, quantize, records, search, shard, tenants
from tests.conftest import rows


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} bigint, vec array<float>")


def exact(q, x, metric):
    q, x = q.astype(float), x.astype(float)
    if metric == "l2":
        return ((x - q) ** 2).sum(1)
    if metric == "dot":
        return -(x @ q)
    return 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_knn_join_equals_brute_force(spark, metric):
    rng = np.random.default_rng(5)
    x = (rng.uniform(-1, 1, (200, 16)) * (np.arange(200) + 1)[:, None]).astype(np.float32)  # varied lengths
    x[17] = x[3]
    got = search.knn_join(frame(spark, x[:9], "query_id"), frame(spark, x).repartition(5), 7, metric).collect()
    for q in range(9):
        d = exact(x[q], x, metric)
        want = sorted(range(200), key=lambda i: (round(d[i], 9), i))[:7]
        mine = [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert sorted(round(d[i], 6) for i in mine) == sorted(round(d[i], 6) for i in want) and mine[0] == want[0]


def test_knn_join_odd_rows(spark):
    x = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [1.0]), (4, []), (5, [0.0, 0.0])], "id bigint, vec array<float>").withColumn("query_id", F.lit("clash"))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0]), (3, None)], "query_id bigint, vec array<float>").withColumn("id", F.lit(9))
    got = rows(search.knn_join(q, x, 5, "cosine").select("query_id", "rank", "id"))
    assert got == [(1, 1, 1), (1, 2, 5), (2, 1, 3)]
    assert rows(search.knn_join(q.limit(0), x, 5, "l2")) == [] and rows(search.knn_join(q, x.limit(0), 5, "l2")) == []
    for k in (0, 1001):
        with pytest.raises(ValueError):
            search.knn_join(q, x, k)


def test_queries_in_pieces(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(40, 4)).astype(np.float32)
    whole = rows(search.knn_join(frame(spark, x, "query_id"), frame(spark, x), 3, "l2"))
    monkeypatch.setattr(search.query_pieces, "__defaults__", (100, 1 << 22))
    assert rows(search.knn_join(frame(spark, x, "query_id"), frame(spark, x), 3, "l2")) == whole


def test_scatter_gather_and_search(spark):
    x = np.array([(i, i, 0, 0) for i in range(40)], np.float32)
    c = shard.with_shard(frame(spark, x), 4)
    q = spark.createDataFrame([(0, [5.0, 5.0, 0.0, 0.0])], "query_id int, vec array<float>")
    assert rows(search.scatter_gather(q, c, 5, "l2", "shard")) == rows(search.knn_join(q, c, 5, "l2"))
    got = search.search(c, [5.0, 5.0, 0.0, 0.0], 3, "l2", columns=()).collect()
    assert [(r["id"], r["score"]) for r in got] == [(5, 0.0), (4, 2.0), (6, 2.0)]
    assert "TakeOrderedAndProject" in search.search(c, [1.0] * 4, 3)._jdf.queryExecution().executedPlan().toString()


def test_table_function(spark):
    x = np.random.default_rng(3).normal(size=(30, 4)).astype(np.float32)
    c = frame(spark, x)
    search.register_knn(spark, c, "l2")
    c.createOrReplaceTempView("t_queries")
    got = rows(spark.sql("SELECT q.id AS query_id, n.rank, n.id, n.score FROM t_queries q, LATERAL knn(q.vec, 3) n"))
    want = rows(search.knn_join(frame(spark, x, "query_id"), c, 3, "l2"))
    assert [g[:3] for g in got] == [w[:3] for w in want]


def test_planner_falls_back_to_exact(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, (300, 8)).astype(np.float32)
    c = frame(spark, x).withColumn("metadata", F.create_map(F.lit("kind"), F.when(F.col("id") % 50 == 3, "rare").otherwise("common")))
    rare = [Clause("kind", "eq", "rare")]
    assert planner.plan(c, rare, 5, 10) == "exact" and planner.plan(c, [], 5, 10) == "graph" and planner.plan(c, [], 5, 4096) == "exact"
    graphs = hnsw.build_graphs(c.withColumn("shard", F.lit(0)), "l2", 8, 40)
    for limit in (10, 0):  # by the pool, and by graph attempts
        got = [r["id"] for r in planner.planned_search(c, graphs, x[0], 6, "l2", rare, exact_limit=limit).collect()]
        d = exact(x[0], x, "l2")
        assert got == sorted(range(3, 300, 50), key=lambda i: d[i])


def test_paging(spark):
    c = spark.createDataFrame([(i,) for i in (5, 1, 9, 3)], "id bigint")
    assert [tuple(r) for r in records.list_page(c, 0, 2).orderBy("id").collect()] == [(1, 4), (3, 4)]
    assert [tuple(r) for r in records.list_page(c, 4, 2).orderBy("id").collect()] == [(5, None), (9, None)]
    assert records.list_page(c, 10, 2).count() == 0


def test_writes(spark):
    c = spark.createDataFrame([(1, {"a": "1"}), (2, {"a": "2"})], "id bigint, metadata map<string,string>")
    new = spark.createDataFrame([(2, {"b": "x"}, 1), (2, None, 2), (3, {"c": "y"}, 1)], "id bigint, metadata map<string,string>, n int")
    assert rows(records.upsert(c, new, "n")) == [(1, {"a": "1"}), (2, None), (3, {"c": "y"})]
    assert rows(records.update_metadata(c, new, "n")) == [(1, {"a": "1"}), (2, None)]
    assert rows(records.delete(c, new).select("id")) == [(1,)]
    assert records.count_new(new, c).first()[0] == 1 and records.count(c.limit(0)).first()[0] == 0
    assert rows(records.postings(c)) == [("a", "1", 1), ("a", "2", 1)]


def test_limits_and_violations(spark):
    big = spark.createDataFrame([({str(i): "" for i in range(65)},), ({"k": "v" * 16383},), ({"k": "é" * 8192},), (None,), ({"k": None},)], "metadata map<string,string>")
    assert [r[0] for r in big.select(records.metadata_fits()).collect()] == [False, True, False, True, True]
    names = ["../escape", "a/b", ".", ".hidden", "*", "api_keys.json", "", "x" * 129, "acme", "a b"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    assert [r[0] for r in df.select(valid_tenant(F.col("t"))).collect()] == [False] * 8 + [True] * 2
    ten = spark.createDataFrame([("acme", 2), (None, 3)], "tenant_id string, dim int")
    batch = [("acme", 1, [1.0, 2.0], None), ("acme", 2, [1.0], None), (None, 3, [1.0, 2.0, float("nan")], None), ("no", 4, [1.0], None), ("acme", None, [1.0, 2.0], None), ("acme", 6, None, None), ("a/b", 7, [1.0], None)]
    got = rows(records.batch_violations(spark.createDataFrame(batch, "tenant_id string, id bigint, vec array<float>, metadata map<string,string>"), ten))
    assert got == [("a/b", 7, "bad tenant"), ("acme", 2, "bad dim"), ("acme", 6, "bad dim"), ("acme", None, "bad id"), ("default", 3, "not finite"), ("no", 4, "unknown tenant")]


def test_quota_and_rate(spark):
    ten = spark.createDataFrame([("a", 2, "l2", 3, 1.0), ("b", 2, "l2", 0, None)], "tenant_id string, dim int, metric string, max_vectors bigint, max_qps double")
    have = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "tenant_id string, id bigint")
    batch = spark.createDataFrame([("a", 2), ("a", 3), ("a", 4), ("b", 7)], "tenant_id string, id bigint")
    assert rows(tenants.quota_check(batch, have, ten)) == [("a", 2, 2, False), ("b", 1, 1, True)]
    assert rows(tenants.tenant_stats(have, ten).select("tenant_id", "n_vectors")) == [("a", 2), ("b", 1)]
    req = spark.createDataFrame([("c", i, f"2024-01-01 00:00:0{s}") for i, s in enumerate([0, 0, 0, 1, 3])], "client string, request_id int, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = tenants.rate_limited(req, "client", "at", 2.0).orderBy("request_id").collect()
    assert [r["allowed"] for r in got] == [True, True, False, True, True]


def test_keys(spark):
    ks = spark.createDataFrame([("1", ["a"], False, "h"), ("2", ["*"], False, "h"), ("3", None, True, "h"), ("4", ["a", "b"], None, "h"), ("5", None, None, "h")], "key_id string, tenants array<string>, admin boolean, key_hash string").withColumn("expires_at", F.lit(None).cast("timestamp"))
    assert [r[0] for r in rows(tenants.keys_allowing(ks, "b").select("key_id"))] == ["2", "3", "4"]
    assert [r[0] for r in rows(tenants.drop_tenant_from_keys(ks, "a").select("key_id"))] == ["2", "3", "4", "5"]


def test_ring(spark):
    n = lambda k: spark.createDataFrame([(f"n{i}",) for i in range(k)], "node string")
    s = spark.range(1024).select(F.col("id").alias("shard"))
    load = [r[0] for r in shard.ring_owners(s, n(8)).groupBy("node").count().select("count").collect()]
    assert len(load) == 8 and min(load) >= 64 and max(load) <= 256
    moved = shard.rebalance(s, n(4), n(5)).collect()
    assert 0 < len(moved) <= 0.4 * 1024 and {r["node_after"] for r in moved} == {"n4"}
    assert shard.ring_owners(s, n(3), 5).groupBy("shard").agg(F.count_distinct("node").alias("c")).where("c <> 3").count() == 0
    assert rows(shard.with_shard(spark.createDataFrame([(None,), (2**62,)], "id bigint"), 4).select("shard"))[-1] == (None,)
    up = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, "c", None)], "shard int, node string, seq bigint")
    assert rows(shard.failover(up)) == [(1, "a")]


def _blobs(n, dim, k, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-1, 1, (k, dim))
    return (centres[rng.integers(k, size=n)] + rng.normal(0, spread, (n, dim))).astype(np.float32)


def test_kmeans_and_codebook(spark):
    rng = np.random.default_rng(1)
    x = (10 * (np.arange(2000) % 8)[:, None] + rng.uniform(0, 0.1, (2000, 16))).astype(np.float32)
    book = quantize.train_codebook(frame(spark, x), 4, 16)
    codes = book.encode(x.astype(float))
    assert ((book.decode(codes) - x) ** 2).sum(1).max() < 1.0
    q = x[5].astype(float)
    t = book.table(q)
    adc = t[np.arange(4)[None], codes].sum(1)
    assert np.allclose(adc, ((book.decode(codes) - q) ** 2).sum(1), rtol=1e-4, atol=1e-9)
    with pytest.raises(ValueError):
        quantize.kmeans(x, 0)
    bad = spark.createDataFrame([(1, [0, 0, 0, 0]), (2, [0, 0]), (3, [0, 0, 0, 99]), (4, None)], "id bigint, code array<smallint>")
    assert {r[0]: r[1] is None for r in quantize.decode(bad, book).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_code_search_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (3000, 64)).astype(np.float32)
    v, q = frame(spark, x), frame(spark, rng.uniform(-1, 1, (30, 64)).astype(np.float32), "query_id")
    book = quantize.train_codebook(v, 16, 256, 2000)
    codes = quantize.encode(v, book).cache()
    truth = search.knn_join(q, v, 10, "l2").cache()
    mean = lambda df: metrics.recall(df, truth).agg(F.avg("recall")).first()[0]
    assert mean(quantize.code_search(q, codes, book, 10)) >= 0.45
    assert mean(quantize.code_search_reranked(q, codes, v, book, 10, 100)) >= 0.95
    assert quantize.code_search(q, codes, book, 0).count() == 0


def test_inverted_lists(spark):
    x = _blobs(2000, 32, 20, 0.2, 5)
    v, q = frame(spark, x), frame(spark, x[:20], "query_id")
    book, lists = quantize.train_codebook(v, 8, 32), quantize.train_lists(v, 16)
    index = quantize.ivf_index(v, book, lists).cache()
    whole = rows(quantize.code_search(q, quantize.encode(v, book), book, 10))
    assert rows(quantize.code_search(q, index, book, 10, lists, 16)) == whole
    truth = search.knn_join(q, v, 10, "l2")
    found = quantize.code_search_reranked(q, index, v, book, 10, 100, lists, 4)
    assert metrics.recall(found, truth).agg(F.avg("recall")).first()[0] >= 0.9


def test_graph_recall_and_deletes(spark):
    rng = np.random.default_rng(42)
    x = rng.uniform(-1, 1, (2000, 32)).astype(np.float32)
    q = rng.uniform(-1, 1, (50, 32)).astype(np.float32)
    c = shard.with_shard(frame(spark, x), 4)
    graphs = hnsw.build_graphs(c).cache()
    assert hnsw.graph_problems(graphs).count() == 0
    queries = frame(spark, q, "query_id")
    truth = search.knn_join(queries, c, 10, "l2")
    found = hnsw.search_graphs(queries, graphs, 10, ef=100)
    assert metrics.recall(found, truth).agg(F.avg("recall")).first()[0] >= 0.9
    gone = spark.range(1000)
    assert hnsw.search_graphs(queries, graphs, 10, ef=100, deleted=gone).where("id < 1000").count() == 0


def test_graph_edges():
    assert hnsw.Graph(np.zeros((0, 3))).search(np.zeros(3), 5) == []
    g = hnsw.Graph(np.array([[1, 0], [1.05, 0], [1, 0.05], [0, 1.1]]), m=2)
    assert g._spread([(d, v) for v, d in enumerate(g._d(np.zeros(2), range(4)))], 2) == [0, 3]
    g.dead[:] = True
    assert g.search(np.zeros(2), 3) == [] and hnsw.width(0, 10) == 64 and hnsw.width(0, 100) == 100


def test_measures_and_texts(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)] + [(None,)], "v double")
    assert tuple(metrics.percentiles(df, "v", {"a": 0.5, "b": 0.95, "c": 1.0}).first()) == (51.0, 96.0, 100.0)
    assert tuple(metrics.percentiles(df, "v", {"a": 0.5}, "load").first()) == (50.0,)
    docs = spark.createDataFrame([(1, "a" * 40 + "\n\nshort\n\n  " + "b" * 41), (2, None), (3, "")], "doc_id int, text string")
    assert [r[:2] for r in rows(text.paragraphs(docs))] == [(1, 0), (1, 2)]
    assert rows(text.distinct_texts(docs.union(docs)).select("n_rows")) == [(2,)]
    assert [r[0] is None for r in docs.select(text.text_id("text")).collect()] == [False, True, False]
    assert sorted(r[0] for r in text.text_problems(docs).select("doc_id").collect()) == [2, 3]


def test_percentiles_of_ranges_equal_sorting(spark):
    rng = np.random.default_rng(5)
    v, g = rng.integers(0, 60, 4000), rng.choice(["a", "b", None], 4000, p=[0.9, 0.05, 0.05])
    df = spark.createDataFrame([(int(a), b) for a, b in zip(v, g)], "v int, g string").repartition(5)
    points = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    want = lambda x: tuple(int(np.sort(x)[min(int(len(x) * p), len(x) - 1)]) for p in points.values())
    assert rows(metrics.percentiles(df, "v", points)) == [want(v)]
    assert {r[0]: tuple(r)[1:] for r in metrics.percentiles(df, "v", points, by=["g"]).collect()} == {k: want(v[[x == k for x in g]]) for k in ("a", "b", None)}


def test_index_upkeep(spark, tmp_path):
    x = _blobs(600, 16, 8, 0.2, 3)
    v = frame(spark, x)
    book, lists = quantize.train_codebook(v, 4, 16), quantize.train_lists(v, 8)
    old, new = v.where("id < 400"), v.where("id >= 300").select("id", F.lit(1).alias("at"), "vec")
    moved = v.where("id < 100").select("id", F.lit(2).alias("at"), F.transform("vec", lambda c: -c).alias("vec"))
    stale = moved.select("id", F.lit(1).alias("at"), F.transform("vec", lambda c: c * 0).alias("vec"))
    index = quantize.index_insert(quantize.ivf_index(old, book, lists), new.unionByName(moved).unionByName(stale), book, "at", lists)
    want = quantize.ivf_index(v.where("id >= 100").select("id", "vec").unionByName(moved.select("id", "vec")), book, lists)
    assert rows(index.select("id", "code", "list_id")) == rows(want)
    flat = quantize.index_insert(quantize.encode(old, book), new, book, "at")
    assert rows(flat) == rows(quantize.encode(v, book)) and quantize.index_size(flat).first()[0] == 600
    less = quantize.index_delete(index, spark.range(50, 5000))
    assert quantize.index_size(less).first()[0] == 50
    quantize.write_index(index, str(tmp_path / "ivf"))
    stored = spark.read.parquet(str(tmp_path / "ivf"))
    q = frame(spark, x[:3], "query_id")
    found = quantize.code_search(q, stored, book, 5, lists, 2)
    assert rows(found) == rows(quantize.code_search(q, index, book, 5, lists, 2))
    assert "PartitionFilters: [isnotnull(list_id" in found._jdf.queryExecution().toString() or "list_id#" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_decoding_of_malformed_codes(spark):
    book = quantize.Codebook(np.arange(8.0).reshape(2, 2, 2))
    codes = spark.createDataFrame([(1, [0, 1]), (2, [1]), (3, None), (4, [0, 2]), (5, [None, 1]), (6, [-1, 0]), (7, [1, 1]), (8, [])], "id int, code array<smallint>")
    got = {r["id"]: r["vec"] for r in quantize.decode(codes, book).collect()}
    assert got == {1: [0.0, 1.0, 6.0, 7.0], 7: [2.0, 3.0, 6.0, 7.0], **{i: None for i in (2, 3, 4, 5, 6, 8)}}


def test_graph_upkeep(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, (900, 12)).astype(np.float32)
    c = shard.with_shard(frame(spark, x), 3)
    graphs = hnsw.build_graphs(c.where("id < 500"))
    again = shard.with_shard(frame(spark, -x).where("id < 50"), 3)
    grown = hnsw.insert_into_graphs(graphs, c.where("id >= 500").unionByName(again.select(*c.columns))).cache()
    assert hnsw.graph_problems(grown).count() == 0 and sorted(r["id"] for r in hnsw.graph_ids(grown).collect()) == list(range(900))
    assert sum(r["n_dead"] for r in hnsw.tombstones(grown).collect()) == 50
    now = again.select("id", "vec").unionByName(c.where("id >= 50").select("id", "vec"))
    queries = frame(spark, rng.uniform(-1, 1, (40, 12)).astype(np.float32), "query_id")
    recall = lambda g, truth: metrics.recall(hnsw.search_graphs(queries, g, 10, ef=100), truth).agg(F.avg("recall")).first()[0]
    assert recall(grown, search.knn_join(queries, now, 10, "l2")) >= 0.9
    dead = hnsw.delete_from_graphs(grown, spark.range(0, 600))
    assert hnsw.compact_graphs(dead, min_dead=10_000).where("dead").count() == dead.where("dead").count()
    small = hnsw.compact_graphs(dead, min_dead=10).cache()
    assert small.where("dead").count() == 0 and small.count() == 300 and hnsw.graph_problems(small).count() == 0
    assert recall(small, search.knn_join(queries, now.where("id >= 600"), 10, "l2")) >= 0.9
