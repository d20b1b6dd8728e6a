from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.llm import clusters, mih, subset
from quiverlake.llm.vectors import current_vectors
from tests.conftest import rows

VEC = "tenant_id string, id bigint, vec array<float>, metadata map<string,string>, received_at timestamp"
TEN = "tenant_id string, dim int, metric string"


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def vectors(spark, data):
    """(tenant, id, numbers) rows."""
    return spark.createDataFrame([(t, i, [float(x) for x in v], {"topic": str(i % 3)}, at(0)) for t, i, v in data], VEC)


def tenants(spark, *pairs):
    return spark.createDataFrame([(t, d, "l2") for t, d in pairs], TEN)


def unit(x):
    x = np.asarray(x, np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def groups(rng, n, dim, k, spread=0.35):
    c = unit(rng.normal(size=(k, dim)))
    own = rng.integers(k, size=n)
    return (unit(c[own] + spread / np.sqrt(dim) * rng.normal(size=(n, dim))) * rng.uniform(0.1, 9, n)[:, None]).astype(np.float32)


ODD = [
    ("a", 1, [1.0, 0.0], None, at(1)), ("a", 1, [0.0, 1.0], {"x": None}, at(5)), ("a", 1, [5.0, 5.0, 5.0], None, at(9)), ("a", 1, [0.0, 0.0], None, at(9)), ("a", 1, [float("nan"), 1.0], None, at(9)),
    ("a", 1, [float("inf"), 1.0], None, at(9)), ("a", 1, [None, 1.0], None, at(9)), ("a", 1, None, None, at(9)), ("a", 1, [0.0, 1.0], {"x": None}, at(5)), ("a", 2, [2.0, 2.0], {}, None), ("a", None, [1.0, 1.0], None, at(1)),
    (None, 7, [1.0, 2.0], None, at(1)), ("", 7, [1.0, 3.0], None, at(2)), ("none", 1, [1.0, 1.0], None, at(1)), ("nodim", 1, [1.0], None, at(1)),
]


def test_current_vectors(spark):
    t = tenants(spark, ("a", 2), ("a", 2), (None, 2), ("nodim", None))
    got = rows(current_vectors(spark.createDataFrame(ODD, VEC).withColumn("dim", F.lit("clash")), t).select("tenant_id", "id", "vec"))
    assert got == [("a", 1, [0.0, 1.0]), ("a", 2, [2.0, 2.0]), ("default", 7, [1.0, 3.0])]


def nearest_truth(x, ids, limit):
    u = unit(x)
    d = 1 - u @ u.T
    np.fill_diagonal(d, 9)
    j = d.argmin(1)
    return {(min(ids[i], ids[j[i]]), max(ids[i], ids[j[i]])) for i in range(len(ids)) if d[i, j[i]] <= limit and j[j[i]] == i}


@pytest.mark.parametrize("block_rows", [100, 100_000])
def test_mutual_pairs_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(4)
    data, want = [], set()
    for tenant, n, dim in (("a", 1500, 24), ("b", 40, 48), (None, 12, 5)):
        x = groups(rng, n, dim, 5)
        close = rng.permutation(n)[: n // 10]
        near = (x[close] + 0.02 * np.abs(x[close]).mean() * rng.normal(size=(len(close), dim))).astype(np.float32)
        x, ids = np.vstack([x, near]), rng.permutation(100_000)[: n + len(close)]
        data += [(tenant, int(i), v) for i, v in zip(ids, x)]
        want |= {(tenant or "default", *p) for p in nearest_truth(x, [int(i) for i in ids], 0.01)}
    t = tenants(spark, ("a", 24), ("b", 48), (None, 5))
    got = rows(mih.mutual_pairs(mih.near_pairs(vectors(spark, data).repartition(5), t, block_rows=block_rows)))
    assert got == sorted(want, key=repr) and len(want) > 50


def test_pairs_of_a_large_tenant_are_sought_in_small_cells(spark, monkeypatch):
    """Groups that planes can't halve: the codes tell nearly all pairs of a group apart."""
    from quiverlake.llm import cells

    rng = np.random.default_rng(6)
    x = groups(rng, 12_000, 32, 6, 0.6)
    close = rng.permutation(12_000)[:600]
    x = np.vstack([x, (unit(x[close]) + rng.uniform(0.001, 0.13, (600, 1)) * unit(rng.normal(size=(600, 32)))).astype(np.float32), x[:20], 2 * x[20:30]])
    ids = rng.permutation(100_000)[: len(x)]
    u = unit(x).astype(np.float32)
    monkeypatch.setattr(cells, "LOOKUP_NS", 0.01)
    monkeypatch.setattr(cells, "CODE_NS", 0.01)
    tree = cells.learn_cells(u[:4096], len(u), cells.margin_of(0.01))
    placed = tree.place(u)
    assert all(c.coded for c in tree.cells) and len(placed) >= 6 and sum(map(len, placed)) < 1.2 * len(u) and max(map(len, placed)) < 0.3 * len(u)
    monkeypatch.setattr(cells, "CHUNK", 1000)
    for at, cell in zip(placed, tree.cells):
        got = sum(len(a) for a, _ in cells.code_pairs(cell.codes(u[at]), cell, tree.margin))
        assert got < 0.02 * len(at) ** 2 / 2
    data = [("a", int(i), v) for i, v in zip(ids, x)] + [("b", i, v) for i, v in enumerate(x[:50, :8])]
    got = rows(mih.near_pairs(vectors(spark, data).repartition(5), tenants(spark, ("a", 32), ("b", 8)).withColumn("dim", F.col("dim").cast("bigint")), block_rows=1000).where("tenant_id = 'a'").select("id", "near_id", "distance"))
    d = np.round(1 - unit(x.astype(np.float64)) @ unit(x.astype(np.float64)).T, 12)
    np.fill_diagonal(d, 9)
    some = np.flatnonzero(d.min(1) <= 0.01)
    row = {int(k): i for i, k in enumerate(ids)}
    assert {r[0] for r in got} == {int(ids[i]) for i in some} and len(got) == len(some) > 1000
    assert all(abs(d[row[i], row[j]] - d[row[i]].min()) < 1e-11 and abs(far - d[row[i]].min()) < 1e-11 for i, j, far in got)


@pytest.mark.parametrize("n, dim, decay, apart", [(25, 64, 0.0, 0.1), (61, 64, 0.0, 0.1), (2500, 64, 1.5, 0.1), (2500, 64, 3.0, 0.05), (1200, 8, 0.0, 0.1)])
def test_pairs_of_few_rows_and_low_rank(n, dim, decay, apart):
    rng = np.random.default_rng(n)
    x = unit(rng.normal(size=(n, dim)) * np.arange(1, dim + 1) ** -decay)
    near = unit(rng.normal(size=(n // 5, dim)) * np.arange(1, dim + 1) ** -decay)
    x = np.vstack([x, unit(x[: n // 5] + apart * near)]).astype(np.float32)
    ids = rng.permutation(10 * len(x))[: len(x)]
    other = mih.learn_rotation(unit(rng.normal(size=(2000, dim)) + 3 * np.eye(dim)[0]).astype(np.float32), 0.14)  # of quite another tenant
    for rotation in (mih.learn_rotation(unit(x).astype(np.float32), 0.14), other):
        _same_as_brute_force(x, ids, n, rotation)


def _same_as_brute_force(x, ids, n, rotation):
    who, best = mih.nearest_within(x, ids, 0.01, rotation)
    u = unit(x)
    d = np.round(1 - u @ u.T, 12)
    np.fill_diagonal(d, 9)
    some = d.min(1) <= 0.01
    assert (np.isfinite(best) == some).all() and some.sum() >= 2 * (n // 5) * 0.9
    assert np.abs(best[some] - d.min(1)[some]).max() < 1e-11
    assert (d[np.flatnonzero(some), [{int(k): i for i, k in enumerate(ids)}[int(w)] for w in who[some]]] <= d.min(1)[some] + 1e-11).all()


@pytest.mark.parametrize("n, dim, spread", [(2, 8, 0.0), (4, 64, 0.0), (8, 32, 0.0), (16, 64, 0.05), (40, 128, 0.1), (64, 64, 0.3), (6000, 48, 0.02)])
def test_planted_pairs_of_small_and_narrow_tenants(n, dim, spread):
    """One close pair, and rows around few centres or in one narrow cone."""
    rng = np.random.default_rng(n)
    rotation = mih.learn_rotation(unit(rng.normal(size=(500, dim))).astype(np.float32), 0.14)
    for _ in range(20 if n < 1000 else 1):
        x = unit(np.eye(dim)[rng.integers(3, size=n)] + spread * rng.normal(size=(n, dim))) if spread else unit(rng.normal(size=(n, dim)))
        x[0] = unit(x[1:2] + 0.13 * unit(rng.normal(size=(1, dim))))[0]
        who, best = mih.nearest_within(x.astype(np.float32), np.arange(n), 0.01, rotation)
        d = 1 - x @ x.T
        np.fill_diagonal(d, 9)
        assert (np.isfinite(best) == (d.min(1) <= 0.01)).all() and np.isfinite(best[1])


def test_dense_blocks_are_compared_by_products():
    rng = np.random.default_rng(3)
    x = unit(np.eye(16)[0] + 0.003 * rng.normal(size=(5000, 16))).astype(np.float32)
    rotation = mih.learn_rotation(unit(rng.normal(size=(500, 16))).astype(np.float32), 0.14)
    assert mih.CodeIndex(rotation.codes(x, False)).expected() > mih.DENSE_SHARE * 5000**2 / 2
    who, best = mih.nearest_within(x, np.arange(5000), 0.01, rotation)
    d = 1 - x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(d, 9)
    assert np.abs(best - d.min(1)).max() < 1e-6


def test_pairs_of_copies_and_odd_rows(spark):
    data = [("a", i, [1.0, 2.0, 3.0]) for i in (5, 3, 9, 1)] + [("a", 20, [2.0, 4.0, 6.0]), ("b", 1, [1.0, 2.0, 3.0])]
    t = tenants(spark, ("a", 3), ("b", 3))
    near = {(r[0], r[1]): r[2] for r in mih.near_pairs(vectors(spark, data), t).collect()}
    assert near["a", 5] == near["a", 9] == 1 and near["a", 1] == 3 and near["a", 3] == 1 and ("b", 1) not in near
    assert rows(mih.mutual_pairs(mih.near_pairs(vectors(spark, data), t))) == [("a", 1, 3)]
    t = tenants(spark, ("a", 2), (None, 2))
    assert rows(mih.near_pairs(spark.createDataFrame(ODD, VEC), t)) == []
    assert rows(mih.near_pairs(spark.createDataFrame([], VEC), t)) == [] and rows(mih.similar_vectors(spark.createDataFrame([], VEC), t)) == []


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**63, (300, 3), dtype=np.int64).astype(np.uint64)
    for i in range(150):
        flips = rng.permutation(192)[: rng.integers(1, 24)]
        codes[150 + i] = codes[i]
        for f in flips:
            codes[150 + i, f // 64] ^= np.uint64(1) << np.uint64(f % 64)
    got = {(min(a, b), max(a, b)) for x, y in mih.CodeIndex(codes).pairs(23) for a, b in zip(x.tolist(), y.tolist())}
    apart = np.bitwise_count(codes[:, None] ^ codes[None]).sum(2)
    assert got == {(a, b) for a, b in zip(*np.nonzero(apart <= 23)) if a < b} and len(got) >= 150


@pytest.mark.parametrize("block_rows", [400, 100_000])
def test_similar_vectors_recall(spark, block_rows):
    rng = np.random.default_rng(8)
    x = groups(rng, 3000, 32, 6, 0.6)
    u = unit(x)
    got = mih.similar_vectors(vectors(spark, [("a", i, v) for i, v in enumerate(x)]), tenants(spark, ("a", 32)), k=10, rerank=50, block_rows=block_rows).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r["id"], set()).add(r["near_id"])
    assert set(found) == set(range(0, 3000, 20))
    hits = 0
    for q, near in found.items():
        d = 1 - u @ u[q]
        d[q] = 9
        hits += len(near & set(np.argsort(d)[:10].tolist()))
    assert hits / (10 * len(found)) >= 0.9


def cluster_truth(x, ids, limit):
    u = unit(x)
    near = u @ u.T >= 1 - limit
    out = set()
    for i in range(len(ids)):
        own = np.flatnonzero(near[i])
        if len(own) >= 3 and all((near[j] == near[i]).all() for j in own):
            head = min(ids[j] for j in own)
            out |= {(head, ids[j]) for j in own}
    return out


@pytest.mark.parametrize("node_rows", [150, 100_000])
def test_clusters_equal_brute_force(spark, node_rows):
    rng = np.random.default_rng(3)
    data, want = [], set()
    axes = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    for tenant, spread in (("a", 0.3), ("b", 0.45), ("c", 0.6)):  # tight, wide, and too wide in part
        own = axes[rng.integers(8, size=500)] + spread / np.sqrt(24) * rng.normal(size=(500, 24))
        x = np.vstack([own, axes[10:16], -axes[2:3]])
        if tenant == "b":
            x = np.vstack([x, axes[:1] + axes[1:2]])  # near two groups, which are no clusters then
        ids = [int(i) for i in rng.permutation(10_000)[: len(x)]]
        data += [(tenant, i, v) for i, v in zip(ids, x)]
        want |= {(tenant, *c) for c in cluster_truth(x.astype(np.float32), ids, 0.55)}
    got = clusters.mutual_clusters(vectors(spark, data).repartition(4), tenants(spark, ("a", 24), ("b", 24), ("c", 24)), node_rows=node_rows, with_vec=True).cache()
    assert rows(got.select("tenant_id", "head_id", "id")) == sorted(want, key=repr) and len(want) > 600
    told = clusters.cluster_descriptions(got, 3).collect()
    sizes = {(t, h): sum(1 for w in want if w[:2] == (t, h)) for t, h, _ in want}
    assert {(r["tenant_id"], r["head_id"]): r["size"] for r in told} == sizes
    place = {(t, i): unit([v])[0] for t, i, v in data}
    for r in told:
        own = sorted(i for t, h, i in want if (t, h) == (r["tenant_id"], r["head_id"]))
        x = np.array([place[r["tenant_id"], i] for i in own])
        far = 1 - x @ unit([x.sum(0)])[0]
        assert r["typical_ids"] == [own[k] for k in np.lexsort((own, far.round(9)))[:3]]


@pytest.mark.parametrize("paired", [2, 128])
def test_clusters_of_loose_data(spark, monkeypatch, paired):
    """Many leaves, some groups among rows without any."""
    monkeypatch.setattr(clusters, "PAIRED", paired)
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(300, 6)), np.eye(6)[rng.integers(3, size=20)] * 1.0]).astype(np.float32)
    y = np.vstack([np.eye(64)[k] + 0.03 * rng.normal(size=(n, 64)) for k, n in enumerate((3, 2, 1, 4, 5, 3, 8))]).astype(np.float32)
    least = 0.45
    for z in (x, y):
        u = unit(z).astype(np.float32)
        leaf, centres = clusters.bisect(u, least)
        assert all((u[leaf == k] @ u[leaf == k].T >= least).all(1).any() for k in range(len(centres)))
        sizes = np.bincount(leaf)
        edges = clusters._edges(u, leaf, centres, u, leaf, centres, least, True)
        a, b, every = (np.array([e[k] for e in edges], bool if k == 2 else np.int64) for k in range(3))
        found = clusters.clusters_of(sizes, a, b, every)
        got = {}
        for row, k in enumerate(leaf):
            if found[k] >= 0:
                got.setdefault(found[k], []).append(row)
        assert {(min(m), r) for m in got.values() for r in m} == cluster_truth(z, list(range(len(z))), 0.55)


def test_clusters_of_odd_rows(spark):
    t = tenants(spark, ("a", 2), (None, 2))
    assert rows(clusters.mutual_clusters(spark.createDataFrame(ODD, VEC), t)) == [] == rows(clusters.mutual_clusters(spark.createDataFrame([], VEC), t))
    same = [("a", i, [1.0, 2.0]) for i in range(5, 9)] + [("a", 1, [-1.0, 0.0]), ("a", 2, [-1.0, 0.1])]
    assert [r[:3] for r in rows(clusters.mutual_clusters(vectors(spark, same), t))] == [("a", 5, i) for i in range(5, 9)]


def test_relation_bounds_agree_with_the_product(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(clusters, "BLOCK", 4)
    for k in range(200):
        a = unit(rng.normal(size=6) + rng.uniform(0, 0.6) * rng.normal(size=(rng.integers(1, 20), 6))).astype(np.float32)
        b = unit(rng.normal(size=6) + rng.uniform(0, 0.6) * rng.normal(size=(rng.integers(1, 20), 6))).astype(np.float32)
        near = a @ b.T >= 0.45
        assert clusters.relation(a, b, clusters._centre(a), clusters._centre(b), 0.45) == (near.any(), near.all()), k


def test_varied_subset(spark):
    rng = np.random.default_rng(5)
    x = groups(rng, 1200, 16, 6, 0.2)
    big = np.vstack([x[:1], x[:1] * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32) + 0.001 * rng.normal(size=(3000, 16)).astype(np.float32)])
    data = [("a", i, v) for i, v in enumerate(np.vstack([x, big]))] + [("b", 1, [1.0, 0.0])]
    t = tenants(spark, ("a", 16), ("b", 2))
    df = vectors(spark, data).withColumn("group_no", F.lit("clash"))
    got = subset.varied_subset(df.repartition(6), t, 24).cache()
    mine = [r for r in got.collect() if r["tenant_id"] == "a"]
    assert 20 <= len(mine) <= 24 and len({r["id"] for r in mine}) == len(mine)
    assert sum(r["group_size"] for r in mine) == 4201
    assert sum(r["id"] >= 1200 for r in mine) <= 12  # five in seven of all rows, far less of the subset
    u, picked = unit(x), unit(np.vstack([x, big])[[r["id"] for r in mine]])
    assert (u @ picked.T).max(1).min() > 0.8  # every group is covered
    assert [r["id"] for r in got.collect() if r["tenant_id"] == "b"] == [1]
    assert rows(subset.varied_subset(spark.createDataFrame([], VEC), t)) == []
    odd = rows(subset.varied_subset(spark.createDataFrame(ODD, VEC), tenants(spark, ("a", 2), (None, 2))).select("tenant_id", "id"))
    assert odd == [("a", 1), ("a", 2), ("default", 7)]


@pytest.mark.parametrize("parts", [1, 7])
def test_varied_subset_is_of_the_given_size(spark, parts):
    rng = np.random.default_rng(9)
    tight = unit(rng.normal(size=(5, 32)))[rng.integers(5, size=6000)] + 0.3 / np.sqrt(32) * rng.normal(size=(6000, 32))
    close = np.repeat(np.array([1.0, 0]) + 0.01 * np.array([[0.0, i] for i in range(40)]), 12, axis=0)
    few = np.repeat(np.eye(32)[:20], 30, axis=0)
    data = [(t, i, v) for t, x in (("tight", tight), ("close", close), ("few", few)) for i, v in enumerate(x)]
    df = vectors(spark, data).withColumn("metadata", F.create_map(F.lit("topic"), F.lit("one")))
    got = subset.varied_subset(df.repartition(parts), tenants(spark, ("tight", 32), ("close", 2), ("few", 32))).collect()
    for t, x, want in (("tight", tight, 32), ("close", close, 32), ("few", few, 20)):
        mine = [r for r in got if r["tenant_id"] == t]
        assert len(mine) == want == len(np.unique(x[[r["id"] for r in mine]], axis=0)) and len({r["group_no"] for r in mine}) == want
        assert sum(r["group_size"] for r in mine) == len(x)


def test_summaries_merge_by_levels(spark, monkeypatch):
    monkeypatch.setattr(subset, "FAN_IN", 2)
    rng = np.random.default_rng(4)
    x = unit(rng.normal(size=(40, 16)))[np.minimum(39, rng.integers(400, size=4000))] + 0.02 * rng.normal(size=(4000, 16))  # one group holds nine rows in ten
    df = vectors(spark, [("a", i, v) for i, v in enumerate(x)]).withColumn("metadata", F.lit(None).cast("map<string,string>"))
    monkeypatch.setattr(subset, "current_vectors", lambda v, t, *e: current_vectors(v, t, *e).repartition(11))
    got = subset.varied_subset(df, tenants(spark, ("a", 16)), 40).collect()
    assert len(got) == 40 and sum(r["group_size"] for r in got) == 4000
    u = unit(x)
    far = lambda ids: (1 - (u @ u[ids].T).max(1)).mean()
    assert far([r["id"] for r in got]) < 0.5 * far(rng.permutation(4000)[:40])


def test_components():
    rng = np.random.default_rng(2)
    for n, e in ((1, 0), (50, 20), (300, 280), (300, 900)):
        a, b = rng.integers(n, size=e), rng.integers(n, size=e)
        top = list(range(n))
        for _ in range(n):
            for i, j in zip(a, b):
                top[i] = top[j] = min(top[i], top[j])
        assert clusters.components(n, a, b).tolist() == top
    path = rng.permutation(20_000)
    assert (clusters.components(20_000, path[:-1], path[1:]) == 0).all()


def test_ward_cuts_at_k():
    c = np.array([[0, 0], [0, 1], [10, 0], [10, 1], [50, 0.0]])
    assert sorted(np.bincount(subset.ward(np.ones(5), c, 3)).tolist()) == [1, 2, 2] and len(set(subset.ward(np.ones(5), c, 5))) == 5
