from __future__ import annotations

import datetime

import pytest

from quiverlake.session import shared_dir
from quiverlake.store import BatchTooLarge, RateLimited, Store, StoreError


@pytest.fixture(scope="module")
def store(spark):
    s = Store(spark, shared_dir(spark, "t-store"), 2)
    s.create_tenant("acme", 3, "l2", max_vectors=4)
    s.create_tenant("globex", 2)
    return s


def ids(df):
    return [int(r["id"]) for r in df.collect()]


def test_records(store):
    store.batch_upsert([{"id": i, "values": [i, 0, 0], "metadata": {"price": str(5 + 10 * (i - 1))}, "tenant_id": "acme"} for i in (1, 2, 3)])
    store.insert(str(2**64 - 1), [9, 9, 9], tenant_id="acme")
    store.insert(1, [3.0, 4.0], {"team": "search"}, "globex")
    assert store.count("acme") == 4 and store.count("globex") == 1
    assert ids(store.search([0, 0, 0], 2, "acme")) == [1, 2]
    assert ids(store.search([0, 0, 0], 9, "acme", where=[("price", "gte", 15)])) == [2, 3]
    assert ids(store.search([1, 1], 9, "globex", filters={"team": "search"})) == [1]
    assert store.get(1, "globex").first()["vec"] == pytest.approx([0.6, 0.8])  # cosine keeps unit vectors
    page = store.list("acme", 0, 3).collect()
    assert [int(r["id"]) for r in page] == [1, 2, 3] and int(page[0]["next_id"]) == 4
    assert ids(store.list("acme", 4, 3)) == [2**64 - 1]
    store.insert(2, [7, 7, 7], None, "acme")  # overwriting is free, and clears the metadata
    assert store.get(2, "acme").first()["metadata"] is None
    store.update_metadata(2, {"a": "b"}, "acme")
    assert store.get(2, "acme").first()["metadata"] == {"a": "b"} and store.get(2, "acme").first()["vec"] == [7, 7, 7]
    assert store.delete(3, "acme") and store.delete(12345, "acme") and store.count("acme") == 3
    store.compact()
    assert store.count("acme") == 3 and {r["tenant_id"]: r["n_vectors"] for r in store.list_tenants().collect()} == {"acme": 3, "globex": 1}


def test_refused_calls_write_nothing(store):
    good = {"id": 50, "values": [1, 1], "tenant_id": "globex"}
    before = store.count("globex")
    for bad in ({"id": 51, "values": [1], "tenant_id": "globex"}, {"id": 51, "values": [1, 1], "tenant_id": "nobody"}, {"id": 51, "values": [1, float("inf")], "tenant_id": "globex"}):
        with pytest.raises(StoreError):
            store.batch_upsert([good, bad])
    with pytest.raises(StoreError):
        store.batch_upsert([{"id": 60 + i, "values": [1, 1, 1], "tenant_id": "acme"} for i in range(3)])
    for call in (
        lambda: store.create_tenant("acme", 3), lambda: store.create_tenant("../x", 3), lambda: store.create_tenant("y", 0), lambda: store.set_quota("acme", -1, 0), lambda: store.delete_tenant("default"),
        lambda: store.search([1, 1], 3, "acme"), lambda: store.search([1, 1, 1], 3, "acme", metric="dot"), lambda: store.get("x1", "acme"), lambda: store.get(2**64, "acme"), lambda: store.update_metadata(99, {}, "acme"), lambda: store.count("nobody"),
    ):
        with pytest.raises(StoreError):
            call()
    assert store.count("globex") == before


def test_texts_and_keys(store):
    embed = lambda texts: [[t.count("cat") + 0.01, t.count("dog") + 0.01] for t in texts]
    store.create_tenant("texts", 2)
    first = store.add_texts(["a cat sat", "the dog ran"], embed, tenant_id="texts")
    assert store.add_texts(["a cat sat"], embed, tenant_id="texts") == first[:1] and store.count("texts") == 2
    assert store.search_texts("dog", embed, 1, tenant_id="texts").first()["metadata"]["text"] == "the dog ran"
    with pytest.raises(StoreError):
        store.add_texts([" "], embed, tenant_id="texts")
    key, secret = store.create_key(["texts"])
    _, late = store.create_key(["texts"], ttl=datetime.timedelta(microseconds=1))
    _, admin = store.create_key(admin=True)
    assert store.allowed(secret, "texts") and not store.allowed(secret, "acme") and not store.allowed(late, "texts") and store.allowed(admin, "acme") and not store.allowed("no", "acme")
    assert "key_hash" not in store.list_keys().columns and store.list_keys().count() == 3
    store.delete_tenant("texts")
    assert not store.allowed(secret, "texts") and store.list_keys().count() == 1
    with pytest.raises(StoreError):
        store.revoke_key(key)


def test_rates(spark):
    now = [100.0]
    s = Store(spark, shared_dir(spark, "t-rates"), 1, clock=lambda: now[0])
    s.create_tenant("r", 1, "l2", max_qps=3.5)
    with pytest.raises(BatchTooLarge):
        s.batch_upsert([{"id": i, "values": [1], "tenant_id": "r"} for i in range(4)])
    s.batch_upsert([{"id": i, "values": [1], "tenant_id": "r"} for i in range(2)])
    s.search([1], 1, "r")
    with pytest.raises(RateLimited):
        s.get(1, "r")
    now[0] += 1 / 3.5
    s.get(1, "r")
    with pytest.raises(RateLimited):
        s.delete(1, "r")
    s.set_quota("r", 0, 0)
    s.list("r")
    got = {(r["call"], r["code"]): r["n"] for r in s.request_metrics().where("tenant_id = 'r'").collect()}
    assert got["batch_upsert", "BatchTooLarge"] == 1 and got["batch_upsert", "ok"] == 1 and got["get", "RateLimited"] == 1 and got["get", "ok"] == 1


def test_indexed_search_sees_later_writes(spark, monkeypatch):
    import numpy as np

    from quiverlake.operators import planner

    monkeypatch.setattr(planner.plan, "__defaults__", (20,))
    s = Store(spark, shared_dir(spark, "t-index"), 2)
    s.create_tenant("g", 4, "l2")
    x = np.random.default_rng(2).normal(size=(120, 4)).round(3)
    s.batch_upsert([{"id": i, "values": v.tolist(), "metadata": {"even": str(i % 2 == 0)}, "tenant_id": "g"} for i, v in enumerate(x)])
    s.build_index("g", 50)
    assert planner.plan(s.collection("g"), [], 5) == "graph"
    want = np.argsort(((x - x[7]) ** 2).sum(1))
    assert ids(s.search(x[7].tolist(), 5, "g", ef=100)) == want[:5].tolist()
    s.insert(500, x[7].tolist(), tenant_id="g")
    s.delete(int(want[1]), "g")
    s.insert(7, (x[7] + 9).tolist(), tenant_id="g")
    assert ids(s.search(x[7].tolist(), 4, "g", ef=100)) == [500, *want[2:5].tolist()]
    assert all(int(r["id"]) % 2 == 0 for r in s.search(x[7].tolist(), 5, "g", filters={"even": "true"}).collect())


def test_key_limits(store):
    for call in (
        lambda: store.create_key(["a"], name="n" * 129), lambda: store.create_key(["a"] * 257), lambda: store.create_key([""]), lambda: store.create_key(["x" * 257]),
        lambda: store.create_key(["a"], ttl=datetime.timedelta(days=3651)), lambda: store.create_key(["a"], ttl=datetime.timedelta(0)), lambda: store.create_key(),
    ):
        with pytest.raises(StoreError):
            call()
    key, _ = store.create_key(admin=True, name="ops")
    r = store.list_keys().where(f"key_id = '{key}'").first()
    assert r["name"] == "ops" and r["tenants"] == ["*"]
    store.revoke_key(key)


def test_load():
    from quiverlake.load import load_percentile, run_load

    def bad():
        raise ValueError

    got = run_load([lambda: None, bad], 0.2, 2)
    assert got["requests"] > 0 and got["errors"] > 0 and got["p50"] <= got["p99.9"]
    assert load_percentile([3.0, 1.0, 2.0, 4.0], 0.5) == 2.0 and load_percentile([], 0.5) == 0.0
