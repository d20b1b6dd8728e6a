from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from quiverlake.operators.attributes import BAD, attributes_to_wide, key_list, unreadable_cells
from quiverlake.operators.change_runs import ChangeRuns, changes_of, fold, metadata_map
from quiverlake.operators.incremental import due_records, last_success
from quiverlake.operators.key_profiles import heavy_keys, per_key
from quiverlake.functions.tenants import tenant_of
from quiverlake.session import shared_dir
from tests.conftest import rows

ATTRS = "tenant_id string, id bigint, attr_key string, attr_value string, set_seq bigint"
KEYS = [("day", "day"), ("flag", "flag"), ("n", "number"), ("stock", "int"), ("t_x", "text")]


def test_wide_cells(spark):
    data = [
        ("a", 1, "n", "1.5", 1), ("a", 1, " N ", "2.5e1", 3), ("a", 1, "n", "9", 2), ("a", 1, "T-X", " hi ", 1), ("a", 1, "FLAG", "YES", 1),
        (None, 1, "stock", "+12", 1), ("", 1, "stock", "12", 1), ("default", 1, "day", "31.12.2024", 5), ("A", 1, "day", "2024-02-30", 5),
        ("b", 2, "n", "1e999", 1), ("b", 2, "stock", "9223372036854775808", 1), ("b", 2, "t_x", "  ", 1), ("b", 2, "flag", None, 1),
        ("b", 3, "n", "1", 1), ("b", 3, "n", None, 2), ("b", 3, "n", None, 2), ("b", None, "n", "x", 1), ("b", 4, None, "x", 1), ("b", 5, "other", "x", 1),
        ("b", 6, "n", "٣", 1), ("b", 6, "stock", "-9223372036854775808", None), ("b", 6, "stock", "1_0", None),
    ]
    wide = attributes_to_wide(spark.createDataFrame(data, ATTRS).withColumn("n", F.lit("clash")), KEYS, 3)
    got = {(r["tenant_id"], r["id"]): r for r in wide.collect()}
    assert set(got) == {("a", 1), ("default", 1), ("A", 1), ("b", 2), ("b", 3), ("b", 6)}
    a = got["a", 1]
    assert (a["n"], a["t_x"], a["flag"], a["stock"], a[BAD]) == (25.0, "hi", True, None, [])
    assert got["default", 1]["stock"] == 12 and got["default", 1]["day"] == datetime.date(2024, 12, 31)
    assert got["A", 1]["day"] is None and got["A", 1][BAD] == ["day"]
    assert got["b", 2][BAD] == ["n", "stock", "t_x"]
    assert got["b", 3]["n"] is None and got["b", 3][BAD] == []
    assert got["b", 6][BAD] == ["n", "stock"]  # of equal set_seq the largest text counts
    assert ("A", 1, "day") in rows(unreadable_cells(wide))


def test_wide_is_order_free_and_takes_hot_entities(spark):
    rng = random.Random(3)
    data = [("a", 1 if rng.random() < 0.5 else rng.randrange(50), rng.choice("npqn"), str(rng.randrange(100)), rng.randrange(5000)) for _ in range(4000)]
    keys = [("n", "int"), ("p", "int"), ("q", "text")]
    a = rows(attributes_to_wide(spark.createDataFrame(data, ATTRS).repartition(7), keys))
    rng.shuffle(data)
    b = rows(attributes_to_wide(spark.createDataFrame(data + data, ATTRS).repartition(3), keys))
    want = {}
    for t, i, k, v, s in data:
        want[i, k] = max(want.get((i, k), (-1, "")), (s, v))
    assert a == b
    assert {(r[1], "n"): str(r[2]) for r in a if r[2] is not None} == {k: v for k, (_, v) in want.items() if k[1] == "n"}


def test_wide_empty(spark):
    empty = spark.createDataFrame([], ATTRS)
    assert rows(attributes_to_wide(empty, KEYS)) == [] and rows(attributes_to_wide(empty, [])) == []
    keys = spark.createDataFrame([("T-x", "text"), ("t_x", "text"), (None, "int"), ("z", "colour")], "filter_key string, kind string")
    assert key_list(keys) == [("t_x", "text")]


LOG = "tenant_id string, shard int, seq bigint, op tinyint, id bigint, vec array<float>, extra string"


def _play(records):
    """The state of one log applied record by record in order."""
    state, seen = {}, set()
    for t, _, seq, op, i, vec, extra in sorted(records, key=lambda r: r[2]):
        if (t, seq) in seen:
            continue
        seen.add((t, seq))
        if op == 1:
            state[t, i] = [seq, seq, vec, extra]
        elif op == 2:
            state.pop((t, i), None)
        elif (t, i) in state:
            state[t, i][1], state[t, i][3] = seq, extra
    return sorted((t, i, *s) for (t, i), s in state.items())


def _log(seed, n=600):
    rng = random.Random(seed)
    out = []
    for seq in range(1, n):
        op = rng.choice([1, 1, 2, 3, 3])
        out.append(("t", 1, seq, op, 7 if rng.random() < 0.3 else rng.randrange(40), [float(seq)] if op == 1 else None, rng.choice([None, "{}", '{"a":"%d"}' % seq])))
    return out


def test_runs_equal_sequential_play(spark):
    log = _log(1)
    want = _play(log)
    late = log + random.Random(2).sample(log, 150)
    random.Random(4).shuffle(late)
    store = ChangeRuns(spark, shared_dir(spark, "t-runs"), 3, max_runs=3)
    for k in range(5):
        store.append(changes_of(spark.createDataFrame(late[k::5], LOG)))
    assert store.version() > 1  # it has compacted
    got = sorted(tuple(r) for r in store.state().select("tenant_id", "id", "vec_seq", "meta_seq", "vec", "extra").collect())
    assert got == want
    again = ChangeRuns(spark, store.root, 3)  # another reader of the same folder
    assert sorted(tuple(r) for r in again.state().select("tenant_id", "id", "vec_seq", "meta_seq", "vec", "extra").collect()) == want
    assert rows(fold(changes_of(spark.createDataFrame(late, LOG))).select("tenant_id", "id", "vec_seq")) == sorted((w[:3] for w in want), key=repr)


def test_tombstone_outlives_compaction(spark):
    store = ChangeRuns(spark, shared_dir(spark, "t-late"), 2)
    log = [("t", 1, 5, 2, 1, None, None), ("t", 1, 2, 1, 2, [1.0], None)]
    store.append(changes_of(spark.createDataFrame(log[:1], LOG)))
    store.append(changes_of(spark.createDataFrame(log[1:], LOG)))
    store.compact()
    store.append(changes_of(spark.createDataFrame([("t", 1, 3, 1, 1, [2.0], None)], LOG)))  # older than the delete
    assert [(r["id"], r["vec_seq"]) for r in store.state().collect()] == [(2, 2)]


def test_runs_without_rows_and_with_nulls(spark):
    store = ChangeRuns(spark, shared_dir(spark, "t-empty"), 2)
    assert store.state().count() == 0 and store.runs() == 0
    bad = [("t", 1, None, 1, 1, [1.0], None), ("t", 1, 1, 1, None, [1.0], None), ("t", 1, 2, 9, 1, None, None), ("t", 1, 3, None, 1, None, None), ("t", 1, 4, 3, 1, None, "{}")]
    store.append(changes_of(spark.createDataFrame(bad, LOG)))
    assert store.state().count() == 0
    m = spark.createDataFrame([(None,), ("",), ("{}",), ("{oops",), ('{"a":"b"}',)], "extra string").select(metadata_map()).collect()
    assert [r[0] for r in m] == [None, None, None, None, {"a": "b"}]


def test_plan_merges_runs_without_shuffle(spark):
    store = ChangeRuns(spark, shared_dir(spark, "t-plan"), 3)
    for k in range(2):
        store.append(changes_of(spark.createDataFrame(_log(k, 50), LOG)))
    assert store.runs() == 2
    plan = store.state()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "HashAggregate" not in plan and "Window" in plan


def test_frames_outlive_appends_and_a_compaction(spark):
    store = ChangeRuns(spark, shared_dir(spark, "t-frames"), 3, max_runs=99)
    log = _log(5, 90)
    store.append(changes_of(spark.createDataFrame(log[:40], LOG)))
    store.append(changes_of(spark.createDataFrame(log[40:60], LOG)))
    before = store.state()
    store.compact()
    store.append(changes_of(spark.createDataFrame(log[60:], LOG)))
    after = store.state()
    pick = ["tenant_id", "id", "vec_seq", "meta_seq", "vec", "extra"]
    assert sorted(tuple(r) for r in before.select(*pick).collect()) == _play(log[:60])
    assert sorted(tuple(r) for r in after.select(*pick).collect()) == _play(log)


def test_queries_can_be_held_side_by_side(spark):
    from quiverlake.plans.general import p3_found

    a = p3_found(spark, "/root/testdata/sf0.001")
    b = p3_found(spark, "/root/testdata/sf0.001")
    assert a.count() == b.count() > 0


RUNS = "tenant_id string, shard int, run_no bigint, snapshot_seq bigint, status string"


def test_due_records(spark):
    log = [(t, 1, s) for t in ("a", "b", None, "d") for s in (1, 2, 3, 5, 6, 8)] + [("a", 1, 5), ("a", 1, 5), ("a", None, 6), ("a", 1, None), ("e", 2, 2)]
    runs = [
        ("a", 1, 1, 3, "ok"), ("a", 1, 2, 4, "OK"), ("a", 1, 3, 8, "failed"), ("a", 1, 3, 8, None), ("b", 1, 1, 6, "ok"), ("b", 1, 2, 1, " Ok"), ("b", 1, 2, 1, " Ok"),
        ("", 1, 1, 2, "running"), ("d", 1, 4, 2, "ok"), ("d", 1, None, 6, "ok"), ("d", 1, 3, None, "ok"), ("x", 1, 1, 1, "ok"),
    ]
    df = spark.createDataFrame(log, "tenant_id string, shard int, seq bigint").withColumn("done_seq", F.lit(1))
    got = rows(due_records(df, spark.createDataFrame(runs, RUNS)))
    assert got == [("a", 1, 5), ("a", 1, 6), ("b", 1, 2), ("b", 1, 3), ("d", 1, 3), ("default", 1, 1), ("default", 1, 2), ("default", 1, 3)]
    done = {r["tenant_id"]: r["done_seq"] for r in last_success(spark.createDataFrame(runs, RUNS)).collect()}
    assert done == {"a": 4, "b": 1, "d": 2, "x": 1}


def test_due_records_equals_brute_force(spark):
    rng = random.Random(9)
    log = [("t%d" % rng.randrange(3), rng.randrange(2), rng.randrange(1, 60)) for _ in range(700)]
    runs = [("t%d" % rng.randrange(3), rng.randrange(2), n, rng.randrange(40), rng.choice(["ok", "failed", None])) for n in range(8)]
    want = []
    for key in {(t, s) for t, s, _ in log}:
        own = {q for t, s, q in log if (t, s) == key}
        at = max(((n, q) for t, s, n, q, st in runs if (t, s) == key and st == "ok"), default=(0, 0))[1] + 1
        while at in own:
            want.append((*key, at))
            at += 1
    got = rows(due_records(spark.createDataFrame(log, "tenant_id string, shard int, seq bigint"), spark.createDataFrame(runs, RUNS)))
    assert got == sorted(want, key=repr)


TIMED = RUNS + ", started_at timestamp, finished_at timestamp"


def test_reread_starts_at_the_oldest_open_run(spark):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    runs = [
        ("a", 1, 1, 10, "ok", at(0), at(1)), ("a", 1, 2, 20, "running", at(2), None), ("a", 1, 3, 30, "ok", at(3), at(4)), ("a", 1, 4, 40, "ok", at(5), at(6)), ("a", 1, 5, 50, "running", at(7), None),
        ("b", 1, 1, 10, "ok", at(0), at(1)), ("b", 1, 2, 20, "failed", at(2), at(3)), ("b", 1, 3, 30, "ok", at(4), at(5)), ("b", 1, 4, 35, "ok", at(6), at(7)),
        ("c", 1, 1, 10, "ok", at(0), at(1)), ("c", 1, 2, 20, "ok", at(2), at(9)), ("c", 1, 3, 30, "ok", at(3), at(4)),
        ("d", 1, 1, 10, "ok", at(0), at(1)), ("d", 1, 2, 4, "ok", at(2), at(3)), ("e", 1, 1, 7, "failed", at(0), at(1)),
    ]
    got = {r["tenant_id"]: (r["done_seq"], r["reread_from"]) for r in last_success(spark.createDataFrame(runs, TIMED)).collect()}
    assert got == {"a": (40, 10), "b": (35, 30), "c": (30, 10), "d": (4, 4)}


def test_a_crash_between_work_and_ledger_neither_skips_nor_repeats(spark):
    import pytest

    from quiverlake.operators.incremental import Ledger, late_records, process_new

    seqs = "tenant_id string, shard int, seq bigint"
    ledger = Ledger(spark, shared_dir(spark, "t-ledger"))
    log = spark.createDataFrame([("a", 1, s) for s in (1, 2, 2, 3, 5)] + [("b", 1, 1)], seqs)
    runs = spark.createDataFrame([], TIMED)
    done: dict[int, list] = {}

    def work(run, fail=False):
        def take(due):
            done[run] = rows(due)
            if fail:
                raise RuntimeError("lost")

        return take

    with pytest.raises(RuntimeError):
        process_new(log, runs, ledger, 1, work(1, True))
    assert ledger.runs() == [] and process_new(log, runs, ledger, 1, work(1)) and done[1] == [("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("b", 1, 1)]
    assert not process_new(log, runs, ledger, 1, work(1))
    # The run's snapshot lags behind its ledger: what is noted isn't due again.
    runs = spark.createDataFrame([("a", 1, 1, 3, "ok", None, None), ("b", 1, 1, 1, "ok", None, None)], TIMED)
    more = log.unionByName(spark.createDataFrame([("a", 1, 4), ("b", 1, 2)], seqs))
    assert process_new(more, runs, ledger, 2, work(2)) and done[2] == [("a", 1, 4), ("a", 1, 5), ("b", 1, 2)]
    assert sorted(r[2] for r in ledger.pairs().where("tenant_id = 'a'").collect()) == [1, 2, 3, 4, 5] and rows(late_records(more, runs, ledger.pairs())) == []
    runs = spark.createDataFrame([("a", 1, 1, 3, "ok", None, None), ("a", 1, 2, 7, "ok", None, None), ("a", 1, 3, 8, "ok", None, None)], TIMED)
    assert rows(late_records(more.unionByName(spark.createDataFrame([("a", 1, 8)], seqs)), runs, ledger.pairs())) == [("a", 1, 8)]
    ledger.forget(last_success(runs), 9)
    assert ledger.runs() == [9] and rows(ledger.pairs()) == [("b", 1, 1), ("b", 1, 2)]


def test_the_reread_records_that_no_run_has_noted_are_due(spark):
    from quiverlake.operators.incremental import covered_records

    seqs = "tenant_id string, shard int, seq bigint"
    log = spark.createDataFrame([("a", 1, s) for s in (1, 2, 3, 4, 4, 5, 7, 8, 10)] + [("b", 1, s) for s in range(1, 8)] + [("c", 1, 1)], seqs)
    # The note of a's second run was lost, and that of b's second run, which failed later, was kept.
    runs = spark.createDataFrame([("a", 1, 1, 3, "ok"), ("a", 1, 2, 6, "ok"), ("b", 1, 1, 3, "ok"), ("b", 1, 2, 5, "failed")], RUNS)
    runs = runs.withColumn("finished_at", F.lit("2024-01-01").cast("timestamp")).withColumn("started_at", F.timestamp_seconds(F.lit(1.7e9) + F.col("run_no")))
    noted = spark.createDataFrame([("a", 1, s) for s in (1, 2, 3)] + [("b", 1, s) for s in (1, 2, 3, 4, 5)] + [("x", 1, 1)], seqs)
    new = [("a", 1, 7), ("a", 1, 8), ("b", 1, 6), ("b", 1, 7), ("c", 1, 1)]
    assert rows(due_records(log, runs, noted)) == [("a", 1, 4), ("a", 1, 5), *new]
    at = last_success(runs)
    assert rows(due_records(log, runs, noted.unionByName(covered_records(log, at)))) == new


def test_due_records_empty(spark):
    log = spark.createDataFrame([], "tenant_id string, shard int, seq bigint")
    runs = spark.createDataFrame([], RUNS)
    assert rows(due_records(log, runs)) == []
    some = spark.createDataFrame([("a", 1, 1)], "tenant_id string, shard int, seq bigint")
    assert rows(due_records(some, runs)) == [("a", 1, 1)]


def test_heavy_keys(spark):
    df = spark.createDataFrame([("a",)] * 60 + [("A",)] * 20 + [(None,)] * 10 + [("",)] * 8 + [("z",)] * 2, "tenant_id string").withColumn("n_rows", F.lit(0))
    got = rows(heavy_keys(df, tenant_of(), 0.18))
    assert [(k, n) for k, n, _ in got] == [("A", 20), ("a", 60), ("default", 18)]
    assert rows(heavy_keys(df.limit(0), tenant_of(), 0.1)) == []
    assert rows(per_key(df, tenant_of(), {"n": F.count("tenant_id")})) == [("A", 20, 20), ("a", 60, 60), ("default", 18, 18), ("z", 2, 2)]


def test_kmeans_step_refuses_more_centroids_than_it_takes(spark, monkeypatch):
    import pytest

    from quiverlake.operators import quantize

    monkeypatch.setattr(quantize, "STEP_CENTROIDS", 2, raising=False)
    points = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "id bigint, vec array<double>")
    centroids = points.selectExpr("id AS centroid", "vec AS v")
    assert quantize.kmeans_step(points, centroids.limit(2)).count() == 2
    with pytest.raises(ValueError):
        quantize.kmeans_step(points, centroids)


def test_registers_merge_in_any_order_and_keys_come_in_passes(spark, monkeypatch):
    from quiverlake.operators import attributes

    a, b, c = {0: (1, "x"), 2: (None, "q")}, {0: (1, "y"), 1: (4, None)}, {1: (4, "z"), 2: (0, None)}
    want = {0: (1, "y"), 1: (4, "z"), 2: (0, None)}
    for order in ((a, b, c), (c, b, a), (b, a, c)):
        got: dict = {}
        for r in order:
            got = attributes.merge_registers(got, r)
        assert got == want
    data = [("t", 1, f"k{i % 5}", str(i), i) for i in range(40)] + [("t", 2, "k1", "x", None), ("t", 2, "K1 ", "3", None), ("t", 2, "k1", None, None)]
    rows_ = spark.createDataFrame(data, "tenant_id string, id bigint, attr_key string, attr_value string, set_seq bigint").repartition(3)
    monkeypatch.setattr(attributes, "MAX_KEYS", 2)
    wide = attributes_to_wide(rows_, [(f"k{i}", "int") for i in range(5)])
    assert {tuple(r)[:2]: tuple(r)[2:] for r in wide.collect()} == {("t", 1): (35, 36, 37, 38, 39, []), ("t", 2): (None, None, None, None, None, ["k1"])}
