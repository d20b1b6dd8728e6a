from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.operators.change_runs import ChangeRuns
from quiverlake.session import shared_dir
from quiverlake.sources import records, vecs
from quiverlake.streaming.oplog_stream import follow, lagging, read_log_stream
from tests.conftest import rows


def test_vecs(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(100, 5)).astype(np.float32)
    (tmp_path / "a_base.fvecs").write_bytes(vecs.vecs_bytes(x))
    (tmp_path / "a_query.fvecs").write_bytes(vecs.vecs_bytes(x[:3]))
    (tmp_path / "a_groundtruth.ivecs").write_bytes(vecs.vecs_bytes(np.arange(12, dtype=np.int32).reshape(3, 4)))
    base, query, truth = vecs.read_bundle(spark, str(tmp_path / "a"))
    got = base.orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(100)) and np.array_equal(np.array([r["vec"] for r in got], np.float32), x)
    assert query.count() == 3 and rows(vecs.bundle_truth(truth, 2))[:2] == [(0, 1, 0), (0, 2, 1)]
    (tmp_path / "empty.fvecs").write_bytes(b"")
    assert vecs.read_vecs(spark, str(tmp_path / "empty.fvecs")).count() == 0
    (tmp_path / "bad.fvecs").write_bytes(vecs.vecs_bytes(x)[:-3])
    with pytest.raises(ValueError):
        vecs.read_vecs(spark, str(tmp_path / "bad.fvecs"))


def test_json_batch(spark, tmp_path):
    data = [{"id": "18446744073709551615", "values": [1.0, 2.0], "metadata": {"a": "b"}, "tenant_id": ""}, {"id": "x", "values": None}, {"id": "18446744073709551616", "values": []}]
    (tmp_path / "b.json").write_text(json.dumps(data))
    got = records.read_json_batch(spark, str(tmp_path / "b.json")).collect()
    assert [None if r["id"] is None else int(r["id"]) for r in got] == [2**64 - 1, None, None]
    assert got[0]["tenant_id"] == "default" and got[0]["metadata"] == {"a": "b"}
    df = spark.createDataFrame([('{"1": {"a": "b"}, "2": {}}',), (None,), ("{",)], "j string")
    assert rows(records.metadata_rows(df, "j")) == [("1", {"a": "b"}), ("2", {})]


def test_binary_log(spark, tmp_path):
    data = b"".join(records.frame(i, 1 + i % 3, 2**63 + i, [float(i)] if i % 3 == 0 else None, b'{"a":"b"}') for i in range(1, 8))
    (tmp_path / "1.log").write_bytes(data)
    (tmp_path / "2.log").write_bytes(data[:-7])
    df = records.read_log(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("path", "/"), -1))
    assert rows(df.groupBy("file").agg(F.max("seq"))) == [("1.log", 7), ("2.log", 6)]
    first = df.where("file = '1.log' AND seq = 3").first()
    assert first["vec"] == [3.0] and int(first["id"]) == 2**63 + 3 and first["extra"] == '{"a":"b"}'
    hurt = bytearray(data)
    hurt[12] ^= 1
    with pytest.raises(records.DamagedLog):
        records.parse_log(bytes(hurt))
    with pytest.raises(records.DamagedLog):
        records.parse_log(records.frame(1, 2, 1) + records.frame(3, 2, 1))
    assert records.parse_log(b"") == []


def test_snapshot(spark, tmp_path):
    state = spark.createDataFrame([(1, [1.0])], "id bigint, vec array<float>")
    records.write_snapshot(state, str(tmp_path / "s"), 5, 1, "l2")
    assert rows(records.read_snapshot(spark, str(tmp_path / "s"), 1, "l2")) == [(1, [1.0], 5)]
    with pytest.raises(ValueError):
        records.read_snapshot(spark, str(tmp_path / "s"), 2, "l2")


def test_stream_keeps_a_store(spark, tmp_path):
    schema = "tenant_id string, shard int, seq bigint, op tinyint, id bigint, vec array<float>, extra string"
    log = spark.createDataFrame([("t", 1, s, 1 if s % 3 else 2, s % 5, [float(s)], None) for s in range(1, 40)], schema)
    store = ChangeRuns(spark, shared_dir(spark, "t-stream"), 2)
    log.where("seq < 20").repartition(2).write.parquet(str(tmp_path / "log"))
    checkpoint = shared_dir(spark, "t-stream-checkpoint")
    stream = lambda: follow(read_log_stream(spark, str(tmp_path / "log"), log.schema, 1), store, checkpoint).awaitTermination()
    stream()
    log.where("seq >= 15").write.mode("append").parquet(str(tmp_path / "log"))  # some come again
    stream()
    whole = ChangeRuns(spark, shared_dir(spark, "t-batch"), 2)
    whole.append(log)
    cols = ["tenant_id", "id", "vec_seq", "meta_seq", "vec"]
    assert rows(store.state().select(*cols)) == rows(whole.state().select(*cols))
    assert rows(lagging(log, spark.createDataFrame([("t", 1, 30)], "tenant_id string, shard int, applied_seq bigint"))) == [("t", 1, 30, 39)]


def test_log_bytes_of_the_format():
    """Fixed bytes: length counts the checksum and the payload."""
    import struct
    import zlib

    def one(payload: str) -> bytes:
        p = bytes.fromhex(payload)
        return struct.pack("<II", 4 + len(p), zlib.crc32(p)) + p

    data = one("0700000000000000 01 0200000000000000 02000000 0000803f 000000c0 00000000") + one("0800000000000000 03 0300000000000000 00000000 05000000 7b2261227d") + one("0900000000000000 02 ffffffffffffffff 00000000 00000000")
    want = [(7, 1, 2, [1.0, -2.0], None), (8, 3, 3, None, '{"a"}'), (9, 2, 2**64 - 1, None, None)]
    assert records.parse_log(data) == want and data[:4] == b"\x25\0\0\0"
    assert b"".join(records.frame(s, o, i, v, (e or "").encode()) for s, o, i, v, e in want) == data
    assert records.parse_log(data[:-1]) == want[:2]
    assert records.parse_log(data + b"\0" * 30) == want  # a torn end
    bad_op = one("0800000000000000 04 0300000000000000 00000000 00000000")
    with pytest.raises(records.DamagedLog):
        records.parse_log(bad_op + data)
    assert records.parse_log(data + bad_op) == want
    assert records.parse_log(data + b"x" + data[:37]) == want  # only older records after the damage


def test_graph_snapshot_files(spark, tmp_path):
    nodes = [(5, 1, False, [1.0, 2.0], [[2**63], [2**63]]), (2**63, 1, False, [0.0, -1.0], [[5, 7], [5]]), (7, 0, True, [3.0, 3.0], [[5]])]
    for version in (b"1", b"2"):
        data = records.snapshot_bytes(40, 2, "cosine", nodes, 5, 1, b"SNAPSHT" + version)
        assert records.parse_snapshot(data, 2, "cosine") == (40, nodes)
        for hurt in (data[:-5], data + b"\0", data[:9]):
            with pytest.raises(ValueError):
                records.parse_snapshot(hurt, 2, "cosine")
        with pytest.raises(ValueError):
            records.parse_snapshot(data, 3, "cosine")
        (tmp_path / f"{version.decode()}.snap").write_bytes(data)
    flipped = bytearray(data)
    flipped[60] ^= 1
    for hurt in (bytes(flipped), b"SNAPSHT9" + data[8:], records.snapshot_bytes(1, 2, "l2", nodes, 5, 1, b"SNAPSHT2")):
        with pytest.raises(ValueError):
            records.parse_snapshot(hurt, 2, "cosine")
    assert records.parse_snapshot(b"", 2, "cosine") == (0, [])
    df = records.read_graph_snapshot(spark, str(tmp_path), 2, "cosine")
    assert df.count() == 6 and sorted(int(r["id"]) for r in df.where("snapshot_seq = 40 AND NOT deleted").collect()) == [5, 5, 2**63, 2**63]


def test_strict_following_refuses_gaps(spark, tmp_path):
    from quiverlake.streaming.oplog_stream import next_records

    kind = "tenant_id string, shard int, seq bigint, op tinyint, id bigint, vec array<float>, extra string"
    log = lambda *seqs: spark.createDataFrame([("a", 1, s, 1, s, [1.0], None) for s in seqs], kind)
    done = spark.createDataFrame([("a", 1, 2)], "tenant_id string, shard int, seq bigint")
    assert rows(next_records(log(1, 2, 3, 3, 4), done)) == [("a", 1, 4, None)] and rows(next_records(log(2, 4, 6), done)) == [("a", 1, 2, 3)] and rows(next_records(log(1), done)) == [("a", 1, 2, None)]
    folder, store = str(tmp_path / "log"), ChangeRuns(spark, shared_dir(spark, "t-strict"), 2)
    check = shared_dir(spark, "t-strict-check")
    run = lambda: follow(read_log_stream(spark, folder, log(1).schema, 1), store, check, strict=True).awaitTermination()
    log(2, 1).coalesce(1).write.mode("append").parquet(folder)
    run()
    log(2, 3).coalesce(1).write.mode("append").parquet(folder)
    run()
    log(5).coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="lacks record 4"):
        run()
    assert sorted(r["id"] for r in store.state().collect()) == [1, 2, 3]
