"""JSON batches, tenant sidecars, metadata objects, the binary log, and snapshots."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_SCHEMA = "id string, values array<float>, metadata map<string,string>, tenant_id string"
LOG_SCHEMA = "seq bigint, op tinyint, id decimal(20,0), vec array<float>, extra string"
#: Operations of the binary log.
INSERT, DELETE, META = 1, 2, 3
#: Longest record, and longest tail after damage that is searched for a good one.
MAX_RECORD_BYTES = 64 << 20
MAX_SEARCHED_TAIL = 64 << 20
MAX_LEVEL = 64
GRAPH_SCHEMA = "snapshot_seq bigint, id decimal(20,0), level int, deleted boolean, vec array<float>, neighbors array<array<decimal(20,0)>>"


class DamagedLog(ValueError):
    """A bad record with good ones after it."""


def read_json_batch(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(tenant_id, id, vec, metadata) of JSON objects {id, values, metadata, tenant_id}: one array
    of them (multi_line), or one a line, which is read in parallel. ids are decimal texts up to
    2^64 - 1; others become null and are for the batch check to refuse."""
    df = spark.read.schema(BATCH_SCHEMA).json(path, multiLine=multi_line)
    number = F.when(F.col("id").rlike(r"\A[0-9]{1,20}\z"), F.col("id").try_cast("decimal(20,0)"))
    number = F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number)
    return df.select(F.coalesce(F.nullif("tenant_id", F.lit("")), F.lit("default")).alias("tenant_id"), number.alias("id"), F.col("values").alias("vec"), "metadata")


def metadata_rows(df: DataFrame, column: str) -> DataFrame:
    """(id, metadata) of objects {id: {key: value}}."""
    return df.select(F.explode(F.from_json(column, "map<string,map<string,string>>")).alias("id", "metadata"))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(dim, metric, max_vectors, max_qps) of tenant descriptor files."""
    return spark.read.schema("dim int, metric string, max_vectors bigint, max_qps double").json(path, multiLine=True)


def frame(seq: int, op: int, record_id: int, vec: list[float] | None = None, extra: bytes = b"") -> bytes:
    """A record of the binary log: the length of what follows it, CRC-32 of the payload, and the
    payload (little endian: seq, op, id, number of components, components, length of extra, extra)."""
    v = vec or []
    body = struct.pack(f"<QBQI{len(v)}fI", seq, op, record_id, len(v), *v, len(extra)) + extra
    return struct.pack("<II", len(body) + 4, zlib.crc32(body)) + body


def _parse(body: bytes) -> tuple | None:
    """The record of a payload, or None if it holds none."""
    if len(body) < 25:
        return None
    seq, op, record_id, n = struct.unpack_from("<QBQI", body)
    if op not in (INSERT, DELETE, META) or len(body) < 25 + 4 * n:
        return None
    (m,) = struct.unpack_from("<I", body, 21 + 4 * n)
    extra = body[25 + 4 * n :]
    if len(extra) != m:
        return None
    vec = list(struct.unpack_from(f"<{n}f", body, 21)) if n else None
    return seq, op, record_id, vec, extra.decode("utf-8", "replace") or None


def _frame_at(data: bytes, at: int) -> tuple[tuple, int] | None:
    """The whole and good record that starts at a byte, and where it ends."""
    if at + 8 > len(data):
        return None
    n, crc = struct.unpack_from("<II", data, at)
    end = at + 4 + n
    if not 4 <= n <= MAX_RECORD_BYTES or end > len(data) or zlib.crc32(data[at + 8 : end]) != crc:
        return None
    rec = _parse(data[at + 8 : end])
    return rec and (rec, end)


def parse_log(data: bytes) -> list[tuple]:
    """Records of a log's bytes. A torn end is dropped; damage before a later good record, or a
    sequence number that isn't the next, is an error."""
    out, at = [], 0
    while at < len(data):
        found = _frame_at(data, at)
        if found is None:
            if _good_after(data, at + 1, out[-1][0] if out else 0):
                raise DamagedLog(f"damaged record at byte {at}")
            break
        rec, end = found
        if out and rec[0] != out[-1][0] + 1:
            raise DamagedLog(f"record {rec[0]} follows {out[-1][0]}")
        out.append(rec)
        at = end
    return out


def _good_after(data: bytes, start: int, last_seq: int) -> bool:
    """Whether a good record with a later sequence number starts anywhere from ``start`` on; a tail too
    long to be searched counts as one, so that nothing is given up in silence."""
    if len(data) - start > MAX_SEARCHED_TAIL:
        return True
    return any((found := _frame_at(data, at)) and found[0][0] > last_seq for at in range(start, len(data) - 7))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, op, id, vec, extra) of binary log files, one task a file; see parse_log."""
    fields = T.StructType([T.StructField("path", T.StringType()), *T._parse_datatype_string(LOG_SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = parse_log(data)
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows), pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int8()), pa.array([decimal.Decimal(i) for i in cols[2]], pa.decimal128(20, 0)), pa.array(cols[3], pa.list_(pa.float32())), pa.array(cols[4], pa.string())],
                    names=fields.names,
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, fields)


def record_checksum(seq: str = "seq", op: str = "op", record_id: str = "id", extra: str = "extra"):
    """CRC-32 of a record's canonical text, for comparing two logs."""
    return F.crc32(F.concat_ws("|", F.col(seq), F.col(op), F.col(record_id), F.coalesce(extra, F.lit(""))).cast("binary"))


def write_snapshot(state: DataFrame, path: str, seq: int, dim: int, metric: str) -> None:
    """The state as one version: rows with the header (seq, dim, metric) as columns. Spark's commit
    makes it appear as a whole."""
    state.withColumns({"snapshot_seq": F.lit(seq).cast("bigint"), "snapshot_dim": F.lit(dim), "snapshot_metric": F.lit(metric)}).write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str, dim: int, metric: str) -> DataFrame:
    """The rows of a version; another dim or metric than expected is an error."""
    df = spark.read.parquet(path)
    wrong = df.where((F.col("snapshot_dim") != dim) | (F.col("snapshot_metric") != metric)).limit(1).count()
    if wrong:
        raise ValueError("the snapshot has another dim or metric")
    return df.drop("snapshot_dim", "snapshot_metric")


class _Reader:
    """Little-endian numbers from bytes; running over their end is an error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, layout: str) -> tuple:
        try:
            out = struct.unpack_from("<" + layout, self.data, self.at)
        except struct.error:
            raise ValueError("the snapshot ends early") from None
        self.at += struct.calcsize("<" + layout)
        return out


def snapshot_bytes(seq: int, dim: int, metric: str, nodes: list[tuple], entry: int, top: int, signature: bytes) -> bytes:
    """A snapshot file of graph nodes (id, level, deleted, vec, neighbors by layer). signature: eight
    bytes, the last of which is the format's version, 1 or 2; version 1 has neither dim and metric
    nor a checksum."""
    out = [signature, struct.pack("<QBQIQ", seq, bool(nodes), entry, top, len(nodes))]
    if signature[-1:] == b"2":
        out.append(struct.pack("<IB", dim, len(metric)) + metric.encode())
    for record_id, level, deleted, vec, layers in nodes:
        out.append(struct.pack(f"<QiBI{len(vec)}fI", record_id, level, deleted, len(vec), *vec, len(layers)))
        out += [struct.pack(f"<I{len(x)}Q", len(x), *x) for x in layers]
    data = b"".join(out)
    return data + struct.pack("<I", zlib.crc32(data)) if signature[-1:] == b"2" else data


def parse_snapshot(data: bytes, dim: int, metric: str) -> tuple[int, list[tuple]]:
    """(seq, nodes) of a snapshot file, as snapshot_bytes writes it; an empty file has none.

    Wrong checksums, versions, counts, levels, unknown or repeated ids, and another dim or metric than
    expected are errors.
    """
    if not data:
        return 0, []
    version = data[7:8]
    if version not in (b"1", b"2"):
        raise ValueError("no snapshot of a known version")
    if version == b"2":
        if len(data) < 12 or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("the snapshot's checksum is wrong")
        data = data[:-4]
    r = _Reader(data)
    r.at = 8
    seq, has_entry, entry, top, n = r.take("QBQiQ")
    if version == b"2":
        own, length = r.take("IB")
        (name,) = r.take(f"{length}s")
        if own != dim or name.decode("utf-8", "replace") != metric:
            raise ValueError("the snapshot has another dim or metric")
    if has_entry > 1 or bool(has_entry) != (n > 0) or not 0 <= top <= MAX_LEVEL or n > len(data) // 21:
        raise ValueError("the snapshot's header is wrong")
    nodes = []
    for _ in range(n):
        record_id, level, deleted, length = r.take("QiBI")
        if length != dim or not 0 <= level <= MAX_LEVEL:
            raise ValueError("a node has another dim or a wrong level")
        vec = list(r.take(f"{length}f"))
        (layers,) = r.take("I")
        if layers > MAX_LEVEL + 1:
            raise ValueError("a node has too many layers")
        nodes.append((record_id, level, bool(deleted), vec, [list(r.take(f"{r.take('I')[0]}Q")) for _ in range(layers)]))
    ids = {x[0] for x in nodes}
    if r.at != len(data) or len(ids) < n or n and entry not in ids or any(not ids.issuperset(layer) for x in nodes for layer in x[4]):
        raise ValueError("the snapshot's nodes don't fit together")
    return seq, nodes


def read_graph_snapshot(spark: SparkSession, path: str, dim: int, metric: str) -> DataFrame:
    """(path, snapshot_seq, id, level, deleted, vec, neighbors) of binary snapshot files, one task a
    file; see parse_snapshot."""
    fields = T.StructType([T.StructField("path", T.StringType()), *T._parse_datatype_string(GRAPH_SCHEMA).fields])
    number = pa.decimal128(20, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seq, nodes = parse_snapshot(data, dim, metric)
                for at in range(0, len(nodes), 10_000):
                    ids, levels, dead, vecs, near = zip(*nodes[at : at + 10_000])
                    near = [[[decimal.Decimal(i) for i in layer] for layer in x] for x in near]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(ids), pa.string()), pa.array([seq] * len(ids), pa.int64()), pa.array([decimal.Decimal(i) for i in ids], number), pa.array(levels, pa.int32()), pa.array(dead, pa.bool_()), pa.array(vecs, pa.list_(pa.float32())), pa.array(near, pa.list_(pa.list_(number)))],
                        names=fields.names,
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, fields)
