"""Entity, attribute, value rows into one typed row per entity (problem 1).

``RDD.combineByKey`` holds one register per entity: the order and raw value of each output slot
that is filled. Merging two registers keeps the later cell of each slot, so the merge is
associative and commutative and runs before the shuffle as well as after it: whatever number of
rows an entity or attribute has, one task ships at most one register per entity. Rows reach the
RDD in Arrow batches, each already reduced to the registers of its entities, and leave it as Arrow
batches from the typed encoders, which run once per entity, after the last merge.
"""

from __future__ import annotations

import datetime
import math
import pickle
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quiverlake.functions.tenants import tenant_of
from quiverlake.session import shuffle_partitions

#: Keys sent to the executors at once; more are taken in several passes.
MAX_KEYS = 4096
#: Entities encoded at once.
ENCODED_ROWS = 4096
#: Rows for which the shuffle gets one more partition.
ROWS_PER_PARTITION = 2_000_000
#: Column with the keys whose current value can't be read as its kind.
BAD = "unreadable_keys"

_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_INT = re.compile(r"[+-]?[0-9]+")
_DAY = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})")
_DAY_DOTS = re.compile(r"([0-9]{2})\.([0-9]{2})\.([0-9]{4})")
_FLAGS = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}
_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _number(s: str) -> float | None:
    x = float(s) if _NUMBER.fullmatch(s) else math.inf
    return x if math.isfinite(x) else None


def _int(s: str) -> int | None:
    if not _INT.fullmatch(s) or len(s.lstrip("+-").lstrip("0")) > 19:
        return None
    x = int(s.lstrip("+-").lstrip("0") or "0") * (-1 if s[0] == "-" else 1)
    return x if -(2**63) <= x < 2**63 else None


def _flag(s: str) -> bool | None:
    return _FLAGS.get(s.lower()) if s.isascii() else None


def _day(s: str) -> datetime.date | None:
    if m := _DAY.fullmatch(s):
        y, mo, d = map(int, m.groups())
    elif m := _DAY_DOTS.fullmatch(s):
        d, mo, y = map(int, m.groups())
    else:
        return None
    try:
        return datetime.date(y, mo, d)
    except ValueError:
        return None


#: kind: the column's type and the reader of a stripped value, None if it can't be read.
KINDS: dict[str, tuple[T.DataType, Callable[[str], object]]] = {
    "number": (T.DoubleType(), _number),
    "int": (T.LongType(), _int),
    "flag": (T.BooleanType(), _flag),
    "day": (T.DateType(), _day),
    "text": (T.StringType(), lambda s: s or None),
}


def key_name(name: str) -> str:
    """The form in which keys are compared."""
    return name.strip().lower().replace("-", "_")


def key_list(keys: DataFrame) -> list[tuple[str, str]]:
    """(key, kind) of a key table, sorted by key.

    Rows with a null key or an unknown kind name no column; of repeated keys the first kind in
    alphabetical order counts. Each key is a column of the result, so they are held on the driver.
    """
    rows = keys.select("filter_key", "kind").distinct().toLocalIterator()
    found: dict[str, str] = {}
    for key, kind in sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] in KINDS):
        found.setdefault(key_name(key), kind)
    return sorted(found.items())


def _rank(cell: tuple) -> tuple:
    """Order of cells (seq, value): nulls first, ties by value."""
    seq, value = cell
    return seq is not None, seq or 0, value is not None, value or ""


def merge_registers(a: dict, b: dict) -> dict:
    """Register a with the cells of b that are later: {slot: (seq, value)}."""
    for slot, cell in b.items():
        have = a.get(slot)
        if have is None or (have != cell and _rank(cell) > _rank(have)):
            a[slot] = cell
    return a


def _last_cells(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of each entity and slot in a batch the row of its latest cell, sorted by entity, and where
    entities start among these."""
    tenant = b.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    id_, slot = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
    has = b.column(3).is_valid().to_numpy(zero_copy_only=False)
    seq = b.column(3).fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((seq, has, slot, id_, tenant))
    same = np.ones(len(order) - 1, bool)
    for key in (tenant, id_, slot):
        same &= key[order[1:]] == key[order[:-1]]
    equal = same & (has[order[1:]] == has[order[:-1]]) & (seq[order[1:]] == seq[order[:-1]])
    tied = np.flatnonzero(np.concatenate([equal, [False]]) | np.concatenate([[False], equal]))
    if len(tied):  # cells of the same order: the largest value is the latest
        values = b.column(4).take(pa.array(order[tied])).to_pylist()
        rank = {v: i for i, v in enumerate([None, *sorted({v for v in values if v is not None})])}
        by_value = np.zeros(len(order), np.int64)
        by_value[order[tied]] = [rank[v] for v in values]
        order = np.lexsort((by_value, seq, has, slot, id_, tenant))
    rows = order[np.concatenate([~same, [True]])]
    new = np.ones(len(rows), bool)
    new[1:] = (tenant[rows[1:]] != tenant[rows[:-1]]) | (id_[rows[1:]] != id_[rows[:-1]])
    return rows, np.flatnonzero(new)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The registers of each batch's entities, as one pickled list [((tenant, id), register), ...]."""
    for b in batches:
        if not b.num_rows:
            continue
        rows, starts = _last_cells(b)
        tenant, id_ = (b.column(c).take(pa.array(rows[starts])).to_pylist() for c in (0, 1))
        slot, seq, value = (b.column(c).take(pa.array(rows)).to_pylist() for c in (2, 3, 4))
        cells = list(zip(seq, value))
        ends = [*starts[1:].tolist(), len(rows)]
        out = [((t, i), dict(zip(slot[s:e], cells[s:e]))) for t, i, s, e in zip(tenant, id_, starts.tolist(), ends)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out, 5)], pa.binary())], names=["q_packed"])


def _place(key: tuple) -> int:
    return zlib.crc32(f"{key[1]}/{key[0]}".encode("utf-8", "surrogatepass"))


def attributes_to_wide(rows: DataFrame, keys: Iterable[tuple[str, str]], partitions: int | None = None) -> DataFrame:
    """One row per (tenant_id, id) with a typed column per key, and BAD.

    rows: tenant_id, id, attr_key, attr_value, set_seq; further columns are ignored. keys: as
    from key_list. An attr_key belongs to a key if both agree apart from letter case, outer
    blanks and ``-`` for ``_``; other attributes are left out, and an entity with none of the
    keys has no row. The current value of a cell is that of the largest set_seq (null counts as
    the smallest; among equal ones the largest value counts, null last). A null value clears the
    cell; blanks around a value don't count. A cell whose value can't be read as its kind is
    null, and its key is in BAD. Rows with a null id or attr_key are left out. Repeated rows
    change nothing. An empty table gives no rows.
    """
    keys = list(keys)
    spark = rows.sparkSession
    fields = [T.StructField(k, KINDS[kind][0]) for k, kind in keys]
    schema = T.StructType([T.StructField("tenant_id", T.StringType()), T.StructField("id", T.LongType()), *fields, T.StructField(BAD, T.ArrayType(T.StringType()))])
    if not keys:
        return spark.createDataFrame([], schema)
    own = rows.where(F.col("id").isNotNull() & F.col("attr_key").isNotNull()).select(
        tenant_of().alias("tenant_id"),
        F.col("id").cast("bigint").alias("id"),
        F.translate(F.lower(F.regexp_replace("attr_key", _BLANKS, "")), "-", "_").alias("q_key"),
        F.col("set_seq").cast("bigint").alias("q_seq"),
        F.col("attr_value").alias("q_value"),
    )
    cells = None
    for at in range(0, len(keys), MAX_KEYS):
        slots = spark.createDataFrame([(k, at + i) for i, (k, _) in enumerate(keys[at : at + MAX_KEYS])], "q_key string, q_slot int")
        part = own.join(F.broadcast(slots), "q_key").select("tenant_id", "id", "q_slot", "q_seq", "q_value")
        cells = part if cells is None else cells.unionByName(part)
    if partitions is None:  # registers in a partition follow the rows; a count reads no columns
        partitions = max(shuffle_partitions(spark), rows.count() // ROWS_PER_PARTITION)
    readers = [(k, KINDS[kind][1]) for k, kind in keys]
    arrow = to_arrow_schema(schema)

    def encoded(entities: list[tuple[tuple, dict]]) -> tuple[bytes]:
        bad: list[list[str]] = [[] for _ in entities]
        columns = [pa.array([k[0] for k, _ in entities], pa.string()), pa.array([k[1] for k, _ in entities], pa.int64())]
        for slot, (key, read) in enumerate(readers):
            out = [None] * len(entities)
            for row, (_, register) in enumerate(entities):
                raw = register.get(slot, (None, None))[1]
                if raw is not None:
                    out[row] = read(raw.strip())
                    if out[row] is None:
                        bad[row].append(key)
            columns.append(pa.array(out, arrow.field(slot + 2).type))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, arrow) as writer:
            writer.write_batch(pa.RecordBatch.from_arrays([*columns, pa.array(bad, arrow.field(BAD).type)], schema=arrow))
        return (sink.getvalue().to_pybytes(),)

    def encode(part: Iterator[tuple[tuple, dict]]) -> Iterator[tuple[bytes]]:
        held = []
        for entity in part:
            held.append(entity)
            if len(held) == ENCODED_ROWS:
                yield encoded(held)
                held = []
        if held:
            yield encoded(held)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                yield from pa.ipc.open_stream(data.as_buffer())

    wide = (
        cells.mapInArrow(_packed, "q_packed binary")
        .rdd.flatMap(lambda r: pickle.loads(r[0]))
        .combineByKey(lambda register: register, merge_registers, merge_registers, max(1, partitions), _place)
        .mapPartitions(encode)
    )
    return spark.createDataFrame(wide, "q_encoded binary", verifySchema=False).mapInArrow(unpacked, schema)


def unreadable_cells(wide: DataFrame) -> DataFrame:
    """(tenant_id, id, filter_key) of the cells whose current value can't be read as its kind."""
    return wide.select("tenant_id", "id", F.explode(BAD).alias("filter_key"))
