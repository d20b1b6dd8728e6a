"""Placement: shards of ids, and owners of shards on a hash ring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIRTUAL_NODES = 150
#: FNV-1a, 64 bit. Fixed values.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211


def fnv_shards(ids: np.ndarray, n: int) -> np.ndarray:
    """FNV-1a of the ids' eight big-endian bytes, modulo n."""
    v = ids.astype(np.uint64)
    h = np.full(len(v), FNV_OFFSET, np.uint64)
    with np.errstate(over="ignore"):
        for shift in range(56, -8, -8):
            h = (h ^ ((v >> np.uint64(shift)) & np.uint64(255))) * np.uint64(FNV_PRIME)
    return (h % np.uint64(n)).astype(np.int32)


def with_shard(df: DataFrame, n: int, id_col: str = "id", name: str = "shard") -> DataFrame:
    """df with the shard of each id; null for null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(b.schema.get_field_index(id_col))
            s = fnv_shards(c.fill_null(0).to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, mask=c.is_null().to_numpy(zero_copy_only=False))], names=[*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())]))


def _hash(text: Column) -> Column:
    """The first 64 bits of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def ring_points(nodes: DataFrame, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """(node, h): each node's points on the ring."""
    p = nodes.select("node").distinct().select("node", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("i"))
    return p.select("node", _hash(F.concat("node", F.lit("#"), F.col("i").cast("string"))).alias("h"))


def ring_owners(shards: DataFrame, nodes: DataFrame, n: int = 1, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """(shard, place, node): the first n different nodes clockwise from each shard's hash.

    The sorted points travel with every shard as one array; a ring has nodes * virtual points,
    some thousands at most.
    """
    points = ring_points(nodes, virtual).agg(F.array_sort(F.collect_list(F.struct("h", "node"))).alias("points"))
    s = shards.select("shard").distinct().withColumn("hs", _hash(F.concat(F.lit("shard#"), F.col("shard").cast("string"))))
    held = s.join(F.broadcast(points))  # one row of bounded size
    ahead = F.filter("points", lambda p: p["h"] >= F.col("hs"))
    behind = F.filter("points", lambda p: p["h"] < F.col("hs"))
    names = F.array_distinct(F.transform(F.concat(ahead, behind), lambda p: p["node"]))
    return held.select("shard", F.posexplode(F.slice(names, 1, n)).alias("place", "node"))


def rebalance(shards: DataFrame, before: DataFrame, after: DataFrame, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """(shard, node_before, node_after) of the shards whose owner changes with the nodes."""
    a = ring_owners(shards, before, 1, virtual).select("shard", F.col("node").alias("node_before"))
    b = ring_owners(shards, after, 1, virtual).select("shard", F.col("node").alias("node_after"))
    return a.join(b, "shard").where("node_before <> node_after")


def shard_owner(shards: DataFrame, leaders: DataFrame, nodes: DataFrame, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """(shard, node): a shard's named leader, else its owner on the ring."""
    ring = ring_owners(shards, nodes, 1, virtual).select("shard", F.col("node").alias("ring_node"))
    named = leaders.groupBy("shard").agg(F.max("node").alias("leader"))
    return ring.join(named, "shard", "left").select("shard", F.coalesce("leader", "ring_node").alias("node"))


def failover(replicas: DataFrame) -> DataFrame:
    """(shard, node): the replica with the highest sequence number, ties to the first by name."""
    w = Window.partitionBy("shard").orderBy(F.col("seq").desc_nulls_last(), "node")
    return replicas.withColumn("q_rn", F.row_number().over(w)).where("q_rn = 1").select("shard", "node")
