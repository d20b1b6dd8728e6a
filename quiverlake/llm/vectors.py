"""Current vectors of a collection, and helpers for vectors in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.functions.tenants import tenant_of
from quiverlake.session import partitions_for, shuffle_partitions
from quiverlake.session import written as written


def usable_rows(vectors: DataFrame, tenants: DataFrame, *extra: str) -> DataFrame:
    """tenant_id, id, vec, received_at, dim and ``extra`` of the rows whose vec has the tenant's
    dim, is finite and not all zero.

    Rows with a null id, of tenants without a descriptor or with a null dim are not usable. Of a
    repeated descriptor the largest dim counts.
    """
    dims = tenants.where(F.col("dim") > 0).groupBy(tenant_of().alias("q_tenant")).agg(F.max("dim").alias("dim"))
    rows = vectors.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select(
        tenant_of().alias("tenant_id"), F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<float>").alias("vec"), "received_at", *extra
    )
    rows = rows.join(dims, F.col("tenant_id") == F.col("q_tenant")).where(F.size("vec") == F.col("dim")).drop("q_tenant")
    # A null, infinite or NaN component makes the sum of squares null or not finite.
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.where((squares > 0) & (squares < F.lit(float("inf"))))


#: Vectors in one shuffle partition, about.
PARTITION_ROWS = 400_000


def partitions_of(vectors: DataFrame) -> int:
    """Shuffle partitions for a table of vectors; counting its rows reads no columns."""
    return partitions_for(vectors.sparkSession, vectors.count(), PARTITION_ROWS)


def sized(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows hashed to n partitions by the keys by which they are grouped next, where the session's own
    number would leave too many in each."""
    return rows.repartition(n, *keys) if n > shuffle_partitions(rows.sparkSession) else rows


def latest(rows: DataFrame, partitions: int = 0) -> DataFrame:
    """Of each (tenant_id, id) the row with the latest received_at (null is earliest; of equal
    ones the row whose vector hashes largest), in one shuffle of the rows."""
    rows = sized(rows, partitions, "tenant_id", "id")
    order = Window.partitionBy("tenant_id", "id").orderBy(F.col("received_at").desc_nulls_last(), F.xxhash64("vec").desc())
    return rows.withColumn("q_rank", F.row_number().over(order)).where("q_rank = 1").drop("q_rank")


def current_vectors(vectors: DataFrame, tenants: DataFrame, *extra: str) -> DataFrame:
    """tenant_id, id, vec, dim and ``extra`` of each id's current vector: its usable row with the
    latest received_at."""
    return latest(usable_rows(vectors, tenants, *extra), partitions_of(vectors)).drop("received_at")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``dim`` items."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def matrices(batch: pa.RecordBatch, column: str = "vec", by: str = "dim"):
    """(dim, row numbers, matrix) for each dim in a batch."""
    dims = batch.column(by).to_numpy(zero_copy_only=False)
    vec = batch.column(column)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        own = vec if len(at) == batch.num_rows else pc.take(vec, pa.array(at))
        yield int(d), at, matrix(own, int(d))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    n = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return (x / np.where(n > 0, n, 1)[:, None]).astype(np.float32)


def list_array(x: np.ndarray) -> pa.Array:
    """A list column of the rows of x."""
    offsets = np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x, np.float32).ravel()))
