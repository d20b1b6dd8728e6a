"""Results per key when a few keys hold most rows (problem 6).

Only algebraic aggregates are used (count, sum, min, max, the moments, HyperLogLog): Spark
combines them in a bounded hash table within each map task, spills that table by sorting when
it outgrows its memory, and shuffles one compact state per key and task. A key that holds a
third of all rows thus costs each task one state. Nothing here groups raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(rows: DataFrame, key: Column, aggregates: Mapping[str, Column], name: str = "tenant_id") -> DataFrame:
    """One row per key: its ``n_rows`` and the given algebraic aggregates.

    A null key is a key of its own. An empty table gives no rows.
    """
    keyed = rows.withColumn(name, key)
    return keyed.groupBy(name).agg(F.count(F.lit(1)).alias("n_rows"), *(c.alias(n) for n, c in aggregates.items()))


def heavy_keys(rows: DataFrame, key: Column, share: float, name: str = "tenant_id") -> DataFrame:
    """Keys with at least the given share of all rows, with ``n_rows`` and ``share``.

    The total is summed from the counts per key, whose shuffle is reused. An empty table gives
    no rows.
    """
    sizes = per_key(rows.select(key.alias(name)), F.col(name), {}, name)
    total = sizes.agg(F.sum("n_rows").alias("q_total"))
    # The total is one row, so the broadcast has a fixed size.
    return (
        sizes.join(F.broadcast(total), F.col("n_rows") >= F.lit(share * (1 - 1e-12)) * F.col("q_total"))  # a share met exactly counts
        .select(name, "n_rows", (F.col("n_rows") / F.col("q_total")).alias("share"))
    )
