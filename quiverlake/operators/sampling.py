"""Samples of a bounded number of rows that don't depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_sample(df: DataFrame, n: int, total: int | None = None) -> DataFrame:
    """The n rows with the smallest hashes over all columns (all rows if there are fewer).

    Rows are first thinned by their hash to about twice n, so that tasks send few rows wherever
    the sorting happens. total: the number of rows, if known. Columns must not be maps.
    """
    total = df.count() if total is None else total
    part = F.pmod("q_hash", F.lit(1 << 30))
    hashed = df.withColumn("q_hash", F.xxhash64(*df.columns))
    if total > 2 * n:
        hashed = hashed.where(part < int((2 * n + 100) / total * (1 << 30)) + 1)
    return hashed.orderBy(part, "q_hash").limit(n).drop("q_hash")
