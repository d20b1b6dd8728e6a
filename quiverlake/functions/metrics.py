"""Recall and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.session import shuffle_partitions, written


def recall(found: DataFrame, truth: DataFrame, query: str = "query_id", item: str = "id") -> DataFrame:
    """(query, recall): the part of the true items that was found, for each query with a truth;
    items of either side count once."""
    t = truth.select(query, item).distinct()
    f = found.select(query, item).distinct().withColumn("q_hit", F.lit(1))
    return t.join(f, [query, item], "left").groupBy(query).agg((F.count("q_hit") / F.count(F.lit(1))).alias("recall"))


def percentiles(df: DataFrame, value: str, points: dict[str, float], rule: str = "run", by: list[str] | None = None) -> DataFrame:
    """Values at positions of the sorted column, without interpolation.

    Rule ``run`` takes index floor(n * p), rule ``load`` index floor(p * (n - 1)), both from 0.
    Nulls don't count. Equal values are counted before they are sorted; the counts are cut in ranges of
    the value, each with a running count of its own to which the sums of the ranges before are added,
    so that neither a large group nor the whole table is sorted by one task.
    """
    by = by or []
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("q_n"))
    n = shuffle_partitions(spark)
    ranged = written(counts.repartitionByRange(n, *by, value).withColumn("q_range", F.spark_partition_id()), "percentiles")
    # One row for each group and range that meet: at most groups + ranges rows, as both are in order.
    sums = ranged.groupBy(*by, "q_range").agg(F.sum("q_n").alias("q_sum"))
    over = Window.partitionBy(*by)
    named = [F.col(c).alias(f"q_by{i}") for i, c in enumerate(by)]
    before = sums.select(*named, F.col("q_range").alias("q_own"), (F.sum("q_sum").over(over.orderBy("q_range")) - F.col("q_sum")).alias("q_before"), F.sum("q_sum").over(over).alias("q_total"))
    on = F.col("q_range") == F.col("q_own")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"q_by{i}"))
    placed = ranged.join(before, on)
    within = Window.partitionBy(*by, "q_range").orderBy(value)
    running = placed.withColumn("q_seen", F.sum("q_n").over(within) + F.col("q_before"))

    def at(p: float) -> Column:
        n = F.col("q_total")
        index = F.least(F.floor(n * p) if rule == "run" else F.floor((n - 1) * p), n - 1)
        return F.min(F.when(F.col("q_seen") > index, F.col(value)))

    return running.groupBy(*by).agg(*(at(p).alias(name) for name, p in points.items()))
