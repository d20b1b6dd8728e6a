"""Tenants: descriptors, statistics, quotas, rate limits and access keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlake.functions.tenants import tenant_of


def descriptors(tenants: DataFrame) -> DataFrame:
    """One row per tenant; repeated rows count once, of differing ones the largest values."""
    return tenants.groupBy(tenant_of().alias("tenant_id")).agg(F.max("dim").alias("dim"), F.max("metric").alias("metric"), F.max("max_vectors").alias("max_vectors"), F.max("max_qps").alias("max_qps"))


def tenant_stats(collection: DataFrame, tenants: DataFrame) -> DataFrame:
    """(tenant_id, dim, metric, max_vectors, max_qps, n_vectors) of every tenant, also of those
    without vectors; repeated ids of a tenant count once."""
    sizes = collection.select(tenant_of().alias("tenant_id"), "id").distinct().groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_vectors"))
    return descriptors(tenants).join(sizes, "tenant_id", "left").withColumn("n_vectors", F.coalesce("n_vectors", F.lit(0).cast("bigint")))


def quota_check(batch: DataFrame, collection: DataFrame, tenants: DataFrame) -> DataFrame:
    """(tenant_id, n_live, n_new, fits) for each tenant of a batch: whether its stored ids and the
    batch's new ones stay within max_vectors; 0 and null mean no limit, overwriting is free."""
    stored = collection.select(tenant_of().alias("tenant_id"), "id").distinct()
    given = batch.select(tenant_of().alias("tenant_id"), "id").distinct()
    live = stored.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_live"))
    new = given.join(stored, ["tenant_id", "id"], "left_anti").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_new"))
    zero = F.lit(0).cast("bigint")
    out = given.select("tenant_id").distinct().join(live, "tenant_id", "left").join(new, "tenant_id", "left").join(descriptors(tenants).select("tenant_id", "max_vectors"), "tenant_id", "left")
    n_live, n_new, most = F.coalesce("n_live", zero), F.coalesce("n_new", zero), F.coalesce("max_vectors", zero)
    return out.select("tenant_id", n_live.alias("n_live"), n_new.alias("n_new"), ((most == 0) | (n_live + n_new <= most)).alias("fits"))


def burst(max_qps: Column) -> Column:
    """Requests that may come at once: the whole part of the rate, at least 1."""
    return F.greatest(F.lit(1.0), F.floor(max_qps))


def rate_limited(requests: DataFrame, key: str, at: str, rate: float) -> DataFrame:
    """requests with ``allowed``: a token bucket of the given rate and its burst for each key, over
    event time; requests of equal time in order of ``request_id``. A bucket is sequential by
    nature, so keys are the unit of parallel work; a key's requests stream through its task in
    order, with the bucket as the only state. Null times come first and let no time pass."""
    size = max(1.0, float(int(rate)))
    own = requests.select(key, at, "request_id").withColumn("q_at", F.unix_micros(F.col(at).cast("timestamp")))
    fields = requests.select(key, at, "request_id").withColumn("allowed", F.lit(True)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, tokens, last = object(), size, None
        for b in batches:
            out = []
            for name, micros in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if name != have:
                    have, tokens, last = name, size, None
                s = last if micros is None else micros / 1e6
                if last is not None:
                    tokens = min(size, tokens + (s - last) * rate)
                last = s
                out.append(tokens >= 1)
                tokens -= tokens >= 1
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.bool_())], names=fields.names)

    return own.repartition(key).sortWithinPartitions(key, "q_at", "request_id").mapInArrow(run, fields)


def keys_allowing(keys: DataFrame, tenant: str, now: Column | None = None) -> DataFrame:
    """Keys that may act for a tenant: admin keys, and keys whose tenants hold it or ``*``; expired
    ones (expires_at not after now) may not."""
    now = F.current_timestamp() if now is None else now
    alive = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    return keys.where(alive & (F.coalesce("admin", F.lit(False)) | F.coalesce(F.array_contains("tenants", tenant) | F.array_contains("tenants", "*"), F.lit(False))))


def key_lookup(keys: DataFrame, secret: str) -> DataFrame:
    """The key of a secret, by its SHA-256."""
    return keys.where(F.col("key_hash") == F.sha2(F.lit(secret), 256))


def drop_tenant_from_keys(keys: DataFrame, tenant: str) -> DataFrame:
    """Keys without the tenant; keys that named only this tenant are gone, admin keys stay."""
    had = F.coalesce(F.size("tenants") > 0, F.lit(False))
    rest = F.array_remove("tenants", tenant)
    return keys.where(F.coalesce("admin", F.lit(False)) | ~had | (F.size(rest) > 0)).withColumn("tenants", F.array_remove("tenants", tenant))


def list_keys(keys: DataFrame) -> DataFrame:
    return keys.orderBy("created_at", "key_id")
