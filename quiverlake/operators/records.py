"""Operations on records of a collection: get, list, count, writes and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlake.functions.distance import all_finite
from quiverlake.functions.tenants import tenant_of, valid_tenant

MAX_META_KEYS = 64
MAX_META_BYTES = 16 << 10
DEFAULT_PAGE, MAX_PAGE = 100, 1000
#: A collection is due for compaction with at least so many dead records, and more than live ones.
MIN_DEAD = 256


def get(collection: DataFrame, record_id: int, tenant: str | None = None) -> DataFrame:
    """The record of an id; no row for an unknown one."""
    rows = collection.where(F.col("id") == record_id)
    return rows if tenant is None else rows.where(F.col("tenant_id") == (tenant or "default"))


def list_page(collection: DataFrame, start: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
    """(id, next_id): the first ``limit`` ids from ``start`` on, ascending; next_id is where the next
    page starts, null on the last page."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be from 1 to {MAX_PAGE}")
    page = collection.where(F.col("id") >= start).select("id").orderBy("id").limit(limit + 1)
    # limit + 1 rows, so their order is no burden for one task.
    numbered = page.agg(F.sort_array(F.collect_list("id")).alias("ids"))
    more = F.when(F.size("ids") > limit, F.try_element_at("ids", F.lit(limit)) + 1)
    return numbered.select(F.explode(F.slice("ids", 1, limit)).alias("id"), more.alias("next_id"))


def count(collection: DataFrame) -> DataFrame:
    """(n_live,): the number of records; 0 for an empty collection."""
    return collection.agg(F.count(F.lit(1)).alias("n_live"))


def count_new(ids: DataFrame, collection: DataFrame) -> DataFrame:
    """(n_new,): the number of different ids that the collection doesn't hold."""
    return ids.select("id").distinct().join(collection.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n_new"))


def postings(collection: DataFrame) -> DataFrame:
    """(key, value, n_ids): how many records hold each metadata pair."""
    return collection.select("id", F.explode("metadata").alias("key", "value")).groupBy("key", "value").agg(F.count_distinct("id").alias("n_ids"))


def posting_ids(collection: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Ids of the records whose key has one of the values, each once."""
    return collection.where(F.try_element_at("metadata", F.lit(key)).isin(list(dict.fromkeys(values)))).select("id").distinct()


def metadata_fits(metadata: Column | str = "metadata") -> Column:
    """At most MAX_META_KEYS keys and MAX_META_BYTES bytes of keys and values."""
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    text = F.concat(F.map_keys(m), F.filter(F.map_values(m), lambda v: v.isNotNull()))
    size = F.aggregate(text, F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x).cast("bigint"))
    return m.isNull() | ((F.size(m) <= MAX_META_KEYS) & (size <= MAX_META_BYTES))


def upsert(collection: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """The collection after writing a batch: of each id the batch's row with the largest order
    value, metadata included, else its own row. Both have the same columns but for ``order``."""
    columns = [c for c in collection.columns]
    last = batch.groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*")
    return collection.join(batch.select("id"), "id", "left_anti").select(columns).unionByName(last)


def update_metadata(collection: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """The collection with the metadata of ids in ``changes`` replaced as a whole (null clears);
    ids that aren't stored stay unknown. Of several changes the one with the largest order counts."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("metadata"), order).alias("q_new"))
    joined = collection.join(last, "id", "left")
    new = F.when(F.col("q_new").isNotNull(), F.col("q_new.metadata")).otherwise(F.col("metadata"))
    return joined.withColumn("metadata", new).select(collection.columns)


def delete(collection: DataFrame, ids: DataFrame) -> DataFrame:
    """The collection without the ids; unknown ids do nothing."""
    return collection.join(ids.select("id").distinct(), "id", "left_anti")


def seq_gaps(log: DataFrame, key: str = "tenant_id", seq: str = "seq") -> DataFrame:
    """(key, after_seq): sequence numbers whose successor is missing though later ones exist.

    Records and successors meet by (key, seq), so that a long log is spread over all tasks.
    """
    c = log.select(F.col(key), F.col(seq).alias("seq"))
    marks = c.select(key, F.explode(F.array(F.struct("seq", F.lit(True).alias("here")), F.struct((F.col("seq") + 1).alias("seq"), F.lit(False).alias("here")))).alias("m")).select(key, "m.*")
    ends = marks.groupBy(key, "seq").agg(F.bool_or("here").alias("here")).where("NOT here")
    last = c.groupBy(key).agg(F.max("seq").alias("q_last"))
    return ends.join(last, key).where(F.col("seq") <= F.col("q_last")).select(key, (F.col("seq") - 1).alias("after_seq"))


def compaction_due(counts: DataFrame, live: str = "n_live", dead: str = "n_dead") -> Column:
    return (F.col(dead) >= MIN_DEAD) & (F.col(dead) > F.col(live))


def batch_violations(batch: DataFrame, tenants: DataFrame) -> DataFrame:
    """(tenant_id, id, problem) of the rows for which a whole batch must be refused.

    batch: tenant_id, id, vec, metadata. Problems, in this order: bad tenant, unknown tenant, bad
    id (null), bad dim, not finite, bad metadata.
    """
    known = tenants.groupBy(tenant_of().alias("q_tenant")).agg(F.max("dim").alias("q_dim"))
    rows = batch.withColumn("tenant_id", tenant_of())
    rows = rows.join(known, F.col("tenant_id") == F.col("q_tenant"), "left")
    problem = (
        F.when(~valid_tenant(F.col("tenant_id")), "bad tenant")
        .when(F.col("q_tenant").isNull(), "unknown tenant")
        .when(F.col("id").isNull(), "bad id")
        .when(F.col("vec").isNull() | (F.size("vec") != F.col("q_dim")), "bad dim")
        .when(~all_finite("vec"), "not finite")
        .when(~metadata_fits(), "bad metadata")
    )
    return rows.select("tenant_id", "id", problem.alias("problem")).where("problem IS NOT NULL")
