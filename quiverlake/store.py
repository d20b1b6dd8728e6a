"""A durable multi-tenant collection with the operations of a vector database.

Writes append to one change-run store for all tenants; reads fold it. Descriptors and access keys
are small tables of which each change writes a new version. Calls that change data are batches of a
single writer: a batch is checked as a whole before anything of it is written.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import secrets
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.functions.distance import METRICS, normalized
from quiverlake.functions.filters import Clause, from_equalities, from_tuples
from quiverlake.functions.tenants import DEFAULT_TENANT, tenant_of, valid_tenant
from quiverlake.functions.text import MAX_TEXTS, text_id, text_problems
from quiverlake.operators import hnsw, planner, records, search, tenants
from quiverlake.operators.change_runs import DELETE, INSERT, META, ChangeRuns, changes_of, metadata_map
from quiverlake.session import delete_path, shuffle_partitions

ID = "decimal(20,0)"
MAX_ID = 2**64 - 1
_TENANTS = "tenant_id string, dim int, metric string, max_vectors bigint, max_qps double"
#: Limits of access keys.
MAX_KEY_NAME_BYTES, MAX_KEY_TENANTS, MAX_KEY_TENANT_BYTES, MAX_KEY_TTL = 128, 256, 256, datetime.timedelta(days=3650)
_INDEXES = "tenant_id string, path string, built_seq bigint"
_KEYS = "name string, key_id string, key_hash string, tenants array<string>, admin boolean, created_at timestamp, expires_at timestamp"
_RECORDS = f"id {ID}, vec array<float>, metadata map<string,string>, tenant_id string"
#: Sequence numbers that a batch may use.
_STRIDE = 1 << 40


class StoreError(ValueError):
    """A call that can't be carried out; nothing was written."""


class RateLimited(StoreError):
    """The tenant has used up its rate; the call may be repeated later."""


class BatchTooLarge(StoreError):
    """A batch of more vectors than the tenant's burst, which no waiting lets through."""


def _measured(call):
    """Count a call and its time by name, tenant and outcome; calls within calls aren't counted."""

    @functools.wraps(call)
    def run(self, *args, **kwargs):
        if self._inside:
            return call(self, *args, **kwargs)
        self._inside, self._tenant, began, code = True, "-", time.perf_counter(), "ok"
        try:
            return call(self, *args, **kwargs)
        except StoreError as e:
            code = type(e).__name__
            raise
        finally:
            self._inside = False
            self._requests.setdefault((call.__name__, self._tenant, code), []).append(time.perf_counter() - began)

    return run


def _number(record_id: int | str) -> Decimal:
    text = str(record_id)
    if not text.isascii() or not text.isdigit() or int(text) > MAX_ID:
        raise StoreError(f"bad id {record_id!r}")
    return Decimal(text)


class Store:
    """Tenants, records and keys below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, n_buckets: int | None = None, clock: Callable[[], float] = time.monotonic):
        self.clock = clock
        self._tokens: dict[str, tuple[float, float, float]] = {}
        self._inside, self._tenant = False, "-"
        self._requests: dict[tuple[str, str, str], list[float]] = {}
        self.spark, self.root = spark, root.rstrip("/")
        self.runs = ChangeRuns(spark, f"{self.root}/log", n_buckets or shuffle_partitions(spark), id_type=ID)

    # --- small tables -----------------------------------------------------------------------

    def _small(self, name: str, schema: str) -> DataFrame:
        versions = [n for n in self.runs._names(f"{self.root}/{name}") if n.isdigit()]
        done = [v for v in versions if "_SUCCESS" in self.runs._names(f"{self.root}/{name}/{v}")]
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{max(done)}")

    def _write_small(self, name: str, df: DataFrame) -> None:
        old = sorted(n for n in self.runs._names(f"{self.root}/{name}") if n.isdigit())
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}/{int(old[-1]) + 1 if old else 1:08d}")
        for v in old:
            delete_path(self.spark, f"{self.root}/{name}/{v}")

    def tenants(self) -> DataFrame:
        return self._small("tenants", _TENANTS)

    def keys(self) -> DataFrame:
        return self._small("keys", _KEYS)

    # --- rates and measures -------------------------------------------------------------------

    def _take(self, tenant_id: str | None, n: int = 1) -> None:
        """Take n tokens from the tenant's bucket; a batch costs as much as its vectors one by one."""
        name = self._tenant = tenant_id or DEFAULT_TENANT
        r = self.tenants().where(F.col("tenant_id") == name).select("max_qps").first()
        if r is None or not r[0]:
            return
        rate, size = r[0], max(1.0, math.floor(r[0]))
        if n > size:
            raise BatchTooLarge(f"{n} vectors; tenant {name} takes at most {int(size)} at once")
        now = self.clock()
        had, tokens, at = self._tokens.get(name, (rate, size, now))
        tokens = size if had != rate else min(size, tokens + (now - at) * rate)
        self._tokens[name] = (rate, tokens - n if tokens >= n else tokens, now)
        if tokens < n:
            raise RateLimited(f"tenant {name} is over its rate")

    def request_metrics(self) -> DataFrame:
        """(call, tenant_id, code, n, seconds): calls of this store object so far and their time."""
        rows = [(*key, len(v), sum(v)) for key, v in sorted(self._requests.items())]
        return self.spark.createDataFrame(rows, "call string, tenant_id string, code string, n bigint, seconds double")

    # --- tenants ----------------------------------------------------------------------------

    @_measured
    def create_tenant(self, tenant_id: str = DEFAULT_TENANT, dim: int = 0, metric: str = "cosine", max_vectors: int = 0, max_qps: float = 0.0) -> None:
        """Length and metric of a tenant are fixed from then on."""
        name = tenant_id or DEFAULT_TENANT
        if not self.spark.range(1).select(valid_tenant(F.lit(name))).first()[0]:
            raise StoreError(f"bad tenant id {tenant_id!r}")
        if dim < 1 or (metric or "cosine") not in METRICS:
            raise StoreError("a tenant needs a positive dim and a known metric")
        self._check_quota(max_vectors, max_qps)
        have = self.tenants()
        if have.where(F.col("tenant_id") == name).count():
            raise StoreError(f"tenant {name!r} exists")
        new = self.spark.createDataFrame([(name, dim, metric or "cosine", max_vectors, float(max_qps))], _TENANTS)
        self._write_small("tenants", have.unionByName(new))

    @staticmethod
    def _check_quota(max_vectors: int, max_qps: float) -> None:
        if max_vectors < 0 or not math.isfinite(max_qps) or max_qps < 0:
            raise StoreError("limits must be finite and not negative")

    def index_of(self, tenant_id: str = DEFAULT_TENANT) -> tuple[int, str]:
        """(dim, metric) of a tenant."""
        r = self.tenants().where(F.col("tenant_id") == (tenant_id or DEFAULT_TENANT)).first()
        if r is None:
            raise StoreError(f"unknown tenant {tenant_id!r}")
        return r["dim"], r["metric"]

    @_measured
    def set_quota(self, tenant_id: str, max_vectors: int, max_qps: float) -> None:
        self._check_quota(max_vectors, max_qps)
        self.index_of(tenant_id)
        own = F.col("tenant_id") == (tenant_id or DEFAULT_TENANT)
        limits = {"max_vectors": F.when(own, F.lit(max_vectors).cast("bigint")).otherwise(F.col("max_vectors")), "max_qps": F.when(own, F.lit(float(max_qps))).otherwise(F.col("max_qps"))}
        self._write_small("tenants", self.tenants().withColumns(limits))

    @_measured
    def delete_tenant(self, tenant_id: str) -> None:
        """Drop a tenant, its records, and its name from all keys; the default tenant stays."""
        if (tenant_id or DEFAULT_TENANT) == DEFAULT_TENANT:
            raise StoreError("the default tenant can't be deleted")
        self.index_of(tenant_id)
        gone = self.collection(tenant_id).select("tenant_id", "id").withColumn("op", F.lit(DELETE))
        self._append(gone.withColumn("vec", F.lit(None)).withColumn("extra", F.lit(None)), F.monotonically_increasing_id())
        self._write_small("tenants", self.tenants().where(F.col("tenant_id") != tenant_id))
        if self.keys().count():
            self._write_small("keys", tenants.drop_tenant_from_keys(self.keys(), tenant_id))

    @_measured
    def list_tenants(self) -> DataFrame:
        """Descriptors with n_vectors, in order of tenant_id."""
        return tenants.tenant_stats(self.collection(), self.tenants()).orderBy("tenant_id")

    # --- reads ------------------------------------------------------------------------------

    def collection(self, tenant_id: str | None = None) -> DataFrame:
        """(tenant_id, id, vec, metadata) of all stored records, or of one tenant's."""
        rows = self.runs.state().select("tenant_id", "id", "vec", metadata_map().alias("metadata"))
        return rows if tenant_id is None else rows.where(F.col("tenant_id") == (tenant_id or DEFAULT_TENANT))

    @_measured
    def get(self, record_id: int | str, tenant_id: str = DEFAULT_TENANT) -> DataFrame:
        self.index_of(tenant_id)
        self._take(tenant_id)
        return records.get(self.collection(tenant_id), _number(record_id))

    @_measured
    def list(self, tenant_id: str = DEFAULT_TENANT, page_token: int | str = 0, page_size: int = records.DEFAULT_PAGE) -> DataFrame:
        self.index_of(tenant_id)
        self._take(tenant_id)
        return records.list_page(self.collection(tenant_id), _number(page_token), page_size)

    @_measured
    def count(self, tenant_id: str = DEFAULT_TENANT) -> int:
        self.index_of(tenant_id)
        return records.count(self.collection(tenant_id)).first()[0]

    @_measured
    def search(
        self,
        query: Sequence[float],
        top_k: int = 10,
        tenant_id: str = DEFAULT_TENANT,
        metric: str | None = None,
        ef: int = 0,
        filters: Mapping[str, str] | None = None,
        where: Iterable[tuple] | Iterable[Clause] = (),
    ) -> DataFrame:
        """(id, score, metadata) of the top_k nearest records that pass all filters.

        A tenant with an index (build_index) is searched by it with beam width ef where the planner
        finds that worth while; records written since the index was built are compared exactly. All
        other searches are exact.
        """
        dim, own = self.index_of(tenant_id)
        if metric and metric != own:
            raise StoreError(f"the tenant's metric is {own}")
        if len(query) != dim or not all(math.isfinite(x) for x in query):
            raise StoreError(f"a query must have {dim} finite components")
        if not 0 <= ef <= search.MAX_EF:
            raise StoreError(f"ef must be from 0 to {search.MAX_EF}")
        where = list(where)
        clauses = [c for c in where if isinstance(c, Clause)] + from_tuples(c for c in where if not isinstance(c, Clause)) + from_equalities(filters or {})
        self._take(tenant_id)
        rows = self.collection(tenant_id)
        index = self._small("indexes", _INDEXES).where(F.col("tenant_id") == (tenant_id or DEFAULT_TENANT)).first()
        if index is None or planner.plan(rows, clauses, top_k) == "exact":
            return search.search(rows, query, top_k, own, clauses)
        changed = self.runs.changes().where((F.col("tenant_id") == index["tenant_id"]) & (F.col("seq") > index["built_seq"])).select("id").distinct()
        graphs = hnsw.delete_from_graphs(self.spark.read.parquet(index["path"]), changed)
        found = planner.planned_search(rows, graphs, query, top_k, own, clauses, ef)
        fresh = search.search(rows, query, top_k, own, clauses, candidates=changed)
        return found.select("id", "score", "metadata").unionByName(fresh).dropDuplicates(["id"]).orderBy("score", "id").limit(top_k)

    @_measured
    def build_index(self, tenant_id: str = DEFAULT_TENANT, shard_rows: int = 20_000) -> None:
        """Build proximity graphs over a tenant's records, one for about shard_rows of them, for search."""
        _, metric = self.index_of(tenant_id)
        name = tenant_id or DEFAULT_TENANT
        last = self.runs.changes().agg(F.max("seq")).first()[0] or 0
        rows = self.collection(name).select("id", "vec")
        shards = max(1, -(-rows.count() // shard_rows))
        old = self._small("indexes", _INDEXES)
        path = f"{self.root}/graphs/{secrets.token_hex(8)}"
        hnsw.build_graphs(rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")), metric).write.parquet(path)
        gone = old.where(F.col("tenant_id") == name).first()
        self._write_small("indexes", old.where(F.col("tenant_id") != name).unionByName(self.spark.createDataFrame([(name, path, last)], _INDEXES)))
        if gone is not None:
            delete_path(self.spark, gone["path"])

    # --- writes -----------------------------------------------------------------------------

    def _append(self, changes: DataFrame, order) -> None:
        last = self.runs.changes().agg(F.max("seq")).first()[0] or 0
        base = (last // _STRIDE + 1) * _STRIDE
        self.runs.append(changes_of(changes.withColumn("seq", F.lit(base) + order), id_type=ID))

    def _batch(self, batch: DataFrame | Iterable[Mapping]) -> DataFrame:
        if isinstance(batch, DataFrame):
            return batch.select(F.col("id").cast(ID).alias("id"), F.col("vec").cast("array<float>").alias("vec"), "metadata", tenant_of().alias("tenant_id"), F.monotonically_increasing_id().alias("q_at"))
        rows = [(_number(r["id"]), [float(x) for x in r.get("values") or []], dict(r["metadata"]) if r.get("metadata") else None, r.get("tenant_id") or DEFAULT_TENANT, i) for i, r in enumerate(batch)]
        return self.spark.createDataFrame(rows, _RECORDS + ", q_at bigint")

    @_measured
    def batch_upsert(self, batch: DataFrame | Iterable[Mapping]) -> None:
        """Write records {id, values, metadata, tenant_id}, or a table (id, vec, metadata, tenant_id),
        in order. The batch is refused as a whole if one of its rows is bad or a tenant's quota
        would be exceeded. Cosine tenants keep vectors of length 1."""
        rows = self._batch(batch)
        for r in rows.groupBy("tenant_id").count().join(F.broadcast(self.tenants().select("tenant_id")), "tenant_id").toLocalIterator():
            self._take(r["tenant_id"], r["count"])
        bad = records.batch_violations(rows, self.tenants()).limit(3).collect()
        if bad:
            raise StoreError("; ".join(f"{r['tenant_id']}/{r['id']}: {r['problem']}" for r in bad))
        full = tenants.quota_check(rows, self.collection(), self.tenants()).where("NOT fits").limit(1).collect()
        if full:
            raise StoreError(f"tenant {full[0]['tenant_id']} would exceed max_vectors")
        metric = self.tenants().select(F.col("tenant_id").alias("q_t"), "metric")
        rows = rows.join(metric, F.col("tenant_id") == F.col("q_t"))
        vec = F.when(F.col("metric") == "cosine", normalized("vec").cast("array<float>")).otherwise(F.col("vec"))
        self._append(rows.select("tenant_id", "id", F.lit(INSERT).alias("op"), vec.alias("vec"), F.to_json("metadata").alias("extra"), "q_at"), F.col("q_at"))

    @_measured
    def insert(self, record_id: int | str, values: Sequence[float], metadata: Mapping[str, str] | None = None, tenant_id: str = DEFAULT_TENANT) -> None:
        self.batch_upsert([{"id": record_id, "values": values, "metadata": metadata, "tenant_id": tenant_id}])

    def _one(self, op: int, record_id: int | str, tenant_id: str, extra: str | None = None) -> DataFrame:
        return self.spark.createDataFrame([(tenant_id or DEFAULT_TENANT, _number(record_id), op, None, extra)], f"tenant_id string, id {ID}, op int, vec array<float>, extra string")

    @_measured
    def update_metadata(self, record_id: int | str, metadata: Mapping[str, str] | None, tenant_id: str = DEFAULT_TENANT) -> None:
        """Replace a record's metadata as a whole; none clears it."""
        self.index_of(tenant_id)
        self._take(tenant_id)
        if not records.get(self.collection(tenant_id), _number(record_id)).count():
            raise StoreError(f"unknown id {record_id}")
        df = self.spark.createDataFrame([(dict(metadata) if metadata else None,)], "metadata map<string,string>")
        if not df.select(records.metadata_fits()).first()[0]:
            raise StoreError("too much metadata")
        self._append(self._one(META, record_id, tenant_id, df.select(F.to_json("metadata")).first()[0]), F.lit(0))

    @_measured
    def delete(self, record_id: int | str, tenant_id: str = DEFAULT_TENANT) -> bool:
        """Always true, also for unknown ids, for which nothing is written."""
        self.index_of(tenant_id)
        self._take(tenant_id)
        if records.get(self.collection(tenant_id), _number(record_id)).count():
            self._append(self._one(DELETE, record_id, tenant_id), F.lit(0))
        return True

    def compact(self) -> None:
        self.runs.compact()

    # --- texts ------------------------------------------------------------------------------

    @_measured
    def add_texts(self, texts: Sequence[str], embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], metadata: Sequence[Mapping[str, str]] | None = None, tenant_id: str = DEFAULT_TENANT) -> list[str]:
        """Store texts under their content ids with the text in their metadata; returns the ids."""
        if not 1 <= len(texts) <= MAX_TEXTS or metadata is not None and len(metadata) != len(texts):
            raise StoreError(f"from 1 to {MAX_TEXTS} texts, with as many metadata")
        rows = [(i, t, dict(metadata[i]) if metadata else {}) for i, t in enumerate(texts)]
        docs = self.spark.createDataFrame(rows, "q_at bigint, text string, metadata map<string,string>")
        bad = text_problems(docs, metadata="metadata").first()
        if bad is not None:
            raise StoreError(f"text {bad['q_at']}: {bad['problem']}")
        vectors = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(embed(texts))], "q_at bigint, vec array<float>")
        own = docs.join(vectors, "q_at").select("q_at", text_id("text").alias("id"), "vec", F.map_concat("metadata", F.create_map(F.lit("text"), "text")).alias("metadata"), F.lit(tenant_id).alias("tenant_id"))
        self.batch_upsert(own.orderBy("q_at"))
        return [str(r["id"]) for r in own.orderBy("q_at").select("id").collect()]

    @_measured
    def search_texts(self, text: str, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], top_k: int = 5, filters: Mapping[str, str] | None = None, tenant_id: str = DEFAULT_TENANT) -> DataFrame:
        if not 1 <= top_k <= 50:
            raise StoreError("top_k must be from 1 to 50")
        return self.search(embed([text])[0], top_k, tenant_id, filters=filters)

    def add_text_table(self, docs: DataFrame, vec: str = "vec", tenant_id: str = DEFAULT_TENANT) -> None:
        """Store the texts of a table with computed vectors."""
        rows = docs.where(F.length(F.trim("text")) > 0).select(text_id("text").alias("id"), F.col(vec).alias("vec"), F.create_map(F.lit("text"), "text").alias("metadata"), F.lit(tenant_id).alias("tenant_id"))
        self.batch_upsert(rows)

    def check_tenant(self, dim: int, tenant_id: str = DEFAULT_TENANT) -> None:
        """An error unless vectors of this length fit the tenant."""
        if self.index_of(tenant_id)[0] != dim:
            raise StoreError(f"tenant {tenant_id!r} has another dim")

    # --- keys -------------------------------------------------------------------------------

    @_measured
    def create_key(self, names: Sequence[str] = (), admin: bool = False, ttl: datetime.timedelta | None = None, name: str = "") -> tuple[str, str]:
        """(key_id, secret) of a new key for the tenants ``names``; an admin's without any serves all
        tenants. Only the secret's hash is stored. ttl: how long it works, for ever without one."""
        if not names and not admin:
            raise StoreError("a key needs tenants, or must be an admin's")
        if len(name.encode()) > MAX_KEY_NAME_BYTES or len(names) > MAX_KEY_TENANTS:
            raise StoreError(f"a key has a name of at most {MAX_KEY_NAME_BYTES} bytes and at most {MAX_KEY_TENANTS} tenants")
        if any(not 1 <= len(t.encode()) <= MAX_KEY_TENANT_BYTES for t in names):
            raise StoreError(f"tenant names have from 1 to {MAX_KEY_TENANT_BYTES} bytes")
        if ttl is not None and not datetime.timedelta(0) < ttl <= MAX_KEY_TTL:
            raise StoreError("a key works for a positive time of at most ten years, or for ever")
        secret = secrets.token_hex(24)
        digest = hashlib.sha256(secret.encode()).hexdigest()
        now = datetime.datetime.now(datetime.timezone.utc)
        row = (name, f"key_{digest[:16]}", digest, list(names) or ["*"], admin, now, now + ttl if ttl else None)
        self._write_small("keys", self.keys().unionByName(self.spark.createDataFrame([row], _KEYS)))
        return row[1], secret

    @_measured
    def list_keys(self) -> DataFrame:
        return tenants.list_keys(self.keys()).drop("key_hash")

    @_measured
    def revoke_key(self, key_id: str) -> None:
        if not self.keys().where(F.col("key_id") == key_id).count():
            raise StoreError(f"unknown key {key_id!r}")
        self._write_small("keys", self.keys().where(F.col("key_id") != key_id))

    def allowed(self, secret: str, tenant_id: str) -> bool:
        return tenants.keys_allowing(tenants.key_lookup(self.keys(), secret), tenant_id or DEFAULT_TENANT).count() > 0
