"""Queries of the collection operators over the test tables, with their SQL.

The collection ``vecs`` is the embeddings table with four tenants and string metadata, of which
every third row lacks two keys. Query sets are all ids divisible by 20. Codebooks and list centres
are taken from the first rows, so that both sides agree on them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.functions import distance as D
from quiverlake.functions import metrics, text
from quiverlake.functions.filters import Clause, matches, number
from quiverlake.functions.tenants import tenant_of
from quiverlake.operators import hnsw, quantize, records, search, shard, tenants
from quiverlake.operators.change_runs import ChangeRuns, changes_of, fold
from quiverlake.operators.incremental import last_success
from quiverlake.session import delete_path, shared_dir, shuffle_partitions, table
from quiverlake.streaming.oplog_stream import follow, read_log_stream

Query = Callable[[SparkSession, str], DataFrame]
K = 10
SUBSPACES, CENTROIDS, LISTS, PROBES = 8, 16, 16, 4
TRAINED_SUBSPACES, TRAINED_LISTS, TRAINED_PROBES = 64, 64, 48
SHARDS = 4
EDGE_NUMBERS = ["1", " 1 ", "1d", "1f", "1e400", "nan", "inf", "-Infinity", "1_000", "+.5", "5.", "1e3", "30\n", "", "abc", "-2.5E-1"]
NODES = ["node-a", "node-b", "node-c", "node-d"]


def _vecs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    base = [F.lit("label"), F.col("label").cast("string")]
    more = [F.lit("bucket"), (F.col("vec_id") % 7).cast("string"), F.lit("price"), (F.col("vec_id") * 37 % 100).cast("string")]
    meta = F.when(F.col("vec_id") % 3 != 0, F.create_map(*base, *more)).otherwise(F.create_map(*base))
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("t"), (F.col("vec_id") % 4).cast("string")).alias("tenant_id"), F.col("embedding").alias("vec"), meta.alias("metadata"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _vecs(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vec")


def _first(spark: SparkSession, d: str) -> list[float]:
    """The vector of id 0."""
    return list(_vecs(spark, d).where("id = 0").select("vec").first()[0])


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_VECS = """vecs AS (SELECT vec_id AS id, concat('t', vec_id % 4) AS tenant_id, embedding::DOUBLE[] AS vec,
  CASE WHEN vec_id % 3 <> 0 THEN MAP {'label': label::VARCHAR, 'bucket': (vec_id % 7)::VARCHAR, 'price': ((vec_id * 37) % 100)::VARCHAR}
  ELSE MAP {'label': label::VARCHAR} END AS metadata FROM embeddings)"""
_LEN = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
_L2 = "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"
_COS = f"1 - {_DOT} / ({_LEN.format('{0}')} * {_LEN.format('{1}')})"
_SQL = {"l2": _L2, "dot": f"-{_DOT}", "cosine": _COS}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# --- distances and searches -------------------------------------------------------------------

for _m in D.METRICS:

    @query(f"WITH {_VECS}, q AS (SELECT vec AS qv FROM vecs WHERE id = 0) SELECT id, round({_SQL[_m].format('qv', 'vec')}, 6) AS score FROM vecs, q", f"q_dist_{_m}")
    def _dist(spark: SparkSession, d: str, m: str = _m) -> DataFrame:
        q = F.lit(_first(spark, d)).cast("array<float>")
        return _rounded(_vecs(spark, d).select("id", D.distance(m, q, "vec").alias("score")), "score")

    @query(
        f"WITH {_VECS}, q AS (SELECT vec AS qv FROM vecs WHERE id = 0) SELECT id, round(score, 6) AS score FROM (SELECT id, {_SQL[_m].format('qv', 'vec')} AS score FROM vecs, q) ORDER BY score, id LIMIT {K}",
        f"q_search_{_m}",
    )
    def _search(spark: SparkSession, d: str, m: str = _m) -> DataFrame:
        return _rounded(search.search(_vecs(spark, d), _first(spark, d), K, m, columns=()), "score")

    @query(
        f"""WITH {_VECS}, s AS (SELECT q.id AS query_id, v.id, {_SQL[_m].format('q.vec', 'v.vec')} AS score FROM vecs q, vecs v WHERE q.id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INT AS rank FROM s) SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= {K}""",
        f"q_knn_join_{_m}",
    )
    def _knn(spark: SparkSession, d: str, m: str = _m) -> DataFrame:
        return _rounded(search.knn_join(_queries(spark, d), _vecs(spark, d), K, m), "score")


@query(f"WITH {_VECS} SELECT id, i AS place, round(x / n, 6) AS x FROM (SELECT id, unnest(vec) AS x, unnest(range(len(vec)))::INT AS i, {_LEN.format('vec')} AS n FROM vecs)")
def q_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_vecs(spark, d).select("id", F.posexplode(D.normalized("vec")).alias("place", "x")), "x")


@query(f"WITH {_VECS}, q AS (SELECT vec AS qv FROM vecs WHERE id = 0) SELECT id, round(score, 6) AS score FROM (SELECT id, {_COS.format('qv', 'vec')} AS score FROM vecs, q WHERE tenant_id = 't1') ORDER BY score, id LIMIT {K}")
def q_search_tenant(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.search(_vecs(spark, d), _first(spark, d), K, "cosine", tenant="t1", columns=()), "score")


@query(f"WITH {_VECS}, q AS (SELECT vec AS qv FROM vecs WHERE id = 0) SELECT id, round(score, 6) AS score FROM (SELECT id, {_L2.format('qv', 'vec')} AS score FROM vecs, q WHERE id IN (SELECT doc_id FROM documents)) ORDER BY score, id LIMIT {K}")
def q_exact_candidates(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return _rounded(search.search(_vecs(spark, d), _first(spark, d), K, "l2", candidates=ids, columns=()), "score")


@query(f"WITH {_VECS}, q AS (SELECT vec AS qv FROM vecs WHERE id = 0) SELECT id, round(score, 6) AS score FROM (SELECT id, {_L2.format('qv', 'vec')} AS score FROM vecs, q WHERE metadata['label'] = '3' AND metadata['price']::DOUBLE >= 20) ORDER BY score, id LIMIT {K}")
def q_filtered_search(spark: SparkSession, d: str) -> DataFrame:
    where = [Clause("label", "eq", "3"), Clause("price", "gte", "20")]
    return _rounded(search.search(_vecs(spark, d), _first(spark, d), K, "l2", where, columns=()), "score")


# --- filters ----------------------------------------------------------------------------------

_FILTERS = {
    "eq": ([Clause("bucket", "eq", "2")], "metadata['bucket'] = '2'"),
    "ne": ([Clause("bucket", "ne", "2")], "coalesce(metadata['bucket'] <> '2', true)"),
    "in": ([Clause("bucket", "in", "", ("1", "3", "3"))], "metadata['bucket'] IN ('1', '3')"),
    "not_in": ([Clause("bucket", "not_in", "", ("1", "3"))], "NOT coalesce(metadata['bucket'] IN ('1', '3'), false)"),
    "gt": ([Clause("price", "gt", "50")], "metadata['price']::DOUBLE > 50"),
    "gte": ([Clause("price", "gte", "50")], "metadata['price']::DOUBLE >= 50"),
    "lt": ([Clause("price", "lt", "50")], "metadata['price']::DOUBLE < 50"),
    "lte": ([Clause("price", "lte", "50")], "metadata['price']::DOUBLE <= 50"),
    "exists": ([Clause("price", "exists")], "metadata['price'] IS NOT NULL"),
    "and_range": ([Clause("price", "gte", "20"), Clause("price", "lt", "60"), Clause("label", "ne", "0")], "metadata['price']::DOUBLE >= 20 AND metadata['price']::DOUBLE < 60 AND metadata['label'] <> '0'"),
}
for _op, (_clauses, _where) in _FILTERS.items():

    @query(f"WITH {_VECS} SELECT id, tenant_id FROM vecs WHERE {_where}", f"q_filter_{_op}")
    def _filter(spark: SparkSession, d: str, clauses: list = _clauses) -> DataFrame:
        return _vecs(spark, d).where(matches(clauses)).select("id", "tenant_id")


_EDGES = ", ".join(f"('{x}')" if "\n" not in x else f"('{x.strip()}' || chr(10))" for x in EDGE_NUMBERS)


@query(
    f"""SELECT v, CASE WHEN regexp_full_match(v, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(try_cast(v AS DOUBLE)) THEN try_cast(v AS DOUBLE)
 WHEN regexp_full_match(lower(v), '[+]?inf(inity)?') THEN 'inf'::DOUBLE WHEN regexp_full_match(lower(v), '-inf(inity)?') THEN '-inf'::DOUBLE END AS x FROM (VALUES {_EDGES}) t(v)"""
)
def q_filter_number_parse(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in EDGE_NUMBERS], "v string").select("v", number(F.col("v")).alias("x"))


# --- records ----------------------------------------------------------------------------------


@query(f"WITH {_VECS} SELECT id, tenant_id, metadata['label'] AS label, len(vec)::INT AS dim FROM vecs WHERE id = 7")
def q_get(spark: SparkSession, d: str) -> DataFrame:
    return records.get(_vecs(spark, d), 7).select("id", "tenant_id", F.try_element_at("metadata", F.lit("label")).alias("label"), F.size("vec").alias("dim"))


@query("SELECT id, 151 AS next_id FROM (SELECT vec_id AS id FROM embeddings WHERE vec_id >= 51 ORDER BY 1 LIMIT 100)".replace("151", "(SELECT min(vec_id) FROM (SELECT vec_id FROM embeddings WHERE vec_id >= 51 ORDER BY 1 LIMIT 101 OFFSET 99)) + 1"))
def q_list_page(spark: SparkSession, d: str) -> DataFrame:
    return records.list_page(_vecs(spark, d), 51, 100)


@query("SELECT count(*) AS n_live FROM embeddings")
def q_count(spark: SparkSession, d: str) -> DataFrame:
    return records.count(_vecs(spark, d))


@query("SELECT count(DISTINCT doc_id) AS n_new FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def q_count_new(spark: SparkSession, d: str) -> DataFrame:
    return records.count_new(table(spark, d, "documents").select(F.col("doc_id").alias("id")), _vecs(spark, d))


@query(f"WITH {_VECS} SELECT e.key AS key, e.value AS value, count(DISTINCT id) AS n_ids FROM (SELECT id, unnest(map_entries(metadata)) AS e FROM vecs) GROUP BY 1, 2")
def q_postings(spark: SparkSession, d: str) -> DataFrame:
    return records.postings(_vecs(spark, d))


def _event_log(spark: SparkSession, d: str) -> DataFrame:
    """The events as a log: seq is event_id and id user_id; the payload is the value."""
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "purchase"), 1).when(kind == "error", 2).otherwise(3)
    return table(spark, d, "events").select(F.lit(None).cast("string").alias("tenant_id"), F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.cast("tinyint").alias("op"), F.array(F.col("value").cast("float")).alias("vec"), F.col("props").alias("extra"))


_EVENTS = "ev AS (SELECT user_id AS id, event_id AS seq, CASE WHEN event_type IN ('signup','purchase') THEN 1 WHEN event_type = 'error' THEN 2 ELSE 3 END AS op, value::FLOAT AS x, props FROM events)"
_FOLDED = f"""WITH {_EVENTS}, st AS (SELECT id, max(seq) FILTER (op = 1) AS vec_seq, max(seq) FILTER (op = 2) AS del_seq, max(seq) FILTER (op IN (1, 3)) AS meta_seq FROM ev GROUP BY 1)
 SELECT st.id, vec_seq, meta_seq, round(a.x::DOUBLE, 4) AS x, b.props AS extra FROM st JOIN ev a ON a.seq = vec_seq JOIN ev b ON b.seq = meta_seq WHERE del_seq IS NULL OR vec_seq > del_seq"""


def _state(df: DataFrame) -> DataFrame:
    return df.select("id", "vec_seq", "meta_seq", F.round(F.col("vec")[0].cast("double"), 4).alias("x"), "extra")


@query(_FOLDED)
def q_oplog_replay(spark: SparkSession, d: str) -> DataFrame:
    return _state(fold(changes_of(_event_log(spark, d))))


def _store(spark: SparkSession, name: str) -> ChangeRuns:
    return ChangeRuns(spark, shared_dir(spark, name), shuffle_partitions(spark))


@query(_FOLDED)
def q_snapshot_plus_tail(spark: SparkSession, d: str) -> DataFrame:
    """A compacted base of the first half of the log, and the rest as a run on top of it."""
    log = changes_of(_event_log(spark, d))
    half = log.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    store = _store(spark, "q_snapshot_plus_tail")
    store.append(log.where((F.col("seq") <= half) & (F.col("seq") % 2 == 0)))
    store.append(log.where((F.col("seq") <= half) & (F.col("seq") % 2 == 1)))
    store.compact()
    store.append(log.where(F.col("seq") > half))
    return _state(store.state())


@query(_FOLDED)
def q_stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """The log followed as a stream of files, in micro-batches of one file."""
    folder = shared_dir(spark, "q_stream_log")
    _event_log(spark, d).repartitionByRange(3, "seq").write.parquet(folder)
    store = _store(spark, "q_stream_replay")
    log = read_log_stream(spark, folder, spark.read.parquet(folder).schema, 1)
    follow(log, store, shared_dir(spark, "q_stream_checkpoint")).awaitTermination()
    delete_path(spark, folder)
    return _state(store.state())


@query("SELECT user_id AS id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1 UNION ALL SELECT vec_id, 0.0 FROM embeddings WHERE vec_id NOT IN (SELECT user_id FROM events)")
def q_upsert_lww(spark: SparkSession, d: str) -> DataFrame:
    have = _vecs(spark, d).select("id", F.lit(0.0).alias("value"))
    batch = table(spark, d, "events").select(F.col("user_id").alias("id"), "value", "event_id")
    return _rounded(records.upsert(have, batch, "event_id"), "value")


@query(
    f"WITH {_VECS}, ch AS (SELECT user_id AS id, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1) SELECT v.id, coalesce(ch.kind, metadata['label']) AS shown FROM vecs v LEFT JOIN ch ON ch.id = v.id"
)
def q_update_metadata(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "events").select(F.col("user_id").alias("id"), F.create_map(F.lit("kind"), "event_type").alias("metadata"), "event_id")
    new = records.update_metadata(_vecs(spark, d), changes, "event_id")
    return new.select("id", F.coalesce(F.try_element_at("metadata", F.lit("kind")), F.try_element_at("metadata", F.lit("label"))).alias("shown"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def q_delete(spark: SparkSession, d: str) -> DataFrame:
    return records.delete(_vecs(spark, d), table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("id"))).select("id")


_OT = "coalesce(nullif(tenant_id,''),'default')"


@query(
    f"WITH r AS (SELECT DISTINCT {_OT} || '/' || shard AS log, seq FROM oplog), n AS (SELECT *, lead(seq) OVER (PARTITION BY log ORDER BY seq) AS nx FROM r) SELECT log, seq AS after_seq FROM n WHERE nx > seq + 1"
)
def q_seq_gaps(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "oplog").select(F.concat(tenant_of(), F.lit("/"), F.col("shard").cast("string")).alias("log"), "seq")
    return records.seq_gaps(log, "log")


@query(
    f"""WITH o AS (SELECT {_OT} AS tenant_id, id, max(seq) FILTER (op = 1) AS i, max(seq) FILTER (op = 2) AS x FROM oplog GROUP BY 1, 2),
 c AS (SELECT tenant_id, count(*) FILTER (i IS NOT NULL AND (x IS NULL OR i > x)) AS n_live, count(*) FILTER (x > i) AS n_dead FROM o GROUP BY 1)
 SELECT *, n_dead >= 256 AND n_dead > n_live AS due FROM c"""
)
def q_compaction_due(spark: SparkSession, d: str) -> DataFrame:
    c = changes_of(table(spark, d, "oplog"), [])
    last = lambda op: F.max(F.when(F.col("op") == op, F.col("seq")))
    ids = c.groupBy("tenant_id", "id").agg(last(1).alias("i"), last(2).alias("x"))
    live, dead = F.col("i").isNotNull() & (F.col("x").isNull() | (F.col("i") > F.col("x"))), F.col("x") > F.col("i")
    counts = ids.groupBy("tenant_id").agg(F.count_if(live).alias("n_live"), F.count_if(dead).alias("n_dead"))
    return counts.withColumn("due", records.compaction_due(counts))


@query(f"SELECT {_OT} AS tenant_id, shard, arg_max(snapshot_seq, run_no) AS done_seq FROM snapshots WHERE lower(trim(status)) = 'ok' GROUP BY 1, 2")
def q_snapshot_seq(spark: SparkSession, d: str) -> DataFrame:
    return last_success(table(spark, d, "snapshots")).select("tenant_id", "shard", "done_seq")


# --- tenants ----------------------------------------------------------------------------------

_TEN = f"ten AS (SELECT {_OT} AS tenant_id, max(dim) AS dim, max(metric) AS metric, max(max_vectors) AS max_vectors, max(max_qps) AS max_qps FROM tenants GROUP BY 1)"


@query(f"WITH {_TEN}, n AS (SELECT {_OT} AS tenant_id, count(DISTINCT id) AS n_vectors FROM vectors GROUP BY 1) SELECT ten.*, coalesce(n_vectors, 0) AS n_vectors FROM ten LEFT JOIN n USING (tenant_id)")
def q_tenant_stats(spark: SparkSession, d: str) -> DataFrame:
    return tenants.tenant_stats(table(spark, d, "vectors"), table(spark, d, "tenants"))


@query(
    f"""WITH {_TEN}, st AS (SELECT DISTINCT {_OT} AS tenant_id, id FROM vectors), gv AS (SELECT DISTINCT {_OT} AS tenant_id, id FROM oplog WHERE op = 1),
 l AS (SELECT tenant_id, count(*) AS n FROM st GROUP BY 1), w AS (SELECT tenant_id, count(*) AS n FROM (SELECT * FROM gv EXCEPT SELECT * FROM st) GROUP BY 1)
 SELECT g.tenant_id, coalesce(l.n, 0) AS n_live, coalesce(w.n, 0) AS n_new, coalesce(max_vectors, 0) = 0 OR coalesce(l.n, 0) + coalesce(w.n, 0) <= max_vectors AS fits
 FROM (SELECT DISTINCT tenant_id FROM gv) g LEFT JOIN l USING (tenant_id) LEFT JOIN w USING (tenant_id) LEFT JOIN ten USING (tenant_id)"""
)
def q_quota_check(spark: SparkSession, d: str) -> DataFrame:
    return tenants.quota_check(table(spark, d, "oplog").where("op = 1"), table(spark, d, "vectors"), table(spark, d, "tenants"))


@query(
    f"""WITH {_TEN}, v AS (SELECT {_OT} AS tenant_id, id, vec, metadata FROM vectors)
 SELECT v.tenant_id, id, CASE WHEN ten.tenant_id IS NULL THEN 'unknown tenant' WHEN vec IS NULL OR len(vec) IS DISTINCT FROM dim THEN 'bad dim' ELSE 'not finite' END AS problem
 FROM v LEFT JOIN ten USING (tenant_id) WHERE ten.tenant_id IS NULL OR vec IS NULL OR len(vec) IS DISTINCT FROM dim OR NOT list_bool_and(list_transform(vec, lambda x: x IS NOT NULL AND isfinite(x)))"""
)
def q_batch_violations(spark: SparkSession, d: str) -> DataFrame:
    return records.batch_violations(table(spark, d, "vectors"), table(spark, d, "tenants"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS client, ts, event_id AS request_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT client, ts, request_id, s, n, true AS allowed, 0.0::DOUBLE AS tokens FROM e WHERE n = 1
  UNION ALL SELECT e.client, e.ts, e.request_id, e.s, e.n, least(1.0, r.tokens + (e.s - r.s) * 0.001::DOUBLE) >= 1,
   least(1.0, r.tokens + (e.s - r.s) * 0.001::DOUBLE) - CASE WHEN least(1.0, r.tokens + (e.s - r.s) * 0.001::DOUBLE) >= 1 THEN 1 ELSE 0 END FROM r JOIN e ON e.client = r.client AND e.n = r.n + 1)
 SELECT client, ts, request_id, allowed FROM r"""
)
def q_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    req = table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("ts"), F.col("event_id").alias("request_id"))
    return tenants.rate_limited(req, "client", "ts", 0.001)


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """Made-up access keys: one for each customer, for one or two tenants; some expired."""
    c = table(spark, d, "customer")
    return c.select(
        F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key_id"),
        F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("t"), (F.col("c_custkey") % 4).cast("string")), F.concat(F.lit("t"), (F.col("c_nationkey") % 4).cast("string")))).alias("tenants"),
        (F.col("c_custkey") % 97 == 0).alias("admin"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("2020-01-01").cast("timestamp")).alias("expires_at"),
    )


_KEYS = """ks AS (SELECT 'k' || c_custkey AS key_id, CASE WHEN c_custkey % 5 = 0 THEN ['*'] ELSE ['t' || (c_custkey % 4), 't' || (c_nationkey % 4)] END AS tenants, c_custkey % 97 = 0 AS admin, c_custkey % 3 = 0 AS expired FROM customer)"""


@query(f"WITH {_KEYS} SELECT key_id FROM ks WHERE NOT expired AND (admin OR list_contains(tenants, 't1') OR list_contains(tenants, '*'))")
def q_key_allow(spark: SparkSession, d: str) -> DataFrame:
    return tenants.keys_allowing(_keys(spark, d), "t1", F.lit("2024-01-01").cast("timestamp")).select("key_id")


@query(f"WITH {_KEYS} SELECT key_id, array_to_string(list_filter(tenants, lambda x: x <> 't1'), ',') AS tenants FROM ks WHERE admin OR len(list_filter(tenants, lambda x: x <> 't1')) > 0")
def q_drop_tenant(spark: SparkSession, d: str) -> DataFrame:
    return tenants.drop_tenant_from_keys(_keys(spark, d), "t1").select("key_id", F.array_join("tenants", ",").alias("tenants"))


# --- product quantisation and inverted lists -----------------------------------------------------

# With a fixed book and fixed lists (the first rows), which SQL can follow: these check encoding, tables and ranking
# against SQL and find few of the true neighbours. The searches to use are those with trained ones, q_..._trained.

def _book(spark: SparkSession, d: str) -> quantize.Codebook:
    return quantize.codebook_of(_vecs(spark, d).where(F.col("id") < CENTROIDS), SUBSPACES)


def _lists(spark: SparkSession, d: str) -> np.ndarray:
    return np.array([r[0] for r in _vecs(spark, d).where(F.col("id") < LISTS).orderBy("id").select("vec").collect()], np.float64)


_SUB = 64 // SUBSPACES
_CB = f"{_VECS}, cb AS (SELECT id AS c, s, vec[s * {_SUB} + 1 : s * {_SUB} + {_SUB}] AS cv FROM vecs, (SELECT unnest(range({SUBSPACES}))::INT AS s) WHERE id < {CENTROIDS})"
_CODES = f"""{_CB}, en AS (SELECT v.id, s, c, row_number() OVER (PARTITION BY v.id, s ORDER BY {_L2.format(f'v.vec[s * {_SUB} + 1 : s * {_SUB} + {_SUB}]', 'cv')}, c) AS r FROM vecs v, cb),
 codes AS (SELECT id, s, c::INT AS c FROM en WHERE r = 1)"""
_TABLE = f"tab AS (SELECT q.id AS query_id, s, c::INT AS c, {_L2.format(f'q.vec[s * {_SUB} + 1 : s * {_SUB} + {_SUB}]', 'cv')} AS dist FROM vecs q, cb WHERE q.id % 20 = 0)"
_ADC = f"{_CODES}, {_TABLE}, adc AS (SELECT query_id, id, list_sum(list(dist ORDER BY s)) AS score FROM codes JOIN tab USING (s, c) GROUP BY 1, 2)"


def _best(source: str, k: int, by: str = "query_id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score, id)::INT AS rank FROM {source}) WHERE rank <= {k}"


@query(f"WITH {_VECS} SELECT id, s AS part, array_to_string(list_transform(vec[s * {_SUB} + 1 : s * {_SUB} + {_SUB}], lambda x: round(x * 1000000)::BIGINT), ' ') AS numbers FROM vecs, (SELECT unnest(range({SUBSPACES}))::INT AS s)")
def q_pq_subvectors(spark: SparkSession, d: str) -> DataFrame:
    parts = _vecs(spark, d).select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(SUBSPACES - 1))).alias("part"))
    shown = F.transform(D.subvector("vec", F.col("part"), _SUB), lambda x: F.round(x.cast("double") * 1000000).cast("bigint").cast("string"))
    return parts.select("id", "part", F.array_join(shown, " ").alias("numbers"))


@query(f"WITH {_CODES} SELECT id, array_to_string(list(c ORDER BY s), ' ') AS code FROM codes GROUP BY 1")
def q_pq_encode(spark: SparkSession, d: str) -> DataFrame:
    return quantize.encode(_vecs(spark, d), _book(spark, d)).select("id", F.array_join(F.transform("code", lambda c: c.cast("string")), " ").alias("code"))


@query(f"WITH {_CODES} SELECT x.id, (x.s * {_SUB} + i)::INT AS place, round(cv[i + 1], 6) AS x FROM codes x JOIN cb ON cb.s = x.s AND cb.c = x.c, (SELECT unnest(range({_SUB})) AS i)")
def q_pq_decode(spark: SparkSession, d: str) -> DataFrame:
    book = _book(spark, d)
    decoded = quantize.decode(quantize.encode(_vecs(spark, d), book), book)
    return _rounded(decoded.select("id", F.posexplode("vec").alias("place", "x")), "x")


@query(f"WITH {_CB}, {_TABLE} SELECT query_id, s AS subspace, c AS centroid, round(dist, 6) AS dist FROM tab")
def q_pq_adc_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(quantize.distance_tables(_queries(spark, d), _book(spark, d)), "dist")


@query(f"WITH {_ADC} SELECT query_id, id, round(score, 6) AS score FROM adc")
def q_pq_adc(spark: SparkSession, d: str) -> DataFrame:
    """Table distances of every query to every code, as a join of codes and tables."""
    book = _book(spark, d)
    codes = quantize.encode(_vecs(spark, d), book).select("id", F.posexplode("code").alias("subspace", "centroid"))
    tables = quantize.distance_tables(_queries(spark, d), book)
    joined = codes.join(tables, ["subspace", "centroid"])
    return _rounded(joined.groupBy("query_id", "id").agg(F.sum("dist").alias("score")), "score")


@query(f"WITH {_ADC} SELECT query_id, rank, id, round(score, 6) AS score FROM ({_best('adc', K)})")
def q_pq_search(spark: SparkSession, d: str) -> DataFrame:
    book = _book(spark, d)
    return _rounded(quantize.code_search(_queries(spark, d), quantize.encode(_vecs(spark, d), book), book, K), "score")


_RERANK = f"""SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INT AS rank FROM
 (SELECT query_id, n.id, {_L2.format('q.vec', 'v.vec')} AS score FROM near n JOIN vecs q ON q.id = query_id JOIN vecs v ON v.id = n.id)) WHERE rank <= {K}"""


@query(f"WITH {_ADC}, near AS ({_best('adc', 100)}) {_RERANK}")
def q_pq_rerank(spark: SparkSession, d: str) -> DataFrame:
    book, v = _book(spark, d), _vecs(spark, d)
    return _rounded(quantize.code_search_reranked(_queries(spark, d), quantize.encode(v, book), v, book, K, 100), "score")


_LIST = f"ls AS (SELECT id AS list_id, vec AS lv FROM vecs WHERE id < {LISTS}), ld AS (SELECT v.id, list_id::INT AS list_id, row_number() OVER (PARTITION BY v.id ORDER BY {_L2.format('v.vec', 'lv')}, list_id)::INT AS r FROM vecs v, ls)"
_IVF = f"{_ADC}, {_LIST}, ivf AS (SELECT a.* FROM adc a JOIN ld own ON own.id = a.id AND own.r = 1 JOIN ld p ON p.id = a.query_id AND p.r <= {PROBES} AND p.list_id = own.list_id)"


@query(f"WITH {_VECS}, {_LIST} SELECT id, list_id FROM ld WHERE r = 1")
def q_ivf_assign(spark: SparkSession, d: str) -> DataFrame:
    return quantize.assign_lists(_vecs(spark, d), _lists(spark, d))


@query(f"WITH {_VECS}, {_LIST} SELECT id AS query_id, r - 1 AS place, list_id FROM ld WHERE r <= {PROBES} AND id % 20 = 0")
def q_ivf_probe(spark: SparkSession, d: str) -> DataFrame:
    return quantize.probed_lists(_queries(spark, d), _lists(spark, d), PROBES)


@query(f"WITH {_IVF} SELECT query_id, rank, id, round(score, 6) AS score FROM ({_best('ivf', K)})")
def q_ivf_search(spark: SparkSession, d: str) -> DataFrame:
    book, lists = _book(spark, d), _lists(spark, d)
    return _rounded(quantize.code_search(_queries(spark, d), quantize.ivf_index(_vecs(spark, d), book, lists), book, K, lists, PROBES), "score")


@query(f"WITH {_IVF}, near AS ({_best('ivf', 100)}) {_RERANK}")
def q_ivf_rerank(spark: SparkSession, d: str) -> DataFrame:
    book, lists, v = _book(spark, d), _lists(spark, d), _vecs(spark, d)
    return _rounded(quantize.code_search_reranked(_queries(spark, d), quantize.ivf_index(v, book, lists), v, book, K, 100, lists, PROBES), "score")


def _trained_book(spark: SparkSession, d: str) -> quantize.Codebook:
    v = _vecs(spark, d).select("id", "vec")
    return quantize.train_codebook(v, TRAINED_SUBSPACES, max(1, min(quantize.MAX_CENTROIDS, v.count())))


def _trained_lists(spark: SparkSession, d: str) -> np.ndarray:
    v = _vecs(spark, d).select("id", "vec")
    return quantize.train_lists(v, max(1, min(TRAINED_LISTS, v.count())))


@query()
def q_pq_search_trained(spark: SparkSession, d: str) -> DataFrame:
    book = _trained_book(spark, d)
    return _rounded(quantize.code_search(_queries(spark, d), quantize.encode(_vecs(spark, d), book), book, K), "score")


@query()
def q_pq_rerank_trained(spark: SparkSession, d: str) -> DataFrame:
    book, v = _trained_book(spark, d), _vecs(spark, d)
    return _rounded(quantize.code_search_reranked(_queries(spark, d), quantize.encode(v, book), v, book, K, 100), "score")


@query()
def q_ivf_search_trained(spark: SparkSession, d: str) -> DataFrame:
    book, lists = _trained_book(spark, d), _trained_lists(spark, d)
    return _rounded(quantize.code_search(_queries(spark, d), quantize.ivf_index(_vecs(spark, d), book, lists), book, K, lists, TRAINED_PROBES), "score")


@query()
def q_ivf_rerank_trained(spark: SparkSession, d: str) -> DataFrame:
    book, lists, v = _trained_book(spark, d), _trained_lists(spark, d), _vecs(spark, d)
    return _rounded(quantize.code_search_reranked(_queries(spark, d), quantize.ivf_index(v, book, lists), v, book, K, 100, lists, TRAINED_PROBES), "score")


@query()
def q_recall_trained(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall at K of each trained search."""
    truth = search.knn_join(_queries(spark, d), _vecs(spark, d), K, "l2")
    out = None
    for f in (q_pq_search_trained, q_pq_rerank_trained, q_ivf_search_trained, q_ivf_rerank_trained):
        part = metrics.recall(f(spark, d), truth).agg(F.avg("recall").alias("recall")).select(F.lit(f.__name__).alias("search"), "recall")
        out = part if out is None else out.unionByName(part)
    return _rounded(out, "recall")


@query(
    f"""WITH {_VECS}, {_LIST}, own AS (SELECT id, list_id FROM ld WHERE r = 1), x AS (SELECT list_id, unnest(range(64))::INT AS place, unnest(vec) AS x FROM own JOIN vecs USING (id))
 SELECT list_id::BIGINT AS centroid, count(*) AS n, place, round(avg(x), 6) AS x FROM x GROUP BY ALL"""
)
def q_kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    v = _vecs(spark, d)
    step = quantize.kmeans_step(v, v.where(F.col("id") < LISTS).select(F.col("id").alias("centroid"), F.col("vec").alias("v")))
    return _rounded(step.select("centroid", "n", F.posexplode("v").alias("place", "x")), "x")


# --- shards -----------------------------------------------------------------------------------

_FNV = f"""fnv AS (WITH RECURSIVE r AS (SELECT vec_id AS id, 0 AS k, 14695981039346656037::UHUGEINT AS h FROM embeddings UNION ALL
  SELECT id, k + 1, (((h - h % 256) + xor((h % 256)::BIGINT, (id >> (56 - 8 * k)) & 255)::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT FROM r WHERE k < 8)
  SELECT id, (h % {SHARDS})::INT AS shard FROM r WHERE k = 8)"""


@query(f"WITH {_FNV} SELECT id, shard FROM fnv")
def q_shard_for(spark: SparkSession, d: str) -> DataFrame:
    return shard.with_shard(_vecs(spark, d).select("id"), SHARDS)


@query(ORACLES["q_knn_join_l2"])
def q_scatter_gather(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.scatter_gather(_queries(spark, d), shard.with_shard(_vecs(spark, d).select("id", "vec"), SHARDS), K, "l2", "shard"), "score")


def _shards(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.col("id").cast("int").alias("shard"))


def _nodes(spark: SparkSession, n: int) -> DataFrame:
    return spark.createDataFrame([(x,) for x in NODES[:n]], "node string")


def _ring(n: int, name: str) -> str:
    nodes = ", ".join(f"('{x}')" for x in NODES[:n])
    return f"""{name} AS (SELECT shard, node, (row_number() OVER (PARTITION BY shard ORDER BY far) - 1)::INT AS place FROM (SELECT shard, node, min(CASE WHEN h >= hs THEN 0 ELSE 1 END::HUGEINT * 18446744073709551616 + h::HUGEINT) AS far
  FROM (SELECT node, ('0x' || substr(sha256(node || '#' || i), 1, 16))::UBIGINT AS h FROM (VALUES {nodes}) t(node), range(150) x(i)),
  (SELECT s::INT AS shard, ('0x' || substr(sha256('shard#' || s), 1, 16))::UBIGINT AS hs FROM range(64) y(s)) GROUP BY 1, 2))"""


@query(f"WITH {_ring(4, 'r')} SELECT shard, node FROM r WHERE place = 0")
def q_ring_owner(spark: SparkSession, d: str) -> DataFrame:
    return shard.ring_owners(_shards(spark), _nodes(spark, 4)).select("shard", "node")


@query(f"WITH {_ring(4, 'r')} SELECT shard, place, node FROM r WHERE place < 3")
def q_ring_owners(spark: SparkSession, d: str) -> DataFrame:
    return shard.ring_owners(_shards(spark), _nodes(spark, 4), 3)


@query(f"WITH {_ring(3, 'a')}, {_ring(4, 'b')} SELECT shard, a.node AS node_before, b.node AS node_after FROM a JOIN b USING (shard) WHERE a.place = 0 AND b.place = 0 AND a.node <> b.node")
def q_rebalance_diff(spark: SparkSession, d: str) -> DataFrame:
    return shard.rebalance(_shards(spark), _nodes(spark, 3), _nodes(spark, 4))


@query("SELECT (s_nationkey) AS shard, arg_min(s_name, struct_pack(a := -s_acctbal, n := s_name)) AS node FROM supplier GROUP BY 1")
def q_failover(spark: SparkSession, d: str) -> DataFrame:
    return shard.failover(table(spark, d, "supplier").select(F.col("s_nationkey").alias("shard"), F.col("s_name").alias("node"), F.col("s_acctbal").alias("seq")))


# --- measures and texts --------------------------------------------------------------------------


@query(
    f"""WITH {_ADC}, got AS ({_best('adc', K)}), ex AS (SELECT q.id AS query_id, v.id, {_L2.format('q.vec', 'v.vec')} AS score FROM vecs q, vecs v WHERE q.id % 20 = 0), truth AS ({_best('ex', K)})
 SELECT t.query_id, round(count(g.id) / count(*), 6) AS recall FROM truth t LEFT JOIN got g ON g.query_id = t.query_id AND g.id = t.id GROUP BY 1"""
)
def q_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    truth = search.knn_join(_queries(spark, d), _vecs(spark, d), K, "l2")
    book = _book(spark, d)
    found = quantize.code_search(_queries(spark, d), quantize.encode(_vecs(spark, d), book), book, K)
    return _rounded(metrics.recall(found, truth), "recall")


@query(
    """WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
 SELECT event_type, v[least(floor(len(v) * 0.5)::BIGINT, len(v) - 1) + 1] AS p50, v[least(floor(len(v) * 0.95)::BIGINT, len(v) - 1) + 1] AS p95 FROM s"""
)
def q_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.percentiles(table(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95}, by=["event_type"])


@query("SELECT doc_id, CASE WHEN text IS NOT NULL THEN concat('0x', substr(sha256(text), 1, 15))::BIGINT END AS text_id FROM documents")
def q_text_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.text_id("text").alias("text_id"))


@query("SELECT concat('0x', substr(sha256(text), 1, 15))::BIGINT AS text_id, count(*) AS n_rows FROM documents WHERE length(trim(text, ' ')) > 0 GROUP BY 1")
def q_text_dedup(spark: SparkSession, d: str) -> DataFrame:
    return text.distinct_texts(table(spark, d, "documents")).select("text_id", "n_rows")


@query(
    "SELECT * FROM (SELECT doc_id, (unnest(range(len(p))))::INT AS position, trim(unnest(p), ' ') AS paragraph FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL)) WHERE length(paragraph) >= 40"
)
def q_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return text.paragraphs(table(spark, d, "documents"))


@query()
def q_hnsw_search(spark: SparkSession, d: str) -> DataFrame:
    graphs = hnsw.build_graphs(shard.with_shard(_vecs(spark, d).select("id", "vec"), SHARDS), "l2")
    return _rounded(hnsw.search_graphs(_queries(spark, d), graphs, K, "l2"), "score")
