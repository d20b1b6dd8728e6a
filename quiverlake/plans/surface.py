"""Queries of the call surface: filter forms, readers and writers, index upkeep, store calls, measures.

Where a result is a measure that SQL can't follow (the recall of an approximate search), the query
says whether it reaches its bound, and the SQL expects that it does.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.functions import distance as D
from quiverlake.functions import filters, metrics, text
from quiverlake.functions.tenants import tenant_of
from quiverlake.operators import change_runs, hnsw, incremental, planner, quantize, records, search, shard, tenants
from quiverlake.plans import catalog as c
from quiverlake.session import shared_dir, table, written
from quiverlake.sources import records as files
from quiverlake.store import Store
from quiverlake.streaming.oplog_stream import lagging, next_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MIN_RECALL = 0.9
#: Records of one log file.
LOG_FILE_RECORDS = 1000
_V = c._VECS
_T = c._OT


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# --- distances and searches -------------------------------------------------------------------

_U = f"{_V}, u AS (SELECT id, list_transform(vec, lambda x: x / {c._LEN.format('vec')}) AS n FROM vecs)"


@query(f"WITH {_U} SELECT u.id, round(1 - {c._DOT.format('u.n', 'q.n')}, 6) AS score FROM u, u q WHERE q.id = 0")
def q_unit_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = c._vecs(spark, d).select("id", D.normalized("vec").alias("n"))
    first = F.lit(list(v.where("id = 0").first()["n"]))
    return c._rounded(v.select("id", D.unit_cosine_distance("n", first).alias("score")), "score")


@query(f"WITH {_V}, q AS (SELECT vec AS qv FROM vecs WHERE id = 0) SELECT id, CASE WHEN id % 5 = 0 THEN 'inf'::DOUBLE ELSE round({c._L2.format('qv', 'vec')}, 6) END AS score FROM vecs, q")
def q_l2_unequal_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Squared L2 is infinite where one side is shorter."""
    q = F.lit(c._first(spark, d)).cast("array<float>")
    return c._rounded(c._vecs(spark, d).select("id", D.l2_squared("vec", F.when(F.col("id") % 5 == 0, F.slice(q, 1, 32)).otherwise(q)).alias("score")), "score")


@query(f"WITH {_V}, q AS (SELECT vec AS qv FROM vecs WHERE id = 0) SELECT id, round({c._L2.format('qv', 'vec')}, 6) AS l2, round(-{c._DOT.format('qv', 'vec')}, 6) AS dot, round({c._COS.format('qv', 'vec')}, 6) AS cosine, round({c._LEN.format('vec')}, 6) AS length FROM vecs, q")
def q_sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The distances as SQL functions."""
    D.register_sql(spark)
    q = F.lit(c._first(spark, d)).cast("array<float>")
    v = c._vecs(spark, d).withColumn("q", q)
    return c._rounded(v.selectExpr("id", "l2_distance(q, vec) AS l2", "dot_distance(q, vec) AS dot", "cosine_distance(q, vec) AS cosine", "vector_norm(vec) AS length"), "l2", "dot", "cosine", "length")


@query(c.ORACLES["q_knn_join_l2"])
def q_knn_lateral(spark: SparkSession, d: str) -> DataFrame:
    """The table function in a lateral join."""
    search.register_knn(spark, c._vecs(spark, d), "l2", "q_knn_l2")
    c._queries(spark, d).createOrReplaceTempView("q_lateral_queries")
    return c._rounded(spark.sql(f"SELECT q.query_id, n.rank, n.id, n.score FROM q_lateral_queries q, LATERAL q_knn_l2(q.vec, {c.K}) n"), "score")


@query(f"WITH {_V}, q AS (SELECT vec AS qv FROM vecs WHERE id = 0) SELECT id, round(score, 6) AS score, label, bucket FROM (SELECT id, {c._L2.format('qv', 'vec')} AS score, metadata['label'] AS label, metadata['bucket'] AS bucket FROM vecs, q) ORDER BY score, id LIMIT {c.K}")
def q_search_metadata(spark: SparkSession, d: str) -> DataFrame:
    found = search.search(c._vecs(spark, d), c._first(spark, d), c.K, "l2")
    return c._rounded(found.select("id", "score", *(F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("label", "bucket"))), "score")


_POOL = [filters.Clause("label", "eq", "3"), filters.Clause("bucket", "in", "", ("1", "2")), filters.Clause("price", "gte", "20")]


@query(f"WITH {_V} SELECT CASE WHEN n <= {planner.EXACT_LIMIT} THEN n END AS pool FROM (SELECT least(count(*) FILTER (metadata['label'] = '3'), count(*) FILTER (metadata['bucket'] IN ('1', '2'))) AS n FROM vecs)")
def q_candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    """The smallest set of records that an equality clause of a filter leaves, if it is small enough."""
    return spark.createDataFrame([(planner.candidate_pool(c._vecs(spark, d), _POOL),)], "pool bigint")


def _graphs(spark: SparkSession, d: str) -> DataFrame:
    return written(hnsw.build_graphs(shard.with_shard(c._vecs(spark, d).select("id", "vec"), c.SHARDS), "l2"), "graphs")


@query(f"WITH {_V}, q AS (SELECT vec AS qv FROM vecs WHERE id = 0) SELECT id, round(score, 6) AS score FROM (SELECT id, {c._L2.format('qv', 'vec')} AS score FROM vecs, q WHERE metadata['label'] = '3' AND metadata['bucket'] IN ('1', '2') AND metadata['price']::DOUBLE >= 20) ORDER BY score, id LIMIT {c.K}")
def q_planned_search(spark: SparkSession, d: str) -> DataFrame:
    """A filtered search by the path that the planner takes: exact, as the filter leaves few records."""
    v = c._vecs(spark, d)
    return c._rounded(planner.planned_search(v, hnsw.build_graphs(v.limit(0).select(F.lit(0).alias("shard"), "id", "vec")), c._first(spark, d), c.K, "l2", _POOL).select("id", "score"), "score")


@query("SELECT count(*) AS n_queries, true AS recall_ok FROM embeddings WHERE vec_id % 20 = 0")
def q_hnsw_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the graphs find at least MIN_RECALL of the true neighbours."""
    found = hnsw.search_graphs(c._queries(spark, d), _graphs(spark, d), c.K, "l2")
    each = metrics.recall(found, search.knn_join(c._queries(spark, d), c._vecs(spark, d), c.K, "l2"))
    return each.agg(F.count(F.lit(1)).alias("n_queries"), (F.avg("recall") >= MIN_RECALL).alias("recall_ok"))


@query("SELECT search, true AS recall_ok FROM (VALUES ('q_pq_search_trained'), ('q_pq_rerank_trained'), ('q_ivf_search_trained'), ('q_ivf_rerank_trained')) t(search)")
def q_trained_recall(spark: SparkSession, d: str) -> DataFrame:
    return c.q_recall_trained(spark, d).select("search", (F.col("recall") >= MIN_RECALL).alias("recall_ok"))


# --- filters ----------------------------------------------------------------------------------

_FORMS = {
    "short": filters.from_equalities({"label": "3", "bucket": "2"}),
    "messages": filters.from_messages([{"key": "label", "value": "3"}, {"key": "price", "op": "gte", "value": "20"}, {"key": "bucket", "op": "in", "values": ["1", "2"]}]),
    "tuples": filters.from_tuples([("label", "ne", "3"), ("price", "exists"), ("bucket", "not_in", ["0", "1"])]),
    "text": filters.from_text(["label=3"], ["price:lt:50", "bucket:in:1,2,3"]),
}


@query(
    f"""WITH {_V} SELECT form, count(*) AS n FROM (SELECT 'short' AS form FROM vecs WHERE metadata['label'] = '3' AND metadata['bucket'] = '2'
 UNION ALL SELECT 'messages' FROM vecs WHERE metadata['label'] = '3' AND metadata['price']::DOUBLE >= 20 AND metadata['bucket'] IN ('1', '2')
 UNION ALL SELECT 'tuples' FROM vecs WHERE metadata['label'] <> '3' AND metadata['price'] IS NOT NULL AND metadata['bucket'] NOT IN ('0', '1')
 UNION ALL SELECT 'text' FROM vecs WHERE metadata['label'] = '3' AND metadata['price']::DOUBLE < 50 AND metadata['bucket'] IN ('1', '2', '3')) GROUP BY 1"""
)
def q_filter_forms(spark: SparkSession, d: str) -> DataFrame:
    """Filters in each of the ways to write them."""
    v = c._vecs(spark, d)
    hits = F.array(*(F.when(filters.matches(clauses), F.lit(form)) for form, clauses in _FORMS.items()))
    return v.select(F.explode(hits).alias("form")).where("form IS NOT NULL").groupBy("form").agg(F.count(F.lit(1)).alias("n"))


_HEX = {"0x1p4": "16.0", "0x1.8p1": "3.0", "-0x.8p0": "-0.5", "0X1P-2": "0.25", "+0xAp0": "10.0", "0x10": "NULL", "0x1p99999": "NULL", "0xp1": "NULL", " 0x1p1": "NULL"}


@query("SELECT v, x::DOUBLE AS x FROM (VALUES " + ", ".join(f"('{k}', {x})" for k, x in _HEX.items()) + ") t(v, x)")
def q_filter_hex_numbers(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _HEX], "v string").select("v", filters.number(F.col("v")).alias("x"))


@query(f"WITH {_V} SELECT id FROM vecs WHERE metadata['bucket'] IN ('1', '4')")
def q_posting_ids(spark: SparkSession, d: str) -> DataFrame:
    return records.posting_ids(c._vecs(spark, d), "bucket", ["1", "4", "1"])


# --- readers and writers ------------------------------------------------------------------------


@query(f"WITH {_V} SELECT id, tenant_id, metadata['label'] AS label, len(vec)::INT AS dim, round({c._LEN.format('vec')}, 4) AS length FROM vecs")
def q_json_batch(spark: SparkSession, d: str) -> DataFrame:
    """The collection written as a JSON batch, one object a line, and read again."""
    path = shared_dir(spark, "json-batch")
    c._vecs(spark, d).select(F.col("id").cast("string").alias("id"), F.col("vec").alias("values"), "metadata", "tenant_id").write.json(path)
    got = files.read_json_batch(spark, path, multi_line=False)
    return got.select(F.col("id").cast("bigint").alias("id"), "tenant_id", F.try_element_at("metadata", F.lit("label")).alias("label"), F.size("vec").alias("dim"), F.round(F.sqrt(D.squared_norm("vec")), 4).alias("length"))


@query("SELECT dim, metric, max_vectors, max_qps FROM tenants")
def q_sidecars(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "sidecars")
    table(spark, d, "tenants").select("dim", "metric", "max_vectors", "max_qps").write.option("ignoreNullFields", "false").json(path)
    return spark.read.schema("dim int, metric string, max_vectors bigint, max_qps double").json(path)


@query(f"WITH {_V} SELECT id::VARCHAR AS id, metadata['label'] AS label, metadata['price'] AS price FROM vecs")
def q_metadata_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects of ids and their metadata, as a snapshot has them, taken apart."""
    objects = c._vecs(spark, d).select(F.to_json(F.create_map(F.col("id").cast("string"), "metadata")).alias("j"))
    return files.metadata_rows(objects, "j").select("id", *(F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("label", "price")))


_LOGGED = f"""lg AS (SELECT {_T} AS tenant_id, shard, seq, any_value(op) AS op, any_value(id) AS id, any_value(len(vec)) AS dim FROM oplog GROUP BY 1, 2, 3)"""


@query(f"WITH {_LOGGED} SELECT tenant_id, shard, op::TINYINT AS op, count(*) AS n, sum(id)::BIGINT AS ids, coalesce(sum(dim), 0)::BIGINT AS numbers FROM lg GROUP BY 1, 2, 3")
def q_log_frames(spark: SparkSession, d: str) -> DataFrame:
    """The records of oplog as frames of the binary log, LOG_FILE_RECORDS a file, and parsed again.
    Missing records are passed over by counting a file's records anew."""
    log = table(spark, d, "oplog").select(tenant_of().alias("tenant_id"), "shard", "seq", "op", "id", "vec")
    once = log.groupBy("tenant_id", "shard", "seq").agg(F.max_by(F.struct("op", "id", "vec"), "op").alias("r"))
    once = once.select("tenant_id", "shard", F.floor(F.col("seq") / LOG_FILE_RECORDS).alias("file"), "seq", "r.*")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        rows = zip(t.column("op").to_pylist(), t.column("id").to_pylist(), t.column("vec").to_pylist())
        data = b"".join(files.frame(i, op, x, vec if op == files.INSERT else None) for i, (op, x, vec) in enumerate(rows, 1))
        back = files.parse_log(data)
        n = len(back)
        return pa.table({"tenant_id": pa.array([key[0].as_py()] * n, pa.string()), "shard": pa.array([key[1].as_py()] * n, pa.int32()), "op": pa.array([r[1] for r in back], pa.int8()), "id": pa.array([r[2] for r in back], pa.int64()), "dim": pa.array([len(r[3] or []) for r in back], pa.int32())})

    parsed = once.groupBy("tenant_id", "shard", "file").applyInArrow(run, "tenant_id string, shard int, op tinyint, id bigint, dim int")
    return parsed.groupBy("tenant_id", "shard", "op").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.sum(F.col("dim").cast("bigint")).alias("numbers"))


@query(f"WITH {c._EVENTS}, st AS (SELECT id, max(seq) FILTER (op = 1) AS vec_seq, max(seq) FILTER (op = 2) AS del_seq FROM ev GROUP BY 1) SELECT id, vec_seq, (SELECT max(event_id) FROM events) AS snapshot_seq FROM st WHERE vec_seq IS NOT NULL AND (del_seq IS NULL OR vec_seq > del_seq)")
def q_snapshot_file(spark: SparkSession, d: str) -> DataFrame:
    """A state written as a snapshot with its header, and read with the header checked."""
    log = change_runs.changes_of(c._event_log(spark, d))
    path = shared_dir(spark, "snapshot")
    files.write_snapshot(change_runs.fold(log), path, log.agg(F.max("seq")).first()[0] or 0, 1, "l2")
    return files.read_snapshot(spark, path, 1, "l2").select("id", "vec_seq", "snapshot_seq")


# --- index upkeep -------------------------------------------------------------------------------

_MOVED = "mv AS (SELECT id, CASE WHEN id % 10 = 3 THEN list_transform(vec, lambda x: -x) ELSE vec END AS vec FROM vecs WHERE id % 10 <> 7)"


def _upkeep(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors there at first, those inserted (new ones, and others again with all signs changed), ids deleted."""
    v = c._vecs(spark, d).select("id", "vec")
    again = v.where("id % 10 = 3").select("id", F.lit(2).alias("at"), F.transform("vec", lambda x: -x).alias("vec"))
    new = v.where("id % 10 >= 5 OR id % 10 = 3").select("id", F.lit(1).alias("at"), "vec")
    return v.where("id % 10 < 5"), new.unionByName(again), v.where("id % 10 = 7").select("id")


@query(f"WITH {c._CB}, {_MOVED}, en AS (SELECT v.id, s, c, row_number() OVER (PARTITION BY v.id, s ORDER BY {c._L2.format(f'v.vec[s * {c._SUB} + 1 : s * {c._SUB} + {c._SUB}]', 'cv')}, c) AS r FROM mv v, cb) SELECT id, array_to_string(list(c::INT ORDER BY s), ' ') AS code FROM en WHERE r = 1 GROUP BY 1")
def q_pq_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Codes after inserts, inserts of stored ids, and deletes."""
    book = c._book(spark, d)
    have, new, gone = _upkeep(spark, d)
    codes = quantize.index_delete(quantize.index_insert(quantize.encode(have, book), new, book, "at"), gone)
    return codes.select("id", F.array_join(F.transform("code", lambda x: x.cast("string")), " ").alias("code"))


@query(f"WITH {_V}, {_MOVED}, ls AS (SELECT id AS list_id, vec AS lv FROM vecs WHERE id < {c.LISTS}), ld AS (SELECT v.id, list_id::INT AS list_id, row_number() OVER (PARTITION BY v.id ORDER BY {c._L2.format('v.vec', 'lv')}, list_id) AS r FROM mv v, ls) SELECT id, list_id, (SELECT count(*) FROM mv) AS n_live FROM ld WHERE r = 1")
def q_ivf_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Lists after the same: an id inserted again moves to its new list."""
    book, lists = c._book(spark, d), c._lists(spark, d)
    have, new, gone = _upkeep(spark, d)
    index = written(quantize.index_delete(quantize.index_insert(quantize.ivf_index(have, book, lists), new, book, "at", lists), gone), "ivf")
    return index.select("id", "list_id").crossJoin(F.broadcast(quantize.index_size(index)))  # with a single row


@query("SELECT vec_id AS id, (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 3 OR vec_id % 10 = 7) AS n_dead FROM embeddings WHERE vec_id % 10 <> 7")
def q_graph_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Living vertices, and the number of dead ones, after the same."""
    have, new, gone = _upkeep(spark, d)
    last = new.groupBy("id").agg(F.max_by("vec", "at").alias("vec"))
    graphs = hnsw.build_graphs(shard.with_shard(have, c.SHARDS), "l2")
    graphs = written(hnsw.delete_from_graphs(hnsw.insert_into_graphs(graphs, shard.with_shard(last, c.SHARDS), "l2"), gone), "graphs")
    return hnsw.graph_ids(graphs).select("id").crossJoin(F.broadcast(hnsw.tombstones(graphs).agg(F.sum("n_dead").alias("n_dead"))))


@query("SELECT true AS better, true AS trained")
def q_pq_training(spark: SparkSession, d: str) -> DataFrame:
    """Whether a trained codebook of the same size is nearer to the vectors than rows taken as one."""
    v = c._vecs(spark, d).select("id", "vec")

    def error(book: quantize.Codebook):
        near = quantize.decode(quantize.encode(v, book), book).select("id", F.col("vec").alias("near"))
        return v.join(near, "id").agg(F.avg(D.l2_squared("vec", "near"))).first()[0]

    trained = quantize.train_codebook(v, c.SUBSPACES, c.CENTROIDS)
    return spark.createDataFrame([(error(trained) < error(c._book(spark, d)), trained.centroids.shape == (c.SUBSPACES, c.CENTROIDS, 64 // c.SUBSPACES))], "better boolean, trained boolean")


# --- logs and shards ------------------------------------------------------------------------------

_OK = f"ok AS (SELECT {_T} AS tenant_id, shard, arg_max(snapshot_seq, run_no) AS s FROM snapshots WHERE lower(trim(status)) = 'ok' GROUP BY 1, 2)"


def _applied(spark: SparkSession, d: str) -> DataFrame:
    return incremental.last_success(table(spark, d, "snapshots")).select("tenant_id", "shard", F.col("done_seq").alias("seq"))


@query(f"WITH {_OK}, l AS (SELECT {_T} AS tenant_id, shard, max(seq) AS last_seq FROM oplog GROUP BY 1, 2) SELECT l.tenant_id, l.shard, coalesce(s, 0) AS applied_seq, last_seq FROM l LEFT JOIN ok ON ok.tenant_id = l.tenant_id AND ok.shard = l.shard WHERE last_seq > coalesce(s, 0)")
def q_lagging(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "oplog").select(tenant_of().alias("tenant_id"), "shard", "seq")
    return lagging(log, _applied(spark, d).withColumnRenamed("seq", "applied_seq"))


@query(
    f"""WITH {_OK}, r AS (SELECT DISTINCT {_T} AS tenant_id, shard, seq FROM oplog), p AS (SELECT r.*, coalesce(s, 0) AS s FROM r LEFT JOIN ok ON ok.tenant_id = r.tenant_id AND ok.shard = r.shard),
 n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, shard ORDER BY seq) AS rn FROM p WHERE seq > s), g AS (SELECT tenant_id, shard, count(*) FILTER (seq = s + rn) AS fine, max(seq) AS top FROM n GROUP BY 1, 2),
 k AS (SELECT DISTINCT tenant_id, shard, s FROM p)
 SELECT k.tenant_id, k.shard, s + coalesce(fine, 0) AS last_seq, CASE WHEN top > s + fine THEN s + fine + 1 END AS next_seq FROM k LEFT JOIN g ON g.tenant_id = k.tenant_id AND g.shard = k.shard"""
)
def q_next_records(spark: SparkSession, d: str) -> DataFrame:
    """How far each log can be applied after its last success, and the record that it lacks next."""
    return next_records(table(spark, d, "oplog"), _applied(spark, d))


@query(f"WITH {c._ring(3, 'a')} SELECT a.shard, coalesce(n, node) AS node FROM a LEFT JOIN (SELECT s_suppkey::INT AS shard, max(s_name) AS n FROM supplier WHERE s_suppkey < 40 GROUP BY 1) l ON l.shard = a.shard WHERE place = 0")
def q_shard_owner(spark: SparkSession, d: str) -> DataFrame:
    """Named leaders of some shards, the ring's owners of the others."""
    leaders = table(spark, d, "supplier").where("s_suppkey < 40").select(F.col("s_suppkey").cast("int").alias("shard"), F.col("s_name").alias("node"))
    return shard.shard_owner(c._shards(spark), leaders, c._nodes(spark, 3))


@query(c.ORACLES["q_knn_join_l2"])
def q_search_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards as tables of their own, merged."""
    v = written(shard.with_shard(c._vecs(spark, d).select("id", "vec"), c.SHARDS), "shards")
    found, failed = search.search_shards(c._queries(spark, d), {k: (lambda k=k: v.where(F.col("shard") == k)) for k in range(c.SHARDS)}, c.K, "l2")
    if failed:
        raise RuntimeError(str(failed))
    return c._rounded(found, "score")


# --- tenants, keys and measures -------------------------------------------------------------------


@query(f"SELECT DISTINCT {_T} AS tenant_id, greatest(1.0, floor(max_qps))::DOUBLE AS burst FROM tenants WHERE max_qps > 0")
def q_burst(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tenants").where("max_qps > 0").select(tenant_of().alias("tenant_id"), tenants.burst(F.col("max_qps")).cast("double").alias("burst")).distinct()


_HASHED = "ks AS (SELECT 'k' || c_custkey AS key_id, sha256('secret-' || c_custkey) AS key_hash FROM customer)"


@query(f"WITH {_HASHED} SELECT key_id FROM ks WHERE key_hash = sha256('secret-17')")
def q_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = c._keys(spark, d).withColumn("key_hash", F.sha2(F.concat(F.lit("secret-"), F.substring("key_id", 2, 20)), 256))
    return tenants.key_lookup(keys, "secret-17").select("key_id")


@query("SELECT 'k' || c_custkey AS key_id, c_custkey % 97 = 0 AS admin FROM customer")
def q_list_keys(spark: SparkSession, d: str) -> DataFrame:
    return tenants.list_keys(c._keys(spark, d).withColumn("created_at", F.col("expires_at"))).select("key_id", "admin")


@query("WITH s AS (SELECT list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL) SELECT v[floor((len(v) - 1) * 0.5)::BIGINT + 1] AS p50, v[floor((len(v) - 1) * 0.99)::BIGINT + 1] AS p99, v[floor((len(v) - 1) * 0.999)::BIGINT + 1] AS p999 FROM s")
def q_percentiles_load(spark: SparkSession, d: str) -> DataFrame:
    """The load generator's rule over the whole table."""
    return metrics.percentiles(table(spark, d, "events"), "value", {"p50": 0.5, "p99": 0.99, "p999": 0.999}, "load")


@query(f"SELECT doc_id, CASE WHEN text IS NULL OR length(trim(text, ' ')) = 0 THEN 'empty' ELSE 'too long' END AS problem FROM documents WHERE text IS NULL OR length(trim(text, ' ')) = 0 OR strlen(text) > {text.MAX_TEXT_BYTES}")
def q_text_problems(spark: SparkSession, d: str) -> DataFrame:
    return text.text_problems(table(spark, d, "documents")).select("doc_id", "problem")


# --- store calls ------------------------------------------------------------------------------------


def _store(spark: SparkSession, d: str) -> Store:
    """A store with the collection's tenants and records, and some of each tenant's updated and deleted."""
    s = Store(spark, shared_dir(spark, "store"), 4)
    for t in range(4):
        s.create_tenant(f"t{t}", 64, "l2", max_vectors=10**9)
    v = c._vecs(spark, d)
    s.batch_upsert(v.select("id", "vec", "metadata", "tenant_id"))
    s.batch_upsert(v.where("id % 8 = 1").select("id", "vec", F.create_map(F.lit("label"), F.lit("new")).alias("metadata"), "tenant_id"))
    s.update_metadata(2, {"label": "updated"}, "t2")
    s.update_metadata(3, None, "t3")
    s.delete(4, "t0")
    s.delete(10**12, "t0")
    return s


_STORED = f"{_V}, stored AS (SELECT id, tenant_id, vec, CASE WHEN id % 8 = 1 THEN 'new' WHEN id = 2 THEN 'updated' WHEN id = 3 THEN NULL ELSE metadata['label'] END AS label FROM vecs WHERE id <> 4)"


@query(f"WITH {_STORED} SELECT id, tenant_id, label, len(vec)::INT AS dim FROM stored")
def q_store_records(spark: SparkSession, d: str) -> DataFrame:
    """Records after inserts, upserts, metadata updates and deletes by the store's calls."""
    s = _store(spark, d)
    s.compact()
    return s.collection().select(F.col("id").cast("bigint").alias("id"), "tenant_id", F.try_element_at("metadata", F.lit("label")).alias("label"), F.size("vec").alias("dim"))


@query(f"WITH {_STORED} SELECT tenant_id, 64 AS dim, 'l2' AS metric, count(*) AS n_vectors FROM stored GROUP BY 1")
def q_store_tenants(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).list_tenants().select("tenant_id", "dim", "metric", "n_vectors")


@query(f"WITH {_STORED}, q AS (SELECT vec AS qv FROM vecs WHERE id = 0) SELECT id, round(score, 6) AS score, label FROM (SELECT id, label, {c._L2.format('qv', 'vec')} AS score FROM stored, q WHERE tenant_id = 't1' AND label = 'new') ORDER BY score, id LIMIT {c.K}")
def q_store_search(spark: SparkSession, d: str) -> DataFrame:
    found = _store(spark, d).search(c._first(spark, d), c.K, "t1", filters={"label": "new"})
    return c._rounded(found.select(F.col("id").cast("bigint").alias("id"), "score", F.try_element_at("metadata", F.lit("label")).alias("label")), "score")


@query(f"WITH {_STORED} SELECT id, (SELECT count(*) FROM stored WHERE tenant_id = 't0') AS n_live FROM stored WHERE tenant_id = 't0' AND id >= 9 ORDER BY id LIMIT 100")
def q_store_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of ids, and the tenant's count."""
    s = _store(spark, d)
    return s.list("t0", 9, 100).select(F.col("id").cast("bigint").alias("id"), F.lit(s.count("t0")).cast("bigint").alias("n_live"))
