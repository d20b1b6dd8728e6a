"""Queries of the general training-data problems 1, 3, 6 and 7."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.functions.tenants import tenant_of
from quiverlake.operators.attributes import attributes_to_wide, key_list, unreadable_cells
from quiverlake.operators.change_runs import ChangeRuns, buckets_for, changes_of, metadata_map
from quiverlake.operators.incremental import Ledger, covered_records, due_records, last_success
from quiverlake.operators.key_profiles import heavy_keys, per_key
from quiverlake.session import shared_dir, shuffle_partitions, table, written

Query = Callable[[SparkSession, str], DataFrame]

HEAVY_SHARE = 0.05
#: Runs into which a replayed log is cut by arrival.
REPLAY_RUNS = 4


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return attributes_to_wide(table(spark, d, "attrs"), key_list(table(spark, d, "filter_keys")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return unreadable_cells(_wide(spark, d))


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).withColumn("unreadable_keys", F.array_join("unreadable_keys", ","))


def _replayed(spark: SparkSession, d: str, query: str) -> ChangeRuns:
    """The log appended in order of arrival, as REPLAY_RUNS runs, with a compaction on the way."""
    log = table(spark, d, "oplog")
    at = F.unix_micros("arrived_at")
    low, high, n = log.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    low, high = low or 0, high or 0
    store = ChangeRuns(spark, shared_dir(spark, query), buckets_for(n, shuffle_partitions(spark)), max_runs=REPLAY_RUNS - 1)
    slot = F.coalesce(F.least(F.floor((at - low) * REPLAY_RUNS / max(1, high - low)), F.lit(REPLAY_RUNS - 1)), F.lit(REPLAY_RUNS - 1))
    for k in range(REPLAY_RUNS):
        store.append(changes_of(log.where(slot == k)))
    return store


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d, "p3_found").state([]).select("tenant_id", "id", "vec_seq", "meta_seq")


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    """The stored ids with the size and sum of their vector and their sorted metadata."""
    state = _replayed(spark, d, "p3_state").state()
    meta = F.map_entries(metadata_map())
    return state.select(
        "tenant_id",
        "id",
        "vec_seq",
        "meta_seq",
        F.size("vec").alias("dim"),
        F.coalesce(F.array_join(F.array_sort(F.transform(meta, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ";"), F.lit("")).alias("metadata"),
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "vectors"), tenant_of(), HEAVY_SHARE).select("tenant_id")


def p6_vectors(spark: SparkSession, d: str) -> DataFrame:
    aggregates = {"n_vec": F.count("vec"), "min_id": F.min("id"), "max_id": F.max("id"), "last_at": F.max(F.unix_micros("received_at")), "n_meta": F.count_if(F.size("metadata") > 0), "dims": F.sum(F.coalesce(F.size("vec"), F.lit(0)).cast("bigint"))}
    return per_key(table(spark, d, "vectors"), tenant_of(), aggregates)


def p6_attrs(spark: SparkSession, d: str) -> DataFrame:
    aggregates = {"n_values": F.count("attr_value"), "max_seq": F.max("set_seq"), "n_chars": F.sum(F.length("attr_value").cast("bigint"))}
    return per_key(table(spark, d, "attrs"), tenant_of(), aggregates)


def p6_oplog(spark: SparkSession, d: str) -> DataFrame:
    op = F.col("op")
    aggregates = {"n_insert": F.count_if(op == 1), "n_delete": F.count_if(op == 2), "n_meta": F.count_if(op == 3), "max_seq": F.max("seq")}
    return per_key(table(spark, d, "oplog"), tenant_of(), aggregates)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The ledger holds what the runs of snapshots covered of the range that is reread."""
    log, runs = table(spark, d, "oplog"), table(spark, d, "snapshots")
    at = written(last_success(runs), "p7-positions")
    ledger = Ledger(spark, shared_dir(spark, "p7-ledger"))
    ledger.commit(0, covered_records(log, at))
    return due_records(log, runs, ledger.pairs(), at)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_wide, p3_found, p3_state, p6_found, p6_vectors, p6_attrs, p6_oplog, p7_found)
}

_T = "coalesce(nullif(tenant_id,''),'default')"
_CELLS = rf"""
cells AS (
  SELECT {_T} AS tenant_id, id, f.filter_key, f.kind, regexp_replace(arg_max(coalesce(attr_value, chr(1)), set_seq), '^\s+|\s+$', '', 'g') AS v
  FROM attrs JOIN (SELECT DISTINCT filter_key, kind FROM filter_keys) f
    ON replace(lower(regexp_replace(attr_key, '^\s+|\s+$', '', 'g')), '-', '_') = f.filter_key
  GROUP BY 1, 2, 3, 4),
typed AS (
  SELECT *,
    CASE WHEN kind = 'number' AND regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
         AND isfinite(try_cast(v AS DOUBLE)) THEN try_cast(v AS DOUBLE) END AS num,
    CASE WHEN kind = 'int' AND regexp_full_match(v, '[+-]?[0-9]+') THEN try_cast(v AS BIGINT) END AS whole,
    CASE WHEN kind = 'flag' THEN CASE WHEN lower(v) IN ('true','yes','1') THEN true WHEN lower(v) IN ('false','no','0') THEN false END END AS flag,
    CASE WHEN kind = 'day' THEN CASE WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(v AS DATE)
         WHEN regexp_full_match(v, '[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}') THEN try_cast(v[7:10] || '-' || v[4:5] || '-' || v[1:2] AS DATE) END END AS day,
    CASE WHEN kind = 'text' AND v NOT IN ('', chr(1)) THEN v END AS txt
  FROM cells),
bad AS (
  SELECT tenant_id, id, filter_key FROM typed
  WHERE v <> chr(1) AND num IS NULL AND whole IS NULL AND flag IS NULL AND day IS NULL AND txt IS NULL)"""
#: The test tables' filter keys and their typed columns.
_WIDE = {
    "added_on": "day", "build_no": "whole", "color": "txt", "expires_on": "day", "in_stock": "flag", "is_public": "flag", "item_code": "txt",
    "page_count": "whole", "price": "num", "rating": "num", "stock": "whole", "team": "txt", "tier": "txt", "weight_kg": "num",
}
_LAST = f"""
ok AS (SELECT {_T} AS tenant_id, shard, arg_max(snapshot_seq, run_no) AS s FROM snapshots WHERE lower(trim(status)) = 'ok' GROUP BY 1, 2)"""
_FOLD = f"""
ops AS (SELECT {_T} AS tenant_id, id, seq, op, vec, extra FROM oplog),
st AS (
  SELECT tenant_id, id, max(seq) FILTER (op = 1) AS vec_seq, max(seq) FILTER (op = 2) AS del_seq, max(seq) FILTER (op IN (1, 3)) AS meta_seq
  FROM ops GROUP BY 1, 2),
live AS (SELECT * FROM st WHERE vec_seq IS NOT NULL AND (del_seq IS NULL OR vec_seq > del_seq))"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_CELLS} SELECT * FROM bad",
    "p1_wide": f"WITH {_CELLS} SELECT tenant_id, id, "
    + ", ".join(f"any_value({c}) FILTER (filter_key = '{k}') AS {k}" for k, c in _WIDE.items())
    + ", coalesce((SELECT string_agg(b.filter_key, ',' ORDER BY b.filter_key) FROM bad b WHERE b.tenant_id = t.tenant_id AND b.id = t.id), '') AS unreadable_keys"
    + " FROM typed t GROUP BY tenant_id, id",
    "p3_found": f"WITH {_FOLD} SELECT tenant_id, id, vec_seq, meta_seq FROM live",
    "p3_state": f"""WITH {_FOLD},
 vecs AS (SELECT tenant_id, id, seq, any_value(len(vec)) AS dim FROM ops WHERE op = 1 GROUP BY 1, 2, 3),
 metas AS (SELECT tenant_id, id, seq, any_value(coalesce(nullif(extra, ''), '{{}}')) AS e FROM ops WHERE op IN (1, 3) GROUP BY 1, 2, 3),
 kv AS (SELECT tenant_id, id, seq, string_agg(k || '=' || coalesce(json_extract_string(e, '$."' || k || '"'), ''), ';' ORDER BY k || '=' || coalesce(json_extract_string(e, '$."' || k || '"'), '')) AS metadata
   FROM (SELECT *, unnest(json_keys(e)) AS k FROM metas) GROUP BY 1, 2, 3)
 SELECT l.tenant_id, l.id, vec_seq, meta_seq, coalesce(v.dim, -1)::INT AS dim, coalesce(kv.metadata, '') AS metadata
 FROM live l JOIN vecs v ON v.tenant_id = l.tenant_id AND v.id = l.id AND v.seq = l.vec_seq
 LEFT JOIN kv ON kv.tenant_id = l.tenant_id AND kv.id = l.id AND kv.seq = l.meta_seq""",
    "p6_found": f"SELECT {_T} AS tenant_id FROM vectors GROUP BY 1 HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM vectors)",
    "p6_vectors": f"""SELECT {_T} AS tenant_id, count(*) AS n_rows, count(vec) AS n_vec, min(id) AS min_id, max(id) AS max_id, epoch_us(max(received_at)) AS last_at,
 count(*) FILTER (cardinality(metadata) > 0) AS n_meta, sum(coalesce(len(vec), 0))::BIGINT AS dims FROM vectors GROUP BY 1""",
    "p6_attrs": f"SELECT {_T} AS tenant_id, count(*) AS n_rows, count(attr_value) AS n_values, max(set_seq) AS max_seq, sum(length(attr_value))::BIGINT AS n_chars FROM attrs GROUP BY 1",
    "p6_oplog": f"""SELECT {_T} AS tenant_id, count(*) AS n_rows, count(*) FILTER (op = 1) AS n_insert, count(*) FILTER (op = 2) AS n_delete,
 count(*) FILTER (op = 3) AS n_meta, max(seq) AS max_seq FROM oplog GROUP BY 1""",
    "p7_found": f"""WITH {_LAST},
 rec AS (SELECT DISTINCT {_T} AS tenant_id, shard, seq FROM oplog),
 due AS (SELECT r.*, coalesce(s, 0) AS s, row_number() OVER (PARTITION BY r.tenant_id, r.shard ORDER BY seq) AS rn
   FROM rec r LEFT JOIN ok ON ok.tenant_id = r.tenant_id AND ok.shard = r.shard WHERE seq > coalesce(s, 0))
 SELECT tenant_id, shard, seq FROM due WHERE seq = s + rn""",
}
