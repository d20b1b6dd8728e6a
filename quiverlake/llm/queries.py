"""Queries of the language-model problems, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.llm import bpe, clusters, leaks, mih, residue, subset
from quiverlake.session import table

Query = Callable[[SparkSession, str], DataFrame]
MIN_RECALL = 0.9


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mih.mutual_pairs(mih.near_pairs(table(spark, d, "vectors"), table(spark, d, "tenants")))


def p2_similar(spark: SparkSession, d: str) -> DataFrame:
    return mih.similar_vectors(table(spark, d, "vectors"), table(spark, d, "tenants"))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """(n_queries, n_true, recall_ok): queries of p2_similar, their true neighbours by brute force, and
    whether at least MIN_RECALL of these were found."""
    key = ["tenant_id", "id", "near_id"]
    true = mih.exact_similar(table(spark, d, "vectors"), table(spark, d, "tenants")).select(*key)
    found = p2_similar(spark, d).select(*key, F.lit(1).alias("q_hit"))
    counts = true.join(found, key, "left").groupBy("tenant_id", "id").agg(F.count(F.lit(1)).alias("n"), F.count("q_hit").alias("hits"))
    hits = F.coalesce(F.sum("hits"), F.lit(0))
    return counts.agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_true"), (hits >= MIN_RECALL * F.coalesce(F.sum("n"), F.lit(0))).alias("recall_ok"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.mutual_clusters(table(spark, d, "vectors"), table(spark, d, "tenants")).select("tenant_id", "head_id", "id")


def p4_described(spark: SparkSession, d: str) -> DataFrame:
    members = clusters.mutual_clusters(table(spark, d, "vectors"), table(spark, d, "tenants"), with_vec=True)
    return clusters.cluster_descriptions(members).withColumn("typical_ids", F.array_join("typical_ids", ","))


def p5_subset(spark: SparkSession, d: str) -> DataFrame:
    return subset.varied_subset(table(spark, d, "vectors"), table(spark, d, "tenants"))


def _byte_bpe() -> tuple[str, str]:
    """Place and pattern of the public vocabulary; raises ImportError without it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), *_byte_bpe())


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts after encoding and decoding."""
    path, pattern = _byte_bpe()
    return bpe.decode_ids(bpe.encode_texts(table(spark, d, "documents"), path, pattern), path)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return leaks.without_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents"))


def p10_validation(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the classifiers on hosts held out from training, against the weak labels, and on
    phrases that another training's labels did not name."""
    docs = table(spark, d, "documents")
    scores = residue.train(docs).held_out | residue.unseen_phrases(docs)
    return spark.createDataFrame(sorted(scores.items()), "measure string, value double")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_similar, p2_recall, p4_found, p4_described, p5_subset, p8_ids, p8_decoded, p9_found, p9_clean, p10_found, p10_validation)}

_T = "coalesce(nullif(tenant_id,''),'default')"
# Compatibility forms that SQL has no function for: full-width letters by rule, and some single signs.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_PLAIN = f"replace(replace(replace(replace(translate(lower(text), lower('{_WIDE[0]}'), lower('{_WIDE[1]}')), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ß', 'ss')"
_WORDS = rf"regexp_extract_all(lower(regexp_replace(nfc_normalize({_PLAIN}), '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]', '', 'g')), '[\p{{L}}\p{{N}}]+')"
_CURRENT = f"""
usable AS (
  SELECT {_T.replace('tenant_id', 'v.tenant_id')} AS t, id, vec::DOUBLE[] AS v, received_at FROM vectors v
  JOIN (SELECT {_T} AS dt, max(dim) AS dim FROM tenants GROUP BY 1) ON dt = {_T.replace('tenant_id', 'v.tenant_id')}
  WHERE len(vec) = dim AND list_count(vec) = dim AND isfinite(list_sum(list_transform(vec::DOUBLE[], lambda x: x * x))) AND list_sum(list_transform(vec::DOUBLE[], lambda x: x * x)) > 0),
cur AS (SELECT t, id, arg_max(v, received_at) AS v FROM usable GROUP BY 1, 2)"""

_CLUSTERS = f"""{_CURRENT},
 u AS (SELECT t, id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM cur),
 near AS (SELECT a.t, a.id, b.id AS o FROM u a JOIN u b ON a.t = b.t AND 1 - list_inner_product(a.v, b.v) <= 0.55),
 sets AS (SELECT t, id, list(o ORDER BY o) AS s FROM near GROUP BY 1, 2),
 whole AS (SELECT t, s FROM sets GROUP BY 1, 2 HAVING count(*) = len(s) AND len(s) >= 3)"""

ORACLES: dict[str, str] = {
    "p2_found": f"""WITH {_CURRENT},
 u AS (SELECT t, id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM cur),
 near AS (SELECT a.t, a.id, arg_min(b.id, struct_pack(d := round(1 - list_inner_product(a.v, b.v), 12), i := b.id)) AS n, min(1 - list_inner_product(a.v, b.v)) AS d
   FROM u a JOIN u b ON a.t = b.t AND a.id <> b.id GROUP BY 1, 2)
 SELECT a.t AS tenant_id, a.id AS id_a, b.id AS id_b FROM near a JOIN near b ON a.t = b.t AND a.n = b.id AND b.n = a.id AND a.id < b.id WHERE a.d <= 0.01""",
    "p2_recall": f"""WITH {_CURRENT}, n AS (SELECT t, count(*) AS n, count(*) FILTER (id % 20 = 0) AS q FROM cur GROUP BY 1 HAVING count(*) > 1)
 SELECT coalesce(sum(q), 0)::BIGINT AS n_queries, coalesce(sum(q * least(10, n - 1)), 0)::BIGINT AS n_true, true AS recall_ok FROM n""",
    "p4_found": f"""WITH {_CLUSTERS} SELECT t AS tenant_id, s[1] AS head_id, unnest(s) AS id FROM whole""",
    "p4_described": f"""WITH {_CLUSTERS}, m AS (SELECT t, head, w.id, n, v FROM (SELECT t, s[1] AS head, len(s) AS n, unnest(s) AS id FROM whole) w JOIN u USING (t, id)),
 c AS (SELECT t, head, list(x ORDER BY i) AS c FROM (SELECT t, head, i, sum(v[i]) AS x FROM (SELECT t, head, v, unnest(range(1, len(v) + 1)) AS i FROM m) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 r AS (SELECT m.t, m.head, id, n, round(1 - list_inner_product(v, c.c) / sqrt(list_inner_product(c.c, c.c)), 9) AS far FROM m JOIN c ON c.t = m.t AND c.head = m.head),
 k AS (SELECT *, row_number() OVER (PARTITION BY t, head ORDER BY far, id) AS place FROM r)
 SELECT t AS tenant_id, head AS head_id, max(n)::BIGINT AS size, string_agg(id::VARCHAR, ',' ORDER BY place) AS typical_ids FROM k WHERE place <= 5 GROUP BY 1, 2""",
    "p9_found": f"""WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL), dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
 ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM iw)),
 dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM dw))
 SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
