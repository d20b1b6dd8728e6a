"""Exact nearest-neighbour search: one query, many queries, and shard by shard.

Results are ordered by (distance, id). A batch of queries is compared block by block in Arrow
batches: the queries are sent to the executors in pieces of bounded size, each batch of vectors
meets a piece in matrix products of bounded size, and each task keeps the k nearest rows of each
query; only these leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quiverlake.functions.distance import METRICS, distance
from quiverlake.functions.filters import Clause, matches
from quiverlake.session import written

MAX_TOP_K = 1000
MAX_EF = 10_000
#: Bytes of query vectors sent to the executors at once, and rows that a task keeps for these at most.
MAX_QUERY_BYTES = 32 << 20
MAX_KEPT_ROWS = 4 << 20
#: Numbers in one product of queries and rows.
TILE_NUMBERS = 4 << 20


def check_top_k(k: int) -> None:
    if not 1 <= k <= MAX_TOP_K:
        raise ValueError(f"top_k must be from 1 to {MAX_TOP_K}")


def search(
    collection: DataFrame,
    query: Sequence[float],
    k: int,
    metric: str = "cosine",
    where: Iterable[Clause] = (),
    tenant: str | None = None,
    candidates: DataFrame | None = None,
    columns: Sequence[str] = ("metadata",),
) -> DataFrame:
    """(id, score, columns...) of the k rows nearest to a query.

    collection: id, vec and the columns asked for. where: metadata clauses. tenant: only this
    tenant's rows. candidates: a table of ids that alone are considered; unknown ids are skipped.
    Rows whose vector has another length than the query, or is null, are skipped.
    """
    check_top_k(k)
    rows = collection
    if tenant is not None:
        rows = rows.where(F.col("tenant_id") == (tenant or "default"))
    clauses = list(where)
    if clauses:
        rows = rows.where(matches(clauses))
    if candidates is not None:
        rows = rows.join(candidates.select("id"), "id", "left_semi")
    q = F.array(*(F.lit(float(np.float32(x))) for x in query)).cast("array<float>")
    rows = rows.where(F.size("vec") == len(query))
    return rows.select("id", distance(metric, "vec", q).alias("score"), *(c for c in columns if c in collection.columns)).orderBy("score", "id").limit(k)


def _scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of float64 rows q and x, computed pair by pair in the order of the components
    only where needed: blocks use a product, whose rounding differs in the last bits."""
    if metric == "dot":
        return -(q @ x.T)
    if metric == "l2":
        return np.maximum(0.0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T)
    nq, nx = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    cos = (q @ x.T) / np.where(nq > 0, nq, 1)[:, None] / np.where(nx > 0, nx, 1)[None]
    return np.where((nq > 0)[:, None] & (nx > 0)[None], 1 - cos, 1.0)


def _exact(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of rows pair by pair."""
    if metric == "l2":
        return ((x - q) ** 2).sum(1)
    dot = (x * q).sum(1)
    if metric == "dot":
        return -dot
    n = np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1))
    return np.where(n > 0, 1 - dot / np.where(n > 0, n, 1), 1.0)


def query_pieces(queries: DataFrame, most: int = MAX_QUERY_BYTES, rows: int = MAX_KEPT_ROWS) -> Iterator[list]:
    """(query_id, vec) rows in pieces of at most about ``most`` bytes and ``rows`` rows, each
    collected by itself."""
    own = queries.where(F.col("vec").isNotNull()).select("query_id", "vec")
    count, total = own.agg(F.count(F.lit(1)), F.sum(F.size("vec").cast("bigint") * 4)).first()
    n = max(1, -(-(total or 0) // most), -(-count // max(1, rows)))
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)
        yield part.collect()


def _sortable(ids: pa.Array) -> np.ndarray:
    """The ids as an array that NumPy sorts as Spark does."""
    if pa.types.is_decimal(ids.type):
        return np.array([int(i) for i in ids.to_pylist()], np.uint64)
    if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type):
        return np.array(ids.to_pylist(), "U")
    return ids.to_numpy(zero_copy_only=False)


class KBest:
    """The k nearest rows so far of each of some queries, by (score, id)."""

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = q, k, metric
        self.query, self.ids, self.score = np.zeros(0, np.int64), None, np.zeros(0)
        self.worst = np.full(len(q), np.inf)  # score of the k-th
        self.room = self._room(q)

    def _room(self, v: np.ndarray) -> np.ndarray:
        """What rounding may add to a product with each row."""
        return np.full(len(v), 1e-12) if self.metric == "cosine" else 1e-12 * (1 + (v * v).sum(1))

    def take(self, x: np.ndarray, ids: np.ndarray) -> None:
        """Compare all queries with rows x."""
        step = max(1, TILE_NUMBERS // max(1, len(x)))
        room = self._room(x)
        found = []
        for at in range(0, len(self.q), step):
            tile = self.q[at : at + step]
            s = _scores(self.metric, tile, x)
            cut = self.worst[at : at + step]
            if len(x) > self.k:
                cut = np.minimum(cut, np.partition(s + room, self.k - 1, axis=1)[:, self.k - 1])
            i, j = np.nonzero(s - room <= (cut + 2 * self.room[at : at + step])[:, None])
            score = np.zeros(len(i))
            for a in range(0, len(i), 1 << 16):
                part = slice(a, a + (1 << 16))
                score[part] = _exact(self.metric, tile[i[part]], x[j[part]])
            keep, _ = _k_first(at + i, ids[j], score, self.k)
            found.append((at + i[keep], j[keep], score[keep]))
        query, rows, score = (np.concatenate(c) for c in zip(*found))
        new = ids[rows]
        if self.ids is not None:
            query, new, score = np.concatenate([self.query, query]), np.concatenate([self.ids, new]), np.concatenate([self.score, score])
        keep, last = _k_first(query, new, score, self.k)
        self.worst[query[last]] = score[last]
        self.query, self.ids, self.score = query[keep], new[keep], score[keep]


def _k_first(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k first of each query by (score, id), and of the k-th ones."""
    order = np.lexsort((ids, score, query))
    starts = np.flatnonzero(np.diff(query[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[place < k], order[place == k - 1]


def knn_join(queries: DataFrame, collection: DataFrame, k: int, metric: str = "cosine", by: str | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k rows of the collection nearest to each query.

    queries: query_id, vec; collection: id, vec, and ``by`` if given: results are then cut to k
    for each query and value of ``by`` (a shard, say), which is put out too. Of rows at equal distance
    those with the smallest ids count, however many there are. Pairs of vectors of different length
    are left out; null ids and vectors have no part. Empty tables give no rows.
    """
    check_top_k(k)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    spark = collection.sparkSession
    group = [by] if by else []
    rows = collection.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select("id", "vec", *group)
    qtype = queries.schema["query_id"].dataType
    fields = [T.StructField("query_id", qtype), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType()), *(rows.schema[c] for c in group)]
    out = None
    for piece in query_pieces(queries, rows=MAX_KEPT_ROWS // k):
        shared = spark.sparkContext.broadcast([(r[0], np.array(r[1], np.float32)) for r in piece])  # within MAX_QUERY_BYTES

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by_dim: dict[int, tuple[list, list]] = {}
            for qid, v in shared.value:
                names, vs = by_dim.setdefault(len(v), ([], []))
                names.append(qid)
                vs.append(v)
            dims = {dim: (names, np.array(vs, np.float64).reshape(len(vs), dim)) for dim, (names, vs) in by_dim.items() if dim}
            best: dict[tuple, KBest] = {}
            for b in batches:
                sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
                groups = np.array(b.column(2).to_pylist(), object) if by else None
                for dim, (_, q) in dims.items():
                    at = np.flatnonzero(sizes == dim)
                    for g in sorted(set(groups[at]), key=repr) if by else [None] * bool(len(at)):
                        own = at[groups[at] == g] if by else at
                        x = b.column(1).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                        best.setdefault((dim, g), KBest(q, k, metric)).take(x, _sortable(b.column(0).take(pa.array(own))))
            for (dim, g), found in best.items():
                names = dims[dim][0]
                for a in range(0, len(found.query), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    cols = [pa.array([names[i] for i in found.query[part]], to_arrow_type(qtype)), _as_ids(found.ids[part], to_arrow_type(fields[1].dataType)), pa.array(found.score[part])]
                    if by:
                        cols.append(pa.array([g] * len(cols[0]), to_arrow_type(fields[3].dataType)))
                    yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

        near = rows.mapInArrow(run, T.StructType(fields))
        out = near if out is None else out.unionByName(near)
    w = Window.partitionBy("query_id", *group).orderBy("score", "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", *group, "rank", "id", "score")


def _as_ids(ids: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array([Decimal(int(i)) for i in ids] if pa.types.is_decimal(kind) else ids, kind)


def scatter_gather(queries: DataFrame, collection: DataFrame, k: int, metric: str, shard: str) -> DataFrame:
    """(query_id, rank, id, score): each shard's k nearest, merged and cut to k.

    An id that several shards hold counts once, with its lowest score.
    """
    local = knn_join(queries, collection, k, metric, by=shard)
    once = local.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


class ShardsFailed(RuntimeError):
    """No shard could be searched; ``failed`` has the error of each."""

    def __init__(self, failed: dict):
        super().__init__("; ".join(f"shard {k}: {v}" for k, v in failed.items()))
        self.failed = failed


#: How often a shard is searched before it counts as failed.
SEARCH_ATTEMPTS = 2


def search_shards(queries: DataFrame, shards: Mapping[object, Callable[[], DataFrame]], k: int, metric: str) -> tuple[DataFrame, dict]:
    """((query_id, rank, id, score), failed): the merged results of shards that are tables of their own,
    each opened by a function, and the errors of those that could not be read after SEARCH_ATTEMPTS
    attempts, whose results are missing. Without any shard left ShardsFailed is raised.
    """
    parts, failed = [], {}
    for name, shard in shards.items():
        for attempt in range(1, SEARCH_ATTEMPTS + 1):
            try:
                parts.append(written(knn_join(queries, shard(), k, metric).select("query_id", "id", "score"), "shard"))
                break
            except Exception as e:  # whatever a source may raise
                if attempt == SEARCH_ATTEMPTS:
                    failed[name] = e
    if not parts:
        raise ShardsFailed(failed)
    once = reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score"), failed


def top_k_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; the limit is applied before the shuffle too."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Bytes of vectors that the SQL table function may hold.
MAX_FUNCTION_BYTES = 256 << 20


def register_knn(spark: SparkSession, collection: DataFrame, metric: str = "cosine", name: str = "knn") -> None:
    """Make ``SELECT q.id, n.* FROM queries q, LATERAL knn(q.vec, 10) n`` available in SQL: a table
    function that gives (id, score, rank) of the nearest rows of a small collection.

    The collection is broadcast, so one over MAX_FUNCTION_BYTES is refused; knn_join takes any size.
    """
    rows = collection.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select(F.col("id").cast("bigint").alias("id"), "vec")
    size = rows.agg(F.sum(F.size("vec").cast("bigint") * 4)).first()[0] or 0
    if size > MAX_FUNCTION_BYTES:
        raise ValueError("the collection is too large for a table function; use knn_join")
    held: dict[int, tuple[list, list]] = {}
    for r in rows.orderBy("id").toLocalIterator():
        ids, vecs = held.setdefault(len(r["vec"]), ([], []))
        ids.append(r["id"])
        vecs.append(r["vec"])
    shared = spark.sparkContext.broadcast({n: (np.array(i, np.int64), np.array(v, np.float64).reshape(len(i), n)) for n, (i, v) in held.items()})

    @F.udtf(returnType="id bigint, score double, rank int")
    class Nearest:
        def eval(self, query, k):
            if query is None or len(query) not in shared.value:
                return
            ids, x = shared.value[len(query)]
            score = _exact(metric, np.array(query, np.float64)[None], x)
            for rank, i in enumerate(np.lexsort((ids, score))[:k], 1):
                yield int(ids[i]), float(score[i]), rank

    spark.udtf.register(name, Nearest)
