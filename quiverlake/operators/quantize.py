"""Product quantisation and inverted lists.

Codebooks are small tables on the driver (at most 256 centroids a subspace), so encoding,
distance tables and probing are NumPy on Arrow batches with the codebook broadcast; nothing is
shuffled but the k best rows of each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quiverlake.functions.distance import l2_squared
from quiverlake.operators import records
from quiverlake.operators.sampling import hashed_sample
from quiverlake.operators.search import check_top_k, query_pieces

MAX_CENTROIDS = 256
#: Rows of the sample on which codebooks and lists are trained.
SAMPLE_ROWS = 20_000
TRAIN_ROUNDS = 25
#: Centroids that one step takes at most.
STEP_CENTROIDS = 65_536


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared L2 of rows and centroids, component by component."""
    out = np.zeros((len(x), len(c)))
    for k in range(x.shape[1]):
        d = x[:, k, None] - c[None, :, k]
        out += d * d
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = TRAIN_ROUNDS, seed: int = 1) -> np.ndarray:
    """Lloyd's algorithm from D2-sampled rows; an empty cluster keeps its centroid, and it stops
    when no row changes its cluster."""
    if not 1 <= k <= len(x):
        raise ValueError("k must be from 1 to the number of rows")
    rng = np.random.default_rng(seed)
    x = np.asarray(x, np.float64)
    c = np.empty((k, x.shape[1]))
    c[0] = x[rng.integers(len(x))]
    least = _squared(x, c[:1])[:, 0]
    for i in range(1, k):
        total = least.sum()
        c[i] = x[rng.choice(len(x), p=least / total) if total > 0 else rng.integers(len(x))]
        least = np.minimum(least, _squared(x, c[i : i + 1])[:, 0])
    own = None
    for _ in range(rounds):
        new = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]).argmin(1)
        if own is not None and (new == own).all():
            break
        own = new
        n = np.bincount(own, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def kmeans_step(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(centroid, n, v): one round of Lloyd's algorithm. points: id, vec; centroids: centroid, v.

    Each row goes to its nearest centroid (ties to the smallest number) and sums are combined before
    the shuffle; an empty cluster keeps its centroid. The centroids are broadcast; a codebook or
    list table has at most some thousands. More than STEP_CENTROIDS raise an error.
    """
    held = sorted((r["centroid"], list(r["v"])) for r in centroids.select("centroid", "v").limit(STEP_CENTROIDS + 1).collect())
    if len(held) > STEP_CENTROIDS:
        raise ValueError(f"at most {STEP_CENTROIDS} centroids")
    names = [c for c, _ in held]
    shared = points.sparkSession.sparkContext.broadcast(np.array([v for _, v in held], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n, s = np.zeros(len(c), np.int64), np.zeros_like(c)
        for b in batches:
            x = _rows(b.column(0), c.shape[1])
            own = _squared(x, c).argmin(1)
            n += np.bincount(own, minlength=len(c))
            np.add.at(s, own, x)
        offsets = pa.array(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(s.ravel()))], names=["centroid", "n", "s"])

    dim = shared.value.shape[1]
    parts = points.where(F.size("vec") == dim).select("vec").mapInArrow(run, "centroid bigint, n bigint, s array<double>")
    sums = parts.groupBy("centroid").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(dim)))
    mean = F.array(*(F.col(f"s{k}") / F.col("n") for k in range(dim)))
    old = centroids.select(F.col("centroid").cast("bigint").alias("centroid"), F.col("v").cast("array<double>").alias("q_old"))
    return old.join(sums, "centroid", "left").select("centroid", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.when(F.col("n") > 0, mean).otherwise(F.col("q_old")).alias("v"))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


@dataclass
class Codebook:
    """centroids: subspaces x centroids x components."""

    centroids: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[0] * self.centroids.shape[2]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Nearest centroid in each subspace, ties to the first."""
        m, _, sub = self.centroids.shape
        return np.stack([_squared(x[:, i * sub : (i + 1) * sub], self.centroids[i]).argmin(1) for i in range(m)], axis=1).astype(np.int16)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.centroids[i][codes[:, i]] for i in range(len(self.centroids))], axis=1)

    def table(self, q: np.ndarray) -> np.ndarray:
        """Squared L2 of a query's parts to the centroids: subspaces x centroids."""
        m, _, sub = self.centroids.shape
        return np.stack([_squared(q[None, i * sub : (i + 1) * sub], self.centroids[i])[0] for i in range(m)])


def train_codebook(vectors: DataFrame, subspaces: int, centroids: int, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> Codebook:
    """A codebook from the sample_rows rows of ``vec`` with the smallest hashes; all vectors must
    have the length of the first, a multiple of subspaces."""
    if not 1 <= centroids <= MAX_CENTROIDS:
        raise ValueError(f"centroids must be from 1 to {MAX_CENTROIDS}")
    x = sample(vectors, sample_rows)
    if x.shape[1] % subspaces:
        raise ValueError("subspaces must divide the dimension")
    sub = x.shape[1] // subspaces
    return Codebook(np.stack([kmeans(x[:, i * sub : (i + 1) * sub], centroids, seed=seed + i) for i in range(subspaces)]))


def sample(vectors: DataFrame, rows: int) -> np.ndarray:
    picked = hashed_sample(vectors.where(F.col("vec").isNotNull()).select("id", "vec"), rows).select("vec").toArrow()
    return np.array(picked.column(0).to_pylist(), np.float64)


def codebook_of(rows: DataFrame, subspaces: int, by: str = "id") -> Codebook:
    """A codebook whose centroids are the parts of the given rows (at most 256), in order of ``by``."""
    held = rows.orderBy(by).limit(MAX_CENTROIDS).select("vec").collect()
    x = np.array([r[0] for r in held], np.float64)
    return Codebook(x.reshape(len(x), subspaces, -1).transpose(1, 0, 2))


def encode(vectors: DataFrame, book: Codebook) -> DataFrame:
    """(id, code): the code of each vector of the codebook's length; others and nulls are left out."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = shared.value.encode(_rows(b.column(1), shared.value.dim))
            offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], names=["id", "code"])

    return vectors.where(F.size("vec") == book.dim).select("id", "vec").mapInArrow(run, T.StructType([vectors.schema["id"], T.StructField("code", T.ArrayType(T.ShortType()))]))


def decode(codes: DataFrame, book: Codebook) -> DataFrame:
    """(id, vec) of codes; null for codes of the wrong length or with unknown centroids."""
    m, k, _ = book.centroids.shape
    shared = codes.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column(1)
            at = np.flatnonzero(code.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == m)
            flat = code.take(pa.array(at)).flatten()
            c = flat.fill_null(-1).to_numpy(zero_copy_only=False).reshape(-1, m)
            good = ((c >= 0) & (c < k)).all(1)
            x = shared.value.decode(c[good])
            sizes = np.zeros(b.num_rows, np.int64)
            sizes[at[good]] = x.shape[1]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.concatenate([sizes == 0, [False]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.float64()))], names=["id", "vec"])

    return codes.select("id", "code").mapInArrow(run, T.StructType([codes.schema["id"], T.StructField("vec", T.ArrayType(T.DoubleType()))]))


def distance_tables(queries: DataFrame, book: Codebook) -> DataFrame:
    """(query_id, subspace, centroid, dist) for every query."""
    shared = queries.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, k, _ = shared.value.centroids.shape
        for b in batches:
            t = [shared.value.table(q) for q in _rows(b.column(1), shared.value.dim)]
            at = np.repeat(np.arange(b.num_rows), m * k)
            part = np.tile(np.repeat(np.arange(m, dtype=np.int32), k), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(part), pa.array(np.tile(np.arange(k, dtype=np.int32), m * b.num_rows)), pa.array(np.concatenate([x.ravel() for x in t]) if t else np.zeros(0))], names=["query_id", "subspace", "centroid", "dist"])

    fields = [queries.schema["query_id"], T.StructField("subspace", T.IntegerType()), T.StructField("centroid", T.IntegerType()), T.StructField("dist", T.DoubleType())]
    return queries.where(F.size("vec") == book.dim).select("query_id", "vec").mapInArrow(run, T.StructType(fields))


def code_search(queries: DataFrame, codes: DataFrame, book: Codebook, k: int, lists: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """(query_id, rank, id, score): the k codes nearest to each query by table distance, that is by
    squared L2 to the decoded vector. codes: id, code, and list_id if ``lists`` (the lists' centres)
    are given: then only codes in the query's ``probes`` nearest lists are considered.

    Malformed codes are at infinite distance and left out. k below 1 gives no rows.
    """
    m, n, _ = book.centroids.shape
    spark = codes.sparkSession
    columns = ["id", "code", *(["list_id"] if lists is not None else [])]
    fields = [queries.schema["query_id"], codes.schema["id"], T.StructField("score", T.DoubleType())]
    good = codes.where((F.size("code") == m) & ~F.exists("code", lambda c: c.isNull() | (c < 0) | (c >= n))).select(*columns)
    if k < 1:
        return spark.createDataFrame([], T.StructType(fields)).withColumn("rank", F.lit(1)).select("query_id", "rank", "id", "score")
    out = None
    for piece in query_pieces(queries.where(F.size("vec") == book.dim)):
        qs = []
        for qid, v in piece:
            q = np.array(v, np.float64)
            near = None if lists is None else nearest_lists(q[None], lists, probes)[0]
            qs.append((qid, book.table(q), near))
        shared = spark.sparkContext.broadcast(qs)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                c = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
                own = b.column(2).to_numpy(zero_copy_only=False) if lists is not None else None
                for qid, t, near in shared.value:
                    at = np.arange(len(c)) if near is None else np.flatnonzero(np.isin(own, near))
                    if not len(at):
                        continue
                    s = np.zeros(len(at))
                    for i in range(m):
                        s += t[i][c[at, i]]
                    few = _first(s, k)
                    yield pa.RecordBatch.from_arrays([pa.array([qid] * len(few), to_arrow_type(fields[0].dataType)), b.column(0).take(pa.array(at[few])), pa.array(s[few])], names=["query_id", "id", "score"])

        # Only the lists that a query of this piece probes are read; see write_index.
        probed = None if lists is None else sorted({int(i) for _, _, near in qs for i in near})
        part = (good if probed is None else good.where(F.col("list_id").isin(probed))).mapInArrow(run, T.StructType(fields))
        out = part if out is None else out.unionByName(part)
    return _ranked(out, k)


def _first(s: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest, and of all that equal the last of them."""
    return np.arange(len(s)) if len(s) <= k else np.flatnonzero(s <= np.partition(s, k - 1)[k - 1])


def _ranked(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def rerank(found: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): found candidates ordered by their exact squared L2 and cut to k.
    Candidates without a vector, or with one of another length, are left out."""
    c = found.select("query_id", "id").join(vectors.select("id", "vec"), "id").join(queries.select("query_id", F.col("vec").alias("q_vec")), "query_id")
    scored = c.select("query_id", "id", l2_squared("q_vec", "vec").alias("score"))
    return _ranked(scored.where(~F.isnan("score") & (F.col("score") < float("inf"))), k)


def code_search_reranked(queries: DataFrame, codes: DataFrame, vectors: DataFrame, book: Codebook, k: int, candidates: int, lists: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """The best max(candidates, k) codes of each query, reranked exactly."""
    check_top_k(k)
    return rerank(code_search(queries, codes, book, max(candidates, k), lists, probes), queries, vectors, k)


def train_lists(vectors: DataFrame, n: int, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> np.ndarray:
    """Centres of n inverted lists."""
    return kmeans(sample(vectors, sample_rows), n, TRAIN_ROUNDS, seed)


def nearest_lists(q: np.ndarray, lists: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of the nearest lists of each row, nearest first, ties by number."""
    return np.argsort(_squared(q, lists), axis=1, kind="stable")[:, : max(0, probes)]


def assign_lists(vectors: DataFrame, lists: np.ndarray) -> DataFrame:
    """(id, list_id): the nearest list of each vector; ties go to the smaller number."""
    shared = vectors.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _squared(_rows(b.column(1), lists.shape[1]), shared.value).argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own)], names=["id", "list_id"])

    return vectors.where(F.size("vec") == lists.shape[1]).select("id", "vec").mapInArrow(run, T.StructType([vectors.schema["id"], T.StructField("list_id", T.IntegerType())]))


def probed_lists(queries: DataFrame, lists: np.ndarray, probes: int) -> DataFrame:
    """(query_id, place, list_id): the lists in which each query looks, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = nearest_lists(_rows(b.column(1), lists.shape[1]), lists, probes)
            at = np.repeat(np.arange(b.num_rows), near.shape[1])
            place = np.tile(np.arange(near.shape[1], dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(place), pa.array(near.ravel().astype(np.int32))], names=["query_id", "place", "list_id"])

    fields = [queries.schema["query_id"], T.StructField("place", T.IntegerType()), T.StructField("list_id", T.IntegerType())]
    return queries.where(F.size("vec") == lists.shape[1]).select("query_id", "vec").mapInArrow(run, T.StructType(fields))


def ivf_index(vectors: DataFrame, book: Codebook, lists: np.ndarray) -> DataFrame:
    """(id, code, list_id): the codes of an inverted-file index, in one pass over the vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast((book, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_book, own_lists = shared.value
        for b in batches:
            x = _rows(b.column(1), own_book.dim)
            codes = own_book.encode(x)
            offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.array(_squared(x, own_lists).argmin(1).astype(np.int32))], names=["id", "code", "list_id"])

    fields = [vectors.schema["id"], T.StructField("code", T.ArrayType(T.ShortType())), T.StructField("list_id", T.IntegerType())]
    return vectors.where(F.size("vec") == book.dim).select("id", "vec").mapInArrow(run, T.StructType(fields))


def write_index(index: DataFrame, path: str) -> None:
    """Write an index with a folder for each list, so that searches read only the lists they probe."""
    index.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)


def index_insert(index: DataFrame, vectors: DataFrame, book: Codebook, order: str, lists: np.ndarray | None = None) -> DataFrame:
    """The index after inserting vectors: id, vec and ``order``, of which the row with the largest
    value counts for each id. An id that is there already gets its new code, and moves to its new list."""
    last = vectors.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct("vec"), order).alias("r")).select("id", "r.vec")
    new = encode(last, book) if lists is None else ivf_index(last, book, lists)
    return index.join(new.select("id"), "id", "left_anti").select(*index.columns).unionByName(new.select(*index.columns))


def index_delete(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the ids; unknown ids do nothing."""
    return records.delete(index, ids)


def index_size(index: DataFrame) -> DataFrame:
    """(n_live,): the number of codes."""
    return records.count(index)
