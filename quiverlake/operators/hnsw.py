"""Approximate search in layered proximity graphs, one graph for each shard.

Each shard's graph is built and searched within one Arrow group, so parallel work comes from
the shards; a graph is kept as rows (one for each vertex, with its links by layer).
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from quiverlake.operators.search import _exact, query_pieces

LINKS = 16
BUILD_WIDTH = 100
LEAST_WIDTH = 64
MAX_LEVEL = 64
#: Vertices up to which a graph's distances are held as a table while it is built.
TABLE_ROWS = 4096
#: A shard's graph is built anew with at least so many deleted vertices, and more than living ones.
MIN_DEAD = 256


def width(ef: int, k: int) -> int:
    """Beam width of a search: ef, by default the larger of LEAST_WIDTH and k."""
    return max(ef or max(LEAST_WIDTH, k), k)


def _table(x: np.ndarray, metric: str) -> np.ndarray:
    dots = x @ x.T
    if metric == "l2":
        n = np.diag(dots)
        return np.maximum(0.0, n[:, None] + n[None] - 2 * dots)
    return -dots if metric == "dot" else 1 - dots


class Graph:
    """A layered proximity graph over the rows of x; links[v][layer] are a vertex's neighbours."""

    def __init__(self, x: np.ndarray, metric: str = "l2", m: int = LINKS, build: int = BUILD_WIDTH, seed: int = 1, links: list | None = None):
        x = np.asarray(x, np.float64)
        if metric == "cosine":
            n = np.sqrt((x * x).sum(1))
            x = x / np.where(n > 0, n, 1)[:, None]
        self.x, self.metric, self.m, self.build = x, metric, m, build
        self.dead = np.zeros(len(x), bool)
        self.links: list[list[list[int]]] = []
        self.entry, self.top = -1, -1
        self.table = None  # distances of all vertices, while a small graph is built
        if links is None:
            if len(x) <= TABLE_ROWS:
                self.table = _table(self.x, metric)
            levels = self._levels(len(x), seed)
            for v in range(len(x)):
                self._add(v, int(levels[v]))
            self.table = None
        else:
            self.links = links
            if links:
                self.entry = max(range(len(links)), key=lambda v: len(links[v]))
                self.top = len(links[self.entry]) - 1

    def _levels(self, n: int, seed: int) -> np.ndarray:
        u = np.random.default_rng(seed).random(n)
        return np.minimum(MAX_LEVEL, (-np.log(1 - u) / math.log(self.m)).astype(int))

    def _d(self, q: np.ndarray, at) -> np.ndarray:
        y = self.x[at]
        if self.metric == "l2":
            z = y - q
            return np.einsum("ij,ij->i", z, z)
        dots = y @ q
        return -dots if self.metric == "dot" else 1 - dots

    def _descend(self, q: np.ndarray, start: int, layer: int) -> int:
        here, d = start, float(self._d(q, [start])[0])
        while near := self.links[here][layer]:
            all_d = self._d(q, near)
            i = int(all_d.argmin())
            if all_d[i] >= d:
                break
            here, d = near[i], float(all_d[i])
        return here

    def _beam(self, q: np.ndarray, start: int, layer: int, most: int, living: bool = False, of: int = -1) -> list[tuple[float, int]]:
        """(distance, vertex) of the nearest found; dead vertices are walked, but left out if living. of: the vertex that q is, if it is one."""
        dist = (lambda at: self._from(of, at)) if of >= 0 else (lambda at: self._d(q, at))
        d = float(dist([start])[0])
        seen = {start}
        front = [(d, start)]
        best = [] if living and self.dead[start] else [(-d, start)]
        while front:
            d, v = heapq.heappop(front)
            if len(best) >= most and d > -best[0][0]:
                break
            new = [u for u in self.links[v][layer] if u not in seen]
            if not new:
                continue
            seen.update(new)
            for du, u in zip(dist(new).tolist(), new):
                if len(best) < most or du < -best[0][0]:
                    heapq.heappush(front, (du, u))
                    if not (living and self.dead[u]):
                        heapq.heappush(best, (-du, u))
                        if len(best) > most:
                            heapq.heappop(best)
        return sorted((-d, v) for d, v in best)

    def _spread(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are no nearer to any kept before than to the vertex, nearest first."""
        kept: list[int] = []
        for d, v in near:
            if len(kept) >= most:
                break
            if not kept or (self._from(v, kept) >= d).all():
                kept.append(v)
        return kept

    def _from(self, v: int, at) -> np.ndarray:
        """Distances of a vertex to others; from a table in small graphs."""
        return self._d(self.x[v], at) if self.table is None else self.table[v, at]

    def _add(self, v: int, level: int) -> None:
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry, self.top = v, level
            return
        q, at = self.x[v], self.entry
        for layer in range(self.top, level, -1):
            at = self._descend(q, at, layer)
        for layer in range(min(level, self.top), -1, -1):
            near = self._beam(q, at, layer, self.build, of=v)
            at = near[0][1]
            most = 2 * self.m if layer == 0 else self.m
            self.links[v][layer] = self._spread(near, most)
            for u in self.links[v][layer]:
                back = self.links[u][layer]
                back.append(v)
                if len(back) > most:
                    d = self._from(u, back)
                    self.links[u][layer] = self._spread(sorted(zip(d.tolist(), back)), most)
        if level > self.top:
            self.entry, self.top = v, level

    def insert(self, x: np.ndarray, seed: int) -> None:
        """Add rows as new vertices."""
        first = len(self.x)
        if self.metric == "cosine":
            n = np.sqrt((x * x).sum(1))
            x = x / np.where(n > 0, n, 1)[:, None]
        self.x = np.vstack([self.x.reshape(-1, x.shape[1]), x])
        self.dead = np.concatenate([self.dead, np.zeros(len(x), bool)])
        for v, level in enumerate(self._levels(len(x), seed), first):
            self._add(v, int(level))

    def search(self, q: np.ndarray, k: int, ef: int = 0) -> list[tuple[float, int]]:
        if self.entry < 0 or k < 1:
            return []
        q = np.asarray(q, np.float64)
        if self.metric == "cosine" and (n := math.sqrt(float(q @ q))) > 0:
            q = q / n
        at = self.entry
        for layer in range(self.top, 0, -1):
            at = self._descend(q, at, layer)
        return self._beam(q, at, 0, width(ef, k), living=True)[:k]


def _graph_type(rows: DataFrame) -> T.StructType:
    return T.StructType([rows.schema["shard"], rows.schema["id"], T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("slot", T.IntegerType()), T.StructField("links", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("dead", T.BooleanType())])


def _graph_table(shard: pa.ChunkedArray, ids: pa.Array | pa.ChunkedArray, vecs: pa.Array | pa.ChunkedArray, g: Graph, kind: pa.Schema) -> pa.Table:
    n = len(g.links)
    cols = [pa.array([shard[0].as_py()] * n), ids, vecs, pa.array(np.arange(n, dtype=np.int32)), pa.array(g.links, pa.list_(pa.list_(pa.int32()))), pa.array(g.dead)]
    return pa.table({f.name: c.cast(f.type) for f, c in zip(kind, cols)})


def _vectors(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def build_graphs(collection: DataFrame, metric: str = "l2", m: int = LINKS, build: int = BUILD_WIDTH, seed: int = 1) -> DataFrame:
    """(shard, id, vec, slot, links, dead): the graph rows of every shard of (shard, id, vec). Choose
    the number of shards so that a shard has some ten thousand rows."""
    fields = _graph_type(collection)
    kind = to_arrow_schema(fields)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        return _graph_table(t.column("shard"), t.column("id"), t.column("vec"), Graph(_vectors(t.column("vec")), metric, m, build, seed), kind)

    rows = collection.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select("shard", "id", F.col("vec").cast("array<float>").alias("vec"))
    return rows.groupBy("shard").applyInArrow(run, fields)


def insert_into_graphs(graphs: DataFrame, rows: DataFrame, metric: str = "l2", m: int = LINKS, build: int = BUILD_WIDTH, seed: int = 2) -> DataFrame:
    """The graphs after inserting (shard, id, vec), each id once. A stored id's old vertex dies and a
    new one takes its place; shards without a graph get one."""
    fields = _graph_type(graphs)
    kind = to_arrow_schema(fields)

    def run(have: pa.Table, new: pa.Table) -> pa.Table:
        if not new.num_rows:
            return have.select(fields.names).cast(kind)
        new = new.rename_columns(["shard", "id", "vec"]).sort_by("id").combine_chunks()
        x = _vectors(new.column("vec"))
        if not have.num_rows:
            return _graph_table(new.column("shard"), new.column("id"), new.column("vec"), Graph(x, metric, m, build, seed), kind)
        g, t = _loaded(have, metric, m, build)
        known = set(new.column("id").to_pylist())
        g.dead = g.dead | np.array([i in known for i in t.column("id").to_pylist()])
        g.insert(x, seed + t.num_rows)
        both = pa.concat_tables([t.select(["id", "vec"]), new.select(["id", "vec"]).cast(t.select(["id", "vec"]).schema)])
        return _graph_table(t.column("shard"), both.column("id"), both.column("vec"), g, kind)

    given = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select(F.col("shard").alias("q_shard"), F.col("id").alias("q_id"), F.col("vec").cast("array<float>").alias("q_vec"))
    return graphs.select(*fields.names).groupBy("shard").cogroup(given.groupBy("q_shard")).applyInArrow(run, fields)


def delete_from_graphs(graphs: DataFrame, ids: DataFrame) -> DataFrame:
    """The graphs with the vertices of the ids dead: searches walk them, but don't return them."""
    gone = ids.select("id").distinct().withColumn("q_gone", F.lit(True))
    return graphs.join(gone, "id", "left").withColumn("dead", F.col("dead") | F.coalesce("q_gone", F.lit(False))).select("shard", "id", "vec", "slot", "links", "dead")


def compact_graphs(graphs: DataFrame, metric: str = "l2", min_dead: int = MIN_DEAD, m: int = LINKS, build: int = BUILD_WIDTH, seed: int = 1) -> DataFrame:
    """The graphs in which shards with at least min_dead dead vertices, and more than living ones, are
    built anew without them; a shard without living vertices goes."""
    counts = graphs.groupBy("shard").agg(F.count_if("dead").alias("q_dead"), F.count_if(~F.col("dead")).alias("q_living"))
    due = counts.where((F.col("q_dead") >= min_dead) & (F.col("q_dead") > F.col("q_living"))).select("shard")
    again = build_graphs(graphs.join(due, "shard", "left_semi").where("NOT dead"), metric, m, build, seed)
    return graphs.join(due, "shard", "left_anti").select(*again.columns).unionByName(again)


def graph_ids(graphs: DataFrame) -> DataFrame:
    """(shard, id) of the living vertices."""
    return graphs.where("NOT dead").select("shard", "id")


def tombstones(graphs: DataFrame) -> DataFrame:
    """(shard, n_dead): dead vertices of each shard."""
    return graphs.groupBy("shard").agg(F.count_if("dead").alias("n_dead"))


def _loaded(t: pa.Table, metric: str, m: int = LINKS, build: int = BUILD_WIDTH) -> tuple[Graph, pa.Table]:
    """A shard's graph from its rows, and these in order of their vertices."""
    t = t.sort_by("slot").combine_chunks()
    g = Graph(_vectors(t.column("vec")), metric, m, build, links=t.column("links").to_pylist())
    g.dead = t.column("dead").to_numpy(zero_copy_only=False)
    return g, t


def search_graphs(queries: DataFrame, graphs: DataFrame, k: int, metric: str = "l2", ef: int = 0, deleted: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k best of all shards, each searched with beam width
    width(ef, k). Dead vertices, and those of ids in ``deleted``, are walked but not returned."""
    spark = graphs.sparkSession
    fields = T.StructType([queries.schema["query_id"], graphs.schema["id"], T.StructField("score", T.DoubleType())])
    rows = graphs if deleted is None else delete_from_graphs(graphs, deleted)
    out = None
    for piece in query_pieces(queries):
        shared = spark.sparkContext.broadcast([(r[0], np.array(r[1], np.float64)) for r in piece])
        part = rows.groupBy("shard").applyInArrow(_searcher(shared, k, metric, ef, to_arrow_type(fields[0].dataType)), fields)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _searcher(shared, k: int, metric: str, ef: int, query_type: pa.DataType):
    """The search of one shard's graph rows for all queries."""

    def run(t: pa.Table) -> pa.Table:
        g, t = _loaded(t, metric)
        x = _vectors(t.column("vec"))
        ids = t.column("id")
        q, at, score = [], [], []
        for qid, v in shared.value:
            found = [v2 for _, v2 in g.search(v, k, ef)]
            q += [qid] * len(found)
            at += found
            score += _exact(metric, v[None], x[found]).tolist() if found else []
        return pa.table({"query_id": pa.array(q, query_type), "id": ids.take(pa.array(at, pa.int64())), "score": pa.array(score, pa.float64())})

    return run


def graph_problems(graphs: DataFrame) -> DataFrame:
    """(shard, problem): repeated ids, slots that aren't 0..n-1, and links to unknown slots."""
    per = graphs.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(~F.col("dead"), F.col("id"))).alias("ids"), F.count_if(~F.col("dead")).alias("living"), F.max("slot").alias("last"), F.max(F.array_max(F.flatten("links"))).alias("far"))
    problem = F.when(F.col("ids") < F.col("living"), "repeated id").when(F.col("last") != F.col("n") - 1, "missing slot").when(F.col("far") >= F.col("n"), "unknown link")
    return per.select("shard", problem.alias("problem")).where("problem IS NOT NULL")
