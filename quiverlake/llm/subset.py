"""A varied subset by a cluster-feature tree (problem 5).

Each task summarises its rows of a tenant in cluster features (count, linear sum, square sum),
which are additive; a feature takes a row if its radius stays within a threshold, and the
threshold rises when there are too many features; joining leaves half as many as there may be at
least, so that tight groups keep several. The summaries of all tasks are merged by levels, FAN_IN
of a tenant at a time, into at most MAX_ENTRIES features, so that a tenant with most of the rows is
no burden, however many tasks there are. As each task summarises the rows it reads, another layout
of the table may give another, equally good subset. Ward linkage joins the features until the wanted number of
groups is left, and the record nearest each group's centre is taken, whatever the group's size.
Where groups are left without a record, or a tenant's features are fewer than the groups wanted,
the records farthest from those taken fill up (by the same levels).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.vectors import current_vectors, list_array, matrices, matrix, unit, written

#: Features that a summary has at most.
MAX_ENTRIES = 256
#: First squared radius of a feature, and the factor by which it rises.
FIRST_RADIUS2 = 0.02
RISE = 1.5
#: Numbers of the metadata part of a record's point, and its weight against the unit vector.
META_DIMS = 16
META_WEIGHT = 0.5
#: Branches of a tree node.
BRANCHES = 16
#: Summaries that one task merges.
FAN_IN = 32
#: Bytes of group centres sent to the executors at once; more are taken in several passes.
MAX_CENTRE_BYTES = 32 << 20
#: Records of a tenant from which a task picks far ones at once.
FAR_ROWS = 4096


class FeatureTree:
    """A cluster-feature tree of two levels: nodes of up to BRANCHES * 2 features each.

    A point goes down to the nearest node and its nearest feature. Points are taken in batches: a
    batch is placed by the features as they are, and what no feature can take becomes new features.
    """

    def __init__(self, dim: int, most: int = MAX_ENTRIES, radius2: float = FIRST_RADIUS2):
        self.most, self.radius2 = most, radius2
        self.least = most // 2  # joining leaves so many, whatever the threshold
        self.n = np.zeros(0)
        self.ls = np.zeros((0, dim))
        self.ss = np.zeros(0)
        self._nodes: list[np.ndarray] = []

    def _group(self) -> None:
        """Nodes over the features: sorted along their main direction, cut in stretches."""
        c = self.ls / self.n[:, None]
        v = c - c.mean(0)
        main = v[np.einsum("ij,ij->i", v, v).argmax()] if len(v) else v
        order = np.argsort(v @ main, kind="stable")
        self._nodes = np.array_split(order, max(1, -(-len(order) // BRANCHES)))

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        """The feature to which each point goes down the tree."""
        c = self.ls / self.n[:, None]
        heads = np.array([(self.n[k] @ c[k]) / self.n[k].sum() for k in self._nodes])
        node = (x @ heads.T * 2 - np.einsum("ij,ij->i", heads, heads)).argmax(1)
        out = np.zeros(len(x), np.int64)
        for k in np.unique(node):
            at, own = np.flatnonzero(node == k), self._nodes[k]
            out[at] = own[(x[at] @ c[own].T * 2 - np.einsum("ij,ij->i", c[own], c[own])).argmax(1)]
        return out

    def insert(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        """Take features (of single points or of other trees)."""
        for at in range(0, len(n), 512):
            self._insert(n[at : at + 512], ls[at : at + 512], ss[at : at + 512])

    def _insert(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        left = np.arange(len(n))
        if len(self.n):
            near = self._nearest(ls / n[:, None])
            m, s, q = self.n[near] + n, self.ls[near] + ls, self.ss[near] + ss
            fits = q / m - np.einsum("ij,ij->i", s, s) / (m * m) <= self.radius2
            took = np.flatnonzero(fits)
            np.add.at(self.n, near[took], n[took])
            np.add.at(self.ls, near[took], ls[took])
            np.add.at(self.ss, near[took], ss[took])
            left = np.flatnonzero(~fits)
        self.n, self.ls, self.ss = np.concatenate([self.n, n[left]]), np.concatenate([self.ls, ls[left]]), np.concatenate([self.ss, ss[left]])
        while len(self.n) > self.most:
            self._rise()
            self._condense()
        self._group()

    def _rise(self) -> None:
        """A threshold at which a quarter of the nearest pairs of features fit, or as many as there are
        too many; at most eight times the one before."""
        c, e = self.ls / self.n[:, None], len(self.n)
        sq = np.einsum("ij,ij->i", c, c)
        d2 = sq[:, None] + sq[None] - 2 * c @ c.T
        np.fill_diagonal(d2, np.inf)
        pairs = min(8 * self.radius2, np.quantile(d2.min(1) / 4, min(0.25, (e - self.most) / e)))
        self.radius2 = max(self.radius2 * RISE, float(pairs))

    def _condense(self) -> None:
        """Join mutual nearest features by Ward's cost, cheapest first, where the joint radius allows
        it, until none is left or ``least`` features are."""
        while (room := len(self.n) - self.least) > 0:
            n, e = self.n, len(self.n)
            c = self.ls / n[:, None]
            sq = np.einsum("ij,ij->i", c, c)
            m = n[:, None] + n[None]
            cost = n[:, None] * n[None] / m * np.maximum(0, sq[:, None] + sq[None] - 2 * c @ c.T)
            # Of a joint feature, count times squared radius is that of both parts and the cost.
            own = np.maximum(0, self.ss - n * sq)
            cost[(own[:, None] + own[None] + cost) > self.radius2 * m] = np.inf
            np.fill_diagonal(cost, np.inf)
            near = cost.argmin(1)
            i = np.flatnonzero((near[near] == np.arange(e)) & (near > np.arange(e)) & np.isfinite(cost[np.arange(e), near]))
            if not len(i):
                return
            i = i[np.argsort(cost[i, near[i]], kind="stable")][:room]
            j = near[i]
            for x in (self.n, self.ls, self.ss):
                x[i] += x[j]
            left = np.setdiff1d(np.arange(e), j)
            self.n, self.ls, self.ss = self.n[left], self.ls[left], self.ss[left]


def ward(n: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Group number of each feature: Ward linkage, cut at k groups."""
    e = len(n)
    group = np.arange(e)
    n, c = n.astype(np.float64).copy(), centres.astype(np.float64).copy()
    sq = np.einsum("ij,ij->i", c, c)
    cost = n[:, None] * n[None] / (n[:, None] + n[None]) * np.maximum(0, sq[:, None] + sq[None] - 2 * c @ c.T)
    np.fill_diagonal(cost, np.inf)
    for _ in range(e - k):
        i, j = sorted(divmod(int(cost.argmin()), e))
        m = n[i] + n[j]
        c[i] = (n[i] * c[i] + n[j] * c[j]) / m
        n[i] = m
        group[group == j] = i
        cost[j, :] = cost[:, j] = np.inf
        alive = np.isfinite(cost[i]) | (np.arange(e) == i)
        alive[i] = False
        v = c[alive] - c[i]
        cost[i, alive] = cost[alive, i] = n[alive] * m / (n[alive] + m) * np.einsum("ij,ij->i", v, v)
    return np.unique(group, return_inverse=True)[1]


def _meta_points(metadata: list, dims: int = META_DIMS, weight: float = META_WEIGHT) -> np.ndarray:
    """Points of metadata: each key=value goes to one hashed coordinate and sign; length ``weight``."""
    out = np.zeros((len(metadata), dims))
    for row, m in enumerate(metadata):
        for key, value in (m.items() if isinstance(m, dict) else m or ()):
            h = zlib.crc32(f"{key}={value}".encode("utf-8", "surrogatepass"))
            out[row, h % dims] += 1 if h >> 31 else -1
    length = np.sqrt((out * out).sum(1))
    return out * (weight / np.where(length > 0, length, 1))[:, None]


def _points(x: np.ndarray, metadata: list) -> np.ndarray:
    return np.hstack([unit(x), _meta_points(metadata)])


_CF = "tenant_id string, salt int, n double, ls array<double>, ss double"


def _features(tenant: str, salt: int, tree: FeatureTree) -> pa.Table:
    e = len(tree.n)
    offsets = np.arange(0, tree.ls.size + 1, tree.ls.shape[1], dtype=np.int32)
    ls = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tree.ls.ravel()))
    return pa.table({"tenant_id": pa.array([tenant] * e, pa.string()), "salt": pa.array([salt] * e, pa.int32()), "n": tree.n, "ls": ls, "ss": tree.ss})


def _merged(t: pa.Table) -> FeatureTree:
    ls = t.column("ls").combine_chunks()
    ls = ls.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    n, ss = t.column("n").to_numpy(), t.column("ss").to_numpy()
    order = np.lexsort((ls[:, 0], -n))  # the same whatever order the summaries come in
    tree = FeatureTree(ls.shape[1])
    tree.insert(n[order], ls[order], ss[order])
    return tree


def _summaries(rows: DataFrame) -> DataFrame:
    """The features of each tenant after both merges."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, FeatureTree] = {}
        salt = TaskContext.get().partitionId()
        for b in batches:
            tenant = np.array(b.column("tenant_id").to_pylist(), object)
            meta = b.column("metadata").to_pylist()
            for _, at, x in matrices(b):
                p = _points(x, [meta[i] for i in at])
                for t in sorted(set(tenant[at])):
                    own = np.flatnonzero(tenant[at] == t)
                    tree = trees.setdefault(t, FeatureTree(p.shape[1]))
                    tree.insert(np.ones(len(own)), p[own], np.einsum("ij,ij->i", p[own], p[own]))
            if len(trees) > 512:  # a task keeps few summaries at a time; they merge later
                for t, tree in trees.items():
                    yield from _features(t, salt, tree).to_batches()
                trees.clear()
        for t, tree in trees.items():
            yield from _features(t, salt, tree).to_batches()

    def merge_salt(key: tuple, t: pa.Table) -> pa.Table:
        return _features(key[0].as_py(), key[1].as_py(), _merged(t))

    def merge_tenant(key: tuple, t: pa.Table) -> pa.Table:
        return _features(key[0].as_py(), 0, _merged(t))

    once = rows.select("tenant_id", "id", "dim", "vec", "metadata").mapInArrow(summarise, _CF)
    return _by_levels(once, rows, merge_salt, _CF).groupBy("tenant_id").applyInArrow(merge_tenant, _CF)


def _by_levels(once: DataFrame, rows: DataFrame, merge, kind: str) -> DataFrame:
    """What the tasks over rows gave, merged until at most FAN_IN parts of a tenant are left."""
    parts = rows.rdd.getNumPartitions()
    while parts > FAN_IN:
        once = once.withColumn("salt", (F.col("salt") / FAN_IN).cast("int")).groupBy("tenant_id", "salt").applyInArrow(merge, kind)
        parts = -(-parts // FAN_IN)
    return once


def _centres(features: DataFrame, k: int) -> DataFrame:
    def cut(key: tuple, t: pa.Table) -> pa.Table:
        ls = t.column("ls").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        n = t.column("n").to_numpy()
        group = ward(n, ls / n[:, None], min(k, len(n)))
        sums = np.zeros((group.max() + 1, ls.shape[1]))
        total = np.zeros(group.max() + 1)
        np.add.at(sums, group, ls)
        np.add.at(total, group, n)
        order = np.lexsort((sums[:, 0], -total))
        return pa.table({"tenant_id": pa.array([key[0].as_py()] * len(order), pa.string()), "group_no": pa.array(np.arange(1, len(order) + 1), pa.int32()), "centre": list_array((sums / total[:, None])[order])})

    return features.groupBy("tenant_id").applyInArrow(cut, "tenant_id string, group_no int, centre array<float>")


_BEST = "tenant_id string, group_no int, id bigint, distance double, n bigint"


def _nearest_records(rows: DataFrame, centres: dict[str, tuple[np.ndarray, dict[int, int]]]) -> DataFrame:
    """For each batch, tenant and group: the nearest record of the group and the group's size. With
    a tenant's centres come the places of the records that are centres themselves."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # within MAX_CENTRE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            tenant = np.array(b.column("tenant_id").to_pylist(), object)
            ids = b.column("id").to_numpy(zero_copy_only=False)
            meta = b.column("metadata").to_pylist()
            for _, at, x in matrices(b):
                p = _points(x, [meta[i] for i in at])
                for t in sorted(set(tenant[at]) & set(shared.value)):
                    own = np.flatnonzero(tenant[at] == t)
                    c, fixed = shared.value[t]
                    d2 = np.maximum(0, (p[own] ** 2).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * p[own] @ c.T)
                    group = d2.argmin(1)
                    i = ids[at[own]]
                    for row in np.flatnonzero(np.isin(i, list(fixed))) if fixed else ():
                        group[row] = fixed[int(i[row])]
                        d2[row, group[row]] = 0
                    d = np.round(np.sqrt(d2[np.arange(len(own)), group]), 9)
                    for k in np.lexsort((i, d, group))[np.flatnonzero(np.diff(np.sort(group), prepend=-1))]:
                        out.append((t, int(group[k]) + 1, int(i[k]), float(d[k]), int((group == group[k]).sum())))
            cols = list(zip(*out)) if out else [[]] * 5
            types = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["tenant_id", "group_no", "id", "distance", "n"])

    return rows.select("tenant_id", "id", "dim", "vec", "metadata").mapInArrow(run, _BEST)


def _assigned(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(tenant_id, group_no, id, group_size, distance): of each group the record nearest its centre.
    centres: tenant_id, group_no, centre, id (of the record that is the centre, or null)."""
    total = centres.agg(F.sum(F.size("centre").cast("bigint") * 4)).first()[0] or 0
    passes = max(1, -(-total // MAX_CENTRE_BYTES))
    best = None
    for k in range(passes):
        mine = F.pmod(F.xxhash64("tenant_id"), F.lit(passes)) == k
        held: dict[str, list] = {}
        for r in centres.where(mine).orderBy("tenant_id", "group_no").select("tenant_id", "centre", "id").toLocalIterator():
            held.setdefault(r[0], []).append((r[1], r[2]))
        of = {t: (np.array([x for x, _ in c], np.float64), {i: g for g, (_, i) in enumerate(c) if i is not None}) for t, c in held.items()}
        part = _nearest_records(rows.where(mine), of)
        best = part if best is None else best.unionByName(part)
    return best.groupBy("tenant_id", "group_no").agg(F.min(F.struct("distance", "id")).alias("m"), F.sum("n").alias("group_size")).select("tenant_id", "group_no", F.col("m.id").alias("id"), "group_size", F.col("m.distance").alias("distance"))


def farthest(p: np.ndarray, ids: np.ndarray, taken: np.ndarray, k: int) -> np.ndarray:
    """Rows of up to k points, each the farthest from the taken rows and those before; ties go to
    the smallest id. Copies of points that are taken are left out."""
    order = np.argsort(ids, kind="stable")
    least = np.full(len(p), np.inf)
    for i in taken:
        least = np.minimum(least, ((p - p[i]) ** 2).sum(1))
    out: list[int] = []
    while len(out) < k and len(p):
        i = int(order[least[order].argmax()])
        if least[i] <= 0:
            break
        out.append(i)
        least = np.minimum(least, ((p - p[i]) ** 2).sum(1))
    return np.array(out, np.int64)


_FAR = "tenant_id string, salt int, group_no int, id bigint, p array<double>"


def _filled(rows: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(tenant_id, group_no, centre, id): of each tenant of rows to which records can be added,
    those found and those that fill up to k. found: tenant_id, group_no, id."""

    def thinned(held: list[tuple]) -> list[tuple]:
        """Of (group_no, id, point): those taken, and k far ones."""
        p, taken = np.array([h[2] for h in held]), np.array([h[0] is not None for h in held])
        far = farthest(p, np.array([h[1] for h in held]), np.flatnonzero(taken), k)
        return [held[i] for i in [*np.flatnonzero(taken), *far]]

    def table(tenant: str, salt: int, held: list[tuple]) -> pa.Table:
        n = len(held)
        return pa.table({"tenant_id": pa.array([tenant] * n, pa.string()), "salt": pa.array([salt] * n, pa.int32()), "group_no": pa.array([h[0] for h in held], pa.int32()), "id": pa.array([h[1] for h in held], pa.int64()), "p": pa.array([h[2] for h in held], pa.list_(pa.float64()))})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        salt = TaskContext.get().partitionId()
        for b in batches:
            tenant, ids, group, meta = (b.column(c).to_pylist() for c in ("tenant_id", "id", "group_no", "metadata"))
            for _, at, x in matrices(b):
                p = _points(x, [meta[i] for i in at])
                for row, i in enumerate(at):
                    own = held.setdefault(tenant[i], [])
                    own.append((group[i], ids[i], p[row]))
                    if len(own) >= FAR_ROWS:
                        held[tenant[i]] = thinned(own)
            if len(held) > 512:
                for t, own in held.items():
                    yield from table(t, salt, thinned(own)).to_batches()
                held.clear()
        for t, own in held.items():
            yield from table(t, salt, thinned(own)).to_batches()

    def rows_of(t: pa.Table) -> list[tuple]:
        return list(zip(t.column("group_no").to_pylist(), t.column("id").to_pylist(), [np.array(p) for p in t.column("p").to_pylist()]))

    def merge_salt(key: tuple, t: pa.Table) -> pa.Table:
        return table(key[0].as_py(), key[1].as_py(), thinned(rows_of(t)))

    def fill(key: tuple, t: pa.Table) -> pa.Table:
        held = thinned(rows_of(t))
        taken = sorted((h for h in held if h[0] is not None), key=lambda h: h[0])
        whole = (taken + [h for h in held if h[0] is None])[:k]
        whole = whole if len(whole) > len(taken) else []
        n = len(whole)
        return pa.table({"tenant_id": pa.array([key[0].as_py()] * n, pa.string()), "group_no": pa.array(range(1, n + 1), pa.int32()), "centre": pa.array([h[2] for h in whole], pa.list_(pa.float64())).cast(pa.list_(pa.float32())), "id": pa.array([h[1] for h in whole], pa.int64())})

    given = rows.select("tenant_id", "id", "dim", "vec", "metadata").join(found.select("tenant_id", "id", "group_no"), ["tenant_id", "id"], "left")
    once = given.mapInArrow(pick, _FAR)
    return _by_levels(once, given, merge_salt, _FAR).groupBy("tenant_id").applyInArrow(fill, "tenant_id string, group_no int, centre array<float>, id bigint")


def varied_subset(vectors: DataFrame, tenants: DataFrame, per_tenant: int = 32) -> DataFrame:
    """(tenant_id, group_no, id, group_size, distance): for each tenant per_tenant records that
    cover the variety of its current vectors and their metadata, one for each group.

    A tenant with fewer distinct records (by direction and metadata) gives fewer, all others give
    per_tenant. Where groups without records were filled up, each record is its group's centre, and
    the others of the tenant count to the nearest. Null and empty metadata count as a point of its own, null
    values as the text None. Unusable vectors and null ids have no part, repeated rows count once,
    ties go to the smallest id, empty tables give no rows.
    """
    rows = written(current_vectors(vectors, tenants, "metadata"), "subset-vectors")
    centres = written(_centres(_summaries(rows), per_tenant), "subset-centres")
    found = written(_assigned(rows, centres.withColumn("id", F.lit(None).cast("bigint"))), "subset-found")
    short = found.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("q_found"), F.sum("group_size").alias("q_rows"))
    short = short.where((F.col("q_found") < per_tenant) & (F.col("q_rows") > F.col("q_found"))).select("tenant_id")
    if short.isEmpty():
        return found
    filled = written(_filled(rows.join(short, "tenant_id", "left_semi"), found, per_tenant), "subset-filled")
    named = filled.select("tenant_id").distinct()
    again = _assigned(rows.join(named, "tenant_id", "left_semi"), filled)
    return found.join(named, "tenant_id", "left_anti").unionByName(again)
