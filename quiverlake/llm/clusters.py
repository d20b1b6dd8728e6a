"""Clusters of mutually similar vectors by bisecting k-means (problem 4).

Each node that is not compact is split in two, the node of largest dispersion first, until every
leaf is compact: all of its members are near one of them, so that a leaf is always part of one group
of connected vectors. Tenants with more than NODE_ROWS vectors are first split by a tree that is
bisected on a bounded sample; its nodes then go to one task each. An exact check follows: leaves
that are near each other are joined, and a joined group is a cluster if all of its members are near
each other and none is near anything outside. For this, leaves are compared in blocks sorted by how
far they lean towards each other; bounds on cosines decide most blocks, and no pair of vectors
leaves a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.functions.distance import cosine_distance
from quiverlake.llm.vectors import current_vectors, list_array, matrices, matrix, partitions_of, sized, unit, written

#: Cosine distance up to which two vectors are near.
LIMIT = 0.55
#: Vectors of a tenant in one node, about.
NODE_ROWS = 131072
#: Rows of a large tenant on which its tree is bisected.
TREE_SAMPLE = 4096
#: Bytes of all large tenants' trees that are sent to the executors at once.
MAX_TREE_BYTES = 64 << 20
#: Rows compared at once.
TILE = 4096
#: Rows of a block whose bounds are taken together.
BLOCK = 1024
#: Leaves of a node that are compared as wholes.
PAIRED = 128
_ROUNDS = 6
#: Room for float rounding in bounds.
_EPS = 1e-5


def _halves(x: np.ndarray) -> np.ndarray:
    """2-means on unit vectors; True for the second half. Starts from the row farthest from the
    centre and the row farthest from that one. Neither half is empty unless all rows are equal."""
    first = x[(x @ x.mean(0)).argmin()]
    second = x[(x @ first).argmin()]
    side = x @ second > x @ first
    for _ in range(_ROUNDS):
        if side.all() or not side.any():
            break
        a, b = x[~side].mean(0), x[side].mean(0)
        new = x @ (b / max(np.linalg.norm(b), 1e-12) - a / max(np.linalg.norm(a), 1e-12)) > 0
        if (new == side).all():
            break
        side = new
    if side.all() or not side.any():
        side = x @ second > x @ first
    return side


def _centre(x: np.ndarray) -> np.ndarray:
    c = x.mean(0, dtype=np.float64)
    n = np.linalg.norm(c)
    return (c / n).astype(np.float32) if n > 1e-9 else x[0]


def bisect(x: np.ndarray, least: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Leaf number of each unit vector, and the leaves' centres. All members of a leaf have a cosine
    of at least ``least`` to the member nearest its centre. Nodes are split in the order of their
    dispersion."""
    leaf = np.zeros(len(x), np.int64)
    centres: list[np.ndarray] = []
    heap: list[tuple[float, int, np.ndarray]] = [(0.0, 0, np.arange(len(x)))]
    made = 0
    while heap:
        _, _, rows = heapq.heappop(heap)
        own = x[rows]
        c = _centre(own)
        out = own @ own[(own @ c).argmax()] < least
        out[(own @ c).argmax()] = False
        if not out.any():
            leaf[rows] = len(centres)
            centres.append(c)
            continue
        side = out if out.sum() < 0.02 * len(rows) else _halves(own)  # a compact core sheds its strays
        if side.all() or not side.any():
            side = out
        for part in (rows[~side], rows[side]):
            made += 1
            spread = len(part) - float(np.linalg.norm(x[part].sum(0, dtype=np.float64)))
            heapq.heappush(heap, (-spread, made, part))
    return leaf, centres


def _blocks(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest coordinates and largest remainder of each block of rows."""
    at = np.arange(0, len(p), BLOCK)
    return np.minimum.reduceat(p, at), np.maximum.reduceat(p, at), np.maximum.reduceat(q, at)


def relation(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, least: float) -> tuple[bool, bool]:
    """(any, all): whether some, and whether all, rows of a and b have a cosine of at least
    ``least``.

    In the plane of both centres the rows' coordinates are known, and their remainders multiply to
    no more than the product of their lengths. Sorted by their leaning to each other's centre,
    blocks of rows have narrow bounds; only blocks that these don't decide are multiplied.
    """
    g = float(ca @ cb)
    w = cb - g * ca
    n = float(np.linalg.norm(w))
    base = np.stack([ca, w / n]) if n > 1e-4 else ca[None]
    pa_, pb = a @ base.T, b @ base.T
    # Towards the other centre first; with one centre, the rows farthest from it first.
    oa, ob = (np.argsort(-pa_[:, 1]), np.argsort(-pb[:, 0])) if len(base) == 2 else (np.argsort(pa_[:, 0]), np.argsort(pb[:, 0]))
    a, b, pa_, pb = a[oa], b[ob], pa_[oa], pb[ob]
    rest_a, rest_b = (np.sqrt(np.maximum(0, 1 - (p * p).sum(1))) for p in (pa_, pb))
    (la, ha, ra), (lb, hb, rb) = _blocks(pa_, rest_a), _blocks(pb, rest_b)
    corners = np.stack([u[:, None] * v[None] for u in (la, ha) for v in (lb, hb)])
    rest = ra[:, None] * rb[None]
    most, fewest = corners.max(0).sum(2) + rest, corners.min(0).sum(2) - rest
    none, full = most < least - _EPS, fewest >= least + _EPS
    some, every = bool(full.any()), not none.any()
    for i, j in zip(*np.nonzero(~none & ~full)):
        if some and not every:
            break
        near = a[i * BLOCK : (i + 1) * BLOCK] @ b[j * BLOCK : (j + 1) * BLOCK].T >= least
        some = some or bool(near.any())
        every = every and bool(near.all())
    return some, every


def _large(sizes: np.ndarray) -> np.ndarray:
    """Which leaves are compared as wholes: the PAIRED largest of three or more rows."""
    out = sizes >= 3
    if out.sum() > PAIRED:
        out &= sizes > np.partition(sizes, -PAIRED)[-PAIRED]
    return out


def _edges(xa: np.ndarray, la: np.ndarray, ca: list, xb: np.ndarray, lb: np.ndarray, cb: list, least: float, same: bool) -> list[tuple[int, int, bool]]:
    """(leaf of a, leaf of b, all near) for pairs of leaves of which some rows are near. Large
    leaves are compared with each other by relation; the rows of all others with everything, in
    blocks."""
    na, nb = np.bincount(la, minlength=len(ca)), np.bincount(lb, minlength=len(cb))
    order_a, order_b = np.argsort(la, kind="stable"), np.argsort(lb, kind="stable")
    end_a, end_b = np.cumsum(na), np.cumsum(nb)
    big_a, big_b = _large(na), _large(nb)
    rows_a = {i: xa[order_a[end_a[i] - na[i] : end_a[i]]] for i in np.flatnonzero(big_a)}
    rows_b = rows_a if same else {j: xb[order_b[end_b[j] - nb[j] : end_b[j]]] for j in np.flatnonzero(big_b)}
    out: list[tuple[int, int, bool]] = []
    for i in rows_a:
        for j in rows_b:
            if not same or i < j:
                some, every = relation(rows_a[i], rows_b[j], ca[i], cb[j], least)
                if some:
                    out.append((int(i), int(j), every))

    def loose(x, leaf, small, other, other_leaf, keep) -> dict[tuple[int, int], int]:
        """Near pairs of rows, counted by pair of leaves, of the rows in small leaves."""
        few = np.flatnonzero(small[leaf])
        n = int(other_leaf.max()) + 1 if len(other_leaf) else 1
        near: dict[tuple[int, int], int] = {}
        for s in range(0, len(few), TILE):
            some = few[s : s + TILE]
            for t in range(0, len(other), TILE):
                p, q = np.nonzero(x[some] @ other[t : t + TILE].T >= least)
                keys, counts = np.unique(leaf[some[p]] * n + other_leaf[t + q], return_counts=True)
                i, j = keys // n, keys % n
                for at in np.flatnonzero(keep(i, j)):
                    k = int(i[at]), int(j[at])
                    near[k] = near.get(k, 0) + int(counts[at])
        return near

    if same:
        found = loose(xa, la, ~big_a, xb, lb, lambda i, j: (i != j) & (big_a[j] | (i < j)))
    else:
        found = loose(xa, la, ~big_a, xb, lb, lambda i, j: np.ones(len(i), bool))
        found |= {(i, j): n for (j, i), n in loose(xb, lb, ~big_b, xa, la, lambda j, i: big_a[i]).items()}
    out += [(i, j, n == na[i] * nb[j]) for (i, j), n in found.items()]
    if same:  # leaves whose own rows are not all near
        half = np.sqrt((1 + least) / 2) + _EPS
        for i in np.flatnonzero(na >= 3):
            own = xa[order_a[end_a[i] - na[i] : end_a[i]]]
            if (own @ ca[i]).min() < half and not relation(own, own, ca[i], ca[i], least)[1]:
                out.append((int(i), int(i), False))
    return _compact(out, same)


def _compact(edges: list[tuple[int, int, bool]], same: bool) -> list[tuple[int, int, bool]]:
    """The edges, but of a component that can't become a cluster (some of its rows are near and
    some are not) only enough to keep it together."""
    name = lambda i, j: ((0, i), (0 if same else 1, j))
    up: dict = {}

    def top(v):
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    broken = set()
    kept = []
    for i, j, every in edges:
        a, b = map(top, name(i, j))
        if a != b:
            up[a] = b
            kept.append((i, j, every))
        if not every:
            broken.add(name(i, j)[0])
    bad = {top(v) for v in broken}
    return [e for e in edges if top(name(e[0], e[1])[0]) not in bad or same and e[0] == e[1]] + [(i, j, False) for i, j, _ in kept if top(name(i, j)[0]) in bad]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest vertex of the component of each of n vertices, given edges a-b."""
    top = np.arange(n)
    while True:
        low = np.minimum(top[a], top[b])
        new = top.copy()
        np.minimum.at(new, top[a], low)
        np.minimum.at(new, top[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == top).all():
            return top
        top = new


def clusters_of(size: np.ndarray, a: np.ndarray, b: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Cluster number of each leaf, -1 without one. size: rows of each leaf; a-b: edges of leaves of
    which some rows are near, ``every``: whether all are; of a leaf with itself if its own rows are
    not all near. A component of leaves is a cluster if all pairs of its leaves are joined by edges
    whose rows are all near, and it has three rows."""
    n = len(size)
    top = components(n, a, b)
    members, rows = np.bincount(top, minlength=n), np.bincount(top, size, minlength=n)
    full = np.bincount(top[a[every]], minlength=n)
    broken = np.bincount(top[a[~every]], minlength=n) > 0
    good = ~broken & (rows >= 3) & (full == members * (members - 1) // 2)
    return np.where(good[top], top, -1)


def _trees(rows: DataFrame, node_rows: int) -> dict[str, list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """For each tenant with more than node_rows rows a tree bisected on its TREE_SAMPLE rows with
    the smallest hashes: (node, first child, centre, centre); leaves have no entry."""
    large = rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > node_rows)
    per = F.lit(TREE_SAMPLE) / F.col("n")
    picked = rows.join(large, "tenant_id").where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 20)) < per * (1 << 20))

    def grow(key: tuple, t: pa.Table) -> pa.Table:
        x = unit(matrix(t.column("vec"), t.column("dim")[0].as_py()))
        most = len(x) * node_rows / max(1, t.column("n")[0].as_py()) / 1.3
        node, first, a, b = [], [], [], []
        heap, made = [(-len(x), 0, np.arange(len(x)))], 1
        while heap and -heap[0][0] > most:
            _, at, own = heapq.heappop(heap)
            side = _halves(x[own])
            if side.all() or not side.any():
                continue  # equal rows
            node.append(at)
            first.append(made)
            a.append(_centre(x[own[~side]]))
            b.append(_centre(x[own[side]]))
            for part in (own[~side], own[side]):
                heapq.heappush(heap, (-len(part), made, part))
                made += 1
        return pa.table({"tenant_id": pa.array([key[0].as_py()] * len(node), pa.string()), "node": pa.array(node, pa.int32()), "first": pa.array(first, pa.int32()), "a": list_array(np.array(a).reshape(len(node), -1)), "b": list_array(np.array(b).reshape(len(node), -1))})

    out: dict[str, list] = {}
    total = 0
    grown = picked.groupBy("tenant_id").applyInArrow(grow, "tenant_id string, node int, first int, a array<float>, b array<float>")
    for r in grown.toLocalIterator():
        total += 8 * len(r["a"])
        if total > MAX_TREE_BYTES:
            raise ValueError("the trees of the large tenants exceed MAX_TREE_BYTES; raise node_rows")
        out.setdefault(r["tenant_id"], []).append((r["node"], r["first"], np.array(r["a"], np.float32), np.array(r["b"], np.float32)))
    return {t: sorted(nodes, key=lambda e: e[0]) for t, nodes in out.items()}


def _with_nodes(rows: DataFrame, node_rows: int) -> DataFrame:
    """rows with the tree node (0 for small tenants) that each belongs to."""
    trees = rows.sparkSession.sparkContext.broadcast(_trees(rows, node_rows))  # within MAX_TREE_BYTES
    if not trees.value:
        return rows.withColumn("node", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = np.zeros(b.num_rows, np.int32)
            tenant = np.array(b.column("tenant_id").to_pylist(), object)
            for _, at, x in matrices(b):
                x = unit(x)
                for t in set(tenant[at]) & set(trees.value):
                    own = np.flatnonzero(tenant[at] == t)
                    y, place = x[own], np.zeros(len(own), np.int32)
                    for parent, first, ca, cb in trees.value[t]:
                        here = np.flatnonzero(place == parent)
                        place[here] = first + (y[here] @ (cb - ca) > 0)
                    node[at[own]] = place
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node)], names=[*b.schema.names, "node"])

    schema = rows.withColumn("node", F.lit(0)).schema
    return rows.mapInArrow(run, schema)


# Kinds of rows that a node's task gives: a member, a leaf of three or more rows, an edge of leaves.
_MEMBER, _LEAF, _EDGE = 0, 1, 2
_STEP = "tenant_id string, kind int, node int, leaf int, node2 int, leaf2 int, size int, size2 int, every boolean, id bigint"


def _step_table(tenant: str, kind: int, **columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    types = {"node": pa.int32(), "leaf": pa.int32(), "node2": pa.int32(), "leaf2": pa.int32(), "size": pa.int32(), "size2": pa.int32(), "every": pa.bool_(), "id": pa.int64()}
    data = {c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()}
    return pa.table({"tenant_id": pa.array([tenant] * n, pa.string()), "kind": pa.array([kind] * n, pa.int32()), **data})


def mutual_clusters(vectors: DataFrame, tenants: DataFrame, limit: float = LIMIT, node_rows: int = NODE_ROWS, with_vec: bool = False) -> DataFrame:
    """(tenant_id, head_id, id, size): the members of every cluster, a set of at least three ids of
    one tenant whose current vectors are all within cosine distance ``limit`` of each other and of
    none outside the set. head_id is the cluster's smallest id, size its number of members.
    with_vec: also dim and vec.

    Unusable vectors and null ids have no part, repeated rows count once, empty tables give no
    rows. Needs limit <= 1.
    """
    least = 1.0 - limit
    rows = _with_nodes(written(current_vectors(vectors, tenants), "clusters-vectors"), node_rows)

    def node_step(key: tuple, t: pa.Table) -> pa.Table:
        tenant, node = key[0].as_py(), key[1].as_py()
        x = unit(matrix(t.column("vec"), t.column("dim")[0].as_py()))
        leaf, centres = bisect(x, least)
        sizes = np.bincount(leaf, minlength=len(centres))
        big = np.flatnonzero(sizes >= 3)
        edges = _edges(x, leaf, centres, x, leaf, centres, least, True)
        i, j = [e[0] for e in edges], [e[1] for e in edges]
        return pa.concat_tables(
            [
                _step_table(tenant, _MEMBER, node=np.full(len(x), node), leaf=leaf, id=t.column("id").to_numpy()),
                _step_table(tenant, _LEAF, node=np.full(len(big), node), leaf=big, size=sizes[big]),
                _step_table(tenant, _EDGE, node=[node] * len(i), leaf=i, node2=[node] * len(i), leaf2=j, size=sizes[i] if i else [], size2=sizes[j] if j else [], every=[e[2] for e in edges]),
            ]
        )

    # Rows come in order of id, so that a repeated run gives the same leaves.
    n = partitions_of(vectors)
    steps = written(sized(rows, n, "tenant_id", "node").groupBy("tenant_id", "node").applyInArrow(_by_id(node_step), _STEP), "clusters-leaves")
    split = steps.where(F.col("kind") == _MEMBER).groupBy("tenant_id", "node").agg(F.count(F.lit(1)).alias("n"))
    facts = steps.where(F.col("kind") != _MEMBER)
    nodes = split.groupBy("tenant_id").agg(F.sort_array(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1)
    if not nodes.isEmpty():
        labelled = rows.join(nodes, "tenant_id").join(steps.where(F.col("kind") == _MEMBER).select("tenant_id", "id", "leaf"), ["tenant_id", "id"])

        cols = ["tenant_id", "n1", "n2", "dim", "vec", "leaf"]

        def node_pair(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
            tenant, n1, n2 = (k.as_py() for k in key)
            b = b.rename_columns(cols)
            if not a.num_rows or not b.num_rows:
                return _step_table(tenant, _EDGE, node=[])
            sides = []
            for t in (a, b):
                x = unit(matrix(t.column("vec"), t.column("dim")[0].as_py()))
                leaf = t.column("leaf").to_numpy()
                order = np.argsort(leaf, kind="stable")
                cuts = np.flatnonzero(np.diff(leaf[order])) + 1
                centres = {int(leaf[p[0]]): _centre(x[p]) for p in np.split(order, cuts)}
                sides.append((x, leaf, [centres.get(k, x[0]) for k in range(leaf.max() + 1)]))
            edges = _edges(*sides[0], *sides[1], least, False)
            sa, sb = np.bincount(sides[0][1]), np.bincount(sides[1][1])
            i, j = [e[0] for e in edges], [e[1] for e in edges]
            return _step_table(tenant, _EDGE, node=[n1] * len(i), leaf=i, node2=[n2] * len(i), leaf2=j, size=sa[i] if i else [], size2=sb[j] if j else [], every=[e[2] for e in edges])

        left = labelled.withColumn("n1", F.col("node")).withColumn("n2", F.explode(F.filter("nodes", lambda m: m > F.col("node")))).select(*cols)
        right = labelled.withColumn("n2", F.col("node")).withColumn("n1", F.explode(F.filter("nodes", lambda m: m < F.col("node")))).select(*(F.col(c).alias(f"r_{c}") for c in cols))
        pairs = left.groupBy(*cols[:3]).cogroup(right.groupBy(*(f"r_{c}" for c in cols[:3])))
        facts = facts.unionByName(pairs.applyInArrow(node_pair, _STEP))

    def join_leaves(key: tuple, t: pa.Table) -> pa.Table:
        # A row for each leaf of three or more rows and each edge kept (see _compact), as numbers.
        c = {k: t.column(k).fill_null(0).to_numpy() for k in ("kind", "node", "leaf", "node2", "leaf2", "size", "size2")}
        every = t.column("every").fill_null(False).to_numpy()
        edge = c["kind"] == _EDGE
        one, two = (c[n].astype(np.int64) << 32 | c[k] for n, k in (("node", "leaf"), ("node2", "leaf2")))
        names, place = np.unique(np.concatenate([one, two[edge]]), return_inverse=True)
        size = np.zeros(len(names), np.int64)
        size[place] = np.concatenate([c["size"], c["size2"][edge]])
        cluster = clusters_of(size, place[: len(one)][edge], place[len(one) :], every[edge])
        found = np.flatnonzero(cluster >= 0)
        return pa.table({"tenant_id": pa.array([key[0].as_py()] * len(found), pa.string()), "node": (names[found] >> 32).astype(np.int32), "leaf": (names[found] & 0xFFFFFFFF).astype(np.int32), "cluster": cluster[found].astype(np.int32)})

    joined = facts.groupBy("tenant_id").applyInArrow(join_leaves, "tenant_id string, node int, leaf int, cluster int")
    members = steps.where(F.col("kind") == _MEMBER).select("tenant_id", "node", "leaf", "id").join(joined, ["tenant_id", "node", "leaf"])
    heads = members.groupBy("tenant_id", "cluster").agg(F.min("id").alias("head_id"), F.count(F.lit(1)).alias("size"))
    out = members.join(heads, ["tenant_id", "cluster"]).select("tenant_id", "head_id", "id", "size")
    return out.join(rows.select("tenant_id", "id", "dim", "vec"), ["tenant_id", "id"]) if with_vec else out


def _by_id(step):
    """step on a group whose rows are sorted by id."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        return step(key, t.sort_by("id"))

    return run


#: Clusters of which a task keeps the sums at once.
_HELD_SUMS = 4096


def _centres(members: DataFrame) -> DataFrame:
    """(tenant_id, head_id, centre): the sum of the unit vectors of each cluster's members, first in
    each task, so that a cluster of any size shuffles one sum a task."""
    kind = "tenant_id string, head_id bigint, s array<double>"

    def table(held: dict) -> pa.RecordBatch:
        sums = [v.tolist() for v in held.values()]
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in held], pa.string()), pa.array([h for _, h in held], pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=["tenant_id", "head_id", "s"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            tenant, head = b.column("tenant_id").to_pylist(), b.column("head_id").to_pylist()
            for _, at, x in matrices(b):
                w = x.astype(np.float64)
                w /= np.sqrt(np.einsum("ij,ij->i", w, w))[:, None]
                own: dict[tuple, int] = {}
                place = np.array([own.setdefault((tenant[i], head[i]), len(own)) for i in at])
                sums = np.zeros((len(own), w.shape[1]))
                np.add.at(sums, place, w)
                for key, v in zip(own, sums):
                    held[key] = held[key] + v if key in held else v
            if len(held) > _HELD_SUMS:
                yield table(held)
                held.clear()
        yield table(held)

    def total(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"tenant_id": pa.array([key[0].as_py()], pa.string()), "head_id": pa.array([key[1].as_py()], pa.int64()), "s": pa.array([np.array(t.column("s").to_pylist()).sum(0).tolist()], pa.list_(pa.float64()))})

    parts = members.select("tenant_id", "head_id", "dim", "vec").mapInArrow(partial, kind)
    return parts.groupBy("tenant_id", "head_id").applyInArrow(total, kind).select(F.col("tenant_id").alias("q_tenant"), F.col("head_id").alias("q_head"), F.col("s").alias("centre"))


def cluster_descriptions(members: DataFrame, typical: int = 5) -> DataFrame:
    """(tenant_id, head_id, size, typical_ids): each cluster with the ids of its ``typical`` members
    nearest to its centre, the mean of its members' unit vectors, nearest first (distances to nine
    digits), ties by id. members: as from mutual_clusters with_vec."""
    members = written(members, "clusters-members")
    centres = _centres(members)
    far = F.round(cosine_distance("vec", "centre"), 9)
    placed = members.join(centres, (F.col("tenant_id") == F.col("q_tenant")) & (F.col("head_id") == F.col("q_head"))).select("tenant_id", "head_id", "id", "size", far.alias("q_far"))
    # The rank limit is applied before the shuffle too: each task sends ``typical`` rows a cluster.
    w = Window.partitionBy("tenant_id", "head_id").orderBy("q_far", "id")
    top = placed.withColumn("q_rank", F.row_number().over(w)).where(F.col("q_rank") <= typical)
    return top.groupBy("tenant_id", "head_id").agg(F.first("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("q_far", "id"))), lambda e: e["id"]).alias("typical_ids"))
