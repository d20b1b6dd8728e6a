"""Most similar vectors (problem 2) by multi-index hashing.

Vectors become binary codes by rotations learned from a bounded sample: of their principal
coordinates, so that each bit carries the same variance, cut at its median. A code is cut into
substrings of 16 bits, each with an index of its own. If two codes differ in at most R bits, some substring differs in at most
R // substrings bits, so looking up every substring value that near finds every code within R.
Found codes are compared by bit count, and those within the radius by their floats.

Close pairs need a radius that no close pair exceeds. Whether the learned rotation keeps it is
measured in every block on rows moved by the limit; where it doesn't (few rows, narrow or
low-rank groups), drawn rotations take its place: a drawn plane parts two vectors at angle a with
probability a / pi whatever the data are, so that 256 bits of pairs at cosine distance 0.01 differ
in 11.5 bits on average and in more than 31 once in about ten million pairs. Pairs of 32 to
PAIR_BITS bits are taken too if some substring finds them, as nearly always.

Close pairs of more than CELL_ROWS vectors are sought cell by cell (see cells), as the vectors of a
tenant come in groups, within which one code for all of them tells little apart. Of a tenant with
more than BLOCK_ROWS vectors only the codes go to the cells' tasks, and the found pairs are settled
by their floats afterwards; a smaller one goes to one task with its floats.

For the k nearest, tenants with more than BLOCK_ROWS vectors are split into blocks by the signs of their first
principal coordinates. Queries go to every block that their k-th distance so far doesn't rule out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverlake.llm.cells import CELL_BITS, Cells, cell_pairs, learn_cells, margin_of
from quiverlake.llm.vectors import current_vectors, latest, matrices, matrix, partitions_of, sized, unit, usable_rows, written
from quiverlake.operators.sampling import hashed_sample

#: Rows of the sample from which each dim's rotations are learned.
SAMPLE_ROWS = 8192
#: Vectors of a tenant in one block, about.
BLOCK_ROWS = 32768
#: Bits by which a tenant is split at most.
MAX_SPLIT = 24
#: Vectors beyond which close pairs are sought cell by cell.
CELL_ROWS = 4096
#: Rows of the sample from which a tenant's cells are learned, and of all these samples together.
CELL_SAMPLE = 8192
CELL_SAMPLES = 200_000
#: Candidates that are sent to all executors, to pick the rows by which they are settled.
SENT_IDS = 1_000_000
SUBSTRING = 16
#: Bits of a code, a multiple of 64.
BITS = 256
#: Code distance up to which substrings that differ in one bit find every pair.
PAIR_RADIUS = 2 * (BITS // SUBSTRING) - 1
#: Code distance up to which pairs are compared by their floats.
PAIR_BITS = 40
#: Rows of a block on which the learned rotation is tried.
TRIED_ROWS = 256
#: A block whose lookups would give more than this share of its pairs is compared by products.
DENSE_SHARE = 0.5
#: Rows of a leaf, the unit in which a block is compared by products, and columns of one product.
LEAF_ROWS = 512
PRODUCT_COLUMNS = 8192
#: Candidate pairs expanded at once.
CHUNK = 1 << 21
#: Largest number of bits by which a looked-up substring may differ from a query's.
PROBE_RADIUS = 3
#: Codes reranked by their floats for each neighbour wanted.
RERANK = 60


@dataclass
class Rotation:
    """Codes of one dim: signs of x @ planes - offsets, or of x @ drawn; the axes split blocks."""

    mean: np.ndarray
    axes: np.ndarray  # dim x splits, orthonormal, largest variance first
    cuts: np.ndarray  # of the axes' coordinates
    planes: np.ndarray  # dim x bits, learned
    offsets: np.ndarray  # of the planes
    drawn: np.ndarray  # dim x bits, from random rotations

    def codes(self, x: np.ndarray, learned: bool = True) -> np.ndarray:
        """Codes of unit vectors as rows of 64-bit words."""
        bits = x @ self.planes > self.offsets if learned else x @ self.drawn > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def coordinates(self, x: np.ndarray, n: int) -> np.ndarray:
        return (x - self.mean) @ self.axes[:, :n] - self.cuts[:n]

    def keeps(self, x: np.ndarray, limit: float, seed: int = 3) -> bool:
        """Whether the learned codes of rows at cosine distance limit stay well within PAIR_BITS and
        have a substring by which they are found: tried on up to TRIED_ROWS rows of x moved in random directions and towards other rows."""
        rng = np.random.default_rng(seed)
        own = x[rng.permutation(len(x))[:TRIED_ROWS]].astype(np.float64)
        code = self.codes(own.astype(np.float32))
        for to in (rng.standard_normal(own.shape), own[rng.permutation(len(own))]):
            side = to - np.einsum("ij,ij->i", to, own)[:, None] * own
            length = np.sqrt(np.einsum("ij,ij->i", side, side))
            side = side[length > 1e-6] / length[length > 1e-6, None]
            moved = (1 - limit) * own[length > 1e-6] + np.sqrt(limit * (2 - limit)) * side
            apart = self.codes(moved.astype(np.float32)) ^ code[length > 1e-6]
            bits = np.bitwise_count(apart).sum(1)
            least = np.bitwise_count(apart.view(np.uint16)).min(1, initial=0)
            if len(bits) and (least.max() > 1 or bits.mean() + 6 * max(bits.std(), np.sqrt(bits.mean())) > PAIR_BITS):
                return False
        return True


def _drawn(rng: np.random.Generator, d: int) -> np.ndarray:
    q, r = np.linalg.qr(rng.standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _even(covariance: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The rotation r turned, two columns at a time, until all columns carry the same variance."""
    r = r.copy()
    c = r.T @ covariance @ r
    mean = np.trace(c) / len(c)
    for _ in range(len(c) - 1):
        v = np.diag(c)
        i, j = int(v.argmax()), int(v.argmin())
        if v[i] - v[j] <= 1e-9 * mean:
            break
        # The tangent of the angle at which column i has the mean variance.
        low = v[j] - mean
        t = (-c[i, j] - np.sqrt(max(0.0, c[i, j] ** 2 - low * (v[i] - mean)))) / low
        turn = np.array([[1.0, -t], [t, 1.0]]) / np.sqrt(1 + t * t)
        r[:, [i, j]] = r[:, [i, j]] @ turn
        c[:, [i, j]] = c[:, [i, j]] @ turn
        c[[i, j]] = turn.T @ c[[i, j]]
    return r


def learn_rotation(x: np.ndarray, margin: float, seed: int = 7) -> Rotation:
    """Rotations for unit vectors x, as many as fill BITS, and as many drawn ones."""
    d = x.shape[1]
    mean = x.mean(0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=len(x) < d)
    axes = vt.T.astype(np.float32)
    y = (x - mean) @ axes
    spread = np.cov(y.T).reshape(d, d) if len(x) > 1 else np.zeros((d, d))
    rng = np.random.default_rng(seed)
    drawn = [_drawn(rng, d) for _ in range(-(-BITS // d))]
    planes = np.hstack([axes @ _even(spread, r) for r in drawn])[:, :BITS].astype(np.float32)
    splits = min(MAX_SPLIT, d)
    cuts = np.zeros(splits, np.float32)
    for k in range(splits):
        # Of the cuts that leave 30 % on either side, the one with fewest rows in its margin.
        v = np.sort(y[:, k])
        tries = v[int(0.3 * len(v)) : max(int(0.3 * len(v)) + 1, int(0.7 * len(v)))]
        inside = np.searchsorted(v, tries + margin, "right") - np.searchsorted(v, tries, "right")
        cuts[k] = tries[inside.argmin()]
    return Rotation(mean.astype(np.float32), axes[:, :splits], cuts, planes, np.median(x @ planes, axis=0).astype(np.float32), np.hstack(drawn)[:, :BITS].astype(np.float32))


def learn_rotations(rows: DataFrame, margin: float, sample_rows: int = SAMPLE_ROWS) -> dict[int, Rotation]:
    """A rotation for each dim, from its sample_rows usable rows with the smallest hashes."""
    picked: dict[int, Rotation] = {}
    for dim, n in sorted(tuple(r) for r in rows.groupBy("dim").count().collect()):
        own = hashed_sample(rows.where(F.col("dim") == dim).select("tenant_id", "id", "vec"), sample_rows, n).select("vec").toArrow()
        picked[dim] = learn_rotation(unit(matrix(own.column(0), dim)), margin)
    return picked


def _flips(radius: int) -> np.ndarray:
    """Substring patterns of at most ``radius`` set bits."""
    all16 = np.arange(1 << SUBSTRING, dtype=np.uint32)
    return all16[np.bitwise_count(all16) <= radius].astype(np.uint16)


class CodeIndex:
    """Codes, and for each substring their order and where each of its values starts."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = codes.view(np.uint16)
        n, m = self.parts.shape
        self.direct = n >= 4096  # starts by value; fewer codes are found by bisection
        self.orders = np.argsort(self.parts, axis=0, kind="stable").T.copy()
        self.keys = np.take_along_axis(self.parts.T, self.orders, axis=1)
        if self.direct:
            self.counts = np.stack([np.bincount(self.parts[:, s], minlength=1 << SUBSTRING) for s in range(m)])
            self.starts = np.zeros((m, (1 << SUBSTRING) + 1), np.int64)
            np.cumsum(self.counts, axis=1, out=self.starts[:, 1:])

    def _range(self, s: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows with the given values of substring s start and end in its order."""
        if self.direct:
            keys = keys.astype(np.int64)
            return self.starts[s][keys], self.starts[s][keys + 1]
        return np.searchsorted(self.keys[s], keys, "left"), np.searchsorted(self.keys[s], keys, "right")

    def expected(self) -> float:
        """Number of pairs that ``pairs`` expands."""
        if not self.direct:
            total = 0
            for s, keys in enumerate(self.keys):
                for f in np.array([0, *(1 << np.arange(SUBSTRING))], np.uint16):
                    lo, hi = self._range(s, keys ^ f)
                    total += int((hi - lo).sum()) - (len(keys) if f == 0 else 0)
            return total / 2
        c = self.counts.astype(np.float64)
        at = np.arange(1 << SUBSTRING)
        return float((c * (c - 1)).sum() / 2 + sum((c * c[:, at ^ (1 << f)]).sum() for f in range(SUBSTRING)) / 2)

    def pairs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (a, b), in chunks, of pairs with a substring that differs in one bit at most, if
        they are at most ``most`` bits apart. By the pigeonhole principle these are all pairs less
        than 2 * substrings bits apart, and some more; a pair comes once for each such substring."""
        n, m = self.parts.shape
        at = np.arange(n)
        for s in range(m):
            keys = self.keys[s]
            yield from self._joined(s, at, at + 1, self._range(s, keys)[1], most)
            for f in (1 << np.arange(SUBSTRING)).astype(np.uint16):
                some = np.flatnonzero(keys & f == 0)  # of two neighbours, the one without the bit looks the other up
                yield from self._joined(s, some, *self._range(s, keys[some] ^ f), most)

    def _joined(self, s: int, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the rows at ``at`` with those from lo to hi, all in terms of substring s's order."""
        order = self.orders[s]
        some = hi > lo
        at, lo, sizes = at[some], lo[some], (hi - lo)[some]
        ends = np.cumsum(sizes)
        i = 0
        while i < len(at):
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            own = sizes[i:j]
            a = order[np.repeat(at[i:j], own)]
            b = order[np.arange(own.sum()) + np.repeat(lo[i:j] - (ends[i:j] - own - base), own)]
            apart = np.bitwise_count(self.codes[a, 0] ^ self.codes[b, 0])
            for w in range(1, self.codes.shape[1]):
                near = np.flatnonzero(apart <= most)  # most pairs are told apart by their first words
                a, b, apart = a[near], b[near], apart[near]
                apart = apart + np.bitwise_count(self.codes[a, w] ^ self.codes[b, w])
            near = apart <= most
            if near.any():
                yield a[near], b[near]
            i = j

    def lookup(self, code: np.ndarray, flips: np.ndarray) -> np.ndarray:
        """Rows that agree with a query's substrings up to one of the flips in any place."""
        n, m = self.parts.shape
        seen = np.zeros(n, bool)
        for s, part in enumerate(code.view(np.uint16)):
            lo, hi = self._range(s, part ^ flips)
            some = hi > lo
            lo, sizes = lo[some], (hi - lo)[some]
            if len(lo):
                ends = np.cumsum(sizes)
                seen[self.orders[s][np.arange(ends[-1]) + np.repeat(lo - (ends - sizes), sizes)]] = True
        return np.flatnonzero(seen)


def cosine_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of float64 unit rows, pair by pair; the same whichever comes first."""
    return np.round(1.0 - np.einsum("ij,ij->i", a, b), 12)


def _leaves(x: np.ndarray) -> list[np.ndarray]:
    """Rows of x in leaves of at most LEAF_ROWS: halved along their widest direction, about."""
    done, open_ = [], [np.arange(len(x))]
    while open_:
        at = open_.pop()
        if len(at) <= LEAF_ROWS:
            done.append(at)
            continue
        y = x[at] - x[at].mean(0)
        v = y[np.einsum("ij,ij->i", y, y).argmax()]
        for _ in range(4):
            v = v / max(float(np.linalg.norm(v)), 1e-30)
            v = (y @ v) @ y
        order = np.argsort(y @ v, kind="stable")
        open_ += [at[order[len(at) // 2 :]], at[order[: len(at) // 2]]]
    return done


def close_pairs(x: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b), in chunks, among which is every pair of float32 unit rows x that are each
    other's or one the other's nearest, at cosine distance up to limit; pairs come once.

    Products in float32 are off by the error bound of a sum of dim terms at most; what lies within
    it of a row's nearest so far is a candidate.
    """
    if len(x) < 2:
        return
    slack = 2.0 * (x.shape[1] + 8) * 2.0**-24
    leaves = _leaves(x)
    x = x[order := np.concatenate(leaves)]
    ends = np.cumsum([len(k) for k in leaves])
    starts = ends - [len(k) for k in leaves]
    centres = np.array([x[s:e].mean(0, dtype=np.float64) for s, e in zip(starts, ends)])
    radii = np.array([np.sqrt(((x[s:e] - c) ** 2).sum(1).max()) for s, e, c in zip(starts, ends, centres)])
    reach = np.sqrt(2 * (limit + slack)) + 1e-4
    nearest = np.full(len(x), np.float32(limit + slack), np.float32)  # distance up to which a row takes candidates
    for i, (s, e) in enumerate(zip(starts, ends)):
        apart = np.sqrt(((centres[i:] - centres[i]) ** 2).sum(1)) - radii[i:] - radii[i]
        cols = np.concatenate([np.arange(starts[j], ends[j]) for j in i + np.flatnonzero(apart <= reach)])
        for at in range(0, len(cols), PRODUCT_COLUMNS):
            own = cols[at : at + PRODUCT_COLUMNS]
            d = 1 - x[s:e] @ x[own].T
            a, b = np.nonzero(d <= np.float32(limit + slack))
            keep = own[b] > s + a
            a, b, d = s + a[keep], own[b[keep]], d[a[keep], b[keep]]
            np.minimum.at(nearest, a, d + np.float32(slack))
            np.minimum.at(nearest, b, d + np.float32(slack))
            keep = (d <= nearest[a]) | (d <= nearest[b])
            if keep.any():
                yield order[a[keep]], order[b[keep]]


def coded_pairs(x: np.ndarray, limit: float, rotation: Rotation) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit rows x, in chunks, that their codes put near enough for cosine distance limit.

    Where even the codes would give more than DENSE_SHARE of all pairs (thousands of rows in one
    narrow cone), products of the rows give them at less cost.
    """
    if len(x) > CELL_ROWS:
        return _pairs_by_cells(x, limit)
    index = CodeIndex(rotation.codes(x, rotation.keeps(x, limit)))
    if index.expected() > DENSE_SHARE * len(x) ** 2 / 2:
        return close_pairs(x, limit)
    return index.pairs(PAIR_BITS)


def _pairs_by_cells(x: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    margin = margin_of(limit)
    cells = learn_cells(x[np.random.default_rng(5).permutation(len(x))[:CELL_SAMPLE]], len(x), margin)
    for at, cell in zip(cells.place(x), cells.cells):
        own = x[at]
        if cell.coded:
            far = cell.distances(own)
            core = np.flatnonzero(far < cell.inner + margin)
            a, b = cell_pairs(cell.codes(own), core, own[core], far[core] < cell.inner, cell, limit)
            yield at[a], at[b]
        else:
            for a, b in close_pairs(own, limit):
                yield at[a], at[b]


def nearest_within(x: np.ndarray, ids: np.ndarray, limit: float, rotation: Rotation) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the id of its nearest other row (-1 without one) at cosine distance up to
    limit, and that distance. Ties go to the smallest id.

    Exact copies are compared as one: of m copies, m - 1 have the one with the smallest id as their
    nearest, and that one the next.
    """
    n = len(ids)
    best = np.full(n, np.inf)
    who = np.full(n, -1, np.int64)
    order = np.argsort(ids, kind="stable")
    _, group = np.unique(np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    by_group = np.argsort(group.ravel(), kind="stable")
    members = order[by_group]
    starts = np.flatnonzero(np.diff(group.ravel()[by_group], prepend=-1))
    heads = members[starts]
    counts = np.diff(starts, append=n)
    many = counts > 1
    best[heads[many]], who[heads[many]] = 0.0, ids[members[starts[many] + 1]]
    copies = np.setdiff1d(np.arange(n), starts)
    best[members[copies]], who[members[copies]] = 0.0, ids[np.repeat(heads, counts)[copies]]
    wide = _wide(x[heads])
    hid = ids[heads]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for pair in coded_pairs(unit(x[heads]), limit, rotation):
        found.append(pair)
        size += len(pair[0])
        if size > CHUNK:
            _settle(found, wide, hid, heads, limit, best, who)
            size = 0
    _settle(found, wide, hid, heads, limit, best, who)
    return who, best


def _settle(found: list, wide: np.ndarray, hid: np.ndarray, heads: np.ndarray, limit: float, best: np.ndarray, who: np.ndarray) -> None:
    """Rerank found pairs by floats and keep each row's nearest."""
    if not found:
        return
    q, r = (np.concatenate(x) for x in zip(*found))
    found.clear()
    for at in range(0, len(q), 1 << 17):
        a, b = q[at : at + (1 << 17)], r[at : at + (1 << 17)]
        d = cosine_distances(wide[a], wide[b])
        near = d <= limit
        a, b, d = np.concatenate([a[near], b[near]]), np.concatenate([b[near], a[near]]), np.concatenate([d[near], d[near]])
        order = np.lexsort((hid[b], d, a))
        order = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
        i, d, near_id = heads[a[order]], d[order], hid[b[order]]
        closer = (d < best[i]) | ((d == best[i]) & (near_id < who[i]))
        best[i[closer]], who[i[closer]] = d[closer], near_id[closer]


def _wide(x: np.ndarray) -> np.ndarray:
    w = x.astype(np.float64)
    return w / np.sqrt(np.einsum("ij,ij->i", w, w))[:, None]


def nearest_k(x: np.ndarray, ids: np.ndarray, codes: np.ndarray, qx: np.ndarray, qids: np.ndarray, qcodes: np.ndarray, k: int, rerank: int = RERANK) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and distances of its k nearest rows with other ids, nearest first.

    The rerank * k nearest codes are ranked by their floats. The probing radius grows until so many
    codes lie within the code distance up to which probing finds all; beyond PROBE_RADIUS the codes
    (not the vectors) are gone through. Ties go to the smallest id.
    """
    want = min(len(ids), rerank * k)
    wide, qwide = _wide(x), _wide(qx)
    index = CodeIndex(codes)
    flips = [_flips(r) for r in range(PROBE_RADIUS + 1)]
    m = index.parts.shape[1]
    first = 0  # queries of one block are alike: one starts at about the radius the one before needed
    out = []
    for query, own, code in zip(qwide, qids, qcodes):
        for r in range(first, PROBE_RADIUS + 2):
            rows = index.lookup(code, flips[r]) if r <= PROBE_RADIUS else np.arange(len(ids))
            bits = np.bitwise_count(codes[rows] ^ code).sum(1, dtype=np.uint16)
            if r > PROBE_RADIUS or (bits < m * (r + 1)).sum() >= want:
                break
        first = max(0, r - (len(rows) > 8 * want))
        reach = np.partition(bits, want - 1)[want - 1] if want else 0
        rows = rows[bits <= reach]
        rows = rows[ids[rows] != own]
        d = np.round(1.0 - wide[rows] @ query, 12)
        order = np.lexsort((ids[rows], d))[:k]
        out.append((ids[rows[order]], d[order]))
    return out


def _crossed(y: np.ndarray, p: np.ndarray, budget: np.ndarray, one_way: bool) -> list[list[int]]:
    """Block numbers of each row: its own first, then those across planes whose squared distances
    add up to no more than the row's budget. y: coordinates, p: split bits of each row. one_way:
    only to the lower side of a plane."""
    row = np.arange(len(y))
    code = np.zeros(len(y), np.int64)
    for b in range(y.shape[1]):
        code |= ((y[:, b] > 0) & (b < p)).astype(np.int64) << b
    cost = np.zeros(len(y))
    for b in range(y.shape[1]):
        step = y[row, b].astype(np.float64) ** 2
        over = np.flatnonzero((b < p[row]) & (cost + step <= budget[row]) & ((y[row, b] > 0) | (not one_way)))
        row, code, cost = np.concatenate([row, row[over]]), np.concatenate([code, code[over] ^ (1 << b)]), np.concatenate([cost, (cost + step)[over]])
    order = np.argsort(row, kind="stable")
    cuts = np.cumsum(np.bincount(row, minlength=len(y)))[:-1]
    return [c.tolist() for c in np.split(code[order], cuts)]


def _splits(rows: DataFrame, block_rows: int) -> DataFrame:
    """(tenant_id, splits): bits by which each tenant is split."""
    bits = F.least(F.lit(MAX_SPLIT), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / block_rows)))).cast("int")
    return rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).select("tenant_id", bits.alias("splits"))


def _blocked(rows: DataFrame, rotations: dict[int, Rotation], budget, one_way: bool) -> DataFrame:
    """rows, with column splits, with the ``blocks`` that each meets: see _crossed. budget: a
    squared distance as a column (null: 0)."""
    given = rows.withColumn("q_budget", F.coalesce(budget, F.lit(0.0)))
    shared = rows.sparkSession.sparkContext.broadcast(rotations)  # a few matrices for each dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks: list = [[0]] * b.num_rows
            splits = b.column("splits").to_numpy(zero_copy_only=False)
            most = b.column("q_budget").to_numpy(zero_copy_only=False)
            if splits.any():
                for dim, at, x in matrices(b):
                    p = np.minimum(splits[at], dim)
                    y = shared.value[dim].coordinates(unit(x), int(p.max()))
                    for i, o in zip(at, _crossed(y, p, most[at], one_way)):
                        blocks[i] = o
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks, pa.list_(pa.int32()))], names=[*b.schema.names, "blocks"])

    return given.mapInArrow(run, T.StructType([*given.schema.fields, T.StructField("blocks", T.ArrayType(T.IntegerType()))])).drop("q_budget")


_PAIR = "tenant_id string, id bigint, near_id bigint, distance double"


def _learn_cells(rows: DataFrame, block_rows: int, limit: float) -> dict[str, Cells]:
    """The cells of each tenant with more than block_rows rows."""
    sizes = {r["tenant_id"]: r["n"] for r in rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).collect()}
    if not sizes:
        return {}
    each = max(1, min(CELL_SAMPLE, CELL_SAMPLES // len(sizes)))
    part = rows.sparkSession.createDataFrame([(t, min(1 << 30, int(each / n * (1 << 30)) + 1)) for t, n in sizes.items()], "tenant_id string, q_part int")
    picked = rows.join(F.broadcast(part), "tenant_id").where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) < F.col("q_part"))
    found = {t: learn_cells(np.zeros((0, 1), np.float32), n, margin_of(limit)) for t, n in sizes.items()}
    for own in picked.select("tenant_id", "dim", "vec").toArrow().combine_chunks().to_batches():
        names = own.column("tenant_id").to_numpy(zero_copy_only=False)
        for t in np.unique(names):
            at = np.flatnonzero(names == t)
            x = matrix(own.column("vec").take(pa.array(at)), own.column("dim")[int(at[0])].as_py())
            found[t] = learn_cells(unit(x), sizes[t], margin_of(limit))
    return found


def _celled(rows: DataFrame, cells: dict[str, Cells]) -> DataFrame:
    """tenant_id, block, dim, id, copy (a hash of the vector), vec, code and inner of current rows in
    each cell that they meet. Rows of coded cells have a vec only in the core; other rows have no code."""
    given = rows.select("tenant_id", F.col("dim").cast("int").alias("dim"), "id", F.xxhash64("vec").alias("copy"), "vec")
    if not cells:
        return given.withColumns({"block": F.lit(0), "code": F.lit(b""), "inner": F.lit(False)})
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("tenant_id").to_numpy(zero_copy_only=False)
            parts = [(np.flatnonzero(~np.isin(names, list(shared.value))), 0, None, None)]
            for t in set(names) & set(shared.value):
                own = np.flatnonzero(names == t)
                x = unit(matrix(b.column("vec").take(pa.array(own)), b.column("dim")[int(own[0])].as_py()))
                for k, at in enumerate(shared.value[t].place(x)):
                    cell = shared.value[t].cells[k]
                    parts.append((own[at], k, cell.codes(x[at]), cell.distances(x[at]) - cell.inner) if cell.coded and len(at) else (own[at], k, None, None))
            src = np.concatenate([p[0] for p in parts])
            far = np.concatenate([np.full(len(p[0]), -np.inf) if p[3] is None else p[3] for p in parts])
            coded = np.repeat([p[2] is not None for p in parts], [len(p[0]) for p in parts])
            code = b"".join(p[2].tobytes() for p in parts if p[2] is not None)
            ends = np.concatenate([[0], np.cumsum(coded * (CELL_BITS // 8))]).astype(np.int32)
            rest = {
                "vec": b.column("vec").take(pa.array(src, mask=far >= margin)),
                "block": pa.array(np.repeat([p[1] for p in parts], [len(p[0]) for p in parts]).astype(np.int32)),
                "code": pa.Array.from_buffers(pa.binary(), len(src), [None, pa.py_buffer(ends), pa.py_buffer(code)]),
                "inner": pa.array(coded & (far < 0)),
            }
            yield pa.RecordBatch.from_pydict({k: b.column(k).take(pa.array(src)) for k in ("tenant_id", "dim", "id", "copy")} | rest)

    margin = next(iter(cells.values())).margin
    return given.mapInArrow(run, "tenant_id string, dim int, id bigint, copy bigint, vec array<float>, block int, code binary, inner boolean")


def _candidates(t: pa.Table, cells: Cells, block: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, near_id, distance) of a coded cell: copies, and with a NaN what is to be settled."""
    t = t.combine_chunks()
    ids = t.column("id").to_numpy()
    code = t.column("code").chunk(0)
    begin, end = np.frombuffer(code.buffers()[1], np.int32)[[code.offset, code.offset + len(code)]]
    codes = np.frombuffer(code.buffers()[2], np.uint8)[begin:end].view(np.uint64).reshape(len(ids), -1)
    copy = t.column("copy").to_numpy()
    order = np.lexsort((ids, codes[:, 0], copy))
    same = (np.diff(copy[order]) == 0) & (codes[order[1:], 0] == codes[order[:-1], 0])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    counts = np.diff(first, append=len(ids))
    heads, many = order[first], counts > 1
    others = np.delete(order, first)
    vec = t.column("vec").chunk(0)
    held = np.flatnonzero(vec.is_valid().to_numpy(zero_copy_only=False)[heads])
    x = unit(matrix(vec.take(pa.array(heads[held])), t.column("dim")[0].as_py()))
    inner = t.column("inner").to_numpy()[heads[held]]
    a, b = cell_pairs(codes[heads], held, x, inner, cells.cells[block], limit)
    own = ids[np.concatenate([heads[many], others, heads[a]])]
    near = ids[np.concatenate([order[first[many] + 1], np.repeat(heads, counts - 1), heads[b]])]
    return own, near, np.concatenate([np.zeros(many.sum() + len(others)), np.full(len(a), np.nan)])


def _settled(open_: DataFrame, rows: DataFrame, limit: float) -> DataFrame:
    """The pairs (tenant_id, id, near_id), both ways and with their distance, that are within limit."""
    pairs = open_.select("tenant_id", F.col("id").alias("q_a"), F.col("near_id").alias("q_b")).distinct()
    ends = pairs.withColumn("id", F.explode(F.array("q_a", "q_b")))
    wanted = ends.select("tenant_id", "id").distinct()
    few = wanted.count() <= SENT_IDS
    picked = latest(rows.join(F.broadcast(wanted) if few else wanted, ["tenant_id", "id"], "left_semi")).select("tenant_id", "id", "dim", "vec")
    vec = lambda c: F.first(F.when(F.col("id") == F.col(c), F.col("vec")), ignorenulls=True)
    both = ends.join(picked, ["tenant_id", "id"]).groupBy("tenant_id", "q_a", "q_b").agg(F.first("dim").alias("dim"), vec("q_a").alias("a"), vec("q_b").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for (dim, at, x), (_, _, y) in zip(matrices(t, "a"), matrices(t, "b")):
                d = cosine_distances(_wide(x), _wide(y))
                at, d = at[d <= limit], d[d <= limit]
                name, a, b = (t.column(c).take(pa.array(at)) for c in ("tenant_id", "q_a", "q_b"))
                for p, q in ((a, b), (b, a)):
                    yield pa.RecordBatch.from_pydict({"tenant_id": name, "id": p, "near_id": q, "distance": pa.array(d)})

    return both.mapInArrow(run, _PAIR)


def near_pairs(vectors: DataFrame, tenants: DataFrame, limit: float = 0.01, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(tenant_id, id, near_id, distance): of each current vector its nearest other one of the
    tenant, if it is at cosine distance up to limit; ties go to the smallest id.

    Candidates come from codes (see the module) and are settled by their floats; limit is at most 0.01,
    for which the codes are made. Null ids and unusable vectors (see usable_rows) have no part.
    Repeated rows count once. Empty tables give no rows.
    """
    if not 0 <= limit <= 0.01:
        raise ValueError("limit must be from 0 to 0.01")
    rows = usable_rows(vectors, tenants)
    rotations = learn_rotations(rows, float(np.sqrt(2 * limit)) * 1.0001)
    if not rotations:
        return rows.sparkSession.createDataFrame([], _PAIR)
    cells = _learn_cells(rows, block_rows, limit)
    shared = rows.sparkSession.sparkContext.broadcast((rotations, cells))
    n = partitions_of(vectors)
    placed = _celled(latest(rows, n), cells)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rotations, cells = shared.value
        tenant, block = key[0].as_py(), key[1].as_py()
        if tenant in cells and cells[tenant].cells[block].coded:
            own, near, distance = _candidates(t, cells[tenant], block, limit)
        else:
            dim = t.column("dim")[0].as_py()
            ids = t.column("id").to_numpy()
            who, best = nearest_within(matrix(t.column("vec"), dim), ids, limit, rotations[dim])
            hit = np.flatnonzero(np.isfinite(best))
            own, near, distance = ids[hit], who[hit], best[hit]
        return pa.table({"tenant_id": pa.array([tenant] * len(own), pa.string()), "id": own, "near_id": near, "distance": distance})

    found = sized(placed, n, "tenant_id", "block").groupBy("tenant_id", "block").applyInArrow(run, _PAIR)
    if cells:
        found = written(found, "near-pairs")
        open_ = F.isnan("distance")
        found = found.where(~open_).unionByName(_settled(found.where(open_), rows, limit))
    nearest = found.groupBy("tenant_id", "id").agg(F.min(F.struct("distance", "near_id")).alias("m"))
    return nearest.select("tenant_id", "id", F.col("m.near_id").alias("near_id"), F.col("m.distance").alias("distance"))


def mutual_pairs(nearest: DataFrame) -> DataFrame:
    """(tenant_id, id_a, id_b), id_a < id_b: pairs that are each other's nearest."""
    a, b = F.least("id", "near_id"), F.greatest("id", "near_id")
    return nearest.groupBy("tenant_id", a.alias("id_a"), b.alias("id_b")).agg(F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


def _looked_up(home: DataFrame, asked: DataFrame, rotations: dict[int, Rotation], k: int, rerank: int) -> DataFrame:
    """(tenant_id, id, near_id, distance): the k nearest of each query in each block. home: tenant_id,
    block, dim, id, vec of the rows; asked: the same of the queries."""
    shared = home.sparkSession.sparkContext.broadcast(rotations)

    def run(key: tuple, h: pa.Table, q: pa.Table) -> pa.Table:
        if not h.num_rows or not q.num_rows:
            return pa.table({"tenant_id": pa.array([], pa.string()), "id": pa.array([], pa.int64()), "near_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        dim = h.column("dim")[0].as_py()
        ids, qids = h.column("id").to_numpy(), q.column("q_id").to_numpy()
        x, qx = matrix(h.column("vec"), dim), matrix(q.column("q_vec"), dim)
        r = shared.value[dim]
        res = nearest_k(x, ids, r.codes(unit(x)), qx, qids, r.codes(unit(qx)), k, rerank)
        n = [len(w) for w, _ in res]
        return pa.table({"tenant_id": pa.array([key[0].as_py()] * sum(n), pa.string()), "id": np.repeat(qids, n).astype(np.int64), "near_id": np.concatenate([w for w, _ in res]).astype(np.int64), "distance": np.concatenate([d for _, d in res])})

    # Many small groups: queries are few, so a block's queries are one group whatever the block's size.
    asked = asked.select(F.col("tenant_id").alias("q_tenant"), F.col("block").alias("q_block"), F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    return home.groupBy("tenant_id", "block").cogroup(asked.groupBy("q_tenant", "q_block")).applyInArrow(run, _PAIR)


def similar_vectors(vectors: DataFrame, tenants: DataFrame, k: int = 10, query_mod: int = 20, block_rows: int = BLOCK_ROWS, rerank: int = RERANK) -> DataFrame:
    """(tenant_id, id, rank, near_id, distance): the k nearest current vectors of the tenant by
    cosine distance for every current vector whose id is divisible by query_mod.

    Approximate: of a block's rows the rerank * k nearest codes are compared by their floats (see
    nearest_k). A query is looked up in its own block, and then in every other block of the tenant that
    its k-th distance doesn't rule out, so that splitting loses nothing. Nulls, repeats and empty
    tables as in near_pairs; a tenant with fewer than k other vectors gives fewer ranks.
    """
    rows = written(current_vectors(vectors, tenants), "similar-vectors")
    rotations = learn_rotations(rows, 0.05)
    if not rotations:
        return rows.sparkSession.createDataFrame([], _PAIR).withColumn("rank", F.lit(1)).select("tenant_id", "id", "rank", "near_id", "distance")
    given = rows.join(_splits(rows, block_rows), "tenant_id")
    home = _blocked(given, rotations, F.lit(0.0), False).select("tenant_id", F.explode("blocks").alias("block"), "dim", "id", "vec")
    queries = given.where(F.col("id") % query_mod == 0)
    first = written(_looked_up(home, _blocked(queries, rotations, F.lit(0.0), False).withColumn("block", F.col("blocks")[0]), rotations, k, rerank), "similar-first")
    # The squared chord of the k-th distance; a block with fewer than k others rules nothing out.
    kth = first.groupBy("tenant_id", "id").agg(F.when(F.count(F.lit(1)) >= k, 2 * F.max("distance") + 1e-6).otherwise(F.lit(4.0)).alias("q_reach"))
    wide = queries.where("splits > 0").join(kth, ["tenant_id", "id"], "left")
    wide = _blocked(wide, rotations, F.coalesce("q_reach", F.lit(4.0)), False)
    others = wide.select("tenant_id", F.explode(F.slice("blocks", 2, 1 << 30)).alias("block"), "dim", "id", "vec")
    found = first.unionByName(_looked_up(home, others, rotations, k, rerank))
    # At most k rows a query and block: the k best are kept by a window, whose limit runs before the shuffle too.
    w = Window.partitionBy("tenant_id", "id").orderBy("distance", "near_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("tenant_id", "id", "rank", "near_id", "distance")


def exact_similar(vectors: DataFrame, tenants: DataFrame, k: int = 10, query_mod: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """similar_vectors by comparing every query with every row of its tenant, block by block; the
    measure of its recall."""
    rows = written(current_vectors(vectors, tenants), "exact-vectors")
    n = rows.groupBy("tenant_id").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("q_n"))
    given = rows.join(n, "tenant_id")
    home = given.select("tenant_id", F.pmod(F.xxhash64("id"), F.col("q_n")).cast("int").alias("block"), "id", "vec")
    asked = given.where(F.col("id") % query_mod == 0).select(F.col("tenant_id").alias("q_tenant"), F.explode(F.sequence(F.lit(0), F.col("q_n") - 1)).alias("q_block"), F.col("dim").alias("q_dim"), F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))

    def run(key: tuple, h: pa.Table, q: pa.Table) -> pa.Table:
        out = []
        if h.num_rows and q.num_rows:
            dim = q.column("q_dim")[0].as_py()
            ids, qids = h.column("id").to_numpy(), q.column("q_id").to_numpy()
            x, qx = _wide(matrix(h.column("vec"), dim)), _wide(matrix(q.column("q_vec"), dim))
            for at in range(0, len(qx), 64):
                d = np.round(1.0 - qx[at : at + 64] @ x.T, 12)
                d[qids[at : at + 64, None] == ids[None]] = np.inf
                for i, own in enumerate(d):
                    near = np.flatnonzero((own <= np.partition(own, min(k, len(own)) - 1)[min(k, len(own)) - 1]) & np.isfinite(own))
                    near = near[np.lexsort((ids[near], own[near]))[:k]]
                    out.append((np.full(len(near), qids[at + i]), ids[near], own[near]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"tenant_id": pa.array([key[0].as_py()] * len(cols[0]), pa.string()), "id": cols[0].astype(np.int64), "near_id": cols[1].astype(np.int64), "distance": cols[2]})

    found = home.groupBy("tenant_id", "block").cogroup(asked.groupBy("q_tenant", "q_block")).applyInArrow(run, _PAIR)
    w = Window.partitionBy("tenant_id", "id").orderBy("distance", "near_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("tenant_id", "id", "rank", "near_id", "distance")
