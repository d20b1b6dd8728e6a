"""Cells of near vectors, and codes seen from their centres, for close pairs (problem 2).

A tenant's vectors come in groups. A tree of planes, learned from a sample, cuts between the groups,
where few rows lie; a row within the margin above a plane goes to both sides, so that two vectors
within the margin of each other always meet in one cell, whatever the sample was.

Within a cell, drawn planes through its centre give the codes. Two vectors at least ``inner`` away
from the centre and within the margin of each other are seen from there at an angle of at most
2 asin(margin / 2 inner), and a drawn plane parts them with that angle / pi as probability whatever
the data are. ``tables`` substrings of ``width`` bits, each looked up with at most one bit changed,
miss such a pair less than once in 1 / MISSED. Rows nearer to the centre are compared by products
with all that may lie within the margin of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Bits of a cell's code, a multiple of 64.
CELL_BITS = 1024
#: Chance of missing a pair at the limit, the rows of which lie just ``inner`` away from the centre.
MISSED = 1e-7
WIDTHS = (16, 18, 20)
#: Rows of a cell, about, below which it isn't cut further, and rows of the sample for a cut.
LEAST_ROWS = 1024
LEAST_SAMPLE = 32
#: Principal axes along which a cut is tried; a cut has to leave less than this share of the pairs.
AXES = 8
GAIN = 0.9
#: Nanoseconds, about, of a lookup, of a pair of codes and of a pair of 64 numbers: these choose the way, not the result.
LOOKUP_NS, CODE_NS, PRODUCT_NS = 110.0, 80.0, 5.0
CHUNK = 1 << 20


@dataclass
class Cell:
    centre: np.ndarray
    coded: bool
    inner: float = 0.0
    width: int = 16
    tables: int = 0

    def distances(self, x: np.ndarray) -> np.ndarray:
        y = x - self.centre
        return np.sqrt(np.einsum("ij,ij->i", y, y))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.centre) @ drawn_planes(x.shape[1]) > 0, axis=1, bitorder="little").view(np.uint64)


@dataclass
class Cells:
    """A tree of planes; kids of a node are nodes, or ~cell."""

    axes: list[np.ndarray]
    cuts: list[float]
    kids: list[list[int]]
    cells: list[Cell]
    margin: float

    def place(self, x: np.ndarray) -> list[np.ndarray]:
        """Numbers of the rows of unit vectors x that meet in each cell."""
        out = [np.zeros(0, np.int64)] * len(self.cells)
        open_ = [(0 if self.axes else ~0, np.arange(len(x)))]
        while open_:
            node, at = open_.pop()
            if node < 0:
                out[~node] = at
            elif len(at):
                v = x[at] @ self.axes[node] - self.cuts[node]
                open_ += [(self.kids[node][0], at[v <= self.margin]), (self.kids[node][1], at[v > 0])]
        return out


@lru_cache(4)
def drawn_planes(d: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    turns = [np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-CELL_BITS // d))]
    signs = [rng.choice([-1.0, 1.0], d) for _ in turns]
    return np.hstack([q * s for q, s in zip(turns, signs)])[:, :CELL_BITS].astype(np.float32)


def margin_of(limit: float) -> float:
    """Largest distance of unit vectors at cosine distance limit, with room for rounding."""
    return float(np.sqrt(2 * limit)) * 1.0001 + 1e-5


def parted(inner: float, margin: float) -> float:
    """Chance at most that a drawn plane parts two rows within margin, inner away from the centre."""
    return 2 * float(np.arcsin(min(1.0, margin / (2 * inner)))) / np.pi if inner > 0 else 1.0


def _tables(inner: float, margin: float, width: int) -> int:
    p = parted(inner, margin)
    found = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return int(np.ceil(np.log(MISSED) / np.log1p(-found))) if 0 < found < 1 else (1 if found >= 1 else 1 << 30)


def _cell(x: np.ndarray, n: float, margin: float) -> Cell:
    """The cell of the sample rows x, which stand for n rows, with its cheapest way."""
    if not len(x):
        return Cell(np.zeros(x.shape[1], np.float32), False)
    centre = x.mean(0, dtype=np.float64).astype(np.float32)
    best, cost = Cell(centre, False), PRODUCT_NS * n * n / 2
    far = np.sort(best.distances(x))
    for width in WIDTHS:
        for inner in np.arange(0.1, 1.0, 0.02):
            tables = _tables(inner, margin, width)
            if tables * width > CELL_BITS:
                continue
            near, core = np.searchsorted(far, [inner, inner + margin]) / len(far)
            own = LOOKUP_NS * n * tables * (1 + width / 2) + CODE_NS * n * n / 2 * tables * (1 + width) / (1 << width) + PRODUCT_NS * near * core * n * n + tables * (1 << width) * 4
            if near < 0.2 and own < cost:
                best, cost = Cell(centre, True, float(inner), width, tables), own
    return best


def learn_cells(x: np.ndarray, n: int, margin: float) -> Cells:
    """Cells for n unit vectors from their sample x."""
    tree = Cells([], [], [], [], margin)
    open_: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
    while open_:
        at, parent, side = open_.pop()
        rows = n * len(at) / max(1, len(x))
        cut = _cut(x[at], margin) if rows >= 2 * LEAST_ROWS and len(at) >= 2 * LEAST_SAMPLE else None
        me = ~len(tree.cells) if cut is None else len(tree.axes)
        if parent >= 0:
            tree.kids[parent][side] = me
        if cut is None:
            tree.cells.append(_cell(x[at], rows, margin))
            continue
        tree.axes.append(cut[0])
        tree.cuts.append(cut[1])
        tree.kids.append([0, 0])
        v = x[at] @ cut[0] - cut[1]
        open_ += [(at[v <= margin], me, 0), (at[v > 0], me, 1)]
    return tree


def _cut(x: np.ndarray, margin: float) -> tuple[np.ndarray, float] | None:
    """Axis and place of the plane that leaves the smallest share of the pairs, if it is under GAIN."""
    n = len(x)
    y = x - x.mean(0)
    _, axes = np.linalg.eigh((y.T @ y).astype(np.float64))
    best, out = GAIN, None
    for axis in axes[:, ::-1][:, :AXES].T.astype(np.float32):
        v = np.sort(x @ axis)
        at = np.arange(max(1, n // 50), n - n // 50)
        low, high = np.searchsorted(v, v[at] + margin, "right") / n, (n - 1 - at) / n  # the cut lies on a row, which stays below
        share = low**2 + high**2
        if len(share) and share.min() < best:
            k = int(share.argmin())
            best, out = float(share[k]), (axis, float(v[at[k]]))
    return out


def _substrings(codes: np.ndarray, s: int, width: int) -> np.ndarray:
    word, shift = divmod(s * width, 64)
    part = codes[:, word] >> np.uint64(shift)
    if shift + width > 64:
        part = part | (codes[:, word + 1] << np.uint64(64 - shift))
    return (part & np.uint64((1 << width) - 1)).astype(np.uint32)


def _most(bits: int, p: float) -> int:
    """Bits that a pair parted with probability p exceeds less than once in a thousand million."""
    return int(np.ceil(bits * p + 6.5 * np.sqrt(bits * p * (1 - p)) + 2))


def code_pairs(codes: np.ndarray, cell: Cell, margin: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b), in chunks, whose codes are near enough for rows within margin, both at least
    cell.inner away from the centre; a pair may come several times."""
    p = parted(cell.inner, margin)
    words = codes.shape[1]
    most = [_most(64 * k, p) for k in (1, 2, words)]
    for s in range(cell.tables):
        keys = _substrings(codes, s, cell.width)
        order = np.argsort(keys, kind="stable").astype(np.int32)
        keys = keys[order]
        starts = np.zeros((1 << cell.width) + 1, np.int32)
        np.cumsum(np.bincount(keys, minlength=1 << cell.width), out=starts[1:])
        other = (s * cell.width // 64 + 2) % words  # words that aren't in the substring
        first, second = codes[order, other], codes[order, (other + 1) % words]
        for f in np.array([0, *(1 << np.arange(cell.width))], np.uint32):
            if f:
                at = np.flatnonzero(keys & f == 0)
                lo, hi = starts[keys[at] ^ f], starts[(keys[at] ^ f) + 1]
            else:
                at = np.arange(len(keys))
                lo, hi = at + 1, starts[keys + 1]
            some = hi > lo
            at, lo, sizes = at[some], lo[some].astype(np.int64), (hi - lo)[some].astype(np.int64)
            ends = np.cumsum(sizes)
            i = 0
            while i < len(at):
                base = ends[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
                own = sizes[i:j]
                b = np.arange(own.sum()) + np.repeat(lo[i:j] - (ends[i:j] - own - base), own)
                bits = np.bitwise_count(np.repeat(first[at[i:j]], own) ^ first[b])
                near = np.flatnonzero(bits <= most[0])
                a, b, bits = at[i + np.searchsorted(ends[i:j], near + base, "right")], b[near], bits[near]
                near = np.flatnonzero(bits + np.bitwise_count(second[a] ^ second[b]) <= most[1])
                a, b = order[a[near]], order[b[near]]
                near = np.bitwise_count(codes[a] ^ codes[b]).sum(1, dtype=np.int64) <= most[2]
                if near.any():
                    yield a[near], b[near]
                i = j


def cell_pairs(codes: np.ndarray, core: np.ndarray, x: np.ndarray, inner: np.ndarray, cell: Cell, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of a coded cell that may be at cosine distance up to limit, each pair once. core:
    the rows within margin of the inner ones; x: their unit vectors; inner: which of them are inner."""
    close = code_pairs(codes, cell, margin_of(limit))
    near = ((core[a], core[b]) for a, b in product_pairs(x, np.flatnonzero(inner), limit))
    return unique_pairs((pair for pairs in (close, near) for pair in pairs), len(codes))


def product_pairs(x: np.ndarray, inner: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b), in chunks, of unit rows x at cosine distance up to limit, a of the rows in
    ``inner``, with room for rounding."""
    least = np.float32(1 - limit - 2.0 * (x.shape[1] + 8) * 2.0**-24)
    for i in range(0, len(inner), 256):
        for j in range(0, len(x), 8192):
            a, b = np.nonzero(x[inner[i : i + 256]] @ x[j : j + 8192].T >= least)
            a, b = inner[i + a], j + b
            if (a != b).any():
                yield a[a != b], b[a != b]


def unique_pairs(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of n rows, each once, the smaller row first."""
    kept, new, size = np.zeros(0, np.int64), [], 0
    for a, b in pairs:
        a, b = a.astype(np.int64), b.astype(np.int64)
        new.append(np.minimum(a, b) * n + np.maximum(a, b))
        size += len(a)
        if size > max(CHUNK, len(kept)):
            kept, new, size = np.unique(np.concatenate([kept, *new])), [], 0
    kept = np.unique(np.concatenate([kept, *new]))
    return kept // n, kept % n
