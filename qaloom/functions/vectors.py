"""Nearest-neighbour arithmetic on one block of vectors, for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Entries of one distance block (float32): 4 MB, so that a block stays near the core.
BLOCK_ENTRIES = 1_000_000
# Rows of the first slice: the bounds it leaves thin out the slices after it.
FIRST_ROWS = 512
# Norms beyond this are not multiplied in single precision.
MOST_SINGLE = 1e30
# Pairs whose distance is recomputed exactly at a time.
EXACT_PAIRS = 65_536


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column of equal-length vectors as a two-dimensional array; other lengths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty((0, 0))
    sizes = pc.list_value_length(column)
    if sizes.null_count or pc.count_distinct(sizes).as_py() > 1:
        raise ValueError("vectors differ in length or are missing")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def id_values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return np.asarray(column)
    return np.array(column.to_pylist(), dtype=object)


def without_surplus_copies(
    vectors: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Keep the ``k`` lowest ids of equal vectors: no query can want more of them."""
    as_bytes = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.strides[0])))
    group = np.unique(as_bytes.ravel(), return_inverse=True)[1].ravel()
    keep = np.sort(_lowest(group, np.unique(ids, return_inverse=True)[1].ravel(), k))
    return vectors[keep], ids[keep]


def _lowest(group: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` lowest entries by ``order`` in each group."""
    ranked = np.lexsort((order, group))
    sorted_group = group[ranked]
    first = np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])
    place = np.arange(len(ranked)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return ranked[place < k]


class Products:
    """Block products of queries and vectors, in single precision with a rigorous margin.

    ``x = q.v - |v|^2 / 2`` is the greater the nearer: the squared distance is ``|q|^2 - 2x``.
    """

    def __init__(self, queries: np.ndarray, norms: np.ndarray):
        self.queries, self.norms = queries, norms
        self.wide: dict[type, np.ndarray] = {}
        self.single = bool(len(norms)) and norms.max() < MOST_SINGLE

    def _sided(self, rows: np.ndarray, last: np.ndarray | float, kind: type) -> np.ndarray:
        out = np.empty((len(rows), rows.shape[1] + 1), kind)
        out[:, :-1] = rows
        out[:, -1] = last
        return out

    def vectors(self, vectors: np.ndarray, norms: np.ndarray, kind: type) -> np.ndarray:
        return self._sided(vectors, -norms / 2, kind).T

    def kind(self, norms: np.ndarray) -> type:
        return np.float32 if self.single and norms.max() < MOST_SINGLE else np.float64

    def block(self, part: slice, right: np.ndarray) -> np.ndarray:
        kind = right.dtype.type
        if kind not in self.wide:
            self.wide[kind] = self._sided(self.queries, 1.0, kind)
        return self.wide[kind][part] @ right

    def margin(self, part: slice, most: float, kind: type) -> np.ndarray:
        """What a product may be off by: twice the bound on the rounding of a sum of its terms."""
        width = self.queries.shape[1]
        size = np.sqrt(self.norms[part] * most) + most / 2
        return (width + 8) * np.finfo(kind).eps * size + 1e-10 * (1.0 + self.norms[part] + most)


def _over(x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the products that reach their row's least."""
    kind = x.dtype.type
    # Rounded down, so that no product is lost to the threshold's own rounding.
    least = (least - np.abs(np.where(np.isfinite(least), least, 0.0)) * np.finfo(kind).eps).astype(kind)
    at = np.flatnonzero(x >= least[:, None])
    return np.divmod(at, x.shape[1])


class Nearest:
    """Running ``k`` nearest rows for each query, ordered by (distance, id).

    Block products propose candidates; their squared distances are then summed directly
    in double precision, so the result does not depend on how rows were batched. Slices
    grow with the rows seen, so a query meets some ``k`` candidates per doubling.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries = queries
        self.norms = np.einsum("ij,ij->i", queries, queries)
        self.products = Products(queries, self.norms)
        self.k = k
        self.seen = 0
        self.count = np.zeros(len(queries), dtype=np.int64)
        self.best = np.full((len(queries), k), np.inf)
        self.best_ids: np.ndarray | None = None
        self.limit = np.full(len(queries), np.inf)

    @property
    def _held(self) -> np.ndarray:
        return np.arange(self.k) < self.count[:, None]

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.queries)), self.count)

    @property
    def dist(self) -> np.ndarray:
        return self.best[self._held]

    @property
    def ids(self) -> np.ndarray | None:
        return None if self.best_ids is None else self.best_ids[self._held]

    def add(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        if len(vectors) == 0 or len(self.queries) == 0:
            return
        if vectors.shape[1] != self.queries.shape[1]:
            raise ValueError(
                f"vectors of {vectors.shape[1]} and {self.queries.shape[1]} components"
            )
        if self.best_ids is None:
            self.best_ids = np.zeros((len(self.queries), self.k), ids.dtype)
        start = 0
        while start < len(vectors):
            some = slice(start, start + max(FIRST_ROWS, self.seen))
            self._add(vectors[some], ids[some])
            start = some.stop
            self.seen += len(ids[some])

    def add_for(self, some: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Rows that only ``some`` of the queries, by their places, are to meet."""
        if len(some) == 0 or len(vectors) == 0:
            return
        part = Nearest(self.queries[some], self.k)
        part.limit = self.limit[some]
        part.add(vectors, ids)
        if self.best_ids is None:
            self.best_ids = np.zeros((len(self.queries), self.k), ids.dtype)
        self._merge(some[part.row], part.dist, part.ids)

    def _add(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        norms = np.einsum("ij,ij->i", vectors, vectors)
        kind = self.products.kind(norms)
        right = self.products.vectors(vectors, norms, kind)
        thinned = False
        start = 0
        while start < len(self.queries):
            part = slice(start, start + max(1, BLOCK_ENTRIES // len(vectors)))
            rows, cols = self._near(part, right, norms.max())
            if len(rows) > 1000 + 8 * self.k * len(self.queries[part]):
                if not thinned:
                    # Many rows tie: most likely copies of one vector.
                    vectors, ids = without_surplus_copies(vectors, ids, self.k)
                    norms = np.einsum("ij,ij->i", vectors, vectors)
                    right = self.products.vectors(vectors, norms, kind)
                    thinned = True
                    continue
                if kind is np.float32:
                    # Distances far below the norms: single precision does not tell them apart.
                    rows, cols = self._near(part, self.products.vectors(vectors, norms, np.float64), norms.max())
            for s in range(0, len(rows), EXACT_PAIRS):
                r, c = rows[s : s + EXACT_PAIRS], cols[s : s + EXACT_PAIRS]
                diff = self.queries[r] - vectors[c]
                self._merge(r, np.einsum("ij,ij->i", diff, diff), ids[c])
            start = part.stop

    def _near(self, part: slice, right: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) index pairs that may belong to the result."""
        x = self.products.block(part, right)
        off = self.products.margin(part, most, x.dtype.type)
        limit = self.limit[part]
        least = (self.norms[part] - limit) / 2 - off
        if x.shape[1] > self.k and np.isinf(limit).any():
            place = x.shape[1] - self.k
            least = np.maximum(least, np.partition(x, place, axis=1)[:, place] - 2 * off)
        rows, cols = _over(x, least)
        return rows + part.start, cols

    def _merge(self, rows: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        near = ~(dist > self.limit[rows])
        rows, dist, ids = rows[near], dist[near], ids[near]
        if not len(rows):
            return
        touched = np.unique(rows)
        held = np.arange(self.k) < self.count[touched, None]
        rows = np.concatenate([np.repeat(touched, self.count[touched]), rows])
        dist = np.concatenate([self.best[touched][held], dist])
        ids = np.concatenate([self.best_ids[touched][held], ids])
        by_id = np.unique(ids, return_inverse=True)[1].ravel() if ids.dtype == object else ids
        ranked = np.lexsort((by_id, dist, rows))
        new = np.append(True, rows[ranked][1:] != rows[ranked][:-1])
        place = np.arange(len(ranked)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        ranked, place = ranked[place < self.k], place[place < self.k]
        self.best[rows[ranked], place] = dist[ranked]
        self.best_ids[rows[ranked], place] = ids[ranked]
        self.count[touched] = np.bincount(np.searchsorted(touched, rows[ranked]), minlength=len(touched))
        full = touched[self.count[touched] == self.k]
        self.limit[full] = self.best[full, self.k - 1]


class Bounded:
    """Passages that may be among the ``k`` nearest of each query, by bounds on their distance.

    Distances here are not squared. ``limit`` is the k-th least upper bound seen so far; a
    row stays while its lower bound is within it.
    """

    # Rows held per query before those beyond the limit are let go.
    HELD = 64

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.norms = np.einsum("ij,ij->i", queries, queries)
        self.products = Products(queries, self.norms)
        self.limit = np.full(len(queries), np.inf)
        self.high = np.full((len(queries), k), np.inf)
        self.parts: list[tuple] = []
        self.held = self.seen = 0

    def add(self, points: np.ndarray, slack: np.ndarray, same: np.ndarray, ids: np.ndarray) -> None:
        if points.shape[1] != self.queries.shape[1]:
            raise ValueError(f"vectors of {points.shape[1]} and {self.queries.shape[1]} components")
        start = 0
        while start < len(points):
            some = slice(start, start + max(FIRST_ROWS, self.seen))
            self._add(points[some], slack[some], same[some], ids[some])
            start = some.stop
            self.seen += len(ids[some])
        if self.held > self.HELD * self.k * len(self.queries):
            self._prune()
            self.HELD = max(self.HELD, 2 * self.held // (self.k * len(self.queries)) + 1)

    def _add(self, points: np.ndarray, slack: np.ndarray, same: np.ndarray, ids: np.ndarray) -> None:
        norms = np.einsum("ij,ij->i", points, points)
        kind = self.products.kind(norms)
        right = self.products.vectors(points, norms, kind)
        thinned = False
        start = 0
        while start < len(self.queries):
            part = slice(start, start + max(1, BLOCK_ENTRIES // len(points)))
            rows, cols = self._near(part, right, norms.max(), slack.max())
            if len(rows) > 1000 + 8 * self.k * len(self.queries[part]) and not thinned:
                # Many rows tie: the lowest ids of each vector's copies are all a query can want.
                group = np.unique(np.stack([same, slack.view(np.int64)]), axis=1, return_inverse=True)[1].ravel()
                keep = np.sort(_lowest(group, np.unique(ids, return_inverse=True)[1].ravel(), self.k))
                points, slack, same, ids, norms = points[keep], slack[keep], same[keep], ids[keep], norms[keep]
                right = self.products.vectors(points, norms, kind)
                thinned = True
                continue
            for s in range(0, len(rows), EXACT_PAIRS):
                self._keep(rows[s : s + EXACT_PAIRS], cols[s : s + EXACT_PAIRS], points, slack, same, ids, norms.max())
            start = part.stop

    def _near(self, part: slice, right: np.ndarray, most: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) index pairs whose lower bound may be within the limit."""
        x = self.products.block(part, right)
        off = self.products.margin(part, most, x.dtype.type)
        limit = self.limit[part]
        if x.shape[1] > self.k and np.isinf(limit).any():
            place = x.shape[1] - self.k
            kth = self.norms[part] - 2 * (np.partition(x, place, axis=1)[:, place] - off)
            limit = np.minimum(limit, np.sqrt(np.maximum(kth, 0.0) + off) + slack)
        rows, cols = _over(x, (self.norms[part] - (limit + slack) ** 2) / 2 - 2 * off)
        return rows + part.start, cols

    def _keep(self, rows: np.ndarray, cols: np.ndarray, points: np.ndarray, slack: np.ndarray, same: np.ndarray, ids: np.ndarray, most: float) -> None:
        diff = self.queries[rows] - points[cols]
        squared = np.einsum("ij,ij->i", diff, diff)
        # Far above the rounding error of the sum.
        off = 1e-10 * (1.0 + self.norms[rows] + most)
        high = np.sqrt(squared + off) + slack[cols]
        low = np.maximum(np.sqrt(np.maximum(squared - off, 0.0)) - slack[cols], 0.0)
        touched = np.unique(rows)
        of = np.concatenate([np.repeat(touched, self.k), rows])
        best = np.concatenate([self.high[touched].ravel(), high])
        least = _lowest(of, best, self.k)
        self.high[touched] = best[least].reshape(-1, self.k)
        self.limit[touched] = self.high[touched].max(axis=1)
        near = low <= self.limit[rows]
        found = (rows[near], ids[cols[near]], low[near], high[near], same[cols[near]])
        self.parts.append(self._thinned(found))
        self.held += len(self.parts[-1][0])

    def _thinned(self, found: tuple) -> tuple:
        """At most the ``k`` lowest ids of the copies of a vector: no query can want more."""
        row, ids, low, high, same = found
        if len(row) <= self.k:
            return found
        order = np.unique(ids, return_inverse=True)[1].ravel()
        group = np.unique(np.stack([row, same, low.view(np.int64)]), axis=1, return_inverse=True)[1].ravel()
        keep = np.sort(_lowest(group, order, self.k))
        return tuple(x[keep] for x in found)

    def _prune(self) -> None:
        whole = tuple(np.concatenate(x) for x in zip(*self.parts))
        near = whole[2] <= self.limit[whole[0]]
        self.parts = [self._thinned(tuple(x[near] for x in whole))]
        self.held = len(self.parts[0][0])

    def rows(self) -> tuple:
        """Query number, id, lower and upper bound, and hash of every row that is left."""
        if not self.parts:
            none = np.empty(0)
            return none.astype(np.int64), none, none, none, none.astype(np.int64)
        self._prune()
        return self.parts[0]
