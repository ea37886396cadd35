"""Distance blocks by matrix products, and the exact k nearest of each row of a block."""

from __future__ import annotations

import heapq

import numpy as np

_GATHER = 4_000_000
#: Bytes of distances that mostly stay in a processor's cache.
_CACHED = 4_000_000


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, summed from the first coordinate to the last."""
    out = np.zeros(len(x))
    for c in range(x.shape[1]):
        t = x[:, c] - y[:, c]
        out += t * t
    return out


def _distances(x: np.ndarray, norm: np.ndarray, y: np.ndarray, y_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """|x|^2 + |y|^2 - 2xy for all pairs of rows, and for each row of x the most that cancellation can be off."""
    dist = x @ y.T
    dist *= -2.0
    dist += y_norm
    dist += norm[:, None]
    return dist, 1e-12 * (norm + y_norm.max()) * (8 + x.shape[1])


def _paired(x: np.ndarray, xid: np.ndarray, rows: np.ndarray, y: np.ndarray, yid: np.ndarray, columns: np.ndarray, self_dist: float | None) -> np.ndarray:
    """Exact distances of the pairs (rows, columns); that of a point to itself is self_dist, if there is one."""
    step = max(1, _GATHER // max(1, x.shape[1]))
    exact = np.concatenate([_exact(x[rows[a : a + step]], y[columns[a : a + step]]) for a in range(0, max(1, len(rows)), step)])
    if self_dist is not None:
        exact[xid[rows] == yid[columns]] = self_dist
    return exact


def best_of(rows: np.ndarray, cid: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least of each row under (dist, cid), in that order."""
    order = np.lexsort((cid, dist, rows))
    rows, cid, dist = rows[order], cid[order], dist[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[kept], cid[kept], dist[kept]


def _dense(xid: np.ndarray, x: np.ndarray, norm: np.ndarray, yid: np.ndarray, y: np.ndarray, y_norm: np.ndarray, k: int, self_dist: float | None):
    """(rows, ids, distances) of the k nearest rows of y for each row of x, and for each row a distance within
    which they are, infinite if there are fewer."""
    k = min(k, len(y))
    dist, margin = _distances(x, norm, y, y_norm)
    if self_dist is not None:
        dist[xid[:, None] == yid] = self_dist
    reach = np.partition(dist, k - 1, axis=1)[:, k - 1] + margin
    rows, columns = np.nonzero(dist <= np.minimum(reach, np.finfo(float).max)[:, None])
    return *best_of(rows, yid[columns], _paired(x, xid, rows, y, yid, columns, self_dist), k), reach


def nearest(xid: np.ndarray, x: np.ndarray, yid: np.ndarray, y: np.ndarray, k: int, self_dist: float | None, part_bytes: int, tree: Leaves | None = None):
    """Yields (row of x, id, dist) arrays with the k nearest rows of y for each row of x.

    |x|^2 + |y|^2 - 2xy proposes, with a margin for cancellation, every row that may be among the k,
    ties included; their distances are computed exactly and ranked by (dist, id).  Blocks of distances
    hold at most part_bytes.  self_dist: the distance of a point to itself, if it isn't 0; an infinite one
    leaves it out.  tree: `Leaves` of y, by which only near rows of y are looked at.
    """
    if not len(x) or not len(y):
        return
    if tree is not None:
        yield from tree.nearest(xid, x, k, self_dist, part_bytes)
        return
    y_norm = np.einsum("ij,ij->i", y, y)
    if len(y) >= 4 * _MANY_ROWS and k * 64 <= _MANY_ROWS:
        yield from _nearest_in_blocks(xid, x, yid, y, y_norm, k, self_dist, part_bytes)
        return
    step = max(1, min(part_bytes, _CACHED) // 8 // len(y))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        rows, cid, dist, _ = _dense(xid[s : s + step], part, np.einsum("ij,ij->i", part, part), yid, y, y_norm, k, self_dist)
        yield rows + s, cid, dist


#: Rows of y that are multiplied at once where there are many, so that a block also has many rows of x.
_MANY_ROWS = 4096


def _nearest_in_blocks(xid: np.ndarray, x: np.ndarray, yid: np.ndarray, y: np.ndarray, y_norm: np.ndarray, k: int, self_dist: float | None, part_bytes: int):
    """`nearest` over blocks of y: of later ones only rows that may beat the k nearest so far are looked at."""
    step = max(1, min(part_bytes, _CACHED) // 8 // _MANY_ROWS)
    for s in range(0, len(x), step):
        part, ids = x[s : s + step], xid[s : s + step]
        norm = np.einsum("ij,ij->i", part, part)
        best, worst = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), np.full(len(part), np.inf)
        for b in range(0, len(y), _MANY_ROWS):
            here = slice(b, b + _MANY_ROWS)
            dist, margin = _distances(part, norm, y[here], y_norm[here])
            if self_dist is not None:
                dist[ids[:, None] == yid[here]] = self_dist
            reach = worst + margin
            if np.isinf(worst).any() and k <= dist.shape[1]:
                reach = np.minimum(reach, np.partition(dist, k - 1, axis=1)[:, k - 1] + margin)
            rows, columns = np.nonzero(dist <= np.minimum(reach, np.finfo(float).max)[:, None])
            if not len(rows):
                continue
            new = rows, yid[here][columns], _paired(part, ids, rows, y[here], yid[here], columns, self_dist)
            best = best_of(*map(np.concatenate, zip(best, new)), k)
            last = np.searchsorted(best[0], np.arange(len(part)), side="right") - 1
            full = np.bincount(best[0], minlength=len(part)) == k
            worst[full] = best[2][last[full]]
        yield best[0] + s, *best[1:]


def divided(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the points in groups of at most `most`, halved again and again along their widest coordinate."""
    found, open_ = [], [np.arange(len(points))]
    while open_:
        at = open_.pop()
        if len(at) <= most:
            found.append(at)
            continue
        here = points[at]
        axis = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
        order = np.argpartition(here[:, axis], len(at) // 2)
        open_ += [at[order[len(at) // 2 :]], at[order[: len(at) // 2]]]
    return found


class Leaves:
    """Points of a few coordinates in small groups with their boxes: rows of a group whose box is farther from
    those of a group of queries than all of their neighbours aren't looked at."""

    #: Coordinates up to which boxes rule much out, and points from which it pays; points of a group, and queries.
    COORDINATES, POINTS, GROUP, QUERIES = 6, 4096, 128, 32

    def __init__(self, yid: np.ndarray, y: np.ndarray):
        groups = divided(y, self.GROUP)
        self.size = np.array([len(g) for g in groups])
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        order = np.concatenate(groups)
        self.yid, self.y = yid[order], y[order]
        self.norm = np.einsum("ij,ij->i", self.y, self.y)
        self.low, self.high = np.minimum.reduceat(self.y, self.start), np.maximum.reduceat(self.y, self.start)

    @classmethod
    def of(cls, yid: np.ndarray, y: np.ndarray) -> Leaves | None:
        """None where it wouldn't pay, or boxes can't be drawn."""
        return cls(yid, y) if len(y) >= cls.POINTS and 0 < y.shape[1] <= cls.COORDINATES and np.isfinite(y).all() else None

    def _rows(self, groups: np.ndarray) -> np.ndarray:
        size = self.size[groups]
        return np.repeat(self.start[groups] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())

    def nearest(self, xid: np.ndarray, x: np.ndarray, k: int, self_dist: float | None, part_bytes: int):
        for at in divided(x, self.QUERIES):
            part, ids = x[at], xid[at]
            norm = np.einsum("ij,ij->i", part, part)
            gap = np.maximum(0, np.maximum(self.low - part.max(axis=0), part.min(axis=0) - self.high))
            least = _exact(gap, np.zeros_like(gap))
            # First the groups that touch the queries' box, and the next ones until there are more than k points.
            order = np.argsort(least)
            last = min(int(np.searchsorted(np.cumsum(self.size[order]), k + 1)), len(order) - 1)
            taken = np.flatnonzero(least <= least[order[last]])
            columns = self._rows(taken)
            found = self._found(ids, part, norm, columns, k, self_dist, part_bytes)
            reach = np.inf if len(columns) < k else max(f[3].max() for f in found) * (1 + 1e-9)
            every = np.flatnonzero(~(least > reach))
            if len(every) > len(taken):
                found = self._found(ids, part, norm, self._rows(every), k, self_dist, part_bytes)
            for rows, cid, dist, _ in found:
                yield at[rows], cid, dist

    def _found(self, ids: np.ndarray, part: np.ndarray, norm: np.ndarray, columns: np.ndarray, k: int, self_dist: float | None, part_bytes: int):
        step = max(1, part_bytes // 8 // max(1, len(columns)))
        yid, y, y_norm = self.yid[columns], self.y[columns], self.norm[columns]
        found = []
        for s in range(0, len(part), step):
            rows, *rest = _dense(ids[s : s + step], part[s : s + step], norm[s : s + step], yid, y, y_norm, k, self_dist)
            found.append((rows + s, *rest))
        return found


def nearest_by_heap(xid: np.ndarray, x: np.ndarray, yid: np.ndarray, y: np.ndarray, k: int, self_dist: float | None, block: int = 4096, queries: int = 256):
    """The same by a heap of at most k entries a query, over corpus rows one block at a time: only rows of
    a block that may beat the worst of a full heap, and are among its own k nearest, are looked at one by one."""
    if not len(x) or not len(y):
        return
    y_norm = np.einsum("ij,ij->i", y, y)
    for first in range(0, len(x), queries):
        part, ids = x[first : first + queries], xid[first : first + queries]
        norm = np.einsum("ij,ij->i", part, part)
        heaps: list[list[tuple[float, int]]] = [[] for _ in part]  # of (-dist, -id): the worst on top
        worst = np.full(len(part), np.inf)
        for s in range(0, len(y), block):
            here, there = y[s : s + block], yid[s : s + block]
            dist, margin = _distances(part, norm, here, y_norm[s : s + block])
            if self_dist is not None:
                dist[ids[:, None] == there] = self_dist
            reach = worst + margin
            if np.isinf(worst).any() and k < len(here):
                reach = np.minimum(reach, np.partition(dist, k - 1, axis=1)[:, k - 1] + margin)
            rows, columns = np.nonzero(dist <= np.minimum(reach, np.finfo(float).max)[:, None])
            exact = _paired(part, ids, rows, here, there, columns, self_dist)
            for row, entry in zip(rows.tolist(), zip((-exact).tolist(), (-there[columns]).tolist())):
                heap = heaps[row]
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            for row in np.unique(rows).tolist():
                if len(heaps[row]) == k:
                    worst[row] = -heaps[row][0][0]
        best = [sorted((-d, -c) for d, c in heap) for heap in heaps]
        yield (
            np.repeat(np.arange(first, first + len(part)), [len(b) for b in best]),
            np.array([c for b in best for _, c in b], np.int64), np.array([d for b in best for d, _ in b], float),
        )


#: Queries and rows of a block of bounds, and of how many rows one is looked at first.
_BLOCK_QUERIES, _BLOCK_ROWS, _THIN = 512, 1024, 16
#: Pairs found by products from which they are looked at by differences at once, and more than squares lose near 0.
_PAIRS, _LEAST = 1_000_000, 1e-300


def few_copies(yid: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal rows those with the `most` least ids: no others can be among that many nearest.  Rows that hold
    infinite values or NaN are kept: `likely` deals with them."""
    if len(y) <= most or not y.shape[1]:
        return yid, y
    _, group = np.unique(np.ascontiguousarray(y).view(np.dtype((np.void, y.shape[1] * y.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((yid, group))
    run = group[order]
    kept = np.sort(order[(np.arange(len(run)) - np.searchsorted(run, run) < most) | ~np.isfinite(y).all(axis=1)[order]])
    return yid[kept], y[kept]


def _with_norms(x: np.ndarray, y: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrices with products of rows that no squared distance is below (way -1) or above (1), whatever is rounded."""
    e = 1 + way * 1e-12 * (8 + x.shape[1])
    norm, y_norm = np.einsum("ij,ij->i", x, x) * e, np.einsum("ij,ij->i", y, y) * e
    return np.column_stack([x, norm, np.ones(len(x))]), np.column_stack([-2.0 * y, np.ones(len(y)), y_norm])


def proposed(xid: np.ndarray, x: np.ndarray, yid: np.ndarray, y: np.ndarray, k: int, own: bool, reach: np.ndarray, part_bytes: int):
    """Yields (rows of x, rows of y): every pair that may be among the k nearest, ties included, and few others.

    A pair is left out only if k others of its row are nearer for certain.  reach: for each row of x a distance
    within which k points are known; lowered here, so that the next part of a corpus starts with it.  own:
    whether a point counts among its own k nearest; if not, it is proposed, but no bound comes from it.
    Distances that are no number bound nothing, and their pairs are proposed.
    """
    if not len(x) or not len(y):
        return
    low_x, low_y = _with_norms(x, y, -1)
    high_x, high_y = _with_norms(x, y, 1)
    thin = _THIN if len(y) >= 2 * _THIN * k else 1
    step = max(1, min(_BLOCK_QUERIES, part_bytes // 8 // len(y[::thin])))
    for s in range(0, len(x), step):
        here = slice(s, s + step)
        ids, r = xid[here], reach[here]  # a view
        if k <= len(y[::thin]) and not np.isfinite(r).all():
            high = high_x[here] @ high_y[::thin].T
            if not own:
                high[ids[:, None] == yid[::thin]] = np.inf
            r[:] = np.fmin(r, np.partition(high, k - 1, axis=1)[:, k - 1])
        found, n, most = [], 0, _PAIRS
        for b in range(0, len(y), _BLOCK_ROWS):
            low = low_x[here] @ low_y[b : b + _BLOCK_ROWS].T
            i, j = np.nonzero(~(low > r[:, None]))
            found.append((i, j + b, np.isnan(low[i, j])))
            n += len(i)
            if n > most:
                found = [_nearer(ids, x[here], yid, y, k, own, r, *map(np.concatenate, zip(*found)))]
                n = len(found[0][0])
                most = max(_PAIRS, 2 * n)
        i, j, _ = _nearer(ids, x[here], yid, y, k, own, r, *map(np.concatenate, zip(*found)))
        yield i + s, j


def _nearer(ids: np.ndarray, x: np.ndarray, yid: np.ndarray, y: np.ndarray, k: int, own: bool, reach: np.ndarray, i: np.ndarray, j: np.ndarray, unknown: np.ndarray):
    """Of the pairs (i, j) those that may be among the k nearest by bounds on sums of differences, which hold near
    copies apart where products can't, and those of unknown distance.  Lowers reach."""
    step = max(1, _GATHER // max(1, x.shape[1]))
    differences = (x[i[a : a + step]] - y[j[a : a + step]] for a in range(0, max(1, len(i)), step))
    dist, e = np.concatenate([np.einsum("ij,ij->i", t, t) for t in differences]), 1e-12 * (8 + x.shape[1])
    high = dist * (1 + e) + _LEAST
    if not own:
        high[ids[i] == yid[j]] = np.inf
    order = np.lexsort((high, i))
    last = np.searchsorted(i[order], np.arange(len(ids))) + k - 1
    known = np.flatnonzero(last < np.searchsorted(i[order], np.arange(len(ids)), side="right"))
    reach[known] = np.fmin(reach[known], high[order][last[known]])
    near = unknown | ~(dist * (1 - e) - _LEAST > reach[i])
    return i[near], j[near], unknown[near]


def likely(xid: np.ndarray, x: np.ndarray, yid: np.ndarray, y: np.ndarray, k: int, own: bool, reach: np.ndarray, part_bytes: int):
    """`proposed`, but few pairs of rows that hold infinite values or NaN.

    Their distances are infinite or NaN, which are greater than others in this order.  So such rows of y are among
    the k nearest only where fewer than k distances are known to be finite, and there those with the least ids.
    """
    numbers, y_numbers = np.isfinite(x).all(axis=1), np.isfinite(y).all(axis=1)
    if numbers.all() and y_numbers.all():
        yield from proposed(xid, x, yid, y, k, own, reach, part_bytes)
        return
    at, there = np.flatnonzero(numbers), np.flatnonzero(y_numbers)
    known = reach[at]
    for i, j in proposed(xid[at], x[at], yid[there], y[there], k, own, known, part_bytes):
        yield at[i], there[j]
    reach[at] = known
    for at, there in ((at[np.isinf(known)], np.flatnonzero(~y_numbers)), (np.flatnonzero(~numbers), np.arange(len(y)))):
        for i, j in _least_ids(xid[at], x[at], yid[there], y[there], k + 1, part_bytes):
            yield at[i], there[j]


def _least_ids(xid: np.ndarray, x: np.ndarray, yid: np.ndarray, y: np.ndarray, most: int, part_bytes: int):
    """Yields (rows of x, rows of y) where all distances are infinite or NaN: `most` of each row of x, infinite ones
    before NaN and then by id, besides the point itself."""
    if not len(x) or not len(y):
        return
    place = np.argsort(np.argsort(yid))
    infinite = [(np.isposinf(y) * 1.0).T, (np.isneginf(y) * 1.0).T]
    step = max(1, part_bytes // 32 // len(y))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        none = (np.isposinf(part) * 1.0) @ infinite[0] + (np.isneginf(part) * 1.0) @ infinite[1] > 0
        none |= np.isnan(part).any(axis=1)[:, None] | np.isnan(y).any(axis=1)
        order = np.where(none, place + len(y), place)
        order[xid[s : s + step, None] == yid] = -1
        found = np.argpartition(order, most, axis=1)[:, : most + 1] if most < len(y) else np.broadcast_to(np.arange(len(y)), order.shape)
        yield np.repeat(np.arange(s, s + len(part)), found.shape[1]), found.ravel()
