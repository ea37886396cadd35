"""Exact top-k by inner product: best-first search in M-trees.

Vectors get one more coordinate that brings all to the same norm; then a larger inner product is a
smaller Euclidean distance, which is a metric.  Each task builds a paged tree over its rows, or
several where they are too many to hold.  A node stores its children's covering radii and their
distances to its own routing object, so that the triangle inequality rules out children and leaf
entries before their distances are computed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, lean

#: Entries of a leaf page and children of an inner node, at most.
PAGE, FAN = 512, 16
#: Bytes of coordinates, as doubles, of a tree, and of the queries that one pass over the vectors answers; more
#: vectors take further trees, more queries further passes.
TREE_BYTES, QUERY_BYTES = 16 << 20, 16 << 20
SCALE = 1024


@dataclass
class Node:
    """A page of entries (the tree's rows first to after), or children with their routing objects and covering
    radii.  to_center: distances of the entries or routing objects to this node's own routing object."""

    to_center: np.ndarray
    first: int = 0
    after: int = 0
    children: list[Node] | None = None
    routing: np.ndarray | None = None
    radii: np.ndarray | None = None


class Best:
    """The k best (score, id) so far, by score and then the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            enter = scores >= self.scores[-1]
            scores, ids = scores[enter], ids[enter]
            if not len(scores):
                return
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        if len(scores) > 8 * self.k:
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[near], ids[near]
        top = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[top], ids[top]

    @property
    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf


class Tree:
    """An M-tree over whole-number vectors (as doubles).  scored: entries whose inner product was computed."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.scored, self.paged = ids, vectors, 0, 0
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.top, self.largest = float(norms.max()), float(np.abs(vectors).max(initial=0))
        self.extra = np.sqrt(np.maximum(self.top - norms, 0))
        self.center = vectors.mean(axis=0), float(self.extra.mean())
        self.rng = np.random.default_rng(0)
        rows = np.arange(len(ids))
        pages: list[np.ndarray] = []
        self.root = self._build(rows, self._distances(rows, *self.center), pages)
        order = np.concatenate(pages)  # a page's entries stand together
        self.ids, self.vectors = ids[order], vectors[order]

    def _distances(self, rows: np.ndarray, center: np.ndarray, extra: float) -> np.ndarray:
        """Of the points of `rows`, which all have the squared norm `top`, to a point."""
        inner = self.vectors[rows] @ center + self.extra[rows] * extra
        return np.sqrt(np.maximum(self.top + float(center @ center) + extra * extra - 2 * inner, 0))

    def _build(self, rows: np.ndarray, to_center: np.ndarray, pages: list[np.ndarray]) -> Node:
        if len(rows) <= PAGE:
            pages.append(rows)
            self.paged += len(rows)
            return Node(to_center, self.paged - len(rows), self.paged)
        fan = min(FAN, -(-2 * len(rows) // PAGE))  # pages are half full, or better
        picked = self.rng.choice(len(rows), fan, replace=False)
        away = np.stack([self._distances(rows, self.vectors[rows[p]], self.extra[rows[p]]) for p in picked])
        nearest = away.argmin(axis=0)
        if np.bincount(nearest).max() > 0.9 * len(rows):  # copies, or nearly: any even split is as good
            nearest = np.arange(len(rows)) * fan // len(rows)
        kept = [(p, np.flatnonzero(nearest == i), away[i]) for i, p in enumerate(picked)]
        kept = [(p, own, d[own]) for p, own, d in kept if len(own)]
        children = [self._build(rows[own], d, pages) for _, own, d in kept]
        picked = np.array([p for p, *_ in kept])
        return Node(to_center[picked], children=children, routing=self.vectors[rows[picked]], radii=np.array([d.max() for *_, d in kept]))

    def search(self, query_id: int, query: np.ndarray, best: Best) -> None:
        """Add to `best` what can enter it, nearest nodes first."""
        norm = float(query @ query)
        slack = 1e-6 * (1 + np.sqrt(norm + self.top))
        exact = self.largest * float(np.abs(query).max(initial=0)) * max(1, len(query)) < 2**53

        def reach() -> float:
            """The distance beyond which no vector can enter the best k."""
            if best.least == -np.inf:
                return np.inf
            return np.sqrt(max(0.0, norm + self.top - 2 * best.least)) + slack

        center, extra = self.center
        first = np.sqrt(max(0.0, norm + float(center @ center) + extra * extra - 2 * float(query @ center)))
        heap, n = [(0.0, 0, self.root, float(first))], 1
        while heap:
            low, _, node, d = heapq.heappop(heap)
            r = reach()
            if low > r:
                return
            apart = np.abs(d - node.to_center)
            if node.children is None:
                ids, page = self.ids[node.first : node.after], self.vectors[node.first : node.after]
                wanted = (apart <= r) & (ids != query_id)
                if not wanted.all():
                    ids, page = ids[wanted], page[wanted]
                self.scored += len(ids)
                inner = page @ query if exact else page.astype(np.int64) @ query.astype(np.int64)
                best.add(inner.astype(np.int64), ids)
                continue
            near = np.flatnonzero(apart - node.radii <= r)
            if not len(near):
                continue
            ds = np.sqrt(np.maximum(norm + self.top - 2 * (node.routing[near] @ query), 0))
            for i, x in zip(near.tolist(), ds.tolist()):
                if (low := max(0.0, x - node.radii[i])) <= r:
                    heapq.heappush(heap, (low, n, node.children[i], x))
                    n += 1


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null where the vector or a component isn't finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, ties to smaller ids.

    Both tables have vec_id and v (array of long, below 2^53).  Candidates are all rows but those with
    the query's own id.  Rows with a null id or a null vector take no part, nor do vectors of another
    length than the query's.  Repeated rows are candidates each; equal queries are asked once.  An
    empty table on either side gives no rows.  Other columns are ignored.
    """
    good = "vec_id is not null and v is not null"
    rows = bounded_batches(rows).select(F.col("vec_id").cast("long").alias("vec_id"), "v").where(good)
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "v").where(good).distinct()
    size = queries.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    blocks = -(-size // QUERY_BYTES)
    out = None
    for b in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b)
        asked = [(r.vec_id, np.array(r.v, np.float64)) for r in block.collect()]
        part = _searched(rows, rows.sparkSession.sparkContext.broadcast(asked), k, b)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.where("false").selectExpr("vec_id query_id", "0L asked", "vec_id", "0L score")
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
    """Trees over all rows (vec_id, v), by length of v; each holds TREE_BYTES of coordinates at most, or the
    rows of one batch."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def tree(size: int) -> Tree:
        parts = held.pop(size)
        return Tree(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]))

    for batch in batches:
        ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(sizes) - sizes
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            held.setdefault(size, []).append((ids[at], flat[starts[at][:, None] + np.arange(size)]))
            if sum(v.nbytes for _, v in held[size]) >= TREE_BYTES:
                yield tree(size)
    yield from map(tree, list(held))


def _searched(rows: DataFrame, asked: Broadcast, k: int, block: int) -> DataFrame:
    schema = pa.schema([("query_id", pa.int64()), ("asked", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[tuple[int, np.ndarray]] = asked.value
        best = [Best(k) for _ in queries]
        for tree in _trees(batches):
            for (i, q), b in zip(queries, best):
                if len(q) == tree.vectors.shape[1]:
                    tree.search(i, q, b)
        for n, ((i, _), b) in enumerate(zip(queries, best)):
            if len(b.ids):
                own = [np.full(len(b.ids), x, np.int64) for x in (i, (block << 32) + n)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, b.ids, b.scores)], schema=schema)

    return rows.mapInArrow(lean(run), "query_id long, asked long, vec_id long, score long")
