"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, floor(256 * x). Every task holds one slice of the candidates and indexes it
by a cover tree; each block of queries is indexed the same way, and the two trees are walked together, after each group
of queries has met the candidates that promise most.
For a query node (centre q, radius a) and a candidate node (centre c, radius b) no pair below them
scores more than q.c + a|c| + b|q| + ab; the pair of nodes is dropped when that is below the worst k-th
score that any query of the group has so far; a group of queries is as good as the worst of its parts. Surviving
leaves are scored exactly in integers (an error is raised where 64 bits might not hold a score), and the k
best of every slice meet in one small table, k rows a query and slice.

Queries are a stated set against all rows, in blocks of ``QUERY_BLOCK``. Ties go to the smaller id. Vectors
that are null or hold null or non-finite components take no part, nor do rows with a null id; components
of vectors shorter than the longest count as 0. Rows that share an id are separate candidates, and a query's
own id is left out altogether; queries that share an id and a vector count once. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



SCALE = 256
QUERY_BLOCK = 1024
SLICE_ROWS = 16_384
LEAF, QUERY_LEAF = 64, 4  # a group of queries is pruned by its widest spread, so groups are small
BASE = 1.3  # of the covering radii


class CoverTree:
    """Points under centres that are points themselves; covering radii shrink by ``BASE`` from level to level.

    ``nodes`` holds (centre, radius, children, members): radius is the exact distance to the farthest point
    below, children are node numbers, members the rows of a leaf.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        self.leaf, self.company = leaf, max(1, leaf // 8)
        self.points = points.astype(np.float64)  # bounds only: scores are of the integers
        self.nodes: list[tuple[np.ndarray, float, list[int], np.ndarray | None]] = []
        rows = np.arange(len(points))
        distance = np.sqrt(((self.points - self.points[0]) ** 2).sum(axis=1))
        self.root = self._build(0, rows, distance)

    def _leaf(self, centre: int, rows: np.ndarray, radius: float) -> int:
        self.nodes.append((self.points[centre], radius, [], rows))
        return len(self.nodes) - 1

    def _build(self, centre: int, rows: np.ndarray, distance: np.ndarray) -> int:
        """Node over ``rows`` with their distances to the centre."""
        radius = float(distance.max(initial=0.0))
        if len(rows) <= self.leaf or radius == 0.0:
            return self._leaf(centre, rows, radius)
        reach, children, misses = radius / BASE, [], 0
        near, own = distance, centre
        while len(rows) and misses < 4:
            inside = near <= reach
            if inside.sum() >= self.company:
                children.append(self._build(own, rows[inside], near[inside]))
                rows, distance = rows[~inside], distance[~inside]
            else:
                misses += 1
            if len(rows):
                own = int(rows[(7919 * misses) % len(rows)])
                near = np.sqrt(((self.points[rows] - self.points[own]) ** 2).sum(axis=1))
        # rows without close company stay under this centre, nearest together
        order = np.argsort(distance, kind="stable")
        for lo in range(0, len(rows), self.leaf):
            some = order[lo:lo + self.leaf]
            children.append(self._leaf(centre, rows[some], float(distance[some[-1]])))
        if len(children) == 1:
            return children[0]
        self.nodes.append((self.points[centre], radius, children, None))
        return len(self.nodes) - 1


NONE = np.iinfo(np.int64).min  # score of a place that no candidate has taken


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """Number type in which the inner products of two integer matrices are exact; an error if 64 bits might not hold them."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 1 << 63:
        raise OverflowError("inner products beyond 64 bits")
    return np.float64 if most < 1 << 53 else np.int64  # every partial sum is exact in doubles, or not


class Search:
    """k best candidates of every query, by a walk over pairs of nodes of two trees."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.c, self.k = CoverTree(queries, QUERY_LEAF), CoverTree(points, LEAF), k
        kind = exact_kind(queries, points)
        self.q_rows = [None if n[3] is None else queries[n[3]].astype(kind) for n in self.q.nodes]
        self.c_rows = [None if n[3] is None else points[n[3]].astype(kind).T for n in self.c.nodes]
        self.query_ids, self.ids = query_ids, ids
        self.score = np.full((len(queries), k), NONE)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.worst = [-np.inf] * len(self.q.nodes)  # least k-th score of the queries below a node
        self.parent = [-1] * len(self.q.nodes)
        for node, (_, _, children, _) in enumerate(self.q.nodes):
            for child in children:
                self.parent[child] = node
        self.slack = 1e-6 + 1e-12 * float(np.sqrt((self.q.points ** 2).sum(axis=1)).max(initial=0)) * float(
            np.sqrt((self.c.points ** 2).sum(axis=1)).max(initial=0))  # of rounding in the bounds
        self.bound = self._bounds()
        self.pairs = 0  # scored, query by candidate

    def _bounds(self) -> np.ndarray:
        """(query node, candidate node) bounds, from one product of the centres; a block and a slice have a few hundred nodes each."""
        (q, q_radius), (c, c_radius) = ((np.array([n[0] for n in t.nodes]), np.array([n[1] for n in t.nodes])) for t in (self.q, self.c))
        q_norm, c_norm = np.sqrt((q ** 2).sum(axis=1)), np.sqrt((c ** 2).sum(axis=1))
        return q @ c.T + q_radius[:, None] * c_norm + c_radius * (q_norm + q_radius)[:, None]

    def run(self) -> None:
        """Fill ``score`` and ``found``, best first, ties by id."""
        inner = [bool(n[2]) for n in self.c.nodes]
        leaves = np.flatnonzero(~np.array(inner))
        self.seen: dict[int, np.ndarray] = {}
        for q, (_, _, children, _) in enumerate(self.q.nodes):
            if not children:  # every group first meets the leaves that promise most, so that all bounds below can act
                order = leaves[np.argsort(-self.bound[q, leaves], kind="stable")]
                enough = int(np.searchsorted(np.cumsum([self.c_rows[c].shape[1] for c in order[:self.k + 2]]), self.k + 1)) + 1
                self.seen[q] = order[:enough]
                self._score(q, self.seen[q])
        self._walk(self.q.root, np.array([self.c.root]))

    def _within(self, q: int, nodes: np.ndarray) -> np.ndarray:
        return nodes[self.bound[q, nodes] >= self.worst[q] - self.slack]

    def _opened(self, nodes: np.ndarray) -> np.ndarray:
        return np.array([x for c in nodes.tolist() for x in (self.c.nodes[c][2] or [c])], np.int64)

    def _walk(self, q: int, nodes: np.ndarray) -> None:
        """Meet the candidates below ``nodes`` with the queries below ``q``; pairs of nodes out of reach go first."""
        nodes = self._within(q, nodes)
        children = self.q.nodes[q][2]
        if children:
            nodes = self._within(q, self._opened(nodes))
            for child in children:
                if len(nodes):
                    self._walk(child, nodes)
            return
        while len(nodes) and any(self.c.nodes[c][2] for c in nodes.tolist()):
            nodes = self._within(q, self._opened(nodes))
        nodes = nodes[~np.isin(nodes, self.seen[q])]
        nodes = nodes[np.argsort(-self.bound[q, nodes], kind="stable")]
        at, step = 0, 1
        while at < len(nodes) and self.bound[q, nodes[at]] >= self.worst[q] - self.slack:
            some = self._within(q, nodes[at:at + step])
            self._score(q, some)
            at, step = at + step, min(2 * step, 64)

    def _score(self, q: int, nodes: np.ndarray) -> None:
        """Enter the members of candidate leaves into the lists of a leaf of queries."""
        rows, members = self.q.nodes[q][3], np.concatenate([self.c.nodes[c][3] for c in nodes])
        scores = self.q_rows[q] @ np.concatenate([self.c_rows[c] for c in nodes], axis=1)
        self.pairs += scores.size
        better = scores >= self.score[rows, -1:]
        if not better.any():
            return
        rows, scores = rows[better.any(axis=1)], scores[better.any(axis=1)].astype(np.int64)
        scores[self.query_ids[rows][:, None] == self.ids[members][None]] = NONE
        both = np.concatenate((self.score[rows], scores), axis=1)
        ids = np.concatenate((self.found[rows], np.broadcast_to(self.ids[members], scores.shape)), axis=1)
        least = np.partition(both, -self.k, axis=1)[:, -self.k]
        row, column = np.nonzero(both >= least[:, None])  # ties at the edge stay until ids decide
        order = np.lexsort((ids[row, column], ~both[row, column], row))  # ~x falls as x rises, without overflow
        row, column = row[order], column[order]
        starts = np.searchsorted(row, np.arange(len(rows)))
        top = starts[:, None] + np.arange(self.k)
        self.score[rows], self.found[rows] = both[row[top], column[top]], ids[row[top], column[top]]
        least = int(self.score[self.q.nodes[q][3], -1].min())
        self.worst[q] = -np.inf if least == NONE else float(least)
        while (q := self.parent[q]) >= 0:  # a group is as good as the worst of its parts
            worst = min(self.worst[child] for child in self.q.nodes[q][2])
            if worst <= self.worst[q]:
                break
            self.worst[q] = worst


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): usable vectors as integers."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes] or [np.empty(0, int)])] = flat
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of ``vectors`` for every row of ``queries`` (both vec_id, v)."""
    width = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 1, queries.agg(F.max(F.size("v"))).first()[0] or 1)
    rows = vectors.count()
    slices = max(1, -(-rows // SLICE_ROWS))
    dealt = vectors.withColumn("slice", F.pmod(F.xxhash64("vec_id", "v"), F.lit(slices)).cast("int"))
    asked = queries.distinct()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    # each block of queries visits each slice: a stated query set against all rows
    asked = (asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(blocks)).cast("int"))
             .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))))
    both = (dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(False))
            .unionByName(asked.withColumn("asks", F.lit(True))))

    def search(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
        ids, points = table["vec_id"].to_numpy(), _matrix(table["v"], width)
        out = [np.empty(0, np.int64)] * 3
        if asks.any() and not asks.all():
            found = Search(points[asks], ids[asks], points[~asks], ids[~asks], k)
            found.run()
            real = found.score != NONE
            out = [np.repeat(ids[asks], real.sum(axis=1)), found.found[real], found.score[real]]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out))))

    found = both.groupBy("block", "slice").applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0)::HUGEINT * coalesce(z[2], 0)::HUGEINT)) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
