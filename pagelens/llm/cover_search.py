"""Exact top-k inner products by dual-tree search over cover trees.

Each block of rows and each block of queries has a cover tree: a node's children
are centres that cover its points within a shrinking radius and lie further than
that radius from each other. A query node q and a data node d are pruned if
<cq, cd> + rd |cq| + rq |cd| + rq rd, which no pair of their points exceeds, is
below the worst kth score among the queries of q. Each query starts from its kth
score within a bounded sample, so blocks prune from the first pair on.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import vectors
from pagelens.sources.shared import materialize

LEAF = 256
SHRINK = 0.85
SCALE = 256
SCORED = 2048  # points of data leaves that meet a query leaf at a time, at least


class CoverTree:
    """Nodes over contiguous ranges of reordered points; children of a node are contiguous too."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        base = points.astype(float)
        nodes: list[list] = [[0, len(points), *self._middle(base), 0, 0]]  # start, end, centre (original row), radius, first child, children
        todo = [(0, np.arange(len(points)))]
        final = np.empty(len(points), np.int64)
        while todo:
            at, members = todo.pop()
            start, end, centre, radius = nodes[at][:4]
            groups = self._cover(base, members, centre, radius) if len(members) > LEAF and radius > 0 else []
            if len(groups) < 2:
                final[start:end] = members
                continue
            nodes[at][4], nodes[at][5] = len(nodes), len(groups)
            lo = start
            for c, r, own in groups:
                nodes.append([lo, lo + len(own), c, r, 0, 0])
                todo.append((len(nodes) - 1, own))
                lo += len(own)
        self.ids, self.points = ids[final], points[final]
        self.span = np.array([n[:2] for n in nodes], np.int64)
        self.centre = base[[n[2] for n in nodes]]
        self.radius = np.array([n[3] for n in nodes])
        self.child = np.array([n[4:] for n in nodes], np.int64)
        self.norm = np.sqrt((self.centre**2).sum(axis=1))

    @staticmethod
    def _middle(base: np.ndarray) -> tuple[int, float]:
        mean = base.mean(axis=0)
        centre = int(((base - mean) ** 2).sum(axis=1).argmin())
        return centre, float(np.sqrt(((base - base[centre]) ** 2).sum(axis=1).max()))

    @staticmethod
    def _cover(base: np.ndarray, members: np.ndarray, centre: int, radius: float) -> list[tuple[int, float, np.ndarray]]:
        """Groups (centre, radius, members): greedy centres at a shrinking distance, the node's own centre first."""
        limit = (radius * SHRINK) ** 2
        own = base[members]
        free = np.ones(len(members), bool)
        out = []
        pick = int(np.flatnonzero(members == centre)[0]) if (members == centre).any() else 0
        while True:
            d = ((own - own[pick]) ** 2).sum(axis=1)
            take = free & (d <= limit)
            take[pick] = True
            free &= ~take
            out.append((int(members[pick]), float(np.sqrt(d[take].max())), members[take]))
            if not free.any():
                return out
            pick = int(np.flatnonzero(free)[0])

    def dump(self, **more) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, points=self.points, span=self.span, centre=self.centre, radius=self.radius, child=self.child, norm=self.norm, **more)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        self = object.__new__(cls)
        with np.load(io.BytesIO(data)) as f:
            self.__dict__.update({k: f[k] for k in f.files})
        return self


def _scorer(q: np.ndarray, d: np.ndarray):
    """Integer inner products of rows of q (from, to) with places of d: by floats where these are exact, else by whole numbers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        x, y = q.astype(float), d.astype(float)
        return lambda a, b, at: (x[a:b] @ y[at].T).astype(np.int64)
    if most < 2.0**61:
        return lambda a, b, at: q[a:b] @ d[at].T
    raise OverflowError("a score may not fit a long")


def dual_tree(q: CoverTree, d: CoverTree, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best k of d (own id left out) that can still be among its best k of all: ids, vector ids, scores.

    bound: for each query a score that at least k rows reach. A query node goes
    down with all data nodes that it can't prune; a leaf scores the points of
    these, those of the highest bounds first, SCORED at least at a time.
    """
    n = len(q.ids)
    none = -(2**62)  # can be negated, unlike the least long
    best = np.full((n, k), none)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    worst = bound.astype(float).copy()
    slack = 1e-9 * (1.0 + float((q.norm + q.radius).max()) * float((d.norm + d.radius).max()))
    scores = _scorer(q.points, d.points)

    def kept(i: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = q.span[i]
        high = d.centre[nodes] @ q.centre[i] + d.radius[nodes] * q.norm[i] + q.radius[i] * (d.norm[nodes] + d.radius[nodes])
        own = high + slack >= worst[a:b].min()
        return nodes[own], high[own]

    def leaf(i: int, at: np.ndarray) -> None:
        a, b = q.span[i]
        s, ids = scores(a, b, at), d.ids[at]
        s[q.ids[a:b, None] == ids[None, :]] = none
        hit = s >= worst[a:b, None]
        for row in np.flatnonzero(hit.any(axis=1)):
            x = np.concatenate([best[a + row], s[row, hit[row]]])
            y = np.concatenate([best_id[a + row], ids[hit[row]]])
            order = np.lexsort((y, -x))[:k]
            best[a + row], best_id[a + row] = x[order], y[order]
            if best[a + row, k - 1] != none:
                worst[a + row] = max(worst[a + row], float(best[a + row, k - 1]))

    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        i, nodes = todo.pop()
        nodes, high = kept(i, nodes)
        open_q = q.child[i, 1] > 0
        while True:
            wide = d.child[nodes, 1] > 0
            if open_q:
                wide &= d.radius[nodes] >= q.radius[i]
            if not wide.any():
                break
            below = [np.arange(lo, lo + m) for lo, m in d.child[nodes[wide]]]
            nodes, high = kept(i, np.concatenate([nodes[~wide], *below]))
        if open_q:
            todo += [(x, nodes) for x in range(q.child[i, 0], q.child[i].sum())]
            continue
        while len(nodes):
            order = np.argsort(-high, kind="stable")
            nodes, high = nodes[order], high[order]
            size = np.cumsum(d.span[nodes, 1] - d.span[nodes, 0])
            some = int(np.searchsorted(size, SCORED)) + 1
            leaf(i, np.concatenate([np.arange(lo, hi) for lo, hi in d.span[nodes[:some]]]))
            nodes, high = kept(i, nodes[some:])
    rows, cols = np.nonzero((best != none) & (best >= bound[:, None]))
    return q.ids[rows], best_id[rows, cols], best[rows, cols]


def top_k(table: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products with the other rows.

    Components become floor(scale * x). is_query is a condition on the column id.
    Rows with a null id, a null vector or an empty one, or a component that is
    null or not finite take no part; vectors of different lengths are not
    compared. A query with fewer candidates gets all of them; ties go to the
    smaller id. Rows with the query's own id are not its candidates; of repeated
    query ids the least vector counts, and repeated candidates may each appear.
    An empty table gives an empty result. Other columns are not read.
    """
    whole = F.transform("v", lambda x: F.floor(x * scale))
    rows = materialize(vectors.usable(table, id_col, vector_col).select("id", whole.alias("v")), "whole-vectors")
    sampled = table.sparkSession.sparkContext.broadcast(vectors.sample(rows))
    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))

    def query_block(ids: np.ndarray, matrix: np.ndarray) -> bytes:
        tree = CoverTree(ids, matrix)
        return tree.dump(bound=vectors.lower_bounds(tree.ids, tree.points, sampled.value, k))

    def compare(data: bytes, query: bytes) -> tuple:
        q = CoverTree.load(query)
        return dual_tree(q, CoverTree.load(data), q.bound, k)

    data = materialize(vectors.blocks(rows, lambda ids, m: CoverTree(ids, m).dump(), vectors.BLOCK_ROWS), "cover-trees")
    queries = materialize(vectors.blocks(asked, query_block, vectors.QUERY_ROWS), "query-trees")
    return vectors.search(data, queries, compare, k, "long")
