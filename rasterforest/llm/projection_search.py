"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stop.

The squared distance of two points after a Gaussian projection to m dimensions, over their
true squared distance, follows a chi-square law of m degrees. Points are met in order of
projected distance; once that exceeds the law's quantile times the kth true distance found,
a point nearer than the kth is left unseen only with the small probability beyond it.

The top of the kd-tree is fitted on a bounded sample of projections; every row falls into one
of its cells, and each part of a cell carries the tree on in a task. The same test keeps a
query away from whole cells.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Find, search, sound


def chi_square_cdf(x: float, m: int) -> float:
    """For an even number m of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1.0 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 2.0 * m
    while chi_square_cdf(high, m) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


def halves(points: np.ndarray, rows: np.ndarray) -> tuple[int, float, np.ndarray] | None:
    """Axis, cut and mask of the rows up to it: the median of the widest coordinate; None if all rows coincide."""
    spread = np.ptp(points[rows], axis=0)
    axis = int(np.argmax(spread))
    if spread[axis] == 0:
        return None
    x = points[rows, axis]
    cut = float(np.median(x))
    if cut == x.max():
        cut = float(x[x < cut].max())
    return axis, cut, x <= cut


class Cells:
    """The top of the kd-tree: cells of projected space with about equal shares of a sample."""

    def __init__(self, points: np.ndarray, n: int, m: int, limit: float, seed: int):
        self.matrix, self.limit = projection(points.shape[1], m, seed), limit
        low_dim = points @ self.matrix
        cells = [(np.arange(len(points)), np.full(m, -np.inf), np.full(m, np.inf))]
        done: list = []
        while cells and len(cells) + len(done) < n:
            cells.sort(key=lambda c: len(c[0]))
            rows, low, high = cells.pop()
            cut = halves(low_dim, rows)
            if cut is None:
                done.append((rows, low, high))
                continue
            axis, at, left = cut
            left_high, right_low = high.copy(), low.copy()
            left_high[axis] = right_low[axis] = at
            cells += [(rows[left], low, left_high), (rows[~left], right_low, high)]
        self.low, self.high = np.stack([c[1] for c in done + cells]), np.stack([c[2] for c in done + cells])

    def __len__(self) -> int:
        return len(self.low)

    def gaps(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point's projection from each cell."""
        p, out = points @ self.matrix, np.empty((len(points), len(self)))
        for i in range(len(self)):
            out[:, i] = (np.maximum(0, np.maximum(self.low[i] - p, p - self.high[i])) ** 2).sum(axis=1)
        return out

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.gaps(points).argmin(axis=1), np.zeros(len(points))

    def promise(self, queries: np.ndarray) -> np.ndarray:
        return -self.gaps(queries)

    def reach(self, queries: np.ndarray, known: np.ndarray, radii: np.ndarray) -> np.ndarray:
        return ~(self.gaps(queries) > (self.limit * known * known + rounding(queries @ self.matrix))[:, None])


def rounding(p: np.ndarray) -> np.ndarray:
    """Room for the rounding of squared projected distances from p."""
    return 1e-12 * (1 + (p * p).sum(axis=-1))


def projection(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class ProjectedIndex:
    """A kd-tree over the projections of one part's points."""

    def __init__(self, points: np.ndarray, matrix: np.ndarray, leaf: int = 128):
        self.points, self.matrix, self.low_dim, self.verified = points, matrix, points @ matrix, 0
        self.rows: list[np.ndarray | None] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self._grow(np.arange(len(points)), leaf)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        at, own = len(self.low), self.low_dim[rows]
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.rows.append(rows)
        self.children.append(None)
        cut = halves(self.low_dim, rows) if len(rows) > leaf else None
        if cut:
            left = cut[2]
            self.children[at] = self._grow(rows[left], leaf), self._grow(rows[~left], leaf)
            self.rows[at] = None
        return at

    def _gap(self, node: int, p: np.ndarray) -> float:
        return float((np.maximum(0, np.maximum(self.low[node] - p, p - self.high[node])) ** 2).sum())

    def nearest(self, q: np.ndarray, k: int, skip: np.ndarray, limit: float, known: float = math.inf, batch: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest found; skip holds the rows that take no part.

        Points come in order of projected distance from a queue of tree nodes and are
        verified by batches; the chi-square test is made before each. known is a kth
        distance found elsewhere.
        """
        p = q @ self.matrix
        room = float(rounding(p))
        rows, dist = np.empty(0, dtype=np.int64), np.empty(0)
        queue, wait, ahead = [(self._gap(0, p), 0)], np.empty(0, dtype=np.int64), np.empty(0)
        while queue or len(wait):
            kth = min(known, dist[-1]) if len(dist) == k else known
            edge = min(queue[0][0] if queue else math.inf, limit * kth * kth + room)
            ready = int(np.searchsorted(ahead, edge, side="right"))
            if ready:
                new, wait, ahead = wait[: min(ready, batch)], wait[min(ready, batch) :], ahead[min(ready, batch) :]
                new = new[~np.isin(new, skip)] if len(skip) else new
                d = np.sqrt(((self.points[new] - q) ** 2).sum(axis=1))
                self.verified += len(new)
                rows, dist = np.append(rows, new[d <= kth]), np.append(dist, d[d <= kth])
                best = np.lexsort((rows, dist))[:k]
                rows, dist = rows[best], dist[best]
                continue
            if not queue or queue[0][0] > limit * kth * kth + room:
                break
            node = heapq.heappop(queue)[1]
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (self._gap(child, p), child))
            else:
                own = self.rows[node]
                gaps = ((self.low_dim[own] - p) ** 2).sum(axis=1)
                wait, ahead = np.append(wait, own), np.append(ahead, gaps)
                order = np.argsort(ahead, kind="stable")
                wait, ahead = wait[order], ahead[order]
        return rows, dist


def nearest_neighbours(queries: DataFrame, candidates: DataFrame, k: int = 10, m: int = 16, confidence: float = 0.95, seed: int = 7, rows_per_block: int = 4096, sample: int = 8192) -> DataFrame:
    """Each query's k nearest candidates found, by Euclidean distance in doubles.

    Both tables: vec_id long, vector array<double>. A point that should be among the k is
    missed with a probability of at most about 1 - confidence; m is even. Vectors null,
    zero or holding null or non-finite components and rows with a null vec_id take no part;
    a query never finds a row of its own vec_id; ties go to the smaller vec_id; rows repeated
    under one vec_id count each; all candidates are returned if fewer than k; empty tables
    give no rows. The cells of the top level are fitted on at most sample rows and hold all.
    Returns query_id, rank, vec_id, score.
    """
    limit = chi_square_quantile(confidence, m)

    def prepare(ids: np.ndarray, points: np.ndarray) -> Find:
        index = ProjectedIndex(points, projection(points.shape[1], m, seed))

        def find(q_ids: np.ndarray, q: np.ndarray, known: np.ndarray) -> pd.DataFrame:
            out = []
            for q_id, x, kth in zip(q_ids, q, known):
                rows, dist = index.nearest(x, k, np.flatnonzero(ids == q_id), limit, math.inf if np.isnan(kth) else float(kth))
                out.append(pd.DataFrame({"query_id": q_id, "vec_id": ids[rows], "score": dist}))
            return pd.concat(out)

        return find

    def build(points: np.ndarray, n: int) -> Cells:
        return Cells(points, n, m, limit, seed)

    zero = ~F.exists("vector", lambda x: x != 0)
    fit = lambda df: df.where(sound(F.col("vector")) & F.col("vec_id").isNotNull()).where(~zero)
    return search(fit(queries), fit(candidates), k, build, prepare, True, rows_per_block, sample=sample)
