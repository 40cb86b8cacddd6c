"""Exact top-k inner products by dual-tree search over cover trees.

The top level of the candidates' tree is a net of centres fitted on a bounded sample; every
row belongs to the ball of its nearest centre, whose radius covers all its rows. Below it,
each part of a ball is one cover tree in a task, searched together with a tree of the queries.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hard_negatives import BLOCK, in_tiles, positives_in, whole_components
from .vectors import Find, search, sound

#: Sums of products stay exact in doubles where no vector's largest component times the root of its length exceeds this.
EXACT = 2**26


def squared_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T)


def loose(bound: np.ndarray | float) -> np.ndarray | float:
    """A bound with room for rounding."""
    return bound + 1e-9 * np.abs(bound) + 1e-6


class Balls:
    """Balls around a net of sampled points, each the farthest from those before it."""

    def __init__(self, points: np.ndarray, n: int):
        at = [int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))]
        nearest = squared_gaps(points, points[at])[:, 0]
        while len(at) < n and nearest.max() > 0:
            at.append(int(np.argmax(nearest)))
            nearest = np.minimum(nearest, squared_gaps(points, points[at[-1:]])[:, 0])
        self.centers = points[at]

    def __len__(self) -> int:
        return len(self.centers)

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gaps = squared_gaps(points, self.centers)
        return gaps.argmin(axis=1), np.sqrt(gaps.min(axis=1))

    def promise(self, queries: np.ndarray) -> np.ndarray:
        return queries @ self.centers.T

    def reach(self, queries: np.ndarray, known: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """The inner product with a point of a ball is at most that with its centre + |query| * radius."""
        bound = loose(queries @ self.centers.T + np.sqrt((queries * queries).sum(axis=1))[:, None] * radii)
        return ~(bound < known[:, None])


@dataclass
class Node:
    """Rows covered by a ball around center. Leaves hold rows, inner nodes children."""

    rows: np.ndarray
    center: np.ndarray
    radius: float
    norm: float
    children: list["Node"] = field(default_factory=list)

    def seal(self) -> None:
        """Children's balls as arrays, so that one product bounds them all."""
        self.centers = np.stack([c.center for c in self.children])
        self.radii = np.array([c.radius for c in self.children])
        self.leaf = np.array([not c.children for c in self.children])


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, leaf: int = 16) -> Node:
    """Each level covers its rows by balls of half the radius around a greedy net of them.

    A node is a leaf when it has few rows or all its rows coincide. Where points lie far
    apart from each other a level has as many balls as points.
    """
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    gaps = squared_gaps(own, own)
    middle = int(np.argmin(((own - own.mean(axis=0)) ** 2).sum(axis=1)))
    nearest, owner, nets = gaps[middle].copy(), np.zeros(len(rows), dtype=np.int64), 1
    radius, center = math.sqrt(nearest.max()), own[middle]
    node = Node(rows, center, radius, float(np.sqrt(center @ center)))
    if len(rows) <= leaf or radius == 0:
        return node
    while nearest.max() > radius * radius / 4:
        gap = gaps[int(np.argmax(nearest))]
        closer = gap < nearest
        nearest, owner = np.where(closer, gap, nearest), np.where(closer, nets, owner)
        nets += 1
    del gaps
    by_owner = np.argsort(owner, kind="stable")
    node.children = [cover_tree(points, rows[own], leaf) for own in np.split(by_owner, np.cumsum(np.bincount(owner, minlength=nets))[:-1]) if len(own)]
    node.seal()
    return node


class Best:
    """The k best candidates of every query so far; ties go to the earlier candidate.

    known holds each query's kth score found elsewhere, -inf if none.
    """

    def __init__(self, k: int, known: np.ndarray):
        self.k, self.least, self.scored = k, known.copy(), 0
        self.scores = np.full((len(known), k), -np.inf)
        self.rows = np.full((len(known), k), np.iinfo(np.int64).max, dtype=np.int64)

    def offer(self, queries: np.ndarray, scores: np.ndarray, rows: np.ndarray) -> None:
        self.scored += scores.size
        least = self.least[queries]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        fresh = (scores >= least[:, None]) & np.isfinite(scores)
        for i in np.flatnonzero(fresh.any(axis=1)):
            q, new = queries[i], np.flatnonzero(fresh[i])
            s, r = np.append(self.scores[q], scores[i, new]), np.append(self.rows[q], rows[new])
            keep = np.lexsort((r, -s))[: self.k]
            self.scores[q], self.rows[q] = s[keep], r[keep]
            self.least[q] = max(self.least[q], self.scores[q, -1])


def dual_search(queries: np.ndarray, points: np.ndarray, tree: Node, k: int, apart: Callable[[np.ndarray, np.ndarray], np.ndarray], known: np.ndarray, leaf: int = 16) -> Best:
    """Top-k inner products of each query over the tree of points; apart(i, j) is true for the pairs that may not meet.

    For balls around c and p, no inner product exceeds c.p + |c| r + |p| R + R r. A pair
    of nodes is pruned when that is below the worst kth score in the query node.
    """
    best, norms = Best(k, known), np.sqrt((queries * queries).sum(axis=1))

    def score(q: np.ndarray, p: np.ndarray) -> None:
        p = np.sort(p)
        best.offer(q, np.where(apart(q, p), -np.inf, queries[q] @ points[p].T), p)

    stack = [(cover_tree(queries, leaf=leaf), tree)]
    while stack:
        q, p = stack.pop()
        bound = q.center @ p.center + q.norm * p.radius + p.norm * q.radius + q.radius * p.radius
        if loose(bound) < best.least[q.rows].min():
            continue
        if q.children and (not p.children or q.radius >= p.radius):
            stack += [(c, p) for c in q.children]
        elif p.children:
            bounds = loose(queries[q.rows] @ p.centers.T + norms[q.rows][:, None] * p.radii)
            alive = (bounds >= best.least[q.rows][:, None]).any(axis=0)
            near = np.flatnonzero(alive & p.leaf)
            if len(near):
                score(q.rows, np.concatenate([p.children[c].rows for c in near]))
            # The most promising child is popped first.
            inner = np.flatnonzero(alive & ~p.leaf)
            stack += [(q, p.children[c]) for c in inner[np.argsort(bounds[:, inner].max(axis=0), kind="stable")]]
        else:
            score(q.rows, p.rows)
    return best


def top_inner_products(queries: DataFrame, candidates: DataFrame, k: int = 5, rows_per_block: int = 2048, sample: int = 8192) -> DataFrame:
    """Each query's k candidates of the largest inner product, exactly.

    Both tables: vec_id long, vector array<double> of whole numbers. Vectors whose largest
    component times the root of their length exceeds 2**26, so that sums in doubles may
    round, aren't in the trees: they meet every vector of the other table in tiles of
    integers. Scores beyond 64 bits stay at the ends of that range. A query never finds a row of its own vec_id;
    rows with a null vec_id, a null or non-finite component or no vector take no part;
    ties go to the smaller vec_id; a query with fewer candidates gets them all; rows
    repeated under one vec_id count each; empty tables give no rows. The balls of the top
    level are fitted on at most sample rows; they decide speed, not results.
    Returns query_id, rank, vec_id, score long.
    """

    def prepare(ids: np.ndarray, points: np.ndarray) -> Find:
        tree = cover_tree(points)

        def find(q_ids: np.ndarray, q: np.ndarray, known: np.ndarray) -> pd.DataFrame:
            best = dual_search(q, points, tree, k, lambda i, j: q_ids[i][:, None] == ids[j], np.where(np.isnan(known), -np.inf, known))
            real = np.isfinite(best.scores)
            return pd.DataFrame({"query_id": np.repeat(q_ids, k)[real.ravel()], "vec_id": ids[best.rows[real]], "score": best.scores[real]})

        return find

    wide = F.array_max(F.transform("vector", F.abs)) * F.sqrt(F.size("vector")) > EXACT
    queries, candidates = (df.where(sound(F.col("vector")) & F.col("vec_id").isNotNull()).select("vec_id", "vector") for df in (queries, candidates))
    found = search(queries.where(~wide), candidates.where(~wide), k, Balls, prepare, False, rows_per_block, sample=sample)
    found = found.withColumn("score", F.col("score").cast("long"))
    apart = [df.agg(F.count_if(wide)).first()[0] for df in (queries, candidates)]
    if not any(apart):
        return found
    parts = [found.drop("rank")]
    if apart[0]:
        parts.append(tiled(queries.where(wide), candidates, k))
    if apart[1]:
        parts.append(tiled(queries.where(~wide), candidates.where(wide), k))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def tiled(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's k best of every block of candidates, in exact integers."""
    rows = candidates.withColumn("dim", F.size("vector"))
    blocks = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    held = rows.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks"))).withColumn("asks", F.lit(False))
    asked = queries.withColumn("dim", F.size("vector")).join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    cols = ["dim", "block", "asks", "vec_id", "vector", F.lit(0).cast("long").alias("label"), F.col("vec_id").alias("anchor")]
    found = in_tiles(held.select(cols).unionByName(asked.select(cols)), ["dim", "block"], positives_in(k), "anchor long, positive_id long, positive_score long")
    return found.select(F.col("anchor").alias("query_id"), F.col("positive_id").alias("vec_id"), F.col("positive_score").alias("score"))


def scaled(embeddings: DataFrame, factor: int = 256) -> DataFrame:
    """vec_id and the vector with each component x as floor(factor * x) in doubles."""
    ok = embeddings.where(sound(F.col("embedding")))
    return ok.select("vec_id", whole_components(F.col("embedding").cast("array<double>"), factor).alias("vector"))
