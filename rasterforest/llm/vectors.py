"""Searches of a stated query set against all rows, over blocks of near vectors.

A sample of bounded size fixes the blocks; every row is placed in one, and large blocks are
dealt into parts of bounded size. A query first searches one part of its most promising
block. The kth score found there rules out whole blocks before it visits any other part, so
a candidate is shuffled once a round and a query only to the blocks it may still gain from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: find(query ids, queries, known kth scores or NaN) returns query_id, vec_id, score.
Find = Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]
PART = ["dim", "block", "part"]
#: Lengths of vectors that get blocks of their own, the most frequent ones; others are one block each.
FITTED_LENGTHS = 64


class Blocks(Protocol):
    """Blocks of the vectors of one length."""

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's block and its distance from what stands for the block."""

    def promise(self, queries: np.ndarray) -> np.ndarray:
        """For each query and block, how promising the block is (more is better)."""

    def reach(self, queries: np.ndarray, known: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """For each query and block, whether the block may hold something better than the known kth."""


def sound(vector: Column) -> Column:
    """True for a vector that isn't null or empty and holds finite numbers only."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~odd, F.lit(False))


def fit_blocks(rows: DataFrame, build: Callable[[np.ndarray, int], Blocks], rows_per_block: int, max_blocks: int, sample: int) -> dict[int, Blocks]:
    """Blocks by length of vector, from at most sample rows, the first by a hash of their id and vector: the same on every layout of the table."""
    lengths = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(FITTED_LENGTHS).collect()
    if not lengths:
        return {}
    drawn = rows.where(F.col("dim").isin([r["dim"] for r in lengths])).withColumn("_draw", F.xxhash64("vec_id", "vector"))
    drawn = drawn.orderBy("_draw", "vec_id").limit(sample).select("vector").toPandas()["vector"]
    out = {}
    for r in lengths:
        own = [v for v in drawn if len(v) == r["dim"]]
        if own:
            out[r["dim"]] = build(np.stack(own), max(1, min(max_blocks, -(-r["count"] // rows_per_block))))
    return out


def placed_rows(rows: DataFrame, fitted: dict[int, Blocks]) -> DataFrame:
    """rows with block, gap (their distance from it) and salt, which deals a block into parts."""

    @F.pandas_udf("block int, gap double")
    def place(vector: pd.Series) -> pd.DataFrame:
        blocks, gaps = np.zeros(len(vector), dtype=np.int32), np.zeros(len(vector))
        dims = vector.str.len().to_numpy()
        for dim in np.unique(dims):
            if dim in fitted:
                at = np.flatnonzero(dims == dim)
                blocks[at], gaps[at] = fitted[dim].place(np.stack(vector.iloc[at]))
        return pd.DataFrame({"block": blocks, "gap": gaps})

    return rows.withColumn("_at", place("vector")).select("vec_id", "vector", "dim", "_at.block", "_at.gap", F.xxhash64("vec_id", "vector").alias("salt"))


def visits(queries: DataFrame, fitted: dict[int, Blocks], radii: dict[int, np.ndarray], first: bool) -> DataFrame:
    """A row for each query and block: its home, the most promising one that isn't empty, or all that may still add to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                home, goes = np.zeros(len(own), dtype=np.int64), np.ones((len(own), 1), dtype=bool)
                if dim in fitted and dim in radii:
                    q, filled = np.stack(own["vector"]), radii[dim] >= 0
                    home = np.where(filled, fitted[dim].promise(q), -np.inf).argmax(axis=1)
                    goes = filled & fitted[dim].reach(q, own["known"].to_numpy(dtype=float), radii[dim])
                at, block = (np.arange(len(own)), home) if first else np.nonzero(goes)
                if len(at):
                    yield own.iloc[at].assign(block=block, home=home[at])

    return queries.mapInPandas(run, "vec_id long, vector array<double>, dim int, known double, block int, home int")


def search_parts(rows: DataFrame, queries: DataFrame, prepare: Callable[[np.ndarray, np.ndarray], Find]) -> DataFrame:
    """Run each part's queries, in batches, against its rows; one task holds the rows of one part at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, points, find = None, [], [], None
        for batch in batches:
            for own_key, own in batch.groupby([*PART, "asks"], sort=True):
                if own_key[:-1] != key:
                    key, ids, points, find = own_key[:-1], [], [], None
                vectors = np.stack(own["vector"])
                if not own_key[-1]:
                    ids.append(own["vec_id"].to_numpy())
                    points.append(vectors)
                elif ids:
                    find = find or prepare(np.concatenate(ids), np.concatenate(points))
                    found = find(own["vec_id"].to_numpy(), vectors, own["known"].to_numpy(dtype=float))
                    if len(found):
                        yield found

    cols = [*PART, "asks", "vec_id", "vector", "known"]
    rows = rows.join(queries.select(PART).distinct(), PART, "left_semi").withColumn("asks", F.lit(False)).withColumn("known", F.lit(None).cast("double"))
    both = rows.select(cols).unionByName(queries.withColumn("asks", F.lit(True)).select(cols))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(tasks, *PART).sortWithinPartitions(*PART, "asks", "vec_id")
    return dealt.mapInPandas(run, "query_id long, vec_id long, score double")


def search(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    build: Callable[[np.ndarray, int], Blocks],
    prepare: Callable[[np.ndarray, np.ndarray], Find],
    smallest: bool,
    rows_per_block: int,
    max_blocks: int = 256,
    sample: int = 8192,
) -> DataFrame:
    """Each query's k best rows: query_id, rank, vec_id, score double; ties go to the smaller vec_id.

    Both tables have vec_id and vector (array<double>). Vectors of different lengths are
    never compared. build makes the blocks of a length from sampled vectors; prepare readies
    the rows of a part (in order of vec_id) for its queries.
    """
    keep = Scratch(candidates.sparkSession, "vector-search")
    sized = [df.select("vec_id", "vector", F.size("vector").alias("dim")) for df in (candidates, queries)]
    fitted = fit_blocks(sized[0], build, rows_per_block, max_blocks, sample)
    rows = keep.keep(placed_rows(sized[0], fitted), "placed")
    blocks = keep.keep(rows.groupBy("dim", "block").agg(F.max("gap").alias("radius"), F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("parts")), "blocks")
    radii: dict[int, np.ndarray] = {}
    for r in blocks.where(F.col("dim").isin(list(fitted))).collect():  # at most max_blocks for each fitted length
        radii.setdefault(r["dim"], np.full(max_blocks, -1.0))[r["block"]] = r["radius"]
    radii = {dim: r[: len(fitted[dim])] for dim, r in radii.items()}
    rows = rows.join(blocks, ["dim", "block"]).withColumn("part", F.pmod("salt", "parts").cast("int"))

    order = F.col("score").asc() if smallest else F.col("score").desc()
    best = F.row_number().over(W.partitionBy("query_id").orderBy(order, F.col("vec_id").asc()))
    ask = keep.keep(visits(sized[1].withColumn("known", F.lit(None).cast("double")), fitted, radii, True).withColumn("part", F.lit(0)), "home")
    first = keep.keep(search_parts(rows.where("part = 0"), ask, prepare), "first")
    known = first.withColumn("rank", best).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    further = visits(sized[1].join(known, "vec_id", "left").select("vec_id", "vector", "dim", "known"), fitted, radii, False).join(blocks, ["dim", "block"])
    further = further.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("block <> home OR part > 0")
    found = first.unionByName(search_parts(rows, keep.keep(further, "further"), prepare))
    ranked = found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return keep.result(ranked, "vector-search")
