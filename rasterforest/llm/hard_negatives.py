"""Hard negatives: exact integer inner products of anchors and candidates by Strassen's multiplication.

Candidates lie in blocks of bounded size, and each block meets the anchors in batches: a
tile of anchors times a tile of candidates, in int64. The first pass, over rows of the
anchor's own label, keeps a list of the best positives in each block; lists of all blocks
merge. The second pass keeps, for each positive, the best rows of its window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, returning_memory
from .vectors import sound

#: Sides of tiles at or below which numpy multiplies them.
LEAF = 48
#: Rows of a block of candidates, and anchors that meet it at once.
BLOCK, BATCH = 4096, 512
LEAST = np.iinfo(np.int64).min
LAST = (1 << 63) - 1


def padded(x: np.ndarray) -> np.ndarray:
    """x with a row or column of zeros more where its sides are odd."""
    out = np.zeros((x.shape[0] + x.shape[0] % 2, x.shape[1] + x.shape[1] % 2), dtype=x.dtype)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two integer matrices by seven half-size products, odd sides padded with zeros.

    int64 stays int64: sums on the way may wrap, which leaves every entry right that fits
    itself. Arrays of Python integers are exact at any size.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = padded(a), padded(b)
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), dtype=a.dtype)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def whole_components(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as a double; beyond 2**53 doubles have no fractions, which floor's longs couldn't hold."""
    return F.transform(vector, lambda x: F.when(F.abs(x * factor) < 2.0**53, F.floor(x * factor).cast("double")).otherwise(x * factor))


def whole_numbers(x: np.ndarray, room: float) -> np.ndarray:
    """Doubles without fractions as int64 where products stay below 2**63, else as Python integers."""
    return x.astype(np.int64) if room < 2.0**62 else np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two arrays of whole doubles, as int64; beyond its range they stay at its ends."""
    most = lambda x: float(np.abs(x).max(initial=0.0))
    room = max(most(a) * most(b) * max(a.shape[1], 1), most(a), most(b))
    out = strassen(whole_numbers(a, room), np.ascontiguousarray(whole_numbers(b, room).T))
    return out if out.dtype == np.int64 else np.clip(out, -LAST, LAST).astype(np.int64)


def best(scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k times, the rows that still have an entry above LEAST and the place of their greatest, the first among equals; changes scores."""
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        rows = np.flatnonzero(scores[np.arange(len(at)), at] > LEAST)
        if not len(rows):
            return
        yield rows, at[rows]
        scores[rows, at[rows]] = LEAST


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


Tile = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch], dict]


def in_tiles(both: DataFrame, key: list[str], find: Tile, result: str) -> DataFrame:
    """Each block's anchors, in batches, against its candidates; a task holds one block at a time.

    both: the key, asks (True for anchors, which come after the block's candidates), vec_id,
    label, vector and what find reads of the anchors. find gets the products, the
    candidates' ids (ascending) and labels, the anchors' labels, and their rows.
    """
    tasks = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in (*key, "asks")]))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if keys[lo][:-1] != now:
                    now, parts, held = keys[lo][:-1], [], None
                own = b.slice(lo, hi - lo)
                if not keys[lo][-1]:
                    parts.append((own.column("vec_id").to_numpy(), own.column("label").to_numpy(), matrix(own.column("vector"))))
                    continue
                if not parts:
                    continue
                held = held or tuple(np.concatenate(p) for p in zip(*parts))
                for at in range(0, len(own), BATCH):
                    asked = own.slice(at, BATCH)
                    found = find(products(matrix(asked.column("vector")), held[2]), held[0], held[1], asked.column("label").to_numpy(), asked)
                    yield pa.RecordBatch.from_pydict(found)

    return both.repartition(tasks, *key).sortWithinPartitions(*key, "asks", "vec_id").mapInArrow(run, result)


def positives_in(k: int) -> Tile:
    def find(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, own: np.ndarray, asked: pa.RecordBatch) -> dict:
        # The anchor itself, and rows that repeat its id, are no positives.
        scores[ids[None, :] == asked.column("vec_id").to_numpy()[:, None]] = LEAST
        kept = scores.copy()
        found = list(best(scores, k))
        rows, at = (np.concatenate([f[i] for f in found]) if found else np.empty(0, dtype=np.int64) for i in (0, 1))
        anchor = asked.column("anchor").to_numpy()
        return {"anchor": pa.array(anchor[rows], pa.int64()), "positive_id": pa.array(ids[at], pa.int64()), "positive_score": pa.array(kept[rows, at], pa.int64())}

    return find


def negatives_in(k: int) -> Tile:
    def find(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, own: np.ndarray, asked: pa.RecordBatch) -> dict:
        other = labels[None, :] != own[:, None]
        out: list[list[np.ndarray]] = [[], [], [], []]
        anchor = asked.column("anchor").to_numpy()
        lists = asked.column("windows").to_pylist()
        for place in range(max((len(x) for x in lists), default=0)):
            rows = np.array([i for i, x in enumerate(lists) if len(x) > place])
            low, high = (np.array([lists[i][place][c] for i in rows], dtype=np.int64)[:, None] for c in ("low", "high"))
            inside = np.where(other[rows] & (scores[rows] >= low) & (scores[rows] <= high), scores[rows], LEAST)
            for r, at in best(inside, k):
                out[0].append(anchor[rows[r]])
                out[1].append(np.full(len(r), place))
                out[2].append(ids[at])
                out[3].append(scores[rows[r], at])
        joined = [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in out]
        return {n: pa.array(x, t) for n, x, t in zip(("anchor", "place", "negative_id", "negative_score"), joined, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))}

    return find


def blocked(rows: DataFrame, key: list[str], keep: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """rows dealt into blocks of about BLOCK within each key, and the number of blocks of each key."""
    sizes = keep.keep(rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), name)
    return rows.join(sizes, key).withColumn("block", F.pmod("_row", "blocks").cast("int")).drop("blocks"), sizes


def merged(found: DataFrame, by: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    """The k best of the lists that blocks kept, with rank."""
    w = W.partitionBy(*by).orderBy(F.desc(score), vec_id)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine_hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, vector (array<double> of whole numbers); anchors says which of
    them are anchors. An anchor's positives are the best other rows of its label; for each
    of them the best rows of other labels with low * p <= 100 * score <= high * p are
    ranked, p being the positive's score. Higher scores come first, ties by smaller vec_id.
    Rows with a null label or a null, empty or unsound vector take no part; vectors of
    different lengths are never compared. Rows that repeat the anchor's id are no positives
    of it. A null vec_id is never an anchor and comes last among ties. Scores beyond 64
    bits count as its ends. Without positives or fitting negatives an anchor has no row; an
    empty table gives none. Other columns are ignored.
    """
    keep = Scratch(rows.sparkSession, "hard-negatives")
    fit = rows.where(F.col("label").isNotNull() & sound(F.col("vector"))).withColumn("asks", F.coalesce(anchors & F.col("vec_id").isNotNull(), F.lit(False)))
    fit = fit.select(F.coalesce("vec_id", F.lit(LAST)).alias("vec_id"), F.col("label").cast("long").alias("label"), "vector", F.size("vector").alias("dim"), "asks")
    fit = keep.keep(fit.withColumn("_row", F.monotonically_increasing_id()), "rows")
    asking = fit.where("asks").withColumn("anchor", F.col("_row"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cols = ["asks", "vec_id", "vector", "anchor"]

    key = ["dim", "label"]
    held, sizes = blocked(fit.join(asking.select(key).distinct(), key, "left_semi"), key, keep, "label-blocks")
    held = held.withColumn("asks", F.lit(False)).withColumn("anchor", F.lit(None).cast("long")).select(*key, "block", *cols)
    both = held.unionByName(asking.join(sizes, key).withColumn("block", every).select(*key, "block", *cols))
    found = keep.keep(in_tiles(both, [*key, "block"], positives_in(positives), "anchor long, positive_id long, positive_score long"), "positives")
    top = keep.keep(merged(found, ["anchor"], "positive_score", "positive_id", positives).withColumnRenamed("rank", "place").withColumn("place", F.col("place") - 1), "top-positives")

    # 100 * score between the bounds, in whole scores; a product beyond 64 bits can't wrap in decimals.
    p = F.col("positive_score").cast("decimal(20,0)")
    window = F.struct("place", F.ceil(p * low / 100).cast("long").alias("low"), F.floor(p * high / 100).cast("long").alias("high"))
    asked = asking.join(top.groupBy("anchor").agg(F.array_sort(F.collect_list(window)).alias("windows")), "anchor")
    held, sizes = blocked(fit, ["dim"], keep, "blocks")
    cols = ["dim", "block", "asks", "vec_id", "label", "vector", "anchor", "windows"]
    held = held.withColumn("asks", F.lit(False)).withColumn("anchor", F.lit(None).cast("long")).withColumn("windows", F.lit(None).cast(dict(asked.dtypes)["windows"])).select(cols)
    both = held.unionByName(asked.join(sizes, "dim").withColumn("block", every).select(cols))
    found = keep.keep(in_tiles(both, ["dim", "block"], negatives_in(negatives), "anchor long, place int, negative_id long, negative_score long"), "negatives")
    ranked = merged(found, ["anchor", "place"], "negative_score", "negative_id", negatives).join(top, ["anchor", "place"])
    out = ranked.join(asking.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    none = lambda c: F.nullif(F.col(c), F.lit(LAST)).alias(c)
    return keep.result(out.select("anchor_id", none("positive_id"), "rank", none("negative_id"), "positive_score", "negative_score"), "hard-negatives")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS vector FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.vector, c.vector)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.vector) = len(c.vector) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""
