"""Ranked lexical search: documents with equal bags of the items' words are scored once.

Items are searched in blocks of bounded vocabulary, each block against all documents. A
document is reduced to its counts of the block's words and to its length term; documents
that agree in both form a class. Classes are scored against all items of the block, and
the best classes are expanded to their documents by ascending doc_id.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, in_small_batches, returning_memory

#: Bytes that aren't part of a term become spaces, A to Z lower case; all else stays.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Distinct words of items, each counted for each item, that one block holds.
BLOCK_WORDS = 1 << 18
#: Products that a task forms at once.
HELD = 1 << 21
LAST = (1 << 63) - 1
BAG = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLDED).split() if text else []


def item_words(items: DataFrame) -> DataFrame:
    """_item, word and count: the distinct words of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("_item").to_pylist(), b.column("text").to_pylist()):
                if own := Counter(terms(text)):
                    yield pa.RecordBatch.from_pydict({"_item": [item] * len(own), "word": pa.array(list(own), pa.binary()), "count": pa.array(list(own.values()), pa.int64())})

    return items.select("_item", "text").mapInArrow(run, "_item long, word binary, count long")


def bags(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """doc_id, number of terms, and the counts of the given words by ascending number."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in batches:
            sizes, ids, tfs, ends = [], [], [], [0]
            for text in b.column("text"):
                own = terms(text.as_py())
                met = sorted((number[w], c) for w, c in Counter(own).items() if w in number)
                sizes.append(len(own))
                ids += [i for i, _ in met]
                tfs += [c for _, c in met]
                ends.append(len(ids))
            of = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), of(ids), of(tfs)], ["doc_id", "n", "terms", "tfs"])

    return in_small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, BAG)


def classes(bag_table: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """A row for each class: terms, tfs, m and its k least doc_ids in order, nulls last.

    The hash brings equal bags together; the window compares the bags themselves. Each task
    hands on k documents of a class at most, so a class of any size passes.
    """
    m = F.lit(25) + F.expr(f"(75 * n * {n_docs}L) div {max(n_terms, 1)}L")
    bag = bag_table.where(F.size("terms") > 0).select("doc_id", "terms", "tfs", m.alias("m"))
    bag = bag.withColumn("hash", F.xxhash64("terms", "tfs", "m"))
    key = ["hash", "m", "terms", "tfs"]
    least = F.row_number().over(W.partitionBy(*key).orderBy(F.asc_nulls_last("doc_id")))
    first = bag.withColumn("place", least).where(F.col("place") <= k)
    # Nulls are LAST inside, as collected lists leave nulls out.
    return first.groupBy(*key).agg(F.array_sort(F.collect_list(F.coalesce("doc_id", F.lit(LAST)))).alias("members")).drop("hash")


def best_classes(class_table: DataFrame, weights: np.ndarray, items: list[list[tuple[int, int]]], k: int) -> DataFrame:
    """_item (its place in items), score and members: the k best classes of each task, by score and least member."""
    pairs = sorted((w, i, c) for i, words in enumerate(items) for w, c in words)
    words, at, counts = (np.array([p[j] for p in pairs], dtype=np.int64) for j in range(3))
    # The columns of the word-by-item matrix that each word has, as ranges of the sorted pairs.
    starts = np.searchsorted(words, np.arange(len(weights) + 1))
    shared = class_table.sparkSession.sparkContext.broadcast((starts, at, counts * weights[words] if len(words) else counts, len(items)))

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, at, gains, n_items = shared.value
        heaps: list[list[tuple[int, int, list[int]]]] = [[] for _ in range(n_items)]
        floor = np.zeros(n_items, dtype=np.int64)
        for b in batches:
            ends = b.column("terms").offsets.to_numpy()
            ids, tfs = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            ends = ends - ends[0]
            ms = b.column("m").to_numpy()
            held = np.append(0, np.cumsum(starts[ids + 1] - starts[ids]))
            members = b.column("members")
            lo = 0
            while lo < len(ms):
                # As many classes as fit; one class alone always goes.
                hi = max(lo + 1, min(int(np.searchsorted(held[ends], held[ends[lo]] + HELD, "right")) - 1, lo + max(1, HELD // max(n_items, 1))))
                own = slice(ends[lo], ends[hi])
                of = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                share = (1_000_000_000 * tfs[own]) // (1000 * tfs[own] + 8 * ms[lo:hi][of])
                width = starts[ids[own] + 1] - starts[ids[own]]
                first = np.cumsum(width) - width
                pick = np.repeat(starts[ids[own]] - first, width) + np.arange(int(width.sum()))
                scores = np.zeros((hi - lo) * n_items, dtype=np.int64)
                np.add.at(scores, np.repeat(of * n_items, width) + at[pick], np.repeat(share, width) * gains[pick])
                scores = scores.reshape(hi - lo, n_items)
                for c, i in zip(*np.nonzero((scores > 0) & (scores >= floor))):
                    who = members[lo + int(c)].as_py()
                    entry = (int(scores[c, i]), -who[0], who)
                    heap = heaps[i]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        floor[i] = heap[0][0]
                lo = hi
        found = [(i, s, who) for i, heap in enumerate(heaps) for s, _, who in heap]
        if found:
            i, s, who = zip(*found)
            yield pa.RecordBatch.from_pydict({"_item": pa.array(i, pa.int32()), "score": pa.array(s, pa.int64()), "members": pa.array(who, pa.list_(pa.int64()))})

    return in_small_batches(class_table).select("terms", "tfs", "m", "members").mapInArrow(run, "_item int, score long, members array<long>")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each item's k best documents: item_id, rank (from 1), doc_id, score; best first, ties by ascending doc_id.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Only scores above
    0 are returned, so items without terms, or whose terms no document has, have no rows.
    Null and empty texts have no terms. Each row of items is an item, also where ids repeat
    or are null; repeated documents each take a rank; null doc_ids come after all others of
    the same score (inside, 2**63 - 1 stands for them). Empty tables give no rows.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "lexical")
    asked = keep.keep(items.select("item_id", "text").withColumn("_item", F.monotonically_increasing_id()), "items")
    pairs = keep.keep(item_words(asked), "item-words")
    blocks = max(1, -(-pairs.count() // block_words))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("_item"), F.lit(blocks)))
    out, size = [], None
    for block in range(blocks):
        rows = pairs.where(F.col("block") == block).select("_item", "word", "count").collect()  # about block_words
        number = {w: i for i, w in enumerate(sorted({bytes(r["word"]) for r in rows}))}
        names = sorted({r["_item"] for r in rows})
        words: dict[int, list[tuple[int, int]]] = {i: [] for i in names}
        for r in rows:
            words[r["_item"]].append((number[bytes(r["word"])], r["count"]))
        bag = keep.keep(bags(docs, number), "bags")
        size = size or bag.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(number), dtype=np.int64)
        for r in bag.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one for each word of the block
            weights[r["t"]] = math.floor(1000 * math.log((2 * size[0] + 2) / (2 * r["count"] + 1)))
        found = best_classes(classes(bag, size[0], size[1], k), weights, [words[i] for i in names], k)
        order = (F.desc("score"), F.asc("doc_id"))
        found = found.withColumn("part", F.spark_partition_id() % 64).select("_item", "part", "score", F.explode("members").alias("doc_id"))
        # Tasks' lists meet in 64 parts before they meet as one.
        for by in (["_item", "part"], ["_item"]):
            found = found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        ids = F.array(*[F.lit(i) for i in names]) if names else F.array().cast("array<long>")
        out.append(keep.keep(found.select(F.get(ids, "_item").alias("_item"), "rank", F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "score"), "found"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return keep.result(found.join(asked.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score"), "lexical")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
z AS (SELECT count(DISTINCT r) AS n_docs, count(*) AS n_terms FROM d),
s AS (SELECT r, 25 + (75 * count(*) * (SELECT n_docs FROM z)) // (SELECT n_terms FROM z) AS m FROM d GROUP BY r),
tf AS (SELECT r, any_value(doc_id) AS doc_id, t, count(*) AS tf FROM d GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * (SELECT n_docs FROM z) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY t),
x AS (SELECT q, any_value(item_id) AS item_id, tf.r, any_value(tf.doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN tf ON i.t = tf.t JOIN w ON w.t = tf.t JOIN s ON s.r = tf.r GROUP BY q, tf.r),
o AS (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id))::INTEGER AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
