"""Stupid-backoff language-model scores, computed against count tables partitioned by hash.

Blocks of documents ask for the counts of their distinct n-grams; the questions are
partitioned by n-gram hash, where the counts of all blocks meet, and each block gets its
answers back and sums the scores of its documents. A frequent n-gram costs one entry per
block, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, materialize, returning_memory, word_count
from .jaccard import mixed

BLOCK_BYTES = 8 << 20
#: Distinct n-grams that one partition of the count table should hold about.
BUCKET_GRAMS = 1 << 21
REST_BITS = 40


def word_hashes(text: str | None, memo: dict[bytes, int]) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    for w in words:
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(words: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1-grams to order-grams; each is the context's hash with a word added."""
    out = [mixed(words + np.uint64(1))]
    for n in range(2, order + 1):
        out.append(mixed(out[-1][: len(words) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :] + np.uint64(n)) if len(words) >= n else words[:0])
    return out


class Block:
    """The n-grams of a block's documents by partition and hash, 40 bits within a partition."""

    def __init__(self, texts: list[str | None], order: int, bits: int):
        memo: dict[bytes, int] = {}
        self.docs = [[self.cut(g, bits) for g in grams(word_hashes(t, memo), order)] for t in texts]
        every = [g for doc in self.docs for g in doc]
        self.grams, self.counts = np.unique(np.concatenate(every) if every else np.empty(0, np.uint64), return_counts=True)
        self.bounds = np.searchsorted(self.grams, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(REST_BITS))

    @staticmethod
    def cut(h: np.ndarray, bits: int) -> np.ndarray:
        return h >> np.uint64(64 - bits - REST_BITS)

    def questions(self) -> Iterator[tuple[int, bytes, bytes]]:
        for bucket in np.flatnonzero(np.diff(self.bounds)):
            part = slice(self.bounds[bucket], self.bounds[bucket + 1])
            yield int(bucket), packed(np.diff(self.grams[part] & np.uint64((1 << REST_BITS) - 1), prepend=np.uint64(0))), packed(self.counts[part].astype(np.uint64))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in 1, 4 or 8 bytes each, as the largest of the most part needs; the first byte says which."""
    for code, kind in ((1, np.uint8), (4, np.uint32)):
        top = np.iinfo(kind).max
        odd = np.flatnonzero(x >= top)
        if len(odd) <= len(x) // 16:
            low = np.minimum(x, np.uint64(top)).astype(kind)
            return bytes([code]) + np.uint32(len(x)).tobytes() + low.tobytes() + x[odd].astype(np.uint64).tobytes()
    return bytes([8]) + np.uint32(len(x)).tobytes() + x.astype(np.uint64).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    code, n = b[0], int(np.frombuffer(b[1:5], dtype=np.uint32)[0])
    kind = {1: np.uint8, 4: np.uint32, 8: np.uint64}[code]
    x = np.frombuffer(b[5 : 5 + code * n], dtype=kind).astype(np.uint64)
    if code < 8:
        x[x == np.iinfo(kind).max] = np.frombuffer(b[5 + code * n :], dtype=np.uint64)
    return x


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block: its number, the documents' ids and their texts, compressed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        import zstandard

        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        pack = zstandard.ZstdCompressor(level=6).compress

        def row(held: list) -> pd.DataFrame:
            return pd.DataFrame({"block": [number], "docs": [pack(pickle.dumps(held))]})

        held, size = [], 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                text = text if isinstance(text, str) else None
                held.append((None if pd.isna(doc_id) else int(doc_id), text))
                size += len(text or "")
                if size >= block_bytes:
                    yield row(held)
                    held, size, number = [], 0, number + 1
        if held:
            yield row(held)

    return in_small_batches(docs).select("doc_id", "text").mapInPandas(returning_memory(run), "block long, docs binary")


def opened(data: bytes) -> list[tuple[int | None, str | None]]:
    import pickle

    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def scores(doc: list[np.ndarray], place: list[np.ndarray], total: np.ndarray, all_words: int, backoff: float) -> float:
    """Sum of log10 scores of a document's words, from counts in all other documents.

    place has the positions of each order's n-grams in the table of totals.
    """
    n = len(doc[0])
    others = []
    for at in place:
        _, inverse, own = np.unique(at, return_inverse=True, return_counts=True)
        others.append(total[at] - own[inverse])
    rest = all_words - n
    # Words that no other document has count as half an occurrence.
    found = np.log10(np.maximum(others[0], 0.5) / max(rest, 1))
    for k in range(1, len(doc)):
        if n <= k:
            break
        # The k-gram context of the word at i + k starts at i.
        context, gram = others[k - 1][: n - k].astype(np.float64), others[k].astype(np.float64)
        seen = gram > 0
        found[k:] = np.where(seen, np.log10(np.where(seen, gram, 1) / np.where(seen, context, 1)), np.log10(backoff) + found[k:])
    return float(found.sum())


def backoff_scores(docs: DataFrame, order: int = 3, backoff: float = 0.4, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words and score, the sum of log10 stupid-backoff scores of its words.

    docs: doc_id, text; other columns are ignored. Counts are over all documents; a row's
    own n-grams are left out of its score, so a text isn't told by itself, while other
    copies of it count. A word's score is the count of its longest n-gram over that of
    its context; where other documents don't have it, backoff times the score with one
    word less; a word of no other document counts as half an occurrence. Words are those
    between white space, A-Z lowered. Null and empty texts have no words and score 0; rows
    with a null doc_id and repeated rows are documents of their own; an empty table gives
    no rows.
    """
    all_words = docs.agg(F.sum(word_count(F.col("text"))).alias("n")).first()["n"] or 0
    bits = max(1, int(np.ceil(np.log2(max(2, all_words * order * 0.6 / BUCKET_GRAMS)))))
    stored = materialize(blocks(docs, block_bytes), "lm-blocks")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, data in zip(pdf["block"], pdf["docs"]):
                asked = Block([t for _, t in opened(data)], order, bits)
                yield pd.DataFrame([(number, *q) for q in asked.questions()], columns=["block", "bucket", "grams", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpacked(b)) for b in pdf["grams"]]
        own = np.concatenate([unpacked(b) for b in pdf["counts"]])
        # The block's own count is added once more to each entry's place in the sorted table.
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=own.astype(np.float64)).astype(np.uint64)[inverse]
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "totals": [packed(t) for t in np.split(total, ends[:-1])]})

    def sum_up(held: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data in held["docs"]:
            rows = opened(data)
            block = Block([t for _, t in rows], order, bits)
            total = np.zeros(len(block.grams), dtype=np.int64)
            for bucket, totals in zip(answers["bucket"], answers["totals"]):
                total[block.bounds[bucket] : block.bounds[bucket + 1]] = unpacked(totals)
            for (doc_id, _), doc in zip(rows, block.docs):
                place = [np.searchsorted(block.grams, g) for g in doc]
                out.append((doc_id, len(doc[0]), scores(doc, place, total, all_words, backoff) if len(doc[0]) else 0.0))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "score"]).astype({"doc_id": "Int64"})

    asked = stored.mapInPandas(ask, "block long, bucket long, grams binary, counts binary")
    answers = asked.groupBy("bucket").applyInPandas(answer, "block long, bucket long, totals binary")
    return stored.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(sum_up, "doc_id long, n_words long, score double")


#: The same rows for another engine, from exploded n-grams and count tables.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, w FROM d),
g AS (SELECT r, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] END AS c1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS c2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3 FROM t),
a AS (SELECT r, g1 AS g, count(*) AS own FROM g GROUP BY ALL UNION ALL SELECT r, g2, count(*) FROM g WHERE g2 IS NOT NULL GROUP BY ALL UNION ALL SELECT r, g3, count(*) FROM g WHERE g3 IS NOT NULL GROUP BY ALL),
c AS (SELECT r, g, sum(own) OVER (PARTITION BY g) - own AS n FROM a),
s AS (SELECT g.r, log10(greatest(n1.n, 0.5::DOUBLE) / greatest((SELECT count(*) FROM t) - len(d.w), 1)) AS s1, n1.n AS n1, x1.n AS x1, n2.n AS n2, x2.n AS x2, n3.n AS n3
  FROM g JOIN d ON g.r = d.r JOIN c n1 ON n1.r = g.r AND n1.g = g.g1 LEFT JOIN c x1 ON x1.r = g.r AND x1.g = g.c1 LEFT JOIN c n2 ON n2.r = g.r AND n2.g = g.g2 LEFT JOIN c x2 ON x2.r = g.r AND x2.g = g.c2 LEFT JOIN c n3 ON n3.r = g.r AND n3.g = g.g3),
b AS (SELECT r, CASE WHEN n3 > 0 THEN log10(n3::DOUBLE / x2) WHEN n2 > 0 THEN log10(n2::DOUBLE / x1) + CASE WHEN n3 IS NULL THEN 0 ELSE log10(0.4::DOUBLE) END
  ELSE s1 + CASE WHEN n2 IS NULL THEN 0 WHEN n3 IS NULL THEN log10(0.4::DOUBLE) ELSE 2 * log10(0.4::DOUBLE) END END AS v FROM s)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(coalesce(sum(v), 0), 6) AS score FROM d LEFT JOIN b ON d.r = b.r GROUP BY d.r, d.doc_id, d.w
"""
