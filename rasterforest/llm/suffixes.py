"""Removal of long byte strings that occur elsewhere, by comparing sampled suffixes.

Every string of `length` bytes holds a sampled position, chosen by the string's own bytes
(the leftmost least hash of a short gram, over the window of grams that fit). So two equal
strings hold a sampled suffix at the same place, and only sampled suffixes meet: a shuffle
brings those with the same gram together, spilling to disk. From them the other suffixes
follow: a sampled suffix whose whole surroundings occur twice covers all of them; for the
rest, the strings at each distance before the sampled position are compared by hashes.

No full suffix array is sorted: its tuples would take 16 times the text, and the disk that
this operator may use is four times the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_small_batches, returning_memory
from .jaccard import mixed

GRAM = 32
#: Contexts in one task's group, and beyond how many a gram's contexts are dealt out by window.
GROUP_CONTEXTS = 2048
#: Strings of hot grams in one task's group.
BUCKET_STRINGS = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: A fixed 64-bit number for each byte.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
CHUNK = 1 << 22


def gram_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-byte strings, n a power of two, by doubling."""
    h, m = BYTES[x], 1
    while m < n:
        h = (h[:-m] * BASE) ^ (h[m:] + (h[:-m] >> np.uint64(31)))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        m *= 2
    return mixed(h)


def sampled(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of a byte array and the hashes of their grams."""
    window = length - GRAM + 1
    positions, grams = [], []
    # Each chunk has all grams of the windows that start in it.
    for at in range(0, len(x) - length + 1, CHUNK):
        h = gram_hashes(x[at : at + CHUNK + length - 1], GRAM)
        low = np.uint64(0xFFFFFF)
        least, m = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * m <= window:
            least = np.minimum(least[:-m], least[m:])
            m *= 2
        least = np.minimum(least[: len(h) - window + 1], least[window - m :][: len(h) - window + 1])
        p = (least & low).astype(np.int64)
        p = p[np.append(True, p[1:] != p[:-1])]
        positions.append(p + at)
        grams.append(h[p])
    if not positions:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    p, g = np.concatenate(positions), np.concatenate(grams)
    p, first = np.unique(p, return_index=True)
    return p, g[first]


def encoded(text: object) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def sample_table(keyed: DataFrame, length: int) -> DataFrame:
    """key, position, gram and the hash of the surroundings of each sampled suffix."""
    left = length - GRAM

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for pdf in batches:
            for begin in range(0, len(pdf), 256):
                part, out = pdf.iloc[begin : begin + 256], []
                for key, text in zip(part["key"], part["text"]):
                    data = encoded(text)
                    if len(data) < length:
                        continue
                    p, g = sampled(np.frombuffer(data, dtype=np.uint8), length)
                    # How far the surroundings reach to the left is a part of their hash.
                    around = np.fromiter((digest(data[max(0, i - left) : i + length], min(i, left)) for i in p.tolist()), dtype=np.uint64, count=len(p))
                    out.append(pd.DataFrame({"key": key, "position": p, "gram": g.view(np.int64), "around": around.view(np.int64)}))
                if out:
                    yield pd.concat(out)

    return in_small_batches(keyed).mapInPandas(returning_memory(run), "key long, position long, gram long, around long")


def contexts(texts: DataFrame, length: int) -> DataFrame:
    """The surroundings of the positions listed with each text."""
    left = length - GRAM

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for begin in range(0, len(pdf), 128):
                part, rows = pdf.iloc[begin : begin + 128], []
                for key, text, open_ in zip(part["key"], part["text"], part["open"]):
                    data = encoded(text)
                    rows += [(key, o["position"], o["gram"], max(0, o["position"] - left), data[max(0, o["position"] - left) : o["position"] + length]) for o in open_]
                yield pd.DataFrame(rows, columns=["key", "position", "gram", "start", "bytes"])

    return in_small_batches(texts).select("key", "text", "open").mapInPandas(returning_memory(run), "key long, position long, gram long, start long, bytes binary")


def window_hashes(pdf: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts: row, first byte and hash of each string of the length that holds the sampled gram."""
    width = 2 * length - GRAM
    sizes = pdf["bytes"].map(len).to_numpy()
    x = np.zeros((len(pdf), width), dtype=np.uint8)
    for i, b in enumerate(pdf["bytes"]):
        x[i, : len(b)] = np.frombuffer(b, dtype=np.uint8)
    total, powers = np.zeros((len(pdf), width + 1), dtype=np.uint64), np.uint64(1)
    for j in range(width):
        total[:, j + 1] = total[:, j] * BASE + BYTES[x[:, j]]
    for _ in range(length):
        powers = np.uint64((int(powers) * int(BASE)) & 0xFFFFFFFFFFFFFFFF)
    hashes = total[:, length:] - total[:, : width + 1 - length] * powers
    at = np.arange(hashes.shape[1])
    anchor = (pdf["position"] - pdf["start"]).to_numpy()
    ok = (at[None, :] + length <= sizes[:, None]) & (at[None, :] <= anchor[:, None])
    row, col = np.nonzero(ok)
    return row, pdf["start"].to_numpy()[row] + col, mixed(hashes[row, col] ^ mixed(pdf["gram"].to_numpy().view(np.uint64))[row])


def place(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One number for a place in a text: a string met through two samples is one place."""
    return mixed(mixed(key.view(np.uint64)) + start.astype(np.uint64))


def equal(key: np.ndarray, start: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose hash also stands at another place, and one row for each hash."""
    spot, order = place(key, start), np.argsort(h, kind="stable")
    if not len(h):
        return order, order
    cut = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    low, high = np.minimum.reduceat(spot[order], cut), np.maximum.reduceat(spot[order], cut)
    return order[np.repeat(low != high, np.diff(np.append(cut, len(h))))], order[cut]


def runs(key: np.ndarray, start: np.ndarray, length: int) -> pd.DataFrame:
    """Union of the spans from each start, by key."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    if not len(key):
        return pd.DataFrame({"key": [], "begin": [], "end": []}, dtype="int64")
    first = np.append(True, (key[1:] != key[:-1]) | (start[1:] > start[:-1] + length))
    last = np.append(first[1:], True)
    return pd.DataFrame({"key": key[first], "begin": start[first], "end": start[last] + length})


def repeated_spans(keyed: DataFrame, length: int) -> DataFrame:
    """key and the sorted spans (begin, end) of repeated strings, for keys that have any."""
    left = length - GRAM
    scratch = Scratch(keyed.sparkSession, "suffixes")
    keep = scratch.keep
    samples = keep(sample_table(keyed, length), "samples")
    twice = keep(samples.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("gram"), "grams")
    every, samples = samples, keep(samples.join(twice, "gram"), "candidates")
    scratch.drop(every, twice)
    # Surroundings are compared through one place each; a gram whose surroundings all occur
    # twice has nothing open.
    kinds = samples.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "position")).alias("one"))
    kinds = keep(kinds, "kinds")
    whole = samples.join(kinds.where(F.col("n") > 1).select("gram", "around"), ["gram", "around"], "left_semi")
    lone = keep(kinds.groupBy("gram").agg(F.min("n").alias("least")).where(F.col("least") == 1).select("gram"), "open")
    lone = kinds.join(lone, "gram", "left_semi").select("one.key", "one.position", "gram")
    lists = whole.select("key", "position", F.lit(None).cast("long").alias("gram")).unionByName(lone).groupBy("key").agg(
        F.collect_set(F.when(F.col("gram").isNull(), F.col("position"))).alias("whole"),
        F.collect_set(F.when(F.col("gram").isNotNull(), F.struct("position", "gram"))).alias("open"),
    )
    lists = keep(lists, "lists")
    scratch.drop(samples, kinds)

    texts = keyed.join(lists.where(F.size("open") > 0).select("key", "open"), "key")
    around = keep(contexts(texts, length), "contexts")
    counts = keep(around.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "counts")
    total = counts.agg(F.coalesce(F.sum(F.when(F.col("n") <= GROUP_CONTEXTS, F.col("n"))), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    groups = max(1, -(-total[0] // GROUP_CONTEXTS))
    sized = around.join(counts, "gram")
    span = "key long, begin long, end long"

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        row, start, h = window_hashes(pdf, length)
        key = pdf["key"].to_numpy()[row]
        hit, _ = equal(key, start, h)
        return runs(key[hit], start[hit], length)

    few = sized.where(F.col("n") <= GROUP_CONTEXTS).withColumn("group", F.pmod(F.xxhash64("gram"), F.lit(groups)))
    spans = few.groupBy("group").applyInPandas(compare, span)
    if total[1] > GROUP_CONTEXTS:
        # A hot gram's strings are dealt by their own hashes, once for each batch of contexts;
        # those that a batch has twice are known to be repeated at once.
        hot = sized.where(F.col("n") > GROUP_CONTEXTS)
        buckets = max(1, -(-hot.count() * (left + 1) // BUCKET_STRINGS))

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for begin in range(0, len(pdf), 4096):
                    part = pdf.iloc[begin : begin + 4096]
                    row, start, h = window_hashes(part, length)
                    key = part["key"].to_numpy()[row]
                    hit, first = equal(key, start, h)
                    yield runs(key[hit], start[hit], length).assign(bucket=None, data=None)
                    bucket = (h[first] % np.uint64(buckets)).astype(np.int64)
                    data = np.stack([h[first].view(np.int64), key[first], start[first]], axis=1)
                    rows = [(int(b), data[bucket == b].tobytes()) for b in np.unique(bucket)]
                    yield pd.DataFrame(rows, columns=["bucket", "data"]).assign(key=None, begin=None, end=None)

        def meet(pdf: pd.DataFrame) -> pd.DataFrame:
            h, key, start = np.concatenate([np.frombuffer(b, dtype=np.int64).reshape(-1, 3) for b in pdf["data"]]).T
            hit, _ = equal(key.copy(), start, h.astype(np.int64).view(np.uint64))
            return runs(key[hit], start[hit], length)

        dealt = keep(hot.mapInPandas(deal, f"{span}, bucket long, data binary"), "strings")
        spans = spans.unionByName(dealt.where(F.col("bucket").isNull()).select("key", "begin", "end"))
        spans = spans.unionByName(dealt.where(F.col("bucket").isNotNull()).select("bucket", "data").groupBy("bucket").applyInPandas(meet, span))
    spans = spans.select("key", F.struct("begin", "end").alias("span"))
    # Surroundings met twice are covered as far as the text goes; the end is clipped there.
    sure = lists.select("key", F.explode("whole").alias("p")).select("key", F.struct(F.greatest(F.col("p") - left, F.lit(0)).alias("begin"), (F.col("p") + length).alias("end")).alias("span"))
    spans = sure.unionByName(spans).groupBy("key").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    return scratch.result(spans, "suffix-spans")


def remove_repeats(docs: DataFrame, length: int = 200, as_text: bool = False) -> DataFrame:
    """The columns of docs with n_bytes, spans (array of begin and end) and kept (the other bytes).

    A byte is removed when a string of `length` bytes around it also starts at any other
    place of any text, its own included; strings are judged on the input. docs: doc_id,
    text; other columns pass through, unless they are named like the new ones (these win).
    Null and empty texts have no bytes and nothing removed; rows with a null doc_id and
    repeated rows are documents of their own, so repeated rows of at least `length` bytes
    are removed whole; an empty table gives no rows. Texts may be of any length. With
    as_text, kept is a string; what is left of a character that was cut is taken out.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    keyed = docs.drop("n_bytes", "spans", "kept").withColumn("_suffix_key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed.select(F.col("_suffix_key").alias("key"), "text"), length)
    spans = spans.withColumnRenamed("key", "_suffix_key")
    schema = docs.drop("n_bytes", "spans", "kept").schema
    names = schema.names
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part, out = batch.slice(begin, 256), []
                for data, spans in zip(map(encoded, part.column("text").to_pylist()), part.column("spans").to_pylist()):
                    merged: list[list[int]] = []
                    for s in spans or ():
                        b, e = s["begin"], min(s["end"], len(data))
                        if merged and b <= merged[-1][1]:
                            merged[-1][1] = max(e, merged[-1][1])
                        else:
                            merged.append([b, e])
                    edges = [0, *[x for m in merged for x in m], len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    out.append((len(data), [{"begin": a, "end": b} for a, b in merged], kept.decode("utf-8", "ignore") if as_text else kept))
                new = [pa.array(list(c), kind) for c, kind in zip(zip(*out), (pa.int64(), span, pa.string() if as_text else pa.binary()))]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *new], [*names, "n_bytes", "new_spans", "kept"])

    joined = keyed.join(spans, "_suffix_key", "left").select(*names, "spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    done = in_small_batches(joined).mapInArrow(returning_memory(cut), f"{fields}, n_bytes long, new_spans array<struct<begin: long, end: long>>, kept {'string' if as_text else 'binary'}")
    return done.withColumnRenamed("new_spans", "spans")
