"""Jaccard join of word n-gram sets by PartEnum signatures, up to connected components.

Sizes are cut into bands so that a set and any similar one lie in the same or in
neighbouring bands. Within a band two similar sets differ in at most k elements. The
element domain is dealt into partitions, so that some partitions differ in at most one
element, and each of those into halves, one of which must then be equal: every half is a
signature. For small k one level of partitions is used and all subsets that leave out k of
them are enumerated. Sets that share no signature can't be similar.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, in_small_batches, returning_memory

#: Bits of the smallest sketch, and of those that pairs of a signature compare; enough for sets of about a thousand.
LEAST_BITS = 512
BRIEF = LEAST_BITS // 64
#: Partitions beyond the least number: a set may have so many with an empty half and need not announce them.
SPARE = 3
#: Sets that may differ in so many elements or more get a sixteenth as many partitions on top; see without_frequent().
LONG = 192
#: A row's `other`: the sketch in the low 28 bits, the allowed differences in two more, then the number of the set's instance.
SKETCH_BITS = (1 << 28) - 1
#: Signatures meet in so many parts one after the other, so that only a part is on its way at a time.
PARTS = 6
#: Ids of texts to compare are broadcast up to so many rows, of 32 bytes each; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
ONE, MIX1, MIX2 = np.uint64(1), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """The distinct n-word shingles of a text as sorted 64-bit hashes."""

    def __init__(self, n: int, memo_size: int = 1 << 18):
        self.n, self.memo, self.memo_size = n, {}, memo_size

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes: lower() changes A-Z only, split() takes space and tab to carriage return only.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.memo) > self.memo_size:
            self.memo.clear()
        memo, digest = self.memo, xxhash.xxh3_64_intdigest
        for w in words:
            if w not in memo:
                memo[w] = digest(w)
        h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.n, len(h))
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out = mixed(out) + h[i : len(h) - n + 1 + i]
        return np.unique(mixed(out + np.uint64(n)))


class PartEnum:
    """Signatures of sets of 64-bit hashes for a Jaccard threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low, self.high = [1], [100 // percent]

    def band(self, n: int) -> int:
        """The number of the size band that holds n; bands are added as sizes ask for them."""
        while self.high[-1] < n:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * 100 // self.percent)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def instances(self, n: int) -> list[int]:
        """The set's own band, as the larger set of a pair, and the next if it reaches there."""
        band = self.band(n)
        return [band, self.band(self.high[band] + 1)] if n * 100 // self.percent > self.high[band] else [band]

    def differences(self, band: int) -> int:
        """The most elements in which similar sets differ, the larger being in this band."""
        return (100 - self.percent) * 2 * self.high[band] // (100 + self.percent)

    def spare(self, k: int) -> int:
        """Partitions on top, so that as many signatures of a set may be left out."""
        return k // 16 if k >= LONG else 0

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Signatures, for each what it says of the elements it leaves out, and the instances' spare signatures.

        That is a sketch of 28 parities, and above it in how many elements sets of equal
        signatures may differ there: sketches that differ in more bits rule a pair out.
        """
        if not len(hashes):
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32), []
        spread = mixed(hashes ^ MIX2)
        out, others, spares = [], [], []
        for i, band in enumerate(self.instances(len(hashes))):
            k = self.differences(band)
            make = self.subsets if k <= 3 else self.halves
            sums, ids, other = make(hashes, spread, k)
            out.append(mixed(mixed(sums + ids) + np.uint64(band * 0x10001 + 1)))
            others.append(other | np.int32(i << 30))
            spares.append(self.spare(k))
        return np.concatenate(out), np.concatenate(others), spares

    def cells(self, spread: np.ndarray, cell: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per cell the sum of its elements, their number and the parities of 28 classes of them."""
        sums = np.zeros(n, dtype=np.uint64)
        np.add.at(sums, cell, spread)
        classes = np.bincount(cell * 28 + (spread >> np.uint64(40)).astype(np.int64) % 28, minlength=28 * n).reshape(n, 28)
        bits = (classes & 1).astype(np.int32) @ (1 << np.arange(28, dtype=np.int32))
        return sums, classes.sum(axis=1), bits

    def subsets(self, hashes: np.ndarray, spread: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = k + 3 if k else 1
        sums, _, bits = self.cells(spread, ((hashes >> np.uint64(32)) % np.uint64(n)).astype(np.int64), n)
        kept = [list(c) for c in combinations(range(n), n - k)]
        every = np.bitwise_xor.reduce(bits)
        other = np.array([every ^ np.bitwise_xor.reduce(bits[c]) for c in kept], dtype=np.int32)
        return np.array([sums[c].sum(dtype=np.uint64) for c in kept]), np.arange(len(kept), dtype=np.uint64), other | np.int32(k << 28)

    def halves(self, hashes: np.ndarray, spread: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = k // 2 + 1 + SPARE + self.spare(k)
        cell = ((hashes >> np.uint64(32)) % np.uint64(n)).astype(np.int64) * 2 + ((hashes >> np.uint64(9)) & ONE).astype(np.int64)
        sums, counts, bits = self.cells(spread, cell, 2 * n)
        ids = np.arange(2 * n, dtype=np.uint64)
        other = bits.reshape(n, 2)[:, ::-1].ravel() | np.int32(1 << 28)
        # At least SPARE + self.spare(k) + 1 partitions of a similar pair have an equal half;
        # a set with at most SPARE partitions with an empty half has one among them where
        # none is empty, even if self.spare(k) others don't count.
        if (counts.reshape(n, 2).min(axis=1) == 0).sum() <= SPARE:
            held = counts > 0
            return sums[held], ids[held], other[held]
        return sums, ids, other


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the counts by hashed bit: two sketches differ in no more bits than their sets in elements.

    At least two bits for each element, a power of two; half as many by folding the halves together.
    """
    n = max(LEAST_BITS, 1 << max(2 * len(hashes) - 1, 0).bit_length())
    bits = np.bincount(((hashes >> np.uint64(20)) % np.uint64(n)).astype(np.int64), minlength=n) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def set_table(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, its sketch and its signatures.

    A copy of a set that the same task met before has no signatures, nor has a row with a
    null doc_id; such rows don't count as met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signatures, seen = Shingler(n), PartEnum(percent), set()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                ids = part.column("doc_id")
                for known, text in zip(ids.is_valid().to_pylist(), part.column("text").to_pylist()):
                    h = shingles(text)
                    d1, d2 = (int(mixed(h ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) for salt in (0x51ED27, 0xA3B19535))
                    new = (d1, d2) not in seen and len(h) > 0 and known
                    if len(seen) > 1 << 20:
                        seen.clear()
                    if new:
                        seen.add((d1, d2))
                    sigs, others, spares = signatures(h) if new else (None, None, None)
                    rows.append((len(h), d1, d2, sketch(h) if new else None, sigs.view(np.int64) if new else None, others, spares))
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_shingles", "d1", "d2", "sketch", "signatures", "others", "spares"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_small_batches(keyed).mapInArrow(returning_memory(run), "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>, signatures array<long>, others array<int>, spares array<int>")


def folded(x: Column, y: Column) -> Column:
    """Sketch x in the length of y, if that is half of its own."""
    halves = F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(x) == 2 * F.size(y), halves).otherwise(x)


def apart() -> Column:
    """Bits in which the sketches of the sides a and b differ; null if their sizes are too far apart."""
    x, y = F.col("a_sketch"), F.col("b_sketch")
    return F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)


def may_link(percent: int) -> Column:
    """By sizes and sketches of the sides a and b: False for pairs that can't reach the threshold."""
    n1, n2 = F.col("a_n"), F.col("b_n")
    most = F.floor((n1 + n2) * (100 - percent) / (100 + percent))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (apart() <= most)


def compatible(x: Column, y: Column) -> Column:
    """Whether what two rows of one signature leave out may be as close as it must be."""
    return F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(SKETCH_BITS))) <= F.shiftright(x, 28).bitwiseAND(F.lit(3))


def without_frequent(shared: DataFrame) -> DataFrame:
    """shared without as many signatures of each instance as it can spare, the most frequent ones.

    Passages that many texts hold fill some signatures of each. The frequency is one number
    for all sets of a signature, and what goes from a set is more frequent than all that
    stays. Similar sets share more signatures than either can spare, so of the two the set
    that stops at the lower frequency keeps one of these, and the other keeps it too.
    """
    mine = W.partitionBy("d1", F.shiftright("other", 30)).orderBy(F.desc("frequency"))
    some = shared.where(F.col("spare") > 0).dropDuplicates(["d1", "sig"]).withColumn("as_frequent", F.count(F.lit(1)).over(mine))
    some = some.where(F.col("as_frequent") > F.col("spare")).drop("as_frequent")
    return shared.where(F.col("spare") == 0).unionByName(some).drop("spare", "frequency")


def brief(sketch: Column) -> list[Column]:
    """A sketch folded to LEAST_BITS bits, in BRIEF longs."""
    fold = lambda at: F.aggregate(F.filter(sketch, lambda x, i: i % BRIEF == at), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    return [fold(at).alias(f"bits{at}") for at in range(BRIEF)]


def with_sides(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that sizes and sketches don't rule out."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch")), side)
    return pairs.where(may_link(percent)).select("a", "b", apart().alias("apart"))


def verify(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, n: int, percent: int, scratch: Scratch, texts_per_group: int = 256, shingles_per_group: int = 1 << 19) -> DataFrame:
    """The pairs of doc ids whose sets reach the threshold, from the whole texts.

    The texts to compare with one text are dealt into groups that are bounded in number and
    in shingles; sizes (node, n) has these for every doc id of the pairs.
    """
    pairs = scratch.keep(pairs.join(sizes.select(F.col("node").alias("b"), F.col("n").alias("b_n")), "b"), "pairs")
    parts = F.greatest(F.count(F.lit(1)) / texts_per_group, F.sum("b_n") / shingles_per_group)
    groups = pairs.groupBy("a").agg(F.ceil(parts).cast("int").alias("groups"))
    # Each row says which group a document's text goes to, and whether it is the one compared with all.
    first = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.col("a").alias("need"), F.lit(True).alias("head"))
    rest = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("group"), F.col("b").alias("need"), F.lit(False).alias("head"))
    needs = scratch.keep(first.unionByName(rest), "needs")
    side = F.broadcast(needs) if needs.count() <= BROADCAST_ROWS else needs
    texts = docs.select(F.col("doc_id").alias("need"), "text").join(side, "need")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        shingles, sets, found = Shingler(n), {}, set()
        head = [shingles(t) for t in pdf["text"][pdf["head"]]]
        rest = pdf[~pdf["head"]]
        for text, b in zip(rest["text"], rest["need"]):
            if text not in sets:
                h = shingles(text)
                sizes = ((len(np.intersect1d(x, h, assume_unique=True)), len(x)) for x in head)
                sets[text] = any(100 * both >= percent * (own + len(h) - both) for both, own in sizes)
            if sets[text]:
                found.add(int(b))
        return pd.DataFrame({"a": [int(pdf["a"].iloc[0])] * len(found), "b": sorted(found)}, dtype="int64")

    return texts.groupBy("a", "group").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node and the smallest node reachable, for all nodes of the edges (a, b).

    Every round takes the least label around each node, then the label's own label.
    """
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "cc-labels")
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = new.select(F.col("node").alias("j_node"), F.col("label").alias("j_label"))
        new = scratch.keep(new.join(jump, F.col("label") == F.col("j_node"), "left").select("node", "old", F.least("label", F.coalesce("j_label", "label")).alias("label")), "cc-labels")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
    raise RuntimeError("the components did not settle")


def split(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components."""
    for side in ("a", "b"):
        labels = found.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        pairs = pairs.join(labels, side, "left").withColumn(f"{side}_label", F.coalesce(f"{side}_label", side))
    return pairs.where(F.col("a_label") != F.col("b_label")).select("a", "b")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    docs: doc_id, text; other columns are ignored. A set is the distinct n-word shingles of
    the whole text (A-Z lowered, words between white space); a shorter text is one shingle;
    null, empty and white-space-only texts have none and are linked with nothing. Two rows
    link when 100 * intersection >= percent * union. Equal sets are one node from the start.
    Rows with a null doc_id are returned with a null component and link with nothing; rows
    repeated under one doc_id each get their own set's component; an empty table gives no rows.

    Every signature's sets are first compared with two centers; members still in different
    components are then compared with each other, so that no link is lost.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    keep = scratch.keep
    sets = keep(set_table(docs, n, percent), "sets")
    info = keep(sets.drop("sketch", "signatures", "others", "spares"), "info")
    own = sets.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = own.groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("node"), F.first("sketch", ignorenulls=True).alias("sketch"))
    nodes = keep(nodes, "nodes")
    rows = own.select(F.explode(F.arrays_zip("signatures", "others")).alias("s"), "d1", "spares").select(F.col("s.signatures").alias("sig"), "d1", F.col("s.others").alias("other"), "spares")
    rows = rows.select("sig", "d1", "other", F.get("spares", F.shiftright("other", 30)).alias("spare"))
    span = W.partitionBy("sig")
    ends = [f(F.struct("d1", "other")).over(span).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    ends.append(F.count(F.lit(1)).over(span).alias("frequency"))
    shared = None
    for part in range(PARTS):
        met = rows.where(F.pmod("sig", F.lit(PARTS)) == part).select("sig", "d1", "other", "spare", *ends).where(F.col("low.d1") < F.col("high.d1"))
        met = keep(met.select("sig", "d1", "other", "spare", "low", "frequency"), "shared")
        shared = met if shared is None else shared.unionByName(met)
        scratch.drop()
    scratch.drop(sets)
    every, shared = shared, keep(without_frequent(shared), "kept")
    scratch.drop(every)

    # Centers: the smallest digest of a signature, and the member met most often.
    key = nodes.select("d1", "node", "n", "sketch")
    of = lambda name: nodes.select(F.col("d1").alias(f"{name}_d1"), F.col("node").alias(name))
    star = lambda df, c: df.where((F.col("d1") != F.col(f"{c}.d1")) & compatible(F.col("other"), F.col(f"{c}.other"))).select(F.col(f"{c}.d1").alias("a_d1"), F.col("d1").alias("b_d1")).distinct()
    degree = shared.join(shared.groupBy("sig").agg(F.count(F.lit(1)).alias("c")), "sig").groupBy("d1").agg(F.sum("c").alias("weight"))
    degree = keep(degree, "degree")
    top = shared.join(degree, "d1").groupBy("sig").agg(F.max(F.struct("weight", "d1", "other")).alias("top"))
    stars = keep(star(shared, "low").unionByName(star(shared.join(top, "sig"), "top")).distinct(), "stars")
    scratch.drop(degree)
    pairs = stars.join(of("a"), "a_d1").join(of("b"), "b_d1").where(F.col("a") != F.col("b")).select("a", "b")
    pairs = keep(with_sides(pairs, key, percent), "candidates")
    scratch.drop(stars)
    # First each set with the nearest of its centers, then the pairs that this left apart.
    nearest = pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).getField("a").alias("a")).select("a", "b")
    links = keep(verify(nearest, docs, key, n, percent, scratch), "links")
    found = components(links, scratch)
    rest = split(pairs.select("a", "b").join(nearest, ["a", "b"], "left_anti"), found)
    links = keep(links.unionByName(verify(rest, docs, key, n, percent, scratch)), "links")
    found = components(links, scratch)

    # Signatures whose members aren't in one component yet.
    key2 = nodes.select("d1", "node", "n", *brief(F.col("sketch")))
    members = shared.select("sig", "d1", "other").distinct().join(key2, "d1").join(found.select("node", "label"), "node", "left")
    members = members.withColumn("label", F.coalesce("label", "node"))
    mixed_sigs = members.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where(F.col("x") < F.col("y")).select("sig")
    bits = [f"bits{at}" for at in range(BRIEF)]
    members = keep(members.join(mixed_sigs, "sig", "left_semi").select("sig", "other", "node", "label", "n", *bits), "members")
    scratch.drop(shared)
    # Both sides read one exchange.
    dealt = members.repartition("sig")
    side = lambda s: dealt.select("sig", *[F.col(c).alias(f"{s}_{c}") for c in ("other", "node", "label", "n", *bits)])
    near_sizes = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    apart_at_least = reduce(Column.__add__, [F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in bits])
    near_sizes &= apart_at_least <= F.floor((F.col("a_n") + F.col("b_n")) * (100 - percent) / (100 + percent))
    cross = side("a").join(side("b"), "sig").where((F.col("a_label") < F.col("b_label")) & compatible(F.col("a_other"), F.col("b_other")) & near_sizes)
    cross = keep(cross.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), "cross")
    scratch.drop(members)
    tried = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cross = with_sides(cross.join(tried, ["a", "b"], "left_anti"), key, percent).select("a", "b")
    late = keep(verify(cross, docs, key, n, percent, scratch), "late")
    if not late.isEmpty():
        found = components(links.unionByName(late), scratch)

    table = nodes.join(found, "node", "left").select("d1", "d2", F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("component"))
    out = info.select("doc_id", "n_shingles", "d1", "d2").join(table, ["d1", "d2", "n_shingles"], "left")
    lone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", lone)).alias("component_id"))
    return scratch.result(out, "jaccard-components")


def keep_representatives(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """docs without those whose component holds a smaller doc_id; null ids and rows repeated under one id stay."""
    gone = linked.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def distinct_documents(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row of docs for each component: the smallest doc_id, null last.

    A document is an id with its text (told apart by 64-bit hashes), so rows with a null id
    and different texts under one id are documents like all others; of rows that repeat both,
    one stays. Rows without shingles are all kept.
    """
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    linked = jaccard_components(keyed.select(F.col("_row").alias("doc_id"), "text"), n, percent).select(F.col("doc_id").alias("_row"), "n_shingles", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    best = keyed.select("_row", "doc_id").join(linked.dropDuplicates(["_row"]), "_row").groupBy("component_id").agg(F.min(order).getField("_row").alias("_row"), F.min("n_shingles").alias("_n"))
    one = F.row_number().over(W.partitionBy("_row").orderBy("_row"))
    return keyed.join(best.select("_row", "_n"), "_row").withColumn("_one", one).where((F.col("_one") == 1) | (F.col("_n") == 0)).select(docs.columns)
