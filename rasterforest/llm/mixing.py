"""Mixing sources to target weights with Efraimidis-Spirakis sampling, native expressions only.

A document's key is -ln(u) / quality with u from a hash of its id: taking the smallest
keys of a source first is weighted sampling without replacement. A source whose target
exceeds its size is taken whole as often as it fits (complete epochs); the rest of the
target goes to the documents of the smallest keys, by a prefix sum of their sizes.
The prefix sum runs in two levels, within key ranges and over the ranges' totals, so
that a hot source is never one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, word_count

#: Weights by the rank of a source's name, repeating.
CYCLE = (3.0, 1.0, 2.0)


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of the md5 of seed and id; a null id counts as 'null'."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sized: DataFrame, share: float = 1.5, epochs: int = 2, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Per source: source_size, target, n_docs and the number of key ranges.

    share times all sizes is dealt by weight; a target stops at epochs times its
    source's size and the excess goes to the others by weight (water filling: a level
    L with sum of least(cap, L * weight) = total, found by sorting on cap / weight).
    One row per source: this table is small beside the documents.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle)
    weight = F.element_at(F.array(*map(F.lit, cycle)), (rank + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * epochs)
    full = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    below = full.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by = by.withColumn("total", F.sum("source_size").over(whole).cast("double") * share)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    )
    by = by.withColumn("level_here", level)
    # Sources are capped up to the first one whose cap lies above the level reached so far.
    free = F.min(F.when(F.col("level_here") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level_here"))))
    by = by.withColumn("found", free.over(whole).getField("level_here"))
    target = F.coalesce(F.least(F.col("cap"), F.col("found") * F.col("weight")), F.col("cap"))
    return by.select("source", "source_size", "n_docs", target.alias("target"))


def weight_classes(sized: DataFrame) -> DataFrame:
    """Per source: classes, an array of the number n of documents and the least weight, rate, for each power of two of the weights.

    A key of weight w is exponential with rate w. With the least weight of each class no
    range of keys holds more than about twice its share. A double has some 2,100 powers of
    two, which bounds the array.
    """
    weight = F.coalesce(F.col("weight"), F.lit(1.0))
    classes = sized.groupBy("source", F.floor(F.log2(weight)).alias("power")).agg(F.count(F.lit(1)).alias("n"), F.min(weight).alias("rate"))
    return classes.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rate", "n"))).alias("classes"))


def key_range() -> Column:
    """The number of the key's range: a monotone map, the distribution function of the source's keys."""
    below = F.aggregate("classes", F.lit(0.0), lambda s, c: s + c["n"] * (1 - F.exp(-c["rate"] * F.col("key"))))
    return F.floor(below / F.col("n_docs") * F.col("ranges")).cast("long")


def mix(docs: DataFrame, quality: DataFrame | None = None, seed: int = 42, share: float = 1.5, epochs: int = 2, rows_per_range: int = 4096, cycle: tuple[float, ...] = CYCLE, row: str | None = None) -> DataFrame:
    """How many words of each document the mix takes.

    docs: doc_id, source, text; other columns are ignored. quality (doc_id, weight > 0)
    may lack documents (weight 1) and may repeat ids (the largest weight counts).
    Returns doc_id, source, size, source_size, target, taken, one row per row of docs, and
    the column row of docs, if named: a unique key, so that each row finds its own taken.
    Null and empty texts have size 0 and are taken with 0 words; a null source is a
    source of its own; repeated rows share a key and are taken one after the other;
    an empty table gives no rows. Reruns with the same seed agree. The document at the
    budget's edge is taken in part, so a source misses its target by under one word.
    """
    own = [row] if row else []
    sized = docs.select(*own, "doc_id", "source", word_count(F.col("text")).alias("size"))
    if quality is not None:
        best = quality.groupBy(F.col("doc_id").alias("q_id")).agg(F.max("weight").alias("weight"))
        sized = sized.join(best, F.col("doc_id") == F.col("q_id"), "left").drop("q_id")
    else:
        sized = sized.withColumn("weight", F.lit(None).cast("double"))
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.coalesce(F.col("weight"), F.lit(1.0))
    sized = materialize(sized.withColumn("key", key), "mix-sized")
    targets = source_targets(sized, share, epochs, cycle).join(weight_classes(sized).withColumnRenamed("source", "w_source"), F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    ranges = F.greatest(F.ceil(F.col("n_docs") / rows_per_range), F.lit(1))
    targets = targets.withColumn("ranges", ranges.cast("long"))
    # Sources are few beside documents, but not provably so: the planner sizes this join.
    same = F.col("source").eqNullSafe(F.col("t_source"))
    rows = sized.join(targets.withColumnRenamed("source", "t_source"), same).drop("t_source")
    rows = rows.withColumn("range", key_range()).drop("weight", "classes")
    rows = materialize(rows, "mix-ranged")
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s_source"), F.col("range").alias("s_range"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_before"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range"))).drop("s_source", "s_range")
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size", *own).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("range_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor(F.col("target")).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return rows.select(*own, "doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


def label_quality(labels: DataFrame, good: float = 2.0, poor: float = 0.5) -> DataFrame:
    """Document quality weights from the labels' 0/1 quality marks."""
    return labels.where(F.col("quality").isNotNull()).select("doc_id", F.when(F.col("quality") == 1, good).otherwise(poor).alias("weight"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, white space kept as it is."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def apply_mix(docs: DataFrame, mixed: DataFrame, row: str = "doc_id") -> DataFrame:
    """The mixed corpus: each document once per complete take, and its head for a partial one.

    The column row of docs and mixed is a unique key: doc_id only where no id is repeated
    or null twice, else one of numbered() that mix() carried. Returns the columns of docs;
    documents of which nothing is taken are left out.
    """
    m = mixed.where(F.col("taken") > 0).select(F.col(row).alias("_mix_id"), F.col("size").alias("_mix_size"), F.col("taken").alias("_mix_taken"))
    size, taken = F.col("_mix_size"), F.col("_mix_taken")
    joined = docs.join(m, F.col(row).eqNullSafe(F.col("_mix_id")))
    joined = joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(0), F.ceil(taken / size).cast("int") - 1)))
    left = taken - F.col("_mix_copy") * size
    text = F.when(left >= size, F.col("text")).otherwise(first_words(F.col("text"), left))
    return joined.withColumn("text", text).select(docs.columns)


#: The same rows for another engine; one window over each source, no ranges.
ORACLE = """
WITH q AS (SELECT doc_id AS q_id, max(CASE WHEN quality = 1 THEN 2.0 ELSE 0.5 END) AS weight FROM labels WHERE quality IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  -ln((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(weight, 1.0)::DOUBLE AS key
  FROM documents LEFT JOIN q ON doc_id = q_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM d GROUP BY source),
l AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS lev FROM s
  WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(lev, cap / weight) FROM l WHERE lev * weight <= cap)), cap) AS target FROM l),
p AS (SELECT d.*, source_size, target, floor(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) ELSE 0 END)::BIGINT AS taken FROM p
"""
