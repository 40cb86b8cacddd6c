"""Data-set-wide attribute statistics and normalization."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import in_portions
from .datasets import fingerprint

VERSION = 1


def stat_key(tree_key: str, attribute: Column) -> Column:
    return F.concat(F.lit(f"{tree_key}::"), attribute)


def long_form(attributes: DataFrame, names: list[str], ids: list[str]) -> DataFrame:
    """ids, attribute, value: one row for each attribute of each node."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(n).cast("double").alias("value")) for n in names]))
    return attributes.select(*ids, pairs.alias("p")).select(*ids, "p.attribute", "p.value")


def fit_stats(attributes: DataFrame, names: list[str], tree_key: str = "max") -> DataFrame:
    """stat_key, count, sum, sumsq, amin, amax over all nodes, each emitted row counting; an empty table fails."""
    if attributes.isEmpty():
        raise ValueError("no rows to fit statistics on")
    rows = long_form(attributes, names, [])
    agg = [F.count("value").alias("count"), F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("sumsq"), F.min("value").alias("amin"), F.max("value").alias("amax")]
    return rows.groupBy(stat_key(tree_key, F.col("attribute")).alias("stat_key")).agg(*agg)


def merge_stats(*tables: DataFrame) -> DataFrame:
    """Statistics of the union of what the tables describe."""
    both = tables[0]
    for t in tables[1:]:
        if set(t.columns) != set(both.columns):
            raise ValueError("the statistics have different fields")
        both = both.unionByName(t)
    return both.groupBy("stat_key").agg(*[F.sum(c).alias(c) for c in ("count", "sum", "sumsq")], F.min("amin").alias("amin"), F.max("amax").alias("amax"))


def validate_summary(stats: DataFrame) -> DataFrame:
    """Rows of statistics that can't be: not finite, empty, or out of order."""
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    issue = F.when(F.coalesce(F.col("count"), F.lit(0)) <= 0, "count").when(odd("sum") | odd("sumsq") | odd("amin") | odd("amax"), "not finite").when(F.col("amin") > F.col("amax"), "order").when(F.col("sumsq") < 0, "sumsq")
    return stats.select("stat_key", issue.alias("issue")).where(F.col("issue").isNotNull())


def missing_stats(stats: DataFrame, required: list[str]) -> None:
    """Fail naming up to three of the keys that have no statistics."""
    want = stats.sparkSession.createDataFrame([(k,) for k in required], "stat_key string")
    lost = [r[0] for r in want.join(stats, "stat_key", "left_anti").orderBy("stat_key").take(3)]
    if lost:
        raise ValueError(f"no statistics for {', '.join(lost)}")


def normalized(x: Column, mode: str, eps: float = 1e-6, k: float = 3.0, floor: float = 0.05) -> Column:
    """x with its statistics beside it, by mode: minmax01, zscore, clipped_zscore01 or none."""
    if mode == "none":
        return x
    if mode == "minmax01":
        return (x - F.col("amin")) / F.greatest(F.col("amax") - F.col("amin"), F.lit(eps))
    mean = F.col("sum") / F.col("count")
    z = (x - mean) / F.sqrt(F.greatest(F.col("sumsq") / F.col("count") - mean * mean, F.lit(eps)))
    if mode == "zscore":
        return z
    if mode == "clipped_zscore01":
        return floor + (1 - floor) * (F.least(F.greatest(z, F.lit(-k)), F.lit(k)) + k) / (2 * k)
    raise ValueError(f"unknown mode {mode!r}")


def normalize(attributes: DataFrame, names: list[str], stats: DataFrame, ids: list[str], mode: str = "clipped_zscore01", tree_key: str = "max", **options: float) -> DataFrame:
    """ids and the normalized attributes, in the same wide form; stats has a row per attribute."""
    rows = {r["stat_key"]: r for r in stats.where(F.col("stat_key").isin([f"{tree_key}::{n}" for n in names])).collect()}
    if lost := [n for n in names if f"{tree_key}::{n}" not in rows]:
        raise ValueError(f"no statistics for {', '.join(lost[:3])}")
    out = attributes
    for n in names:
        r = rows[f"{tree_key}::{n}"]
        with_stats = out.withColumns({c: F.lit(r[c]) for c in ("count", "sum", "sumsq", "amin", "amax")})
        out = with_stats.withColumn(n, normalized(F.col(n).cast("double"), mode, **options)).drop("count", "sum", "sumsq", "amin", "amax")
    return out.select(*ids, *names)


def per_image_normalize(response: DataFrame, keys: list[str]) -> DataFrame:
    # One deal by keys serves the ends and the rows.
    each = W.partitionBy(*keys)
    ends = in_portions(response, keys).withColumns({"lo": F.min("value").over(each), "hi": F.max("value").over(each)})
    return ends.withColumn("value", (F.col("value") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))).drop("lo", "hi")


def project_threshold(specs: DataFrame, stats: DataFrame) -> DataFrame:
    """Thresholds of soft gates back on the attribute's scale; specs: spec, stat_key, weight, bias (linear: lambda = -bias / weight)."""
    s = specs.join(stats.select("stat_key", "amin", "amax"), "stat_key")
    return s.withColumn("threshold", F.col("amin") + (-F.col("bias") / F.col("weight")) * (F.col("amax") - F.col("amin")))


def stats_from_manifest(contributions: DataFrame, entry_stats: DataFrame, split: str = "train") -> DataFrame:
    """Merged statistics of the entries that a split's contributions name, with multiplicity.

    contributions has entry_key, and split unless all its rows are of that split; entry_stats has entry_key.
    """
    if "split" in contributions.columns:
        contributions = contributions.where(F.col("split") == split)
    rows = contributions.select("entry_key").join(entry_stats, "entry_key")
    return merge_stats(rows.select("stat_key", "count", "sum", "sumsq", "amin", "amax"))


def stats_identity(contributions: DataFrame, contract: dict[str, str]) -> DataFrame:
    """One row, the digest of what statistics were fitted on: contract and the samples (position, sample_id, entry_key) in order."""
    samples = contributions.select("position", "sample_id", "entry_key")
    terms = F.lit(json.dumps(contract, sort_keys=True))
    return fingerprint(samples, ["position"]).select(F.sha2(F.concat_ws("|", terms, "fingerprint"), 256).alias("stats_identity"))


def save_stats(stats: DataFrame, path: str, mode: str) -> None:
    stats.withColumns({"version": F.lit(VERSION), "mode": F.lit(mode)}).write.mode("overwrite").parquet(path)


def load_stats(spark: SparkSession, path: str, mode: str) -> DataFrame:
    df = spark.read.parquet(path)
    other = df.where((F.col("version") != VERSION) | (F.col("mode") != mode)).select("version", "mode").take(1)
    if other:
        raise ValueError(f"the statistics are of version {other[0]['version']} and mode {other[0]['mode']}")
    return df.drop("version", "mode")
