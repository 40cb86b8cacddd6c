"""Prepared entries: attributes of trees stored by content, built once and committed in blocks."""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..plans.ranks import numbered_within
from ..plans.trees import build
from ..tables import KEY, settle
from .attributes import compute, expand
from .datasets import content_key, pixel_digest
from .stats import long_form, stat_key

STATS = ("count", "sum", "sumsq", "amin", "amax")
#: Pixels whose entries a block holds about: many small rasters or few large ones.
BLOCK_PIXELS = 1 << 26


def open_store(spark: SparkSession, path: str, contract: dict[str, object]) -> None:
    """Bind a store to a contract, or fail if it has another one."""
    name = hashlib.sha256(json.dumps(contract, sort_keys=True).encode()).hexdigest()
    found = tables.published(spark, f"{path}/contract")
    if not found:
        tables.publish(spark, f"{path}/contract", name)
    elif found != [name]:
        raise ValueError(f"{path} holds entries of another contract")


def read_store(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    """The committed rows of a part (nodes or summaries) of the store; None where nothing is committed."""
    blocks = tables.published(spark, f"{path}/commits")
    return spark.read.parquet(*[f"{path}/{part}/{b}" for b in blocks]) if blocks else None


def _summaries(nodes: DataFrame, names: list[str], tree_key: str) -> DataFrame:
    v = F.col("value")
    rows = long_form(nodes, names, ["entry_key"])
    agg = [F.count(v).alias("count"), F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq"), F.min(v).alias("amin"), F.max(v).alias("amax")]
    return rows.groupBy("entry_key", stat_key(tree_key, F.col("attribute")).alias("stat_key")).agg(*agg)


def prepare_entries(pixels: DataFrame, tree_keys: list[str], names: str | list[str], path: str, radius: float = 1.5, per_block: int | None = None) -> DataFrame:
    """Every raster's entries: key, tree_key, sha256, entry_key and built (whether this run made it).

    An entry is the attributes of a tree (max, min or shapes) of one content, with a summary
    of each attribute beside them. Only entries that no run has committed are built, equal
    rasters once; they are committed per_block at a time (as many as have about BLOCK_PIXELS
    pixels, if not given), so a stopped run goes on where it stopped, and readers never see
    half a block. A block costs the same jobs whatever it holds. Fails where the store has another contract
    (attributes, radius), and where no tree is asked for.
    """
    if not tree_keys or len({*tree_keys}) < len(tree_keys):
        raise ValueError("tree keys must be given and differ")
    spark, names = pixels.sparkSession, expand(names)
    open_store(spark, path, {"version": 1, "attributes": sorted(names), "radius": radius})
    digests = settle(pixel_digest(pixels), "digests")
    wanted = reduce(DataFrame.unionByName, [content_key(digests, t, names).withColumn("tree_key", F.lit(t)) for t in tree_keys])
    have = read_store(spark, path, "summaries")
    lost = wanted.groupBy("entry_key", "tree_key").agg(F.min(F.struct(*KEY)).alias("one"))
    if have is not None:
        lost = lost.join(have.select("entry_key").distinct(), "entry_key", "left_anti")
    lost = numbered_within(lost.select("entry_key", "tree_key", "one.*"), [], [F.col("entry_key")])
    if per_block is None:
        size = pixels.groupBy(*KEY).count().agg(F.avg("count")).first()[0] or 1
        per_block = max(1, int(BLOCK_PIXELS / size))
    lost = settle(lost.withColumn("block", F.expr(f"position div {per_block}")).drop("position"), "missing")
    last = lost.agg(F.max("block")).first()[0]
    for block in range(0 if last is None else last + 1):
        name = uuid.uuid4().hex
        for t in tree_keys:
            here = lost.where((F.col("block") == block) & (F.col("tree_key") == t)).select(*KEY, "entry_key")
            if here.isEmpty():
                continue
            forest = build(pixels.join(here.select(*KEY), KEY, "left_semi"), t, radius)
            nodes = settle(compute(forest, names).join(here, KEY).drop(*KEY), "entry-nodes")
            nodes.write.mode("append").parquet(f"{path}/nodes/{name}")
            _summaries(nodes, names, t).write.mode("append").parquet(f"{path}/summaries/{name}")
        tables.publish(spark, f"{path}/commits", name)
    made = lost.select("entry_key", F.lit(True).alias("built"))
    return wanted.join(made, "entry_key", "left").select(*KEY, "tree_key", "sha256", "entry_key", F.coalesce("built", F.lit(False)).alias("built"))


def entry_stats(entries: DataFrame, path: str) -> DataFrame:
    """Statistics over the given entries, merged from their summaries; an entry counts as often as it is given."""
    summaries = read_store(entries.sparkSession, path, "summaries")
    if summaries is None:
        raise ValueError(f"nothing is committed in {path}")
    times = entries.groupBy("entry_key").agg(F.count(F.lit(1)).alias("times"))
    rows = summaries.join(times, "entry_key")
    return rows.groupBy("stat_key").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in STATS[:3]], F.min("amin").alias("amin"), F.max("amax").alias("amax"))
