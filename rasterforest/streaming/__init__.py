"""Incremental statistics over a stream of node attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import tables
from ..operators.stats import fit_stats, merge_stats


def committed(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the micro-batches whose statistics are complete, in order."""
    return sorted(int(n) for n in tables.published(spark, f"{table}/commits"))


def frozen(spark: SparkSession, table: str) -> bool:
    return "frozen" in tables.published(spark, f"{table}/state")


def freeze_stats(spark: SparkSession, table: str) -> None:
    """Let no later micro-batch change the statistics in `table`, streams that already run included."""
    tables.publish(spark, f"{table}/state", "frozen")


def unfreeze_stats(spark: SparkSession, table: str) -> None:
    tables.remove(spark, f"{table}/state/frozen")


def stream_stats(stream: DataFrame, names: list[str], table: str, checkpoint: str, tree_key: str = "max") -> StreamingQuery:
    """Fold a stream of attribute rows into statistics in `table`, one complete version per micro-batch.

    A version holds the former one and the batch, and counts once it is committed by one
    rename: readers see the former fit until then, and a replayed batch counts once. Of the
    versions only the last two stay. An empty batch makes none, nor does one that comes
    while the statistics are frozen: its rows never count.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark, done = batch.sparkSession, committed(batch.sparkSession, table)
        if batch_id in done or frozen(spark, table) or batch.isEmpty():
            return
        whole = fit_stats(batch, names, tree_key)
        if done:
            whole = merge_stats(spark.read.parquet(f"{table}/version={done[-1]}"), whole)
        whole.write.mode("overwrite").parquet(f"{table}/version={batch_id}")
        tables.publish(spark, f"{table}/commits", str(batch_id))
        for old in done[:-1]:
            tables.remove(spark, f"{table}/commits/{old}")
            tables.remove(spark, f"{table}/version={old}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stats(spark: SparkSession, table: str) -> DataFrame:
    """The statistics of the last committed micro-batch."""
    done = committed(spark, table)
    if not done:
        raise ValueError(f"no statistics are committed in {table}")
    return spark.read.parquet(f"{table}/version={done[-1]}")
