"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it (space, and tab to carriage return), and the words between.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only on a single machine may the session name none; a temporary folder is set then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs no more than the stage at hand.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_small_batches(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """docs, whose rows go to Python in batches of at most so many: Spark's 10,000 whole texts are a lot of a task's memory."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return docs


def returning_memory(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a task's function on batches, giving what it took back to the system when the task ends.

    Spark keeps Python workers from task to task and counts what they hold against the executor.
    """

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def numbered(docs: DataFrame, name: str, row: str = "_row") -> DataFrame:
    """docs with a unique key for each row, written once so that every reader meets the same keys."""
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), name)


class Scratch:
    """The tables that one operator writes between its steps, in a folder of the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written as Parquet and read back."""
        self.made += 1
        path = f"{self.path}/{self.made}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that keep() wrote and no later step reads, and let Spark drop the shuffle files behind them."""
        for folder in {name.rpartition("/")[0] for df in tables for name in df.inputFiles()}:
            self._delete(folder)
        self.spark._jvm.System.gc()

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df written outside the folder, which is deleted."""
        out = materialize(df, name)
        self._delete(self.path)
        self.spark._jvm.System.gc()
        return out


def word_count(text: Column) -> Column:
    """Number of words as a long: 0 for null, empty or white-space-only text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
