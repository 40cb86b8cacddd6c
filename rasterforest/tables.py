"""Shared table helpers: keys, shared folder, tables between steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: One raster.
KEY = ["image_id", "channel"]


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where a session on a single machine names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage of iterations."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return written(df, path)


def written(df: DataFrame, path: str) -> DataFrame:
    """df as its files in path have it, to be joined by sorting.

    Ids and levels compress to a small part of their size, so Spark would take tables of
    millions of rows for small ones and pass them whole through the driver.
    """
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def portions(df: DataFrame, rows: int = 1 << 20) -> int:
    """How many portions of about so many rows df has, one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def in_portions(df: DataFrame, keys: list[str], rows: int = 1 << 20) -> DataFrame:
    """df dealt by keys into portions of about so many rows: Spark's own sizes count compressed bytes, of which pixels need few."""
    return df.repartition(portions(df, rows), *keys)


def begins(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """True for the first row of each run of equal keys."""
    new = np.zeros(len(rows), dtype=bool)
    new[:1] = True
    for k in keys:
        x = rows[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches of rows dealt anew so that no group of keys is cut; many small groups stay together."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        new = begins(batch, keys)
        new[0] = not held or tuple(held[-1][keys].iloc[-1]) != tuple(batch[keys].iloc[0])
        cuts = np.flatnonzero(new)
        if held and not len(cuts):
            held.append(batch)
            continue
        if held or cuts[-1]:
            yield pd.concat([*held, batch[: cuts[-1]]], ignore_index=True)
        held = [batch[cuts[-1] :]]
    if held:
        yield pd.concat(held, ignore_index=True)


class Scratch:
    """Tables that one operator writes between its steps; close() deletes them all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.path}/{self.made}-{name}"
        df.write.parquet(path)
        return written(df, path)

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at, spark._jvm.org.apache.hadoop.fs.Path


def published(spark: SparkSession, folder: str) -> list[str]:
    """Names that publish() has put into a folder, in order."""
    fs, at, _ = _files(spark, folder)
    return sorted(n for f in fs.listStatus(at) if not (n := f.getPath().getName()).startswith((".", "_"))) if fs.exists(at) else []


def publish(spark: SparkSession, folder: str, name: str) -> None:
    """Put an empty file of that name into the folder by one rename: a reader sees it whole or not at all."""
    fs, at, path = _files(spark, folder)
    fs.mkdirs(at)
    made = path(f"{folder}/.{uuid.uuid4().hex}")
    fs.create(made).close()
    if not fs.rename(made, path(f"{folder}/{name}")) and name not in published(spark, folder):
        raise OSError(f"{name} could not be published in {folder}")


def remove(spark: SparkSession, path: str) -> None:
    fs, at, _ = _files(spark, path)
    fs.delete(at, True)
