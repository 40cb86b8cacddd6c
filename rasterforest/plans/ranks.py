"""Ranks and running sums over any number of rows: ranges of the order, then prefix sums of their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import settle


def in_parts(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with _part, whose values follow the order within each group: a part is a range of about equal size, also of one large group."""
    dealt = df.repartitionByRange(*[F.col(c) for c in by], *order)
    return settle(dealt.withColumn("_part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: list[str], order: list[Column], **sums: Column) -> DataFrame:
    """df with the running sums of expressions, rows in order within each group (nulls as 0); rows that tie in order need to be the same in it.

    No window holds more than one part of a group, or one row for each part.
    """
    parts = in_parts(df, by, order)
    totals = parts.groupBy(*by, "_part").agg(*[F.sum(F.coalesce(e, F.lit(0))).alias(f"_{n}") for n, e in sums.items()])
    before = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    within = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = parts.withColumns({n: F.sum(F.coalesce(e, F.lit(0))).over(within) for n, e in sums.items()})
    return own.join(totals, [*by, "_part"]).withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *[f"_{n}" for n in sums])


def numbered_within(df: DataFrame, by: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """df with the rank of each row in its group, from 0; order must tell all rows of a group apart."""
    return running(df, by, order, **{name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("long"))
