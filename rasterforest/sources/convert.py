"""Value conversion, resizing and checks of pixel tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import KEY


def _per_raster(pixels: DataFrame, **aggs: object) -> DataFrame:
    return pixels.join(pixels.groupBy(*KEY).agg(*[a.alias(n) for n, a in aggs.items()]), KEY)


def to_u8(pixels: DataFrame) -> DataFrame:
    """Truncated bytes; rasters with a maximum of at most 1.5 are scaled by 255 first."""
    if dict(pixels.dtypes)["value"] == "boolean":
        return pixels.withColumn("value", F.when(F.col("value"), 255).otherwise(0))
    df = _per_raster(pixels, top=F.max("value"))
    value = F.when(F.col("top") <= 1.5, F.col("value") * 255).otherwise(F.col("value"))
    return df.withColumn("value", F.least(F.greatest(value, F.lit(0)), F.lit(255)).cast("int")).drop("top")


def validate_intensity(pixels: DataFrame) -> DataFrame:
    """A row for each raster that isn't finite, within 0 to 255, or unambiguous in its scale."""
    v = F.col("value").cast("double")
    bad = F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    per = pixels.groupBy(*KEY).agg(bad.alias("odd"), F.min(v).alias("low"), F.max(v).alias("high"))
    issue = F.when(F.col("odd") > 0, "not finite").when(F.col("low") < 0, "negative").when(F.col("high") > 255, "above 255").when((F.col("high") > 1 + 1e-6) & (F.col("high") <= 1.5), "ambiguous scale")
    return per.select(*KEY, issue.alias("issue")).where(F.col("issue").isNotNull())


def invert(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("value", F.lit(255) - F.least(F.greatest("value", F.lit(0)), F.lit(255)))


def _shape(pixels: DataFrame) -> DataFrame:
    return _per_raster(pixels, n_rows=F.max("row") + 1, n_cols=F.max("col") + 1)


def resize_area(pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """Mean over each target cell, weighted by the overlap with the source cells."""

    def targets(at: str, n: str, size: int) -> list:
        low, high = F.col(at) * size / F.col(n), (F.col(at) + 1) * size / F.col(n)
        cells = F.sequence(F.floor(low).cast("int"), F.greatest(F.ceil(high) - 1, F.floor(low)).cast("int"))
        return [F.explode(F.transform(cells, lambda t: F.struct(t.alias("at"), (F.least(high, t + 1) - F.greatest(low, t)).alias("part"))))]

    df = _shape(pixels).withColumn("r", *targets("row", "n_rows", rows)).withColumn("c", *targets("col", "n_cols", cols))
    df = df.withColumn("w", F.col("r.part") * F.col("c.part")).where(F.col("w") > 1e-12)
    out = df.groupBy(*KEY, F.col("r.at").alias("row"), F.col("c.at").alias("col")).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    return out.select(*KEY, "row", "col", (F.col("row").cast("long") * cols + F.col("col")).alias("pixel_id"), "value")


def resize_nearest(pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    shape = _shape(pixels).select(*KEY, "n_rows", "n_cols").distinct()
    grid = shape.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    grid = grid.withColumn("s_row", F.floor(F.col("row") * F.col("n_rows") / rows).cast("int")).withColumn("s_col", F.floor(F.col("col") * F.col("n_cols") / cols).cast("int"))
    source = pixels.select(*KEY, F.col("row").alias("s_row"), F.col("col").alias("s_col"), "value")
    return grid.join(source, [*KEY, "s_row", "s_col"]).select(*KEY, "row", "col", (F.col("row").cast("long") * cols + F.col("col")).alias("pixel_id"), "value")


def scale(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("value", F.col("value") / 255.0)


def binarize(pixels: DataFrame) -> DataFrame:
    """0/1 targets; fails on a raster whose values aren't 0 and 1 or 0 and 255."""
    seen = pixels.select(*KEY, "value").distinct().groupBy(*KEY).agg(F.count_if(~F.col("value").isin(0, 1)).alias("a"), F.count_if(~F.col("value").isin(0, 255)).alias("b"))
    odd = seen.where((F.col("a") > 0) & (F.col("b") > 0)).select("image_id").take(3)
    if odd:
        raise ValueError(f"targets must hold 0 and 1 or 0 and 255: {[r[0] for r in odd]}")
    return pixels.withColumn("value", (F.col("value") > 0).cast("int"))


def check_same_shape(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rasters whose sides differ between the two tables, or that only one of them has."""
    a, b = (_shape(x).select(*KEY, F.col("n_rows").alias(f"{s}_rows"), F.col("n_cols").alias(f"{s}_cols")).distinct() for x, s in ((left, "left"), (right, "right")))
    both = a.join(b, KEY, "full")
    return both.where(~(F.col("left_rows").eqNullSafe(F.col("right_rows")) & F.col("left_cols").eqNullSafe(F.col("right_cols"))))


def with_generated_target(pixels: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pixels with the column target from a function of the whole pixel table."""
    target = make(pixels)
    odd = check_same_shape(pixels, target).take(1)
    if odd:
        raise ValueError(f"the target of {odd[0]['image_id']} has another shape")
    return pixels.join(target.select(*KEY, "pixel_id", F.col("value").alias("target")), [*KEY, "pixel_id"])


def channel_first(pixels: DataFrame) -> DataFrame:
    """One row per raster: its values by channel, then row-major."""
    rows = pixels.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pixel_id", "value"))), lambda x: x["value"]).alias("values"))
    return rows.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "values"))), lambda x: x["values"]).alias("channels"))
