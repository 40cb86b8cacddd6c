"""Patches: grids, extraction with a halo, reassembly and weighted losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import KEY

PATCH = [*KEY, "patch_row", "patch_col"]


def _starts(side: Column, size: int, stride: int) -> Column:
    return F.array_union(F.sequence(F.lit(0), (side - size).cast("int"), F.lit(stride)), F.array((side - size).cast("int")))


def patch_grid(images: DataFrame, size: int, stride: int) -> DataFrame:
    """Starts of all patches of each raster (key, n_rows, n_cols), row-major; the last reaches the border."""
    if not 1 <= stride <= size:
        raise ValueError("the stride must be at least 1 and at most the size")
    if images.where(F.least("n_rows", "n_cols") < size).take(1):
        raise ValueError("a raster is smaller than the patch")
    rows = images.withColumn("patch_row", F.explode(_starts(F.col("n_rows"), size, stride)))
    return rows.withColumn("patch_col", F.explode(_starts(F.col("n_cols"), size, stride))).select(*PATCH, "n_rows", "n_cols")


def extract_patches(pixels: DataFrame, patches: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """Pixels of each patch with its halo, 0 outside the raster: local_row, local_col from 0 at the halo's corner."""
    span = F.sequence(F.lit(0), F.lit(size + 2 * halo - 1))
    local = patches.select(*PATCH).withColumn("local_row", F.explode(span)).withColumn("local_col", F.explode(span))
    local = local.withColumn("row", F.col("patch_row") + F.col("local_row") - halo).withColumn("col", F.col("patch_col") + F.col("local_col") - halo)
    core = F.col("local_row").between(halo, halo + size - 1) & F.col("local_col").between(halo, halo + size - 1)
    found = local.join(pixels.select(*KEY, "row", "col", "value"), [*KEY, "row", "col"], "left")
    return found.select(*PATCH, "local_row", "local_col", "row", "col", F.coalesce("value", F.lit(0)).alias("value"), core.alias("is_core"))


def crop_core(patch_pixels: DataFrame) -> DataFrame:
    return patch_pixels.where("is_core")


def coverage(images: DataFrame, patches: DataFrame, size: int) -> DataFrame:
    """Per pixel the number of patches over it, 0 where there is none."""
    inside = patches.withColumn("row", F.explode(F.sequence(F.col("patch_row"), F.col("patch_row") + size - 1))).withColumn("col", F.explode(F.sequence(F.col("patch_col"), F.col("patch_col") + size - 1)))
    n = inside.groupBy(*KEY, "row", "col").agg(F.count(F.lit(1)).alias("n"))
    grid = images.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    return grid.join(n, [*KEY, "row", "col"], "left").select(*KEY, "row", "col", F.coalesce("n", F.lit(0)).alias("n"))


def reassemble_mean(patch_pixels: DataFrame) -> DataFrame:
    """Mean of the overlapping cores; fails on values that aren't finite."""
    v = F.col("value").cast("double")
    core = crop_core(patch_pixels)
    if core.where(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).take(1):
        raise ValueError("patch values must be finite")
    return core.groupBy(*KEY, "row", "col").agg(F.avg(v).alias("value"))


def overlap_add(patch_pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Sum of all patches' signals over the raster, halo included: the adjoint of extract_patches."""
    inside = patch_pixels.join(images.select(*KEY, "n_rows", "n_cols"), KEY).where((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.col("n_rows")) & (F.col("col") < F.col("n_cols")))
    return inside.groupBy(*KEY, "row", "col").agg(F.sum("value").alias("value"))


def patch_weighted_loss(patch_pixels: DataFrame, loss: Column, weight: Column | None = None, auxiliary: Column | None = None, auxiliary_weight: float = 0.0) -> DataFrame:
    """One row: the mean over patches of the weighted mean core loss, plus a weighted auxiliary mean."""
    w = F.lit(1.0) if weight is None else weight
    per = crop_core(patch_pixels).groupBy(*PATCH).agg((F.sum(loss * w) / F.sum(w)).alias("loss"), (F.lit(0.0) if auxiliary is None else F.avg(auxiliary)).alias("auxiliary"))
    return per.agg((F.avg("loss") + auxiliary_weight * F.avg("auxiliary")).alias("loss"))
