"""Rasters as long pixel tables: image_id, channel, row, col, pixel_id, value."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import KEY


def rasterize(df: DataFrame, image_id: Column, row: Column, col: Column, n_rows: int, n_cols: int, value: Column | None = None) -> DataFrame:
    """A dense raster per image_id of any table: value aggregates the rows of a cell (default: their number).

    Cells without rows are 0. Rows outside the grid or with null keys take no part.
    """
    found = _cells(df, image_id, row.cast("int"), col.cast("int"), n_rows, n_cols, value)
    grid = found.select("_i").distinct().select("_i", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("_r")).select("_i", "_r", F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))).alias("_c"))
    dense = grid.join(found, ["_i", "_r", "_c"], "left")
    pixel = (F.col("_r").cast("long") * n_cols + F.col("_c")).alias("pixel_id")
    return dense.select(F.col("_i").alias("image_id"), F.lit(0).alias("channel"), F.col("_r").alias("row"), F.col("_c").alias("col"), pixel, F.coalesce("value", F.lit(0)).alias("value"))


def rasterize_cells(df: DataFrame, image_id: Column, row: Column, col: Column, n_rows: int, n_cols: int, value: Column | None = None) -> DataFrame:
    """As rasterize, but only the cells that have rows: for grids far larger than the table, with sides in 64 bits."""
    found = _cells(df, image_id, row.cast("long"), col.cast("long"), n_rows, n_cols, value)
    return found.select(F.col("_i").alias("image_id"), F.lit(0).alias("channel"), F.col("_r").alias("row"), F.col("_c").alias("col"), (F.col("_r") * F.lit(n_cols) + F.col("_c")).alias("pixel_id"), "value")


def _cells(df: DataFrame, image_id: Column, row: Column, col: Column, n_rows: int, n_cols: int, value: Column | None) -> DataFrame:
    agg = F.count(F.lit(1)) if value is None else value
    cells = df.select("*", image_id.cast("string").alias("_i"), row.alias("_r"), col.alias("_c"))
    cells = cells.where(F.col("_i").isNotNull() & F.col("_r").between(0, n_rows - 1) & F.col("_c").between(0, n_cols - 1))
    return cells.groupBy("_i", "_r", "_c").agg(agg.alias("value"))


def quantize(pixels: DataFrame, levels: int = 16) -> DataFrame:
    """Values of each raster as (levels - 1) * value div its largest value, in integers."""
    top = pixels.groupBy(*KEY).agg(F.max("value").alias("top"))
    value = F.when(F.col("top") > 0, F.floor(F.col("value") * (levels - 1) / F.col("top"))).otherwise(0)
    return pixels.join(top, KEY).withColumn("value", value.cast("int")).drop("top")


def read_images(spark: SparkSession, path: str, gray: bool = True, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "bmp", "gif")) -> DataFrame:
    """Pixels of the image files below path, by Spark's own decoder: gray, or red, green and blue as channels 0 to 2.

    Opacity is left out; a gray file's three colours are equal. A file that can't be decoded
    fails. An image is cut into its rows before a pixel is made, and a row into its pixels.
    """
    names = "*.{" + ",".join(sorted({e for x in extensions for e in (x.lower(), x.upper())})) + "}"
    raw = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path).select("image.*")
    height = F.when(F.col("height") > 0, F.col("height")).otherwise(F.raise_error(F.concat(F.lit("not an image: "), "origin")).cast("int"))
    stride = F.col("width") * F.col("nChannels")
    cut = F.transform(F.sequence(F.lit(0), height - 1), lambda r: F.struct(r.alias("row"), F.substring(F.col("data"), r * stride + 1, stride).alias("bytes")))
    rows = raw.select(F.col("origin").alias("image_id"), "width", "nChannels", F.explode(cut).alias("r")).select("image_id", "width", "nChannels", "r.*")
    cell = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.struct(c.alias("col"), F.substring(F.col("bytes"), c * F.col("nChannels") + 1, F.col("nChannels")).alias("bytes")))
    cells = rows.select("image_id", "width", "nChannels", "row", F.explode(cell).alias("c"))
    # The decoder's order is blue, green, red, opacity.
    colour = [F.conv(F.hex(F.substring(F.col("c.bytes"), F.when(F.col("nChannels") == 1, 1).otherwise(3 - k), F.lit(1))), 16, 10).cast("int") for k in range(3)]
    cells = cells.select("image_id", "row", F.col("c.col").alias("col"), (F.col("row").cast("long") * F.col("width") + F.col("c.col")).alias("pixel_id"), *[v.alias(n) for v, n in zip(colour, "rgb")])
    if gray:
        value = F.round(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("int")
        return cells.select("image_id", F.lit(0).alias("channel"), "row", "col", "pixel_id", value.alias("value"))
    return cells.select("image_id", F.posexplode(F.array("r", "g", "b")).alias("channel", "value"), "row", "col", "pixel_id").select("image_id", "channel", "row", "col", "pixel_id", "value")


#: What a file's first bytes tell; nulls where they are of no known format.
HEADER = "n_rows int, n_cols int, n_channels int, dtype string"


def _header(content: bytes | None) -> tuple[int | None, int | None, int | None, str | None]:
    """Sides, channels as stored (a palette counts as three) and type of a PNG, JPEG, BMP or GIF file."""
    none, b = (None,) * 4, content or b""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n" and b[12:16] == b"IHDR":
            cols, rows, depth, kind = struct.unpack(">IIBB", b[16:26])
            return rows, cols, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}[kind], "uint16" if depth == 16 else "uint8"
        if b[:2] == b"\xff\xd8":
            at = 2
            while b[at] == 0xFF:
                mark = b[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    depth, rows, cols, channels = struct.unpack(">BHHB", b[at + 4 : at + 10])
                    return rows, cols, channels, "uint8" if depth == 8 else "uint16"
                # Fill bytes and marks without a length are one or two bytes long.
                at += 1 if mark == 0xFF else 2 if mark == 0x01 or 0xD0 <= mark <= 0xD8 else 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
            return none
        if b[:2] == b"BM":
            cols, rows, _, bits = struct.unpack("<iiHH", b[18:30])
            return abs(rows), cols, {1: 3, 4: 3, 8: 3, 16: 3, 24: 3, 32: 4}[bits], "uint8"
        if b[:6] in (b"GIF87a", b"GIF89a"):
            cols, rows = struct.unpack("<HH", b[6:10])
            return rows, cols, 3, "uint8"
    except (struct.error, IndexError, KeyError):
        pass
    return none


def _headers(content: pd.Series) -> pd.DataFrame:
    found = pd.DataFrame([_header(x) for x in content], columns=["n_rows", "n_cols", "n_channels", "dtype"], dtype=object)
    return found.astype({c: "Int32" for c in ("n_rows", "n_cols", "n_channels")})


def image_header(content: Column) -> Column:
    """A struct of n_rows, n_cols, n_channels and dtype from a file's bytes, nothing decoded; only JPEG needs more than the first 32."""
    jpeg = F.hex(F.substring(content, 1, 2)) == "FFD8"
    return F.pandas_udf(_headers, HEADER)(F.when(jpeg, content).otherwise(F.substring(content, 1, 32)))


def write_prepared(df: DataFrame, path: str, tree_key: str) -> None:
    """Persist a tree's table, partitioned by tree_key."""
    df.withColumn("tree_key", F.lit(tree_key)).write.mode("append").partitionBy("tree_key").parquet(path)


def read_prepared(spark: SparkSession, path: str, tree_key: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if tree_key is None else df.where(F.col("tree_key") == tree_key)
