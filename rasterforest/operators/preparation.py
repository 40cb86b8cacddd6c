"""Preparing a data set: trees, attributes and statistics of its training rasters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..plans.trees import Forest, build
from ..tables import KEY
from .attributes import compute
from .stats import fit_stats, merge_stats


@dataclass
class Prepared:
    """By tree key, forests and attributes of all rasters; the statistics describe the training rasters only."""

    forests: dict[str, Forest]
    attributes: dict[str, DataFrame]
    stats: DataFrame


def prepare(pixels: DataFrame, tree_keys: list[str], names: list[str], train: DataFrame, radius: float = 1.5) -> Prepared:
    """Trees and attributes of every raster of pixels, and statistics over the rasters that train (image_id) names.

    tree_keys are "max" and "min". A raster named twice counts once; fails if no raster is named.
    """
    if not tree_keys or len({*tree_keys}) < len(tree_keys):
        raise ValueError("tree keys must be given and differ")
    forests = {key: build(pixels, key, radius) for key in tree_keys}
    attributes = {key: compute(forest, names) for key, forest in forests.items()}
    chosen = train.select("image_id").distinct()
    fits = [fit_stats(table.join(chosen, KEY[0], "left_semi"), names, key) for key, table in attributes.items()]
    return Prepared(forests, attributes, merge_stats(*fits))
