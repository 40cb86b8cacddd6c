"""Connected components of edge tables: union within tiles, then labels between tiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import settle

#: Vertex ids of one tile, whose edges one task unites.
TILE = 1 << 16
#: Vertices that a task holds at once.
HELD = 1 << 20


def components(edges: DataFrame, keys: list[str], tile: int = TILE, most_rounds: int = 64) -> DataFrame:
    """keys, vid and label (the least vertex reachable) for every vertex of the edges (keys, u, v).

    Each tile of vertex ids is contracted in one task to stars; only where tiles meet do
    labels travel between them, with pointer jumping. Raises if that doesn't settle.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.select(*keys).schema)

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One forest for all tiles of a partition; any part of the edges gives true stars.
        parent: dict[tuple, tuple] = {}

        def find(x: tuple) -> tuple:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        def stars() -> pd.DataFrame:
            rows = [(*x[0], x[1], find(x)[1]) for x in list(parent)]
            parent.clear()
            return pd.DataFrame(rows, columns=[*keys, "vid", "label"])

        for pdf in batches:
            for row in zip(zip(*[pdf[k].tolist() for k in keys]), pdf["u"].tolist(), pdf["v"].tolist()):
                a, b = find((row[0], row[1])), find((row[0], row[2]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > HELD:
                yield stars()
        yield stars()

    tiled = edges.select(*keys, "u", "v").repartition(*keys, F.floor(F.least("u", "v") / tile))
    stars = settle(tiled.mapInPandas(unite, f"{fields}, vid long, label long"), "stars")
    labels = stars.groupBy(*keys, "vid").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    labels = settle(labels, "labels")
    if labels.where(F.col("label") != F.col("other")).isEmpty():
        return labels.drop("other")
    both = settle(stars.select(*keys, F.col("vid").alias("u"), F.col("label").alias("v")).unionByName(stars.select(*keys, F.col("label").alias("u"), F.col("vid").alias("v"))).distinct(), "star-edges")
    labels = settle(both.groupBy(*keys, F.col("u").alias("vid")).agg(F.least(F.col("vid"), F.min("v")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("vid", "v"), [*keys, "v"]).groupBy(*keys, F.col("u").alias("vid")).agg(F.min("label").alias("near"))
        new = labels.join(near, [*keys, "vid"]).select(*keys, "vid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = new.select(*keys, F.col("vid").alias("label"), F.col("label").alias("far"))
        new = settle(new.join(jump, [*keys, "label"]).select(*keys, "vid", "old", F.least("label", "far").alias("label")), "labels")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return new.drop("old")
        labels = new.drop("old")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
