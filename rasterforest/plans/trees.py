"""Component trees from the trees of tiles, and the strides along which values travel in them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import KEY, Scratch, settle
from .tiles import FAN_BITS, TILE_BITS, merged_tiles, rim_edges, steps_within, tile_trees

NODE = [*KEY, "node_id"]
#: A stride table leads to the ancestors at 0 to STRIDE - 1 times its length; the next one is STRIDE times as long.
STRIDE = 16
#: Kinds of component trees, and what a value's sign is turned by.
SIGNS = {"max": 1, "min": -1}


@dataclass(frozen=True)
class Forest:
    """Trees of many rasters.

    nodes: key, node_id (least pixel of the node's own pixels), parent_id (itself at the
    root), level, residue, proper_area, depth. owners: key, pixel_id, row, col, value,
    node_id. strides: tables of key, node_id, ancestor_id, times, as STRIDE says.
    """

    kind: str
    radius: float
    nodes: DataFrame
    owners: DataFrame
    strides: tuple[DataFrame, ...]

    @property
    def closure(self) -> DataFrame:
        """key, node_id, ancestor_id, steps of all pairs: as many as the sum of depths, so only for results of that size."""
        return ancestors(self.strides, self.nodes.select(*NODE))

    @cached_property
    def dual(self) -> Forest:
        """The tree of the opposite kind and connectivity over the same pixels, in which holes are components."""
        return build(self.owners.drop("node_id"), "min" if self.kind == "max" else "max", 1.0 if self.radius >= 1.5 else 1.5)


def neighbours(pixels: DataFrame, radius: float) -> DataFrame:
    """key, u, v: each pair of pixels within the radius once (1: four, 1.5: eight neighbours)."""
    near = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps_within(radius)]))
    left = pixels.select(*KEY, F.col("pixel_id").alias("u"), "row", "col", near.alias("s"))
    left = left.select(*KEY, "u", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    return left.join(pixels.select(*KEY, "row", "col", F.col("pixel_id").alias("v")), [*KEY, "row", "col"]).select(*KEY, "u", "v")


def strides(nodes: DataFrame) -> tuple[DataFrame, ...]:
    """Stride tables of key, node_id, parent_id; each has at most STRIDE rows for a node, and depths of 16, 256, 4,096 take 1, 2, 3."""
    keep, out = Scratch(nodes.sparkSession, "strides"), []
    up = nodes.where("parent_id <> node_id").select(*NODE, F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("times"))
    own = nodes.select(*NODE, F.col("node_id").alias("ancestor_id"), F.lit(0).alias("times"))
    while True:
        reach, far, length = up, up, 1
        while length < STRIDE and not far.isEmpty():
            # Pairs at exactly the longest distance so far, continued by every known pair.
            more = reach.select(*KEY, F.col("node_id").alias("ancestor_id"), F.col("ancestor_id").alias("beyond"), F.col("times").alias("more"))
            found = far.join(more, [*KEY, "ancestor_id"]).select(*NODE, F.col("beyond").alias("ancestor_id"), (F.col("times") + F.col("more")).alias("times"))
            found, length = keep.keep(found, "reach"), 2 * length
            reach, far = reach.unionByName(found), found.where(F.col("times") == length)
        out.append(settle(own.unionByName(reach.where(F.col("times") < STRIDE)), "stride"))
        if far.isEmpty():
            keep.close()
            return tuple(out)
        up = far.withColumn("times", F.lit(1))


def ancestors(steps: tuple[DataFrame, ...], of: DataFrame, most: int | None = None) -> DataFrame:
    """key, node_id, ancestor_id, steps for the given nodes (key, node_id), themselves included, up to most steps."""
    out = of.select(*NODE, F.col("node_id").alias("ancestor_id"), F.lit(0).alias("steps"))
    for k, table in enumerate(steps):
        if k and most is not None and most < STRIDE**k:
            break
        up = table.select(*KEY, F.col("node_id").alias("ancestor_id"), F.col("ancestor_id").alias("beyond"), (F.col("times") * STRIDE**k).alias("more"))
        out = out.join(up, [*KEY, "ancestor_id"]).select(*NODE, F.col("beyond").alias("ancestor_id"), (F.col("steps") + F.col("more")).alias("steps"))
        if most is not None:
            out = out.where(F.col("steps") <= most)
    return out


def rolled(steps: tuple[DataFrame, ...], values: DataFrame, up: bool, by: tuple[str, ...] = (), **aggs: str) -> DataFrame:
    """Aggregates (sum, min, max, bool_and, bool_or) of columns over each node's subtree (up) or root path, by further columns."""
    to, at = ("ancestor_id", "node_id") if up else ("node_id", "ancestor_id")
    out = values.select(*NODE, *by, *aggs)
    for table in steps:
        met = table.join(out.withColumnRenamed("node_id", at), [*KEY, at])
        out = met.groupBy(*KEY, F.col(to).alias("node_id"), *by).agg(*[getattr(F, how)(c).alias(c) for c, how in aggs.items()])
    return out


def nearest(steps: tuple[DataFrame, ...], marked: DataFrame) -> DataFrame:
    """key, node_id, holder: the nearest marked ancestor (key, node_id), the node itself included, of each node that has one."""
    out = marked.select(*KEY, F.col("node_id").alias("ancestor_id"), F.col("node_id").alias("holder"))
    for table in steps:
        out = table.join(out, [*KEY, "ancestor_id"]).groupBy(*NODE).agg(F.min_by("holder", "times").alias("holder")).withColumnRenamed("node_id", "ancestor_id")
    return out.withColumnRenamed("ancestor_id", "node_id")


def climbed(steps: tuple[DataFrame, ...], parents: DataFrame, start: DataFrame, item: list[str], marks: DataFrame, passes: Column) -> DataFrame:
    """start (item, key, node_id, bound) with node_id moved to the first ancestor, itself included, whose mark passes.

    marks: key, node_id, mark; passes is a condition on mark and bound that stays true
    upwards once it holds. Starts none of whose ancestors pass are left out.
    """
    keys = [*KEY, *[c for c in item if c not in KEY]]
    at = start.select(*keys, "bound", "node_id")
    on = marks.select(*KEY, F.col("node_id").alias("ancestor_id"), "mark")
    for table in reversed(steps):
        met = at.join(table, NODE).join(on, [*KEY, "ancestor_id"]).where((F.col("times") == 0) | ~passes)
        at = met.groupBy(*keys).agg(F.first("bound").alias("bound"), F.max_by("ancestor_id", "times").alias("node_id"))
    here = at.join(marks, NODE)
    done = here.where(passes).select(*keys, "bound", "node_id")
    up = here.where(~passes).join(parents.where("parent_id <> node_id").select(*NODE, "parent_id"), NODE)
    return done.unionByName(up.select(*keys, "bound", F.col("parent_id").alias("node_id")))


def finished(kind: str, radius: float, nodes: DataFrame, owners: DataFrame) -> Forest:
    """A forest of nodes (key, node_id, parent_id, level, proper_area), with residues, depths and strides."""
    steps = strides(nodes)
    depth = rolled(steps, nodes.select(*NODE, F.lit(1).alias("depth")), False, depth="sum").withColumn("depth", (F.col("depth") - 1).cast("int"))
    up = nodes.select(*KEY, F.col("node_id").alias("parent_id"), F.col("level").alias("p_level"))
    residue = F.when(F.col("node_id") == F.col("parent_id"), F.col("level")).otherwise(F.col("level") - F.col("p_level"))
    done = nodes.join(up, [*KEY, "parent_id"]).withColumn("residue", residue.cast("double")).join(depth, NODE)
    return Forest(kind, radius, settle(done.select(*NODE, "parent_id", "level", "residue", "proper_area", "depth"), "nodes"), owners, steps)


def build(pixels: DataFrame, kind: str = "max", radius: float = 1.5, tile_bits: int = TILE_BITS, interpolation: str = "self-dual", seed: tuple[int, int] = (0, 0)) -> Forest:
    """The max-tree (bright components), min-tree (dark components) or tree of shapes of every raster of pixels.

    Tiles of 2**tile_bits rows and columns grow their own trees; rims then merge, 8 by 8
    parts a round, so a merge holds what the rims of its parts hold, whatever their areas.
    interpolation and seed are those of the tree of shapes (see shape_tree).
    """
    if kind == "shapes":
        from .shapes import shape_tree

        return shape_tree(pixels, interpolation, *seed)
    if kind not in SIGNS:
        raise ValueError(f"kind must be 'max', 'min' or 'shapes', not {kind!r}")
    return grown_together(pixels, [(kind, radius)], tile_bits)


def grown_together(pixels: DataFrame, kinds: list[tuple[str, float]], tile_bits: int = TILE_BITS) -> Forest:
    """Trees of several kinds and radii in the same jobs; the number of the tree is dealt into the channel, channel * their number + its place."""
    keep, n = Scratch(pixels.sparkSession, "tree"), len(kinds)
    signs = [(SIGNS[kind], radius) for kind, radius in kinds]
    pixels = pixels.withColumn("channel", F.explode(F.array(*[F.col("channel") * n + t for t in range(n)]))) if n > 1 else pixels
    local = keep.keep(tile_trees(pixels, signs, tile_bits), "tiles")
    last = local.agg(F.coalesce(F.greatest(F.max("ti"), F.max("tj")), F.lit(0))).first()[0]
    rounds = -(-int(last).bit_length() // FAN_BITS)
    edges = keep.keep(rim_edges(local, signs, tile_bits), "rims") if rounds else None
    nodes, became = merged_tiles(local, edges, signs, rounds, keep)
    owners = local.select(*KEY, "pixel_id", "row", "col", "value", "node_id")
    if became is not None:
        owners = owners.join(became, NODE, "left").withColumn("node_id", F.coalesce("became", "node_id")).drop("became")
    owners = settle(owners, "owners")
    nodes = keep.keep(nodes.withColumnRenamed("n", "proper_area"), "nodes")
    out = finished(*kinds[0], nodes, owners)
    keep.close()
    return out


def picked(forest: Forest, n: int, chosen: list[int], kind: str) -> Forest:
    """Of n trees grown together, those in the chosen places, dealt into the channel by their order."""
    place = F.array_position(F.array(*[F.lit(t) for t in chosen]), F.col("channel") % n).cast("int") - 1
    recode = lambda df: df.where((F.col("channel") % n).isin(chosen)).withColumn("channel", (F.expr(f"channel div {n}") * len(chosen) + place).cast("int"))
    return Forest(kind, forest.radius, recode(forest.nodes), recode(forest.owners), tuple(recode(t) for t in forest.strides))
