"""Connected filters: pruning, direct, subtractive, soft and extinction filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.trees import Forest, nearest
from ..tables import KEY
from .trees import NODE, leaves, max_tree, min_tree, roll_down, roll_up, tree_of_shapes


def _checked(forest: Forest, marks: DataFrame, column: str) -> DataFrame:
    """marks must name every node of the forest once, without nulls."""
    n = marks.groupBy(*NODE).agg(F.count(F.col(column)).alias("n"))
    odd = forest.nodes.join(n, NODE, "full").where(F.col("n").isNull() | (F.col("n") != 1) | F.col("level").isNull()).take(1)
    if odd:
        raise ValueError(f"{column} needs one value for each node; see node {odd[0]['node_id']} of {odd[0]['image_id']}")
    return marks.select(*NODE, column)


def _pixels(forest: Forest, by_node: DataFrame, column: str) -> DataFrame:
    return forest.owners.drop("value").join(by_node, NODE).select(*KEY, "pixel_id", "row", "col", F.col(column).alias("value"))


def _nearest(forest: Forest, keep: DataFrame) -> DataFrame:
    """Pixels at the level of the nearest kept ancestor; the root is always kept."""
    roots = forest.nodes.where("node_id = parent_id").select(*NODE)
    kept = keep.where("keep").select(*NODE).unionByName(roots).distinct()
    near = nearest(forest.strides, kept).withColumnRenamed("holder", "a")
    level = forest.nodes.select(*KEY, F.col("node_id").alias("a"), "level")
    return _pixels(forest, near.join(level, [*KEY, "a"]).select(*NODE, "level"), "level")


def pruning_min(forest: Forest, marks: DataFrame, keep: Column) -> DataFrame:
    """Keep a node if it and all its ancestors pass."""
    marks = _checked(forest, marks.select(*NODE, keep.alias("keep")), "keep")
    return _nearest(forest, roll_down(forest, marks, keep="bool_and"))


def pruning_max(forest: Forest, marks: DataFrame, keep: Column) -> DataFrame:
    """Keep a node if it or any descendant passes."""
    marks = _checked(forest, marks.select(*NODE, keep.alias("keep")), "keep")
    return _nearest(forest, roll_up(forest, marks, keep="bool_or"))


def direct(forest: Forest, marks: DataFrame, keep: Column) -> DataFrame:
    return _nearest(forest, _checked(forest, marks.select(*NODE, keep.alias("keep")), "keep"))


def subtractive(forest: Forest, marks: DataFrame, keep: Column) -> DataFrame:
    """Sum of the kept residues on the root path, as signed longs that aren't clipped."""
    marks = _checked(forest, marks.select(*NODE, keep.alias("keep")), "keep")
    gain = forest.nodes.join(marks, NODE).select(*NODE, F.when(F.col("keep"), F.col("residue")).otherwise(0.0).alias("gain"))
    return _pixels(forest, roll_down(forest, gain, gain="sum").withColumn("gain", F.col("gain").cast("long")), "gain")


def soft_subtractive(forest: Forest, scores: DataFrame) -> DataFrame:
    """Sum of residue times score on the root path; scores (key, node_id, score) within 0 and 1."""
    s = F.col("score")
    if (bad := scores.where(s.isNull() | F.isnan(s) | (s < 0) | (s > 1)).take(1)) :
        raise ValueError(f"scores must be finite and within 0 and 1; see node {bad[0]['node_id']}")
    return reconstruct(forest, _checked(forest, scores, "score"))


def reconstruct(forest: Forest, scores: DataFrame) -> DataFrame:
    """The transposed Jacobian on residue times score: pixels of a node signal."""
    gain = forest.nodes.join(scores, NODE).select(*NODE, (F.col("residue") * F.col("score")).alias("gain"))
    return _pixels(forest, roll_down(forest, gain, gain="sum"), "gain")


def extinction_values(forest: Forest, attribute: DataFrame) -> DataFrame:
    """One value per extremum (leaf): the attribute at the top of its path of winning children.

    attribute: key, node_id, value. At each node the child subtree of the larger attribute
    wins, on ties the smaller node_id; the raster's last winner gets infinity.
    """
    if forest.kind == "shapes":
        raise ValueError("extinction values need a max-tree or a min-tree")
    v = F.col("value").cast("double")
    if attribute.where(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).take(1):
        raise ValueError("the attribute must be finite")
    attribute = _checked(forest, attribute, "value")
    kids = forest.nodes.where("node_id <> parent_id").select(*NODE, "parent_id").join(attribute, NODE)
    w = W.partitionBy(*KEY, "parent_id").orderBy(F.desc("value"), "node_id")
    win = kids.select(*NODE, (F.row_number().over(w) == 1).alias("wins"))
    # A leaf's path goes up to the first node that loses against a sibling.
    stop = leaves(forest).select(*NODE).join(nearest(forest.strides, win.where("NOT wins")), NODE, "left")
    out = stop.select(*KEY, F.col("node_id").alias("leaf"), F.col("holder").alias("node_id")).join(attribute, NODE, "left")
    return out.select(*KEY, F.col("leaf").alias("node_id"), F.coalesce(F.col("value").cast("double"), F.lit(float("inf"))).alias("extinction"))


def filter_extinction(forest: Forest, attribute: DataFrame, top_k: int | None = None, threshold: float | None = None) -> DataFrame:
    """Keep the ancestors of the selected extrema: the k of largest extinction, or all at or above a threshold."""
    if (top_k is None) == (threshold is None) or (top_k or 0) < 0 or threshold != threshold:
        raise ValueError("give either top_k (0 or more) or a threshold")
    values = extinction_values(forest, attribute)
    if top_k is not None:
        w = W.partitionBy(*KEY).orderBy(F.desc("extinction"), "node_id")
        values = values.withColumn("keep", F.row_number().over(w) <= top_k)
    else:
        values = values.withColumn("keep", F.col("extinction") >= threshold)
    marks = forest.nodes.select(*NODE).join(values.select(*NODE, "keep"), NODE, "left")
    return pruning_max(forest, marks, F.coalesce("keep", F.lit(False)))


def area_of(forest: Forest) -> DataFrame:
    return roll_up(forest, forest.nodes.select(*NODE, "proper_area"), proper_area="sum").withColumnRenamed("proper_area", "area")


def area_opening(pixels: DataFrame, least: int, radius: float = 1.5) -> DataFrame:
    """Remove bright components of fewer than `least` pixels."""
    forest = max_tree(pixels, radius)
    return pruning_min(forest, area_of(forest), F.col("area") >= least)


def area_closing(pixels: DataFrame, least: int, radius: float = 1.5) -> DataFrame:
    """Fill dark components of fewer than `least` pixels."""
    forest = min_tree(pixels, radius)
    return pruning_min(forest, area_of(forest), F.col("area") >= least)


def grain_filter(pixels: DataFrame, least: int, interpolation: str = "self-dual", seed_row: int = 0, seed_col: int = 0) -> DataFrame:
    """Remove shapes of fewer than `least` pixels, bright and dark alike."""
    forest = tree_of_shapes(pixels, interpolation, seed_row, seed_col)
    return pruning_min(forest, area_of(forest), F.col("area") >= least)
