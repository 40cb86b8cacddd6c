"""Queries on component trees: topology, traversal, reconstruction, pruning and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranks import numbered_within
from ..plans.trees import NODE, Forest, ancestors, build, climbed, finished, nearest, rolled, strides
from ..tables import KEY, settle


def max_tree(pixels: DataFrame, radius: float = 1.5) -> Forest:
    return build(pixels, "max", radius)


def min_tree(pixels: DataFrame, radius: float = 1.5) -> Forest:
    return build(pixels, "min", radius)


def tree_of_shapes(pixels: DataFrame, interpolation: str = "self-dual", seed_row: int = 0, seed_col: int = 0) -> Forest:
    return build(pixels, "shapes", interpolation=interpolation, seed=(seed_row, seed_col))


def roll_up(forest: Forest, values: DataFrame, by: tuple[str, ...] = (), **aggs: str) -> DataFrame:
    """Aggregates (sum, min, max, bool_and, bool_or) of columns over each node's subtree; the node itself counts."""
    return rolled(forest.strides, values, True, by, **aggs)


def roll_down(forest: Forest, values: DataFrame, by: tuple[str, ...] = (), **aggs: str) -> DataFrame:
    """Aggregates of columns over each node's root path."""
    return rolled(forest.strides, values, False, by, **aggs)


def tree_summary(forest: Forest) -> DataFrame:
    """Per raster: root, numbers of nodes, leaves and pixels, and the sides."""
    leaf = leaves(forest).groupBy(*KEY).agg(F.count(F.lit(1)).alias("num_leaf_nodes"))
    size = forest.owners.groupBy(*KEY).agg(F.count(F.lit(1)).alias("num_pixels"), (F.max("row") + 1).alias("num_rows"), (F.max("col") + 1).alias("num_columns"))
    nodes = forest.nodes.groupBy(*KEY).agg(F.max(F.when(F.col("node_id") == F.col("parent_id"), F.col("node_id"))).alias("root"), F.count(F.lit(1)).alias("num_nodes"))
    return nodes.join(leaf, KEY).join(size, KEY)


def leaves(forest: Forest) -> DataFrame:
    parents = forest.nodes.where("node_id <> parent_id").select(*KEY, F.col("parent_id").alias("node_id")).distinct()
    return forest.nodes.join(parents, NODE, "left_anti")


def relatives(forest: Forest) -> DataFrame:
    """Per node: num_children, num_siblings, first_child, next_sibling, is_root, is_leaf."""
    kids = forest.nodes.where("node_id <> parent_id")
    by = kids.groupBy(*KEY, F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("num_children"), F.min("node_id").alias("first_child"))
    w = W.partitionBy(*KEY, "parent_id")
    side = kids.select(*NODE, F.lead("node_id").over(w.orderBy("node_id")).alias("next_sibling"), (F.count(F.lit(1)).over(w) - 1).alias("num_siblings"))
    out = forest.nodes.join(by, NODE, "left").join(side, NODE, "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("num_children", "num_siblings")]
    return out.select(*NODE, "parent_id", *zero, "first_child", "next_sibling", (F.col("node_id") == F.col("parent_id")).alias("is_root"), F.col("num_children").isNull().alias("is_leaf"))


def ancestors_of(forest: Forest, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """key, node_id, ancestor_id, steps of the given nodes, themselves included, up to most steps."""
    return ancestors(forest.strides, nodes.select(*NODE).distinct(), most)


def descendants_of(forest: Forest, nodes: DataFrame, strict: bool = True) -> DataFrame:
    tops = nodes.select(*NODE).distinct().join(forest.nodes.select(*NODE, "parent_id", "depth"), NODE)
    held = nearest(forest.strides, tops)
    # The given nodes as a forest of their own: each below the nearest of the others above it.
    over = held.select(*KEY, F.col("node_id").alias("parent_id"), F.col("holder").alias("up"))
    linked = tops.join(over, [*KEY, "parent_id"], "left").select(*NODE, F.when(F.col("node_id") != F.col("parent_id"), F.col("up")).alias("up"))
    chains = ancestors(strides(settle(linked.select(*NODE, F.coalesce("up", "node_id").alias("parent_id")), "tops")), tops)
    chains = chains.select(*KEY, F.col("node_id").alias("holder"), "ancestor_id")
    deep = lambda n, c: forest.nodes.select(*KEY, F.col("node_id").alias(n), F.col("depth").alias(c))
    found = held.join(chains, [*KEY, "holder"]).join(deep("node_id", "low"), NODE).join(deep("ancestor_id", "high"), [*KEY, "ancestor_id"])
    found = found.select(*NODE, "ancestor_id", (F.col("low") - F.col("high")).alias("steps"))
    return found.where("steps > 0") if strict else found


def path_between(forest: Forest, pairs: DataFrame) -> DataFrame:
    """Nodes on the path of each pair (key, a, b), in order from a to b."""
    half = lambda s: ancestors_of(forest, pairs.select(*KEY, F.col(s).alias("node_id"))).select(*KEY, F.col("node_id").alias(s), "ancestor_id", F.col("steps").alias(f"{s}_steps"))
    p = pairs.select(*KEY, "a", "b")
    up, down = p.join(half("a"), [*KEY, "a"]), p.join(half("b"), [*KEY, "b"])
    pair = [*KEY, "a", "b"]
    meet = up.join(down, [*pair, "ancestor_id"]).groupBy(*pair).agg(F.min("a_steps").alias("a_top"), F.min("b_steps").alias("b_top"))
    first = up.join(meet, pair).where(F.col("a_steps") <= F.col("a_top")).select(*pair, F.col("a_steps").alias("position"), F.col("ancestor_id").alias("node_id"))
    second = down.join(meet, pair).where(F.col("b_steps") < F.col("b_top")).select(*pair, (F.col("a_top") + F.col("b_top") - F.col("b_steps")).alias("position"), F.col("ancestor_id").alias("node_id"))
    return first.unionByName(second)


def tree_intervals(forest: Forest) -> DataFrame:
    """Per node tpre and tpost: the compact preorder of the depth-first walk, children by node_id."""
    size = roll_up(forest, forest.nodes.select(*NODE, F.lit(1).cast("long").alias("size")), size="sum")
    w = W.partitionBy(*KEY, "parent_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)
    kids = forest.nodes.join(size, NODE).where("node_id <> parent_id").withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)) + 1)
    offsets = kids.select(*NODE, "offset").unionByName(forest.nodes.where("node_id = parent_id").select(*NODE, F.lit(0).cast("long").alias("offset")))
    pre = roll_down(forest, offsets, offset="sum").withColumnRenamed("offset", "tpre")
    return pre.join(size, NODE).select(*NODE, "tpre", (F.col("tpre") + F.col("size")).alias("tpost"))


def lowest_common(forest: Forest, pairs: DataFrame) -> DataFrame:
    """key, a, b and meet, the lowest common ancestor of each pair of nodes (either of them, where it lies above the other)."""
    spans = tree_intervals(forest)
    asked = pairs.select(*KEY, "a", "b").distinct().join(spans.select(*KEY, F.col("node_id").alias("b"), F.col("tpre").alias("bound")), [*KEY, "b"])
    marks = spans.select(*NODE, F.struct("tpre", "tpost").alias("mark"))
    holds = (F.col("mark.tpre") <= F.col("bound")) & (F.col("bound") < F.col("mark.tpost"))
    met = climbed(forest.strides, forest.nodes, asked.select(*KEY, "a", "b", "bound", F.col("a").alias("node_id")), ["a", "b"], marks, holds)
    return met.select(*KEY, "a", "b", F.col("node_id").alias("meet"))


def walk(forest: Forest, order: str = "post", start: DataFrame | None = None) -> DataFrame:
    """Nodes with their position in the post-order or breadth-first walk of their raster.

    With start, a table of nodes, the walk of each one's subtree, named by of_node.
    """
    if order not in ("post", "breadth"):
        raise ValueError(f"order must be 'post' or 'breadth', not {order!r}")
    at, of = forest.nodes.select(*NODE, "depth"), KEY
    if order == "post":
        # A node comes after its whole subtree and before what starts later.
        at = tree_intervals(forest).join(at, NODE).select(*NODE, "tpre", "tpost", (F.col("tpost") - 1 - F.col("depth")).cast("long").alias("position"))
    if start is not None:
        inside = descendants_of(forest, start, strict=False).select(*NODE, F.col("ancestor_id").alias("of_node"))
        of = [*KEY, "of_node"]
        if order == "post":
            # A subtree's nodes follow each other; its top is the last.
            top = at.select(*KEY, F.col("node_id").alias("of_node"), (F.col("position") - (F.col("tpost") - F.col("tpre")) + 1).alias("first"))
            at = at.join(inside, NODE).join(top, of).withColumn("position", F.col("position") - F.col("first"))
        else:
            at = at.join(inside, NODE)
    if order == "breadth":
        at = numbered_within(at, of, [F.col("depth"), F.col("node_id")])
    return at.select(*of, "node_id", "position")


def find_nodes(forest: Forest, attributes: DataFrame, condition: Column | None = None, by: str | None = None, top: int = 1) -> DataFrame:
    """Attributes of the nodes that meet a condition; with by, each raster's top ones of that attribute, largest first.

    Nulls never meet a condition and never rank; ties go to the smaller node_id. Adds rank with by.
    """
    rows = attributes.join(forest.nodes.select(*NODE), NODE, "left_semi")
    if condition is not None:
        rows = rows.where(condition)
    if by is None:
        return rows
    rank = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc(by), "node_id"))
    return rows.where(F.col(by).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= top)


def smallest_node(forest: Forest, pixels: DataFrame) -> DataFrame:
    """pixels (key, row, col) with pixel_id and node_id, the smallest node over each; nulls outside the raster, one row for each given."""
    at = forest.owners.select(*KEY, "row", "col", "pixel_id", "node_id")
    clash = [c for c in ("pixel_id", "node_id") if c in pixels.columns]
    return pixels.drop(*clash).join(at, [*KEY, "row", "col"], "left")


def reconstruct_node(forest: Forest, nodes: DataFrame) -> DataFrame:
    """0/255 mask pixels of each node's whole component."""
    inside = descendants_of(forest, nodes, strict=False).select(*KEY, F.col("ancestor_id").alias("of_node"), "node_id")
    on = forest.owners.join(inside, NODE).select(*KEY, "of_node", "pixel_id", F.lit(255).alias("value"))
    grid = forest.owners.select(*KEY, "pixel_id").join(nodes.select(*KEY, F.col("node_id").alias("of_node")), KEY)
    return grid.join(on, [*KEY, "of_node", "pixel_id"], "left").select(*KEY, "of_node", "pixel_id", F.coalesce("value", F.lit(0)).alias("value"))


def reconstruct_levels(forest: Forest) -> DataFrame:
    return forest.owners.join(forest.nodes.select(*NODE, "level"), NODE).select(*KEY, "pixel_id", "row", "col", F.col("level").alias("value"))


def without(forest: Forest, gone: DataFrame, subtree: bool) -> Forest:
    """The forest without the given nodes (prune: with their subtrees); pixels and children go to the nearest kept ancestor.

    Roots stay, and a root among the given nodes takes nothing with it.
    """
    roots = forest.nodes.where("node_id = parent_id").select(*NODE)
    gone = gone.select(*NODE).join(roots, NODE, "left_anti")
    if subtree:
        gone = descendants_of(forest, gone, strict=False).select(*NODE).distinct()
    kept = forest.nodes.join(gone, NODE, "left_anti")
    holder = settle(nearest(forest.strides, kept), "holders")
    owners = settle(forest.owners.join(holder, NODE).drop("node_id").withColumnRenamed("holder", "node_id"), "owners")
    up = holder.select(*KEY, F.col("node_id").alias("parent_id"), "holder")
    sizes = owners.groupBy(*NODE).agg(F.count(F.lit(1)).alias("proper_area"))
    nodes = kept.select(*NODE, "parent_id", "level").join(up, [*KEY, "parent_id"]).drop("parent_id").withColumnRenamed("holder", "parent_id").join(sizes, NODE)
    return finished(forest.kind, forest.radius, settle(nodes.select(*NODE, "parent_id", "level", "proper_area"), "kept"), owners)


def prune_nodes(forest: Forest, nodes: DataFrame) -> Forest:
    return without(forest, nodes, subtree=True)


def merge_into_parent(forest: Forest, nodes: DataFrame) -> Forest:
    return without(forest, nodes, subtree=False)


def validate_tree(forest: Forest) -> DataFrame:
    """Violations: rasters without exactly one root, missing parents, levels that don't change, lost owners, areas that don't add up, intervals that don't nest, preorders with gaps."""
    n = forest.nodes
    roots = n.groupBy(*KEY).agg(F.count_if(F.col("node_id") == F.col("parent_id")).alias("x")).where("x <> 1").select(*KEY, F.lit("roots").alias("issue"))
    lost = n.join(n.select(*KEY, F.col("node_id").alias("parent_id")), [*KEY, "parent_id"], "left_anti").select(*KEY, F.lit("parent").alias("issue"))
    flat = n.where("node_id <> parent_id AND residue = 0").select(*KEY, F.lit("residue").alias("issue"))
    owner = forest.owners.join(n.select(*NODE), NODE, "left_anti").select(*KEY, F.lit("owner").alias("issue"))
    area = n.groupBy(*KEY).agg(F.sum("proper_area").alias("a")).join(forest.owners.groupBy(*KEY).agg(F.count(F.lit(1)).alias("b")), KEY).where("a <> b").select(*KEY, F.lit("area").alias("issue"))
    iv = tree_intervals(forest)
    outer = iv.select(*KEY, F.col("node_id").alias("parent_id"), F.col("tpre").alias("p_pre"), F.col("tpost").alias("p_post"))
    nested = n.where("node_id <> parent_id").join(iv, NODE).join(outer, [*KEY, "parent_id"]).where("tpre <= p_pre OR tpost > p_post").select(*KEY, F.lit("interval").alias("issue"))
    order = iv.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tpre").alias("m"), F.max("tpre").alias("last")).where("n <> m OR last <> n - 1").select(*KEY, F.lit("preorder").alias("issue"))
    return roots.unionByName(lost).unionByName(flat).unionByName(owner).unionByName(area).unionByName(nested).unionByName(order)


def jacobian(forest: Forest, max_rows: int | None = None) -> DataFrame:
    """(node_id, pixel_id) incidence of all supports; refuses beyond max_rows, the sum of areas."""
    rows = forest.nodes.select((F.col("proper_area") * (F.col("depth") + 1)).alias("n"))
    if max_rows is not None and (n := rows.agg(F.sum("n")).first()[0] or 0) > max_rows:
        raise ValueError(f"the supports have {n} rows, more than {max_rows}")
    return forest.owners.join(forest.closure, NODE).select(*KEY, F.col("ancestor_id").alias("node_id"), "pixel_id", "row", "col", "value")


def export_hierarchy(forest: Forest) -> DataFrame:
    """Pixels, then nodes from the leaves' depth to the root, with dense ids, parents and altitudes.

    node_id maps a node's id back to the tree's; it is null for pixels.
    """
    size = forest.owners.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    ids = numbered_within(forest.nodes.select(*NODE, "parent_id", "level", "depth"), KEY, [F.desc("depth"), F.col("node_id")])
    ids = settle(ids.join(size, KEY).select(*NODE, "parent_id", "level", (F.col("n") + F.col("position")).alias("h_id")), "h-ids")
    up = ids.select(*KEY, F.col("node_id").alias("parent_id"), F.col("h_id").alias("parent"))
    nodes = ids.join(up, [*KEY, "parent_id"]).select(*KEY, "h_id", "parent", F.col("level").cast("double").alias("altitude"), "node_id")
    pixels = forest.owners.join(ids.select(*NODE, F.col("h_id").alias("parent")), NODE).select(*KEY, F.col("pixel_id").alias("h_id"), "parent", F.col("value").cast("double").alias("altitude"))
    return pixels.withColumn("node_id", F.lit(None).cast("long")).unionByName(nodes)


def project_attributes(hierarchy: DataFrame, attributes: DataFrame) -> DataFrame:
    """Node attributes under the ids of an exported hierarchy; pixels, which are no nodes, have nulls."""
    return hierarchy.select(*KEY, "h_id", "node_id").join(attributes, NODE, "left").drop("node_id")
