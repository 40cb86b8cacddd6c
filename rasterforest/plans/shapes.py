"""Holes of components, filled components, and the tree of shapes.

A component of the pixels at or above a level and the components of the pixels below it
that touch it are nodes of a tree and of its dual (opposite kind and connectivity). A
component lies in a hole of the component just outside it. That one is found from a single
pixel: the component's pixel nearest to the outside, and one step on from it. So holes are
links between nodes, and anything that adds up over pixels adds up over filled components
along these links, without writing out their pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import KEY, Scratch, begins, in_portions, settle, whole_groups
from .tiles import TILE_BITS
from .trees import NODE, Forest, climbed, finished, grown_together, nearest, picked, rolled, strides

#: Interpolations of the tree of shapes, with the adjacency radii of dark and bright components.
INTERPOLATIONS = {"self-dual": (1.0, 1.0), "min4-max8": (1.0, 1.5), "min8-max4": (1.5, 1.0)}


def nearest_pixels(forest: Forest, distance: Column) -> DataFrame:
    """key, node_id and near: distance, row and col of each component's pixel nearest to the outside."""
    own = forest.owners.groupBy(*NODE).agg(F.min(F.struct(distance.alias("distance"), "row", "col")).alias("near"))
    return rolled(forest.strides, own, True, near="min")


def hole_links(inner: Forest, outer: Forest, beside: DataFrame) -> DataFrame:
    """key, node_id (of outer), hole (a node of inner): the components in holes of each node, at the node's own level.

    beside: key, hole, row, col: a pixel just outside of each node of inner that has an outside.
    """
    sign = 1 if outer.kind == "max" else -1
    up = inner.nodes.select(*KEY, F.col("node_id").alias("parent_id"), F.col("level").alias("p_level"))
    held = inner.nodes.where("node_id <> parent_id").join(up, [*KEY, "parent_id"])
    held = held.select(*KEY, F.col("node_id").alias("hole"), (sign * F.col("level")).alias("low"), (sign * F.col("p_level")).alias("bound"))
    at = outer.owners.select(*KEY, "row", "col", "node_id")
    start = held.join(beside, [*KEY, "hole"]).join(at, [*KEY, "row", "col"]).select(*KEY, "hole", "low", "bound", "node_id")
    # Between the inner node's level and its parent's, the outside is the same pixel's component.
    marks = outer.nodes.select(*NODE, (sign * F.col("level")).alias("mark"))
    first = climbed(outer.strides, outer.nodes, start, ["hole"], marks, F.col("mark") <= F.col("bound"))
    out = first.join(held.select(*KEY, "hole", "low"), [*KEY, "hole"]).select(*KEY, "hole", "low", "node_id")
    levels = marks.select(*KEY, F.col("node_id").alias("beyond"), "mark")
    for table in outer.strides:
        step = table.select(*NODE, F.col("ancestor_id").alias("beyond"))
        out = out.join(step, NODE).join(levels, [*KEY, "beyond"]).where(F.col("mark") > F.col("low")).select(*KEY, "hole", "low", F.col("beyond").alias("node_id"))
    return out.select(*NODE, "hole")


def filled_sums(bright: Forest, dark: Forest, own: dict[int, DataFrame], names: list[str], beside: tuple[DataFrame, DataFrame], keep: Scratch) -> DataFrame:
    """key, tree (0: bright's nodes, 1: dark's), node_id and sums over each filled component.

    bright and dark are duals. own: by tree, sums over each node's own pixels; beside: for
    each tree's nodes, a pixel just outside. Sums of holes pass on to what surrounds them
    in as many rounds as holes lie within holes.
    """
    sums = {n: "sum" for n in names}
    part = lambda t, f: rolled(f.strides, own[t], True, **sums).select(*KEY, F.lit(t).alias("tree"), "node_id", *names)
    whole = keep.keep(part(0, bright).unionByName(part(1, dark)), "components")
    link = lambda t, o, i: hole_links(i, o, beside[1 - t]).select(*KEY, F.lit(t).alias("tree"), "node_id", F.lit(1 - t).alias("inner"), "hole")
    links = keep.keep(link(0, bright, dark).unionByName(link(1, dark, bright)), "holes")
    out, more = whole, whole
    while True:
        inner = more.select(*KEY, F.col("tree").alias("inner"), F.col("node_id").alias("hole"), *names)
        more = links.join(inner, [*KEY, "inner", "hole"]).groupBy(*KEY, "tree", "node_id").agg(*[F.sum(n).alias(n) for n in names])
        more = keep.keep(more, "filled")
        if more.isEmpty():
            return out.groupBy(*KEY, "tree", "node_id").agg(*[F.sum(n).alias(n) for n in names])
        out = out.unionByName(more)


def beside_holes(forest: Forest) -> DataFrame:
    """For holes in the plane: the pixel above the topmost one of each component off the image's border."""
    box = forest.owners.groupBy(*NODE).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    box = rolled(forest.strides, box, True, r0="min", r1="max", c0="min", c1="max")
    sides = forest.owners.groupBy(*KEY).agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"))
    off = box.join(sides, KEY).where("r0 > top AND r1 < bottom AND c0 > left AND c1 < right").select(*NODE)
    near = nearest_pixels(forest, F.col("row")).join(off, NODE)
    return near.select(*KEY, F.col("node_id").alias("hole"), (F.col("near.row") - 1).alias("row"), F.col("near.col").alias("col"))


def full_grids(pixels: DataFrame) -> None:
    """Fails where a raster isn't a full rectangle: its missing pixels would belong to neither tree."""
    n = pixels.groupBy(*KEY).agg(F.count("value").alias("n"), ((F.max("row") - F.min("row") + 1).cast("long") * (F.max("col") - F.min("col") + 1)).alias("area"))
    if odd := n.where("n <> area").take(1):
        raise ValueError(f"holes and shapes need every pixel of a raster; {odd[0]['image_id']} has {odd[0]['n']} of {odd[0]['area']}")


def filled_components(forest: Forest, sums: dict[str, Column]) -> DataFrame:
    """key, node_id and sums over the pixels of each node's component and its holes.

    sums: additive expressions on row and col. A hole is a component of the complement, of
    the dual connectivity, that doesn't reach the raster's border.
    """
    full_grids(forest.owners)
    keep, dual = Scratch(forest.owners.sparkSession, "filled"), forest.dual
    own = {t: f.owners.groupBy(*NODE).agg(*[c.alias(n) for n, c in sums.items()]) for t, f in enumerate((forest, dual))}
    out = filled_sums(forest, dual, own, list(sums), (beside_holes(forest), beside_holes(dual)), keep)
    out = settle(out.where("tree = 0").drop("tree"), "filled")
    keep.close()
    return out


def shapes_of(dark: Forest, bright: Forest, seed_row: int, seed_col: int, keep: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, Callable[[int], DataFrame]]:
    """Shapes of a pair of dual trees: components filled up as seen from the seed.

    classes: key, node_id (of the shape), parent_id, area. owners: key, pixel_id and
    node_id, the least shape around. named: key, tree (0: bright, 1: dark), node_id, the
    area of the filled component and its shape. Last, for a tree, what lies just outside
    of each component at its own level (key, node_id, up: a node of the dual).
    """
    forests = (bright, dark)
    away = F.abs(F.col("row") - seed_row) + F.abs(F.col("col") - seed_col)
    near = [keep.keep(nearest_pixels(f, away), "near") for f in forests]
    # One step on towards the seed; the component that holds the seed has no outside.
    row, col = F.col("near.row"), F.col("near.col")
    step = lambda x, s: x + F.signum(F.lit(s) - x).cast("int")
    out = [n.where("near.distance > 0").select(*KEY, F.col("node_id").alias("hole"), F.when(row != seed_row, step(row, seed_row)).otherwise(row).alias("row"), F.when(row != seed_row, col).otherwise(step(col, seed_col)).alias("col")) for n in near]
    beside = tuple(keep.keep(x, "beside") for x in out)
    own = {t: f.nodes.select(*NODE, F.col("proper_area").alias("area")) for t, f in enumerate(forests)}
    area = filled_sums(bright, dark, own, ["area"], beside, keep)
    size = bright.owners.groupBy(*KEY).agg(F.count(F.lit(1)).alias("all"))
    held = near[0].select(*KEY, F.lit(0).alias("tree"), "node_id", "near").unionByName(near[1].select(*KEY, F.lit(1).alias("tree"), "node_id", "near"))
    area = area.join(held.select(*KEY, "tree", "node_id", (F.col("near.distance") == 0).alias("seeded"), F.col("near").alias("tip")), [*KEY, "tree", "node_id"]).join(size, KEY)
    area = area.withColumn("area", F.when(F.col("seeded"), F.col("all")).otherwise(F.col("area")))
    # Shapes of one size with the same pixel nearest to the seed are one: shapes lie within one another or apart.
    tip = F.when(F.col("seeded"), "").otherwise(F.concat_ws(":", "tip.row", "tip.col"))
    area = keep.keep(area.select(*KEY, "tree", "node_id", "area", tip.alias("tip")), "areas")
    code = F.col("node_id") * 2 + F.col("tree")
    shape = area.groupBy(*KEY, "area", "tip").agg(F.min(code).alias("shape"))
    named = keep.keep(area.join(shape, [*KEY, "area", "tip"]).drop("tip"), "named")

    def outside(t: int, own: bool) -> DataFrame:
        """The dual component just outside of each component: at the component's own level, or the least one, up to its parent's level."""
        f, dual = forests[t], forests[1 - t]
        sign = 1 if f.kind == "max" else -1
        at = dual.owners.select(*KEY, "row", "col", "node_id")
        if own:
            levels = f.nodes.select(*KEY, F.col("node_id").alias("hole"), (sign * F.col("level")).alias("bound"))
        else:
            up = f.nodes.select(*KEY, F.col("node_id").alias("parent_id"), (sign * F.col("level")).alias("bound"))
            levels = f.nodes.join(up, [*KEY, "parent_id"]).select(*KEY, F.col("node_id").alias("hole"), "bound")
        start = beside[t].join(at, [*KEY, "row", "col"]).join(levels, [*KEY, "hole"]).select(*KEY, "hole", "bound", "node_id")
        marks = dual.nodes.select(*NODE, (sign * F.col("level")).alias("mark"))
        passes = F.col("mark") >= F.col("bound") if own else F.col("mark") > F.col("bound")
        over = climbed(dual.strides, dual.nodes, start, ["hole"], marks, passes)
        # The last dual component up to that level: the child, on the way, of the first beyond it.
        return below(dual, start, over).select(*KEY, F.col("hole").alias("node_id"), F.col("node_id").alias("up"))

    def around(t: int) -> DataFrame:
        """What strictly holds a component may be: its parent's shape, or that of the least dual component just outside."""
        f, last = forests[t], outside(t, False)
        return f.nodes.where("node_id <> parent_id").select(*NODE, F.lit(t).alias("tree"), F.lit(t).alias("to"), F.col("parent_id").alias("up")).unionByName(last.select(*NODE, F.lit(t).alias("tree"), F.lit(1 - t).alias("to"), "up"))

    def below(dual: Forest, start: DataFrame, over: DataFrame) -> DataFrame:
        """For each start, the highest ancestor under the one in over, or the root where none is."""
        marks = dual.nodes.select(*NODE, F.col("depth").alias("mark"))
        top = over.join(dual.nodes.select(*NODE, F.col("depth").alias("d")), NODE).select(*KEY, "hole", F.col("d").alias("limit"))
        bounded = start.join(top, [*KEY, "hole"], "left").select(*KEY, "hole", (F.coalesce("limit", F.lit(-1)) + 1).alias("bound"), "node_id")
        return climbed(dual.strides, dual.nodes, bounded, ["hole"], marks, F.col("mark") <= F.col("bound"))

    links = around(0).unionByName(around(1))
    ends = named.select(*KEY, F.col("tree").alias("to"), F.col("node_id").alias("up"), F.col("shape").alias("above"), F.col("area").alias("size"))
    links = links.join(named, [*KEY, "tree", "node_id"]).join(ends, [*KEY, "to", "up"]).where("above <> shape")
    parents = links.groupBy(*KEY, "shape").agg(F.min_by("above", "size").alias("above"))
    classes = named.groupBy(*KEY, "shape").agg(F.first("area").alias("area"))
    classes = classes.join(parents, [*KEY, "shape"], "left").select(*KEY, F.col("shape").alias("node_id"), F.coalesce("above", "shape").alias("parent_id"), "area")
    side = lambda t: named.where(F.col("tree") == t).select(*NODE, F.struct("area", "shape").alias(f"s{t}"))
    pixels = [f.owners.select(*KEY, "pixel_id", "node_id").join(side(t), NODE).drop("node_id") for t, f in enumerate(forests)]
    owners = pixels[0].join(pixels[1], [*KEY, "pixel_id"]).select(*KEY, "pixel_id", F.least("s0", "s1")["shape"].alias("node_id"))
    return keep.keep(classes, "shapes"), keep.keep(owners, "shape-owners"), named, lambda t: outside(t, True)


def enclosed(forests: tuple[Forest, Forest], named: DataFrame, outside: Callable[[int], DataFrame], keep: Scratch) -> DataFrame:
    """key, node_id of the shapes of four-connected components that lie within the opposite kind.

    Where two bright and two dark pixels meet across, the outer kind is connected there and
    the inner one isn't. A component belongs to the outer kind if its eight-connected
    component, filled up, is larger than what lies just outside of the four-connected one.
    """
    out = []
    for t, f in enumerate(forests):  # bright components have four neighbours in the first pair, dark ones in the second
        four = named.where((F.col("tree") == t) & (F.col("channel") % 2 == t))
        sizes = named.select(*KEY, F.col("tree").alias("to"), F.col("node_id").alias("up"), F.col("area").alias("out_area"))
        beyond = outside(t).withColumn("to", F.lit(1 - t)).join(sizes, [*KEY, "to", "up"]).select(*NODE, "out_area")
        eight = f.owners.where(F.col("channel") % 2 == 1 - t).select(*KEY, "node_id", "pixel_id")
        eight = eight.join(named.where(F.col("tree") == t).select(*NODE, F.col("area").alias("wide")), NODE)
        eight = eight.select("image_id", (F.col("channel") - (1 - t) + t).alias("channel"), F.col("pixel_id").alias("node_id"), "wide")
        out.append(four.join(beyond, NODE).join(eight, NODE).where("wide < out_area").select(*KEY, F.col("shape").alias("node_id")))
    return keep.keep(out[0].unionByName(out[1]).distinct(), "enclosed")


def kept_only(classes: DataFrame, kept: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """The tree of the kept shapes (key, node_id, parent_id), and for every shape the nearest kept one (holder) from itself up."""
    holder = keep.keep(nearest(strides(classes), kept), "holders")
    over = holder.select(*KEY, F.col("node_id").alias("parent_id"), F.col("holder").alias("up"))
    linked = classes.join(kept, NODE, "left_semi").join(over, [*KEY, "parent_id"], "left")
    up = F.when(F.col("node_id") == F.col("parent_id"), F.col("node_id")).otherwise(F.coalesce("up", "node_id"))
    return keep.keep(linked.select(*NODE, up.alias("up"), "area").withColumnRenamed("up", "parent_id"), "kept"), holder


def flooded(level: np.ndarray, start: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The self-dual tree of shapes of one raster of ranks: the node of each pixel (its least pixel) and each node's parent, as places in the raster.

    Between the pixels lie cells that may take any value in the span of those around. A flood
    from the start visits cells by the nearest value they can take; components joined
    in the opposite order are the shapes.
    """
    h, w = level.shape
    rows, cols = 2 * h + 1, 2 * w + 1  # with a rim, which is never visited
    low, high = np.empty((2 * h - 1, 2 * w - 1), dtype=np.int64), np.empty((2 * h - 1, 2 * w - 1), dtype=np.int64)
    for out, ends in ((low, np.minimum), (high, np.maximum)):
        out[::2, ::2] = level
        out[1::2, ::2] = ends(level[:-1], level[1:])
        out[:, 1::2] = ends(out[:, :-1:2], out[:, 2::2])
    lows, highs = (np.pad(x, 1).ravel().tolist() for x in (low, high))
    seen = np.pad(np.zeros(low.shape, dtype=bool), 1, constant_values=True).ravel().tolist()
    value, order = [0] * (rows * cols), []
    first = (2 * start[0] + 1) * cols + 2 * start[1] + 1
    at, above, below = lows[first], [(lows[first], first)], []
    seen[first] = True
    while above or below:
        if not below or above and above[0][0] - at <= at + below[0][0]:
            at, p = heappop(above)
        else:
            at, p = heappop(below)
            at = -at
        value[p] = at
        order.append(p)
        for q in (p - cols, p - 1, p + 1, p + cols):
            if not seen[q]:
                seen[q] = True
                x = min(max(at, lows[q]), highs[q])
                if x >= at:
                    heappush(above, (x, q))
                else:
                    heappush(below, (-x, q))
    up, root = [-1] * (rows * cols), [-1] * (rows * cols)
    for p in reversed(order):
        up[p] = root[p] = p
        for q in (p - cols, p - 1, p + 1, p + cols):
            if root[q] >= 0:
                while root[q] != q:
                    root[q] = q = root[root[q]]
                if q != p:
                    up[q] = root[q] = p
    # Cells of one component and value go by the first of them; shapes without pixels, or of the level around, go up.
    owns = set()
    for p in order:
        if value[up[up[p]]] == value[up[p]]:
            up[p] = up[up[p]]
        if p // cols % 2 and p % cols % 2:
            owns.add(p if value[up[p]] != value[p] else up[p])
    holder, over = {}, {}
    for p in order:
        q = up[p]
        if p == q:
            holder[p] = over[p] = p
        elif value[q] == value[p]:
            holder[p] = holder[q]
        else:
            top = holder[q]
            holder[p] = p if p in owns and value[top] != value[p] else top
            over[p] = top
    cells = [holder[p] for r in range(h) for p in range((2 * r + 1) * cols + 1, (2 * r + 2) * cols - 1, 2)]
    least: dict[int, int] = {}
    for i, c in enumerate(cells):
        least.setdefault(c, i)
    return np.array([least[c] for c in cells]), np.array([least[over[c]] for c in cells])


def small_shapes(pixels: DataFrame, seed_row: int, seed_col: int) -> Forest:
    """The self-dual trees of shapes of full rasters that a task can hold one after the other."""
    kind = dict(pixels.dtypes)["value"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pixels.select(*KEY).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, KEY):
            starts = np.append(np.flatnonzero(begins(part, KEY)), len(part))
            ids, r, c, value = (part[x].to_numpy() for x in ("pixel_id", "row", "col", "value"))
            node, parent, n = np.empty_like(ids), np.empty_like(ids), np.empty_like(ids)
            for lo, hi in zip(starts, starts[1:]):
                top, left, _, rank = r[lo:hi].min(), c[lo:hi].min(), *np.unique(value[lo:hi], return_inverse=True)
                place = (r[lo:hi] - top) * (c[lo:hi].max() - left + 1) + c[lo:hi] - left
                by = np.argsort(place)  # nodes go by their least pixel_id, pixels are sorted by it
                of, up = flooded(rank[by].reshape(r[lo:hi].max() - top + 1, -1), (seed_row - top, seed_col - left))
                own = np.full(hi - lo, hi - lo)
                np.minimum.at(own, of, by)
                node[lo + by], parent[lo + by] = ids[lo + own[of]], ids[lo + own[up]]
                n[lo:hi] = np.bincount(own[of], minlength=hi - lo)
            yield part.assign(node_id=node, parent_id=parent, n=n)

    px = in_portions(pixels.select(*KEY, "pixel_id", "row", "col", "value"), KEY).sortWithinPartitions(*KEY, "pixel_id")
    done = settle(px.mapInPandas(run, f"{fields}, pixel_id long, row int, col int, value {kind}, node_id long, parent_id long, n long"), "owners")
    nodes = done.where("node_id = pixel_id").select(*NODE, "parent_id", F.col("value").alias("level"), F.col("n").alias("proper_area"))
    return finished("shapes", 1.0, nodes, done.drop("parent_id", "n"))


def joined(one: Forest, other: Forest) -> Forest:
    """The trees of two forests of different rasters; a forest of fewer strides has none that long, so each node stays."""
    stay = lambda f: f.nodes.select(*NODE, F.col("node_id").alias("ancestor_id"), F.lit(0).alias("times"))
    steps = [[*f.strides, *[stay(f)] * (max(len(one.strides), len(other.strides)) - len(f.strides))] for f in (one, other)]
    return Forest(one.kind, one.radius, one.nodes.unionByName(other.nodes), one.owners.unionByName(other.owners), tuple(a.unionByName(b) for a, b in zip(*steps)))


def shape_tree(pixels: DataFrame, interpolation: str = "self-dual", seed_row: int = 0, seed_col: int = 0, tile_bits: int = TILE_BITS) -> Forest:
    """The tree of shapes: bright and dark components, filled up as seen from the seed pixel, by inclusion.

    interpolation: self-dual (the image between pixels takes the value, within the span of
    the pixels around, that a flood from the seed brings there: where kinds meet across, the
    outer one is connected), min4-max8 or min8-max4 (dark and bright components have those
    neighbours). A shape is a node where it owns pixels, that
    is, is the least shape around them; a shape of its parent's level is part of it. The
    seed's level is the root's. Fails for a seed outside of a raster and for rasters with
    missing pixels. Self-dual trees of rasters within a tile of 2**tile_bits rows and columns
    grow whole in a task, the others from component trees.
    """
    if interpolation not in INTERPOLATIONS:
        raise ValueError(f"interpolation must be one of {', '.join(INTERPOLATIONS)}, not {interpolation!r}")
    full_grids(pixels)
    sides = pixels.groupBy(*KEY).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    if odd := sides.where((F.col("r0") > seed_row) | (F.col("r1") < seed_row) | (F.col("c0") > seed_col) | (F.col("c1") < seed_col)).take(1):
        raise ValueError(f"the seed ({seed_row}, {seed_col}) lies outside of {odd[0]['image_id']}")
    if interpolation == "self-dual":
        large = sides.where((F.col("r1") - F.col("r0") >= 1 << tile_bits) | (F.col("c1") - F.col("c0") >= 1 << tile_bits)).select(*KEY)
        if large.isEmpty():
            return small_shapes(pixels, seed_row, seed_col)
        rest = sides.join(large, KEY, "left_anti").select(*KEY)
        if not rest.isEmpty():
            whole = small_shapes(pixels.join(rest, KEY, "left_semi"), seed_row, seed_col)
            return joined(whole, shape_tree(pixels.join(large, KEY, "left_semi"), interpolation, seed_row, seed_col, tile_bits))
    keep = Scratch(pixels.sparkSession, "shapes")
    px = pixels.select(*KEY, "pixel_id", "row", "col", "value")
    if interpolation == "self-dual":
        # Bright shapes from one complementary pair, dark ones from the other; both pairs share the jobs.
        grown = grown_together(px, [("max", 1.0), ("max", 1.5), ("min", 1.5), ("min", 1.0)])
        pair = picked(grown, 4, [0, 1], "max"), picked(grown, 4, [2, 3], "min")
        *found, named, outside = shapes_of(pair[1], pair[0], seed_row, seed_col, keep)
        found.append(enclosed(pair, named, outside, keep))
        one = lambda df, t: df.where(F.col("channel") % 2 == t).withColumn("channel", F.expr("channel div 2").cast("int"))
        nodes, owners = joined_shapes([tuple(one(df, t) for df in found) for t in range(2)], keep)
    else:
        dark, bright = INTERPOLATIONS[interpolation]
        grown = grown_together(px, [("max", bright), ("min", dark)])
        classes, owners, *_ = shapes_of(picked(grown, 2, [1], "min"), picked(grown, 2, [0], "max"), seed_row, seed_col, keep)
        nodes, _ = kept_only(classes, owners.select(*NODE).distinct(), keep)
    out = levelled(px, nodes, owners, keep)
    keep.close()
    return out


def joined_shapes(found: list[tuple[DataFrame, DataFrame, DataFrame]], keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """Nodes and owners of one tree from some shapes of two trees: each its classes, owners and the shapes that count.

    Shapes of both trees lie within one another or apart, so what holds a pixel is a chain
    by area. Equal shapes go by the first tree's name.
    """
    sides = []
    for i, (classes, owners, counts) in enumerate(found):
        own, holder = kept_only(classes, classes.where("node_id = parent_id").select(*NODE).unionByName(counts).distinct(), keep)
        least = owners.join(holder, NODE).select(*KEY, "pixel_id", F.col("holder").alias("node_id")).join(own.select(*NODE, "area"), NODE)
        sides.append((own, keep.keep(least.select(*KEY, "pixel_id", F.col("node_id").alias(f"n{i}"), F.col("area").alias(f"a{i}")), "least")))
    both = sides[0][1].join(sides[1][1], [*KEY, "pixel_id"])
    first = F.col("a0") <= F.col("a1")
    name = lambda i, node: F.struct(F.lit(i).alias("tree"), F.col(node).alias("of"))
    pixels = keep.keep(both.select(*KEY, "pixel_id", F.when(first, name(0, "n0")).otherwise(name(1, "n1")).alias("s"), F.least("a0", "a1").alias("area"), "n0", "n1"), "pixels")
    code = F.col("s.of") * 2 + F.col("s.tree")
    # One pixel stands for each shape; the next larger shape around it in either tree may be its parent.
    stands = keep.keep(pixels.groupBy(*KEY, code.alias("shape")).agg(F.min_by(F.struct("n0", "n1", "area"), "pixel_id").alias("p")), "stands")
    over = []
    for i, (own, _) in enumerate(sides):
        owning = pixels.where(F.col("s.tree") == i).select(*KEY, F.col("s.of").alias("node_id")).distinct()
        roots = own.where("node_id = parent_id").select(*NODE)
        tree, holder = kept_only(own, owning.unionByName(roots).distinct(), keep)
        start = stands.select(*KEY, "shape", F.col(f"p.n{i}").alias("node_id"), F.col("p.area").alias("bound")).join(holder, NODE)
        start = start.select(*KEY, "shape", "bound", F.col("holder").alias("node_id"))
        up = climbed(strides(tree), tree, start, ["shape"], tree.select(*NODE, F.col("area").alias("mark")), F.col("mark") > F.col("bound"))
        over.append(up.join(tree.select(*NODE, "area"), NODE).join(owning.withColumn("owns", F.lit(True)), NODE, "left").where("owns").select(*KEY, "shape", F.struct("area", F.lit(i).alias("tree"), F.col("node_id").alias("of")).alias("up")))
    parent = over[0].unionByName(over[1]).groupBy(*KEY, "shape").agg(F.min("up").alias("up"))
    nodes = stands.join(parent, [*KEY, "shape"], "left").select(*KEY, F.col("shape").alias("node_id"), F.coalesce(F.col("up.of") * 2 + F.col("up.tree"), F.col("shape")).alias("parent_id"), F.col("p.area").alias("area"))
    return keep.keep(nodes, "nodes"), pixels.select(*KEY, "pixel_id", code.alias("node_id"))


def levelled(pixels: DataFrame, nodes: DataFrame, owners: DataFrame, keep: Scratch) -> Forest:
    """The forest of shapes: nodes go by their least pixel, and those of their parent's level join it."""
    own = keep.keep(pixels.join(owners, [*KEY, "pixel_id"]), "own")
    level = keep.keep(own.groupBy(*NODE).agg(F.first("value").alias("level")), "levels")
    up = level.select(*KEY, F.col("node_id").alias("parent_id"), F.col("level").alias("p_level"))
    tops = nodes.join(level, NODE).join(up, [*KEY, "parent_id"]).where("node_id = parent_id OR level <> p_level").select(*NODE)
    tree, holder = kept_only(nodes, tops, keep)
    owned = keep.keep(own.join(holder, NODE).drop("node_id").withColumnRenamed("holder", "node_id"), "owned")
    least = keep.keep(owned.groupBy(*NODE).agg(F.min("pixel_id").alias("least"), F.first("value").alias("level"), F.count(F.lit(1)).alias("proper_area")), "least")
    named = least.select(*KEY, F.col("node_id").alias("parent_id"), F.col("least").alias("parent"))
    done = tree.select(*NODE, "parent_id").join(least, NODE).join(named, [*KEY, "parent_id"])
    done = keep.keep(done.select(*KEY, F.col("least").alias("node_id"), F.col("parent").alias("parent_id"), "level", "proper_area"), "done")
    final = owned.join(least.select(*NODE, "least"), NODE).select(*KEY, "pixel_id", "row", "col", "value", F.col("least").alias("node_id"))
    return finished("shapes", 1.0, done, settle(final, "owners"))
