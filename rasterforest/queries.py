"""Registered queries of the raster engine over the given tables, and their SQL.

Raster E: events by type, hour of day and user; raster L: line items by return flag,
quantity and discount; raster V: each embedding as 8 by 8 values. Values have 16 levels.
Raster U: events by user and hour, one image that grows with the table; its values are numbers,
cells without events are left out, as users times hours may be far more than events.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import attributes, datasets, entries, filters, metrics, patches, preparation, scoring, stats, trees
from .plans.components import components
from .plans.trees import Forest, build, neighbours
from .sources import quantize, rasterize, rasterize_cells
from .tables import KEY, settle, shared_dir

NODE = trees.NODE
BUILT: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark: SparkSession, key: tuple, make: Callable[[], object]) -> object:
    """Built once per session: rasters and trees are shared by many queries."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in BUILT:
        BUILT[key] = make()
    return BUILT[key]


def user_hours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int, int]:
    """Users and hours of the events, the sides of their grid and its first hour."""
    df = table(spark, sf_dir, "events").where("user_id >= 0").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hour"))
    size = once(spark, (sf_dir, "size", "U"), lambda: df.agg(F.max("user_id").alias("users"), F.min("hour").alias("first"), F.max("hour").alias("last")).first())
    return (df, 1, 1, 0) if None in size else (df, size["users"] + 1, size["last"] - size["first"] + 1, size["first"])


def raster(spark: SparkSession, sf_dir: str, name: str = "E") -> DataFrame:
    def make() -> DataFrame:
        if name == "E":
            df = table(spark, sf_dir, "events").where("user_id >= 0")
            hour = F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000), F.lit(24))
            if dict(df.dtypes)["ts"] == "timestamp_ntz":
                hour = F.hour("ts")
            return quantize(rasterize(df, F.col("event_type"), hour, F.col("user_id") % 32, 24, 32))
        if name == "L":
            df = table(spark, sf_dir, "lineitem")
            return quantize(rasterize(df, F.col("l_returnflag"), F.col("l_quantity").cast("int") % 32, F.round(F.col("l_discount") * 100).cast("int"), 32, 11))
        if name == "U":
            df, n_rows, n_cols, first = user_hours(spark, sf_dir)
            return rasterize_cells(df, F.lit("events"), F.col("user_id"), F.col("hour") - F.lit(first), n_rows, n_cols)
        v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), F.col("embedding").cast("array<double>").alias("e")).where("size(e) = 64")
        v = v.select("image_id", F.array_min("e").alias("lo"), F.array_max("e").alias("hi"), F.posexplode("e").alias("at", "x"))
        value = F.when(F.col("hi") > F.col("lo"), F.floor(15 * (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")))).otherwise(0).cast("int")
        return v.select("image_id", F.lit(0).alias("channel"), F.floor(F.col("at") / 8).cast("int").alias("row"), (F.col("at") % 8).alias("col"), F.col("at").cast("long").alias("pixel_id"), value.alias("value"))

    return once(spark, (sf_dir, "raster", name), lambda: settle(make(), f"raster-{name}"))


def forest(spark: SparkSession, sf_dir: str, kind: str = "max", radius: float = 1.5, name: str = "E") -> Forest:
    return once(spark, (sf_dir, kind, radius, name), lambda: build(raster(spark, sf_dir, name), kind, radius))


def shapes(spark: SparkSession, sf_dir: str) -> Forest:
    return once(spark, (sf_dir, "shapes", "V"), lambda: trees.tree_of_shapes(raster(spark, sf_dir, "V")))


def r6(df: DataFrame, *names: str) -> DataFrame:
    # + 0.0 turns a negative zero into zero.
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


BASICS = ["AREA", "GRAY_LEVEL", "VOLUME", "MEAN_GRAY_LEVEL", "GRAY_LEVEL_VARIANCE", "GRAY_LEVEL_HEIGHT", "BOUNDING_BOX_WIDTH", "BOUNDING_BOX_HEIGHT", "DIAGONAL_LENGTH", "RECTANGULARITY", "RATIO_WH", "BOX_COLUMN_MIN", "BOX_COLUMN_MAX", "BOX_ROW_MIN", "BOX_ROW_MAX"]
MOMENTS = ["CENTRAL_MOMENT_20", "CENTRAL_MOMENT_02", "CENTRAL_MOMENT_11", "HU_MOMENT_1", "INERTIA", "COMPACTNESS", "RAW_INERTIA"]
SIDES = ["CONTOUR_PIXELS", "CONTOUR_PERIMETER", "CONTOUR_SIDE_NORTH", "CONTOUR_SIDE_WEST", "CONTOUR_SIDE_EAST", "CONTOUR_SIDE_SOUTH"]
SHAPES = ["CENTRAL_MOMENT_30", "CENTRAL_MOMENT_03", "CENTRAL_MOMENT_21", "CENTRAL_MOMENT_12", "HU_MOMENT_2", "LENGTH_MAJOR_AXIS", "LENGTH_MINOR_AXIS", "RELATIVE_VOLUME"]
QUADS = ["BITQUAD_AREA", "BITQUAD_NUMBER_EULER", "BITQUAD_NUMBER_HOLES", "BITQUAD_PERIMETER", "BITQUAD_PERIMETER_CONTINUOUS", "BITQUAD_CIRCULARITY", "BITQUAD_PERIMETER_AVERAGE", "BITQUAD_LENGTH_AVERAGE", "BITQUAD_WIDTH_AVERAGE"]
AXES = ["AXIS_ORIENTATION", "ECCENTRICITY", "CIRCULARITY", "HU_MOMENT_3", "HU_MOMENT_4", "HU_MOMENT_5", "HU_MOMENT_6", "HU_MOMENT_7"]
WEIGHTED = ["DIST_MODE", "DIST_WEIGHTED_CENTROID_ROW", "DIST_WEIGHTED_CENTROID_COLUMN", "DIST_WEIGHTED_CENTRAL_MOMENT_20", "DIST_WEIGHTED_CENTRAL_MOMENT_02", "DIST_WEIGHTED_CENTRAL_MOMENT_11"]
FILLED = ["FILLED_AREA", "FILLED_CENTROID_ROW", "FILLED_CENTROID_COLUMN", "FILLED_LENGTH_MAJOR_AXIS", "FILLED_LENGTH_MINOR_AXIS", "FILLED_AXIS_ORIENTATION", "FILLED_ECCENTRICITY", "FILLED_INERTIA", "HOLE_AREA_FRACTION", "FILLED_CENTROID_DISPLACEMENT_NORMALIZED", "FILLED_COMPACTNESS", "FILLED_CIRCULARITY", "FILLED_AXIS_ORIENTATION_SIGNED"]
BRANCHES = ["NUM_SIBLINGS_NODE", "NUM_LEAF_DESCENDANTS_NODE", "LEAF_RATIO_NODE", "BALANCE_NODE", "AVG_CHILD_HEIGHT_NODE"]
DISTANCES = ["MAX_DIST", "MAX_SQUARED_DIST", "DIST_SQUARED_SUM", "DIST_SQUARED_MEAN", "DIST_RMS", "DIST_SQUARED_VARIANCE", "MAX_DIST_CENTER_ROW", "MAX_DIST_CENTER_COLUMN", "MAX_DIST_PLATEAU_AREA", "MAX_DIST_PLATEAU_CENTROID_ROW", "MAX_DIST_PLATEAU_CENTROID_COLUMN", "DIST_SUM", "DIST_MEAN", "DIST_VARIANCE", "DIST_MEDIAN", "DIST_Q25", "DIST_Q75", "DIST_Q90", "DIST_ENTROPY", "DIST_POSITIVE_AREA", "DIST_LEVEL_COUNT"]
TOPOLOGY = ["DEPTH_NODE", "IS_LEAF_NODE", "IS_ROOT_NODE", "NUM_CHILDREN_NODE", "NUM_DESCENDANTS_NODE", "SUBTREE_HEIGHT"]


def _nodes(kind: str, radius: float = 1.5, name: str = "E") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = forest(spark, sf_dir, kind, radius, name).nodes
        return n.select("image_id", "node_id", "parent_id", F.col("level").cast("long").alias("level"), F.col("residue").cast("long").alias("residue"), F.col("proper_area").cast("long").alias("proper_area"), F.col("depth").cast("long").alias("depth"))

    return run


def user_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The max-tree of raster U: trees of the cells with events, under the cells without as the root."""
    nodes, cells = _nodes("max", 1.5, "U")(spark, sf_dir), raster(spark, sf_dir, "U").select("pixel_id")
    _, n_rows, n_cols, _ = user_hours(spark, sf_dir)
    n = cells.count()
    if n in (0, n_rows * n_cols):
        return nodes
    # The least pixel that is no cell is the first one, or comes right after a cell.
    free = cells.select((F.col("pixel_id") + 1).alias("pixel_id")).unionByName(spark.range(1).withColumnRenamed("id", "pixel_id"))
    root = free.join(cells, "pixel_id", "left_anti").agg(F.min("pixel_id")).first()[0]
    at = F.lit(root).cast("long")
    ground = {"node_id": at, "parent_id": at, "level": F.lit(0), "residue": F.lit(0), "proper_area": F.lit(n_rows * n_cols - n), "depth": F.lit(0)}
    under = F.when(F.col("node_id") == F.col("parent_id"), at).otherwise(F.col("parent_id"))
    nodes = nodes.withColumns({"parent_id": under, "depth": F.col("depth") + 1})
    return nodes.unionByName(spark.range(1).select(F.lit("events").alias("image_id"), *[v.cast("long").alias(c) for c, v in ground.items()]))


def shape_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = shapes(spark, sf_dir)
    n = f.nodes.join(filters.area_of(f).withColumnRenamed("area", "n"), NODE)
    return n.select("image_id", "node_id", "parent_id", *[F.col(c).cast("long").alias(c) for c in ("level", "residue", "proper_area")], F.col("n").cast("long").alias("area"))


def grain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of fewer than 4 pixels removed, bright and dark alike."""
    f = shapes(spark, sf_dir)
    out = filters.pruning_min(f, filters.area_of(f), F.col("area") >= 4)
    return out.select("image_id", "pixel_id", F.col("value").cast("long").alias("value"))


def _attributes(names: list[str], radius: float = 1.5) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return r6(attributes.compute(forest(spark, sf_dir, "max", radius), names), *names).select("image_id", "node_id", *names)

    return run


def _marks(spark: SparkSession, sf_dir: str) -> tuple[Forest, DataFrame]:
    f = forest(spark, sf_dir)
    return f, once(spark, (sf_dir, "basics"), lambda: settle(attributes.compute(f, ["AREA", "GRAY_LEVEL", "BOUNDING_BOX_WIDTH"]), "basics"))


def _filter(apply: Callable[[Forest, DataFrame, Column], DataFrame], keep: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f, marks = _marks(spark, sf_dir)
        return apply(f, marks, F.expr(keep)).select("image_id", "pixel_id", F.col("value").cast("long").alias("value"))

    return run


AREA4, WIDE = "AREA >= 4", "BOUNDING_BOX_WIDTH >= 3"
SPECS = [scoring.Spec("size", ("AREA", "GRAY_LEVEL"), (0.02, -0.1), 0.5, 2.0), scoring.soft_threshold("level", "GRAY_LEVEL", 5.0, 0.7)]
MODES = ("minmax01", "zscore", "clipped_zscore01")


def soft_subtractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, marks = _marks(spark, sf_dir)
    score = marks.select(*NODE, (F.col("AREA") / (F.col("AREA") + 8)).alias("score"))
    return r6(filters.soft_subtractive(f, score), "value").select("image_id", "pixel_id", "value")


def area_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forest(spark, sf_dir, "min")
    out = filters.pruning_min(f, filters.area_of(f), F.col("area") >= 4)
    return out.select("image_id", "pixel_id", F.col("value").cast("long").alias("value"))


def extinction(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, marks = _marks(spark, sf_dir)
    e = filters.extinction_values(f, marks.select(*NODE, F.col("AREA").alias("value")))
    return e.select("image_id", "node_id", F.when(F.col("extinction") == float("inf"), -1.0).otherwise(F.col("extinction")).cast("long").alias("extinction"))


def extinction_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, marks = _marks(spark, sf_dir)
    out = filters.filter_extinction(f, marks.select(*NODE, F.col("AREA").alias("value")), top_k=3)
    return out.select("image_id", "pixel_id", F.col("value").cast("long").alias("value"))


def attribute_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, marks = _marks(spark, sf_dir)
    return r6(stats.fit_stats(marks, ["AREA", "GRAY_LEVEL"]), "sum", "sumsq", "amin", "amax")


def _normalized(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, marks = _marks(spark, sf_dir)
        out = stats.normalize(marks, ["AREA", "GRAY_LEVEL"], stats.fit_stats(marks, ["AREA", "GRAY_LEVEL"]), ["image_id", "node_id"], mode)
        return r6(out, "AREA", "GRAY_LEVEL").select("image_id", "node_id", F.col("AREA").alias("area"), F.col("GRAY_LEVEL").alias("gray_level"))

    return run


def apply_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, marks = _marks(spark, sf_dir)
    return r6(scoring.apply_specs(f, marks, SPECS), "value").select("image_id", "channel", "pixel_id", "value")


def edge_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, marks = _marks(spark, sf_dir)
    return r6(scoring.edge_penalty(scoring.node_scores(f, marks, SPECS[:1]), 2.0), "penalty").select("image_id", "penalty")


def path_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, marks = _marks(spark, sf_dir)
    return r6(scoring.path_penalty(scoring.node_scores(f, marks, SPECS[:1]), trees.ancestors_of(f, f.nodes, 2), 2.0, 2), "penalty").select("image_id", "penalty")


def flat_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = raster(spark, sf_dir, "L")
    value = px.select(*KEY, F.col("pixel_id").alias("u"), F.col("value").alias("a"))
    e = neighbours(px, 1).join(value, [*KEY, "u"]).join(value.withColumnRenamed("u", "v").withColumnRenamed("a", "b"), [*KEY, "v"]).where("a = b")
    zone = px.join(components(e, KEY).withColumnRenamed("vid", "pixel_id"), [*KEY, "pixel_id"], "left")
    zone = zone.groupBy("image_id", F.coalesce("label", "pixel_id").alias("zone_id")).agg(F.count(F.lit(1)).alias("area"), F.first("value").cast("long").alias("value"))
    return zone


def _images(px: DataFrame) -> DataFrame:
    return px.groupBy(*KEY).agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))


def patch_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = raster(spark, sf_dir)
    got = patches.extract_patches(px, patches.patch_grid(_images(px), 8, 6), 8, 2)
    return got.groupBy("image_id", "patch_row", "patch_col").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"), F.sum(F.when(F.col("is_core"), F.col("value")).otherwise(0)).alias("core_total"))


def patch_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = raster(spark, sf_dir)
    got = patches.extract_patches(px, patches.patch_grid(_images(px), 8, 6), 8, 2)
    return patches.reassemble_mean(got).select("image_id", "row", "col", "value")


def patch_overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = raster(spark, sf_dir)
    images = _images(px)
    return patches.overlap_add(patches.extract_patches(px, patches.patch_grid(images, 8, 6), 8, 2), images).select("image_id", "row", "col", "value")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels against a score from the length: 100 characters are 0.5."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    y = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("label"))
    return d.join(y, "doc_id").withColumn("score", F.round(F.col("n_chars") / (F.col("n_chars") + 1000.0), 3))


def confusion_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.rates(metrics.confusion(predictions(spark, sf_dir), 0.6, ["lang"]))
    return r6(r, "accuracy", "precision", "recall", "specificity", "f1", "jaccard", "kappa", "mcc")


def auc_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.auc(predictions(spark, sf_dir), ["lang"]), "auc").where("auc IS NOT NULL")


def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.roc_curve(predictions(spark, sf_dir)), "fpr", "tpr")


def grid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.metrics_on_grid(predictions(spark, sf_dir), [0.2, 0.4, 0.6, 0.8]), "iou", "f1", "foreground")


def split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole nations of customers dealt to three splits: sizes by split."""
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_nationkey").cast("string").alias("group_id"))
    n = g.select("group_id").distinct().count()
    s = datasets.split_by_group(g, {"test": n // 5, "train": n - 2 * (n // 5), "val": n // 5}, seed=7)
    return s.groupBy("split").agg(F.count_distinct("group_id").alias("n_groups"), F.count(F.lit(1)).alias("n_samples"))


def test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all orders drawn for the test split."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return datasets.train_test_split(orders, 0.1, "o_orderkey", seed=5).where("split = 'test'").select("o_orderkey")


def order_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far scores fall along the order of areas."""
    f, marks = _marks(spark, sf_dir)
    scores = scoring.node_scores(f, marks, SPECS[1:]).join(marks.select(*NODE, "AREA"), NODE)
    return r6(scoring.order_penalty(scores, "AREA", 2.0), "penalty").select("image_id", "penalty")


def crossing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as splits of orders: customers, as groups, that cross them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderpriority").alias("split"), F.col("o_custkey").cast("string").alias("group_id"))
    v = datasets.validate_splits(o.select("sample_id"), o.select("sample_id", "split"), o.select("sample_id", "group_id"))
    return v.select("issue", "id")


def price_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = datasets.distribution(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    return r6(d, "median", "low", "high", "mad")


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.pixel_digest(raster(spark, sf_dir, "V")).select("image_id", "sha256")


def all_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.compute(forest(spark, sf_dir), ["MOMENTS", "BOUNDARY", "TREE_TOPOLOGY"]).drop("channel")


def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forest(spark, sf_dir)
    return trees.tree_intervals(f).join(trees.walk(f, "post"), NODE).select("image_id", "node_id", "tpre", "tpost", "position")


def tree_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = trees.relatives(forest(spark, sf_dir))
    return r.select("image_id", "node_id", "num_children", "num_siblings", "first_child", "next_sibling", "is_root", "is_leaf")


def tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = trees.tree_summary(forest(spark, sf_dir))
    return s.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("root", "num_nodes", "num_leaf_nodes", "num_pixels", "num_rows", "num_columns")])


def reconstructed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trees.reconstruct_levels(forest(spark, sf_dir))
    return out.select("image_id", "pixel_id", F.col("value").cast("long").alias("value"))


def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.pr_curve(predictions(spark, sf_dir)), "precision", "recall", "f1")


def mean_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.per_image(predictions(spark, sf_dir), ["lang"], 0.6)
    return r6(out, *out.columns)


def prediction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.errors(predictions(spark, sf_dir), [("score", "label")])
    return r6(out, *out.columns)


def prediction_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.losses(predictions(spark, sf_dir), ["lang"], 2.0, 0.25)
    return r6(out, *out.columns)


def price_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as runs: mean and deviation by priority and status."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", F.col("o_custkey").alias("run_id"), (F.col("o_totalprice") / 1e5).alias("value"))
    out = metrics.consolidate(rows, ["o_orderpriority", "o_orderstatus"])
    return r6(out, "mean", "std").select("o_orderpriority", "o_orderstatus", "n", "mean", "std")


def pixels_out(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return raster(spark, sf_dir, name).select("image_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "pixel_id", F.col("value").cast("long").alias("value"))

    return run


def _largest(spark: SparkSession, sf_dir: str, top: int = 1) -> tuple[Forest, DataFrame]:
    """Each raster's largest nodes below the root."""
    f, marks = _marks(spark, sf_dir)
    inner = f.nodes.where("node_id <> parent_id").select(*NODE)
    return f, trees.find_nodes(f, marks.join(inner, NODE, "left_semi"), by="AREA", top=top)


def found_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _largest(spark, sf_dir, 3)[1].select("image_id", "node_id", F.col("AREA").alias("area"), "rank")


def subtree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breadth-first walk of the subtree below each raster's largest node but the root."""
    f, top = _largest(spark, sf_dir)
    return trees.walk(f, "breadth", top).select("image_id", "of_node", "node_id", "position")


def node_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, top = _largest(spark, sf_dir)
    return trees.reconstruct_node(f, top).select("image_id", "of_node", "pixel_id", F.col("value").cast("long").alias("value"))


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path between the first and the last node of each raster."""
    f = forest(spark, sf_dir)
    ends = f.nodes.groupBy(*KEY).agg(F.min("node_id").alias("a"), F.max("node_id").alias("b"))
    return trees.path_between(f, ends).select("image_id", F.col("position").cast("long").alias("position"), "node_id")


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported hierarchy with the nodes' areas under its ids."""
    f, marks = _marks(spark, sf_dir)
    h = trees.export_hierarchy(f)
    area = trees.project_attributes(h, marks.select(*NODE, F.col("AREA").alias("area")))
    return h.join(area, [*KEY, "h_id"]).select("image_id", F.col("h_id").cast("long").alias("h_id"), F.col("parent").cast("long").alias("parent"), "altitude", "area")


def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forest(spark, sf_dir)
    out = trees.reconstruct_levels(trees.merge_into_parent(f, f.nodes.where("node_id % 2 = 1")))
    return out.select("image_id", "pixel_id", F.col("value").cast("long").alias("value"))


def pruned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forest(spark, sf_dir)
    out = trees.reconstruct_levels(trees.prune_nodes(f, f.nodes.where("node_id % 5 = 1")))
    return out.select("image_id", "pixel_id", F.col("value").cast("long").alias("value"))


def prepared_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of both trees over all rasters but the last, which is left for evaluation."""
    px = raster(spark, sf_dir)
    last = px.agg(F.max("image_id").alias("last"))
    train = px.select("image_id").distinct().join(last, F.col("image_id") != F.col("last")).select("image_id")
    done = preparation.prepare(px, ["max", "min"], ["AREA", "GRAY_LEVEL"], train)
    return r6(done.stats, "sum", "sumsq", "amin", "amax")


def prepared_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all vectors' rasters in a new store, prepared twice: rasters, entries built the first and the second time, and the statistics from the store."""
    path, px = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", raster(spark, sf_dir, "V")
    first = settle(entries.prepare_entries(px, ["max", "min"], ["AREA"], path), "first")
    again = entries.prepare_entries(px, ["max", "min"], ["AREA"], path)
    s = entries.entry_stats(first, path).select(F.split("stat_key", "::")[0].alias("tree_key"), F.col("count").alias("nodes"), F.col("sum").cast("long").alias("area"))
    n = first.groupBy("tree_key").agg(F.count(F.lit(1)).alias("rasters"), F.count_distinct(F.when(F.col("built"), F.col("entry_key"))).alias("built"))
    return n.join(again.groupBy("tree_key").agg(F.count_if("built").alias("built_again")), "tree_key").join(s, "tree_key")


def _manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as samples, their customers as entries: ready where the balance isn't negative; some nations have none."""
    orders = table(spark, sf_dir, "orders")
    samples = orders.select((F.col("o_orderkey")).alias("position"), F.concat(F.lit("order-"), "o_orderkey").alias("sample_id"))
    contributions = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("entry_key"))
    entries = table(spark, sf_dir, "customer").where("c_nationkey > 4")
    state = F.when(F.col("c_acctbal") >= 0, "ready").otherwise("failed")
    return samples, contributions, entries.select(F.col("c_custkey").alias("entry_key"), state.alias("state"), F.length("c_name").cast("long").alias("size_bytes"))


def manifest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.inspect_manifest(*_manifest(spark, sf_dir))[0].select("state", "n", "bytes")


def manifest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.inspect_manifest(*_manifest(spark, sf_dir))[1]


def cache_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of issues by scope and kind; every fifth sample of the source has another name."""
    samples, contributions, entries = _manifest(spark, sf_dir)
    name = F.when(F.col("position") % 5 == 0, F.concat("sample_id", F.lit("-b"))).otherwise(F.col("sample_id"))
    payload = entries.where("size_bytes > 0 AND entry_key % 3 > 0")
    found = datasets.inspect_dataset_cache(samples, contributions, entries, payload, samples.select("position", name.alias("sample_id")))
    return found.groupBy("scope", "issue").agg(F.count(F.lit(1)).alias("n"))


def missing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, contributions, entries = _manifest(spark, sf_dir)
    return datasets.prepare_missing(contributions, entries)


def entry_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.size_estimate(_manifest(spark, sf_dir)[2], 10, 1_000_000_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rasterize_events": pixels_out("E"),
    "rasterize_lineitem": pixels_out("L"),
    "rasterize_embeddings": pixels_out("V"),
    "flat_zones": flat_zones,
    "max_tree_nodes": _nodes("max"),
    "max_tree_nodes_4": _nodes("max", 1.0),
    "min_tree_nodes": _nodes("min"),
    "vector_tree_nodes": _nodes("max", 1.5, "V"),
    "user_tree_nodes": user_tree_nodes,
    "shape_tree_nodes": shape_tree_nodes,
    "grain_filter": grain_filter,
    "attributes_filled": _attributes(FILLED),
    "attributes_quads": _attributes(QUADS),
    "attributes_quads_4": _attributes(QUADS, 1.0),
    "attributes_axes": _attributes(AXES),
    "attributes_weighted": _attributes(WEIGHTED),
    "attributes_basic": _attributes(BASICS),
    "attributes_moments": _attributes(MOMENTS),
    "attributes_contour": _attributes(SIDES),
    "attributes_topology": _attributes(TOPOLOGY),
    "attributes_shape": _attributes(SHAPES),
    "attributes_branches": _attributes(BRANCHES),
    "attributes_distance": _attributes(DISTANCES),
    "attributes_distance_exact": _attributes([f"{n}_EXACT" for n in DISTANCES]),
    "tree_relatives": tree_relatives,
    "tree_summary": tree_summary,
    "reconstructed_levels": reconstructed_levels,
    "pr_curve": pr_curve,
    "mean_by_lang": mean_by_lang,
    "prediction_errors": prediction_errors,
    "prediction_losses": prediction_losses,
    "price_by_priority": price_by_priority,
    "attributes_all": all_attributes,
    "tree_walk": tree_walk,
    "area_opening": _filter(filters.pruning_min, AREA4),
    "area_closing": area_closing,
    "pruning_max_width": _filter(filters.pruning_max, WIDE),
    "direct_width": _filter(filters.direct, WIDE),
    "subtractive_width": _filter(filters.subtractive, WIDE),
    "soft_subtractive": soft_subtractive,
    "extinction_values": extinction,
    "extinction_top3": extinction_top3,
    "attribute_stats": attribute_stats,
    **{f"normalize_{m}": _normalized(m) for m in MODES},
    "apply_specs": apply_specs,
    "edge_penalty": edge_penalty,
    "path_penalty": path_penalty,
    "patch_sums": patch_sums,
    "patch_round_trip": patch_round_trip,
    "patch_overlap_add": patch_overlap_add,
    "confusion_by_lang": confusion_by_lang,
    "auc_by_lang": auc_by_lang,
    "roc_curve": roc_curve,
    "grid_metrics": grid_metrics,
    "split_groups": split_groups,
    "crossing_groups": crossing_groups,
    "test_split": test_split,
    "order_penalty": order_penalty,
    "price_distribution": price_distribution,
    "pixel_digests": digests,
    "found_nodes": found_nodes,
    "subtree_walk": subtree_walk,
    "node_masks": node_masks,
    "tree_paths": tree_paths,
    "hierarchy": hierarchy,
    "merged_nodes": merged_nodes,
    "pruned_nodes": pruned_nodes,
    "prepared_stats": prepared_stats,
    "prepared_entries": prepared_entries,
    "manifest_states": manifest_states,
    "manifest_missing": manifest_missing,
    "cache_issues": cache_issues,
    "missing_entries": missing_entries,
    "entry_size_estimate": entry_size_estimate,
}
