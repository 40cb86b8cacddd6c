"""Trees, attributes, filters, statistics, scoring, patches and metrics on small rasters."""

import hashlib
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterforest import queries
from rasterforest.operators import attributes, datasets, filters, metrics, patches, preparation, scoring, stats, trees
from rasterforest.plans.components import components
from rasterforest.plans.trees import STRIDE, ancestors, climbed, nearest, rolled, strides
from rasterforest.sources import binarize, check_same_shape, invert, rasterize, resize_area, resize_nearest, to_u8, validate_intensity
from rasterforest.streaming import read_stats, stream_stats

PIXELS = "image_id string, channel int, row int, col int, pixel_id long, value int"
SQUARE = np.zeros((7, 7), int)
SQUARE[1:6, 1:6] = 200
HOLE = SQUARE.copy()
HOLE[2, 2] = 0
IMAGES = {
    "random": np.random.default_rng(0).integers(0, 6, (7, 8)),
    "square": SQUARE,
    "hole": HOLE,
    "box": np.pad(np.full((3, 5), 200), 1),
    "root_mean": np.array([[10, 30], [10, 50]]),
    "const": np.full((2, 3), 7),
    "line": np.array([[1, 2, 3, 4]]),
}


def rows_of(images):
    return [(k, 0, r, c, r * im.shape[1] + c, int(im[r, c])) for k, im in images.items() for r in range(im.shape[0]) for c in range(im.shape[1])]


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.createDataFrame(rows_of(IMAGES), PIXELS).cache()


@pytest.fixture(scope="module")
def forest(pixels):
    return trees.max_tree(pixels)


@pytest.fixture(scope="module")
def table(forest):
    return attributes.compute(forest, "ALL").toPandas()


def flood(image, radius):
    """Every node's level, own least pixel and support, by flooding each level set."""
    steps = [(r, c) for r in (-2, -1, 0, 1, 2) for c in (-2, -1, 0, 1, 2) if (r, c) != (0, 0) and r * r + c * c <= radius * radius]
    h, w = image.shape
    out = {}
    for t in set(image.ravel().tolist()):
        seen = set()
        for p in np.flatnonzero(image.ravel() >= t).tolist():
            if p in seen:
                continue
            part, todo = {p}, [p]
            while todo:
                q = todo.pop()
                for dr, dc in steps:
                    r, c = q // w + dr, q % w + dc
                    if 0 <= r < h and 0 <= c < w and image[r, c] >= t and r * w + c not in part:
                        part.add(r * w + c)
                        todo.append(r * w + c)
            seen |= part
            if own := [q for q in part if image.flat[q] == t]:
                out[min(own)] = (t, frozenset(part))
    return out


@pytest.mark.parametrize("kind,radius,bits", [("max", 1.5, 9), ("max", 1, 1), ("min", 1.5, 2), ("max", 2, 1), ("min", 1, 9)])
def test_trees_match_flooding(pixels, kind, radius, bits):
    from rasterforest.plans.trees import build

    got = build(pixels, kind, radius, bits).nodes.toPandas()
    sign = 1 if kind == "max" else -1
    for name, image in IMAGES.items():
        nodes = flood(image * sign, radius)
        for r in got[got.image_id == name].itertuples():
            level, support = nodes.pop(r.node_id)
            above = [(t, n) for n, (t, s) in flood(image * sign, radius).items() if t < level and support <= s]
            assert (r.level, r.parent_id) == (sign * level, max(above)[1] if above else r.node_id)
        assert not nodes


def test_components_settle_between_tiles(spark):
    chain = spark.createDataFrame([("a", i, i + 1) for i in range(200)] + [("b", 5, 9)], "k string, u long, v long")
    got = components(chain, ["k"], tile=16).groupBy("k", "label").count().toPandas()
    assert sorted(map(tuple, got.to_numpy().tolist())) == [("a", 0, 201), ("b", 5, 2)]


def test_tree_is_valid_and_rebuilds_the_image(forest, pixels):
    assert trees.validate_tree(forest).count() == 0
    ones = forest.nodes.select(*trees.NODE, F.lit(1.0).alias("score"))
    half = forest.nodes.select(*trees.NODE, F.lit(0.5).alias("score"))
    old = pixels.select("image_id", "pixel_id", F.col("value").alias("old"))
    for scores, share in ((ones, 1.0), (half, 0.5)):
        new = filters.soft_subtractive(forest, scores).join(old, ["image_id", "pixel_id"])
        assert new.where(F.abs(F.col("value") - share * F.col("old")) > 1e-9).count() == 0
    assert trees.reconstruct_levels(forest).join(old, ["image_id", "pixel_id"]).where("value <> old").count() == 0
    with pytest.raises(ValueError):
        filters.soft_subtractive(forest, forest.nodes.select(*trees.NODE, F.lit(1.5).alias("score")))


def test_topology_queries(forest):
    summary = {r["image_id"]: r for r in trees.tree_summary(forest).collect()}
    assert (summary["const"]["num_nodes"], summary["const"]["num_pixels"], summary["line"]["num_leaf_nodes"]) == (1, 6, 1)
    line = forest.nodes.where("image_id = 'line'")
    top = line.where("level = 4")
    assert trees.ancestors_of(forest, top).count() == 4
    assert trees.descendants_of(forest, line.where("level = 1")).count() == 3
    pair = line.where("level = 4").select("image_id", "channel", F.col("node_id").alias("a")).join(line.where("level = 2").select("image_id", "channel", F.col("node_id").alias("b")), ["image_id", "channel"])
    assert [r["node_id"] for r in trees.path_between(forest, pair).orderBy("position").collect()] == [3, 2, 1]
    spans = {r["node_id"]: (r["tpre"], r["tpost"]) for r in trees.tree_intervals(forest).where("image_id = 'line'").collect()}
    assert spans == {0: (0, 4), 1: (1, 4), 2: (2, 4), 3: (3, 4)}
    order = [r["node_id"] for r in trees.walk(forest).where("image_id = 'line'").orderBy("position").collect()]
    assert order == [3, 2, 1, 0]
    mask = trees.reconstruct_node(forest, line.where("level = 3")).orderBy("pixel_id").collect()
    assert [r["value"] for r in mask] == [0, 0, 255, 255]
    hierarchy = trees.export_hierarchy(forest).where("image_id = 'line'")
    assert hierarchy.count() == 8 and hierarchy.where("h_id = parent").count() == 1
    merged = trees.merge_into_parent(forest, line.where("level = 2"))
    assert merged.nodes.where("image_id = 'line'").orderBy("level").select("level").toPandas().level.tolist() == [1, 3, 4]
    pruned = trees.prune_nodes(forest, line.where("level = 3"))
    assert pruned.owners.where("image_id = 'line'").groupBy("node_id").count().orderBy("node_id").toPandas()["count"].tolist() == [1, 3]


def test_pruning_a_root_keeps_its_subtree(forest):
    line = forest.nodes.where("image_id = 'line'")
    rooted = trees.prune_nodes(forest, line.where("node_id = parent_id OR level = 3"))
    assert rooted.owners.where("image_id = 'line'").groupBy("node_id").count().orderBy("node_id").toPandas()["count"].tolist() == [1, 3]


def test_attribute_values(table):
    assert table.shape[1] == 3 + 136 and not table.isna().any().any()
    square = table[(table.image_id == "square") & (table.GRAY_LEVEL == 200)].iloc[0]
    assert (square.AREA, square.DIST_SUM, square.MAX_DIST, square.DIST_LEVEL_COUNT, square.CONTOUR_PERIMETER, square.BITQUAD_NUMBER_EULER) == (25, 10, 2, 3, 20, 1)
    hole = table[(table.image_id == "hole") & (table.GRAY_LEVEL == 200)].iloc[0]
    assert (hole.AREA, hole.FILLED_AREA, hole.BITQUAD_NUMBER_HOLES) == (24, 25, 1)
    assert hole.HOLE_AREA_FRACTION == pytest.approx(1 / 25) and hole.FILLED_LENGTH_MAJOR_AXIS == pytest.approx(math.sqrt(8))
    assert hole.FILLED_CIRCULARITY == pytest.approx(1) and hole.FILLED_COMPACTNESS == pytest.approx(1 / (8 * math.pi))
    root = table[(table.image_id == "root_mean") & (table.IS_ROOT_NODE == 1)].iloc[0]
    assert (root.GRAY_LEVEL, root.MEAN_GRAY_LEVEL) == (10, 25)
    assert table[(table.image_id == "box") & (table.GRAY_LEVEL == 200)].iloc[0].BOUNDING_BOX_WIDTH == 5


def test_attributes_match_supports(table):
    image = IMAGES["random"]
    for node, (_, support) in flood(image, 1.5).items():
        m = np.zeros((9, 10), int)
        ys, xs = np.array([p // 8 for p in support]), np.array([p % 8 for p in support])
        m[ys + 1, xs + 1] = 1
        got = table[(table.image_id == "random") & (table.node_id == node)].iloc[0]
        near = [m[:-2, 1:-1], m[1:-1, :-2], m[1:-1, 2:], m[2:, 1:-1]]
        core = m[1:-1, 1:-1]
        assert [got.CONTOUR_SIDE_NORTH, got.CONTOUR_SIDE_WEST, got.CONTOUR_SIDE_EAST, got.CONTOUR_SIDE_SOUTH] == [int((core * (1 - x)).sum()) for x in near]
        edge = core * (1 - np.minimum.reduce(near))
        assert got.CONTOUR_PIXELS == edge.sum()
        er, ec = np.nonzero(edge)
        d2 = [min((er - y) ** 2 + (ec - x) ** 2) for y, x in zip(ys, xs)]
        assert got.DIST_SQUARED_SUM == sum(d2)
        assert got.CENTRAL_MOMENT_21 == pytest.approx(((xs - xs.mean()) ** 2 * (ys - ys.mean())).sum(), abs=1e-6)
        assert got.VOLUME == image[ys, xs].sum()


def test_unknown_attribute_and_groups(forest):
    with pytest.raises(ValueError, match="unknown attribute"):
        attributes.compute(forest, ["NOPE"])
    assert [len(attributes.GROUPS[g]) for g in ("SHAPE", "MOMENTS", "FILLED_SHAPE", "ALL")] == [50, 23, 13, 136]
    with pytest.raises(ValueError, match="supports"):
        attributes.compute(forest, "MAX_DIST", max_support_rows=3)


def test_filters(forest, table):
    area = filters.area_of(forest)
    for least, gone in ((25, 0), (26, 1)):
        out = filters.pruning_min(forest, area, F.col("area") >= least).where("image_id = 'square'")
        assert out.agg(F.max("value")).first()[0] == (0 if gone else 200)
    value = area.withColumnRenamed("area", "value")
    leaves = trees.leaves(forest).where("image_id = 'random'").count()
    values = filters.extinction_values(forest, value).where("image_id = 'random'").toPandas()
    assert len(values) == leaves and np.isinf(values.extinction).sum() == 1
    one = filters.filter_extinction(forest, value, top_k=1).orderBy("image_id", "pixel_id").collect()
    assert one == filters.filter_extinction(forest, value, threshold=1e18).orderBy("image_id", "pixel_id").collect()
    for bad in ({"top_k": -1}, {"threshold": float("nan")}, {}):
        with pytest.raises(ValueError):
            filters.filter_extinction(forest, value, **bad)
    with pytest.raises(ValueError):
        filters.direct(forest, area.limit(1), F.lit(True))


NODES = "image_id string, channel int, node_id long, parent_id long, score double, feature double"


def scored(spark, parent, score, feature=None):
    return spark.createDataFrame([("i", 0, i, p, s, f) for i, (p, s, f) in enumerate(zip(parent, score, feature or score))], NODES)


def test_penalties(spark):
    assert scoring.edge_penalty(scored(spark, [0, 0, 0], [0.5, 0.7, 0.4]), 2.0).first()["penalty"] == pytest.approx(0.04)
    for parent, score, depth, weight, want in (([0, 0, 1, 1], [0.5, 0.4, 0.8, 0.3], 2, 2.0, 0.1), ([0, 0, 1], [0.0, 0.8, 0.9], None, 1.0, (0.64 + 0.01 + 0.81) / 3)):
        nodes = scored(spark, parent, score)
        assert scoring.path_penalty(nodes, ancestors(strides(nodes), nodes), weight, depth).first()["penalty"] == pytest.approx(want)
    assert scoring.order_penalty(scored(spark, [0] * 4, [0.2, 0.7, 0.4, 0.9], [0.1, 0.2, 0.3, 0.4]), "feature", 2.0).first()["penalty"] == pytest.approx(0.06)
    assert scoring.order_penalty(scored(spark, [0] * 3, [0.9, 0.7, 0.8], [0.1, 0.2, 0.3]), "feature", 3.0, increasing=False).first()["penalty"] == pytest.approx(0.015)
    report = scoring.edge_violations(scored(spark, [0, 0, 0], [0.5, 0.7, 0.4])).first()
    assert (report["edges"], report["violations"]) == (2, 1)


def test_scorers_and_gradients(spark, forest):
    a = attributes.compute(forest, ["AREA", "GRAY_LEVEL"]).withColumn("AREA", F.col("AREA") / 25).withColumn("GRAY_LEVEL", F.col("GRAY_LEVEL") / 200)
    spec = scoring.Spec("s", ("AREA", "GRAY_LEVEL"), (0.3, -0.2), 0.1, 2.0)
    target = forest.owners.select("image_id", "channel", "pixel_id", F.lit(0.0).alias("value"))

    def loss(s):
        return scoring.apply_specs(forest, a, [s]).agg(F.sum(F.col("value") * F.col("value"))).first()[0]

    out = scoring.apply_specs(forest, a, [spec])
    slope = scoring.linear_gradients(forest, a, spec, out.select("image_id", "channel", "pixel_id", (2 * F.col("value")).alias("value"))).first()
    from dataclasses import replace

    up, down = loss(replace(spec, bias=spec.bias + 1e-4)), loss(replace(spec, bias=spec.bias - 1e-4))
    assert slope["d_bias"] == pytest.approx((up - down) / 2e-4, rel=1e-4)
    deep = scoring.Spec("mlp", ("AREA", "GRAY_LEVEL"), (1.0,), 0.0, 1.0, layers=((((1.0, -1.0),), (0.5,)),))
    assert scoring.node_scores(forest, a, [deep]).where("score < 0.5 OR score > 1").count() == 0
    kept = replace(spec, keep_root=True)
    assert scoring.node_scores(forest, a, [kept]).where("node_id = parent_id AND score <> 1").count() == 0
    ranks = scoring.rank_attributes(scoring.attribute_ablation(a, [spec])).toPandas()
    assert ranks.percent.sum() == pytest.approx(100)


def test_statistics(spark, tmp_path):
    df = spark.createDataFrame([(2.0,), (5.0,), (3.0,)], "A double")
    s = stats.fit_stats(df, ["A"])
    assert tuple(s.first())[1:] == (3, 10.0, 38.0, 2.0, 5.0)
    assert tuple(stats.merge_stats(s, s).first())[1:] == (6, 20.0, 76.0, 2.0, 5.0)
    assert stats.normalize(df, ["A"], s, [], "minmax01").toPandas().A.tolist() == pytest.approx([0, 1, 1 / 3])
    clipped = stats.normalize(df, ["A"], s, [], "clipped_zscore01", k=2.0, floor=0.1).toPandas().A
    assert clipped.between(0.1, 1).all()
    assert stats.validate_summary(s.withColumn("count", F.lit(0))).count() == 1
    with pytest.raises(ValueError, match="no statistics"):
        stats.normalize(df.withColumn("B", F.lit(1.0)), ["B"], s, [])
    stats.save_stats(s, str(tmp_path / "s"), "minmax01")
    assert stats.load_stats(spark, str(tmp_path / "s"), "minmax01").count() == 1
    with pytest.raises(ValueError):
        stats.load_stats(spark, str(tmp_path / "s"), "zscore")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream_stats(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["A"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert tuple(read_stats(spark, str(tmp_path / "out")).first()) == tuple(s.first())


def test_patches(spark):
    image = {"p": np.arange(63).reshape(7, 9)}
    px = spark.createDataFrame(rows_of(image), PIXELS)
    sides = px.groupBy("image_id", "channel").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    for halo in (0, 2, 12):
        got = patches.extract_patches(px, patches.patch_grid(sides, 3, 2), 3, halo)
        back = patches.reassemble_mean(got).join(px.drop("value").join(px.select("pixel_id", F.col("value").alias("old")), "pixel_id"), ["image_id", "channel", "row", "col"])
        assert back.count() == 63 and back.where("value <> old").count() == 0
    assert patches.coverage(sides, patches.patch_grid(sides, 3, 2), 3).where("n = 0").count() == 0
    with pytest.raises(ValueError):
        patches.patch_grid(sides, 3, 4)


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1), (0.2, 0)], "score double, label int")
    r = metrics.rates(metrics.confusion(df, 0.5)).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 2) and r["f1"] == pytest.approx(2 / 3)
    pairs = [(a > b) + 0.5 * (a == b) for a in (0.9, 0.8, 0.1) for b in (0.8, 0.3, 0.2)]
    assert metrics.auc(df).first()["auc"] == pytest.approx(np.mean(pairs))
    assert metrics.best_thresholds(df).first()["by_f1"] == 0.8
    assert metrics.roc_curve(df).count() == 5 and metrics.metrics_on_grid(df, [0.5]).first()["f1"] == pytest.approx(2 / 3)


def test_conversion(spark, pixels):
    unit = pixels.withColumn("value", F.col("value") / 255.0)
    assert to_u8(unit.where("image_id = 'root_mean'")).agg(F.max("value")).first()[0] in (49, 50)
    assert invert(pixels.where("image_id = 'square'")).agg(F.min("value")).first()[0] == 55
    assert [r["issue"] for r in validate_intensity(pixels.withColumn("value", F.col("value") + 100)).select("issue").distinct().collect()] == ["above 255"]
    mean = resize_area(pixels.where("image_id = 'root_mean'"), 1, 1).first()["value"]
    assert mean == pytest.approx(25)
    assert resize_nearest(pixels.where("image_id = 'line'"), 1, 2).orderBy("col").toPandas().value.tolist() == [1, 3]
    with pytest.raises(ValueError):
        binarize(pixels)
    assert check_same_shape(pixels, pixels.where("image_id <> 'line'")).count() == 1
    cells = spark.createDataFrame([("a", 0, 1), ("a", 0, 1), ("a", 9, 9), (None, 0, 0)], "i string, r int, c int")
    assert rasterize(cells, F.col("i"), F.col("r"), F.col("c"), 2, 2).orderBy("pixel_id").toPandas().value.tolist() == [0, 2, 0, 0]


def test_datasets(spark):
    samples = spark.createDataFrame([(s,) for s in ("01", "1", "β", "four", "five")], "sample_id string")
    groups = spark.createDataFrame([("01", "a"), ("1", "a"), ("β", "b"), ("four", "c"), ("five", "c")], "sample_id string, group_id string")
    splits = spark.createDataFrame([("evaluation", 0, "β"), ("learning", 0, "1"), ("learning", 1, "01")], "split string, position int, sample_id string")
    assert datasets.validate_splits(samples, splits, groups).count() == 0
    assert datasets.validate_splits(samples, splits, groups, complete=True).count() == 2
    assert {r["split"]: r["n"] for r in datasets.split_report(samples, splits).collect()} == {"evaluation": 1, "learning": 2, "unassigned": 2}
    dealt = datasets.split_by_group(groups, {"train": 2, "test": 1}, seed=3)
    assert dealt.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        datasets.split_by_group(groups, {"train": 1})
    with pytest.raises(ValueError, match="at least one"):
        datasets.split_by_group(groups, {"train": 3, "test": 0})
    assert datasets.train_test_split(samples, 0.3).where("split = 'test'").count() == 2
    files = lambda names: spark.createDataFrame([(n.rsplit(".", 1)[0], n, n.rsplit(".", 1)[1]) for n in names], "stem string, path string, ext string")
    assert datasets.pair_folders(files(["a.png", "b.png"]), files(["b.jpg", "a.jpg"])).count() == 2
    with pytest.raises(ValueError, match="unmatched"):
        datasets.pair_folders(files(["a.png"]), files(["b.png"]))
    with pytest.warns(UserWarning, match="left out: b, c"):
        assert datasets.pair_folders(files(["a.png", "b.png"]), files(["a.png", "c.png"]), unmatched="warn").count() == 1
    pairs = datasets.pair_suffixes(files(["x_in.png", "x_t.png"]), "_in", "_t").first()
    assert (pairs["sample_id"], pairs["target_path"]) == ("x", "x_t.png")
    best = datasets.pair_first_match(files(["x.png"]), files(["x.gif", "x.png"]), ["png", "gif"]).first()
    assert best["target_path"] == "x.png"
    a = datasets.fingerprint(splits).first()[0]
    assert a == datasets.fingerprint(splits.orderBy("sample_id")).first()[0] != datasets.fingerprint(splits.limit(2)).first()[0]
    d = datasets.distribution(spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "x double"), "x").first()
    assert (d["n"], d["median"], d["mad"]) == (3, 2.0, 1.0)


def test_found_nodes_and_walks_of_subtrees(forest):
    line = "image_id = 'line'"
    marks = attributes.compute(forest, ["AREA", "GRAY_LEVEL"])
    assert [r["AREA"] for r in trees.find_nodes(forest, marks, by="AREA", top=2).where(line).orderBy("rank").collect()] == [4.0, 3.0]
    assert trees.find_nodes(forest, marks, F.col("GRAY_LEVEL") >= 3).where(line).count() == 2
    start = forest.nodes.where(line).where("level = 2").select(*trees.NODE)
    levels = forest.nodes.select(*trees.NODE, "level")
    for order, want in (("post", [4, 3, 2]), ("breadth", [2, 3, 4])):
        got = trees.walk(forest, order, start).join(levels, trees.NODE).orderBy("position").collect()
        assert [r["level"] for r in got] == want and [r["position"] for r in got] == [0, 1, 2]
    with pytest.raises(ValueError):
        trees.walk(forest, "in")


def test_attributes_under_hierarchy_ids(forest):
    h = trees.export_hierarchy(forest)
    area = trees.project_attributes(h, attributes.compute(forest, ["AREA"])).where("image_id = 'line'").orderBy("h_id").collect()
    assert [r["AREA"] for r in area] == [None] * 4 + [1.0, 2.0, 3.0, 4.0]
    assert trees.validate_tree(forest).count() == 0


def test_closure_of_a_deep_chain(spark):
    chain = spark.createDataFrame([("a", 0, i, max(0, i - 1)) for i in range(700)], "image_id string, channel int, node_id long, parent_id long")
    tables = strides(chain)
    assert len(tables) == 3 and sum(t.count() for t in tables) < 2 * 700 * STRIDE
    got = ancestors(tables, chain)
    assert got.count() == 700 * 701 // 2 and got.agg(F.max("steps")).first()[0] == 699
    assert ancestors(tables, chain, 20).agg(F.max("steps")).first()[0] == 20
    ones = chain.withColumn("n", F.lit(1))
    assert rolled(tables, ones, True, n="sum").where("n <> 700 - node_id").count() == 0
    assert rolled(tables, ones, False, n="sum").where("n <> node_id + 1").count() == 0
    held = nearest(tables, chain.where("node_id % 300 = 0"))
    assert held.where("holder <> node_id - node_id % 300").count() == 0 and held.count() == 700
    start = chain.select("image_id", "channel", "node_id", F.col("node_id").alias("item"), F.lit(123).alias("bound"))
    marks = chain.select("image_id", "channel", "node_id", F.col("node_id").alias("mark"))
    found = climbed(tables, chain, start, ["item"], marks, F.col("mark") <= F.col("bound"))
    assert found.count() == 700 and found.where("node_id <> least(item, 123)").count() == 0


def test_preparation_uses_training_rasters_only(spark, pixels):
    few = pixels.where("image_id IN ('line', 'const')")
    done = preparation.prepare(few, ["max", "min"], ["AREA"], spark.createDataFrame([("line",), ("line",)], "image_id string"))
    got = {r["stat_key"]: (r["count"], r["sum"]) for r in done.stats.collect()}
    assert got == {"max::AREA": (4, 10.0), "min::AREA": (4, 10.0)}
    assert done.attributes["max"].count() == 5
    with pytest.raises(ValueError):
        stats.fit_stats(done.attributes["max"].limit(0), ["AREA"])


def tree_of_digests(rows, per_block, digits):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    counts = Counter(sha(json.dumps(r, separators=(",", ":"))) for r in rows)
    depth = digits
    while len(rows) > per_block * 16**depth:
        depth += digits
    level = {}
    for d, n in counts.items():
        level.setdefault(d[:depth], []).append(d + (f"*{n}" if n > 1 else ""))
    while True:
        level = {b: sha("".join(sorted(x) if isinstance(x[0], str) else [v for _, v in sorted(x)])) for b, x in level.items()}
        if depth == 0 or not level:
            return level.get("", sha(""))
        depth -= digits
        above = {}
        for b, x in level.items():
            above.setdefault(b[:depth], []).append((b, x))
        level = above


def test_fingerprint_of_many_rows_is_a_tree(spark):
    rows = [{"a": i % 250, "b": f"x{i % 250}"} for i in range(300)] + [{"a": 1, "b": "hot"}] * 400
    df = spark.createDataFrame([(r["a"], r["b"]) for r in rows], "a long, b string")
    for per_block, digits in ((2, 1), (4096, 3)):
        got = {datasets.fingerprint(x, per_block=per_block, digits=digits).first()[0] for x in (df, df.repartition(7).select("b", "a"))}
        assert got == {tree_of_digests(rows, per_block, digits)}
    assert datasets.fingerprint(df.limit(0)).first()[0] == tree_of_digests([], 4096, 3)
    splits = spark.createDataFrame([("s", i, f"k{i}") for i in range(40)], "split string, position long, sample_id string")
    samples = spark.createDataFrame([("input", "k1", "ab")], "role string, sample_id string, sha256 string")
    found = {r["name"]: r["fingerprint"] for r in datasets.fingerprints(samples, splits, {}, per_block=3).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = [sha(f"{i}|k{i}") for i in range(40)]
    while len(level) > 3:
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    assert found["split:s"] == sha("".join(level))


def test_fingerprints_name_what_changed(spark):
    samples = spark.createDataFrame([("a", "input", "x"), ("a", "target", "y"), ("b", "input", "z")], "sample_id string, role string, sha256 string")
    splits = lambda ids: spark.createDataFrame([("train", i, s) for i, s in enumerate(ids)], "split string, position int, sample_id string")
    read = lambda *args: {r["name"]: r["fingerprint"] for r in datasets.fingerprints(*args).collect()}
    first = read(samples, splits("ab"), {"k": "1", "l": "2"})
    assert {*first} == {"input", "target", "splits", "split:train", "preprocessing", "manifest"}
    assert first == read(samples.orderBy(F.desc("sha256")), splits("ab"), {"l": "2", "k": "1"})
    turned = read(samples, splits("ba"), {"k": "1", "l": "2"})
    assert {n for n in first if first[n] != turned[n]} == {"splits", "split:train", "manifest"}
    other = read(samples.where("role = 'input'"), splits("ab"), {"k": "1"})
    assert {n for n in first if first[n] != other[n]} == {"target", "preprocessing", "manifest"}
    rows = lambda ids: spark.createDataFrame([(i, s, s, "x") for i, s in enumerate(ids)], "position int, sample_id string, entry_key string, sha256 string")
    identity = lambda ids, **c: stats.stats_identity(rows(ids), c).first()[0]
    assert identity("ab", mode="z") == identity("ab", mode="z")
    assert len({identity("ab", mode="z"), identity("ba", mode="z"), identity("ab", mode="m")}) == 3
    assert datasets.target_fingerprint(rows("ab")).first() != datasets.target_fingerprint(rows("ba")).first()


def test_manifest_pages_and_cache_issues(spark):
    samples = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "position int, sample_id string")
    contributions = spark.createDataFrame([(i, f"e{i % 3}") for i in range(5)], "position int, entry_key string")
    entries = spark.createDataFrame([("e0", "ready", 5), ("e1", "failed", 7)], "entry_key string, state string, size_bytes long")
    states, missing, page = datasets.inspect_manifest(samples, contributions, entries, 1, 2)
    assert {(r["state"], r["n"], r["bytes"]) for r in states.collect()} == {("ready", 1, 5), ("failed", 1, 7), ("missing", 1, 0)}
    assert [r[0] for r in missing.collect()] == ["e2"]
    assert [(r["position"], r["next_offset"]) for r in page.collect()] == [(1, 3), (2, 3)]
    assert [r["next_offset"] for r in datasets.inspect_manifest(samples, contributions, entries, 3, 2)[2].collect()] == [None, None]
    source = samples.withColumn("sample_id", F.when(F.col("position") == 4, "other").otherwise(F.col("sample_id")))
    got = datasets.inspect_dataset_cache(samples, contributions, entries, contributions.where("entry_key <> 'e0'"), source)
    assert {tuple(r) for r in got.collect()} == {("metadata", "entry", "e1"), ("metadata", "entry", "e2"), ("payload", "no payload", "e0"), ("source", "moved", "4")}


def test_split_checks_are_dealt_by_rows(spark):
    ids = spark.range(12_000).select(F.col("id").cast("string").alias("sample_id"), "id")
    splits = ids.select("sample_id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("split"))
    # One group holds half of all samples, others two of one split each.
    group = F.when(F.col("id") < 6_000, "hot").otherwise(F.concat((F.col("id") / 4).cast("int").cast("string"), F.lit("-"), F.col("id") % 2))
    groups = ids.where("id <> 7000").select("sample_id", group.alias("group_id"))
    more = splits.unionByName(spark.createDataFrame([("0", "b"), ("1", "b"), ("x", "a")], "sample_id string, split string"))
    found = datasets.validate_splits(ids.select("sample_id"), more, groups, rows=500)
    assert {tuple(r) for r in found.collect()} == {("repeated in split", "1"), ("unknown", "x"), ("shared", "0"), ("group crosses", "hot"), ("no group", "7000")}
    assert found.count() == 5
    assert found.rdd.getNumPartitions() >= 24


def user_nodes(spark, path, rows):
    """user_tree_nodes over events (user_id, hour)."""
    events = spark.createDataFrame(rows, "user_id long, hour long").select("user_id", F.timestamp_seconds(F.col("hour") * 3600).alias("ts"))
    events.write.parquet(f"{path}/events.parquet")
    out = queries.user_tree_nodes(spark, str(path))
    return {tuple(r) for r in out.select("node_id", "parent_id", "level", "residue", "proper_area", "depth").collect()}


def test_user_tree_leaves_out_empty_cells(spark, tmp_path):
    # Two users side by side over the border of two tiles, one far beyond 32 bits, so that the grid can't be listed.
    far = 3_000_000_000
    rows = [(511, 10)] * 3 + [(512, 11)] * 2 + [(512, 12)] + [(far, 10)] * 2 + [(-1, 99), (None, 10), (4, None)]
    a, b, c, d = 511 * 3, 512 * 3 + 1, 512 * 3 + 2, far * 3
    want = {(0, 0, 0, 0, (far + 1) * 3 - 4, 0), (a, b, 3, 1, 1, 3), (b, c, 2, 1, 1, 2), (c, 0, 1, 1, 1, 1), (d, 0, 2, 2, 1, 1)}
    assert user_nodes(spark, tmp_path / "far", rows) == want
    # The first cells have events; then all cells have some.
    assert user_nodes(spark, tmp_path / "first", [(0, 0), (0, 1), (1, 1)]) == {(2, 2, 0, 0, 1, 0), (0, 2, 1, 1, 3, 1)}
    assert user_nodes(spark, tmp_path / "full", [(0, 0), (0, 1), (0, 1)]) == {(0, 0, 1, 1, 1, 0), (1, 0, 2, 1, 1, 1)}
