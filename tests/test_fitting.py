"""Losses, gradients and fits of gates on small rasters."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterforest.operators import attributes, fitting, scoring, trees

IMAGES = np.random.default_rng(3).integers(0, 16, (2, 6, 7))


@pytest.fixture(scope="module")
def rasters(spark):
    rows = [(f"i{k}", 0, r, c, r * 7 + c, int(IMAGES[k, r, c])) for k in range(2) for r in range(6) for c in range(7)]
    return spark.createDataFrame(rows, "image_id string, channel int, row int, col int, pixel_id long, value int")


@pytest.fixture(scope="module")
def grown(rasters):
    f = trees.max_tree(rasters)
    a = attributes.compute(f, ["AREA", "GRAY_LEVEL"])
    a = a.withColumn("AREA", F.col("AREA") / 42).withColumn("GRAY_LEVEL", F.col("GRAY_LEVEL") / 15)
    rows = a.collect()
    return f, a.sparkSession.createDataFrame(rows, a.schema)


SPEC = scoring.Spec("s", ("AREA", "GRAY_LEVEL"), (0.3, -0.2), 0.1, 2.0)


@pytest.mark.parametrize("name", ["squared", "cross_entropy"])
@pytest.mark.parametrize("keep_root", [False, True])
def test_gradient_is_the_losses_slope(rasters, grown, name, keep_root):
    f, a = grown
    loss = fitting.squared(15.0) if name == "squared" else fitting.cross_entropy(3.0, 5.0)
    target = rasters.withColumn("value", (F.col("value") >= 8).cast("int"))
    spec, h = replace(SPEC, keep_root=keep_root), 1e-4
    moved = [spec, replace(spec, bias=spec.bias + h), replace(spec, bias=spec.bias - h), replace(spec, weights=(0.3 + h, -0.2)), replace(spec, weights=(0.3 - h, -0.2))]
    at = {r["place"]: r for r in fitting.losses(f, a, moved, target, loss).collect()}
    assert at[0]["n"] == 84
    d = fitting.gradient(f, a, spec, target, loss, 84).first()
    assert d["d_bias"] == pytest.approx((at[1]["loss"] - at[2]["loss"]) / (2 * h), rel=1e-4)
    assert d["d_AREA"] == pytest.approx((at[3]["loss"] - at[4]["loss"]) / (2 * h), rel=1e-4)


def test_weighted_cross_entropy_matches_its_definition(rasters, grown):
    f, a = grown
    target = rasters.withColumn("value", (F.col("value") >= 8).cast("int"))
    y = scoring.apply_specs(f, a, [SPEC]).join(target.select("image_id", "pixel_id", F.col("value").alias("t")), ["image_id", "pixel_id"]).toPandas()
    p = 1 / (1 + np.exp(-y["value"] / 5))
    want = -np.mean(3 * y["t"] * np.log(p) + (1 - y["t"]) * np.log(1 - p))
    assert fitting.losses(f, a, [SPEC], target, fitting.cross_entropy(3.0, 5.0)).first()["loss"] == pytest.approx(want)


def test_soft_threshold_is_found_again(rasters, grown):
    f, a = grown
    made = scoring.apply_specs(f, a, [scoring.soft_threshold("made", "GRAY_LEVEL", 0.6, 8.0)]).select("image_id", "channel", "pixel_id", "value")
    target = made.withColumn("value", F.col("value") / 15)
    found, done = fitting.fit_soft_threshold(f, a, "GRAY_LEVEL", target, 0.3, 8.0, loss=fitting.squared(15.0), steps=6)
    assert list(done.losses) == sorted(done.losses, reverse=True)
    assert found == pytest.approx(0.6, abs=0.05) and done.losses[-1] < done.losses[0] / 20
    assert done.spec.weights == (1.0,)


def test_fit_lowers_the_loss_and_refuses(spark, rasters, grown):
    f, a = grown
    target = rasters.withColumn("value", F.when(F.col("pixel_id") > 2, (F.col("value") >= 8).cast("int")))
    done = fitting.fit(f, a, SPEC, target, fitting.cross_entropy(2.0, 5.0), steps=2, max_norm=5.0)
    assert done.losses[-1] < done.losses[0]
    with pytest.raises(ValueError, match="no pixel"):
        fitting.fit(f, a, SPEC, target.where("value > 1"))
    with pytest.raises(ValueError, match="no such parameters"):
        fitting.fit(f, a, SPEC, target, learn=("VOLUME",))
    with pytest.raises(ValueError, match="hidden layers"):
        fitting.fit(f, a, replace(SPEC, layers=((((1.0, -1.0),), (0.5,)),), weights=(1.0,)), target)


def test_smallest_node(spark, rasters, grown):
    f, _ = grown
    asked = spark.createDataFrame([("i0", 0, 2, 3, -5), ("i0", 0, 2, 3, -5), ("i1", 0, 9, 0, 1), ("none", 0, 0, 0, 1), ("i1", 0, None, 0, 1)], "image_id string, channel int, row int, col int, node_id int")
    got = trees.smallest_node(f, asked).collect()
    want = f.owners.where("image_id = 'i0' AND row = 2 AND col = 3").first()
    assert len(got) == 5 and [(r["pixel_id"], r["node_id"]) for r in got if r["row"] == 2] == [(17, want["node_id"])] * 2
    assert all(r["node_id"] is None for r in got if r["row"] != 2)
