"""Node scorers, the soft connected filter, its gradients and monotonicity penalties."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranks import numbered_within
from ..plans.trees import Forest
from ..tables import KEY
from .trees import NODE, ancestors_of, roll_down, roll_up


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


@dataclass(frozen=True)
class Spec:
    """A filter: attributes, weights, bias, sharpness; clamp bounds the logit before the sigmoid."""

    name: str
    attributes: tuple[str, ...]
    weights: tuple[float, ...] = ()
    bias: float = 0.0
    sharpness: float = 1.0
    clamp: float | None = None
    keep_root: bool = False
    layers: tuple[tuple[tuple[tuple[float, ...], ...], tuple[float, ...]], ...] = ()
    activation: str = "relu"
    penalties: tuple[tuple[str, dict], ...] = field(default=())


ACTIVATIONS = {
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "tanh": F.tanh,
    "sigmoid": sigmoid,
    "identity": lambda x: x,
    # The tanh form of the Gaussian error linear unit.
    "gelu": lambda x: 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x))),
}


def logit(spec: Spec) -> Column:
    """Linear, or through the spec's hidden layers (rows of weights, biases), before the sharpness."""
    values = [F.col(a) for a in spec.attributes]
    for rows, biases in spec.layers:
        values = [ACTIVATIONS[spec.activation](sum((F.lit(w) * v for w, v in zip(row, values)), F.lit(b))) for row, b in zip(rows, biases)]
    return sum((F.lit(w) * v for w, v in zip(spec.weights, values, strict=True)), F.lit(spec.bias))


def score(spec: Spec) -> Column:
    x = spec.sharpness * logit(spec)
    if spec.clamp is not None:
        x = F.least(F.greatest(x, F.lit(-spec.clamp)), F.lit(spec.clamp))
    return sigmoid(x)


def soft_threshold(name: str, attribute: str, threshold: float, sharpness: float = 1.0) -> Spec:
    """Score sigmoid(sharpness * (attribute - threshold)) of exactly one attribute."""
    return Spec(name, (attribute,), (1.0,), -threshold, sharpness)


def node_scores(forest: Forest, attributes: DataFrame, specs: list[Spec]) -> DataFrame:
    """key, node_id, parent_id, residue, spec, spec_index, score."""
    rows = forest.nodes.select(*NODE, "parent_id", "residue").join(attributes, NODE)
    each = F.array(*[F.struct(F.lit(s.name).alias("spec"), F.lit(i).alias("spec_index"), (F.when(F.col("node_id") == F.col("parent_id"), 1.0).otherwise(score(s)) if s.keep_root else score(s)).alias("score")) for i, s in enumerate(specs)])
    return rows.withColumn("s", F.explode(each)).select(*NODE, "parent_id", "residue", "s.*")


def apply_specs(forest: Forest, attributes: DataFrame, specs: list[Spec]) -> DataFrame:
    """The filtered rasters: output channel = channel * number of specs + spec index."""
    scores = node_scores(forest, attributes, specs)
    gain = scores.select(*NODE, "spec", "spec_index", (F.col("residue") * F.col("score")).alias("value"))
    sums = roll_down(forest, gain, ("spec", "spec_index"), value="sum")
    out = forest.owners.drop("value").join(sums, NODE)
    return out.select("image_id", (F.col("channel") * len(specs) + F.col("spec_index")).alias("channel"), "spec", "pixel_id", "row", "col", "value")


def predict(forest: Forest, attributes: DataFrame, specs: list[Spec], sharpness: float = 1000.0) -> DataFrame:
    """apply_specs with nearly hard gates."""
    return apply_specs(forest, attributes, [replace(s, sharpness=sharpness) for s in specs])


def pixels_to_nodes(forest: Forest, signal: DataFrame) -> DataFrame:
    """The Jacobian on a pixel signal (key, pixel_id, value): sums over each node's support."""
    own = forest.owners.drop("value").join(signal.select(*KEY, "pixel_id", "value"), [*KEY, "pixel_id"]).groupBy(*NODE).agg(F.sum("value").alias("value"))
    return roll_up(forest, own, value="sum")


def linear_gradients(forest: Forest, attributes: DataFrame, spec: Spec, loss: DataFrame) -> DataFrame:
    """One row: the derivatives of a pixel loss (key, pixel_id, value = its derivative) by weights and bias; 0 for clamped nodes and kept roots."""
    g = pixels_to_nodes(forest, loss).withColumnRenamed("value", "g")
    x = spec.sharpness * logit(spec)
    open_ = F.lit(True) if spec.clamp is None else F.abs(x) < spec.clamp
    if spec.keep_root:
        open_ = open_ & (F.col("node_id") != F.col("parent_id"))
    rows = forest.nodes.select(*NODE, "parent_id", "residue").join(attributes, NODE).join(g, NODE)
    s = sigmoid(x)
    push = F.when(open_, F.col("g") * F.col("residue") * s * (1 - s) * spec.sharpness).otherwise(0.0)
    return rows.agg(*[F.sum(push * F.col(a)).alias(f"d_{a}") for a in spec.attributes], F.sum(push).alias("d_bias"))


def edge_penalty(scores: DataFrame, weight: float = 1.0, by: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """Mean over tree edges of the squared excess of a child's score over its parent's."""
    up = scores.select(*by, F.col("node_id").alias("parent_id"), F.col("score").alias("p_score"))
    edges = scores.where("node_id <> parent_id").join(up, [*by, "parent_id"])
    return edges.groupBy(*by).agg((weight * F.avg(F.pow(F.greatest(F.col("score") - F.col("p_score"), F.lit(0.0)), 2))).alias("penalty"))


def path_penalty(scores: DataFrame, pairs: DataFrame, weight: float = 1.0, max_depth: int | None = None) -> DataFrame:
    """The same over every pair of a node and an ancestor (key, node_id, ancestor_id, steps), up to max_depth apart."""
    pairs = pairs.where(F.col("steps") > 0 if max_depth is None else F.col("steps").between(1, max_depth))
    up = scores.select(*KEY, F.col("node_id").alias("ancestor_id"), F.col("score").alias("p_score"))
    both = pairs.join(scores.select(*NODE, "score"), NODE).join(up, [*KEY, "ancestor_id"])
    return both.groupBy(*KEY).agg((weight * F.avg(F.pow(F.greatest(F.col("score") - F.col("p_score"), F.lit(0.0)), 2))).alias("penalty"))


def order_penalty(scores: DataFrame, feature: str, weight: float = 1.0, increasing: bool = True, min_gap: float = 0.0) -> DataFrame:
    """Mean squared fall (rise, if decreasing) of the score between neighbours in the feature's order, where the feature's gap exceeds min_gap."""
    at = numbered_within(scores.select(*NODE, "score", F.col(feature).alias("feature")), KEY, [F.col("feature"), F.col("node_id")])
    ahead = at.select(*KEY, (F.col("position") + 1).alias("position"), F.col("feature").alias("before"), F.col("score").alias("former"))
    steps = at.join(ahead, [*KEY, "position"]).withColumn("gap", F.col("feature") - F.col("before")).withColumn("fall", F.col("former") - F.col("score")).where(F.col("gap") > min_gap)
    fall = F.col("fall") if increasing else -F.col("fall")
    return steps.groupBy(*KEY).agg((weight * F.avg(F.pow(F.greatest(fall, F.lit(0.0)), 2))).alias("penalty"))


def regularization_penalty(forest: Forest, attributes: DataFrame, specs: list[Spec]) -> float:
    """Sum of all specs' penalties over the number of rasters; specs without any are skipped."""
    rasters = forest.nodes.select(*KEY).distinct().count()
    kinds = {"edge": lambda s, **o: edge_penalty(s, **o), "path": lambda s, **o: path_penalty(s, ancestors_of(forest, forest.nodes, o.get("max_depth")), **o), "order": lambda s, **o: order_penalty(s.join(attributes, NODE), **o)}
    total = 0.0
    for spec in specs:
        if spec.penalties:
            s = node_scores(forest, attributes, [spec])
            total += sum(kinds[k](s, **o).agg(F.coalesce(F.sum("penalty"), F.lit(0.0))).first()[0] for k, o in spec.penalties)
    return total / max(rasters, 1)


def edge_violations(scores: DataFrame, by: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    up = scores.select(*by, F.col("node_id").alias("parent_id"), F.col("score").alias("p_score"))
    d = scores.where("node_id <> parent_id").join(up, [*by, "parent_id"]).withColumn("over", F.greatest(F.col("score") - F.col("p_score"), F.lit(0.0)))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("over") > 1e-6).alias("violations"), F.sum("over").alias("total"), F.sum(F.col("over") * F.col("over")).alias("squares"), F.max("over").alias("worst"))


def score_diagnostics(scores: DataFrame, bins: int = 10, margin: float = 0.05) -> DataFrame:
    """Per spec: mean, least and largest score, share near 0 or 1, share above a half, histogram."""
    s = F.col("score")
    agg = scores.groupBy("spec").agg(F.avg(s).alias("mean"), F.min(s).alias("low"), F.max(s).alias("high"), F.avg(((s < margin) | (s > 1 - margin)).cast("double")).alias("saturation"), F.avg((s >= 0.5).cast("double")).alias("acceptance"))
    hist = scores.groupBy("spec", F.least(F.floor(s * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return agg.join(hist.groupBy("spec").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", "n")))).alias("histogram")), "spec")


def inspect(forest: Forest, raw: DataFrame, normalized: DataFrame, specs: list[Spec], image_id: str, channel: int = 0) -> DataFrame:
    """Attributes, residues and scores of one raster's nodes."""
    here = (F.col("image_id") == image_id) & (F.col("channel") == channel)
    names = [c for c in normalized.columns if c not in NODE]
    norm = normalized.select(*NODE, *[F.col(c).alias(f"norm_{c}") for c in names])
    return node_scores(forest, normalized, specs).where(here).join(raw, NODE).join(norm, NODE)


def attribute_ablation(attributes: DataFrame, specs: list[Spec]) -> DataFrame:
    """Per raster, spec and attribute: mean change of the score without it, and mean size of its part of the logit."""
    parts = []
    for s in specs:
        x = s.sharpness * logit(s)
        parts += [F.struct(F.lit(s.name).alias("spec"), F.lit(a).alias("attribute"), F.abs(sigmoid(x) - sigmoid(x - s.sharpness * w * F.col(a))).alias("change"), F.abs(s.sharpness * w * F.col(a)).alias("part")) for a, w in zip(s.attributes, s.weights)]
    rows = attributes.select(*KEY, F.explode(F.array(*parts)).alias("p")).select(*KEY, "p.*")
    return rows.groupBy(*KEY, "spec", "attribute").agg(F.avg("change").alias("mean_change"), F.avg("part").alias("mean_contribution"))


def rank_attributes(ablation: DataFrame) -> DataFrame:
    """Per spec and attribute over rasters: mean, sample deviation, n and percent of the spec's total."""
    by = ablation.groupBy("spec", "attribute").agg(F.avg("mean_change").alias("mean"), F.stddev_samp("mean_change").alias("std"), F.count(F.lit(1)).alias("n"))
    total = F.sum("mean").over(W.partitionBy("spec"))
    return by.withColumn("percent", F.when(total > 0, 100 * F.col("mean") / total).otherwise(0.0)).withColumn("rank", F.row_number().over(W.partitionBy("spec").orderBy(F.desc("mean"), "attribute")))
