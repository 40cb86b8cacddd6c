"""Fits of linear and soft-threshold gates: full-batch gradient steps of two Spark aggregates each."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.trees import Forest
from ..tables import KEY, Scratch
from .scoring import Spec, apply_specs, linear_gradients, sigmoid, soft_threshold
from .trees import NODE


@dataclass(frozen=True)
class Loss:
    """A loss of one pixel and its derivative, as columns of prediction and target; a prediction is the filtered value over scale."""

    value: Callable[[Column, Column], Column]
    slope: Callable[[Column, Column], Column]
    scale: float = 1.0


def squared(scale: float = 1.0) -> Loss:
    return Loss(lambda y, t: (y - t) * (y - t), lambda y, t: 2 * (y - t), scale)


def cross_entropy(positive_weight: float = 1.0, scale: float = 1.0) -> Loss:
    """Of predictions as logits; pixels of target 1 count positive_weight times."""

    def softplus(x: Column) -> Column:
        return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))

    return Loss(
        lambda y, t: positive_weight * t * softplus(-y) + (1 - t) * softplus(y),
        lambda y, t: (1 - t) * sigmoid(y) - positive_weight * t * sigmoid(-y),
        scale,
    )


def _predictions(forest: Forest, attributes: DataFrame, specs: list[Spec], target: DataFrame, loss: Loss) -> DataFrame:
    """key, pixel_id, place of the spec in specs, y and t; pixels without a target take no part."""
    out = apply_specs(forest, attributes, specs).withColumn("place", F.pmod("channel", F.lit(len(specs)))).withColumn("channel", F.floor(F.col("channel") / len(specs)).cast("int"))
    want = target.where("value IS NOT NULL").select(*KEY, "pixel_id", F.col("value").cast("double").alias("t"))
    return out.join(want, [*KEY, "pixel_id"]).select(*KEY, "pixel_id", "place", (F.col("value") / loss.scale).alias("y"), "t")


def losses(forest: Forest, attributes: DataFrame, specs: list[Spec], target: DataFrame, loss: Loss) -> DataFrame:
    """place (in specs), n and loss, the mean over the target's pixels (key, pixel_id, value); no row where there are none."""
    rows = _predictions(forest, attributes, specs, target, loss)
    return rows.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.avg(loss.value(F.col("y"), F.col("t"))).alias("loss"))


def gradient(forest: Forest, attributes: DataFrame, spec: Spec, target: DataFrame, loss: Loss, n: int) -> DataFrame:
    """One row: the derivatives of the mean loss over n pixels by the spec's weights and bias."""
    rows = _predictions(forest, attributes, [spec], target, loss)
    slope = rows.select(*KEY, "pixel_id", (loss.slope(F.col("y"), F.col("t")) / (loss.scale * n)).alias("value"))
    return linear_gradients(forest, attributes, spec, slope)


@dataclass(frozen=True)
class Fit:
    spec: Spec
    #: The mean loss before the first step and after each.
    losses: tuple[float, ...]


def fit(forest: Forest, attributes: DataFrame, spec: Spec, target: DataFrame, loss: Loss | None = None, learn: tuple[str, ...] | None = None, steps: int = 20, rate: float = 1.0, tries: int = 6, tolerance: float = 1e-6, max_norm: float | None = None) -> Fit:
    """Gradient steps on the mean loss of the filtered rasters against target (key, pixel_id, value).

    Each step scores `tries` rates (four times the last one, that one, a quarter, ...) in one
    job and takes the best, so that the loss never rises; it ends after `steps`, once a step
    gains less than tolerance of the loss, or where no rate gains. learn names the attributes
    (and "bias") whose weights move: all by default. max_norm bounds the gradient. Only
    weights and losses reach the driver. A target without pixels fails, as do hidden layers.
    """
    loss = loss or squared()
    if spec.layers:
        raise ValueError("hidden layers can't be fitted")
    learn = (*spec.attributes, "bias") if learn is None else learn
    if lost := set(learn) - {*spec.attributes, "bias"}:
        raise ValueError(f"no such parameters: {', '.join(sorted(lost))}")
    scratch = Scratch(target.sparkSession, "fit")
    try:
        attributes = scratch.keep(attributes.select(*NODE, *spec.attributes), "attributes")
        target = scratch.keep(target.select(*KEY, "pixel_id", "value"), "target")
        first = losses(forest, attributes, [spec], target, loss).first()
        if first is None:
            raise ValueError("the target has no pixel of the rasters")
        history = [first["loss"]]
        for _ in range(steps):
            d = gradient(forest, attributes, spec, target, loss, first["n"]).first()
            moves = {a: d[f"d_{a}"] for a in learn}
            norm = math.sqrt(sum(x * x for x in moves.values()))
            if norm == 0:
                break
            shrink = 1.0 if max_norm is None else min(1.0, max_norm / norm)
            rates = [rate * 4.0 ** (1 - i) for i in range(tries)]
            tried = [_moved(spec, moves, r * shrink) for r in rates]
            found = [r for r in losses(forest, attributes, tried, target, loss).collect() if math.isfinite(r["loss"])]
            best = min(found, key=lambda r: r["loss"], default=None)
            if best is None or best["loss"] >= history[-1]:
                if rates[-1] * norm < 1e-9:
                    break
                rate = rates[-1] / 4
                continue
            spec, rate = tried[best["place"]], rates[best["place"]]
            history.append(best["loss"])
            if history[-2] - history[-1] <= tolerance * abs(history[-2]):
                break
        return Fit(spec, tuple(history))
    finally:
        scratch.close()


def _moved(spec: Spec, moves: dict[str, float], rate: float) -> Spec:
    weights = tuple(w - rate * moves.get(a, 0.0) for w, a in zip(spec.weights, spec.attributes, strict=True))
    return replace(spec, weights=weights, bias=spec.bias - rate * moves.get("bias", 0.0))


def fit_soft_threshold(forest: Forest, attributes: DataFrame, attribute: str, target: DataFrame, threshold: float, sharpness: float = 1.0, **options: object) -> tuple[float, Fit]:
    """The threshold of one attribute's soft gate, from a first one; its weight stays 1. Options are those of fit."""
    done = fit(forest, attributes, soft_threshold(attribute, attribute, threshold, sharpness), target, learn=("bias",), **options)
    return -done.spec.bias, done
