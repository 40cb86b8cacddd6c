"""Node attributes as subtree aggregations of what each node's own pixels contribute."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.shapes import filled_components
from ..plans.trees import Forest
from ..tables import KEY, Scratch, begins, settle, whole_groups
from .trees import NODE, jacobian, lowest_common, relatives, roll_up, tree_intervals

C = F.col


def _area() -> Column:
    return C("n").cast("double")


def _mu(p: int, q: int) -> Column:
    """Central moment from raw moments s_ij, x the column and y the row."""
    cx, cy = C("s10") / C("n"), C("s01") / C("n")
    terms = [math.comb(p, i) * math.comb(q, j) * F.pow(-cx, p - i) * F.pow(-cy, q - j) * C(f"s{i}{j}") for i in range(p + 1) for j in range(q + 1)]
    return sum(terms[1:], terms[0])


def _mus(table: DataFrame) -> DataFrame:
    table = table.withColumns({f"mu{p}{q}": _mu(p, q) for p in range(4) for q in range(4 - p) if p + q >= 2})
    spread = F.sqrt(F.pow(C("mu20") - C("mu02"), 2) + 4 * C("mu11") * C("mu11"))
    total = C("mu20") + C("mu02")
    return table.withColumn("l1", (total + spread) / 2).withColumn("l2", F.greatest((total - spread) / 2, F.lit(0.0)))


def _moments(x: Column, y: Column) -> dict[str, Column]:
    return {f"s{i}{j}": F.sum(F.pow(x, i) * F.pow(y, j)) for i in range(4) for j in range(4 - i)}


def _signed_orientation() -> Column:
    angle = F.degrees(0.5 * F.atan2(2 * C("mu11"), C("mu20") - C("mu02")))
    return F.when((F.abs(C("mu11")) < 1e-9) & (F.abs(C("mu20") - C("mu02")) < 1e-9), 0.0).otherwise(angle)


def _inertia_shape(area: Column) -> dict[str, Column]:
    total = C("mu20") + C("mu02")
    one = area <= 1
    return {
        "LENGTH_MAJOR_AXIS": 2 * F.sqrt(C("l1") / area),
        "LENGTH_MINOR_AXIS": 2 * F.sqrt(C("l2") / area),
        "AXIS_ORIENTATION_SIGNED": _signed_orientation(),
        "AXIS_ORIENTATION": F.abs(_signed_orientation()),
        "ECCENTRICITY": F.when(one, 1.0).when(C("l2") * 1e6 <= C("l1"), 1e6).otherwise(C("l1") / C("l2")),
        "INERTIA": total / (area * area),
        "COMPACTNESS": F.when(total > 0, area / (2 * math.pi * total)).otherwise(0.0),
        "CIRCULARITY": F.when(one, 1.0).when(C("l1") <= 0, 0.0).otherwise(C("l2") / C("l1")),
        "RAW_INERTIA": total,
    }


def _hu() -> dict[str, Column]:
    e = {f"{p}{q}": C(f"mu{p}{q}") / F.pow(_area(), 1 + (p + q) / 2) for p in range(4) for q in range(4 - p) if p + q >= 2}
    a, b = e["30"] + e["12"], e["21"] + e["03"]
    c, d = e["30"] - 3 * e["12"], 3 * e["21"] - e["03"]
    s = e["20"] - e["02"]
    return {
        "HU_MOMENT_1": e["20"] + e["02"],
        "HU_MOMENT_2": s * s + 4 * e["11"] * e["11"],
        "HU_MOMENT_3": c * c + d * d,
        "HU_MOMENT_4": a * a + b * b,
        "HU_MOMENT_5": c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b),
        "HU_MOMENT_6": s * (a * a - b * b) + 4 * e["11"] * a * b,
        "HU_MOMENT_7": d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b),
    }


def _box() -> dict[str, Column]:
    w, h = C("max_col") - C("min_col") + 1, C("max_row") - C("min_row") + 1
    return {
        "BOUNDING_BOX_WIDTH": w.cast("double"),
        "BOUNDING_BOX_HEIGHT": h.cast("double"),
        "DIAGONAL_LENGTH": F.sqrt((w * w + h * h).cast("double")),
        "RECTANGULARITY": _area() / (w * h),
        "RATIO_WH": F.greatest(w, h) / F.least(w, h),
        "BOX_COLUMN_MIN": C("min_col").cast("double"),
        "BOX_COLUMN_MAX": C("max_col").cast("double"),
        "BOX_ROW_MIN": C("min_row").cast("double"),
        "BOX_ROW_MAX": C("max_row").cast("double"),
    }


def _gray() -> dict[str, Column]:
    mean = C("sum_v") / _area()
    return {
        "GRAY_LEVEL": C("level").cast("double"),
        "VOLUME": C("sum_v").cast("double"),
        "RELATIVE_VOLUME": C("sum_ar") - _area() * F.abs(C("residue")),
        "GRAY_LEVEL_HEIGHT": F.greatest(C("max_v") - C("level"), C("level") - C("min_v")).cast("double"),
        "MEAN_GRAY_LEVEL": mean,
        "GRAY_LEVEL_VARIANCE": F.greatest(C("sum_vv") / _area() - mean * mean, F.lit(0.0)),
    }


GROUPS: dict[str, tuple[str, ...]] = {
    "GRAY_LEVEL": ("GRAY_LEVEL", "VOLUME", "RELATIVE_VOLUME", "GRAY_LEVEL_HEIGHT", "MEAN_GRAY_LEVEL", "GRAY_LEVEL_VARIANCE"),
    "BOX": ("AREA", "BOUNDING_BOX_WIDTH", "BOUNDING_BOX_HEIGHT", "DIAGONAL_LENGTH", "RECTANGULARITY", "RATIO_WH", "BOX_COLUMN_MIN", "BOX_COLUMN_MAX", "BOX_ROW_MIN", "BOX_ROW_MAX"),
    "MOMENTS": (*(f"CENTRAL_MOMENT_{p}{q}" for p, q in ((2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (2, 1), (1, 2))), *(f"HU_MOMENT_{i}" for i in range(1, 8)), "LENGTH_MAJOR_AXIS", "LENGTH_MINOR_AXIS", "AXIS_ORIENTATION_SIGNED", "AXIS_ORIENTATION", "ECCENTRICITY", "INERTIA", "COMPACTNESS", "CIRCULARITY", "RAW_INERTIA"),
    "BOUNDARY": ("BITQUAD_AREA", "BITQUAD_NUMBER_EULER", "BITQUAD_NUMBER_HOLES", "BITQUAD_PERIMETER", "BITQUAD_PERIMETER_CONTINUOUS", "BITQUAD_CIRCULARITY", "BITQUAD_PERIMETER_AVERAGE", "BITQUAD_LENGTH_AVERAGE", "BITQUAD_WIDTH_AVERAGE", "CONTOUR_PIXELS", "CONTOUR_PERIMETER", "CONTOUR_SIDE_NORTH", "CONTOUR_SIDE_WEST", "CONTOUR_SIDE_EAST", "CONTOUR_SIDE_SOUTH"),
    "TREE_TOPOLOGY": ("SUBTREE_HEIGHT", "DEPTH_NODE", "IS_LEAF_NODE", "IS_ROOT_NODE", "NUM_CHILDREN_NODE", "NUM_SIBLINGS_NODE", "NUM_DESCENDANTS_NODE", "NUM_LEAF_DESCENDANTS_NODE", "LEAF_RATIO_NODE", "BALANCE_NODE", "AVG_CHILD_HEIGHT_NODE"),
}
_DIST = ("MAX_DIST", "MAX_SQUARED_DIST", "DIST_SQUARED_SUM", "DIST_SQUARED_MEAN", "DIST_RMS", "DIST_SQUARED_VARIANCE", "MAX_DIST_CENTER_ROW", "MAX_DIST_CENTER_COLUMN", "MAX_DIST_PLATEAU_AREA", "MAX_DIST_PLATEAU_CENTROID_ROW", "MAX_DIST_PLATEAU_CENTROID_COLUMN", "DIST_SUM", "DIST_MEAN", "DIST_VARIANCE", "DIST_MEDIAN", "DIST_MODE", "DIST_Q25", "DIST_Q75", "DIST_Q90", "DIST_ENTROPY", "DIST_POSITIVE_AREA", "DIST_LEVEL_COUNT", "DIST_WEIGHTED_CENTROID_ROW", "DIST_WEIGHTED_CENTROID_COLUMN", "DIST_WEIGHTED_CENTRAL_MOMENT_20", "DIST_WEIGHTED_CENTRAL_MOMENT_02", "DIST_WEIGHTED_CENTRAL_MOMENT_11", "DIST_WEIGHTED_AXIS_ORIENTATION", "DIST_WEIGHTED_ECCENTRICITY")
GROUPS["DIST_TRANSF"] = _DIST
GROUPS["DIST_TRANSF_EXACT"] = tuple(f"{n}_EXACT" for n in _DIST)
GROUPS["FILLED_SHAPE"] = ("FILLED_AREA", "FILLED_CENTROID_ROW", "FILLED_CENTROID_COLUMN", "FILLED_LENGTH_MAJOR_AXIS", "FILLED_LENGTH_MINOR_AXIS", "FILLED_AXIS_ORIENTATION", "FILLED_ECCENTRICITY", "FILLED_INERTIA", "HOLE_AREA_FRACTION", "FILLED_CENTROID_DISPLACEMENT_NORMALIZED", "FILLED_COMPACTNESS", "FILLED_CIRCULARITY", "FILLED_AXIS_ORIENTATION_SIGNED")
GROUPS["SHAPE"] = (*GROUPS["BOX"], "MAX_DIST", "MAX_DIST_EXACT", *GROUPS["MOMENTS"], *GROUPS["BOUNDARY"])
GROUPS["ALL"] = tuple(dict.fromkeys(n for g in ("GRAY_LEVEL", "BOX", "MOMENTS", "BOUNDARY", "TREE_TOPOLOGY", "DIST_TRANSF", "DIST_TRANSF_EXACT", "FILLED_SHAPE") for n in GROUPS[g]))


def expand(names: str | list[str]) -> list[str]:
    """Attribute names of names and groups, in order, each once; unknown names fail."""
    out: dict[str, None] = {}
    for n in [names] if isinstance(names, str) else names:
        if n in GROUPS:
            out |= dict.fromkeys(GROUPS[n])
        elif n in GROUPS["ALL"]:
            out[n] = None
        else:
            raise ValueError(f"unknown attribute {n!r}")
    return list(out)


def _base(forest: Forest) -> DataFrame:
    x, y, v = (C(c).cast("double") for c in ("col", "row", "value"))
    # Coordinates from the raster's centre limit cancellation in the higher moments.
    mid = forest.owners.groupBy(*KEY).agg(F.floor(F.avg("row")).alias("r0"), F.floor(F.avg("col")).alias("c0"))
    own = forest.owners.join(mid, KEY).withColumn("xc", x - C("c0")).withColumn("yc", y - C("r0"))
    sums = {"n": F.count(F.lit(1)), "sum_v": F.sum("value"), "sum_vv": F.sum(v * v), "min_v": F.min("value"), "max_v": F.max("value"), "min_row": F.min("row"), "max_row": F.max("row"), "min_col": F.min("col"), "max_col": F.max("col"), **_moments(C("xc"), C("yc"))}
    own = own.groupBy(*NODE).agg(*[a.alias(n) for n, a in sums.items()])
    up = {n: "min" if n.startswith("min") else "max" if n.startswith("max") else "sum" for n in sums}
    base = roll_up(forest, own, **up)
    area = base.select(*NODE, C("n").alias("a"))
    volume = roll_up(forest, forest.nodes.select(*NODE, "residue").join(area, NODE).select(*NODE, (C("a") * (1 + F.abs("residue"))).alias("sum_ar")), sum_ar="sum")
    # Rolled together: each node's area times one more than its residue, less its own residue part.
    return base.join(forest.nodes.select(*NODE, "level", "residue"), NODE).join(volume, NODE)


def _topology(forest: Forest) -> DataFrame:
    r = relatives(forest).join(forest.nodes.select(*NODE, "depth"), NODE)
    below = roll_up(forest, r.select(*NODE, C("depth").alias("deepest"), F.lit(1).alias("n_all"), C("is_leaf").cast("int").alias("n_leaves")), deepest="max", n_all="sum", n_leaves="sum").withColumn("n_below", C("n_all") - 1)
    t = r.join(below, NODE).withColumn("SUBTREE_HEIGHT", (C("deepest") - C("depth")).cast("double"))
    kids = t.where("NOT is_root").groupBy(*KEY, C("parent_id").alias("node_id")).agg((F.max("SUBTREE_HEIGHT") - F.min("SUBTREE_HEIGHT")).alias("balance"), F.avg("SUBTREE_HEIGHT").alias("avg_height"))
    d = lambda c: C(c).cast("double")
    return t.join(kids, NODE, "left").select(*NODE, "SUBTREE_HEIGHT", d("depth").alias("DEPTH_NODE"), d("is_leaf").alias("IS_LEAF_NODE"), d("is_root").alias("IS_ROOT_NODE"), d("num_children").alias("NUM_CHILDREN_NODE"), d("num_siblings").alias("NUM_SIBLINGS_NODE"), d("n_below").alias("NUM_DESCENDANTS_NODE"), d("n_leaves").alias("NUM_LEAF_DESCENDANTS_NODE"), (C("n_leaves") / (C("n_below") + 1)).alias("LEAF_RATIO_NODE"), F.coalesce("balance", F.lit(0.0)).alias("BALANCE_NODE"), F.coalesce("avg_height", F.lit(0.0)).alias("AVG_CHILD_HEIGHT_NODE"))


STEPS = {"NORTH": (-1, 0), "WEST": (0, -1), "EAST": (0, 1), "SOUTH": (1, 0)}


def _meetings(forest: Forest) -> DataFrame:
    """key, row, col, node_id, depth and, for each side, meet and meet_depth: the least node that holds the neighbour there too; null beyond the raster.

    In a max-tree or min-tree that is the higher of two neighbours' nodes; shapes that
    touch may lie apart, and meet in their lowest common ancestor.
    """
    own = forest.owners.select(*KEY, "row", "col", "node_id").join(forest.nodes.select(*NODE, "depth"), NODE)
    near = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.lit(r).alias("r"), F.lit(c).alias("c")) for n, (r, c) in STEPS.items()]))
    beside = own.select(*KEY, C("row").alias("r2"), C("col").alias("c2"), C("node_id").alias("b"), C("depth").alias("b_depth"))
    p = own.withColumn("s", near).withColumn("r2", C("row") + C("s.r")).withColumn("c2", C("col") + C("s.c")).join(beside, [*KEY, "r2", "c2"], "left")
    p = p.select(*KEY, "row", "col", "node_id", "depth", C("s.side").alias("side"), "b", "b_depth")
    if forest.kind != "shapes":
        higher = C("b_depth") < C("depth")
        return p.select(*KEY, "row", "col", "node_id", "depth", "side", F.when(higher, C("b")).when(C("b").isNotNull(), C("node_id")).alias("meet"), F.least("depth", "b_depth").alias("least")).select("*", F.when(C("meet").isNotNull(), C("least")).alias("meet_depth")).drop("least")
    pairs = lowest_common(forest, p.where("b <> node_id").select(*KEY, C("node_id").alias("a"), "b"))
    pairs = pairs.select(*KEY, C("a").alias("node_id"), "b", "meet").join(forest.nodes.select(*KEY, C("node_id").alias("meet"), C("depth").alias("meet_depth")), [*KEY, "meet"])
    p = p.join(pairs, [*NODE, "b"], "left")
    same = C("b") == C("node_id")
    return p.select(*KEY, "row", "col", "node_id", "depth", "side", F.when(same, C("node_id")).otherwise(C("meet")).alias("meet"), F.when(same, C("depth")).otherwise(C("meet_depth")).alias("meet_depth"))


def _sides(forest: Forest) -> DataFrame:
    """Contour sides and pixels: +1 where a pixel enters, -1 where its neighbour joins it."""
    p = _meetings(forest)
    apart = p.where("meet IS NULL OR meet <> node_id")
    deltas = apart.select(*NODE, "side", F.lit(1).alias("d")).unionByName(apart.where("meet IS NOT NULL").select(*KEY, C("meet").alias("node_id"), "side", F.lit(-1).alias("d")))
    # A pixel is on the contour until its last neighbour joins: never, on the border.
    last = p.groupBy(*KEY, "row", "col", "node_id").agg(F.bool_or(C("meet").isNull()).alias("edge"), F.min(F.struct("meet_depth", "meet")).alias("low"))
    on = last.where("edge OR low.meet <> node_id")
    pixels = on.select(*NODE, F.lit("PIXELS").alias("side"), F.lit(1).alias("d")).unionByName(on.where("NOT edge").select(*KEY, C("low.meet").alias("node_id"), F.lit("PIXELS").alias("side"), F.lit(-1).alias("d")))
    wide = deltas.unionByName(pixels).groupBy(*NODE).pivot("side", [*STEPS, "PIXELS"]).sum("d").na.fill(0)
    base = forest.nodes.select(*NODE).join(wide, NODE, "left").na.fill(0)
    up = roll_up(forest, base, **dict.fromkeys([*STEPS, "PIXELS"], "sum"))
    d = lambda c: c.cast("double")
    return up.select(*NODE, d(C("PIXELS")).alias("CONTOUR_PIXELS"), d(C("NORTH") + C("WEST") + C("EAST") + C("SOUTH")).alias("CONTOUR_PERIMETER"), *[d(C(n)).alias(f"CONTOUR_SIDE_{n}") for n in STEPS])


def _quad_states(forest: Forest) -> DataFrame:
    """key, node_id, kind, d: changes of 2x2 pattern counts where corners may enter by different branches.

    The owners of a square's corners and their lowest common ancestors are a small tree:
    along each of its branches the corners held so far make one pattern.
    """
    spans = tree_intervals(forest).join(forest.nodes.select(*NODE, "depth"), NODE)
    corner = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(k).alias("k")) for k, (r, c) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))]))
    q = forest.owners.select(*KEY, "row", "col", "node_id").join(spans, NODE).withColumn("x", corner)
    cell = F.struct("tpre", "tpost", "depth", "node_id", C("x.k").alias("k"))
    q = q.groupBy(*KEY, (C("row") - C("x.r")).alias("qr"), (C("col") - C("x.c")).alias("qc")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    # Squares with the same owners in the same corners count together.
    key = F.transform("cells", lambda x: F.struct(x["tpre"].alias("tpre"), x["k"].alias("k")))
    q = q.withColumn("key", key).groupBy(*KEY, "key").agg(F.first("cells").alias("cells"), F.count(F.lit(1)).alias("n"))
    nodes = F.array_distinct(F.transform("cells", lambda x: x["node_id"]))
    pairs = q.select(*KEY, "key", nodes.alias("o")).where(F.size("o") > 1).select(*KEY, "key", F.explode(F.transform(F.sequence(F.lit(1), F.size("o") - 1), lambda i: F.struct(F.get("o", i - 1).alias("a"), F.get("o", i).alias("b")))).alias("p")).select(*KEY, "key", "p.*")
    met = pairs.join(lowest_common(forest, pairs), [*KEY, "a", "b"]).join(spans.withColumnRenamed("node_id", "meet"), [*KEY, "meet"])
    met = met.groupBy(*KEY, "key").agg(F.collect_set(F.struct("tpre", "tpost", "depth", C("meet").alias("node_id"))).alias("met"))
    q = q.join(met, [*KEY, "key"], "left")
    plain = F.transform("cells", lambda x: F.struct(x["tpre"].alias("tpre"), x["tpost"].alias("tpost"), x["depth"].alias("depth"), x["node_id"].alias("node_id")))
    q = q.withColumn("all", F.array_distinct(F.concat(plain, F.coalesce("met", F.array().cast("array<struct<tpre:bigint,tpost:bigint,depth:int,node_id:bigint>>")))))

    def kind(x: Column) -> Column:
        held = F.transform(F.filter("cells", lambda c: (c["tpre"] >= x["tpre"]) & (c["tpre"] < x["tpost"])), lambda c: c["k"])
        facing = (F.size(held) == 2) & (F.abs(F.element_at(held, 1) - F.try_element_at(held, F.lit(2))) == 2)
        return F.when(facing, "QD").otherwise(F.concat(F.lit("Q"), F.size(held).cast("string")))

    def over(x: Column) -> Column:
        holding = F.filter("all", lambda y: (y["tpre"] < x["tpre"]) & (x["tpre"] < y["tpost"]))
        return F.array_max(F.transform(holding, lambda y: F.struct(y["depth"].alias("depth"), y["node_id"].alias("node_id"))))["node_id"]

    states = q.select(*KEY, "n", F.explode(F.transform("all", lambda x: F.struct(x["node_id"].alias("node_id"), over(x).alias("up"), kind(x).alias("kind")))).alias("s")).select(*KEY, "n", "s.*")
    return states.select(*NODE, "kind", C("n").alias("d")).unionByName(states.where("up IS NOT NULL").select(*KEY, C("up").alias("node_id"), "kind", (-C("n")).alias("d")))


def _quad_chains(forest: Forest) -> DataFrame:
    """The same for trees in which a square's corners lie on one branch: as the level falls, it passes through the patterns of its pixels so far."""
    sign = 1 if forest.kind == "max" else -1
    own = forest.owners.select(*KEY, "row", "col", (C("value") * sign).alias("v"), "node_id")
    corner = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(k).alias("k")) for k, (r, c) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))]))
    q = own.select("*", corner.alias("x")).select(*KEY, (C("row") - C("x.r")).alias("qr"), (C("col") - C("x.c")).alias("qc"), C("x.k").alias("k"), "v", "node_id")
    q = q.groupBy(*KEY, "qr", "qc").agg(F.array_sort(F.collect_list(F.struct((-C("v")).alias("order"), "k", "node_id"))).alias("cells"))
    # One state per distinct level: the corners at or above it; its node is that of the last of them.
    ends = F.filter(F.sequence(F.lit(1), F.size("cells")), lambda i: (i == F.size("cells")) | (F.get("cells", i - 1)["order"] < F.coalesce(F.get("cells", i)["order"], F.lit(1 << 30))))

    def kind(i: Column) -> Column:
        held = F.slice("cells", 1, i)
        facing = F.abs(F.element_at(held, 1)["k"] - F.element_at(held, 2)["k"]) == 2
        return F.when(i == 1, "Q1").when(i == 3, "Q3").when(i == 4, "Q4").when(facing, "QD").otherwise("Q2")

    states = F.transform(ends, lambda i: F.struct(F.get("cells", i - 1)["node_id"].alias("node_id"), kind(i).alias("kind")))
    s = q.select(*KEY, F.posexplode(states).alias("at", "s"), states.alias("all"))
    enter = s.select(*KEY, C("s.node_id").alias("node_id"), C("s.kind").alias("kind"), F.lit(1).alias("d"))
    leave = s.where(C("at") > 0).select(*KEY, C("s.node_id").alias("node_id"), F.get("all", C("at") - 1)["kind"].alias("kind"), F.lit(-1).alias("d"))
    return enter.unionByName(leave)


def _quads(forest: Forest) -> DataFrame:
    """2x2 pattern counts of each node's component."""
    changes = _quad_chains(forest) if forest.kind != "shapes" and forest.radius >= 1.5 else _quad_states(forest)
    kinds = ["Q1", "Q2", "Q3", "Q4", "QD"]
    wide = changes.groupBy(*NODE).pivot("kind", kinds).sum("d").na.fill(0)
    up = roll_up(forest, forest.nodes.select(*NODE).join(wide, NODE, "left").na.fill(0), **dict.fromkeys(kinds, "sum"))
    q1, q2, q3, q4, qd = (C(k).cast("double") for k in kinds)
    euler = (q1 - q3 + (-2 if forest.radius >= 1.5 else 2) * qd) / 4
    area, smooth = q1 / 4 + q2 / 2 + 7 * q3 / 8 + q4 + 3 * qd / 4, q2 + (q1 + q3 + 2 * qd) / math.sqrt(2)
    hard = q1 + q2 + q3 + 2 * qd
    average = F.when(euler != 0, smooth / euler).otherwise(0.0)
    return up.select(*NODE, area.alias("BITQUAD_AREA"), euler.alias("BITQUAD_NUMBER_EULER"), (1 - euler).alias("BITQUAD_NUMBER_HOLES"), hard.alias("BITQUAD_PERIMETER"), smooth.alias("BITQUAD_PERIMETER_CONTINUOUS"), F.when(hard > 0, 4 * math.pi * area / (hard * hard)).otherwise(0.0).alias("BITQUAD_CIRCULARITY"), average.alias("BITQUAD_PERIMETER_AVERAGE"), (average / 2).alias("BITQUAD_LENGTH_AVERAGE"), F.when(smooth > 0, 2 * area / smooth).otherwise(0.0).alias("BITQUAD_WIDTH_AVERAGE"))


def _column_minima(row: np.ndarray, first: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Least gap**2 + step**2 over each run of touching rows; first marks where a run begins."""
    at = np.arange(len(row))
    run = np.cumsum(first) - 1
    low = np.flatnonzero(first)[run]
    high = np.append(np.flatnonzero(first)[1:], len(row))[run]
    best = own = gap * gap
    best = best.copy()
    step, open_ = 1, at
    while len(open_ := open_[best[open_] > step * step]):
        for to in (open_ - step, open_ + step):
            inside = (to >= low[open_]) & (to < high[open_])
            i = open_[inside]
            best[i] = np.minimum(best[i], own[to[inside]] + step * step)
        step += 1
    return best


def distance_field(forest: Forest, max_rows: int | None = None) -> DataFrame:
    """key, node_id, row, col, d2: the exact squared distance of each support pixel to the support's four-contour.

    Separable: the nearest contour pixel in the row, then the best row of the column. Only
    rows of the column that the support joins to the pixel matter: where it ends, a contour
    pixel is nearer than all beyond. Rows stay those of the supports at every step.
    """
    jacobian(forest, max_rows)  # refuses, if asked to
    leave = _meetings(forest).groupBy(*KEY, "row", "col", "node_id").agg(F.min(F.coalesce("meet_depth", F.lit(-1))).alias("leave"), F.first("depth").alias("depth"))
    sup = leave.join(forest.closure, NODE).select(*KEY, C("ancestor_id").alias("node_id"), "row", "col", F.when(C("depth") - C("steps") > C("leave"), C("col")).alias("edge"))
    w = W.partitionBy(*NODE, "row").orderBy("col")
    left = F.last("edge", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    right = F.first("edge", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    gap = F.coalesce(F.least(C("col") - left, right - C("col")).cast("double"), F.lit(float("inf")))
    sup = sup.select(*NODE, "row", "col", gap.alias("gap"))

    def columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, [*NODE, "col"]):
            row = part["row"].to_numpy()
            first = begins(part, [*NODE, "col"]) | np.append(True, row[1:] != row[:-1] + 1)
            yield part.drop(columns="gap").assign(d2=_column_minima(row, first, part["gap"].to_numpy()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sup.select(*NODE, "row", "col").schema)
    return sup.repartition(*NODE, "col").sortWithinPartitions(*NODE, "col", "row").mapInPandas(columns, f"{fields}, d2 double")


def _distances(forest: Forest, max_rows: int | None) -> DataFrame:
    keep = Scratch(forest.nodes.sparkSession, "distances")
    f = keep.keep(distance_field(forest, max_rows), "field").withColumn("d", F.sqrt("d2"))
    top = f.groupBy(*NODE).agg(F.max("d2").alias("top"))
    f = f.join(top, NODE)
    on = C("d2") == C("top")
    x, y, d = C("col").cast("double"), C("row").cast("double"), C("d")
    plateau = lambda c: F.avg(F.when(on, c))
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY d)")
    first = F.min(F.when(on, F.struct("row", "col")))
    t = f.groupBy(*NODE).agg(
        F.max("d").alias("MAX_DIST"), F.max("d2").alias("MAX_SQUARED_DIST"), F.sum("d2").alias("DIST_SQUARED_SUM"), F.avg("d2").alias("DIST_SQUARED_MEAN"),
        F.sqrt(F.avg("d2")).alias("DIST_RMS"), F.var_pop("d2").alias("DIST_SQUARED_VARIANCE"), first.alias("first"), F.count_if(on).cast("double").alias("MAX_DIST_PLATEAU_AREA"),
        plateau(y).alias("MAX_DIST_PLATEAU_CENTROID_ROW"), plateau(x).alias("MAX_DIST_PLATEAU_CENTROID_COLUMN"), F.sum(d).alias("DIST_SUM"), F.avg(d).alias("DIST_MEAN"),
        F.var_pop(d).alias("DIST_VARIANCE"), disc(0.5).alias("DIST_MEDIAN"), F.mode("d", True).alias("DIST_MODE"), disc(0.25).alias("DIST_Q25"), disc(0.75).alias("DIST_Q75"), disc(0.9).alias("DIST_Q90"),
        F.count_if(C("d2") > 0).cast("double").alias("DIST_POSITIVE_AREA"), F.count_distinct("d2").cast("double").alias("DIST_LEVEL_COUNT"),
        F.sum(d * y).alias("dy"), F.sum(d * x).alias("dx"), F.avg(y).alias("my"), F.avg(x).alias("mx"), F.sum(d * x * x).alias("dxx"), F.sum(d * y * y).alias("dyy"), F.sum(d * x * y).alias("dxy"),
    )
    counts = f.groupBy(*NODE, "d2").count().groupBy(*NODE).agg(F.sum("count").alias("m"), F.sum(C("count") * F.log2("count")).alias("mlog"))
    t = t.join(counts.select(*NODE, (F.log2("m") - C("mlog") / C("m")).alias("DIST_ENTROPY")), NODE)
    s = C("DIST_SUM")
    cx, cy = F.when(s > 0, C("dx") / s).otherwise(C("mx")), F.when(s > 0, C("dy") / s).otherwise(C("my"))
    t = t.withColumn("DIST_WEIGHTED_CENTROID_ROW", cy).withColumn("DIST_WEIGHTED_CENTROID_COLUMN", cx).withColumn("MAX_DIST_CENTER_ROW", C("first.row").cast("double")).withColumn("MAX_DIST_CENTER_COLUMN", C("first.col").cast("double"))
    cx, cy = C("DIST_WEIGHTED_CENTROID_COLUMN"), C("DIST_WEIGHTED_CENTROID_ROW")
    t = t.withColumn("mu20", F.greatest(C("dxx") - s * cx * cx, F.lit(0.0))).withColumn("mu02", F.greatest(C("dyy") - s * cy * cy, F.lit(0.0))).withColumn("mu11", C("dxy") - s * cx * cy)
    spread = F.sqrt(F.pow(C("mu20") - C("mu02"), 2) + 4 * C("mu11") * C("mu11"))
    l1, l2 = (C("mu20") + C("mu02") + spread) / 2, F.greatest((C("mu20") + C("mu02") - spread) / 2, F.lit(0.0))
    t = t.withColumn("DIST_WEIGHTED_CENTRAL_MOMENT_20", C("mu20")).withColumn("DIST_WEIGHTED_CENTRAL_MOMENT_02", C("mu02")).withColumn("DIST_WEIGHTED_CENTRAL_MOMENT_11", C("mu11"))
    t = t.withColumn("DIST_WEIGHTED_AXIS_ORIENTATION", F.abs(_signed_orientation())).withColumn("DIST_WEIGHTED_ECCENTRICITY", F.when(l1 <= 0, 1.0).when(l2 * 1e6 <= l1, 1e6).otherwise(l1 / l2))
    t = settle(t.select(*NODE, *[C(n).cast("double").alias(n) for n in _DIST]), "distances")
    keep.close()
    return t.select("*", *[C(n).alias(f"{n}_EXACT") for n in _DIST])


def _filled(forest: Forest) -> DataFrame:
    x, y = C("col").cast("double"), C("row").cast("double")
    sums = {"n": F.count(F.lit(1)), **_moments(x, y)}
    here = forest.owners.groupBy(*NODE).agg(*[c.alias(n) for n, c in sums.items()])
    own = roll_up(forest, here, **dict.fromkeys(sums, "sum"))
    # A shape is filled already, as seen from its seed.
    full = own if forest.kind == "shapes" else filled_components(forest, sums)
    own = own.select(*NODE, C("n").alias("area"), (C("s10") / C("n")).alias("x0"), (C("s01") / C("n")).alias("y0"))
    t = _mus(full).join(own, NODE)
    cx, cy = C("s10") / C("n"), C("s01") / C("n")
    shape = {f"FILLED_{n}": c for n, c in _inertia_shape(_area()).items() if n != "RAW_INERTIA"}
    gone = F.sqrt(F.pow(cx - C("x0"), 2) + F.pow(cy - C("y0"), 2)) / F.sqrt(_area())
    extra = {"FILLED_AREA": _area(), "FILLED_CENTROID_ROW": cy, "FILLED_CENTROID_COLUMN": cx, "HOLE_AREA_FRACTION": 1 - C("area") / _area(), "FILLED_CENTROID_DISPLACEMENT_NORMALIZED": gone}
    return t.select(*NODE, *[c.alias(n) for n, c in (extra | shape).items()])


def compute(forest: Forest, attributes: str | list[str], dtype: str = "double", max_support_rows: int | None = None) -> DataFrame:
    """key, node_id and a column for each attribute, rolling up only what the request needs.

    Distances need the supports of all nodes, as many rows as the sum of areas; with
    max_support_rows they fail beyond it, with that size.
    """
    names = expand(attributes)
    out = forest.nodes.select(*NODE)
    has = lambda *groups: any(n in GROUPS[g] for g in groups for n in names)
    if has("GRAY_LEVEL", "BOX", "MOMENTS"):
        base = _mus(_base(forest))
        central = {f"CENTRAL_MOMENT_{p}{q}": C(f"mu{p}{q}") for p in range(4) for q in range(4 - p) if p + q >= 2}
        made = {"AREA": _area(), **_gray(), **_box(), **central, **_hu(), **_inertia_shape(_area())}
        out = out.join(base.select(*NODE, *[made[n].alias(n) for n in names if n in made]), NODE)
    if any(n.startswith("CONTOUR") for n in names):
        out = out.join(_sides(forest), NODE)
    if any(n.startswith("BITQUAD") for n in names):
        out = out.join(_quads(forest), NODE)
    if has("TREE_TOPOLOGY"):
        out = out.join(_topology(forest), NODE)
    if has("DIST_TRANSF", "DIST_TRANSF_EXACT"):
        out = out.join(_distances(forest, max_support_rows), NODE)
    if has("FILLED_SHAPE"):
        out = out.join(_filled(forest), NODE)
    return out.select(*NODE, *[C(n).cast(dtype).alias(n) for n in names])
