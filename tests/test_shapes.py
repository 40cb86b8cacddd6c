"""The tree of shapes, the grain filter and filled components against sets of pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterforest.operators import attributes, filters, trees
from rasterforest.plans.shapes import INTERPOLATIONS, shape_tree
from rasterforest.plans.trees import build

PIXELS = "image_id string, channel int, row int, col int, pixel_id long, value int"
RNG = np.random.default_rng(3)
NESTED = np.zeros((9, 9), int)
NESTED[1:8, 1:8], NESTED[2:7, 2:7], NESTED[3:6, 3:6], NESTED[4, 4] = 5, 1, 5, 3
IMAGES = {
    "random": RNG.integers(0, 4, (6, 7)),
    "binary": RNG.integers(0, 2, (7, 7)),
    "saddle": np.array([[1, 0], [0, 1]]),
    "nested": NESTED,
    "const": np.full((2, 3), 7),
    "dark": 9 - NESTED,
    "line": np.array([[1, 3, 2, 4]]),
}
STEPS = {1.0: [(0, 1), (1, 0), (0, -1), (-1, 0)], 1.5: [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]}


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(k, 0, r, c, r * im.shape[1] + c, int(im[r, c])) for k, im in IMAGES.items() for r in range(im.shape[0]) for c in range(im.shape[1])]
    return spark.createDataFrame(rows, PIXELS).cache()


@pytest.fixture(scope="module")
def self_dual(pixels):
    return trees.tree_of_shapes(pixels)


def parts(on, radius):
    """Connected components of a set of (row, col)."""
    left, out = set(on), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            r, c = todo.pop()
            for dr, dc in STEPS[radius]:
                if (q := (r + dr, c + dc)) in left:
                    left.discard(q)
                    part.add(q)
                    todo.append(q)
        out.append(frozenset(part))
    return out


def flooded(image, seed):
    """The image between and at the pixels of a grid of 2n - 1: each place takes the value within its span that the flood from the seed brings."""
    h, w = 2 * image.shape[0] - 1, 2 * image.shape[1] - 1
    span = {}
    for r, c in np.ndindex(h, w):
        around = [int(image[y, x]) for y in {r // 2, (r + 1) // 2} for x in {c // 2, (c + 1) // 2}]
        span[r, c] = (min(around), max(around))
    start = (2 * seed[0], 2 * seed[1])
    level, out, waiting = span[start][0], {}, {start: span[start][0]}
    while waiting:
        p = min(waiting, key=lambda q: (abs(waiting[q] - level), q))
        level = out[p] = waiting.pop(p)
        for dr, dc in STEPS[1.0]:
            if (q := (p[0] + dr, p[1] + dc)) in span and q not in out and q not in waiting:
                waiting[q] = min(max(level, span[q][0]), span[q][1])
    return np.array([[out[r, c] for c in range(w)] for r in range(h)])


def shapes(image, interpolation, seed):
    """Node (least own pixel) to level, parent, own pixels and area, from all filled components."""
    dark, bright = INTERPOLATIONS[interpolation]
    if interpolation == "self-dual":
        grid, seed = flooded(image, seed), (2 * seed[0], 2 * seed[1])
        pixel = {(2 * r, 2 * c): (r, c) for r, c in np.ndindex(image.shape)}
    else:
        grid, pixel = image, {p: p for p in np.ndindex(image.shape)}
    every = frozenset(np.ndindex(grid.shape))
    found = {every}
    for t in np.unique(grid):
        for on, own, other in (({p for p in every if grid[p] >= t}, bright, dark), ({p for p in every if grid[p] <= t}, dark, bright)):
            for part in parts(on, own):
                outside = [p for p in parts(every - part, other) if seed in p]
                found.add(every - outside[0] if outside else every)
    # In pixels; shapes without pixels of their own go.
    found = {frozenset(pixel[p] for p in s if p in pixel) for s in found} - {frozenset()}
    chain = {p: sorted((s for s in found if p in s), key=len) for p in pixel.values()}
    assert all(a < b for c in chain.values() for a, b in zip(c, c[1:]))
    own = {}
    for p, c in chain.items():
        own.setdefault(c[0], []).append(p)
    name = {s: min(r * image.shape[1] + c for r, c in ps) for s, ps in own.items()}
    out = {}
    for s, ps in own.items():
        up = next((x for x in sorted(own, key=len) if s < x), s)
        assert len({int(image[p]) for p in ps}) == 1
        out[name[s]] = (int(image[ps[0]]), name[up], len(ps), len(s))
    return out


@pytest.mark.parametrize("interpolation,seed", [("self-dual", (0, 0)), ("min4-max8", (0, 0)), ("min8-max4", (1, 1))])
def test_shapes_match_filled_sets(pixels, self_dual, interpolation, seed):
    few = pixels if seed[0] == 0 else pixels.where("image_id <> 'line'")
    forest = self_dual if interpolation == "self-dual" else build(few, "shapes", interpolation=interpolation, seed=seed)
    assert trees.validate_tree(forest).count() == 0
    area = {(r["image_id"], r["node_id"]): r["area"] for r in filters.area_of(forest).collect()}
    got = {(r["image_id"], r["node_id"]): (r["level"], r["parent_id"], r["proper_area"], area[r["image_id"], r["node_id"]]) for r in forest.nodes.collect()}
    want = {(k, n): v for k, im in IMAGES.items() if k != "line" or seed[0] == 0 for n, v in shapes(im, interpolation, seed).items()}
    assert got == want
    assert trees.reconstruct_levels(forest).join(few.select("image_id", "pixel_id", F.col("value").alias("old")), ["image_id", "pixel_id"]).where("value <> old").count() == 0


def test_small_and_large_rasters_have_the_same_trees(spark, pixels, self_dual):
    mixed = shape_tree(pixels, tile_bits=2)  # sides of 5 and more from component trees
    for a, b, key in ((self_dual.nodes, mixed.nodes, "node_id"), (self_dual.owners, mixed.owners, "pixel_id"), (filters.area_of(self_dual), filters.area_of(mixed), "node_id")):
        rows = [[tuple(r) for r in t.select(sorted(t.columns)).orderBy("image_id", key).collect()] for t in (a, b)]
        assert rows[0] == rows[1]


def test_shapes_of_small_rasters_take_few_jobs(spark, pixels):
    spark.sparkContext.setJobGroup("shapes", "")
    trees.tree_of_shapes(pixels)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("shapes")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 80


def test_refusals(pixels, self_dual):
    with pytest.raises(ValueError, match="seed"):
        build(pixels, "shapes", seed=(2, 0))
    with pytest.raises(ValueError, match="interpolation"):
        build(pixels, "shapes", interpolation="linear")
    with pytest.raises(ValueError, match="every pixel"):
        build(pixels.where("pixel_id <> 1"), "shapes")
    with pytest.raises(ValueError, match="max-tree"):
        filters.extinction_values(self_dual, filters.area_of(self_dual).withColumnRenamed("area", "value"))


def test_grain_filter_is_self_dual(pixels):
    out = filters.grain_filter(pixels.where("image_id IN ('nested', 'dark')"), 10).toPandas()
    a, b = (out[out.image_id == k].sort_values("pixel_id").value.to_numpy() for k in ("nested", "dark"))
    assert (a == 9 - b).all() and a.reshape(9, 9)[4, 4] == 1 and a.max() == 5


@pytest.mark.parametrize("kind,radius", [("max", 1.0)])
def test_filled_areas(pixels, kind, radius):
    forest = build(pixels, kind, radius)
    got = attributes.compute(forest, ["FILLED_AREA", "FILLED_CENTROID_ROW", "AREA"]).toPandas()
    levels = {(r["image_id"], r["node_id"]): r["level"] for r in forest.nodes.collect()}
    other = 1.0 if radius >= 1.5 else 1.5
    for r in got.itertuples():
        image = IMAGES[r.image_id]
        every = set(np.ndindex(image.shape))
        t = levels[r.image_id, r.node_id]
        at = divmod(r.node_id, image.shape[1])
        part = next(p for p in parts({p for p in every if (image[p] >= t if kind == "max" else image[p] <= t)}, radius) if at in p)
        h, w = image.shape
        holes = [p for p in parts(every - part, other) if not any(x in (0, h - 1) or y in (0, w - 1) for x, y in p)]
        full = part.union(*holes)
        assert (r.AREA, r.FILLED_AREA) == (len(part), len(full))
        assert r.FILLED_CENTROID_ROW == pytest.approx(np.mean([p[0] for p in full]))


def bit_quads(part, radius):
    """Counts of 2x2 patterns of one support."""
    r0, r1, c0, c1 = (f(p[i] for p in part) for i in (0, 1) for f in (min, max))
    n = [0] * 6
    for r in range(r0 - 1, r1 + 1):
        for c in range(c0 - 1, c1 + 1):
            on = [(y, x) in part for y, x in ((r, c), (r, c + 1), (r + 1, c + 1), (r + 1, c))]
            n[5 if sum(on) == 2 and on[0] == on[2] else sum(on)] += 1
    return n


@pytest.mark.parametrize("kind,radius", [("max", 1.0), ("shapes", 1.0)])
def test_contours_quads_and_distances(pixels, self_dual, kind, radius):
    forest = self_dual if kind == "shapes" else build(pixels, kind, radius)
    names = ["BITQUAD_AREA", "BITQUAD_NUMBER_EULER", "BITQUAD_PERIMETER", "CONTOUR_PIXELS", "CONTOUR_PERIMETER", "CONTOUR_SIDE_WEST", "DIST_SQUARED_SUM", "MAX_SQUARED_DIST", "FILLED_AREA"]
    got = attributes.compute(forest, names).toPandas()
    support = {}
    for r in trees.jacobian(forest).collect():
        support.setdefault((r["image_id"], r["node_id"]), set()).add((r["row"], r["col"]))
    assert len(got) == len(support) > 15
    for r in got.itertuples():
        part = support[r.image_id, r.node_id]
        n = bit_quads(part, radius)
        euler = (n[1] - n[3] + (-2 if kind != "shapes" and radius >= 1.5 else 2) * n[5]) / 4
        assert (r.BITQUAD_AREA, r.BITQUAD_NUMBER_EULER, r.BITQUAD_PERIMETER) == (n[1] / 4 + n[2] / 2 + 7 * n[3] / 8 + n[4] + 3 * n[5] / 4, euler, n[1] + n[2] + n[3] + 2 * n[5])
        sides = [(y, x, dy, dx) for y, x in part for dy, dx in STEPS[1.0] if (y + dy, x + dx) not in part]
        edge = {s[:2] for s in sides}
        assert (r.CONTOUR_PIXELS, r.CONTOUR_PERIMETER, r.CONTOUR_SIDE_WEST) == (len(edge), len(sides), sum(s[2:] == (0, -1) for s in sides))
        d2 = [min((y - a) ** 2 + (x - b) ** 2 for a, b in edge) for y, x in part]
        assert (r.DIST_SQUARED_SUM, r.MAX_SQUARED_DIST) == (sum(d2), max(d2))
        if kind == "shapes":
            assert r.FILLED_AREA == len(part)
