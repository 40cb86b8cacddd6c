"""Trees of tiles: each task builds the tree of its own pixels; only the rims of tiles meet afterwards.

The tree of a graph with levels at its vertices has a node for each connected component of
the vertices at or above a level. Trees of parts are such graphs themselves: their nodes,
the links to parents, and the edges between parts have the same tree as all the pixels. So
neighbouring parts merge by growing the tree of their rims (the nodes that edges to other
parts reach, and those above them), and nodes off the rims are final.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import KEY, Scratch, begins, in_portions, whole_groups

#: Trees to build at once, each a sign (1: of bright components, -1: of dark ones) and a radius; channel modulo their number tells which.
Kinds = list[tuple[int, float]]
#: Rows and columns of a tile, and how many parts by side a merge takes in, as powers of two.
TILE_BITS = 9
FAN_BITS = 3


def steps_within(radius: float) -> list[tuple[int, int]]:
    """Each pair of opposite steps to pixels within the radius once (1: four, 1.5: eight neighbours)."""
    reach = int(radius)
    return [(r, c) for r in range(0, reach + 1) for c in range(-reach, reach + 1) if (r, c) > (0, 0) and r * r + c * c <= radius * radius]


def grown(levels: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tree of a graph: the node of each vertex (its least vertex) and the parent of each node.

    Edges come in the order of their lower ends, highest first. An edge joins two trees at
    their roots: roots of one level become one node, else the lower is the other's parent.
    """
    order = np.argsort(-np.minimum(levels[u], levels[v]), kind="stable")
    level, n = levels.tolist(), len(levels)
    link, size, top = list(range(n)), [1] * n, list(range(n))
    node, parent = list(range(n)), list(range(n))
    for a, b in zip(u[order].tolist(), v[order].tolist()):
        while link[a] != a:
            link[a] = a = link[link[a]]
        while link[b] != b:
            link[b] = b = link[link[b]]
        if a == b:
            continue
        x, y = top[a], top[b]
        if level[x] == level[y]:
            x, y = (x, y) if x < y else (y, x)
            node[y] = x
        elif level[x] > level[y]:
            parent[x] = y
            x = y
        else:
            parent[y] = x
        if size[a] < size[b]:
            a, b = b, a
        link[b] = a
        size[a] += size[b]
        top[a] = x
    for i in range(n):  # a node's number is never above its vertices'
        node[i] = node[node[i]]
    node_of, up = np.array(node, dtype=np.int64), np.array(parent, dtype=np.int64)
    return node_of, node_of[up]


def grid_edges(at: np.ndarray, rank: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the vertices of a grid (-1: none), without those that a path of edges as high makes needless."""
    h, w = at.shape
    cut = lambda r, c: (slice(max(0, -r), h - max(0, r)), slice(max(0, -c), w - max(0, c)))
    level = np.where(at >= 0, rank[at], -1)
    us, vs = [], []
    for r, c in steps_within(radius):
        if r >= h or abs(c) >= w:
            continue
        a, b = at[cut(r, c)], at[cut(-r, -c)]
        there = (a >= 0) & (b >= 0)
        low = np.minimum(level[cut(r, c)], level[cut(-r, -c)])
        if (r, abs(c)) == (1, 1):
            # The two pixels beside a diagonal step: one as high leads around it.
            left, right = (level[:-1, 1:], level[1:, :-1]) if c == 1 else (level[:-1, :-1], level[1:, 1:])
            there &= np.maximum(left, right) < low
        elif radius < 2 and h > 1 and w > 1:
            there &= ~needless(level, r == 0)
        us.append(a[there])
        vs.append(b[there])
    return np.concatenate(us) if us else np.empty(0, dtype=np.int64), np.concatenate(vs) if vs else np.empty(0, dtype=np.int64)


def needless(level: np.ndarray, across: bool) -> np.ndarray:
    """Of the edges along rows (across) or columns, those that are the lowest of a square of four; numbers break ties."""
    h, w = level.shape
    base = 2 * h * w
    rows = np.minimum(level[:, :-1], level[:, 1:]) * base + np.arange(h * w).reshape(h, w)[:, :-1]
    cols = np.minimum(level[:-1], level[1:]) * base + h * w + np.arange(h * w).reshape(h, w)[:-1]
    whole = np.minimum(np.minimum(level[:-1, :-1], level[:-1, 1:]), np.minimum(level[1:, :-1], level[1:, 1:])) >= 0
    least = np.minimum(np.minimum(rows[:-1], rows[1:]), np.minimum(cols[:, :-1], cols[:, 1:]))
    out = np.zeros((h, w - 1) if across else (h - 1, w), dtype=bool)
    if across:
        out[:-1] |= whole & (rows[:-1] == least)
        out[1:] |= whole & (rows[1:] == least)
    else:
        out[:, :-1] |= whole & (cols[:, :-1] == least)
        out[:, 1:] |= whole & (cols[:, 1:] == least)
    return out


def tile_trees(pixels: DataFrame, kinds: Kinds, bits: int) -> DataFrame:
    """Each pixel with ti, tj (its tile), node_id and parent_id in the tile's tree; the pixel that names a node also has its n pixels and whether it is on the rim."""
    side = 1 << bits

    def grow(sign: int, radius: float, ids: np.ndarray, r: np.ndarray, c: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
        reach, n = int(radius), len(ids)
        _, rank = np.unique(sign * value, return_inverse=True)
        at = np.full((np.ptp(r) + 1, np.ptp(c) + 1), -1, dtype=np.int64)
        at[r - r.min(), c - c.min()] = np.arange(n)
        node, parent = grown(rank, *grid_edges(at, rank, radius))
        rim = np.zeros(n, dtype=bool)
        rim[node[(r < reach) | (c < reach) | (r >= side - reach) | (c >= side - reach)]] = True
        for i in np.argsort(-rank[node], kind="stable").tolist():  # nodes above rim nodes are on it
            if rim[node[i]]:
                rim[parent[node[i]]] = True
        return ids[node], ids[parent[node]], np.bincount(node, minlength=n), rim

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, tile):
            starts = np.append(np.flatnonzero(begins(part, tile)), len(part))
            channel, ids, value = (part[c].to_numpy() for c in ("channel", "pixel_id", "value"))
            r, c = part["row"].to_numpy() % side, part["col"].to_numpy() % side
            done = [grow(*kinds[channel[lo] % len(kinds)], ids[lo:hi], r[lo:hi], c[lo:hi], value[lo:hi]) for lo, hi in zip(starts, starts[1:])]
            node, parent, n, rim = (np.concatenate(x) for x in zip(*done))
            yield part.assign(node_id=node, parent_id=parent, n=n, rim=rim)

    tile = [*KEY, "ti", "tj"]
    tiled = pixels.where(F.col("value").isNotNull()).select(*KEY, "pixel_id", "row", "col", "value", F.shiftright("row", bits).alias("ti"), F.shiftright("col", bits).alias("tj"))
    fields = ", ".join(f"{name} {kind}" for name, kind in tiled.withColumn("pixel_id", F.col("pixel_id").cast("long")).dtypes)
    # A task goes through its tiles one after the other, whole rasters of a few pixels many at a time.
    return in_portions(tiled, tile).sortWithinPartitions(*tile, "pixel_id").mapInPandas(run, f"{fields}, node_id long, parent_id long, n long, rim boolean")


def rim_edges(local: DataFrame, kinds: Kinds, bits: int) -> DataFrame:
    """Pairs of nodes of different tiles with neighbouring pixels."""
    widest = max(radius for _, radius in kinds)
    side, reach = 1 << bits, int(widest)
    within = F.get(F.array(*[F.lit(radius * radius) for _, radius in kinds]), F.col("channel") % len(kinds))
    r, c = F.col("row") % side, F.col("col") % side
    near = local.where((r < reach) | (c < reach) | (r >= side - reach) | (c >= side - reach)).select(*KEY, "row", "col", "node_id", "ti", "tj")
    step = F.explode(F.array(*[F.struct(F.lit(x).alias("r"), F.lit(y).alias("c")) for x, y in steps_within(widest)]))
    left = near.select(*KEY, "row", "col", F.col("node_id").alias("u"), F.col("ti").alias("ui"), F.col("tj").alias("uj"), step.alias("s"))
    left = left.where(F.col("s.r") * F.col("s.r") + F.col("s.c") * F.col("s.c") <= within)
    left = left.withColumn("row", F.col("row") + F.col("s.r")).withColumn("col", F.col("col") + F.col("s.c")).drop("s")
    right = near.select(*KEY, "row", "col", F.col("node_id").alias("v"), F.col("ti").alias("vi"), F.col("tj").alias("vj"))
    met = left.join(right, [*KEY, "row", "col"]).where("ui <> vi OR uj <> vj")
    return met.select(*KEY, "u", "ui", "uj", "v", "vi", "vj").distinct()


def merged(part: pd.DataFrame, kinds: Kinds) -> pd.DataFrame:
    """One merge: rows of kind 0 are nodes, of 1 edges within, of 2 nodes that edges lead out of.

    Gives nodes that are final (0), nodes that stay on the rim (1) and what nodes became (2).
    """
    sign, _ = kinds[part["channel"].iloc[0] % len(kinds)]
    nodes = part[part.kind == 0].sort_values("a")
    ids = nodes["a"].to_numpy()
    _, rank = np.unique(sign * nodes["level"].to_numpy(), return_inverse=True)
    place = lambda x: np.searchsorted(ids, x.to_numpy())
    edges = part[part.kind == 1]
    u, v = np.concatenate([np.arange(len(ids)), place(edges["a"])]), np.concatenate([place(nodes["b"]), place(edges["b"])])
    node, parent = grown(rank, u[u != v], v[u != v])
    rim = np.zeros(len(ids), dtype=bool)
    rim[node[place(part[part.kind == 2]["a"])]] = True
    for i in np.argsort(-rank, kind="stable").tolist():
        if rim[node[i]]:
            rim[parent[node[i]]] = True
    n = np.bincount(node, nodes["n"].to_numpy(), minlength=len(ids)).astype(np.int64)
    head = node == np.arange(len(ids))
    key = {k: part[k].iloc[0] for k in (*KEY, "gi", "gj")}
    kept = pd.DataFrame({**key, "kind": rim[head].astype(np.int32), "a": ids[head], "b": ids[parent[head]], "level": nodes["level"].to_numpy()[head], "n": n[head]})
    gone = pd.DataFrame({**key, "kind": np.int32(2), "a": ids[~head], "b": ids[node[~head]], "level": nodes["level"].to_numpy()[~head], "n": np.int64(0)})
    return pd.concat([kept, gone], ignore_index=True)


def merged_tiles(local: DataFrame, edges: DataFrame, kinds: Kinds, rounds: int, keep: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Nodes (key, node_id, parent_id, level, n) of whole rasters, and what nodes of tiles became (key, node_id, became)."""
    heads = local.where("node_id = pixel_id").select(*KEY, F.col("ti").alias("gi"), F.col("tj").alias("gj"), F.col("node_id").alias("a"), F.col("parent_id").alias("b"), F.col("value").alias("level"), "n", "rim")
    final = [heads.where("NOT rim").drop("rim")]
    rim = heads.where("rim").drop("rim")
    cols, became = [*KEY, "gi", "gj", "kind", "a", "b", "level", "n"], []
    schema = rim.withColumn("kind", F.lit(0)).select(cols).schema
    none = F.lit(0).cast(schema["level"].dataType).alias("level")  # no null turns levels into floats
    for _ in range(rounds):
        up = lambda c: F.shiftright(c, FAN_BITS)
        edges = edges.withColumns({c: up(c) for c in ("ui", "uj", "vi", "vj")})
        inside = (F.col("ui") == F.col("vi")) & (F.col("uj") == F.col("vj"))
        ends = lambda s: edges.where(~inside).select(*KEY, F.col(f"{s}i").alias("gi"), F.col(f"{s}j").alias("gj"), F.lit(2).alias("kind"), F.col(s).alias("a"), F.col(s).alias("b"), none, F.lit(0).cast("long").alias("n"))
        rows = rim.withColumns({"gi": up("gi"), "gj": up("gj"), "kind": F.lit(0)}).select(cols)
        rows = rows.unionByName(edges.where(inside).select(*KEY, F.col("ui").alias("gi"), F.col("uj").alias("gj"), F.lit(1).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), none, F.lit(0).cast("long").alias("n")))
        rows = rows.unionByName(ends("u").unionByName(ends("v")).distinct())
        done = keep.keep(rows.groupBy(*KEY, "gi", "gj").applyInPandas(lambda part: merged(part, kinds)[cols], schema), "merged")
        final.append(done.where("kind = 0").drop("kind"))
        rim = done.where("kind = 1").drop("kind")
        gone = done.where("kind = 2").select(*KEY, F.col("a").alias("node_id"), F.col("b").alias("became"))
        became.append(gone)
        edges = edges.where(~inside)
        for s in ("u", "v"):
            edges = edges.join(gone.withColumnRenamed("node_id", s), [*KEY, s], "left").withColumn(s, F.coalesce("became", s)).drop("became")
        edges = keep.keep(edges.distinct(), "edges")
    final.append(rim)
    nodes = final[0]
    for more in final[1:]:
        nodes = nodes.unionByName(more)
    nodes = nodes.select(*KEY, F.col("a").alias("node_id"), F.col("b").alias("parent_id"), "level", "n")
    if not became:
        return nodes, None
    whole = became[-1]
    for gone in became[-2::-1]:  # what became something that a later merge changed again
        later = whole.select(*KEY, F.col("node_id").alias("became"), F.col("became").alias("last"))
        whole = whole.unionByName(gone.join(later, [*KEY, "became"], "left").select(*KEY, "node_id", F.coalesce("last", "became").alias("became")))
    whole = keep.keep(whole, "became")
    up = whole.select(*KEY, F.col("node_id").alias("parent_id"), "became")
    nodes = nodes.join(up, [*KEY, "parent_id"], "left").withColumn("parent_id", F.coalesce("became", "parent_id")).drop("became")
    return nodes, whole
