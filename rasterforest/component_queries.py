"""Registered queries of scorers, losses, value conversion, contents, patches and split statistics, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import datasets, fitting, metrics, patches, scoring, stats, trees
from .oracles import PATCHES, PIXELS, PREDICTIONS, RASTERS, SCORE1, SCORE2, tree
from .queries import SPECS, _images, _marks, forest, predictions, r6, raster, table
from .sources import channel_first, check_same_shape, invert, resize_area, resize_nearest, scale, to_u8, validate_intensity
from .tables import KEY

NODE = trees.NODE
MLP = [
    scoring.Spec("relu", ("AREA", "GRAY_LEVEL"), (0.5, -0.25), 0.1, 2.0, clamp=3.0, keep_root=True, layers=((((0.01, 0.1), (-0.02, 0.2)), (0.5, -0.25)),)),
    scoring.Spec("tanh", ("AREA", "GRAY_LEVEL"), (1.0,), -0.5, 1.0, layers=((((0.01, 0.1),), (0.25,)),), activation="tanh"),
    scoring.Spec("gelu", ("AREA", "GRAY_LEVEL"), (0.75,), 0.0, 1.5, layers=((((0.01, -0.1),), (0.25,)),), activation="gelu"),
]
#: Fixed values of orders.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LOSSES = {"squared": fitting.squared(15.0), "cross_entropy": fitting.cross_entropy(2.0, 5.0)}


def loss_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both losses of the first spec's filter against the pixels of level 8 and above, and their derivatives."""
    f, marks = _marks(spark, sf_dir)
    target = raster(spark, sf_dir).withColumn("value", (F.col("value") >= 8).cast("int"))
    out = None
    for name, loss in LOSSES.items():
        at = fitting.losses(f, marks, SPECS[:1], target, loss)
        # Derivatives of the sum over all pixels, then of their mean.
        d = fitting.gradient(f, marks, SPECS[0], target, loss, 1)
        one = at.crossJoin(F.broadcast(d))  # one row each
        one = one.select(F.lit(name).alias("loss_name"), "n", "loss", *[(F.col(f"d_{a}") / F.col("n")).alias(f"d_{a.lower()}") for a in ("AREA", "GRAY_LEVEL", "bias")])
        out = one if out is None else out.unionByName(one)
    return r6(out, "loss", "d_area", "d_gray_level", "d_bias")


def node_scores_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(scoring.node_scores(*_marks(spark, sf_dir), MLP), "score").select("image_id", "node_id", "spec", "score")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level gate between two levels, nearly hard."""
    out = scoring.predict(*_marks(spark, sf_dir), [scoring.soft_threshold("level", "GRAY_LEVEL", 5.5)])
    return r6(out, "value").select("image_id", "pixel_id", "value")


def node_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel's column number summed over the nodes' supports."""
    f = forest(spark, sf_dir)
    out = scoring.pixels_to_nodes(f, raster(spark, sf_dir).withColumn("value", F.col("col")))
    return out.select("image_id", "node_id", F.col("value").cast("long").alias("value"))


def events_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of events by the smallest node over their pixel."""
    e = table(spark, sf_dir, "events").where("user_id >= 0 AND event_type IS NOT NULL")
    hour = F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000), F.lit(24)).cast("int")
    at = e.groupBy(F.col("event_type").alias("image_id"), F.lit(0).alias("channel"), hour.alias("row"), (F.col("user_id") % 32).cast("int").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return trees.smallest_node(forest(spark, sf_dir), at).groupBy("image_id", "node_id").agg(F.sum("n").cast("long").alias("n_events"))


def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.score_diagnostics(scoring.node_scores(*_marks(spark, sf_dir), SPECS))
    out = out.select("*", F.explode("histogram").alias("bin", "n")).drop("histogram")
    return r6(out, "mean", "low", "high", "saturation", "acceptance")


def edge_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.edge_violations(scoring.node_scores(*_marks(spark, sf_dir), SPECS[:1]))
    return r6(out, "total", "squares", "worst").drop("channel")


def attribute_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.rank_attributes(scoring.attribute_ablation(_marks(spark, sf_dir)[1], SPECS[:1]))
    return r6(out, "mean", "std", "percent").withColumn("rank", F.col("rank").cast("long"))


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the raster of clicks: raw and normalized areas and the scores of the latter."""
    f, marks = _marks(spark, sf_dir)
    raw = marks.select(*NODE, F.col("AREA").alias("raw_area"))
    norm = stats.normalize(marks, ["AREA", "GRAY_LEVEL"], stats.fit_stats(marks, ["AREA", "GRAY_LEVEL"]), NODE, "minmax01")
    out = scoring.inspect(f, raw, norm, SPECS[:1], "click")
    return r6(out, "raw_area", "norm_AREA", "score").select("image_id", "node_id", F.col("residue").cast("long").alias("residue"), "raw_area", F.col("norm_AREA").alias("norm_area"), "score")


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors' rasters as shares of 16, as bytes, inverted, scaled."""
    px = raster(spark, sf_dir, "V").withColumn("value", F.col("value") / 16)
    return r6(scale(invert(to_u8(px))), "value").select("image_id", "pixel_id", "value")


def resized_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(resize_area(raster(spark, sf_dir), 9, 11), "value").select("image_id", "pixel_id", "value")


def resized_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resize_nearest(raster(spark, sf_dir), 9, 48)
    return out.select("image_id", "pixel_id", F.col("value").cast("long").alias("value"))


def intensity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rasters of their components: as they are, as sizes, 5 and 2,000 times their sizes by turns."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "x"))
    size, turn = F.abs("x"), F.pmod("vec_id", F.lit(4))
    value = F.when(turn == 0, F.col("x")).when(turn == 1, size).when(turn == 2, size * 5).otherwise(size * 2000)
    px = v.select(F.col("vec_id").cast("string").alias("image_id"), F.lit(0).alias("channel"), value.alias("value"))
    return validate_intensity(px).select("image_id", "issue")


def shape_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' rasters against those of the types after 'm', at half the rows."""
    px = raster(spark, sf_dir)
    half = resize_nearest(px.where("image_id > 'm'"), 12, 32)
    out = check_same_shape(px, half)
    return out.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("left_rows", "left_cols", "right_rows", "right_cols")])


def channel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters as rows of values, two channels each: the values and their complements."""
    px = raster(spark, sf_dir, "V")
    both = px.unionByName(px.withColumn("channel", F.lit(1)).withColumn("value", 15 - F.col("value")))
    text = F.array_join(F.transform("channels", lambda c: F.array_join(c.cast("array<string>"), ",")), "|")
    return channel_first(both).select("image_id", F.size("channels").cast("long").alias("n_channels"), F.md5(text).alias("digest"))


def content_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of vectors' rasters as two levels: the raster that stands for each, and its entry's key."""
    px = raster(spark, sf_dir, "V").where("row = 0").withColumn("value", (F.col("value") >= 8).cast("int"))
    digests = datasets.pixel_digest(px)
    kept, bound = datasets.dedupe_images(px, digests)
    n = kept.groupBy(F.col("image_id").alias("entry_image")).agg(F.sum("value").cast("long").alias("level_sum"))
    keys = datasets.content_key(digests, "max", ["AREA", "VOLUME"]).select("image_id", "entry_key")
    return bound.join(keys, "image_id").join(n, "entry_image").select("image_id", "entry_image", "entry_key", "level_sum")


def patch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(raster(spark, sf_dir))
    out = patches.coverage(images, patches.patch_grid(images, 8, 6), 8)
    return out.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("row", "col", "n")])


def patch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distance of the cores' values to 7, weighted by level, with the mean level beside it."""
    px = raster(spark, sf_dir)
    got = patches.extract_patches(px, patches.patch_grid(_images(px), 8, 6), 8, 2)
    v = F.col("value").cast("double")
    return r6(patches.patch_weighted_loss(got, (v - 7) * (v - 7), v + 1, v, 0.5), "loss")


def normalize_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["AREA", "GRAY_LEVEL"]
    marks = _marks(spark, sf_dir)[1]
    out = stats.normalize(marks, names, stats.fit_stats(marks, names), ["image_id", "node_id"], "none")
    return out.select("image_id", "node_id", F.col("AREA").alias("area"), F.col("GRAY_LEVEL").alias("gray_level"))


def image_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.per_image_normalize(raster(spark, sf_dir, "V"), KEY), "value").select("image_id", "pixel_id", "value")


def projected_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on normalized areas and levels, one for each nation of the table, back on their scales."""
    fitted = stats.fit_stats(_marks(spark, sf_dir)[1], ["AREA", "GRAY_LEVEL"])
    key = F.when(F.col("n_nationkey") % 2 == 0, "max::AREA").otherwise("max::GRAY_LEVEL")
    specs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("spec"), key.alias("stat_key"), (F.col("n_nationkey") + 1).cast("double").alias("weight"), (-F.col("n_nationkey") / 2).alias("bias"))
    return r6(stats.project_threshold(specs, fitted), "threshold").select("spec", "threshold")


def training_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the vectors' values merged for the training split: labels below 6, twice for label 0."""
    px = raster(spark, sf_dir, "V")
    v = F.col("value").cast("double")
    entry = px.groupBy(F.col("image_id").alias("entry_key")).agg(F.lit("max::VALUE").alias("stat_key"), F.count(v).alias("count"), F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq"), F.min(v).alias("amin"), F.max(v).alias("amax"))
    rows = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select(F.col("vec_id").cast("string").alias("entry_key"), "label")
    part = rows.select("entry_key", F.when(F.col("label") < 6, "train").otherwise("test").alias("split"))
    again = rows.where("label = 0").select("entry_key", F.lit("train").alias("split"))
    return stats.stats_from_manifest(part.unionByName(again), entry)


def train_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language's metrics at the threshold that is best for English."""
    p = predictions(spark, sf_dir).withColumn("split", F.when(F.col("lang") == "en", "train").otherwise(F.col("lang")))
    out = metrics.train_pr(p)
    return r6(out, "precision", "recall", "f1", "threshold").select("split", "precision", "recall", "f1", "threshold")


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's last order of each priority: states by priority; and how many customers have none of it."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("config"), F.col("o_custkey").alias("run_id"), F.struct("o_orderdate", "o_orderkey").alias("finished"), F.col("o_orderstatus").alias("status"))
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.explode(F.array(*map(F.lit, PRIORITIES))).alias("config"))
    _, states, missing = metrics.validate_runs(o, wanted)
    lost = missing.groupBy("config").agg(F.lit("missing").alias("status"), F.count(F.lit(1)).alias("count"))
    return states.unionByName(lost).select("config", "status", F.col("count").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        loss_gradients, node_scores_mlp, predicted, node_signal, events_by_node, score_report, edge_violations, attribute_ranks, inspected,
        converted, resized_area, resized_nearest, intensity_issues, shape_mismatches, channel_rows, content_entries,
        patch_coverage, patch_loss, normalize_none, image_responses, projected_thresholds, training_stats, train_threshold, run_states,
    )
}


def _nodes_of(alias: str) -> str:
    return f"JOIN {alias} ON {alias}.image_id = r.image_id AND {alias}.node_id = r.node_id"


def _gradients() -> str:
    parts = []
    for name, per, value, slope in (
        ("squared", 15.0, "(y - t) * (y - t)", "2 * (y - t)"),
        ("cross_entropy", 5.0, "2 * t * ln(1 + exp(-y)) + (1 - t) * ln(1 + exp(y))", "(1 - t) / (1 + exp(-y)) - 2 * t / (1 + exp(y))"),
    ):
        parts.append(f"""SELECT '{name}' AS loss_name, (SELECT count(*) FROM ys) AS n, (SELECT avg({value}) FROM (SELECT v / {per}::DOUBLE AS y, t FROM ys)) AS loss, sum(k * area) / (SELECT count(*) FROM ys) AS d_area, sum(k * gray) / (SELECT count(*) FROM ys) AS d_gray_level, sum(k) / (SELECT count(*) FROM ys) AS d_bias
FROM (SELECT g * residue * s * (1 - s) * 2 AS k, area, gray FROM (SELECT u.image_id, u.ancestor_id AS node_id, sum({slope}) / {per}::DOUBLE AS g FROM (SELECT image_id, pixel_id, v / {per}::DOUBLE AS y, t FROM ys) y JOIN own o ON o.image_id = y.image_id AND o.pixel_id = y.pixel_id JOIN up u ON u.image_id = o.image_id AND u.node_id = o.node_id GROUP BY ALL) g JOIN sc ON sc.image_id = g.image_id AND sc.node_id = g.node_id)""")
    rows = " UNION ALL ".join(parts)
    return f"""{tree()}, sc AS MATERIALIZED (SELECT r.image_id, r.node_id, residue, area, gray, {SCORE1} AS s FROM res r {_nodes_of("att")}),
ys AS MATERIALIZED (SELECT p.image_id, p.pixel_id, v, (p.value >= 8)::BIGINT AS t FROM (SELECT o.image_id, o.pixel_id, sum(residue * s) AS v {PIXELS} JOIN sc ON sc.image_id = u.image_id AND sc.node_id = u.ancestor_id GROUP BY o.image_id, o.pixel_id) w JOIN px p ON p.image_id = w.image_id AND p.pixel_id = w.pixel_id)
SELECT loss_name, n, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("loss", "d_area", "d_gray_level", "d_bias"))} FROM ({rows})"""


def _mlp() -> str:
    relu = "0.5 * greatest(0.01 * area + 0.1 * gray + 0.5, 0) - 0.25 * greatest(-0.02 * area + 0.2 * gray - 0.25, 0) + 0.1"
    inner = "(0.01 * a - 0.1 * g + 0.25)".replace(" a ", " area ").replace(" g ", " gray ")
    gelu = f"0.5 * {inner} * (1 + tanh(sqrt(2 / pi()) * ({inner} + 0.044715 * {inner} * {inner} * {inner})))"
    forms = {
        "relu": f"CASE WHEN r.node_id = parent_id THEN 1.0 ELSE 1 / (1 + exp(-least(greatest(2 * ({relu}), -3), 3))) END",
        "tanh": "1 / (1 + exp(-(tanh(0.01 * area + 0.1 * gray + 0.25) - 0.5)))",
        "gelu": f"1 / (1 + exp(-1.5 * 0.75 * ({gelu})))",
    }
    return f"{tree()} " + " UNION ALL ".join(f"SELECT r.image_id, r.node_id, '{k}' AS spec, round(({v})::DOUBLE, 6) + 0.0 AS score FROM res r {_nodes_of('att')}" for k, v in forms.items())


SCORES = f"sc AS MATERIALIZED (SELECT image_id, node_id, area, gray, 'size' AS spec, {SCORE1} AS score FROM att UNION ALL SELECT image_id, node_id, area, gray, 'level', {SCORE2} FROM att)"
ROW_DIGEST = """sha256(string_agg(col || '=' || value, ',' ORDER BY col))"""
DIGESTS = f"""rows_ AS (SELECT image_id, "row", {ROW_DIGEST} AS digest, count(*) AS n FROM px GROUP BY ALL), dig AS MATERIALIZED (SELECT image_id, sha256(count(*) || '|' || max(n) || '|' || string_agg(digest, ',' ORDER BY "row")) AS sha256 FROM rows_ GROUP BY image_id)"""


def _without(weight: str) -> str:
    return f"abs({SCORE1} - 1 / (1 + exp(-2.0::DOUBLE * (0.02::DOUBLE * area - 0.1::DOUBLE * gray + 0.5::DOUBLE - ({weight})))))"


ORACLES: dict[str, str] = {
    "loss_gradients": _gradients(),
    "node_scores_mlp": _mlp(),
    "predicted": f"{tree()} SELECT o.image_id, o.pixel_id, round(sum(residue * (1 / (1 + exp(-1000.0::DOUBLE * (gray - 5.5::DOUBLE))))), 6) + 0.0 AS value {PIXELS} JOIN res r ON r.image_id = u.image_id AND r.node_id = u.ancestor_id {_nodes_of('att')} GROUP BY o.image_id, o.pixel_id",
    "node_signal": f"{tree()} SELECT image_id, node_id, sum(col)::BIGINT AS value FROM sup GROUP BY ALL",
    "events_by_node": f"{tree()} SELECT o.image_id, o.node_id, sum(n)::BIGINT AS n_events FROM cells c JOIN px p ON p.image_id = c.image_id AND p.\"row\" = c.\"row\" AND p.col = c.col JOIN own o ON o.image_id = p.image_id AND o.pixel_id = p.pixel_id GROUP BY ALL",
    "score_report": f"""{tree()}, {SCORES}, h AS (SELECT spec, least(floor(score * 10), 9)::INTEGER AS bin, count(*) AS n FROM sc GROUP BY ALL),
a AS (SELECT spec, avg(score) AS mean, min(score) AS low, max(score) AS high, avg((score < 0.05 OR score > 0.95)::INTEGER) AS saturation, avg((score >= 0.5)::INTEGER) AS acceptance FROM sc GROUP BY spec)
SELECT spec, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("mean", "low", "high", "saturation", "acceptance"))}, bin, n FROM a JOIN h USING (spec)""",
    "edge_violations": f"{tree()}, {SCORES}, d AS (SELECT r.image_id, greatest(c.score - p.score, 0) AS over FROM res r JOIN sc c ON c.image_id = r.image_id AND c.node_id = r.node_id AND c.spec = 'size' JOIN sc p ON p.image_id = r.image_id AND p.node_id = r.parent_id AND p.spec = 'size' WHERE r.node_id <> r.parent_id) SELECT image_id, count(*) AS edges, count(*) FILTER (WHERE over > 1e-6) AS violations, round(sum(over), 6) + 0.0 AS total, round(sum(over * over), 6) + 0.0 AS squares, round(max(over), 6) + 0.0 AS worst FROM d GROUP BY image_id",
    "attribute_ranks": f"""{tree()}, c AS (SELECT image_id, 'AREA' AS attribute, {_without("0.02::DOUBLE * area")} AS change FROM att UNION ALL SELECT image_id, 'GRAY_LEVEL', {_without("-0.1::DOUBLE * gray")} FROM att),
m AS (SELECT image_id, attribute, avg(change) AS m FROM c GROUP BY ALL), g AS (SELECT attribute, avg(m) AS mean, stddev_samp(m) AS std, count(*) AS n FROM m GROUP BY attribute)
SELECT 'size' AS spec, attribute, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, n, round(100 * mean / (SELECT sum(mean) FROM g), 6) + 0.0 AS percent, row_number() OVER (ORDER BY mean DESC, attribute) AS rank FROM g""",
    "inspected": f"""{tree()}, st AS (SELECT min(area) AS lo, max(area) AS hi, min(gray) AS lo2, max(gray) AS hi2 FROM att), z AS (SELECT a.image_id, a.node_id, a.area AS raw_area, (a.area - lo) / greatest(hi - lo, 1e-6) AS area, (gray - lo2) / greatest(hi2 - lo2, 1e-6) AS gray FROM att a, st)
SELECT r.image_id, r.node_id, residue, round(raw_area, 6) + 0.0 AS raw_area, round(area, 6) + 0.0 AS norm_area, round({SCORE1}, 6) + 0.0 AS score FROM res r {_nodes_of('z')} WHERE r.image_id = 'click'""",
    "converted": f"WITH {RASTERS['V']} SELECT image_id, pixel_id, round((255 - trunc(value / 16.0::DOUBLE * 255)) / 255.0::DOUBLE, 6) + 0.0 AS value FROM px",
    "resized_area": f"""WITH {RASTERS['E']}, r AS (SELECT s, t, least((s + 1) * 9 / 24.0::DOUBLE, t + 1) - greatest(s * 9 / 24.0::DOUBLE, t) AS w FROM range(24) a(s), range(9) b(t)), c AS (SELECT s, t, least((s + 1) * 11 / 32.0::DOUBLE, t + 1) - greatest(s * 11 / 32.0::DOUBLE, t) AS w FROM range(32) a(s), range(11) b(t))
SELECT image_id, r.t * 11 + c.t AS pixel_id, round(sum(r.w * c.w * value) / sum(r.w * c.w), 6) + 0.0 AS value FROM px JOIN r ON r.s = px."row" AND r.w > 0 JOIN c ON c.s = px.col AND c.w > 0 GROUP BY ALL""",
    "resized_nearest": f'WITH {RASTERS["E"]} SELECT image_id, r * 48 + c AS pixel_id, value FROM range(9) a(r) CROSS JOIN range(48) b(c) JOIN px ON px."row" = r * 24 // 9 AND px.col = c * 32 // 48',
    "intensity_issues": """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN x WHEN 1 THEN abs(x) WHEN 2 THEN abs(x) * 5 ELSE abs(x) * 2000 END AS x FROM v),
g AS (SELECT vec_id, count(*) FILTER (WHERE x IS NULL OR NOT isfinite(x)) AS odd, min(x) AS lo, max(x) AS hi FROM p GROUP BY vec_id)
SELECT * FROM (SELECT vec_id::VARCHAR AS image_id, CASE WHEN odd > 0 THEN 'not finite' WHEN lo < 0 THEN 'negative' WHEN hi > 255 THEN 'above 255' WHEN hi > 1 + 1e-6 AND hi <= 1.5 THEN 'ambiguous scale' END AS issue FROM g) WHERE issue IS NOT NULL""",
    "shape_mismatches": f"WITH {RASTERS['E']} SELECT DISTINCT image_id, 24::BIGINT AS left_rows, 32::BIGINT AS left_cols, CASE WHEN image_id > 'm' THEN 12 END::BIGINT AS right_rows, CASE WHEN image_id > 'm' THEN 32 END::BIGINT AS right_cols FROM px",
    "channel_rows": f"WITH {RASTERS['V']} SELECT image_id, 2::BIGINT AS n_channels, md5(string_agg(value::VARCHAR, ',' ORDER BY pixel_id) || '|' || string_agg((15 - value)::VARCHAR, ',' ORDER BY pixel_id)) AS digest FROM px GROUP BY image_id",
    "pixel_digests": f"WITH {RASTERS['V']}, {DIGESTS} SELECT image_id, sha256 FROM dig",
    "content_entries": f"""WITH {RASTERS['V'].replace("px AS", "whole AS")}, px AS (SELECT image_id, "row", col, (value >= 8)::INTEGER AS value FROM whole WHERE "row" = 0), {DIGESTS}
SELECT d.image_id, entry_image, sha256(d.sha256 || '|max|AREA,VOLUME|double') AS entry_key, level_sum FROM dig d JOIN (SELECT content, min(image_id) AS entry_image, any_value(level_sum) AS level_sum, list(image_id) AS members FROM (SELECT image_id, list(value ORDER BY col) AS content, sum(value)::BIGINT AS level_sum FROM px GROUP BY image_id) GROUP BY content) c ON list_contains(members, d.image_id)""",
    "patch_coverage": PATCHES + ' SELECT image_id, "row", col, count(*) AS n FROM got WHERE core GROUP BY ALL',
    "patch_loss": PATCHES + " SELECT round(avg(l) + 0.5 * avg(a), 6) + 0.0 AS loss FROM (SELECT sum((value - 7) * (value - 7) * (value + 1))::DOUBLE / sum(value + 1)::DOUBLE AS l, avg(value) AS a FROM got WHERE core GROUP BY image_id, pr, pc)",
    "normalize_none": f"{tree()} SELECT image_id, node_id, area, gray AS gray_level FROM att",
    "image_responses": f"WITH {RASTERS['V']} SELECT image_id, pixel_id, round((value - min(value) OVER w) / greatest(max(value) OVER w - min(value) OVER w, 1e-6), 6) + 0.0 AS value FROM px WINDOW w AS (PARTITION BY image_id)",
    "projected_thresholds": f"{tree()} SELECT n_name AS spec, round(CASE WHEN n_nationkey % 2 = 0 THEN min(area) + n_nationkey / 2.0::DOUBLE / (n_nationkey + 1) * (max(area) - min(area)) ELSE min(gray) + n_nationkey / 2.0::DOUBLE / (n_nationkey + 1) * (max(gray) - min(gray)) END, 6) + 0.0 AS threshold FROM nation, att GROUP BY n_name, n_nationkey",
    "training_stats": f"""WITH {RASTERS['V']}, w AS (SELECT vec_id::VARCHAR AS image_id, CASE WHEN label = 0 THEN 2 ELSE 1 END AS times FROM embeddings WHERE label < 6)
SELECT 'max::VALUE' AS stat_key, sum(times)::BIGINT AS count, sum(times * value)::DOUBLE AS sum, sum(times * value * value)::DOUBLE AS sumsq, min(value)::DOUBLE AS amin, max(value)::DOUBLE AS amax FROM px JOIN w USING (image_id)""",
    "train_threshold": f"""WITH {PREDICTIONS}, s AS (SELECT DISTINCT score AS th FROM p WHERE lang = 'en'), f AS (SELECT th, 2 * count(*) FILTER (WHERE score >= th AND label = 1) / (count(*) FILTER (WHERE score >= th) + count(*) FILTER (WHERE label = 1))::DOUBLE AS f1 FROM p, s WHERE lang = 'en' GROUP BY th),
b AS (SELECT th FROM f ORDER BY f1 DESC, th DESC LIMIT 1), c AS (SELECT CASE WHEN lang = 'en' THEN 'train' ELSE lang END AS split, count(*) FILTER (WHERE score >= th AND label = 1) AS tp, count(*) FILTER (WHERE score >= th AND label <> 1) AS fp, count(*) FILTER (WHERE score < th AND label = 1) AS fn, any_value(th) AS threshold FROM p, b GROUP BY ALL)
SELECT split, round(tp / (tp + fp + 1e-12), 6) + 0.0 AS "precision", round(tp / (tp + fn + 1e-12), 6) + 0.0 AS recall, round(2 * tp / (2 * tp + fp + fn + 1e-12), 6) + 0.0 AS f1, round(threshold, 6) + 0.0 AS threshold FROM c""",
    "run_states": f"""WITH l AS (SELECT o_orderpriority AS config, o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY ALL)
SELECT config, status, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT config, 'missing', count(*) FROM (VALUES {', '.join(f"('{p}')" for p in PRIORITIES)}) p(config) CROSS JOIN customer c ANTI JOIN l ON l.config = p.config AND l.o_custkey = c.c_custkey GROUP BY config""",
}
