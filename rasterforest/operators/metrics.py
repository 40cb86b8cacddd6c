"""Segmentation and classification metrics from long prediction tables (score, label 0/1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranks import running

EPS = 1e-12


def confusion(df: DataFrame, threshold: float = 0.5, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """tp, fp, fn, tn; a score counts as positive at the threshold (strict: only above it)."""
    hit, pos = (F.col("score") > threshold) if strict else (F.col("score") >= threshold), F.col("label") == 1
    return df.groupBy(*(by or [])).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, specificity, f1, jaccard, kappa and mcc; undefined ones are 0, recall and specificity NaN."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def over(a: Column, b: Column, none: float = 0.0) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(none))

    chance = over((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return counts.withColumns({"accuracy": over(tp + tn, n), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn, float("nan")), "specificity": over(tn, tn + fp, float("nan")), "f1": over(2 * tp, 2 * tp + fp + fn), "jaccard": over(tp, tp + fp + fn), "kappa": over(over(tp + tn, n) - chance, 1 - chance), "mcc": over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})


def distinct_scores(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per distinct score, from the largest down: tp and fp at that threshold, and the totals."""
    by = by or []
    per = df.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    done = running(per, by, [F.desc("score")], tp=F.col("p"), fp=F.col("q"))
    totals = per.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    done = done.join(totals, by) if by else done.crossJoin(F.broadcast(totals))  # one row
    return done.select(*by, "score", "p", "q", "pos", "neg", "tp", "fp")


def roc_curve(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    d = distinct_scores(df, by)
    return d.select(*(by or []), F.col("score").alias("threshold"), F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr"))


def pr_curve(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    d = distinct_scores(df, by)
    return d.select(*(by or []), F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "pos").alias("recall"), (2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))).alias("f1"))


def auc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at half; null where one label is missing."""
    d = distinct_scores(df, by)
    # Positives of a score beat the negatives below it and share those at it.
    wins = F.sum(F.col("p") * (F.col("neg") - F.col("fp") + F.col("q") / 2))
    return d.groupBy(*(by or [])).agg(F.try_divide(wins, F.first("pos") * F.first("neg")).alias("auc"))


def best_thresholds(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Thresholds of the largest tpr - fpr and of the largest f1; the larger threshold on ties."""
    d = distinct_scores(df, by)
    youden = F.try_divide("tp", "pos") - F.try_divide("fp", "neg")
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))
    return d.groupBy(*(by or [])).agg(F.max(F.struct(youden, "score")).getField("score").alias("by_youden"), F.max(F.struct(f1, "score")).getField("score").alias("by_f1"))


def metrics_on_grid(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """IoU, f1 and the share of foreground at each threshold of a fixed grid."""
    rows = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit, pos = F.col("score") >= F.col("threshold"), F.col("label") == 1
    c = rows.groupBy("threshold").agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count(F.lit(1)).alias("n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("threshold", (tp / (tp + fp + fn + EPS)).alias("iou"), (2 * tp / (2 * tp + fp + fn + EPS)).alias("f1"), ((tp + fp) / F.col("n")).alias("foreground"))


def per_image(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Mean over images of each image's metrics, scores strictly above the threshold."""
    r = rates(confusion(df, threshold, by, strict=True))
    return r.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in ("accuracy", "precision", "recall", "specificity", "f1", "jaccard")])


def train_pr(df: DataFrame) -> DataFrame:
    """Metrics by split at the f1-best threshold of the train split (column split)."""
    best = best_thresholds(df.where("split = 'train'")).first()["by_f1"]
    return rates(confusion(df, best, ["split"])).withColumn("threshold", F.lit(best))


def errors(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row: mse and mae of each pair of columns."""
    out = [x for a, b in pairs for x in (F.avg(F.pow(F.col(a) - F.col(b), 2)).alias(f"mse_{a}_{b}"), F.avg(F.abs(F.col(a) - F.col(b))).alias(f"mae_{a}_{b}"))]
    return df.agg(*out)


def losses(df: DataFrame, by: list[str], positive_weight: float = 1.0, dice_share: float = 0.5) -> DataFrame:
    """Soft Dice loss and positive-weighted cross entropy per image, averaged, and their weighted sum."""
    s, y = F.least(F.greatest(F.col("score"), F.lit(1e-7)), F.lit(1 - 1e-7)), F.col("label").cast("double")
    bce = -(positive_weight * y * F.log(s) + (1 - y) * F.log(1 - s))
    per = df.groupBy(*by).agg((1 - (2 * F.sum(s * y) + 1) / (F.sum(s) + F.sum(y) + 1)).alias("dice"), F.avg(bce).alias("bce"))
    return per.agg(F.avg("dice").alias("dice"), F.avg("bce").alias("bce"), (dice_share * F.avg("dice") + (1 - dice_share) * F.avg("bce")).alias("loss"))


def consolidate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: n, mean, sample deviation (0 for one), run ids and the text 'mean (±std)'. rows: keys, run_id, value."""
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.array_join(F.array_sort(F.collect_set(F.col("run_id").cast("string"))), ",").alias("run_ids"))
    return g.withColumn("text", F.format_string("%.4f (±%.4f)", "mean", "std"))


def validate_runs(rows: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Latest row of each (config, run_id) by finished; counts by status; expected pairs without a row."""
    w = W.partitionBy("config", "run_id").orderBy(F.desc("finished"))
    latest = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return latest, latest.groupBy("config", "status").count(), expected.join(latest, ["config", "run_id"], "left_anti")
