"""Accuracy of scores: confusion, rank and curve statistics. Curves run over distinct scores, counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import EPS
from ..functions.missing import detected
from .ranks import quantiles, rank_table


def confusion(scores: DataFrame, threshold: float, y: str = "y", score: str = "s") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    p = detected(F.col(score), threshold)
    cell = lambda a, b: F.count_if((F.col(y) == a) & (p == b))
    return scores.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def report(confusion_row: DataFrame) -> DataFrame:
    """One row of ratios: a small term keeps empty denominators from failing; kappa has none and is null where chance agrees on all."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n, e = tp + fp + fn + tn, F.lit(EPS)
    precision, recall = tp / (tp + fp + e), tp / (tp + fn + e)
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return confusion_row.select(
        precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + e)).alias("f1"), ((tp + tn) / (n + e)).alias("accuracy"),
        (tp / (tp + fp + fn + e)).alias("iou"), F.try_divide((tp + tn) / n - chance, 1 - chance).alias("kappa"),
    )


def roc_auc(scores: DataFrame, y: str = "y", score: str = "s") -> DataFrame:
    """One row: the chance that a positive scores higher than a negative, ties half."""
    t = rank_table(scores, score, {"pos": F.sum(F.col(y).cast("long"))})
    ranks = F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2))
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return t.agg(F.try_divide(ranks - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def points(scores: DataFrame, y: str = "y", score: str = "s") -> DataFrame:
    """(threshold, tp, n, pos): at each distinct score, positives and rows that reach it, and the score's own positives."""
    t = rank_table(scores, score, {"pos": F.sum(F.col(y).cast("long"))}, descending=True)
    return t.select(F.col("value").alias("threshold"), (F.col("before_pos") + F.col("pos")).alias("tp"), (F.col("before") + F.col("n")).alias("n"), "pos")


def average_precision(scores: DataFrame, y: str = "y", score: str = "s") -> DataFrame:
    """One row: the sum over falling scores of gained recall times precision."""
    return points(scores, y, score).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("n")), F.sum("pos")).alias("ap"))


def _with_totals(p: DataFrame) -> DataFrame:
    return p.crossJoin(F.broadcast(p.agg(F.max("tp").alias("all_pos"), F.max("n").alias("all_n"))))


def roc_curve(scores: DataFrame, y: str = "y", score: str = "s") -> DataFrame:
    p = _with_totals(points(scores, y, score))
    return p.select("threshold", F.try_divide(F.col("n") - F.col("tp"), F.col("all_n") - F.col("all_pos")).alias("fpr"), F.try_divide(F.col("tp"), F.col("all_pos")).alias("tpr"))


def pr_curve(scores: DataFrame, y: str = "y", score: str = "s") -> DataFrame:
    p = _with_totals(points(scores, y, score))
    return p.select("threshold", (F.col("tp") / F.col("n")).alias("precision"), F.try_divide(F.col("tp"), F.col("all_pos")).alias("recall"))


def best_f1(scores: DataFrame, y: str = "y", score: str = "s") -> DataFrame:
    """One row (threshold, f1): the largest F1, and of its thresholds the lowest."""
    p, r = F.col("precision"), F.col("recall")
    f1 = pr_curve(scores, y, score).withColumn("f1", 2 * p * r / (p + r + F.lit(EPS)))
    best = f1.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select((-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def calibration(scores: DataFrame, bins: int = 10, y: str = "y", score: str = "s") -> DataFrame:
    """(bin, n, mean_score, share_positive) by bins between exact quantiles; empty bins have no row."""
    edges = F.array(*[F.lit(e).cast("double") for e in quantiles(scores, score, [k / bins for k in range(1, bins)])])
    binned = scores.withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col(score))))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("share_positive"))


def error_map(truth: DataFrame, raster: DataFrame, threshold: float, value: str = "p") -> DataFrame:
    """(r, c, code) of every pixel: 0 right no, 1 right yes, 2 false alarm, 3 missed. ``truth``: distinct rows (r, c)."""
    j = raster.join(truth.select("r", "c", F.lit(1).alias("_t")), ["r", "c"], "left")
    t, p = F.col("_t").isNotNull(), detected(F.col(value), threshold) == 1
    return j.select("r", "c", F.when(t & p, 1).when(~t & p, 2).when(t & ~p, 3).otherwise(0).alias("code"))


def mean_importance(by_fold: DataFrame) -> DataFrame:
    """(feature, importance): mean over folds of rows (fold, feature, importance)."""
    return by_fold.groupBy("feature").agg(F.avg("importance").alias("importance"))
