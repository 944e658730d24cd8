"""Labels of windows, negatives, folds and samples.

Random choices order rows by the MD5 of a seed and the row's key: exact counts, the same rows in any engine and partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import BANDS
from .ranks import percent_ranks

SEED = 42
POSITIVE_OVERLAP = 0.5
NEGATIVES_PER_POSITIVE = 4
HARD_SHARE = 0.5
FOLDS = 5


def draw(seed: int, *key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))


def label(frac: Column) -> Column:
    """positive (at least half covered), ambiguous (touched) or negative."""
    f = F.coalesce(frac, F.lit(0.0))
    return F.when(f >= POSITIVE_OVERLAP, "positive").when(f > 0, "ambiguous").otherwise("negative")


def in_scope(labelled: DataFrame, covered: Column) -> DataFrame:
    """Positives and negatives only where ``covered``; ambiguous windows stay everywhere."""
    return labelled.where((F.col("label") == "ambiguous") | covered)


def built_up(features: DataFrame, keys: Sequence[str] = ("win_r", "win_c")) -> DataFrame:
    """(keys, brightness, built_score): percent rank of the mean of the band means, plus that of NDBI_mean (without one, brightness again)."""
    bands = [c for c in features.columns if c.endswith("_mean") and c.split("_")[0] in BANDS]
    brightness = sum((F.col(c) for c in bands[1:]), F.col(bands[0])) / len(bands)
    f = features.withColumn("brightness", brightness)
    f = f.withColumn("built", F.col("NDBI_mean") if "NDBI_mean" in features.columns else F.col("brightness"))
    ranked = percent_ranks(f.select(*keys, "brightness", "built"), ["brightness", "built"])
    return ranked.select(*keys, "brightness", (F.col("pct_brightness") + F.col("pct_built")).alias("built_score"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in an order that has no ties."""
    return df.orderBy(*order).limit(n)


def hard_negatives(negatives: DataFrame, n_hard: int, keys: Sequence[str] = ("win_r", "win_c"), seed: int = SEED, pool: int = 4, draw_from_pool: bool = True) -> DataFrame:
    """The most built-up negatives: ``n_hard`` drawn from the first ``pool * n_hard``, or (the tuner's way) strictly the first ``n_hard``."""
    order = [F.desc("built_score"), *keys]
    if not draw_from_pool:
        return top(negatives, n_hard, *order)
    return top(top(negatives, pool * n_hard, *order), n_hard, draw(seed, *[F.col(k) for k in keys]), *[F.col(k) for k in keys])


def easy_negatives(negatives: DataFrame, hard: DataFrame, n: int, keys: Sequence[str] = ("win_r", "win_c"), seed: int = SEED) -> DataFrame:
    return top(negatives.join(hard.select(*keys), list(keys), "left_anti"), n, draw(seed + 1, *[F.col(k) for k in keys]), *[F.col(k) for k in keys])


def training_sample(labelled: DataFrame, keys: Sequence[str] = ("win_r", "win_c"), seed: int = SEED, ratio: int = NEGATIVES_PER_POSITIVE, hard_share: float = HARD_SHARE, draw_from_pool: bool = True) -> DataFrame:
    """(keys, y, is_hard): all positives, and ``ratio`` times as many negatives, ``hard_share`` of them hard. Needs columns label and built_score."""
    positives, negatives = labelled.where("label = 'positive'"), labelled.where("label = 'negative'")
    n_pos = positives.count()
    n_neg, n_hard = n_pos * ratio, int(n_pos * ratio * hard_share)
    hard = hard_negatives(negatives, n_hard, keys, seed, draw_from_pool=draw_from_pool)
    easy = easy_negatives(negatives, hard, n_neg - min(n_hard, negatives.count()), keys, seed)
    row = lambda df, y, h: df.select(*keys, F.lit(y).alias("y"), F.lit(h).alias("is_hard"))
    return row(positives, 1, False).unionByName(row(hard, 0, True)).unionByName(row(easy, 0, False))


def folds(blocks: DataFrame, block: str = "block_id", n: int = FOLDS, seed: int = SEED) -> DataFrame:
    """(block, fold): distinct blocks in drawn order, dealt round. Blocks are few: a row for every 640 000 pixels."""
    order = Window.orderBy(draw(seed, F.col(block)), block)
    return blocks.select(block).distinct().withColumn("fold", ((F.row_number().over(order) - 1) % n).cast("int"))


def stratified_sample(scores: DataFrame, per_class: int, y: str = "y", key: str = "id", seed: int = SEED) -> DataFrame:
    """Up to ``per_class`` rows of each class, in drawn order. Each class is a top-n, so no task sorts a class."""
    parts = [top(scores.where(F.col(y) == k), per_class, draw(seed, F.col(key)), F.col(key)) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def class_weights(rows: DataFrame, y: str = "y") -> DataFrame:
    """Add weight n / (2 n_y). The counts are two rows."""
    counts = rows.groupBy(y).agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(1))))
    return rows.join(F.broadcast(counts), y).withColumn("weight", F.col("_all") / (2 * F.col("_n"))).drop("_n", "_all")
