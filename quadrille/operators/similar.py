"""Similarity of windows to reference windows, and display values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import EPS
from ..functions.scalar import stretch
from ..functions.similarity import similarity
from .ranks import quantiles


def zscores(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column as (x - mean) / (population deviation + a small term), over all rows. The statistics are one row."""
    stats = features.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = features.crossJoin(F.broadcast(stats))
    return joined.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + F.lit(EPS)) for c in columns}).select(*features.columns)


def reference_windows(spark, height: int, width: int, box: tuple[int, int, int, int], mask: DataFrame, window: int = 15, least: float = 0.5) -> DataFrame:
    """Windows on a grid of step window // 2 in the bounding box (first row, first col, last row, last col) of a mask, covered by at least ``least``.

    The mask has distinct rows (r, c).
    """
    r0, c0, r1, c1 = box
    step = max(1, window // 2)
    rows, cols = list(range(r0, min(r1 + 1, height - window + 1), step)), list(range(c0, min(c1 + 1, width - window + 1), step))
    if not rows or not cols:
        raise ValueError("no reference window fits")
    near = mask.where(F.col("r").between(r0, r1 + window) & F.col("c").between(c0, c1 + window))
    first = lambda x, start: F.greatest(F.ceil((F.col(x) - F.lit(start + window - 1)) / F.lit(step)), F.lit(0)).cast("int")
    last = lambda x, start, n: F.least(F.floor((F.col(x) - F.lit(start)) / F.lit(step)), F.lit(n - 1)).cast("int")
    origins = lambda x, start, n: F.when(first(x, start) <= last(x, start, n), F.transform(F.sequence(first(x, start), F.greatest(first(x, start), last(x, start, n))), lambda k: k * step + start)).otherwise(F.array().cast("array<int>"))
    px = near.withColumn("win_r", F.explode(origins("r", r0, len(rows)))).withColumn("win_c", F.explode(origins("c", c0, len(cols))))
    return px.groupBy("win_r", "win_c").agg((F.count(F.lit(1)) / F.lit(float(window * window))).alias("frac")).where(F.col("frac") >= least)


def scored(features: DataFrame, columns: Sequence[str], is_reference, metric: str = "cosine") -> DataFrame:
    """``features`` with ``similarity`` to the mean of the reference rows. The reference vector is one row."""
    reference = features.where(is_reference).agg(*[F.avg(c).alias(f"_r_{c}") for c in columns])
    a, b = F.array(*[F.col(c).cast("double") for c in columns]), F.array(*[F.col(f"_r_{c}") for c in columns])
    return features.crossJoin(F.broadcast(reference)).withColumn("similarity", similarity(metric, a, b)).select(*features.columns, "similarity")


def most_similar(scored_windows: DataFrame, k: int = 5, keys: Sequence[str] = ("win_r", "win_c")) -> DataFrame:
    return scored_windows.orderBy(F.desc("similarity"), *keys).limit(k)


def flat(scored_windows: DataFrame, least: float = 0.01) -> bool:
    """Whether the scores differ by less than ``least``: nothing can be told from them."""
    row = scored_windows.agg(F.max("similarity"), F.min("similarity")).first()
    return row[0] is None or row[0] - row[1] < least


def display(px: DataFrame, bands: Sequence[str] = ("B4", "B3", "B2"), low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(r, c, red, green, blue): bands stretched between two exact percentiles."""
    ends = {b: [F.lit(x) for x in quantiles(px, b, (low, high))] for b in bands}
    return px.select("r", "c", *[stretch(F.col(b), *ends[b]).alias(n) for b, n in zip(bands, ("red", "green", "blue"), strict=True)])
