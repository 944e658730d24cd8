"""Resampling of a pixel table to another grid, as equality joins on source pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import GridSpec

Inverse = Callable[[Column, Column], tuple[Column, Column]]


def _source_place(target: GridSpec, source: GridSpec, inverse: Inverse | None) -> tuple[Column, Column]:
    """Fractional source row and column of target pixel centres (0 is the centre of the first)."""
    x, y = target.pixel_to_map(F.col("r") + 0.5, F.col("c") + 0.5)
    if inverse:
        x, y = inverse(x, y)
    return (y - F.lit(source.f)) / F.lit(source.e) - 0.5, (x - F.lit(source.c)) / F.lit(source.a) - 0.5


def target_pixels(spark, grid: GridSpec) -> DataFrame:
    rows = spark.range(grid.height).select(F.col("id").cast("int").alias("r"))
    return rows.select("r", F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))).alias("c"))


def bilinear(pixels: DataFrame, source: GridSpec, target: GridSpec, value: str = "v", inverse: Inverse | None = None, outside: float | None = None) -> DataFrame:
    """(r, c, value) on the target grid: the four neighbours by weight, those that are missing left out. A pixel with none has ``outside``.

    ``inverse`` takes target map coordinates to the source's system. Equal grids are passed through.
    """
    if inverse is None and source.same_as(target):
        return pixels.select("r", "c", value)
    fr, fc = _source_place(target, source, inverse)
    t = target_pixels(pixels.sparkSession, target).withColumns({"_fr": fr, "_fc": fc})
    t = t.withColumns({"_r0": F.floor("_fr"), "_c0": F.floor("_fc")}).withColumns({"_wr": F.col("_fr") - F.col("_r0"), "_wc": F.col("_fc") - F.col("_c0")})
    corner = lambda dr, dc: F.struct(
        (F.col("_r0") + dr).alias("sr"), (F.col("_c0") + dc).alias("sc"), ((F.col("_wr") if dr else 1 - F.col("_wr")) * (F.col("_wc") if dc else 1 - F.col("_wc"))).alias("w")
    )
    near = t.select("r", "c", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("k")).select("r", "c", "k.*").where("w > 0")
    src = pixels.select(F.col("r").cast("long").alias("sr"), F.col("c").cast("long").alias("sc"), F.col(value).cast("double").alias("_v"))
    out = near.join(src, ["sr", "sc"], "left").groupBy("r", "c").agg(F.try_divide(F.sum(F.col("w") * F.col("_v")), F.sum(F.when(F.col("_v").isNotNull(), F.col("w")))).alias(value))
    return out if outside is None else out.na.fill(outside, [value])


def nearest(pixels: DataFrame, source: GridSpec, target: GridSpec, value: str = "v", inverse: Inverse | None = None) -> DataFrame:
    """(r, c, value): the source pixel that holds the target's centre; null outside."""
    fr, fc = _source_place(target, source, inverse)
    t = target_pixels(pixels.sparkSession, target).withColumns({"sr": F.floor(fr + 0.5), "sc": F.floor(fc + 0.5)})
    src = pixels.select(F.col("r").cast("long").alias("sr"), F.col("c").cast("long").alias("sc"), value)
    return t.join(src, ["sr", "sc"], "left").select("r", "c", value)
