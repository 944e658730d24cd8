"""Terrain statistics of windows, class shares, and summed-area tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import EPS
from ..functions.scalar import slope_degrees
from .windows import STRIDE, WINDOW, explode_windows, window_sums

PIXEL_METRES = 10.0
#: Class ids of the land-cover map (fixed values).
CLASSES = {"soil": (1,), "ceramic": (2,), "fiber": (3,), "paved": (4,), "veg": (5, 6), "tile": (7,)}


def terrain_features(dsm: DataFrame, height: int, width: int, window: int = WINDOW, stride: int = STRIDE, pixel_metres: float = PIXEL_METRES) -> DataFrame:
    """win_r, win_c, DSM_mean, DSM_std, DSM_roughness, DSM_slope_mean, DSM_slope_std from rows (r, c, z).

    Mean and deviation are of the valid pixels; for roughness (mean absolute step to the next row and column) and slope (central
    differences, one-sided at the edges) holes take the window's mean. A window without a valid pixel has five zeros.
    """
    px = explode_windows(dsm.select("r", "c", F.col("z").cast("double").alias("z")), height, width, window, stride)
    win = Window.partitionBy("win_r", "win_c")
    px = px.withColumn("filled", F.coalesce("z", F.avg("z").over(win)))
    down = Window.partitionBy("win_r", "win_c", "c").orderBy("r")
    across = Window.partitionBy("win_r", "win_c", "r").orderBy("c")

    def gradient(order):
        before, z, after = F.lag("filled").over(order), F.col("filled"), F.lead("filled").over(order)
        return F.coalesce((after - before) / 2, after - z, z - before, F.lit(0.0))

    px = px.withColumns({"dr": F.abs(F.col("filled") - F.lag("filled").over(down)), "gr": gradient(down)})
    px = px.withColumns({"dc": F.abs(F.col("filled") - F.lag("filled").over(across)), "gc": gradient(across)})
    px = px.withColumn("slope", slope_degrees(F.col("gc"), F.col("gr"), pixel_metres))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    some = F.count("z") > 0
    return px.groupBy("win_r", "win_c").agg(
        zero(F.avg("z")).alias("DSM_mean"), zero(F.stddev_pop("z")).alias("DSM_std"),
        zero((F.sum("dr") + F.sum("dc")) / F.nullif(F.count("dr") + F.count("dc"), F.lit(0))).alias("DSM_roughness"),
        F.when(some, F.avg("slope")).otherwise(0.0).alias("DSM_slope_mean"), F.when(some, F.stddev_pop("slope")).otherwise(0.0).alias("DSM_slope_std"),
    )


def class_shares(classes: DataFrame, height: int, width: int, window: int = WINDOW, stride: int = STRIDE, names: Mapping[str, tuple[int, ...]] = CLASSES) -> DataFrame:
    """win_r, win_c and the shares of ceramic, fiber, paved, soil and veg; informality and formality add some of them up."""
    kinds = ("ceramic", "fiber", "paved", "soil", "veg")
    sums = {"_n": F.count(F.lit(1))} | {f"_{k}": F.count_if(F.col("cls").isin(*names[k])) for k in kinds}
    w = window_sums(classes, sums, height, width, window, stride)
    share = {k: F.coalesce(F.col(f"_{k}"), F.lit(0)) / (F.col("_n") + F.lit(EPS)) for k in kinds}
    return w.select(
        "win_r", "win_c", *[share[k].alias(f"pct_{k}") for k in kinds],
        (share["ceramic"] + share["fiber"] + share["soil"]).alias("informality"), (share["paved"] + share["veg"]).alias("formality"),
    )


def summed_area(layer: DataFrame, value: str) -> DataFrame:
    """(r, c, s): the sum of ``value`` over all pixels up to and with row r and column c, missing values as 0.

    Rows and columns are windows of their own, so no task holds more than one of them.
    """
    down = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    s = layer.select("r", "c", F.coalesce(F.col(value), F.lit(0)).alias("v")).withColumn("s", F.sum("v").over(down))
    return s.withColumn("s", F.sum("s").over(across)).select("r", "c", "s")


def summed_windows(table: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win_r, win_c, s): window sums from four corners of a summed-area table, by one grouped sum of signed corners."""
    corner = lambda dr, dc, sign: F.struct((F.col("win_r") + dr).alias("r"), (F.col("win_c") + dc).alias("c"), F.lit(sign).alias("sign"))
    k = window - 1
    corners = windows.select("win_r", "win_c", F.explode(F.array(corner(k, k, 1), corner(-1, k, -1), corner(k, -1, -1), corner(-1, -1, 1))).alias("k"))
    corners = corners.select("win_r", "win_c", "k.r", "k.c", "k.sign").where("r >= 0 and c >= 0")
    return corners.join(table, ["r", "c"]).groupBy("win_r", "win_c").agg(F.sum(F.col("sign") * F.col("s")).alias("s"))
