"""Sliding windows over pixel tables.

The windows that hold a pixel depend on its row and column apart, and few neighbours differ in them. Pixels are therefore first summed
into cells, the pixels that lie in the very same windows; only cells are copied to their windows. With windows of 15 and a stride of 10
a cell has 25 pixels, so a twenty-fifth of the rows is exploded, and the first sum runs map-side.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import window_origins

WINDOW, STRIDE = 15, 10


def axis_cell(x: Column, size: int, window: int, stride: int) -> Column:
    """The windows of an axis that hold x: first and last regular number, and whether the one moved in does."""
    last = (size - window) // stride
    low = F.greatest(F.lit(0), F.ceil((x - F.lit(window - 1)) / F.lit(stride))).cast("int")
    high = F.least(F.floor(x / F.lit(stride)), F.lit(last)).cast("int")
    moved = F.lit((size - window) % stride != 0) & (x >= size - window)
    return F.struct(low.alias("low"), high.alias("high"), moved.alias("moved"))


def cell_origins(cell: Column, size: int, window: int, stride: int) -> Column:
    """First rows (or columns) of a cell's windows. The guard matters: a sequence from high to low would count down."""
    none = F.array().cast("array<int>")
    regular = F.when(cell["low"] <= cell["high"], F.transform(F.sequence(cell["low"], F.greatest(cell["low"], cell["high"])), lambda k: k * stride)).otherwise(none)
    return F.concat(regular, F.when(cell["moved"], F.array(F.lit(size - window))).otherwise(none))


def explode_windows(pixels: DataFrame, height: int, width: int, window: int = WINDOW, stride: int = STRIDE, row: str = "r", col: str = "c") -> DataFrame:
    """A row for each pixel and window that holds it, with columns win_r and win_c."""
    window_origins(height, window, stride), window_origins(width, window, stride)  # raises if the window does not fit
    rows = F.explode(cell_origins(axis_cell(F.col(row), height, window, stride), height, window, stride))
    cols = F.explode(cell_origins(axis_cell(F.col(col), width, window, stride), width, window, stride))
    return pixels.withColumn("win_r", rows).withColumn("win_c", cols)


def _cells(pixels: DataFrame, sums: Mapping[str, Column], height: int, width: int, window: int, stride: int, row: str, col: str) -> DataFrame:
    window_origins(height, window, stride), window_origins(width, window, stride)
    keyed = pixels.withColumns({"_rows": axis_cell(F.col(row), height, window, stride), "_cols": axis_cell(F.col(col), width, window, stride)})
    summed = keyed.groupBy("_rows", "_cols").agg(*[s.alias(k) for k, s in sums.items()])
    rows = F.explode(cell_origins(F.col("_rows"), height, window, stride))
    cols = F.explode(cell_origins(F.col("_cols"), width, window, stride))
    return summed.withColumn("win_r", rows).withColumn("win_c", cols)


def window_sums(pixels: DataFrame, sums: Mapping[str, Column], height: int, width: int, window: int = WINDOW, stride: int = STRIDE, row: str = "r", col: str = "c") -> DataFrame:
    """win_r, win_c and sums (of pixel expressions such as F.count(...), F.sum(...)) that add up over cells."""
    cells = _cells(pixels, sums, height, width, window, stride, row, col)
    return cells.groupBy("win_r", "win_c").agg(*[F.sum(k).alias(k) for k in sums])


def _squares(k: str, mean: Column) -> Column:
    """Sum of squared deviations of a window: those about each cell's own mean, and of that about the window's."""

    def about(total: Column, cell: Column) -> Column:
        n, s, m = (cell[f"_{x}_{k}"] for x in "nsm")
        return total + F.coalesce(m + n * F.pow(F.try_divide(s, n) - mean, F.lit(2.0)), F.lit(0.0))

    return F.aggregate(f"_c_{k}", F.lit(0.0), about)


def window_stats(pixels: DataFrame, values: Mapping[str, Column], height: int, width: int, window: int = WINDOW, stride: int = STRIDE, std: bool = True, row: str = "r", col: str = "c") -> DataFrame:
    """win_r, win_c, n_px and, for each value, its mean and (population) standard deviation; missing values are passed over.

    Deviations are summed about the means of cells and these about the window's, so a large mean costs no digits.
    """
    sums: dict[str, Column] = {"n_px": F.count(F.lit(1))}
    pixels = pixels.withColumns({f"_v_{k}": v.cast("double") for k, v in values.items()})
    for k in values:
        v = F.col(f"_v_{k}")
        sums |= {f"_n_{k}": F.count(v), f"_s_{k}": F.sum(v)}
        if std:
            sums[f"_m_{k}"] = F.var_pop(v) * F.count(v)
    cells = _cells(pixels, sums, height, width, window, stride, row, col)
    totals = [F.sum(k).alias(k) for k in sums if not k.startswith("_m_")]
    if std:  # a window has a few cells, however many pixels
        totals += [F.collect_list(F.struct(f"_n_{k}", f"_s_{k}", f"_m_{k}")).alias(f"_c_{k}") for k in values]
    out = cells.groupBy("win_r", "win_c").agg(*totals)
    stats = []
    for k in values:
        n, mean = F.col(f"_n_{k}"), F.try_divide(f"_s_{k}", f"_n_{k}")
        stats.append(mean.alias(f"{k}_mean"))
        if std:
            stats.append(F.sqrt(F.try_divide(_squares(k, mean), n)).alias(f"{k}_std"))
    return out.select("win_r", "win_c", "n_px", *stats)


def overlap_fraction(mask: DataFrame, height: int, width: int, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Share of each window that a mask (distinct rows r, c) covers; windows that it does not touch have no row."""
    return window_sums(mask, {"n": F.count(F.lit(1))}, height, width, window, stride).select("win_r", "win_c", (F.col("n") / F.lit(float(window * window))).alias("frac"))


def all_windows(df_session, height: int, width: int, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """(win_r, win_c) of every window."""
    rows = df_session.createDataFrame([(r,) for r in window_origins(height, window, stride)], "win_r int")
    cols = F.explode(F.array(*[F.lit(c) for c in window_origins(width, window, stride)])).alias("win_c")
    return rows.select("win_r", cols)


def scatter_mean(scored: DataFrame, value: str, window: int = WINDOW) -> DataFrame:
    """(r, c, value): the mean over the windows that hold a pixel. Each window gives rows of columns, then pixels."""
    offsets = F.sequence(F.lit(0), F.lit(window - 1))
    rows = scored.withColumn("r", F.explode(F.transform(offsets, lambda k: F.col("win_r") + k)))
    pixels = rows.withColumn("c", F.explode(F.transform(offsets, lambda k: F.col("win_c") + k)))
    return pixels.groupBy("r", "c").agg(F.avg(value).alias(value))


def vote(scored: DataFrame, prediction: str, score: str, window: int = WINDOW) -> DataFrame:
    """(r, c, vote, score): at least half of the windows say 1; the score is counted from the least of all."""
    least = scored.agg(F.min(score).alias("_least"))  # one row
    shifted = scored.crossJoin(F.broadcast(least)).withColumn("_shifted", F.col(score) - F.col("_least"))
    offsets = F.sequence(F.lit(0), F.lit(window - 1))
    pixels = shifted.withColumn("r", F.explode(F.transform(offsets, lambda k: F.col("win_r") + k))).withColumn("c", F.explode(F.transform(offsets, lambda k: F.col("win_c") + k)))
    return pixels.groupBy("r", "c").agg(F.when(F.avg(prediction) >= 0.5, 1).otherwise(0).alias("vote"), F.avg("_shifted").alias("score"))
