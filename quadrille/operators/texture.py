"""Texture of windows: grey-level co-occurrence in DataFrame operations, Canny edge density per window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import grey_level
from ..storage import ship
from .windows import STRIDE, WINDOW, explode_windows

LEVEL_STEP = 4
CANNY = (50, 150)


def _grey_windows(px: DataFrame, band: str, height: int, width: int, window: int, stride: int) -> DataFrame:
    w = explode_windows(px.select("r", "c", F.col(band).cast("double").alias("v")), height, width, window, stride)
    part = Window.partitionBy("win_r", "win_c")
    return w.select("win_r", "win_c", "r", "c", grey_level(F.col("v"), F.min("v").over(part), F.max("v").over(part)).alias("g"))


def cooccurrence(px: DataFrame, band: str, height: int, width: int, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """(win_r, win_c, contrast, homogeneity, energy, correlation): symmetric pairs of neighbours in four directions, 64 levels, mean over directions.

    A direction whose levels do not vary has correlation 1.
    """
    q = _grey_windows(px, band, height, width, window, stride).withColumn("q", F.floor(F.col("g") / LEVEL_STEP).cast("int"))
    win = ("win_r", "win_c")
    orders = [
        Window.partitionBy(*win, "r").orderBy("c"), Window.partitionBy(*win, (F.col("r") - F.col("c"))).orderBy("r"),
        Window.partitionBy(*win, "c").orderBy("r"), Window.partitionBy(*win, (F.col("r") + F.col("c"))).orderBy("r"),
    ]
    for k, o in enumerate(orders):
        q = q.withColumn(f"n{k}", F.lead("q").over(o))
    pairs = q.select(*win, F.explode(F.array(*[F.struct(F.lit(k).alias("angle"), F.col("q").alias("i"), F.col(f"n{k}").alias("j")) for k in range(4)])).alias("p")).where("p.j is not null")
    both = pairs.select(*win, F.explode(F.array(F.struct("p.angle", "p.i", "p.j"), F.struct("p.angle", F.col("p.j").alias("i"), F.col("p.i").alias("j")))).alias("p")).select(*win, "p.*")
    n = both.groupBy(*win, "angle", "i", "j").agg(F.count(F.lit(1)).cast("double").alias("n"))
    d = (F.col("i") - F.col("j")) * (F.col("i") - F.col("j"))
    w = lambda x: F.sum(F.col("n") * x) / F.sum("n")
    angle = n.groupBy(*win, "angle").agg(
        w(d).alias("contrast"), w(1 / (1 + d)).alias("homogeneity"), (F.sqrt(F.sum(F.col("n") * F.col("n"))) / F.sum("n")).alias("energy"),
        w(F.col("i")).alias("m"), w(F.col("i") * F.col("i")).alias("s"), w(F.col("i") * F.col("j")).alias("x"),
    )
    spread = F.col("s") - F.col("m") * F.col("m")
    angle = angle.withColumn("correlation", F.when(spread > 1e-12, (F.col("x") - F.col("m") * F.col("m")) / spread).otherwise(1.0))
    return angle.groupBy(*win).agg(*[F.avg(c).alias(c) for c in ("contrast", "homogeneity", "energy", "correlation")])


def canny(grey: np.ndarray, low: float = CANNY[0], high: float = CANNY[1]) -> np.ndarray:
    """Edges of an 8-bit image: Sobel gradients, thinning along the gradient, strong edges and the weak ones joined to them."""
    g = np.pad(grey.astype(np.int64), 1, mode="edge")
    s = lambda dr, dc: g[1 + dr : g.shape[0] - 1 + dr, 1 + dc : g.shape[1] - 1 + dc]
    gx = s(-1, 1) + 2 * s(0, 1) + s(1, 1) - s(-1, -1) - 2 * s(0, -1) - s(1, -1)
    gy = s(1, -1) + 2 * s(1, 0) + s(1, 1) - s(-1, -1) - 2 * s(-1, 0) - s(-1, 1)
    size = np.abs(gx) + np.abs(gy)
    m = np.pad(size, 1)
    at = lambda dr, dc: m[1 + dr : m.shape[0] - 1 + dr, 1 + dc : m.shape[1] - 1 + dc]
    flat, steep = np.abs(gy) <= 0.4142 * np.abs(gx), np.abs(gy) >= 2.4142 * np.abs(gx)
    same = (gx >= 0) == (gy >= 0)
    before = np.select([flat, steep, same], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    after = np.select([flat, steep, same], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    ridge = (size > before) & (size >= after) & (size > low)
    edges = ridge & (size > high)
    while True:
        p = np.pad(edges, 1)
        near = np.zeros_like(edges)
        for dr in (0, 1, 2):
            for dc in (0, 1, 2):
                near |= p[dr : dr + edges.shape[0], dc : dc + edges.shape[1]]
        grown = ridge & near
        if (grown == edges).all():
            return edges
        edges = grown


def edge_density(px: DataFrame, band: str, height: int, width: int, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """(win_r, win_c, edge_density): the share of edge pixels. A window's pixels, few and of a fixed number, meet in one call."""
    ship(px.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        image = np.zeros((window, window), np.int64)
        r, c = group.column("win_r")[0].as_py(), group.column("win_c")[0].as_py()
        image[group.column("r").to_numpy() - r, group.column("c").to_numpy() - c] = group.column("g").to_numpy()
        return pa.table({"win_r": pa.array([r], pa.int32()), "win_c": pa.array([c], pa.int32()), "edge_density": [float(canny(image).mean())]})

    return _grey_windows(px, band, height, width, window, stride).groupBy("win_r", "win_c").applyInArrow(run, "win_r int, win_c int, edge_density double")
