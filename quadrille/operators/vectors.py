"""Polygons as edge tables: rasterizing, areas, boxes.

An edge row is (poly_id, part, ring, seq, x1, y1, x2, y2). Holes and parts need no care of their own: a centre is inside if a
ray crosses the edges of its polygon an odd number of times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import GridSpec


def to_pixel_space(edges: DataFrame, grid: GridSpec) -> DataFrame:
    """Map coordinates to (column, row) coordinates of a grid."""
    return edges.withColumns({
        "x1": (F.col("x1") - grid.c) / grid.a, "x2": (F.col("x2") - grid.c) / grid.a,
        "y1": (F.col("y1") - grid.f) / grid.e, "y2": (F.col("y2") - grid.f) / grid.e,
    })


def rasterize(edges: DataFrame, height: int, width: int) -> DataFrame:
    """(poly_id, r, c): pixels whose centre lies in a polygon, by scan lines. Work follows edge rows and output, not the grid.

    An edge gives its crossing in each row of centres that it spans; the sorted crossings of a row pair up to runs of columns. Centres on
    an edge belong to the side of larger coordinates.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(F.ceil(low - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil(high - 0.5) - 1, F.lit(height - 1)).cast("int")
    rows = edges.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("r", F.explode(F.sequence("_first", "_last")))
    x = F.col("x1") + (F.col("r") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossings = rows.select("poly_id", "r", x.alias("x"))
    order = Window.partitionBy("poly_id", "r").orderBy("x")  # crossings of one polygon in one row
    runs = crossings.withColumns({"_n": F.row_number().over(order), "_to": F.lead("x").over(order)}).where("_n % 2 = 1 and _to is not null")
    runs = runs.select("poly_id", "r", F.greatest(F.ceil(F.col("x") - 0.5), F.lit(0)).cast("int").alias("_a"), F.least(F.ceil(F.col("_to") - 0.5) - 1, F.lit(width - 1)).cast("int").alias("_b"))
    return runs.where("_a <= _b").select("poly_id", "r", F.explode(F.sequence("_a", "_b")).alias("c"))


def mask(edges: DataFrame, height: int, width: int) -> DataFrame:
    """Distinct pixels (r, c) of all polygons."""
    return rasterize(edges, height, width).select("r", "c").distinct()


def burn(edges: DataFrame, polygons: DataFrame, value: str, height: int, width: int, order: str = "poly_id") -> DataFrame:
    """(r, c, value): the value of the last polygon, by ``order``, that holds a pixel; polygons without a value are left out."""
    v = polygons.where(F.col(value).isNotNull()).select("poly_id", F.col(value).alias("_v"), F.col(order).alias("_o"))
    return rasterize(edges, height, width).join(v, "poly_id").groupBy("r", "c").agg(F.max_by("_v", F.struct("_o", "poly_id")).alias(value))


def area(edges: DataFrame, unit: float = 1.0) -> DataFrame:
    """(poly_id, area): planar area of outer rings less holes, divided by ``unit`` (10 000 for hectares of metre coordinates)."""
    rings = edges.groupBy("poly_id", "part", "ring").agg(F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("a"))
    return rings.groupBy("poly_id").agg((F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))) / F.lit(float(unit))).alias("area"))


def boxes(edges: DataFrame) -> DataFrame:
    return edges.groupBy("poly_id").agg(F.min("x1").alias("left"), F.min("y1").alias("bottom"), F.max("x1").alias("right"), F.max("y1").alias("top"))


def box_edges(left: float, bottom: float, right: float, top: float) -> list[tuple[float, float, float, float]]:
    corners = [(left, bottom), (right, bottom), (right, top), (left, top)]
    return [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]


def _cuts_box(x1: Column, y1: Column, x2: Column, y2: Column, left: float, bottom: float, right: float, top: float) -> Column:
    """Whether a segment meets a box: clip its parameter range by the four sides (Liang and Barsky)."""
    dx, dy = x2 - x1, y2 - y1
    low, high = F.lit(0.0), F.lit(1.0)
    ok = F.lit(True)
    for p, q in ((-dx, x1 - left), (dx, F.lit(right) - x1), (-dy, y1 - bottom), (dy, F.lit(top) - y1)):
        t = F.try_divide(q, p)
        low = F.when(p < 0, F.greatest(low, t)).otherwise(low)
        high = F.when(p > 0, F.least(high, t)).otherwise(high)
        ok = ok & ((p != 0) | (q >= 0))
    return ok & (low <= high)


def intersecting_box(edges: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """(poly_id) of polygons that meet a box: an edge cuts it, or the polygon holds it whole. Far edges are dropped first where stored boxes allow."""
    cuts = _cuts_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), left, bottom, right, top)
    crosses = ((F.col("y1") <= bottom) != (F.col("y2") <= bottom)) & (F.col("x1") + (F.lit(bottom) - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) > left)
    marks = edges.groupBy("poly_id").agg(F.max(cuts.cast("int")).alias("cut"), F.sum(F.coalesce(crosses, F.lit(False)).cast("int")).alias("crossings"))
    return marks.where("cut = 1 or crossings % 2 = 1").select("poly_id")
