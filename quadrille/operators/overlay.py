"""Share of a polygon that lies in a union of polygons, exactly.

Between two neighbouring heights of vertices and crossings, edges neither end nor cross, so the shared length is linear in height and its value
half-way gives the area of the slab exactly. Pairs of polygons are found by an equality join on coarse cells of their boxes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import one_decimal
from ..storage import ship
from .vectors import boxes


def _spans(edges: np.ndarray, y: float) -> np.ndarray:
    """Sorted crossings of a polygon's edges with a height, as (from, to) rows."""
    on = (edges[:, 1] <= y) != (edges[:, 3] <= y)
    e = edges[on]
    x = np.sort(e[:, 0] + (y - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1]))
    return x.reshape(-1, 2)


def _crossing_heights(e: np.ndarray) -> np.ndarray:
    out = [np.zeros(0)]
    for i in range(len(e)):
        x1, y1, x2, y2 = e[i]
        o = e[i + 1 :]
        d1x, d1y, d2x, d2y = x2 - x1, y2 - y1, o[:, 2] - o[:, 0], o[:, 3] - o[:, 1]
        det = d1x * d2y - d1y * d2x
        ok = np.abs(det) > 1e-300
        t = np.where(ok, ((o[:, 0] - x1) * d2y - (o[:, 1] - y1) * d2x) / np.where(ok, det, 1), -1)
        u = np.where(ok, ((o[:, 0] - x1) * d1y - (o[:, 1] - y1) * d1x) / np.where(ok, det, 1), -1)
        hit = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        out.append(y1 + t[hit] * d1y)
    return np.concatenate(out)


def shared_area(a: np.ndarray, others: list[np.ndarray]) -> tuple[float, float]:
    """Area of polygon ``a`` (rows x1, y1, x2, y2; even-odd) and of its part inside the union of the others."""
    every = np.vstack([a, *others]) if others else a
    heights = np.unique(np.concatenate([every[:, 1], every[:, 3], _crossing_heights(every)]))
    heights = heights[(heights >= a[:, [1, 3]].min()) & (heights <= a[:, [1, 3]].max())]
    own = both = 0.0
    for lo, hi in zip(heights, heights[1:], strict=False):
        y = (lo + hi) / 2
        mine = _spans(a, y)
        own += (mine[:, 1] - mine[:, 0]).sum() * (hi - lo)
        theirs = [s for o in others for s in _spans(o, y).tolist()]
        union: list[list[float]] = []
        for s in sorted(theirs):
            if union and s[0] <= union[-1][1]:
                union[-1][1] = max(union[-1][1], s[1])
            else:
                union.append(s)
        both += sum(max(0.0, min(m[1], u[1]) - max(m[0], u[0])) for m in mine.tolist() for u in union) * (hi - lo)
    return float(own), float(both)


def overlap_percent(edges: DataFrame, others: DataFrame, cell: float) -> DataFrame:
    """(poly_id, overlap_pct): percent of each polygon of ``edges`` inside the union of ``others``, to one decimal place.

    ``cell`` is the size of the cells that pair polygons up, about that of a polygon. A polygon meets in one task only those whose boxes touch its own.
    """
    ship(edges.sparkSession)
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    cells = lambda df: boxes(df).withColumn("_x", F.explode(span("left", "right"))).withColumn("_y", F.explode(span("bottom", "top")))
    a, b = cells(edges), cells(others).select("_x", "_y", F.col("poly_id").alias("other"), *[F.col(k).alias(f"o_{k}") for k in ("left", "bottom", "right", "top")])
    touch = (F.col("left") <= F.col("o_right")) & (F.col("o_left") <= F.col("right")) & (F.col("bottom") <= F.col("o_top")) & (F.col("o_bottom") <= F.col("top"))
    pairs = a.join(b, ["_x", "_y"]).where(touch).select("poly_id", "other").distinct()
    xy = ("x1", "y1", "x2", "y2")
    theirs = pairs.join(others.select(F.col("poly_id").alias("other"), *xy), "other").select("poly_id", "other", *xy)
    rows = edges.select("poly_id", F.lit(None).cast("long").alias("other"), *xy).unionByName(theirs)

    def run(group: pa.Table) -> pa.Table:
        e = np.stack([group.column(k).to_numpy() for k in xy], 1)
        who = np.array([-1 if x is None else x for x in group.column("other").to_pylist()], np.int64)
        none = np.array([x is None for x in group.column("other").to_pylist()])
        own, both = shared_area(e[none], [e[~none & (who == k)] for k in np.unique(who[~none])])
        return pa.table({"poly_id": pa.array([group.column("poly_id")[0].as_py()], pa.int64()), "pct": [100 * both / own if own else 0.0]})

    shares = rows.groupBy("poly_id").applyInArrow(run, "poly_id long, pct double")
    return shares.select("poly_id", one_decimal(F.col("pct")).alias("overlap_pct"))


def unseen(overlaps: DataFrame) -> DataFrame:
    """Polygons whose overlap, after rounding, is 0."""
    return overlaps.where("overlap_pct = 0")
