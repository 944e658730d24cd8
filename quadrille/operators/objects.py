"""Objects of a thresholded raster: labels, sizes, filters, hits, outlines.

Labels are found tile by tile (a tile's pixels are bounded), and what touches across tile borders is joined by components of the border's edge list.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import broadcast_if_few, materialize, ship
from .components import components

TILE = 256
HIT_SHARE = 0.25


def label_tile(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For pixels of one tile: the position of each one's first pixel, in raster order, of its 4-connected part. Runs of a row are united."""
    order = np.lexsort((c, r))
    r, c = r[order], c[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)))
    run_of = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    stop = np.concatenate((start[1:], [len(r)])) - 1
    up = list(range(len(start)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    rows, lo, hi = r[start].tolist(), c[start].tolist(), c[stop].tolist()
    j = 0
    for i in range(len(rows)):
        while rows[j] < rows[i] - 1 or (rows[j] == rows[i] - 1 and hi[j] < lo[i]):
            j += 1
        k = j
        while k < i and rows[k] == rows[i] - 1 and lo[k] <= hi[i]:
            a, b = root(k), root(i)
            if a != b:
                up[max(a, b)] = min(a, b)
            k += 1
    roots = np.array([root(i) for i in range(len(rows))], np.int64)
    out = np.empty(len(r), np.int64)
    out[order] = order[start[roots[run_of]]]
    return out


def label(pixels: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """(r, c, blob_id): 4-connected components of distinct pixels; an id is the smallest r * width + c of its component."""
    ship(pixels.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        r, c = group.column("r").to_numpy().astype(np.int64), group.column("c").to_numpy().astype(np.int64)
        first = label_tile(r, c)
        return pa.table({"r": r, "c": c, "part": r[first] * width + c[first]})

    tiles = pixels.select(F.col("r").cast("long"), F.col("c").cast("long"), F.floor(F.col("r") / tile).alias("_tr"), F.floor(F.col("c") / tile).alias("_tc"))
    parts = materialize(tiles.groupBy("_tr", "_tc").applyInArrow(run, "r long, c long, part long"), "parts")
    border = parts.where(F.expr(f"r % {tile} in (0, {tile - 1}) or c % {tile} in (0, {tile - 1})"))
    here = border.select("r", "c", F.col("part").alias("a"))
    below = border.where(F.expr(f"r % {tile} = 0")).select((F.col("r") - 1).alias("r"), "c", F.col("part").alias("b"))
    right = border.where(F.expr(f"c % {tile} = 0")).select("r", (F.col("c") - 1).alias("c"), F.col("part").alias("b"))
    edges = here.join(below.unionByName(right), ["r", "c"]).select("a", "b")
    tied = broadcast_if_few(components(edges))
    return parts.join(tied, parts["part"] == tied["a"], "left").select("r", "c", F.coalesce("b", "part").alias("blob_id"))


def exact_mean(value: str) -> Column:
    """The mean without rounding on the way, so no order of the rows moves it across a threshold.

    Values are summed as decimals of 18 places where these stand for every double of a group, as they do for all from 0.01 up to 10^10; else as doubles.
    """
    v = F.col(value).cast("double")
    d = v.try_cast("decimal(28,18)")
    return F.when(F.count(v) == F.count_if(d.cast("double") == v), F.avg(d).cast("double")).otherwise(F.avg(v))


def sizes(labelled: DataFrame, raster: DataFrame, value: str = "p") -> DataFrame:
    """(blob_id, n_px, mean_prob, max_prob)."""
    return labelled.join(raster.select("r", "c", value), ["r", "c"]).groupBy("blob_id").agg(F.count(F.lit(1)).alias("n_px"), exact_mean(value).alias("mean_prob"), F.max(value).alias("max_prob"))


def large(stats: DataFrame, least_px: int, least_mean: float | None = None) -> DataFrame:
    kept = stats.where(F.col("n_px") >= least_px)
    return kept if least_mean is None else kept.where(F.col("mean_prob") >= least_mean)


def big(stats: DataFrame, pixel_ha: float, least_ha: float = 2.0) -> DataFrame:
    """Objects of at least so many hectares, with ``area_ha``."""
    return stats.withColumn("area_ha", F.col("n_px") * F.lit(pixel_ha)).where(F.col("area_ha") >= least_ha)


def hits(labelled: DataFrame, kept: DataFrame, truth: DataFrame) -> DataFrame:
    """(blob_id) of kept objects that hold a truth pixel (distinct rows r, c)."""
    return labelled.join(truth.select("r", "c"), ["r", "c"], "left_semi").select("blob_id").distinct().join(kept.select("blob_id"), "blob_id", "left_semi")


def misses(kept: DataFrame, hit: DataFrame) -> DataFrame:
    """Kept objects without a hit, the most probable first."""
    return kept.join(hit, "blob_id", "left_anti").orderBy(F.desc("max_prob"), "blob_id")


def truth_share(polygon_pixels: DataFrame, labelled: DataFrame, kept: DataFrame, polygons: DataFrame) -> DataFrame:
    """(poly_id, share): the share of a truth polygon's pixels in kept objects; a polygon without pixels has 0."""
    on = labelled.join(kept.select("blob_id"), "blob_id", "left_semi").select("r", "c", F.lit(1).alias("_on"))
    share = polygon_pixels.join(on, ["r", "c"], "left").groupBy("poly_id").agg(F.avg(F.coalesce("_on", F.lit(0))).alias("share"))
    return polygons.select("poly_id").join(share, "poly_id", "left").na.fill(0.0, ["share"])


def precision_recall(labelled: DataFrame, kept: DataFrame, truth: DataFrame, polygon_pixels: DataFrame, polygons: DataFrame, least_share: float = HIT_SHARE) -> DataFrame:
    """One row: n_pred, precision (hits over kept) and recall (truth polygons covered by at least ``least_share``)."""
    n = kept.agg(F.count(F.lit(1)).alias("n_pred"))
    h = hits(labelled, kept, truth).agg(F.count(F.lit(1)).alias("_hits"))
    r = truth_share(polygon_pixels, labelled, kept, polygons).agg(F.count_if(F.col("share") >= least_share).alias("_found"), F.count(F.lit(1)).alias("_all"))
    one = n.crossJoin(h).crossJoin(r)
    return one.select("n_pred", (F.col("_hits") / F.greatest("n_pred", F.lit(1))).alias("precision"), (F.col("_found") / F.greatest("_all", F.lit(1))).alias("recall"))


def operating_table(raster: DataFrame, width: int, thresholds: Sequence[float], least_px: int, filter_px: int, filter_mean: float, truth: DataFrame, polygon_pixels: DataFrame, polygons: DataFrame) -> DataFrame:
    """A row a threshold: n_pred, precision and recall for all objects of ``least_px``, and (``_filt``) for those of the stricter filter."""
    out = None
    for t in thresholds:
        on = materialize(label(raster.where(F.col("p") >= t).select("r", "c"), width), "labels")
        stats = materialize(sizes(on, raster), "sizes")
        raw = precision_recall(on, large(stats, least_px), truth, polygon_pixels, polygons)
        strict = precision_recall(on, large(stats, filter_px, filter_mean), truth, polygon_pixels, polygons)
        row = raw.crossJoin(strict.select(*[F.col(c).alias(f"{c}_filt") for c in strict.columns])).select(F.lit(float(t)).alias("threshold"), "*")
        out = row if out is None else out.unionByName(row)
    return out.orderBy("threshold")


def outline_edges(labelled: DataFrame) -> DataFrame:
    """(blob_id, x1, y1, x2, y2): pixel sides whose other side is not of the object, in grid units, the object to the right of each."""
    sides = ((0, -1, "c", "r", "c + 1", "r"), (1, 0, "c + 1", "r", "c + 1", "r + 1"), (0, 1, "c + 1", "r + 1", "c", "r + 1"), (-1, 0, "c", "r + 1", "c", "r"))
    each = labelled.withColumn("s", F.explode(F.array(*[F.struct(F.expr(f"r + {dr}").alias("nr"), F.expr(f"c + {dc}").alias("nc"), *[F.expr(e).alias(n) for e, n in zip(xy, ("x1", "y1", "x2", "y2"), strict=True)]) for dc, dr, *xy in sides])))
    near = labelled.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("blob_id").alias("_b"))
    out = each.join(near, (F.col("s.nr") == F.col("_r")) & (F.col("s.nc") == F.col("_c")) & (F.col("blob_id") == F.col("_b")), "left_anti")
    return out.select("blob_id", "s.x1", "s.y1", "s.x2", "s.y2")


def stitch(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings from directed unit edges; where four meet, the ring turns right, so parts that touch at a corner stay apart."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b, c, d in zip(x1.tolist(), y1.tolist(), x2.tolist(), y2.tolist(), strict=True):
        out.setdefault((a, b), []).append((c, d))
    rings = []
    while out:
        start = min(out)
        at, ring, came = start, [start], None
        while True:
            nexts = out[at]
            if len(nexts) > 1 and came:
                dx, dy = at[0] - came[0], at[1] - came[1]
                nexts.sort(key=lambda n: (n[0] - at[0], n[1] - at[1]) != (-dy, dx))
            to = nexts.pop(0)
            if not nexts:
                del out[at]
            came, at = at, to
            if at == start and (at not in out or len(ring) > 2):
                break
            if len(ring) > 1 and (ring[-1][0] - ring[-2][0], ring[-1][1] - ring[-2][1]) == (to[0] - came[0], to[1] - came[1]):
                ring[-1] = to
            else:
                ring.append(to)
        rings.append(ring)
    return rings


def polygonize(labelled: DataFrame) -> DataFrame:
    """(blob_id, ring, signed_area, points): outlines of objects; rings with positive area are outer, the others holes.

    An object's outline edges are stitched in one task: they follow its perimeter, not its area.
    """
    ship(labelled.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        xs = [group.column(k).to_numpy() for k in ("x1", "y1", "x2", "y2")]
        rings = stitch(*xs)
        blob = group.column("blob_id")[0].as_py()
        area = [sum(a * d - c * b for (a, b), (c, d) in zip(r, r[1:] + r[:1], strict=True)) / 2 for r in rings]
        return pa.table({
            "blob_id": pa.array([blob] * len(rings), pa.int64()), "ring": pa.array(range(len(rings)), pa.int32()), "signed_area": pa.array(area, pa.float64()),
            "points": pa.array([[list(map(float, p)) for p in r] for r in rings], pa.list_(pa.list_(pa.float64()))),
        })

    return outline_edges(labelled).groupBy("blob_id").applyInArrow(run, "blob_id long, ring int, signed_area double, points array<array<double>>")


def dissolve(rings: DataFrame) -> DataFrame:
    """(blob_id, n_rings, area, wkt): one multipolygon text for each object."""
    text = F.concat(F.lit("("), F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))), ", "), F.lit(")"))
    return rings.withColumn("t", text).groupBy("blob_id").agg(
        F.count(F.lit(1)).alias("n_rings"), F.sum("signed_area").alias("area"),
        F.concat(F.lit("MULTIPOLYGON (("), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("signed_area")).alias("k"), "ring", "t"))), lambda x: x["t"]), ", "), F.lit("))")).alias("wkt"),
    )
