"""Statistics of a probability raster in polygons, and detection tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import detected
from ..storage import materialize
from .ranks import quantiles


def zonal_stats(polygon_pixels: DataFrame, raster: DataFrame, polygons: DataFrame, value: str = "p") -> DataFrame:
    """(poly_id, mean_prob, max_prob, n_px) of the valid pixels of every polygon; none: null, null and 0."""
    px = polygon_pixels.join(raster.where(F.col(value).isNotNull()).select("r", "c", value), ["r", "c"])
    stats = px.groupBy("poly_id").agg(F.avg(value).alias("mean_prob"), F.max(value).alias("max_prob"), F.count(value).alias("n_px"))
    return polygons.select("poly_id").join(stats, "poly_id", "left").na.fill(0, ["n_px"])


def zonal_p90(polygon_pixels: DataFrame, raster: DataFrame, polygons: DataFrame, value: str = "p", share: float = 0.9) -> DataFrame:
    """As zonal_stats, with an exact percentile (linear between neighbours)."""
    px = polygon_pixels.join(raster.where(F.col(value).isNotNull()).select("r", "c", value), ["r", "c"])
    stats = px.groupBy("poly_id").agg(F.avg(value).alias("mean_prob"), F.max(value).alias("max_prob"), F.percentile(value, F.lit(share)).alias("p90_prob"))
    return polygons.select("poly_id").join(stats, "poly_id", "left")


def covered_fraction(polygon_pixels: DataFrame, coverage: DataFrame, polygons: DataFrame) -> DataFrame:
    """(poly_id, covered): the share of a polygon's pixels that are in the coverage (distinct rows r, c); no pixel: null."""
    px = polygon_pixels.join(coverage.select("r", "c", F.lit(1).alias("_in")), ["r", "c"], "left")
    stats = px.groupBy("poly_id").agg(F.avg(F.coalesce("_in", F.lit(0))).alias("covered"))
    return polygons.select("poly_id").join(stats, "poly_id", "left")


def scope(town: Column, core: Sequence[str], periphery: Sequence[str]) -> Column:
    """core, periphery or outside; an unknown town is outside."""
    name = F.coalesce(town, F.lit("?"))
    return F.when(name.isin(*core), "core").when(name.isin(*periphery), "periphery").otherwise("outside")


def detection_table(scored: DataFrame, thresholds: Sequence[float] = (0.5,), column: str = "max_prob") -> DataFrame:
    """(scope, threshold, n, detected_pct): the share of polygons that reach a threshold, by scope and for all; outside ones are left out."""
    t = scored.where("scope <> 'outside'").withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    hit = detected(F.col(column), F.col("threshold"))
    return t.cube("scope", "threshold").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("detected"), F.grouping_id().alias("_g")).where("_g in (0, 2)").select(
        F.coalesce("scope", F.lit("all")).alias("scope"), "threshold", "n", (F.col("detected") * 100).alias("detected_pct")
    )


def touched(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: polygons whose maximum reaches the threshold but whose mean does not."""
    return scored.agg(F.count_if((F.col("mean_prob") < threshold) & (F.col("max_prob") >= threshold)).alias("touched"))


def size_tertiles(scored: DataFrame, size: str, value: str, bins: int = 3, threshold: float = 0.5) -> DataFrame:
    """(size_bin, n, largest, detected_pct, median) by bins of equal counts: right-closed, edges at exact linear quantiles. Edges that coincide raise."""
    scored = materialize(scored, "scored")
    edges = quantiles(scored, size, [k / bins for k in range(bins + 1)])
    if edges[0] is not None and len(set(edges)) <= bins:
        raise ValueError(f"bin edges have to be unique: {edges}")
    binned = scored.withColumn("size_bin", F.size(F.filter(F.array(*[F.lit(e).cast("double") for e in edges[1:-1]]), lambda e: e < F.col(size))))
    return binned.groupBy("size_bin").agg(
        F.count(F.lit(1)).alias("n"), F.max(size).alias("largest"), (F.avg(detected(F.col(value), threshold)) * 100).alias("detected_pct"), F.percentile(value, F.lit(0.5)).alias("median")
    )


def quartiles(values: DataFrame, value: str) -> DataFrame:
    """One row: q25, median and q75, exact."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return values.agg(q.alias("q")).select(F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def union_scores(*layers: DataFrame) -> DataFrame:
    """Rows of score tables whose columns differ; a column that a layer lacks is null there."""
    out, *more = layers
    for m in more:
        out = out.unionByName(m, allowMissingColumns=True)
    return out
