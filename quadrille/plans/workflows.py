"""The workflows from bands to object scores, as plans of the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import BANDS, INDICES, index
from ..grid import GridSpec
from ..operators import labels, metrics, models, objects, similar, terrain, texture, vectors, windows, zonal
from ..sources import tables
from ..storage import materialize


@dataclass(frozen=True)
class Settings:
    """Feature groups and sizes; a source that is not given turns its group off."""

    window: int = windows.WINDOW
    stride: int = windows.STRIDE
    indices: Sequence[str] = tuple(INDICES)
    texture_band: str | None = None
    edges: bool = False
    metric: str = "cosine"
    trees: int = 300
    fold_block: int = 800
    socio_clip: Mapping[str, float] = field(default_factory=lambda: {"vuln_mean": 1.0, "landslide_mean": 1.0, "flood_mean": 1.0})


def feature_table(bands: DataFrame, grid: GridSpec, s: Settings = Settings(), dsm: DataFrame | None = None, classes: DataFrame | None = None, socio: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(win_r, win_c, features): one shuffle for bands and indices, one for each further layer. Missing or infinite statistics become 0, socio means stay null."""
    at = (grid.height, grid.width, s.window, s.stride)
    values = {b: F.col(b) for b in BANDS if b in bands.columns} | {i: index(i) for i in s.indices}
    from ..functions.missing import clip_max, finite_or_zero

    out = windows.window_stats(bands, values, *at).drop("n_px")
    out = out.select("win_r", "win_c", *[finite_or_zero(F.col(c)).alias(c) for c in out.columns if c not in ("win_r", "win_c")])
    keys = ["win_r", "win_c"]
    if s.texture_band:
        g = texture.cooccurrence(bands, s.texture_band, *at)
        out = out.join(g.select(*keys, *[F.col(c).alias(f"GLCM_{c}") for c in g.columns if c not in keys]), keys, "left")
    if s.edges and s.texture_band:
        out = out.join(texture.edge_density(bands, s.texture_band, *at), keys, "left")
    if dsm is not None:
        out = out.join(terrain.terrain_features(dsm, *at), keys, "left").na.fill(0.0, list(tables.TERRAIN))
    if classes is not None:
        out = out.join(terrain.class_shares(classes, *at), keys, "left")
    for k, (name, layer) in enumerate((socio or {}).items()):
        v = clip_max(F.col("v"), s.socio_clip[name]) if name in s.socio_clip else F.col("v")
        w = windows.window_sums(layer.withColumn("v", v), {"_s": F.sum("v"), "_n": F.count("v")}, *at)
        flag = [(F.col("_n") > 0).cast("int").alias("has_socio")] if k == 0 else []
        out = out.join(w.select(*keys, F.try_divide("_s", "_n").alias(name), *flag), keys, "left")
    return out.na.fill(0, ["has_socio"]) if socio else out


def similarity_map(features: DataFrame, columns: Sequence[str], is_reference, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Windows with ``similarity`` (features scaled over all windows first), and the mean of the windows over each pixel (r, c, similarity)."""
    scaled = similar.zscores(features.withColumn("_ref", is_reference), list(columns)).select("win_r", "win_c", "_ref", *columns)
    scored = similar.scored(scaled, columns, F.col("_ref"), s.metric).select("win_r", "win_c", "similarity")
    return features.join(scored, ["win_r", "win_c"]), windows.scatter_mean(scored, "similarity", s.window)


@dataclass
class Trained:
    oof: DataFrame
    importance: DataFrame
    raster: DataFrame
    clipped: DataFrame | None


def train(features: DataFrame, columns: Sequence[str], truth_edges: DataFrame, grid: GridSpec, s: Settings = Settings(), in_scope=None, coverage: DataFrame | None = None, seed: int = 42) -> Trained:
    """Labels, negatives, folds, out-of-fold forests and the probability raster; clipped to ``coverage`` (distinct r, c) at the end only.

    Training windows are those in scope, every window is scored. Windows not covered by a score have probability 0 in the raster.
    """
    keys = ["win_r", "win_c"]
    truth = vectors.mask(truth_edges, grid.height, grid.width)
    frac = windows.overlap_fraction(truth, grid.height, grid.width, s.window, s.stride)
    rows = features.join(labels.built_up(features), keys).join(frac, keys, "left").withColumn("label", labels.label(F.col("frac"))).withColumn("block_id", grid.block_id(F.col("win_r"), F.col("win_c"), s.fold_block))
    rows = materialize(rows.drop("frac"), "windows")
    scoped = labels.in_scope(rows, in_scope) if in_scope is not None else rows
    sample = materialize(labels.training_sample(scoped.where("label <> 'ambiguous'"), keys, seed), "sample")
    data = rows.join(F.broadcast(labels.folds(rows, seed=seed)), "block_id").join(sample, keys, "left")
    cv = models.cross_validate(data, columns, keys, s.trees, seed=seed)
    oof = cv.scores.join(sample, keys, "left").select(*keys, "prob", F.coalesce("y", F.lit(0)).alias("y"), F.col("y").isNotNull().alias("is_train"), F.coalesce("is_hard", F.lit(False)).alias("is_hard"))
    oof = materialize(oof, "oof")
    raster = windows.scatter_mean(oof.withColumn("p", F.coalesce("prob", F.lit(0.0))), "p", s.window)
    clipped = raster.join(coverage.select("r", "c"), ["r", "c"], "left_semi") if coverage is not None else None
    return Trained(oof, models.importance_rows(features.sparkSession, cv), raster, clipped)


def oof_metrics(oof: DataFrame) -> DataFrame:
    """(which, auc, ap): for all training windows, and for positives against hard negatives only."""
    t = oof.where("is_train")
    parts = {"all": t, "hard": t.where("is_hard or y = 1")}
    out = None
    for name, rows in parts.items():
        r = metrics.roc_auc(rows, score="prob").crossJoin(metrics.average_precision(rows, score="prob")).select(F.lit(name).alias("which"), "auc", "ap")
        out = r if out is None else out.unionByName(r)
    return out


def unseen_test(features_scored: DataFrame, unseen_frac: DataFrame, known_frac: DataFrame, least: int = 5, background: int = 50_000, seed: int = 42) -> DataFrame | None:
    """AUC of windows on unseen polygons against a drawn background; None with ``least`` or fewer such windows."""
    keys = ["win_r", "win_c"]
    positive = features_scored.join(unseen_frac.where("frac >= 0.5").select(*keys), keys, "left_semi")
    if positive.limit(least + 1).count() <= least:
        return None
    touched = unseen_frac.where("frac > 0").select(*keys).unionByName(known_frac.where("frac > 0").select(*keys))
    rest = labels.top(features_scored.join(touched, keys, "left_anti"), background, labels.draw(seed, *[F.col(k) for k in keys]), *keys)
    return metrics.roc_auc(positive.withColumn("y", F.lit(1)).unionByName(rest.withColumn("y", F.lit(0))), score="prob")


def evaluate(raster: DataFrame, truth_edges: DataFrame, polygons: DataFrame, grid: GridSpec, coverage: DataFrame, thresholds: Sequence[float] = (0.5, 0.7, 0.8, 0.9), least_ha: float = 0.5, filter_ha: float = 1.0, filter_mean: float = 0.6):
    """Polygon scores, detection by scope, and the object table of a probability raster (r, c, p). ``polygons``: poly_id and scope."""
    px = materialize(vectors.rasterize(truth_edges, grid.height, grid.width), "polygon-pixels")
    valid = raster.join(coverage.select("r", "c"), ["r", "c"], "left_semi")
    scores = polygons.join(zonal.zonal_p90(px, valid, polygons), "poly_id").join(zonal.covered_fraction(px, coverage, polygons), "poly_id")
    detection = zonal.detection_table(scores, thresholds)
    table = objects.operating_table(valid, grid.width, thresholds, grid.region_pixels(least_ha), grid.region_pixels(filter_ha), filter_mean, px.select("r", "c").distinct(), px, polygons)
    return scores, detection, table


def validate(raster: DataFrame, truth: DataFrame, threshold: float | None = None, per_class: int | None = None, value: str = "p", seed: int = 42) -> dict[str, DataFrame]:
    """Pixel metrics: report, curves and the error map. Only valid pixels count; with ``per_class`` a drawn sample of each class, but the map is of the whole grid.

    Without a threshold the one of the best F1 is taken.
    """
    y = raster.where(F.col(value).isNotNull()).join(truth.select("r", "c", F.lit(1).alias("_t")), ["r", "c"], "left")
    scores = y.select(F.concat_ws(":", "r", "c").alias("id"), F.coalesce("_t", F.lit(0)).alias("y"), F.col(value).alias("s"))
    scores = materialize(labels.stratified_sample(scores, per_class, seed=seed) if per_class else scores, "scores")
    t = threshold if threshold is not None else metrics.best_f1(scores).first()["threshold"]
    return {
        "report": metrics.report(metrics.confusion(scores, t)), "auc": metrics.roc_auc(scores), "ap": metrics.average_precision(scores), "roc": metrics.roc_curve(scores),
        "pr": metrics.pr_curve(scores), "calibration": metrics.calibration(scores), "error_map": metrics.error_map(truth, raster, t, value),
    }
