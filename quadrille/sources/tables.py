"""Feature tables, score tables and training artifacts."""

from __future__ import annotations

import os
import shutil
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import BANDS, INDICES
from ..grid import GridSpec

KEYS = ("row", "col", "map_x", "map_y", "similarity")
TERRAIN = ("DSM_mean", "DSM_std", "DSM_roughness", "DSM_slope_mean", "DSM_slope_std")
SOCIO = ("vuln_mean", "landslide_mean", "flood_mean", "lowincome_mean")
TEXTURE = ("GLCM_contrast", "GLCM_homogeneity", "GLCM_energy", "GLCM_correlation")
COMPOSITION = ("pct_ceramic", "pct_fiber", "pct_paved", "pct_soil", "pct_veg", "informality", "formality")


def feature_names(spectral: bool = True, indices: Sequence[str] = tuple(INDICES), texture: bool = False, edge: bool = False, terrain: bool = True, composition: bool = False, socio: bool = True) -> list[str]:
    """Feature columns in their order, by the groups that are on."""
    both = lambda names: [f"{n}_{s}" for n in names for s in ("mean", "std")]
    return [
        *(both(BANDS) if spectral else []), *both(indices), *(TEXTURE if texture else ()), *(["edge_density"] if edge else []),
        *(TERRAIN if terrain else ()), *(COMPOSITION if composition else ()), *((*SOCIO, "has_socio") if socio else ()),
    ]


def schema(features: Sequence[str]) -> str:
    return "row int, col int, map_x double, map_y double, similarity double, " + ", ".join(f"{f} {'int' if f == 'has_socio' else 'double'}" for f in features)


def with_map_coordinates(windows: DataFrame, features: Sequence[str], grid: GridSpec, window: int) -> DataFrame:
    """Keys and features as they are stored: centre coordinates to 4 places, similarity and features to 6."""
    x, y = grid.window_centre(F.col("win_r"), F.col("win_c"), window)
    return windows.select(
        F.col("win_r").alias("row"), F.col("win_c").alias("col"), F.bround(x, 4).alias("map_x"), F.bround(y, 4).alias("map_y"), F.bround("similarity", 6).alias("similarity"),
        *[F.col(f) if f == "has_socio" else F.bround(F.col(f).cast("double"), 6).alias(f) for f in features],
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    return spark.read.schema(schema(features)).option("header", True).csv(path)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS]


def replace_columns(spark: SparkSession, path: str, more: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Join new columns to the Parquet table at a local ``path``, in place of any of their names, and put the result in its place.

    The new table is written beside the old one first, since a table cannot be overwritten while it is read. Running it again changes nothing.
    """
    new = [c for c in more.columns if c not in keys]
    joined = spark.read.parquet(path).drop(*new).join(more, list(keys), "left")
    beside = path.rstrip("/") + ".new"
    joined.write.mode("overwrite").parquet(beside)
    shutil.rmtree(path)
    os.rename(beside, path)
    return spark.read.parquet(path)


def write_artifacts(path: str, oof: DataFrame, importance: DataFrame) -> None:
    """Out-of-fold rows (keys, prob, y, is_train, is_hard) and importances (feature, importance), as tables."""
    oof.write.mode("overwrite").parquet(f"{path}/oof")
    importance.write.mode("overwrite").parquet(f"{path}/importance")


def read_artifacts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/oof"), spark.read.parquet(f"{path}/importance")
