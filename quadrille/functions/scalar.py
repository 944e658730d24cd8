"""Scalar rules: slope, grey levels, stretches, rounding, names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bands import EPS

SOCIO_NAMES = ("vuln", "lowincome", "flood", "landslide", "has_socio")
TERRAIN_NAMES = ("DSM", "slope")


def slope_degrees(gx: Column, gy: Column, pixel_metres: float = 10.0) -> Column:
    return F.degrees(F.atan(F.sqrt(gx * gx + gy * gy) / F.lit(float(pixel_metres))))


def grey_level(v: Column, low: Column, high: Column) -> Column:
    """Scale to 0..255, cut down; a constant or unknown range gives 0."""
    scaled = F.floor(F.least(F.greatest((v - low) / (high - low) * 255, F.lit(0.0)), F.lit(255.0)))
    return F.when((high - low) >= EPS, scaled).otherwise(0).cast("int")


def stretch(v: Column, low: Column, high: Column) -> Column:
    """Display value 0..255 between two percentiles."""
    return F.floor(F.least(F.greatest((v - low) / (high - low + F.lit(EPS)), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def one_decimal(c: Column) -> Column:
    """Rounded to one place, halves to even."""
    return F.bround(c, 1)


def feature_group(name: Column) -> Column:
    socio = name.rlike("|".join(map(re.escape, SOCIO_NAMES)))
    return F.when(socio, "socio").when(name.rlike("|".join(TERRAIN_NAMES)), "terrain").otherwise("spectral")


def repair_name(s: str | None) -> str | None:
    """Undo UTF-8 that was read as Latin-1. What is not such text loses the bytes that UTF-8 does not allow."""
    if s is None:
        return None
    try:
        return s.encode("latin-1").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return s.encode("cp1252", "ignore").decode("utf-8", "ignore")


def fix_encoding(name: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(repair_name, na_action="ignore")

    return run(name)
