"""Coordinate systems: geographic degrees and UTM on GRS80 (Krueger series to the fourth order), as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_A, _F, _K0, _FE, _FN = 6378137.0, 1 / 298.257222101, 0.9996, 500_000.0, 10_000_000.0
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = math.sqrt(_F * (2 - _F))
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
#: Central meridians of the southern UTM zones in use; 4326 and 4674 are degrees and count as equal.
UTM_SOUTH = {31984: -39.0, 31985: -33.0}
DEGREES = (4326, 4674)


def _series(u: Column, v: Column, k: tuple[float, ...], sign: int) -> tuple[Column, Column]:
    a, b = u, v
    for j, x in enumerate(k, 1):
        a = a + sign * x * F.sin(2 * j * u) * F.cosh(2 * j * v)
        b = b + sign * x * F.cos(2 * j * u) * F.sinh(2 * j * v)
    return a, b


def to_utm(lon: Column, lat: Column, meridian: float) -> tuple[Column, Column]:
    """(easting, northing) in metres, southern hemisphere."""
    p, q = F.radians(lat), F.radians(lon - F.lit(meridian))
    t = F.sinh(F.atanh(F.sin(p)) - F.lit(_E) * F.atanh(F.lit(_E) * F.sin(p)))
    u, v = _series(F.atan2(t, F.cos(q)), F.atanh(F.sin(q) / F.sqrt(1 + t * t)), _ALPHA, 1)
    return F.lit(_FE) + F.lit(_K0 * _R) * v, F.lit(_FN) + F.lit(_K0 * _R) * u


def from_utm(easting: Column, northing: Column, meridian: float) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees."""
    u0, v0 = (northing - F.lit(_FN)) / F.lit(_K0 * _R), (easting - F.lit(_FE)) / F.lit(_K0 * _R)
    u, v = _series(u0, v0, _BETA, -1)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, x in enumerate(_DELTA, 1):
        lat = lat + x * F.sin(2 * j * chi)
    return F.lit(meridian) + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(lat)


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates of one EPSG code in another; codes that are not known raise when the plan is made."""
    for code in (source, target):
        if code not in DEGREES and code not in UTM_SOUTH:
            raise ValueError(f"EPSG:{code} is not supported")
    if source == target or (source in DEGREES and target in DEGREES):
        return x, y
    if source in UTM_SOUTH:
        x, y = from_utm(x, y, UTM_SOUTH[source])
    return to_utm(x, y, UTM_SOUTH[target]) if target in UTM_SOUTH else (x, y)


def transform_edges(edges: DataFrame, source: int, target: int) -> DataFrame:
    x1, y1 = transform(F.col("x1"), F.col("y1"), source, target)
    x2, y2 = transform(F.col("x2"), F.col("y2"), source, target)
    return edges.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})
