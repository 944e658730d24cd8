"""Spectral bands and per-pixel indices."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ("B2", "B3", "B4", "B8", "B11", "B12")
EPS = 1e-8


def _ratio(up: Column, down: Column) -> Column:
    return up / (down + F.lit(EPS))


#: To add an index, add an entry: a function of the bands by name.
INDICES: dict[str, Callable[[Mapping[str, Column]], Column]] = {
    "NDVI": lambda b: _ratio(b["B8"] - b["B4"], b["B8"] + b["B4"]),
    "NDBI": lambda b: _ratio(b["B11"] - b["B8"], b["B11"] + b["B8"]),
    "BSI": lambda b: _ratio(b["B11"] + b["B4"] - b["B8"] - b["B2"], b["B11"] + b["B4"] + b["B8"] + b["B2"]),
    "MNDWI": lambda b: _ratio(b["B3"] - b["B11"], b["B3"] + b["B11"]),
    "SWIR_RATIO": lambda b: _ratio(b["B11"], b["B12"]),
}


def index(name: str, bands: Mapping[str, Column] | None = None) -> Column:
    """The index of a pixel; by default from columns named like the bands."""
    if name not in INDICES:
        raise ValueError(f"unknown index {name!r}; known: {', '.join(INDICES)}")
    return INDICES[name](bands or {b: F.col(b).cast("double") for b in BANDS})
