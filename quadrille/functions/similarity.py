"""Similarity of feature vectors (array columns) to a reference vector."""

from __future__ import annotations

import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bands import EPS


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine moved to 0..1; a small term keeps zero vectors from dividing by zero."""
    down = (F.sqrt(_dot(a, a)) + F.lit(EPS)) * (F.sqrt(_dot(b, b)) + F.lit(EPS))
    return (_dot(a, b) / down + 1) / 2


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x - y)
    return 1 / (1 + F.sqrt(_dot(d, d)))


METRICS = {"cosine": cosine, "euclidean": euclidean}


def similarity(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        warnings.warn(f"unknown metric {metric!r}: cosine is used", stacklevel=2)
    return METRICS.get(metric, cosine)(a, b)
