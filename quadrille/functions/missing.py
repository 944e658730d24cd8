"""Missing values: NaN becomes null when data come in, and each rule for nulls is named here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """The value if it is a finite number, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def finite_or_zero(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def nodata_to_null(c: Column, nodata: float | None) -> Column:
    c = nan_to_null(c)
    return c if nodata is None or nodata != nodata else F.when(c != nodata, c)


def clip_max(c: Column, most: float) -> Column:
    """Values over ``most`` become null; ``most`` itself stays."""
    return F.when(c <= most, c)


def model_input(c: Column) -> Column:
    """Missing: -1; infinite: the largest 32-bit float of its sign."""
    top = F.lit(3.4028234663852886e38)
    return F.when(c.isNull() | F.isnan(c), F.lit(-1.0)).otherwise(F.greatest(F.least(c, top), -top))


def detected(c: Column, threshold: float | Column) -> Column:
    """1 if the value reaches the threshold, else 0; missing values count as not detected."""
    return F.when(F.coalesce(c >= threshold, F.lit(False)), 1).otherwise(0)
