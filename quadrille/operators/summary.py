"""Short reports on layers and tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles, rank_table


def layer_summary(layers: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(layer, n, n_finite, least, most, mean) of a value column for each named layer; a layer without finite values has null figures."""
    out = None
    for name, (df, value) in layers.items():
        v = F.col(value).cast("double")
        finite = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)
        row = df.agg(F.count(F.lit(1)).alias("n"), F.count(finite).alias("n_finite"), F.min(finite).alias("least"), F.max(finite).alias("most"), F.avg(finite).alias("mean"))
        row = row.select(F.lit(name).alias("layer"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def polygon_summary(areas: DataFrame, polygons: DataFrame, value: str) -> DataFrame:
    """(n, area, median_value): polygons, the sum of their areas, the median of a value."""
    median = quantiles(polygons, value, [0.5])[0]
    return polygons.select("poly_id").join(areas, "poly_id", "left").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area")).withColumn("median_value", F.lit(median).cast("double"))


def covered_mean(grid: DataFrame, mask: DataFrame) -> DataFrame:
    """(covered): the share of the grid's pixels that the mask holds."""
    on = mask.select("r", "c").distinct().withColumn("_on", F.lit(1))
    return grid.select("r", "c").join(on, ["r", "c"], "left").agg(F.avg(F.coalesce("_on", F.lit(0))).alias("covered"))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``idx``, from 0 on in the order of a unique key, without one task that holds all rows."""
    ranks = rank_table(df, key).select(F.col("value").alias(key), F.col("before").alias("idx"))
    return df.join(ranks, key)
