"""Ranks over a whole table without a single task that holds it: values are grouped first, then range-partitioned counts are summed.

``rank_table`` gives, for each distinct value, how many rows are smaller and how many are equal. Rows are counted by value (map-side), values
are range-partitioned, each partition numbers its own, and the partitions' totals, a row each, are summed in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: Up to so many distinct values one window task is used.
FEW_VALUES = 500_000


def rank_table(df: DataFrame, value: str, extra: dict[str, Column] | None = None, descending: bool = False, partitions: int = 64) -> DataFrame:
    """(value, n, before, ...): counts by value, rows that come before, and for each ``extra`` sum its value and what comes before it.

    Null values are left out.
    """
    sums = {"n": F.count(F.lit(1))} | (extra or {})
    by_value = materialize(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(*[s.alias(k) for k, s in sums.items()]), "values")
    order = F.col("value").desc() if descending else F.col("value")
    if by_value.count() <= FEW_VALUES:
        w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return by_value.select("*", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias("before" if k == "n" else f"before_{k}") for k in sums])
    # the number of a partition is kept with its rows, so its totals are those of the rows read below
    parted = materialize(by_value.repartitionByRange(partitions, order).withColumn("_part", F.spark_partition_id()), "parted")
    totals = parted.groupBy("_part").agg(*[F.sum(k).alias(f"_t_{k}") for k in sums])
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(over), F.lit(0)).alias(f"_o_{k}") for k in sums])
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = parted.join(F.broadcast(offsets), "_part")
    return placed.select("value", *sums, *[(F.coalesce(F.sum(k).over(within), F.lit(0)) + F.col(f"_o_{k}")).alias("before" if k == "n" else f"before_{k}") for k in sums])


def percent_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add pct_<column>: average rank of ties over the number of rows that have a value.

    The rows are written first: values that are computed anew, in another order of summing, would miss their own ranks.
    """
    df = materialize(df, "ranked")
    for c in columns:
        ranks = rank_table(df, c)
        n = ranks.agg(F.sum("n").alias("_rows"))
        pct = ranks.crossJoin(F.broadcast(n)).select(F.col("value").alias("_value"), ((F.col("before") + (F.col("n") + 1) / 2) / F.col("_rows")).alias(f"pct_{c}"))
        df = df.join(pct, df[c] == pct["_value"], "left").drop("_value")
    return df


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles, linear between the two neighbours, without a task that holds all distinct values. Null without a value."""
    ranks = rank_table(df, value)
    n = ranks.agg(F.sum("n")).first()[0] or 0
    places = [p * (n - 1) for p in shares]
    wanted = sorted({int(x) + k for x in places for k in (0, 1)})
    at = F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: (w >= F.col("before")) & (w < F.col("before") + F.col("n")))
    found = {w: r["value"] for r in ranks.withColumn("_at", at).where("size(_at) > 0").select("value", "_at").collect() for w in r["_at"]}  # two rows a share at most
    return [None if not n else found[int(x)] + (x - int(x)) * (found.get(int(x) + 1, found[int(x)]) - found[int(x)]) for x in places]
