"""Connected components of a distributed edge list by alternating star operations.

Each round turns every neighbourhood into a star around its smallest member, so the rounds grow with the logarithm of the
longest path. Rounds are grouped sums and equality joins; no neighbourhood is gathered in a task, and no edge
reaches the driver. Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie each larger neighbour of a node to the smallest node of the neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie each smaller neighbour of a node, and the node, to the smallest node. Edges run from larger a to smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return (
        edges.join(least, "a")
        .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        .select("e.a", "e.b").where("a > b").distinct()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b): each node ``a`` that is linked to a smaller one, and ``b``, the smallest node it can reach.

    ``edges`` has long columns a and b in either order; loops, nulls and repeated edges are ignored. A node that is the
    smallest of its component has no row. An empty edge list gives no rows.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            return now
        now = materialize(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if before == state:
            return now
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
