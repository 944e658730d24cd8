"""Contiguous shards of near-equal byte size (operator 6), in DataFrame operations only.

The documents are laid on a line by (hash of the text, doc_id), so that equal texts are neighbours. The line is cut
into partitions by range; each partition adds up its own sizes, prefix sums over these totals (a row a partition) give every
partition its place on the line, and the line is cut at equal targets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, utf8

SHARDS = 24
ROW_OVERHEAD = 8
ROWS_PER_PARTITION = 100_000


def sized(docs: DataFrame, overhead: int = ROW_OVERHEAD) -> DataFrame:
    """doc_id, size (UTF-8 bytes and the overhead of a row), crc32 and order hash of each text. Null text: no bytes, crc32 of nothing."""
    raw = F.coalesce(utf8("text"), F.lit("").cast("binary"))
    return docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h"),
    )


def assign_shards(docs: DataFrame, shards: int = SHARDS, overhead: int = ROW_OVERHEAD, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    Shard k holds the documents whose middle byte lies in the k-th of ``shards`` equal cuts of the line, so a shard
    misses its target by no more than a document. ``slot`` counts from 0 without gaps within the shard. Null texts have
    no bytes; null ids sort first; rows alike in id and text are neighbours, in any order; an empty table gives no rows.
    """
    digest = materialize(sized(docs, overhead), "sized")
    parts = max(1, math.ceil(digest.count() / rows_per_partition))
    parts = max(parts, min(4 * shards, math.ceil(parts * 4)))
    # the number of a partition is kept with its rows, so what is read below is one and the same cut of the line
    line = materialize(digest.repartitionByRange(parts, "h", "doc_id").withColumn("part", F.spark_partition_id()), "line")
    totals = line.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(everything).alias("total"),
    )
    within = Window.partitionBy("part").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        line.withColumns({"through": F.sum("size").over(within), "nth": F.count(F.lit(1)).over(within)})
        .join(F.broadcast(places), "part")  # as many rows as partitions, which follow the row count by rows_per_partition
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("through")) - F.col("size"))
        .withColumns({
            "shard": F.least(F.expr(f"(middle * {shards}) div (2 * total)"), F.lit(shards - 1)).cast("int"),
            "rank": F.col("rows_before") + F.col("nth") - 1,
        })
        .select("doc_id", "size", "text_crc32", "shard", "rank")
    )
    placed = materialize(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # a row a shard
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Write ``docs`` as a folder for each shard, in the order of its slots. Columns may have any names; the folders' key is ``shard``, or the first of ``_shard``, ``__shard``, ... that is free.

    Rows that repeat in id and text lie together and share the place of the first.
    """
    places = assign_shards(docs.select("doc_id", "text"), **how).groupBy("doc_id", "text_crc32").agg(F.min(F.struct("shard", "slot")).alias("at"))
    places = places.select(F.col("doc_id").alias("id"), F.col("text_crc32").alias("crc"), "at.shard", "at.slot")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.coalesce(utf8("text"), F.lit("").cast("binary"))).alias("text_crc32"))
    joined = keyed.join(places, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_crc32") == F.col("crc")))
    key = "shard"
    while key in docs.columns:
        key = f"_{key}"
    rows = joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("shard").alias(key)).write.partitionBy(key).parquet(path)
