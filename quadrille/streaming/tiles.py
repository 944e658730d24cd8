"""Features of a raster whose pixel rows arrive in files.

Each micro-batch holds whole tiles that overlap by a window less a stride, so its windows are complete; they are appended as Parquet, a folder
a batch, so a batch that runs again replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stream_windows(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, features: Callable[[DataFrame], DataFrame], files_per_batch: int = 64):
    """Start the query that turns Parquet pixel files at ``source`` into feature files at ``out``; all files that are there, then it ends."""

    def write(batch: DataFrame, number: int) -> None:
        features(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
