"""Rasters as pixel tables: a ``geotiff`` data source, stacks of bands, and GeoTIFF sinks."""

from __future__ import annotations

import os
import warnings
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.bands import BANDS
from ..functions.missing import nodata_to_null
from ..grid import GridSpec
from ..operators import warp
from ..storage import ship
from . import tiff


class Blocks(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class GeoTiffReader(DataSourceReader):
    """A task reads neighbouring strips or tiles, about a million pixels."""

    def __init__(self, options: Mapping[str, str]):
        self.path, self.band = options["path"].removeprefix("file://"), int(options.get("band", "1")) - 1
        self.pixels = int(options.get("pixelsPerTask", "1000000"))

    def partitions(self):
        h = tiff.read_header(self.path)
        if not 0 <= self.band < h.bands:
            raise ValueError(f"{self.path} has {h.bands} bands")
        each = max(1, self.pixels // (h.block[0] * h.block[1]))
        return [Blocks(i, min(i + each, h.blocks_a_plane)) for i in range(0, h.blocks_a_plane, each)]

    def read(self, partition):
        h = tiff.read_header(self.path)
        for index in range(partition.first, partition.last):
            r0, c0, a = tiff.read_block(self.path, h, index, self.band)
            r, c = np.meshgrid(np.arange(r0, r0 + a.shape[0], dtype=np.int32), np.arange(c0, c0 + a.shape[1], dtype=np.int32), indexing="ij")
            yield pa.RecordBatch.from_arrays([pa.array(r.ravel()), pa.array(c.ravel()), pa.array(a.astype(np.float64).ravel())], names=["r", "c", "v"])


class GeoTiff(DataSource):
    """``spark.read.format("geotiff").option("band", n).load(path)``: rows (r, c, v)."""

    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        return "r int, c int, v double"

    def reader(self, schema):
        return GeoTiffReader(self.options)


def read_grid(path: str) -> GridSpec:
    if not os.path.exists(path):
        raise FileNotFoundError(f"the reference raster {path} is missing")
    return tiff.read_header(path).grid


def read_raster(spark: SparkSession, path: str, band: int = 1) -> DataFrame:
    """(r, c, v) of a band; no-data values and NaN are null."""
    ship(spark)
    spark.dataSource.register(GeoTiff)
    df = spark.read.format("geotiff").option("band", str(band)).load(path)
    return df.withColumn("v", nodata_to_null(F.col("v"), tiff.read_header(path).nodata))


def read_optional(spark: SparkSession, path: str, as_int: bool = False) -> DataFrame | None:
    """As read_raster, as it stands on its own grid; None, and a warning, if there is no such file."""
    if not os.path.exists(path):
        warnings.warn(f"{path} is missing and left out", stacklevel=2)
        return None
    df = read_raster(spark, path)
    return df.withColumn("v", F.col("v").cast("int")) if as_int else df


def read_on_grid(spark: SparkSession, path: str, grid: GridSpec, band: int = 1, inverse: warp.Inverse | None = None, outside: float | None = 0.0) -> DataFrame:
    """A band on a reference grid: as it is if grids are equal, else bilinear; ``outside`` where the source does not reach."""
    return warp.bilinear(read_raster(spark, path, band), read_grid(path), grid, "v", inverse, outside)


def stack(layers: Mapping[str, DataFrame]) -> DataFrame:
    """(r, c, one column a layer): layers are put one under the other and pivoted, one shuffle for all of them."""
    out = None
    for name, df in layers.items():
        part = df.select("r", "c", F.lit(name).alias("layer"), F.col("v").cast("double").alias("v"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("r", "c").pivot("layer", list(layers)).agg(F.first("v"))


def read_bands(spark: SparkSession, paths: Mapping[str, str] | str, grid: GridSpec) -> DataFrame:
    """Band columns from a file a band, or from one file whose bands stand in the usual order."""
    if isinstance(paths, str):
        return stack({b: read_on_grid(spark, paths, grid, k) for k, b in enumerate(BANDS, 1)})
    return stack({b: read_on_grid(spark, paths[b], grid) for b in BANDS})


def write_raster(pixels: DataFrame, value: str, path: str, grid: GridSpec, dtype: str = "float32", nodata: float | None = None, rows: int = 64, compress: bool = True) -> None:
    """A band as GeoTIFF. ``uint8`` stores 255 times the value, clipped and cut down. Rows arrive in order; the driver holds a strip.

    Pixel tables are kept as Parquet; this export is for other programs.
    """
    ordered = pixels.select("r", "c", value).repartitionByRange("r").sortWithinPartitions("r", "c")
    fill = nodata if nodata is not None else 0.0
    strips = tiff.strips_of(((x[0], x[1], x[2]) for x in ordered.toLocalIterator(prefetchPartitions=True)), grid, rows, fill)
    if dtype == "uint8":
        strips = (np.clip(s * 255, 0, 255) for s in strips)
    tiff.write_strips(path, grid, strips, rows, dtype, nodata, compress)
