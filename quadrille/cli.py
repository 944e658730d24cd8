"""Command line: coordinates of a raster, and pixel validation.

    python -m quadrille.cli coords RASTER [--x X --y Y | --row R --col C | --info]
    python -m quadrille.cli validate --truth LAYER --raster RASTER [--threshold T] [--sample N]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import geometry, vectors
from .plans import workflows
from .sources.rasters import read_grid, read_raster
from .sources.vectors import read_polygons


def coords(args: argparse.Namespace) -> list[str]:
    g = read_grid(args.raster)
    if args.x is not None and args.y is not None:
        row, col = round((args.y - g.f) / g.e), round((args.x - g.c) / g.a)
        inside = 0 <= row < g.height and 0 <= col < g.width
        return [f"row {row} col {col}" + ("" if inside else " (outside the raster)")]
    if args.row is not None and args.col is not None:
        return [f"x {g.c + args.col * g.a:.6f} y {g.f + args.row * g.e:.6f}"]
    return [f"{k}: {v}" for k, v in g.describe().items()]


def validate(args: argparse.Namespace) -> list[str]:
    spark = SparkSession.builder.getOrCreate()
    grid = read_grid(args.raster)
    edges = vectors.to_pixel_space(geometry.edges_of(read_polygons(spark, args.truth)), grid)
    raster = read_raster(spark, args.raster).withColumnRenamed("v", "p")
    out = workflows.validate(raster, vectors.mask(edges, grid.height, grid.width), args.threshold, args.sample)
    return [f"{k}: {row.asDict()}" for k in ("report", "auc", "ap") for row in out[k].select(*[F.round(c, 4).alias(c) for c in out[k].columns]).collect()]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("coords")
    c.add_argument("raster")
    for name, kind in (("--x", float), ("--y", float), ("--row", int), ("--col", int)):
        c.add_argument(name, type=kind)
    c.add_argument("--info", action="store_true")
    v = sub.add_parser("validate")
    v.add_argument("--truth", required=True)
    v.add_argument("--raster", required=True)
    v.add_argument("--threshold", type=float)
    v.add_argument("--sample", type=int)
    args = p.parse_args(argv)
    print("\n".join({"coords": coords, "validate": validate}[args.command](args)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
