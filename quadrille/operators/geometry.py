"""Well-known binary polygons to edge rows and back."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ship

Rings = list[list[tuple[float, float]]]


def parse_wkb(data: bytes) -> list[Rings]:
    """Parts of a polygon or multipolygon, each a list of rings; Z and M values are passed over. Other kinds raise ValueError."""

    def read(at: int) -> tuple[list[Rings], int]:
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        if kind & 0x20000000:
            at += 4  # a system id
        dims = 2 + bool(kind & 0x80000000 or 1000 <= kind % 100_000 < 2000 or kind % 100_000 >= 3000) + bool(kind & 0x40000000 or 2000 <= kind % 100_000)
        base = (kind & 0x0FFFFFFF) % 1000
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        if base == 6:
            parts: list[Rings] = []
            for _ in range(n):
                more, at = read(at)
                parts += more
            return parts, at
        if base != 3:
            raise ValueError(f"geometry kind {base} is not a polygon")
        rings: Rings = []
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", data, at)
            xy = np.frombuffer(data, order + "f8", m * dims, at + 4).reshape(m, dims)[:, :2]
            at += 4 + 8 * m * dims
            rings.append([tuple(p) for p in xy.tolist()])
        return [rings] if rings else [], at

    return read(0)[0]


def make_wkb(parts: list[Rings]) -> bytes:
    """A multipolygon; rings are closed if they are not."""
    out = [struct.pack("<BII", 1, 6, len(parts))]
    for rings in parts:
        out.append(struct.pack("<BII", 1, 3, len(rings)))
        for ring in rings:
            closed = ring if ring and ring[0] == ring[-1] else [*ring, *ring[:1]]
            out.append(struct.pack("<I", len(closed)) + np.array(closed, "<f8").tobytes())
    return b"".join(out)


def edges_of(polygons: DataFrame, wkb: str = "wkb", poly_id: str = "poly_id") -> DataFrame:
    """Edge rows of polygons; null and empty geometries have none."""
    ship(polygons.sparkSession)

    @F.pandas_udf("array<struct<part:int,ring:int,seq:int,x1:double,y1:double,x2:double,y2:double>>")
    def parts(blobs: pd.Series) -> pd.Series:
        out = []
        for b in blobs:
            rows = []
            for p, rings in enumerate(parse_wkb(bytes(b)) if b is not None and len(b) else []):
                for g, ring in enumerate(rings):
                    points = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
                    rows += [(p, g, s, *u, *v) for s, (u, v) in enumerate(zip(points, points[1:] + points[:1], strict=True))]
            out.append([dict(zip(("part", "ring", "seq", "x1", "y1", "x2", "y2"), r, strict=True)) for r in rows])
        return pd.Series(out, dtype=object)

    return polygons.where(F.col(wkb).isNotNull()).select(F.col(poly_id).cast("long").alias("poly_id"), F.explode(parts(wkb)).alias("e")).select("poly_id", "e.*")
