"""Grid of a raster: size, affine transform, and the sums that depend on them alone."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """x = c + col * a + row * b, y = f + col * d + row * e; north-up grids have b = d = 0 and e < 0."""

    width: int
    height: int
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = -1.0
    f: float = 0.0
    crs: str = ""

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """left, bottom, right, top"""
        return self.c, self.f + self.height * self.e, self.c + self.width * self.a, self.f

    def same_as(self, other: GridSpec) -> bool:
        return self == other

    def map_to_pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col) of the nearest pixel corner, halves to even."""
        return F.bround((y - F.lit(self.f)) / F.lit(self.e)).cast("long"), F.bround((x - F.lit(self.c)) / F.lit(self.a)).cast("long")

    def containing_pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.floor((y - F.lit(self.f)) / F.lit(self.e)), F.floor((x - F.lit(self.c)) / F.lit(self.a))

    def pixel_to_map(self, row: Column, col: Column) -> tuple[Column, Column]:
        """(x, y) of the upper-left corner; rotation terms are left out."""
        return F.lit(self.c) + col * F.lit(self.a), F.lit(self.f) + row * F.lit(self.e)

    def window_centre(self, row: Column, col: Column, window: int) -> tuple[Column, Column]:
        return F.lit(self.c) + (col + F.lit(window / 2)) * F.lit(self.a), F.lit(self.f) + (row + F.lit(window / 2)) * F.lit(self.e)

    def inside(self, row: Column, col: Column) -> Column:
        return (row >= 0) & (row < self.height) & (col >= 0) & (col < self.width)

    @property
    def pixel_area_ha(self) -> float:
        """Area of a pixel of a grid in degrees, at its top edge."""
        metres_x = abs(self.a) * 111_320 * math.cos(math.radians(abs(self.f)))
        return metres_x * abs(self.e) * 110_540 / 10_000

    def region_pixels(self, hectares: float, at_least_one: bool = True) -> int:
        """Pixels of a region of that size, cut down; ``at_least_one`` is off in the polygon report."""
        n = int(hectares / self.pixel_area_ha)
        return max(n, 1) if at_least_one else n

    def block_id(self, row: Column, col: Column, block: int = 800) -> Column:
        across = -(-self.width // block)
        return F.floor(row / block).cast("long") * across + F.floor(col / block).cast("long")

    def describe(self) -> dict[str, object]:
        left, bottom, right, top = self.bounds
        return {"width": self.width, "height": self.height, "resolution": abs(self.a), "crs": self.crs, "left": left, "bottom": bottom, "right": right, "top": top}


def window_origins(size: int, window: int, stride: int) -> list[int]:
    """First rows (or columns) of the windows of an axis; a last one is moved in so that it ends with the raster."""
    if window > size:
        raise ValueError(f"a window of {window} does not fit {size} pixels")
    regular = list(range(0, size - window + 1, stride))
    return regular if (size - window) % stride == 0 else [*regular, size - window]
