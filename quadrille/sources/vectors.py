"""Vector files: shapefiles and GeoPackages to rows (poly_id, attributes, wkb, crs), and a GeoPackage sink."""

from __future__ import annotations

import glob
import os
import re
import sqlite3
import struct
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.geometry import make_wkb
from ..storage import ship

SCHEMA = "poly_id long, attributes map<string,string>, wkb binary, crs string, file string"


def _area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _parts(rings: list[np.ndarray]) -> list[list[list[tuple[float, float]]]]:
    """Shapefile rings to parts: clockwise rings begin a part, the others are holes of the last one."""
    parts: list[list[list[tuple[float, float]]]] = []
    for r in rings:
        points = [tuple(p) for p in r.tolist()]
        if _area(r) <= 0 or not parts:
            parts.append([points])
        else:
            parts[-1].append(points)
    return parts


def read_shapes(path: str) -> Iterator[tuple[int, bytes | None]]:
    """(record number, geometry) of a .shp file; null shapes have none."""
    with open(path, "rb") as f:
        f.seek(100)
        k = 0
        while len(head := f.read(8)) == 8:
            body = f.read(2 * struct.unpack(">I", head[4:])[0])
            (kind,) = struct.unpack_from("<i", body)
            if kind in (5, 15, 25):
                n_parts, n = struct.unpack_from("<ii", body, 36)
                starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n]
                xy = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * n_parts).reshape(n, 2)
                yield k, make_wkb(_parts([xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]))
            elif kind == 0:
                yield k, None
            else:
                raise ValueError(f"{path}: shape kind {kind} is not a polygon")
            k += 1


def read_attributes(path: str, encoding: str = "utf-8") -> Iterator[dict[str, str]]:
    """Rows of a .dbf file as text; empty fields are left out."""
    if not os.path.exists(path):
        return
    with open(path, "rb") as f:
        head = f.read(32)
        n, head_size, row_size = struct.unpack_from("<IHH", head, 4)
        fields, at = [], 1
        for _ in range((head_size - 33) // 32):
            d = f.read(32)
            fields.append((d[:11].split(b"\0")[0].decode("ascii", "replace"), at, d[16]))
            at += d[16]
        f.seek(head_size)
        for _ in range(n):
            row = f.read(row_size)
            values = {name: row[a : a + size].decode(encoding, "replace").strip("\0 ") for name, a, size in fields}
            yield {k: v for k, v in values.items() if v}


def epsg_of(wkt: str) -> str:
    """EPSG code that a .prj text names, of the systems in use; else empty."""
    if m := re.findall(r'AUTHORITY\["EPSG","?(\d+)"?\]', wkt):
        return f"EPSG:{m[-1]}"
    for sign, code in (("UTM_Zone_25S", 31985), ("UTM zone 25S", 31985), ("UTM_Zone_24S", 31984), ("UTM zone 24S", 31984), ("SIRGAS", 4674), ("WGS", 4326)):
        if sign in wkt:
            return f"EPSG:{code}"
    return ""


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _Files(DataSourceReader):
    """A task a file; ids are unique over files."""

    def __init__(self, options, suffix: str):
        path = options["path"].removeprefix("file://")
        found = sorted(glob.glob(path)) if glob.has_magic(path) else sorted(glob.glob(os.path.join(path, f"*{suffix}"))) if os.path.isdir(path) else [path]
        skip = set(filter(None, options.get("exclude", "").split(",")))
        self.paths = [p for p in found if os.path.splitext(os.path.basename(p))[0] not in skip]
        self.encoding, self.layer = options.get("encoding", "utf-8"), options.get("layer", "")

    def partitions(self):
        return [_File(p, k) for k, p in enumerate(self.paths)]


class ShapefileReader(_Files):
    def read(self, partition):
        stem, name = os.path.splitext(partition.path)[0], os.path.basename(partition.path)
        crs = ""
        if os.path.exists(stem + ".prj"):
            with open(stem + ".prj", encoding="utf-8", errors="replace") as f:
                crs = epsg_of(f.read())
        rows = read_attributes(stem + ".dbf", self.encoding)
        for k, wkb in read_shapes(partition.path):
            yield (partition.number << 40 | k, next(rows, {}), wkb, crs, name)


class Shapefile(DataSource):
    """``spark.read.format("shapefile").load(path, folder or pattern)``; option ``exclude``: names to leave out."""

    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ShapefileReader(self.options, ".shp")


class GeoPackageReader(_Files):
    def read(self, partition):
        con = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)
        try:
            layers = con.execute("select table_name, column_name, srs_id from gpkg_geometry_columns order by table_name").fetchall()
            table, column, srs = next((x for x in layers if not self.layer or x[0] == self.layer), (None,) * 3)
            if table is None:
                raise ValueError(f"{partition.path} has no layer {self.layer!r}")
            quoted = table.replace('"', '""')
            cur = con.execute(f'select * from "{quoted}"')
            names = [d[0] for d in cur.description]
            for k, row in enumerate(cur):
                r = dict(zip(names, row, strict=True))
                blob = r.pop(column)
                wkb = None
                if blob and not blob[3] & 16:
                    wkb = bytes(blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :])
                yield (partition.number << 40 | k, {a: str(b) for a, b in r.items() if b is not None}, wkb, f"EPSG:{srs}" if srs > 0 else "", os.path.basename(partition.path))
        finally:
            con.close()


class GeoPackage(DataSource):
    """``spark.read.format("gpkg").option("layer", name).load(path)``; the first layer if none is named."""

    @classmethod
    def name(cls):
        return "gpkg"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GeoPackageReader(self.options, ".gpkg")


def read_polygons(spark: SparkSession, path: str, kind: str | None = None, **options: str) -> DataFrame:
    """Polygons of a shapefile, a folder or pattern of them, or a GeoPackage. Rows without a geometry are left out."""
    ship(spark)
    spark.dataSource.register(Shapefile)
    spark.dataSource.register(GeoPackage)
    kind = kind or ("gpkg" if path.endswith(".gpkg") else "shapefile")
    return spark.read.format(kind).options(**options).load(path).where("wkb is not null and length(wkb) > 9")


def with_attributes(polygons: DataFrame, keep: dict[str, str]) -> DataFrame:
    """Attribute columns by name and type, beside poly_id, wkb and crs."""
    return polygons.select("poly_id", *[F.try_element_at("attributes", F.lit(k)).try_cast(t).alias(k) for k, t in keep.items()], "wkb", "crs")


def write_geopackage(polygons: DataFrame, path: str, layer: str, srs: int, attributes: Sequence[str] = (), wkb: str = "wkb") -> None:
    """A layer of a new GeoPackage; rows stream through the driver in order of poly_id."""
    if os.path.exists(path):
        os.remove(path)
    con = sqlite3.connect(path)
    con.execute("pragma application_id = 1196444487")
    con.execute("create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text)")
    con.execute("create table gpkg_contents (table_name text primary key, data_type text not null, identifier text, description text, last_change text, min_x double, min_y double, max_x double, max_y double, srs_id integer)")
    con.execute("create table gpkg_geometry_columns (table_name text primary key, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null)")
    con.execute("insert into gpkg_spatial_ref_sys values (?, ?, 'EPSG', ?, 'undefined', null)", (f"EPSG:{srs}", srs, srs))
    con.execute("insert into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, 'features', ?, ?)", (layer, layer, srs))
    con.execute("insert into gpkg_geometry_columns values (?, 'geom', 'MULTIPOLYGON', ?, 0, 0)", (layer, srs))
    columns = "".join(f', "{a}"' for a in attributes)
    con.execute(f'create table "{layer}" (fid integer primary key, geom blob{columns})')
    head = b"GP\0\1" + struct.pack("<i", srs)
    ordered = polygons.select("poly_id", wkb, *attributes).orderBy("poly_id")
    con.executemany(f'insert into "{layer}" values (?, ?{", ?" * len(attributes)})', ((r[0], head + bytes(r[1]), *r[2:]) for r in ordered.toLocalIterator()))
    con.commit()
    con.close()
