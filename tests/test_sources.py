import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille import cli
from quadrille.grid import GridSpec
from quadrille.operators import geometry, vectors
from quadrille.plans import workflows
from quadrille.sources import rasters, tables, tiff
from quadrille.sources import vectors as files
from quadrille.streaming.tiles import stream_windows

GRID = GridSpec(37, 70, a=0.0001, c=-36.0, e=-0.0001, f=-9.5, crs="EPSG:4326")


@pytest.mark.parametrize("data", [b"", b"a", b"abababab" * 999, bytes(range(256)) * 40, np.random.default_rng(1).bytes(70_000), b"\0" * 100_000])
def test_lzw_round_trip(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("compress", [True, False])
def test_geotiff_round_trip(spark, tmp_path, compress):
    a = np.random.default_rng(2).random((70, 37)).astype(np.float32)
    a[5, 6] = -9999
    path = str(tmp_path / "a.tif")
    df = spark.createDataFrame([(int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(a)], "r int, c int, v double").repartition(5)
    rasters.write_raster(df, "v", path, GRID, nodata=-9999.0, rows=16, compress=compress)
    g = rasters.read_grid(path)
    assert (g.width, g.height, g.crs) == (37, 70, "EPSG:4326") and abs(g.c + 36) < 1e-12 and abs(g.e + 0.0001) < 1e-15
    got = {(r, c): v for r, c, v in rasters.read_raster(spark, path).collect()}
    assert len(got) == 70 * 37 and got[5, 6] is None and got[69, 36] == float(a[69, 36])
    assert {tuple(x) for x in rasters.read_on_grid(spark, path, g).where("r < 2").collect()} == {(r, c, v) for (r, c), v in got.items() if r < 2}
    assert rasters.read_optional(spark, str(tmp_path / "none.tif")) is None
    with pytest.raises(FileNotFoundError):
        rasters.read_grid(str(tmp_path / "none.tif"))


def test_byte_raster_and_stack(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 0.5), (0, 1, 2.0), (1, 0, -1.0)], "r int, c int, v double")
    path = str(tmp_path / "b.tif")
    rasters.write_raster(df, "v", path, GridSpec(2, 2), dtype="uint8", rows=1)
    assert [x["v"] for x in rasters.read_raster(spark, path).orderBy("r", "c").collect()] == [127.0, 255.0, 0.0, 0.0]
    both = rasters.stack({"x": df, "y": df.withColumn("v", F.col("v") * 2)})
    assert both.where("r = 0 and c = 0").first().asDict() == {"r": 0, "c": 0, "x": 0.5, "y": 1.0}


def _write_shapefile(stem, rings_by_record, names):
    bodies = []
    for rings in rings_by_record:
        if rings is None:
            bodies.append(struct.pack("<i", 0))
            continue
        xy = np.array([p for r in rings for p in r], "<f8")
        starts = np.cumsum([0] + [len(r) for r in rings[:-1]])
        bodies.append(struct.pack("<i4d", 5, *xy.min(0), *xy.max(0)) + struct.pack("<ii", len(rings), len(xy)) + struct.pack(f"<{len(rings)}i", *starts) + xy.tobytes())
    with open(f"{stem}.shp", "wb") as f:
        size = 100 + sum(8 + len(b) for b in bodies)
        f.write(struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8))
        for k, b in enumerate(bodies):
            f.write(struct.pack(">ii", k + 1, len(b) // 2) + b)
    with open(f"{stem}.dbf", "wb") as f:
        f.write(struct.pack("<B3BIHH20x", 3, 1, 1, 1, len(names), 32 + 32 + 1, 11) + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15 + b"\r")
        for n in names:
            f.write(b" " + n.encode().ljust(10))
    with open(f"{stem}.prj", "w") as f:
        f.write('GEOGCS["GCS_SIRGAS_2000",DATUM["D"]]')


def test_shapefile_and_geopackage(spark, tmp_path):
    outer = [(2.0, 2.0), (2.0, 8.0), (8.0, 8.0), (8.0, 2.0), (2.0, 2.0)]  # clockwise
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    _write_shapefile(tmp_path / "one", [[outer, hole], None], ["first", "second"])
    _write_shapefile(tmp_path / "two", [[outer]], ["third"])
    _write_shapefile(tmp_path / "skip", [[outer]], ["no"])
    p = files.read_polygons(spark, str(tmp_path), "shapefile", exclude="skip")
    assert {(r["file"], r["attributes"]["NAME"], r["crs"]) for r in p.collect()} == {("one.shp", "first", "EPSG:4674"), ("two.shp", "third", "EPSG:4674")}
    assert sorted(r["area"] for r in vectors.area(geometry.edges_of(p)).collect()) == [32.0, 36.0]
    named = files.with_attributes(p, {"NAME": "string", "MISSING": "double"})
    assert {(r["NAME"], r["MISSING"]) for r in named.collect()} == {("first", None), ("third", None)}
    out = str(tmp_path / "out.gpkg")
    files.write_geopackage(named, out, "layer", 4674, ["NAME"])
    back = files.read_polygons(spark, out)
    assert {(r["attributes"]["NAME"], r["crs"]) for r in back.collect()} == {("first", "EPSG:4674"), ("third", "EPSG:4674")}
    assert sorted(r["area"] for r in vectors.area(geometry.edges_of(back)).collect()) == [32.0, 36.0]


def test_feature_tables(spark, tmp_path):
    assert len(tables.feature_names()) == 32 and len(tables.feature_names(socio=False, terrain=False)) == 22
    names = ["B2_mean", "has_socio"]
    w = spark.createDataFrame([(0, 10, 0.1234567, 1.23456789, 1)], "win_r int, win_c int, similarity double, B2_mean double, has_socio int")
    t = tables.with_map_coordinates(w, names, GRID, 15)
    tables.write_csv(t, str(tmp_path / "f.csv"))
    row = tables.read_csv(spark, str(tmp_path / "f.csv"), names).first()
    assert (row["row"], row["col"], row["similarity"], row["B2_mean"], row["has_socio"]) == (0, 10, 0.123457, 1.234568, 1)
    assert tables.feature_columns(t) == names
    t.write.parquet(str(tmp_path / "t"))
    more = spark.createDataFrame([(0, 10, 7.0)], "row int, col int, B2_mean double")
    for _ in range(2):
        assert tables.replace_columns(spark, str(tmp_path / "t"), more).first()["B2_mean"] == 7.0


def _scene(spark):
    rng = np.random.default_rng(3)
    rows = []
    for r in range(60):
        for c in range(45):
            built = 18 <= r < 42 and 12 <= c < 36
            v = rng.normal(900 if built else 300, 60, 6)
            rows.append((r, c, *map(float, np.maximum(v, 1)), float(r + c)))
    return spark.createDataFrame(rows, "r int, c int, B2 double, B3 double, B4 double, B8 double, B11 double, B12 double, z double")


def test_workflow_from_bands_to_objects(spark, tmp_path):
    scene, grid = _scene(spark), GridSpec(45, 60, a=0.0001, c=-36.0, e=-0.0001, f=-9.5)
    s = workflows.Settings(window=6, stride=3, trees=8, fold_block=9)
    socio = scene.select("r", "c", F.when(F.col("c") < 30, F.lit(0.5)).alias("v"))
    features = workflows.feature_table(scene, grid, s, dsm=scene.select("r", "c", "z"), socio={"vuln_mean": socio})
    names = [c for c in features.columns if c not in ("win_r", "win_c")]
    assert len(names) == 22 + 5 + 2 and features.where("has_socio = 0 and vuln_mean is null").count() > 0
    square = [(16.0, 20.0, 32.0, 20.0), (32.0, 20.0, 32.0, 40.0), (32.0, 40.0, 16.0, 40.0), (16.0, 40.0, 16.0, 20.0)]
    edges = spark.createDataFrame([(1, 0, 0, k, *e) for k, e in enumerate(square)], "poly_id long, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    scored, heat = workflows.similarity_map(features, ["B2_mean", "B8_mean"], F.col("B2_mean") > 800, s)
    assert heat.count() == 60 * 45 and scored.orderBy(F.desc("similarity")).first()["B2_mean"] > 500
    coverage = scene.select("r", "c")
    t = workflows.train(features, ["B2_mean", "B8_mean", "NDVI_mean"], edges, grid, s, coverage=coverage)
    assert t.oof.count() == features.count() and t.oof.select("win_r", "win_c").distinct().count() == t.oof.count()
    m = {r["which"]: r for r in workflows.oof_metrics(t.oof).collect()}
    assert m["all"]["auc"] > 0.85
    polygons = spark.createDataFrame([(1, "core")], "poly_id long, scope string")
    scores, detection, table = workflows.evaluate(t.clipped, edges, polygons, grid, coverage, thresholds=(0.5,), least_ha=0.02, filter_ha=0.05)
    assert scores.first()["max_prob"] > 0.5 and detection.count() == 2
    assert table.first()["recall"] == 1.0 and table.first()["precision"] > 0
    v = workflows.validate(t.raster, vectors.mask(edges, 60, 45), per_class=100)
    assert v["auc"].first()[0] > 0.85 and v["error_map"].count() == 60 * 45
    tables.write_artifacts(str(tmp_path / "art"), t.oof, t.importance)
    assert tables.read_artifacts(spark, str(tmp_path / "art"))[0].count() == t.oof.count()


def test_stream_of_tiles(spark, tmp_path):
    scene = _scene(spark).select("r", "c", "B2")
    scene.write.parquet(str(tmp_path / "in"))
    from quadrille.operators import windows

    q = stream_windows(spark, str(tmp_path / "in"), "r int, c int, B2 double", str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: windows.window_stats(b, {"B2": F.col("B2")}, 60, 45))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(windows.window_origins(60, 15, 10)) * len(windows.window_origins(45, 15, 10))


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "p.tif")
    px = spark.createDataFrame([(r, c, 0.9 if 2 <= r < 8 and 2 <= c < 8 else 0.1) for r in range(10) for c in range(10)], "r int, c int, v double")
    rasters.write_raster(px, "v", path, GridSpec(10, 10, a=1.0, e=-1.0, f=10.0))
    assert cli.main(["coords", path, "--x", "3", "--y", "4"]) == 0 and "row 6 col 3" in capsys.readouterr().out
    assert cli.main(["coords", path, "--info"]) == 0 and "width: 10" in capsys.readouterr().out
    _write_shapefile(tmp_path / "t", [[[(2.0, 2.0), (2.0, 8.0), (8.0, 8.0), (8.0, 2.0), (2.0, 2.0)]]], ["x"])
    assert cli.main(["validate", "--truth", str(tmp_path / "t.shp"), "--raster", path, "--threshold", "0.5"]) == 0
    assert "'f1': 1.0" in capsys.readouterr().out
