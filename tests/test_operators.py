import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.functions import bands, missing, scalar, similarity
from quadrille.grid import GridSpec, window_origins
from quadrille.operators import components, crs, geometry, labels, metrics, models, objects, overlay, ranks, similar, terrain, texture, vectors, warp, windows, zonal


def frame(spark, a, names="r int, c int, v double"):
    return spark.createDataFrame([(int(r), int(c), None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(a)], names)


@pytest.mark.parametrize("size", [(15, 15, 15, 10), (37, 41, 15, 10), (20, 23, 4, 7), (30, 30, 5, 5), (16, 33, 15, 1)])
def test_window_stats_equal_numpy(spark, size):
    h, w, ws, stride = size
    rng = np.random.default_rng(1)
    a = rng.normal(1000, 1, (h, w))
    a[rng.random((h, w)) < 0.3] = np.nan
    got = {(r["win_r"], r["win_c"]): r for r in windows.window_stats(frame(spark, a), {"v": F.col("v")}, h, w, ws, stride).collect()}
    want = {(r, c) for r in window_origins(h, ws, stride) for c in window_origins(w, ws, stride)}
    assert set(got) == want
    for (r, c), row in got.items():
        p = a[r : r + ws, c : c + ws]
        assert row["n_px"] == ws * ws
        if np.isfinite(p).any():
            assert np.isclose(row["v_mean"], np.nanmean(p), rtol=1e-12) and np.isclose(row["v_std"], np.nanstd(p), rtol=1e-6, atol=1e-9)
        else:
            assert row["v_mean"] is None and row["v_std"] is None


def test_window_count_of_the_published_scene():
    assert len(window_origins(8399, 15, 10)) * len(window_origins(7988, 15, 10)) == 671_160


def test_a_window_that_does_not_fit_raises(spark):
    with pytest.raises(ValueError):
        windows.window_stats(frame(spark, np.zeros((4, 4))), {"v": F.col("v")}, 4, 4)


def test_terrain_equals_numpy(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(50, 9, (15, 15))
    a[3, 4] = a[0, 0] = a[14, 7] = np.nan
    got = terrain.terrain_features(frame(spark, a, "r int, c int, z double"), 15, 15).first()
    z = np.where(np.isnan(a), np.nanmean(a), a)
    gy, gx = np.gradient(z)
    slope = np.degrees(np.arctan(np.sqrt(gx**2 + gy**2) / 10))
    rough = np.concatenate([np.abs(np.diff(z, axis=0)).ravel(), np.abs(np.diff(z, axis=1)).ravel()]).mean()
    assert np.allclose(list(got)[2:], [np.nanmean(a), np.nanstd(a), rough, slope.mean(), slope.std()], rtol=1e-12)
    empty = terrain.terrain_features(frame(spark, np.full((15, 15), np.nan), "r int, c int, z double"), 15, 15).first()
    assert list(empty)[2:] == [0.0] * 5


def test_summed_area_equals_cells(spark):
    a = (np.random.default_rng(3).random((33, 28)) < 0.4).astype(float)
    df = frame(spark, a).withColumn("v", F.col("v").cast("int"))
    s = terrain.summed_windows(terrain.summed_area(df, "v"), windows.all_windows(spark, 33, 28))
    by_cells = windows.window_sums(df, {"s": F.sum("v")}, 33, 28)
    assert {tuple(r) for r in s.collect()} == {(r["win_r"], r["win_c"], r["s"]) for r in by_cells.collect()}


def test_rasterized_area_is_the_shoelace_area(spark):
    n = 400
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    x, y = 60 + 50 * np.cos(t), 55 + 45 * np.sin(t)
    rows = [(1, 0, 0, k, float(x[k]), float(y[k]), float(x[(k + 1) % n]), float(y[(k + 1) % n])) for k in range(n)]
    e = spark.createDataFrame(rows, "poly_id long, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    px, area = vectors.rasterize(e, 120, 130).count(), vectors.area(e).first()["area"]
    assert abs(px - area) / area < 0.005


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(400, 460)]
    up = list(range(500))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["a"]: r["b"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in range(500) if root(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_labels_do_not_depend_on_tiles(spark, tile):
    a = np.random.default_rng(5).random((40, 31)) < 0.55
    on = spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(a)], "r int, c int")
    want = {}
    for r, c in map(tuple, np.argwhere(a).tolist()):
        if (r, c) in want:
            continue
        stack, first = [(r, c)], r * 31 + c
        while stack:
            p = stack.pop()
            if p in want or not (0 <= p[0] < 40 and 0 <= p[1] < 31) or not a[p]:
                continue
            want[p] = first
            stack += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    assert {(x["r"], x["c"]): x["blob_id"] for x in objects.label(on, 31, tile).collect()} == want


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_a_mean_at_the_threshold_is_kept_in_any_order_of_rows(spark, broadcast):
    at = [list(x) for x in itertools.permutations((0.701, 0.999, 0.653, 0.887, 0.756, 0.804))]
    under = [0.701, 0.999, 0.653, 0.887, 0.756, 0.803]
    rows = [(b, i, b, p) for b, x in enumerate([*at, under]) for i, p in enumerate(x)]
    px = spark.createDataFrame(rows, "r int, c int, blob_id long, p double").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = {x["blob_id"]: x["mean_prob"] for x in objects.large(objects.sizes(px.drop("p"), px.drop("blob_id")), 5, 0.8).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == dict.fromkeys(range(720), 0.8)


def test_exact_mean_of_values_that_no_decimal_holds(spark):
    nan, inf = float("nan"), float("inf")
    groups = {0: [None, None], 1: [0.5, None, 0.7], 2: [nan, 0.5], 3: [inf, 0.5], 4: [1e300, 3e300], 5: [1e-30, 3e-30], 6: [-0.25, 0.1 + 0.2], 7: [1 / 3] * 3, 8: [1e11, 0.5]}
    df = spark.createDataFrame([(k, v) for k, x in groups.items() for v in x], "k int, p double")
    got = {x["k"]: x["m"] for x in df.groupBy("k").agg(objects.exact_mean("p").alias("m")).collect()}
    assert got.pop(0) is None and np.isnan(got.pop(2))
    assert got == pytest.approx({1: 0.6, 3: inf, 4: 2e300, 5: 2e-30, 6: (0.1 + 0.2 - 0.25) / 2, 7: 1 / 3, 8: (1e11 + 0.5) / 2}, rel=1e-15, abs=0)


def test_outlines_have_the_area_of_their_objects(spark):
    a = np.random.default_rng(6).random((25, 25)) < 0.6
    on = objects.label(spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(a)], "r int, c int"), 25)
    px = {r["blob_id"]: r["count"] for r in on.groupBy("blob_id").count().collect()}
    rings = objects.polygonize(on)
    assert {r["blob_id"]: r["area"] for r in objects.dissolve(rings).collect()} == px
    assert all(r["n"] == 1 for r in rings.where("signed_area > 0").groupBy("blob_id").agg(F.count("*").alias("n")).collect())


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=4, max_size=40).filter(lambda x: len({y for y, _ in x}) == 2))
@settings(max_examples=5, deadline=None)
def test_auc_and_ap(spark, rows):
    df = spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(rows)], "id long, y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(metrics.roc_auc(df).first()[0] - auc) < 1e-12
    assert abs(metrics.roc_auc(df.withColumn("s", -F.col("s"))).first()[0] - (1 - auc)) < 1e-12
    ap = sum(sum(y for y, s in rows if s == t) / len(pos) * sum(y for y, s in rows if s >= t) / sum(s >= t for _, s in rows) for t in {s for _, s in rows})
    assert abs(metrics.average_precision(df).first()[0] - ap) < 1e-12
    assert sum(metrics.confusion(df, 3.0).first()) == len(rows)


def test_ranks_over_many_values(spark, monkeypatch):
    rows = [(float(x),) for x in np.random.default_rng(7).integers(0, 50, 300)] + [(None,)]
    df = spark.createDataFrame(rows, "v double")
    few = {tuple(r) for r in ranks.rank_table(df, "v").collect()}
    monkeypatch.setattr(ranks, "FEW_VALUES", 5)
    assert {tuple(r) for r in ranks.rank_table(df, "v", partitions=7).collect()} == few


def test_missing_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan,), (None,), (inf,), (-inf,), (1.0,), (0.5,)], "v double")
    assert [r[0] for r in df.select(missing.finite_or_zero(F.col("v"))).collect()] == [0.0, 0.0, 0.0, 0.0, 1.0, 0.5]
    assert [r[0] for r in df.select(missing.detected(missing.nan_to_null(F.col("v")), 0.5)).collect()] == [0, 0, 1, 0, 1, 1]
    assert df.select(missing.model_input(F.col("v"))).collect()[0][0] == -1.0
    assert [r[0] for r in df.select(missing.clip_max(missing.nan_to_null(F.col("v")), 1.0)).collect()][4:] == [1.0, 0.5]


def test_unknown_names(spark):
    with pytest.raises(ValueError):
        bands.index("EVI")
    with pytest.warns(UserWarning):
        similarity.similarity("nonesuch", F.array(F.lit(1.0)), F.array(F.lit(1.0)))
    with pytest.raises(ValueError):
        crs.transform(F.lit(0.0), F.lit(0.0), 4326, 3857)


def test_grid_rounds_half_to_even(spark):
    g = GridSpec(10, 10, a=1.0, e=-1.0)
    rows = spark.createDataFrame([(2.5, -2.5), (3.5, -3.5), (2.4, -2.6)], "x double, y double").select(*g.map_to_pixel(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in rows] == [(2, 2), (4, 4), (3, 2)]


def test_utm_meridian(spark):
    e, n = crs.to_utm(F.lit(-33.0), F.lit(-9.5), -33.0)
    row = spark.range(1).select(e, n).first()
    assert abs(row[0] - 500_000) < 1e-6 and 8_900_000 < row[1] < 9_000_000


def test_overlap_is_exact():
    square = lambda x, y, s: np.array([(x, y, x + s, y), (x + s, y, x + s, y + s), (x + s, y + s, x, y + s), (x, y + s, x, y)], float)
    own, both = overlay.shared_area(square(0, 0, 10), [square(5, 5, 10), square(8, 0, 4)])
    assert own == 100 and abs(both - (25 + 8)) < 1e-9
    triangle = np.array([(0, 0, 10, 0), (10, 0, 0, 10), (0, 10, 0, 0)], float)
    own, both = overlay.shared_area(triangle, [square(0, 0, 5)])
    assert abs(own - 50) < 1e-9 and abs(both - 25) < 1e-9


def test_wkb_round_trip():
    parts = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]], [[(9.0, 9.0), (10.0, 9.0), (10.0, 10.0), (9.0, 9.0)]]]
    assert geometry.parse_wkb(geometry.make_wkb(parts)) == parts
    with pytest.raises(ValueError):
        geometry.parse_wkb(b"\1\1\0\0\0" + b"\0" * 16)


def test_equal_grids_are_not_resampled(spark):
    g = GridSpec(3, 2)
    df = frame(spark, np.arange(6.0).reshape(2, 3))
    assert warp.bilinear(df, g, g).collect() == df.collect()


def test_one_class_svm_separates(spark):
    rng = np.random.default_rng(8)
    ref = rng.normal(0, 1, (150, 3))
    m = models.fit_one_class(ref, nu=0.1)
    assert abs(m.alpha.sum() - 1) < 1e-9 and m.alpha.max() <= 1 / (0.1 * 150) + 1e-9
    assert 0.03 < (m.score(ref) < 0).mean() < 0.2
    assert (m.score(rng.normal(9, 1, (50, 3))) < 0).all()


def test_canny_finds_a_step():
    image = np.zeros((15, 15), int)
    image[:, 8:] = 255
    e = texture.canny(image)
    assert e.any() and set(np.argwhere(e)[:, 1]) <= {7, 8} and not texture.canny(np.full((15, 15), 9)).any()


def test_folds_and_samples(spark):
    w = spark.range(400).select((F.col("id") % 20).cast("int").alias("win_r"), (F.col("id") / 20).cast("int").alias("win_c"))
    f = labels.folds(w.select((F.col("win_r") * 100 + F.col("win_c")).alias("block_id")))
    assert f.count() == 400 and f.groupBy("fold").count().agg(F.min("count"), F.max("count")).first() == (80, 80)
    rows = w.withColumn("label", F.when(F.col("win_r") < 2, "positive").otherwise("negative")).withColumn("built_score", (F.col("win_r") + F.col("win_c")).cast("double"))
    s = labels.training_sample(rows)
    n = {(r["y"], r["is_hard"]): r["count"] for r in s.groupBy("y", "is_hard").count().collect()}
    assert n == {(1, False): 40, (0, True): 80, (0, False): 80} and s.select("win_r", "win_c").distinct().count() == 200


def test_name_repair():
    assert scalar.repair_name("São".encode().decode("latin-1")) == "São"
    assert scalar.repair_name(None) is None and scalar.repair_name("plain") == "plain"


def test_reference_windows_need_room(spark):
    m = spark.createDataFrame([(0, 0)], "r int, c int")
    with pytest.raises(ValueError):
        similar.reference_windows(spark, 10, 10, (0, 0, 5, 5), m)


def test_zonal_of_a_polygon_without_pixels(spark):
    px = spark.createDataFrame([(1, 0, 0)], "poly_id long, r int, c int")
    raster = spark.createDataFrame([(0, 0, 0.7)], "r int, c int, p double")
    polygons = spark.createDataFrame([(1,), (2,)], "poly_id long")
    assert {tuple(r) for r in zonal.zonal_stats(px, raster, polygons).collect()} == {(1, 0.7, 0.7, 1), (2, None, None, 0)}


def test_deviations_keep_their_digits_beside_a_large_mean(spark):
    rng = np.random.default_rng(4)
    values = 1e9 + rng.normal(0, 2, (25, 25))
    px = spark.createDataFrame([(r, c, float(values[r, c])) for r in range(25) for c in range(25)], "r int, c int, v double")
    for w in windows.window_stats(px, {"v": F.col("v")}, 25, 25).collect():
        part = values[w["win_r"] : w["win_r"] + 15, w["win_c"] : w["win_c"] + 15]
        assert abs(w["v_std"] - part.std()) < 1e-6 and abs(w["v_mean"] - part.mean()) < 1e-5


def test_quantiles_equal_linear_interpolation(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(0, 1, 500), 1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.02, 0.25, 1 / 3, 0.5, 0.98, 1.0]
    assert np.allclose(ranks.quantiles(df, "v", shares), np.quantile(values, shares))
    assert ranks.quantiles(df.where("v is null"), "v", [0.5]) == [None]


def test_equal_bin_edges_raise(spark):
    rows = spark.createDataFrame([(1.0, 0.1)] * 9 + [(2.0, 0.2)], "size double, p double")
    with pytest.raises(ValueError, match="unique"):
        zonal.size_tertiles(rows, "size", "p")
