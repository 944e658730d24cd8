"""Registered queries over the fixtures, and the DuckDB SQL that each has to equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import Fixtures, duck_view
from ..functions import scalar
from ..functions.bands import BANDS, INDICES, index
from ..grid import GridSpec
from ..operators import labels, metrics, objects, ranks, similar, summary, terrain, vectors, windows, zonal
from ..sources import rasters, tables
from ..storage import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
W, S = windows.WINDOW, windows.STRIDE
CORE, PERIPHERY = ("Centre",), ("North", "South")
OBJECT_THRESHOLD = 0.65
GRID = GridSpec(fx.WIDTH, 3000, a=0.0001, c=-36.0, e=-0.0001, f=-9.5, crs="EPSG:4326")


def query(sql: str | None = None):
    def register(f: Callable[[Fixtures], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    return df.select(*[F.round(c, special.get(c, digits)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def duck(*views: str) -> str:
    return "with recursive " + ", ".join(duck_view(v) if v in ("px", "dsm", "socio", "cls", "prob", "edges", "polygons", "scores") else _SHARED[v] for v in views) + "\n"


_SHARED = {
    "hh": "hh as (select count(*) // 50 h from orders)",
    "win": f"""wr as (select cast(unnest(range(0, h - {W} + 1, {S})) as int) win_r from hh union select cast(h - {W} as int) from hh),
 win as (select win_r, cast(x as int) win_c from wr cross join (values (0),(10),(20),(30),(35)) t(x))""",
    "wpx": f"wpx as (select win_r, win_c, px.* from px join win on r between win_r and win_r + {W - 1} and c between win_c and win_c + {W - 1})",
    "polypx": """grid as (select cast(o_orderkey // 50 as int) r, cast(o_orderkey % 50 as int) c from orders),
 polypx as (select poly_id, r, c from grid join edges on (y1 <= r + 0.5) <> (y2 <= r + 0.5) and x1 + (r + 0.5 - y1) * (x2 - x1) / (y2 - y1) > c + 0.5
 group by poly_id, r, c having count(*) % 2 = 1)""",
    "probm": "probm as (select p.r, p.c, case when s.vuln is not null then p.p end p from prob p join socio s on p.r = s.r and p.c = s.c)",
    "feat": "feat as (select win_r, win_c, avg(B2) B2_mean, avg(B3) B3_mean, avg(B4) B4_mean, avg(B8) B8_mean, avg(B11) B11_mean, avg(B12) B12_mean, avg((B11-B8)/(B11+B8+1e-8)) NDBI_mean, avg((B8-B4)/(B8+B4+1e-8)) NDVI_mean from wpx group by win_r, win_c)",
    "frac": f"frac as (select win_r, win_c, count(m.r) / {W * W}::double frac from win left join (select distinct r, c from polypx) m on m.r between win_r and win_r + {W - 1} and m.c between win_c and win_c + {W - 1} group by win_r, win_c)",
    "built": """ranked as (select win_r, win_c, bright, NDBI_mean, (rank() over (order by bright) + (count(*) over (partition by bright) - 1) / 2.0::double) / count(*) over () pb,
 (rank() over (order by NDBI_mean) + (count(*) over (partition by NDBI_mean) - 1) / 2.0::double) / count(*) over () pn from (select *, (B2_mean + B3_mean + B4_mean + B8_mean + B11_mean + B12_mean) / 6 bright from feat) q),
 built as (select win_r, win_c, bright, pb + pn built_score from ranked)""",
    "lab": "lab as (select f.win_r, f.win_c, frac, case when frac >= 0.5 then 'positive' when frac > 0 then 'ambiguous' else 'negative' end label, built_score from frac f join built b using (win_r, win_c))",
    "zs": "zs as (select p.poly_id, town, value, avg(m.p) mean_prob, max(m.p) max_prob, count(m.p) n_px, quantile_cont(m.p, 0.9) p90_prob from polygons p left join polypx x on x.poly_id = p.poly_id left join probm m on m.r = x.r and m.c = x.c group by p.poly_id, town, value)",
    "scoped": "scoped as (select *, case when coalesce(town, '?') = 'Centre' then 'core' when coalesce(town, '?') in ('North', 'South') then 'periphery' else 'outside' end scope from zs)",
    "comp": f"""onpx as (select r * 50 + c id, r, c from prob where p >= {OBJECT_THRESHOLD}),
 adj as (select a.id a, b.id b from onpx a join onpx b on (b.r = a.r and b.c in (a.c - 1, a.c + 1)) or (b.c = a.c and b.r in (a.r - 1, a.r + 1))),
 reach as (select id, id root from onpx union select adj.b, reach.root from reach join adj on adj.a = reach.id where reach.root < adj.b),
 comp as (select o.r, o.c, cast(min(root) as bigint) blob_id from reach join onpx o on o.id = reach.id group by o.r, o.c)""",
    "blobs": "blobs as (select blob_id, count(*) n_px, avg(p) mean_prob, max(p) max_prob from comp join prob using (r, c) group by blob_id)",
    "hit": "kept as (select * from blobs where n_px >= 3), hit as (select distinct blob_id from comp where (r, c) in (select (r, c) from polypx) and blob_id in (select blob_id from kept))",
    "pts": "pts as (select s threshold, sum(sum(y)) over (order by s desc) tp, sum(count(*)) over (order by s desc) n, sum(y) pos from scores group by s)",
    "tot": "tot as (select sum(y) p, count(*) n from scores)",
}


def _idx(name: str) -> str:
    return {
        "NDVI": "(B8-B4)/(B8+B4+1e-8)", "NDBI": "(B11-B8)/(B11+B8+1e-8)", "BSI": "(B11+B4-B8-B2)/(B11+B4+B8+B2+1e-8)", "MNDWI": "(B3-B11)/(B3+B11+1e-8)", "SWIR_RATIO": "B11/(B12+1e-8)",
    }[name]


def _features(f: Fixtures) -> DataFrame:
    values = {b: F.col(b) for b in BANDS} | {"NDBI": index("NDBI"), "NDVI": index("NDVI")}
    return windows.window_stats(f.px, values, f.height, f.width, std=False)


# --- windows

@query(duck("px", "hh", "win", "wpx") + "select win_r, win_c, count(*) n_px, " + ", ".join(f"round(avg({b}), 6) {b}_mean, round(stddev_pop({b}), 6) {b}_std" for b in BANDS) + " from wpx group by win_r, win_c")
def window_features(f):
    return rounded(windows.window_stats(f.px, {b: F.col(b) for b in BANDS}, f.height, f.width))


@query(duck("px", "hh", "win", "wpx") + "select win_r, win_c, count(*) n_px, " + ", ".join(f"round(avg({_idx(i)}), 6) {i}_mean, round(stddev_pop({_idx(i)}), 6) {i}_std" for i in INDICES) + " from wpx group by win_r, win_c")
def index_features(f):
    return rounded(windows.window_stats(f.px, {i: index(i) for i in INDICES}, f.height, f.width))


@query(duck("dsm", "hh", "win") + f""", j as (select win_r, win_c, r, c, z, coalesce(z, avg(z) over (partition by win_r, win_c)) f from dsm join win on r between win_r and win_r + {W - 1} and c between win_c and win_c + {W - 1}),
 g as (select *, abs(f - lag(f) over d) dr, abs(f - lag(f) over a) dc, coalesce((lead(f) over d - lag(f) over d) / 2, lead(f) over d - f, f - lag(f) over d, 0) gr, coalesce((lead(f) over a - lag(f) over a) / 2, lead(f) over a - f, f - lag(f) over a, 0) gc
 from j window d as (partition by win_r, win_c, c order by r), a as (partition by win_r, win_c, r order by c))
select win_r, win_c, round(coalesce(avg(z), 0), 9) DSM_mean, round(coalesce(stddev_pop(z), 0), 9) DSM_std, round(coalesce((sum(dr) + sum(dc)) / (count(dr) + count(dc)), 0), 9) DSM_roughness,
 round(case when count(z) > 0 then avg(degrees(atan(sqrt(gr*gr + gc*gc) / 10))) else 0 end, 9) DSM_slope_mean, round(case when count(z) > 0 then stddev_pop(degrees(atan(sqrt(gr*gr + gc*gc) / 10))) else 0 end, 9) DSM_slope_std from g group by win_r, win_c""")
def dsm_features(f):
    return rounded(terrain.terrain_features(f.dsm, f.height, f.width), 9)


@query(duck("cls", "hh", "win") + f""", k as (select win_r, win_c, count(*) + 1e-8 n, count(*) filter (cls = 2) a, count(*) filter (cls = 3) b, count(*) filter (cls = 4) p, count(*) filter (cls = 1) s, count(*) filter (cls in (5, 6)) v from cls join win on r between win_r and win_r + {W - 1} and c between win_c and win_c + {W - 1} group by win_r, win_c)
select win_r, win_c, round(a/n, 6) pct_ceramic, round(b/n, 6) pct_fiber, round(p/n, 6) pct_paved, round(s/n, 6) pct_soil, round(v/n, 6) pct_veg, round(a/n + b/n + s/n, 6) informality, round(p/n + v/n, 6) formality from k""")
def class_composition(f):
    return rounded(terrain.class_shares(f.cls, f.height, f.width))


@query(duck("edges", "polypx", "hh", "win", "frac") + "select win_r, win_c, round(frac, 6) frac from frac where frac > 0")
def window_overlap_explode(f):
    return rounded(windows.overlap_fraction(vectors.mask(f.edges, f.height, f.width), f.height, f.width))


@query(duck("edges", "polypx", "hh", "win", "frac") + "select win_r, win_c, round(frac, 6) frac from frac")
def window_overlap_sat(f):
    mask = vectors.mask(f.edges, f.height, f.width).withColumn("m", F.lit(1))
    layer = f.prob.select("r", "c").join(mask, ["r", "c"], "left")
    s = terrain.summed_windows(terrain.summed_area(layer, "m"), windows.all_windows(f.spark, f.height, f.width))
    return rounded(s.select("win_r", "win_c", (F.col("s") / F.lit(float(W * W))).alias("frac")))


@query(duck("socio", "hh", "win") + f"select win_r, win_c, round(avg(vuln), 9) vuln_mean, count(vuln) n_valid from socio join win on r between win_r and win_r + {W - 1} and c between win_c and win_c + {W - 1} group by win_r, win_c")
def nan_window_means(f):
    w = windows.window_sums(f.socio, {"s": F.sum("vuln"), "n": F.count("vuln")}, f.height, f.width)
    return rounded(w.select("win_r", "win_c", F.try_divide("s", "n").alias("vuln_mean"), F.col("n").alias("n_valid")), 9)


@query(duck("socio", "hh", "win") + f"select win_r, win_c, cast(count(vuln) > 0 as int) has_socio from socio join win on r between win_r and win_r + {W - 1} and c between win_c and win_c + {W - 1} group by win_r, win_c")
def coverage_flag(f):
    w = windows.window_sums(f.socio, {"n": F.count("vuln")}, f.height, f.width)
    return w.select("win_r", "win_c", (F.col("n") > 0).cast("int").alias("has_socio"))


@query(duck("prob", "hh", "win") + f", s as (select win_r, win_c, avg(p) score from prob join win on r between win_r and win_r + {W - 1} and c between win_c and win_c + {W - 1} group by win_r, win_c) select r, c, round(avg(score), 9) score from s join prob on r between win_r and win_r + {W - 1} and c between win_c and win_c + {W - 1} group by r, c")
def heatmap_mean(f):
    scored = windows.window_stats(f.prob, {"p": F.col("p")}, f.height, f.width, std=False).withColumnRenamed("p_mean", "score")
    return rounded(windows.scatter_mean(scored, "score"), 9)


@query(duck("prob", "hh", "win") + f""", s as (select win_r, win_c, avg(p) score, case when win_r % 20 = 0 then 1 else 0 end pred from prob join win on r between win_r and win_r + {W - 1} and c between win_c and win_c + {W - 1} group by win_r, win_c)
select r, c, cast(avg(pred) >= 0.5 as int) vote, round(avg(score - (select min(score) from s)), 9) score from s join prob on r between win_r and win_r + {W - 1} and c between win_c and win_c + {W - 1} group by r, c""")
def majority_vote(f):
    scored = windows.window_stats(f.prob, {"p": F.col("p")}, f.height, f.width, std=False)
    scored = scored.select("win_r", "win_c", F.col("p_mean").alias("score"), F.when(F.col("win_r") % 20 == 0, 1).otherwise(0).alias("pred"))
    return rounded(windows.vote(scored, "pred", "score"), 9)


@query(duck("prob", "hh") + f""", likely as (select r, c from prob where p >= 0.5), box as (select min(r) r0, min(c) c0, max(r) r1, max(c) c1 from likely),
 rw as (select unnest(range(r0, least(r1 + 1, h - {W} + 1), 7)) win_r from box, hh), cw as (select unnest(range(c0, least(c1 + 1, 50 - {W} + 1), 7)) win_c from box)
select cast(win_r as int) win_r, cast(win_c as int) win_c, round(count(*) / {W * W}::double, 6) frac from rw cross join cw join likely m on r between win_r and win_r + {W - 1} and c between win_c and win_c + {W - 1} group by win_r, win_c having count(*) / {W * W}::double >= 0.5""")
def reference_windows(f):
    mask = f.prob.where("p >= 0.5").select("r", "c")
    box = mask.agg(F.min("r"), F.min("c"), F.max("r"), F.max("c")).first()
    return rounded(similar.reference_windows(f.spark, f.height, f.width, tuple(box), mask))


# --- similarity

@query(duck("px", "hh", "win", "wpx", "feat") + "select win_r, win_c, " + ", ".join(f"round(({b}_mean - avg({b}_mean) over ()) / (stddev_pop({b}_mean) over () + 1e-8), 6) {b}_mean" for b in BANDS) + " from feat")
def zscore_normalise(f):
    columns = [f"{b}_mean" for b in BANDS]
    return rounded(similar.zscores(_features(f).select("win_r", "win_c", *columns), columns))


def _vectors(f: Fixtures) -> DataFrame:
    e = f.spark.table("embeddings")
    return e.select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(64)], "label")


_REF = "with e as (select vec_id, label, unnest(embedding)::double x, generate_subscripts(embedding, 1) k from embeddings), m as (select k, avg(x) m from e where label = 0 group by k), d as (select vec_id, sum(x * m) xy, sum(x * x) xx, sum(m * m) yy, sum((x - m) * (x - m)) dd from e join m using (k) group by vec_id)\n"


@query(_REF + "select vec_id, round((xy / ((sqrt(xx) + 1e-8) * (sqrt(yy) + 1e-8)) + 1) / 2, 6) similarity from d")
def cosine_similarity(f):
    return rounded(similar.scored(_vectors(f), [f"f{k}" for k in range(64)], F.col("label") == 0).select("vec_id", "similarity"))


@query(_REF + "select vec_id, round(1 / (1 + sqrt(dd)), 6) similarity from d")
def euclidean_similarity(f):
    return rounded(similar.scored(_vectors(f), [f"f{k}" for k in range(64)], F.col("label") == 0, "euclidean").select("vec_id", "similarity"))


@query(_REF + "select vec_id, round((xy / ((sqrt(xx) + 1e-8) * (sqrt(yy) + 1e-8)) + 1) / 2, 6) similarity from d order by similarity desc, vec_id limit 5")
def top5_similar(f):
    scored = rounded(similar.scored(_vectors(f), [f"f{k}" for k in range(64)], F.col("label") == 0).select("vec_id", "similarity"))
    return similar.most_similar(scored, 5, ["vec_id"])


@query(duck("px") + ", q as (select " + ", ".join(f"quantile_cont({b}, 0.02) l{b}, quantile_cont({b}, 0.98) h{b}" for b in ("B4", "B3", "B2")) + " from px) select r, c, " + ", ".join(f"cast(floor(least(greatest(({b} - l{b}) / (h{b} - l{b} + 1e-8), 0), 1) * 255) as int) {n}" for b, n in (("B4", "red"), ("B3", "green"), ("B2", "blue"))) + " from px, q")
def rgb_stretch(f):
    return similar.display(f.px)


@query(duck("px", "hh", "win", "wpx") + ", m as (select *, min(B8) over (partition by win_r, win_c) lo, max(B8) over (partition by win_r, win_c) hi from wpx) select win_r, win_c, r, c, cast(case when hi - lo >= 1e-8 then floor((B8 - lo) / (hi - lo)::double * 255) else 0 end as int) grey from m")
def grey_levels(f):
    from pyspark.sql import Window

    w = windows.explode_windows(f.px.select("r", "c", F.col("B8").cast("double").alias("B8")), f.height, f.width)
    part = Window.partitionBy("win_r", "win_c")
    return w.select("win_r", "win_c", "r", "c", scalar.grey_level(F.col("B8"), F.min("B8").over(part), F.max("B8").over(part)).alias("grey"))


# --- polygons

@query(duck("edges", "polypx") + "select * from polypx")
def rasterize_polygons(f):
    return vectors.rasterize(f.edges, f.height, f.width)


@query(duck("edges", "polypx", "polygons") + "select r, c, max_by(value, x.poly_id) as value from polypx x join polygons p on p.poly_id = x.poly_id where p.poly_id % 5 <> 0 group by r, c")
def rasterize_field(f):
    return vectors.burn(f.edges, f.polygons.withColumn("value", F.when(F.col("poly_id") % 5 != 0, F.col("value"))), "value", f.height, f.width)


@query(duck("edges") + "select poly_id, round(sum(case when ring = 0 then a else -a end), 6) area from (select poly_id, part, ring, abs(sum(x1*y2 - x2*y1) / 2) a from edges group by all) group by poly_id")
def polygon_area(f):
    return rounded(vectors.area(f.edges))


def _side(axis: str, at: float, low: float, high: float) -> str:
    """Whether an edge crosses the side of a box on the line x (or y) = ``at``."""
    a, b = (axis, "y" if axis == "x" else "x")
    return f"(({a}1 < {at}) <> ({a}2 < {at}) and {b}1 + ({at} - {a}1) * ({b}2 - {b}1) / ({a}2 - {a}1) between {low} and {high})"


@query(duck("edges") + f""", e as (select poly_id, max(case when (x1 between 4 and 15 and y1 between 4 and 18) or {_side("x", 4, 4, 18)} or {_side("x", 15, 4, 18)} or {_side("y", 4, 4, 15)} or {_side("y", 18, 4, 15)} then 1 else 0 end) cut,
 sum(case when (y1 <= 4) <> (y2 <= 4) and x1 + (4 - y1) * (x2 - x1) / (y2 - y1) > 4 then 1 else 0 end) crossings from edges group by poly_id)
select poly_id from e where cut = 1 or crossings % 2 = 1""")
def polygons_in_box(f):
    return vectors.intersecting_box(f.edges, 4.0, 4.0, 15.0, 18.0)


@query(duck("edges", "polypx", "socio", "prob", "probm", "polygons", "zs") + "select poly_id, round(mean_prob, 9) mean_prob, max_prob, n_px from zs")
def zonal_stats(f):
    return rounded(_zones(f).select("poly_id", "mean_prob", "max_prob", "n_px"), 9)


def _masked(f: Fixtures) -> DataFrame:
    covered = f.socio.where("vuln is not null").select("r", "c", F.lit(1).alias("_in"))
    return f.prob.join(covered, ["r", "c"], "left").select("r", "c", F.when(F.col("_in") == 1, F.col("p")).alias("p"))


def _zones(f: Fixtures) -> DataFrame:
    stats = zonal.zonal_stats(vectors.rasterize(f.edges, f.height, f.width), _masked(f), f.polygons)
    return f.polygons.join(stats, "poly_id").withColumn("scope", zonal.scope(F.col("town"), CORE, PERIPHERY))


@query(duck("edges", "polypx", "socio", "prob", "probm", "polygons", "zs") + "select poly_id, round(mean_prob, 9) mean_prob, max_prob, round(p90_prob, 9) p90_prob from zs")
def zonal_p90(f):
    return rounded(zonal.zonal_p90(vectors.rasterize(f.edges, f.height, f.width), _masked(f), f.polygons), 9)


@query(duck("edges", "polypx", "socio", "polygons") + "select p.poly_id, round(avg(case when x.r is null then null when s.vuln is not null then 1 else 0 end), 9) covered from polygons p left join polypx x on x.poly_id = p.poly_id left join socio s on s.r = x.r and s.c = x.c group by p.poly_id")
def covered_fraction(f):
    return rounded(zonal.covered_fraction(vectors.rasterize(f.edges, f.height, f.width), f.socio.where("vuln is not null"), f.polygons), 9)


@query(duck("polygons") + "select poly_id, case when town = 'Centre' then 'core' when town in ('North', 'South') then 'periphery' else 'outside' end as scope from polygons")
def scope_classify(f):
    return f.polygons.select("poly_id", zonal.scope(F.col("town"), CORE, PERIPHERY).alias("scope"))


@query(duck("edges", "polypx", "socio", "prob", "probm", "polygons", "zs", "scoped") + """, t as (select * from scoped cross join (values (0.5::double), (0.7), (0.9)) v(threshold) where scope <> 'outside')
select coalesce(scope, 'all') as scope, threshold, count(*) n, round(avg(case when coalesce(max_prob >= threshold, false) then 1 else 0 end) * 100, 6) detected_pct from t group by grouping sets ((scope, threshold), (threshold))""")
def detection_by_scope(f):
    return rounded(zonal.detection_table(_zones(f), (0.5, 0.7, 0.9)))


@query(duck("edges", "polypx", "socio", "prob", "probm", "polygons", "zs") + "select count(*) filter (mean_prob < 0.5 and max_prob >= 0.5) touched from zs")
def touched_polygons(f):
    return zonal.touched(_zones(f))


@query(duck("edges", "polypx", "socio", "prob", "probm", "polygons", "zs") + ", q as (select quantile_cont(value, [1/3::double, 2/3::double]) e from zs) select cast((value > e[1])::int + (value > e[2])::int as int) size_bin, count(*) n, max(value) largest, round(avg(case when coalesce(mean_prob >= 0.5, false) then 1 else 0 end) * 100, 9) detected_pct, round(median(mean_prob), 9) as median from zs, q group by 1")
def size_tertiles(f):
    return rounded(zonal.size_tertiles(_zones(f), "value", "mean_prob"), 9)


@query(duck("edges", "polypx", "socio", "prob", "probm", "polygons", "zs") + "select round(quantile_cont(mean_prob, 0.25), 9) q25, round(quantile_cont(mean_prob, 0.5), 9) as median, round(quantile_cont(mean_prob, 0.75), 9) q75 from zs")
def polygon_quartiles(f):
    return rounded(zonal.quartiles(_zones(f), "mean_prob"), 9)


@query(duck("edges", "polypx", "socio", "prob", "probm", "polygons", "zs") + "select poly_id, round(mean_prob, 9) mean_prob, town, cast(null as double) as value from zs where poly_id % 2 = 0 union all select poly_id, round(mean_prob, 9), null, value from zs where poly_id % 2 = 1")
def union_scores(f):
    z = _zones(f)
    return rounded(zonal.union_scores(z.where("poly_id % 2 = 0").select("poly_id", "mean_prob", "town"), z.where("poly_id % 2 = 1").select("poly_id", "mean_prob", "value")), 9)


# --- labels

def _labelled(f: Fixtures, windows_of: DataFrame | None = None) -> DataFrame:
    """Windows (by default with their built-up score) with the covered share and its label."""
    frac = windows.overlap_fraction(vectors.mask(f.edges, f.height, f.width), f.height, f.width)
    every = labels.built_up(_features(f).drop("n_px")) if windows_of is None else windows_of
    return every.join(frac, ["win_r", "win_c"], "left").withColumn("frac", F.coalesce("frac", F.lit(0.0))).withColumn("label", labels.label(F.col("frac")))


@query(duck("edges", "polypx", "hh", "win", "frac") + "select win_r, win_c, round(frac, 6) frac, case when frac >= 0.5 then 'positive' when frac > 0 then 'ambiguous' else 'negative' end as label from frac")
def label_windows(f):
    return rounded(_labelled(f, windows.all_windows(f.spark, f.height, f.width)).select("win_r", "win_c", "frac", "label"))


@query(duck("px", "hh", "win", "wpx", "feat", "built") + "select win_r, win_c, round(bright, 6) brightness, round(built_score, 6) built_score from built")
def builtup_rank(f):
    return rounded(labels.built_up(_features(f).drop("n_px")))


_PICK = "md5(concat_ws(':', '{}', cast(win_r as varchar), cast(win_c as varchar)))"
_HARD = duck("px", "hh", "win", "wpx", "feat", "edges", "polypx", "frac", "built", "lab") + f", neg as (select * from lab where frac < 0.1), hard as (select * from (select * from neg order by built_score desc, win_r, win_c limit 12) order by {_PICK.format(42)}, win_r, win_c limit 3)\n"


@query(_HARD + "select win_r, win_c, round(built_score, 6) built_score from hard")
def hard_negatives(f):
    return rounded(labels.hard_negatives(_labelled(f).where("frac < 0.1"), 3).select("win_r", "win_c", "built_score"))


@query(_HARD + f"select win_r, win_c from neg where (win_r, win_c) not in (select (win_r, win_c) from hard) order by {_PICK.format(43)}, win_r, win_c limit 4")
def easy_negatives(f):
    negatives = _labelled(f).where("frac < 0.1")
    return labels.easy_negatives(negatives, labels.hard_negatives(negatives, 3), 4).select("win_r", "win_c")


@query("with b as (select distinct (o_orderkey // 50) // 10 * 5 + (o_orderkey % 50) // 10 block_id from orders) select block_id, cast((row_number() over (order by md5(concat('42:', cast(block_id as varchar))), block_id) - 1) % 5 as int) fold from b")
def spatial_folds(f):
    grid = GridSpec(f.width, f.height)
    return labels.folds(f.prob.select(grid.block_id(F.col("r"), F.col("c"), 10).alias("block_id")))


@query(duck("scores") + ", k as (select *, row_number() over (partition by y order by md5(concat('42:', cast(id as varchar))), id) n from scores) select id, y, s from k where n <= 50")
def stratified_sample(f):
    return labels.stratified_sample(f.scores, 50)


@query(duck("scores") + "select id, y, round((select count(*) from scores) / (2.0::double * count(*) over (partition by y)), 6) weight from scores")
def class_weights(f):
    return rounded(labels.class_weights(f.scores).select("id", "y", "weight"))


# --- objects

def _on(f: Fixtures) -> DataFrame:
    return objects.label(f.prob.where(F.col("p") >= OBJECT_THRESHOLD).select("r", "c"), f.width)


@query(duck("prob", "comp") + "select cast(r as bigint) r, cast(c as bigint) c, blob_id from comp")
def connected_components(f):
    return _on(f)


@query(duck("prob", "comp", "blobs") + "select blob_id, n_px, round(mean_prob, 9) mean_prob, max_prob from blobs")
def object_sizes(f):
    return rounded(objects.sizes(_on(f), f.prob), 9)


@query(duck("prob", "comp", "blobs") + "select blob_id, n_px, round(mean_prob, 9) mean_prob, max_prob from blobs where n_px >= 5 and mean_prob >= 0.8")
def object_filter(f):
    return rounded(objects.large(objects.sizes(_on(f), f.prob), 5, 0.8), 9)


@query(duck("prob", "comp", "blobs", "edges", "polypx", "hit") + "select blob_id from hit")
def object_hits_semi(f):
    on = _on(f)
    return objects.hits(on, objects.large(objects.sizes(on, f.prob), 3), vectors.mask(f.edges, f.height, f.width))


@query(duck("prob", "comp", "blobs", "edges", "polypx", "hit") + "select blob_id, n_px, round(mean_prob, 9) mean_prob, max_prob from kept where blob_id not in (select blob_id from hit)")
def false_objects_anti(f):
    on = _on(f)
    kept = objects.large(objects.sizes(on, f.prob), 3)
    return rounded(objects.misses(kept, objects.hits(on, kept, vectors.mask(f.edges, f.height, f.width))), 9)


@query(duck("prob", "comp", "blobs", "edges", "polypx", "polygons", "hit") + """, sh as (select p.poly_id, coalesce(avg(case when x.r is null then null when k.blob_id is not null then 1 else 0 end), 0) share from polygons p left join polypx x on x.poly_id = p.poly_id left join comp on comp.r = x.r and comp.c = x.c left join kept k on k.blob_id = comp.blob_id group by p.poly_id)
select (select count(*) from kept) n_pred, round((select count(*) from hit) / greatest((select count(*) from kept), 1)::double, 6) as precision, round(count(*) filter (share >= 0.25) / greatest(count(*), 1)::double, 6) recall from sh""")
def object_precision_recall(f):
    on = _on(f)
    kept = objects.large(objects.sizes(on, f.prob), 3)
    px = vectors.rasterize(f.edges, f.height, f.width)
    return rounded(objects.precision_recall(on, kept, px.select("r", "c").distinct(), px, f.polygons))


@query()
def polygonize_blobs(f):
    return objects.polygonize(_on(f))


@query(duck("prob", "comp") + """, sides as (select * from (values (0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)) t(dc, dr, ac, ar, bc, br))
select a.blob_id, a.c + ac x1, a.r + ar y1, a.c + bc x2, a.r + br y2 from comp a cross join sides left join comp n on n.r = a.r + dr and n.c = a.c + dc and n.blob_id = a.blob_id where n.blob_id is null""")
def blob_outlines(f):
    return objects.outline_edges(_on(f))


def _at_threshold(t: float) -> str:
    """Both rows of object figures at a threshold: all objects, and those of the stricter filter."""
    base = duck("prob", "comp", "blobs", "edges", "polypx", "polygons").replace(f"p >= {OBJECT_THRESHOLD}", f"p >= {t}")
    figures = []
    for name, rule in (("raw", "n_px >= 3"), ("strict", "n_px >= 5 and mean_prob >= 0.8")):
        base += f""", {name}_k as (select * from blobs where {rule}), {name}_h as (select distinct blob_id from comp where (r, c) in (select (r, c) from polypx) and blob_id in (select blob_id from {name}_k)),
 {name}_s as (select p.poly_id, coalesce(avg(case when x.r is null then null when k.blob_id is not null then 1 else 0 end), 0) share from polygons p left join polypx x on x.poly_id = p.poly_id left join comp on comp.r = x.r and comp.c = x.c left join {name}_k k on k.blob_id = comp.blob_id group by p.poly_id)"""
        end = "" if name == "raw" else "_filt"
        figures.append(f'(select count(*) from {name}_k) n_pred{end}, round((select count(*) from {name}_h) / greatest((select count(*) from {name}_k), 1)::double, 6) "precision{end}", (select round(count(*) filter (share >= 0.25) / greatest(count(*), 1)::double, 6) from {name}_s) recall{end}')
    return f"select {t}::double threshold, * from ({base} select {', '.join(figures)})"


@query(" union all ".join(_at_threshold(t) for t in (0.7, 0.9)))
def operating_table(f):
    px = vectors.rasterize(f.edges, f.height, f.width)
    return rounded(objects.operating_table(f.prob, f.width, (0.7, 0.9), 3, 5, 0.8, px.select("r", "c").distinct(), px, f.polygons))


@query(duck("prob", "comp") + "select blob_id, cast(count(*) as double) area from comp group by blob_id")
def dissolve_blobs(f):
    return objects.dissolve(objects.polygonize(_on(f))).select("blob_id", "area")


# --- metrics

@query(duck("scores") + "select count(*) filter (y = 0 and s < 0.5) tn, count(*) filter (y = 0 and s >= 0.5) fp, count(*) filter (y = 1 and s < 0.5) fn, count(*) filter (y = 1 and s >= 0.5) tp from scores")
def confusion_matrix(f):
    return metrics.confusion(f.scores, 0.5)


@query(duck("scores") + """, k as (select count(*) filter (y = 0 and s < 0.5)::double tn, count(*) filter (y = 0 and s >= 0.5)::double fp, count(*) filter (y = 1 and s < 0.5)::double fn, count(*) filter (y = 1 and s >= 0.5)::double tp, count(*)::double n from scores),
 m as (select *, tp/(tp+fp+1e-8) pr, tp/(tp+fn+1e-8) rc, ((tp+fp)*(tp+fn)+(tn+fn)*(tn+fp))/(n*n) pe from k)
select round(pr, 6) as precision, round(rc, 6) recall, round(2*pr*rc/(pr+rc+1e-8), 6) f1, round((tp+tn)/(n+1e-8), 6) accuracy, round(tp/(tp+fp+fn+1e-8), 6) iou, round(((tp+tn)/n-pe)/(1-pe), 6) kappa from m""")
def classification_report(f):
    return rounded(metrics.report(metrics.confusion(f.scores, 0.5)))


@query(duck("scores", "tot") + ", k as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double rk from scores) select round((sum(rk) - any_value(p) * (any_value(p) + 1) / 2.0::double) / (any_value(p) * (any_value(n) - any_value(p)))::double, 6) auc from k, tot where y = 1")
def roc_auc(f):
    return rounded(metrics.roc_auc(f.scores))


@query(duck("scores", "pts", "tot") + "select round(sum(pos * tp / pts.n::double) / any_value(p)::double, 6) ap from pts, tot")
def average_precision(f):
    return rounded(metrics.average_precision(f.scores))


@query(duck("scores", "pts", "tot") + "select threshold, round((pts.n - tp) / (tot.n - p)::double, 6) fpr, round(tp / p::double, 6) tpr from pts, tot")
def roc_curve(f):
    return rounded(metrics.roc_curve(f.scores), 6)


@query(duck("scores", "pts", "tot") + "select threshold, round(tp / pts.n::double, 6) as precision, round(tp / p::double, 6) recall from pts, tot")
def pr_curve(f):
    return rounded(metrics.pr_curve(f.scores), 6)


@query(duck("scores", "pts", "tot") + ", q as (select threshold, tp / pts.n::double pr, tp / p::double rc from pts, tot) select threshold, round(2*pr*rc/(pr+rc+1e-8), 6) f1 from q order by 2*pr*rc/(pr+rc+1e-8) desc, threshold limit 1")
def best_f1_threshold(f):
    return rounded(metrics.best_f1(f.scores))


@query(duck("scores") + ", q as (select quantile_cont(s, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) e from scores), b as (select y, s, len(list_filter(e, lambda x: x < s)) bin from scores, q) select cast(bin as int) bin, count(*) n, round(avg(s), 6) mean_score, round(avg(y), 6) share_positive from b group by bin")
def calibration_bins(f):
    return rounded(metrics.calibration(f.scores))


@query(duck("edges", "polypx", "prob", "socio", "probm") + "select m.r, m.c, cast(case when t.r is not null and coalesce(p >= 0.5, false) then 1 when t.r is null and coalesce(p >= 0.5, false) then 2 when t.r is not null then 3 else 0 end as int) code from probm m left join (select distinct r, c from polypx) t on t.r = m.r and t.c = m.c")
def error_map(f):
    return metrics.error_map(vectors.mask(f.edges, f.height, f.width), _masked(f), 0.5)


@query(duck("prob", "socio") + "select p.r, p.c, p from prob p where (p.r, p.c) in (select (r, c) from socio where vuln is not null)")
def probability_clip(f):
    return f.prob.join(f.socio.where("vuln is not null").select("r", "c"), ["r", "c"], "left_semi").select("r", "c", "p")


@query(duck("prob") + "select r, c, cast(r as bigint) back_r, cast(c as bigint) back_c, round(-36.0::double + c * 0.0001::double, 6) x, round(-9.5::double - r * 0.0001::double, 6) y from prob")
def map_pixel_roundtrip(f):
    x, y = GRID.pixel_to_map(F.col("r"), F.col("c"))
    back_r, back_c = GRID.map_to_pixel(F.col("x"), F.col("y"))
    return rounded(f.prob.select("r", "c", x.alias("x"), y.alias("y")).select("r", "c", back_r.alias("back_r"), back_c.alias("back_c"), "x", "y"))


@query("select * from (values " + ", ".join("({}, {})".format(i, "cast(null as varchar)" if b is None else f"'{b}'") for i, _, b in fx.NAMES_ROWS) + ") t(id, name)")
def fix_encoding(f):
    return f.names.select("id", scalar.fix_encoding("raw").alias("name"))


@query("select name as feature, importance, case when name in ('vuln_mean', 'has_socio') then 'socio' when name like '%DSM%' or name like '%slope%' then 'terrain' else 'spectral' end as kind from (select p_name as name, avg(p_retailprice) importance from (select case p_partkey % 7 when 0 then 'vuln_mean' when 1 then 'DSM_std' when 2 then 'NDVI_mean' when 3 then 'has_socio' when 4 then 'B2_mean' when 5 then 'slope_x' else 'B8_std' end p_name, round(p_retailprice) p_retailprice from part) q group by 1) z order by importance desc, name limit 5")
def importance_topk(f):
    names = ("vuln_mean", "DSM_std", "NDVI_mean", "has_socio", "B2_mean", "slope_x", "B8_std")
    part = f.spark.read.parquet(f"{f.dir}/part.parquet")
    rows = part.select(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 7 + 1).cast("int")).alias("feature"), F.round("p_retailprice").alias("importance"))
    top = metrics.mean_importance(rows).orderBy(F.desc("importance"), "feature").limit(5)
    return top.select("feature", "importance", scalar.feature_group(F.col("feature")).alias("kind"))


# --- texture, resampling, coordinates, overlays, models

_GREY = f""", m as (select *, min(B8) over (partition by win_r, win_c) lo, max(B8) over (partition by win_r, win_c) hi from wpx),
 g as (select win_r, win_c, r, c, cast(floor((case when hi - lo >= 1e-8 then floor((B8 - lo) / (hi - lo)::double * 255) else 0 end) / 4) as int) q from m),
 o as (select * from (values (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) t(angle, dr, dc)),
 pr as (select a.win_r, a.win_c, angle, a.q i, b.q j from g a cross join o join g b on b.win_r = a.win_r and b.win_c = a.win_c and b.r = a.r + dr and b.c = a.c + dc),
 sy as (select * from pr union all select win_r, win_c, angle, j, i from pr),
 n as (select win_r, win_c, angle, i, j, count(*)::double n from sy group by all),
 k as (select win_r, win_c, angle, sum(n*(i-j)*(i-j))/sum(n) contrast, sum(n/(1+(i-j)*(i-j)))/sum(n) homogeneity, sqrt(sum(n*n))/sum(n) energy, sum(n*i)/sum(n) m, sum(n*i*i)/sum(n) s, sum(n*i*j)/sum(n) x from n group by all)
select win_r, win_c, round(avg(contrast), 6) contrast, round(avg(homogeneity), 6) homogeneity, round(avg(energy), 6) energy, round(avg(case when s - m*m > 1e-12 then (x - m*m)/(s - m*m) else 1 end), 6) correlation from k group by win_r, win_c"""


@query(duck("px", "hh", "win", "wpx") + _GREY)
def glcm_texture(f):
    from ..operators import texture

    return rounded(texture.cooccurrence(f.px, "B8", f.height, f.width))


@query()
def edge_density(f):
    from ..operators import texture

    return rounded(texture.edge_density(f.px, "B8", f.height, f.width))


_TARGET = ", t as (select cast(x as int) r, cast(y as int) c, (x + 0.5) * 1.5 - 0.5::double fr, (y + 0.5) * 1.5 - 0.5::double fc from (select unnest(range(0, h * 2 // 3)) x from hh) cross join (select unnest(range(0, 33)) y))"


def _coarse(f: Fixtures) -> tuple[GridSpec, GridSpec]:
    return GridSpec(f.width, f.height, 1.0, e=1.0), GridSpec(33, f.height * 2 // 3, 1.5, e=1.5)


@query(duck("dsm", "hh") + _TARGET + """, k as (select t.r, t.c, (case when a = 0 then 1 - (fr - floor(fr)) else fr - floor(fr) end) * (case when b = 0 then 1 - (fc - floor(fc)) else fc - floor(fc) end) w, z from t cross join (values (0,0),(0,1),(1,0),(1,1)) o(a, b) left join dsm on dsm.r = floor(fr) + a and dsm.c = floor(fc) + b)
select r, c, round(sum(w * z) / sum(case when z is not null then w end), 9) z from k where w > 0 group by r, c""")
def warp_bilinear(f):
    from ..operators import warp

    source, target = _coarse(f)
    return rounded(warp.bilinear(f.dsm, source, target, "z"), 9)


@query(duck("dsm", "hh") + _TARGET + "select t.r, t.c, z from t left join dsm on dsm.r = floor(fr + 0.5) and dsm.c = floor(fc + 0.5)")
def warp_nearest(f):
    from ..operators import warp

    source, target = _coarse(f)
    return warp.nearest(f.dsm, source, target, "z")


def _utm_sql(points: str, meridian: float = -33.0) -> str:
    """Common table expressions that turn ``points`` (..., lon, lat) into ``utm`` (..., e, n): the series of Krueger on GRS80, from its parameters."""
    n = 1 / (2 * 298.257222101 - 1)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    k = 2 * n**0.5 / (1 + n)
    d = lambda x: f"{x!r}::double"
    terms = lambda f, g: " + ".join(f"{d(a)} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    return f"""p0 as ({points}),
 p1 as (select *, radians(lon - {d(meridian)}) q, sinh(atanh(sin(radians(lat))) - {d(k)} * atanh({d(k)} * sin(radians(lat)))) t from p0),
 p2 as (select *, atan2(t, cos(q)) xi, atanh(sin(q) / sqrt(1 + t * t)) eta from p1),
 utm as (select * exclude (q, t, xi, eta), 500000 + {d(radius)} * (eta + {terms("cos", "sinh")}) e, 10000000 + {d(radius)} * (xi + {terms("sin", "cosh")}) n from p2)
"""


@query("with " + _utm_sql("select o_orderkey id, -36.5::double + (o_orderkey % 700) / 100.0::double lon, -11::double + (o_orderkey % 1000) / 500.0::double lat from orders") + "select id, round(e, 3) e, round(n, 3) n, round(lon, 6) lon, round(lat, 6) lat from utm")
def utm_roundtrip(f):
    from ..operators import crs

    rows = f.spark.table("orders").select(F.col("o_orderkey").alias("id"), (F.lit(-36.5) + (F.col("o_orderkey") % 700) / F.lit(100.0)).alias("lon"), (F.lit(-11.0) + (F.col("o_orderkey") % 1000) / F.lit(500.0)).alias("lat"))
    e, n = crs.transform(F.col("lon"), F.col("lat"), 4674, 31985)
    lon, lat = crs.transform(F.col("e"), F.col("n"), 31985, 4326)
    return rounded(rows.select("id", e.alias("e"), n.alias("n")).select("id", "e", "n", lon.alias("lon"), lat.alias("lat")), e=3, n=3)


_CORNERS = "select poly_id, part, ring, seq, k, -36::double + x * 0.0001::double lon, -9.5::double - y * 0.0001::double lat from (select poly_id, part, ring, seq, 1 k, x1 x, y1 y from edges union all select poly_id, part, ring, seq, 2, x2, y2 from edges) q"


@query(duck("edges").rstrip() + ", " + _utm_sql(_CORNERS, -33.0) + """, w as (select poly_id, part, ring, seq, max(e) filter (k = 1) - 200000 x1, max(n) filter (k = 1) - 8900000 y1, max(e) filter (k = 2) - 200000 x2, max(n) filter (k = 2) - 8900000 y2 from utm group by all)
select poly_id, round(sum(case when ring = 0 then a else -a end), 6) area_ha from (select poly_id, part, ring, abs(sum(x1*y2 - x2*y1) / 2) / 10000 a from w group by all) group by poly_id""")
def polygon_hectares(f):
    """Area in hectares, through the metres of a projected system."""
    from ..operators import crs

    degrees = f.edges.withColumns({k: F.lit(-36.0) + F.col(k) * F.lit(0.0001) for k in ("x1", "x2")} | {k: F.lit(-9.5) - F.col(k) * F.lit(0.0001) for k in ("y1", "y2")})
    metres = crs.transform_edges(degrees, 4674, 31985)
    near = metres.withColumns({"x1": F.col("x1") - 200_000, "x2": F.col("x2") - 200_000, "y1": F.col("y1") - 8_900_000, "y2": F.col("y2") - 8_900_000})
    return rounded(vectors.area(near, 10_000.0).withColumnRenamed("area", "area_ha"))


#: Strips between neighbouring heights, and in these between neighbouring crossings, lie wholly inside or outside of any polygon.
_STRIPS = """, every as (select poly_id // 10 b, 0 side, poly_id id, x1, y1, x2, y2 from edges union all select poly_id // 10, 1, poly_id, x1 + 1, y1 + 1, x2 + 1, y2 + 1 from edges),
 met as (select a.b, a.y1, a.y2, ((c.x1 - a.x1) * (c.y2 - c.y1) - (c.y1 - a.y1) * (c.x2 - c.x1)) / nullif((a.x2 - a.x1) * (c.y2 - c.y1) - (a.y2 - a.y1) * (c.x2 - c.x1), 0) t from every a join every c on a.b = c.b),
 hs as (select b, y1 y from every union select b, y1 + t * (y2 - y1) from met where t between 0 and 1),
 slabs as (select b, y lo, lead(y) over (partition by b order by y) hi from hs),
 xs as (select s.b, lo, hi, side, id, x1 + ((lo + hi) / 2 - y1) * (x2 - x1) / (y2 - y1) x from slabs s join every e on e.b = s.b and (y1 <= (lo + hi) / 2) <> (y2 <= (lo + hi) / 2)),
 cuts as (select b, lo, hi, x, lead(x) over (partition by b, lo order by x) nx from (select distinct b, lo, hi, x from xs)),
 inside as (select s.b, s.lo, s.hi, s.x, s.nx, side, id from cuts s join xs on xs.b = s.b and xs.lo = s.lo and xs.x > (s.x + s.nx) / 2 group by all having count(*) % 2 = 1)
select i.id poly_id, round(100 * sum(case when o.b is not null then (i.nx - i.x) * (i.hi - i.lo) else 0 end) / sum((i.nx - i.x) * (i.hi - i.lo)), 1) overlap_pct
 from inside i left join (select distinct b, lo, x from inside where side = 1) o on o.b = i.b and o.lo = i.lo and o.x = i.x where i.side = 0 group by i.id"""


@query(duck("edges") + _STRIPS)
def polygon_overlap(f):
    from ..operators import overlay

    moved = f.edges.withColumns({k: F.col(k) + 1.0 for k in ("x1", "y1", "x2", "y2")})
    return overlay.overlap_percent(f.edges, moved, 10.0)


@query()
def one_class_svm(f):
    from ..operators import models

    columns = [f"f{k}" for k in range(64)]
    return rounded(models.one_class_scores(_vectors(f), columns, F.col("label") == 0).select("vec_id", "svm_score", "svm_inlier"))


def _training(f: Fixtures) -> tuple[DataFrame, list[str]]:
    rows = _labelled(f).join(_features(f).drop("n_px"), ["win_r", "win_c"])
    grid = GridSpec(f.width, f.height)
    rows = rows.withColumn("block_id", grid.block_id(F.col("win_r"), F.col("win_c"), 20)).withColumn("in_scope", F.col("win_c") < 30)
    # half a window on a polygon is rare in this raster, so a tenth counts here
    rows = rows.withColumn("label", F.when(F.col("frac") >= 0.1, "positive").when(F.col("frac") > 0, "ambiguous").otherwise("negative"))
    return rows.join(F.broadcast(labels.folds(rows)), "block_id"), [f"{b}_mean" for b in BANDS] + ["NDBI_mean", "NDVI_mean"]


@query()
def rf_oof_probability(f):
    from ..operators import models

    rows, columns = _training(f)
    sample = labels.training_sample(rows).select("win_r", "win_c", "y")
    cv = models.cross_validate(rows.join(sample, ["win_r", "win_c"], "left"), columns, trees=20)
    return rounded(cv.scores)


@query()
def tune_grid(f):
    from ..operators import models

    rows, columns = _training(f)
    settings = {k: models.TUNING[k] for k in ("base", "plain")}
    return rounded(models.tune(rows, columns, settings, trees=5))


# --- reports, files

@query(duck("prob", "dsm", "socio") + ", v as (select 'p' layer, p::double v from prob union all select 'z', z::double from dsm union all select 'vuln', vuln::double from socio) select layer, count(*) n, count(v) n_finite, round(min(v), 6) least, round(max(v), 6) most, round(avg(v), 6) mean from v group by layer")
def layer_summary(f):
    return rounded(summary.layer_summary({"p": (f.prob, "p"), "z": (f.dsm, "z"), "vuln": (f.socio, "vuln")}))


@query(duck("edges", "polygons") + ", a as (select poly_id, sum(case when ring = 0 then a else -a end) area from (select poly_id, part, ring, abs(sum(x1*y2 - x2*y1) / 2) a from edges group by all) group by poly_id) select count(*) n, round(sum(area), 4) area, median(value) median_value from polygons left join a using (poly_id)")
def polygon_summary(f):
    return rounded(summary.polygon_summary(vectors.area(f.edges), f.polygons, "value"), area=4)


@query(duck("edges", "polypx", "prob") + "select round(avg(case when m.r is null then 0 else 1 end), 9) covered from prob p left join (select distinct r, c from polypx) m on m.r = p.r and m.c = p.c")
def covered_mean(f):
    return rounded(summary.covered_mean(f.prob, vectors.mask(f.edges, f.height, f.width)), 9)


@query(duck("polygons") + "select poly_id, name from polygons where name is not null order by poly_id limit 3")
def name_sample(f):
    return f.polygons.select("poly_id", "name").dropna(subset=["name"]).orderBy("poly_id").limit(3)


@query(duck("prob", "comp", "blobs") + "select row_number() over (order by blob_id) - 1 as idx, blob_id, n_px * 0.5::double area_ha from blobs where n_px * 0.5::double >= 2")
def big_objects(f):
    """Pixels count half a hectare, so that the fixture's objects reach the bound."""
    kept = objects.big(objects.sizes(_on(f), f.prob), 0.5)
    return summary.numbered(kept, "blob_id").select("idx", "blob_id", "area_ha")


@query(duck("px", "hh", "win", "wpx", "feat") + "select win_r as row, win_c as col, round(-36::double + 0.001::double * (win_c + 7.5), 4) map_x, round(-9.5::double - 0.001::double * (win_r + 7.5), 4) map_y, round(NDBI_mean, 6) similarity, round(B2_mean, 6) B2_mean, round(NDVI_mean, 6) NDVI_mean from feat")
def feature_csv_roundtrip(f):
    """Window features as they are stored, written as CSV to the shared folder and read again."""
    names = ["B2_mean", "NDVI_mean"]
    grid = GridSpec(f.width, f.height, a=0.001, c=-36.0, e=-0.001, f=-9.5)
    rows = tables.with_map_coordinates(_features(f).withColumn("similarity", F.col("NDBI_mean")), names, grid, W)
    path = f"{shared_dir(f.spark)}/features-{uuid.uuid4().hex}"
    tables.write_csv(rows, path)
    return rounded(tables.read_csv(f.spark, path, names), 6, map_x=4, map_y=4)


@query(duck("prob", "hh") + "select r, c, floor(p * 64) / 64 v, floor(255 * (floor(p * 64) / 64)) b from prob, hh where r < h")
def geotiff_roundtrip(f):
    """A score raster and its byte form, written as GeoTIFF to the shared folder, which this export needs mounted, and read again."""
    grid = GridSpec(f.width, f.height, a=0.0001, c=-36.0, e=-0.0001, f=-9.5, crs="EPSG:4326")
    rows = f.prob.where(F.col("r") < f.height).select("r", "c", (F.floor(F.col("p") * 64) / F.lit(64.0)).alias("v"))
    path = f"{shared_dir(f.spark).removeprefix('file://')}/scores-{uuid.uuid4().hex}"
    rasters.write_raster(rows, "v", f"{path}.tif", grid)
    rasters.write_raster(rows, "v", f"{path}-bytes.tif", grid, dtype="uint8")
    layers = {"v": rasters.read_raster(f.spark, f"{path}.tif"), "b": rasters.read_raster(f.spark, f"{path}-bytes.tif")}
    return rasters.stack(layers)
