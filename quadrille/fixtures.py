"""Deterministic rasters, polygons and scores, defined alike in Spark SQL and DuckDB over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WIDTH = 50
BLOCK_ROWS = 30


def px_sql(div: str) -> str:
    return f"""select cast(o.o_orderkey {div} {WIDTH} as int) as r, cast(o.o_orderkey % {WIDTH} as int) as c,
 1+coalesce(l.q,0) as B2, 1+coalesce(l.ln,0) as B3, 1+coalesce(l.sk,0) as B4, 1+o.o_custkey as B8, 1+coalesce(l.n,0)*100 as B11, 1+coalesce(l.pk,0) as B12
 from orders o left join (select l_orderkey k, cast(sum(l_quantity) as bigint) q, cast(sum(l_linenumber) as bigint) ln,
 cast(sum(l_suppkey) as bigint) sk, count(*) n, cast(sum(l_partkey) as bigint) pk from lineitem group by l_orderkey) l on l.k = o.o_orderkey"""


def dsm_sql(div: str) -> str:
    return f"select cast(o_orderkey {div} {WIDTH} as int) r, cast(o_orderkey % {WIDTH} as int) c, case when o_orderpriority <> '5-LOW' then o_totalprice/1000 end z from orders"


def socio_sql(div: str) -> str:
    return f"""select r, c, case when c < 25 and v <= 1 then v end vuln from (select cast(o_orderkey {div} {WIDTH} as int) r, cast(o_orderkey % {WIDTH} as int) c,
 case when o_orderkey = 7 then cast(1.5 as double) else (o_custkey % 101)/cast(100 as double) end v from orders)"""


def cls_sql(div: str) -> str:
    return f"select cast(o_orderkey {div} {WIDTH} as int) r, cast(o_orderkey % {WIDTH} as int) c, cast(1 + o_orderkey % 7 as int) cls from orders"


def prob_sql(div: str) -> str:
    return f"select cast(o_orderkey {div} {WIDTH} as int) r, cast(o_orderkey % {WIDTH} as int) c, (o_custkey*7919 % 1000)/cast(1000 as double) p from orders"


SCORES_SQL = "select event_id id, case when event_type = 'purchase' then 1 else 0 end y, round(value)/cast(500 as double) s from events"

#: Rings of one block of 30 rows and 50 columns, in pixel space; vertices lie at quarters, so no pixel centre lies on an edge.
SHAPES: dict[int, list[list[list[tuple[float, float]]]]] = {
    1: [[[(2.25, 2.25), (9.75, 2.25), (9.75, 9.75), (2.25, 9.75)]]],
    2: [[[(12.25, 2.25), (22.75, 4.25), (14.75, 12.75)]]],
    3: [[[(26.25, 2.25), (34.75, 2.25), (34.75, 5.75), (30.25, 5.75), (30.25, 12.75), (26.25, 12.75)]]],
    4: [[[(37.25, 2.25), (47.75, 2.25), (47.75, 13.75), (37.25, 13.75)], [(40.25, 5.25), (40.25, 9.75), (44.75, 9.75), (44.75, 5.25)]]],
    5: [[[(2.25, 16.25), (8.75, 16.25), (8.75, 22.75), (2.25, 22.75)]], [[(12.25, 18.25), (18.75, 18.25), (18.75, 26.75), (12.25, 26.75)]]],
    6: [[[(24.75, 20.75), (25.25, 20.75), (25.25, 21.25), (24.75, 21.25)]]],
}
TOWNS = ("Centre", "North", "South", "Elsewhere")


def edge_rows() -> list[tuple[int, int, int, int, float, float, float, float]]:
    out = []
    for k, parts in SHAPES.items():
        for p, rings in enumerate(parts):
            for g, ring in enumerate(rings):
                for s, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True)):
                    out.append((k, p, g, s, *a, *b))
    return out


def edges_sql(div: str) -> str:
    values = ", ".join(f"({k},{p},{g},{s},cast({x1} as double),cast({y1} as double),cast({x2} as double),cast({y2} as double))" for k, p, g, s, x1, y1, x2, y2 in edge_rows())
    return f"""select cast(b.block*10+k as bigint) poly_id, part, ring, seq, x1, y1+{BLOCK_ROWS}*b.block y1, x2, y2+{BLOCK_ROWS}*b.block y2
 from (values {values}) t(k,part,ring,seq,x1,y1,x2,y2) cross join (select distinct o_orderkey {div} {WIDTH * BLOCK_ROWS} block from orders) b"""


def poly_sql(div: str) -> str:
    towns = " ".join(f"when {k} then '{t}'" for k, t in enumerate(TOWNS))
    return f"select distinct poly_id, concat('P', cast(poly_id as varchar(20))) name, case poly_id % 4 {towns} end town, cast(poly_id % 37 + 1 as double) / 4 value from (select b.block*10+k poly_id from (values (1),(2),(3),(4),(5),(6)) t(k) cross join (select distinct o_orderkey {div} {WIDTH * BLOCK_ROWS} block from orders) b) q"


#: The rule for names costs a name that was right its accents.
NAMES_ROWS = [(1, "Maceió", "Macei"), (2, "Maceió".encode().decode("latin-1"), "Maceió"), (3, "plain", "plain"), (4, None, None), (5, "São".encode().decode("latin-1"), "São")]
NAMES_SQL = "select * from (values " + ", ".join("({}, {})".format(i, "cast(null as varchar(9))" if a is None else f"'{a}'") for i, a, _ in NAMES_ROWS) + ") t(id, raw)"


class Fixtures:
    """The same tables in Spark."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        for t in ("orders", "lineitem", "events", "embeddings"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        self.height = spark.table("orders").count() // WIDTH
        self.width = WIDTH

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    px = property(lambda self: self.sql(px_sql("div")))
    dsm = property(lambda self: self.sql(dsm_sql("div")))
    socio = property(lambda self: self.sql(socio_sql("div")))
    cls = property(lambda self: self.sql(cls_sql("div")))
    prob = property(lambda self: self.sql(prob_sql("div")))
    scores = property(lambda self: self.sql(SCORES_SQL))
    edges = property(lambda self: self.sql(edges_sql("div")))
    polygons = property(lambda self: self.sql(poly_sql("div")))
    names = property(lambda self: self.sql(NAMES_SQL))


def duck_view(name: str) -> str:
    """``name as (...)`` of a common table expression in DuckDB."""
    sql = {"px": px_sql, "dsm": dsm_sql, "socio": socio_sql, "cls": cls_sql, "prob": prob_sql, "edges": edges_sql, "polygons": poly_sql}
    return f"{name} as ({sql[name]('//') if name in sql else SCORES_SQL})"
