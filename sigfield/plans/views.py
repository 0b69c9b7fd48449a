"""Survey-like relations projected from the driver's tables, for Spark and as SQL text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigfield.operators.graph import by_groups
from sigfield.runtime import ship

WIDTH, HEIGHT, PX_PER_M = 1000.0, 600.0, 20.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(
        "event_id row_idx", "event_id*7919%10000/cast(10 as double) x", "event_id*104729%6000/cast(10 as double) y",
        "case user_id%3 when 0 then '24ghz' when 1 then '5ghz' else '6ghz' end band", "least(value, cast(75 as double)) - 95 rssi",
        "concat('M', user_id%12) mac", "case when event_type='error' then '' else event_type end ssid",
    )


def aps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").selectExpr("s_suppkey ap_id", "cast(s_suppkey*613%1000 as double) ax", "cast(s_suppkey*389%600 as double) ay", "cast(s_suppkey%13 as double) gain", "cast(-15-s_suppkey%40 as double) signal")


def walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    material = "element_at(array('drywall','glass','wood','brick','concrete'), n_regionkey+1)"
    return _table(spark, sf_dir, "nation").selectExpr("n_nationkey wall_id", "cast(n_nationkey*37%1000 as double) x0", "cast(n_nationkey*53%600 as double) y0", "cast(n_nationkey*37%1000+120 as double) x1", "cast(n_nationkey*53%600+n_nationkey%7*15 as double) y1", f"{material} material")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as points with a column for each band, some of them incomplete or off the plan."""
    return readings(spark, sf_dir).selectExpr(
        "row_idx", "concat('P', row_idx) point_id", "case when row_idx%97=0 then null when row_idx%89=0 then cast('NaN' as double) else x end x", "y",
        "case when row_idx%4=3 then null when row_idx%101=0 then rssi-40 else rssi end rssi_24ghz", "case when row_idx%6=3 then null else rssi+3 end rssi_5ghz", "case when row_idx%7=0 then rssi-2 end rssi_6ghz",
        "(x+y)/40 distance_m", "case when row_idx%3=0 then x/20 end csv_distance_m", "case row_idx%3 when 0 then 'csv' when 1 then 'manual' else 'detected' end source",
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans to calibrate: by hand, or from two points a known distance apart."""
    return _table(spark, sf_dir, "part").selectExpr(
        "p_partkey site", "case when p_partkey%3=0 then 'manual' else 'two-point' end mode", "cast(p_partkey%41-2 as double)*30 manual_px_per_m",
        "cast(p_partkey%50 as double) ax", "cast(p_partkey%30 as double) ay", "cast(p_partkey%50+p_partkey%7*12 as double) bx", "cast(p_partkey%30+p_partkey%5*9 as double) by_", "cast(p_partkey%11-1 as double) known_m",
        "cast(p_partkey%13 as double) ox", "cast(p_partkey%17 as double) oy", "cast(400+p_size*80 as double) width", "cast(300+p_partkey%60*50 as double) height",
        "case when p_partkey%4<>0 then cast(10+p_size as double) end width_m", "case when p_partkey%5<>0 then cast(8+p_partkey%40 as double) end height_m",
        "cast(p_partkey%60*1000000 as bigint) length", "element_at(array('image/png','image/jpeg','application/pdf','image/webp','image/svg+xml',null), cast(p_partkey%6+1 as int)) mime", "p_name name",
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of 40 pixels' width, as rows (gx, gy, r, g, b)."""
    return _table(spark, sf_dir, "part").selectExpr("cast(p_partkey%40 as int) gx", "cast(p_partkey div 40 as int) gy", "cast(p_partkey*37%256 as int) r", "cast(p_partkey*p_size%256 as int) g", "cast((p_partkey div 40)*11%256 as int) b")


#: Size of a drawn plan, and its strokes: twenty parts draw one plan, later ones over earlier ones.
DRAWN = (160, 120)
_STROKES = """s AS (SELECT k, plan, n, d, CASE n WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 156-2-plan%3 WHEN 19 THEN 0 ELSE 6+k*37%130 END AS x0, CASE n WHEN 0 THEN 6 WHEN 1 THEN 112-plan%3 WHEN 2 THEN 6 WHEN 3 THEN 6 WHEN 19 THEN 0 ELSE 8+k*53%96 END AS y0,
 CASE WHEN n=19 THEN CASE WHEN plan%3=0 THEN 160 ELSE 0 END WHEN n<2 THEN 152 WHEN n<4 THEN 2+plan%3 WHEN n<10 THEN CASE WHEN n%2=0 THEN 40+d*2 ELSE 2+d%5 END WHEN n<16 THEN CASE WHEN n%2=0 THEN 18+d%14 ELSE 2 END ELSE 1 END AS w,
 CASE WHEN n=19 THEN 1 WHEN n<2 THEN 2+plan%3 WHEN n<4 THEN 108 WHEN n<10 THEN CASE WHEN n%2=0 THEN 2+d%5 ELSE 30+d*2 END WHEN n<16 THEN CASE WHEN n%2=0 THEN 2 ELSE 18+d%14 END ELSE 1 END AS h FROM k)"""
_PAINT = """CASE WHEN n=19 THEN 235 WHEN n<4 OR d%4=0 THEN 40 WHEN d%4=1 THEN 60 WHEN d%4=2 THEN 200 ELSE 150 END AS r, CASE WHEN n=19 THEN 240 WHEN n<4 OR d%4=0 THEN 40 WHEN d%4=1 THEN 120 WHEN d%4=2 THEN 80 ELSE 100 END AS g, CASE WHEN n=19 THEN 250 WHEN n<4 OR d%4=0 THEN 40 WHEN d%4=1 THEN 220 WHEN d%4=2 THEN 40 ELSE 60 END AS b, CASE WHEN d%10=0 AND n>9 THEN 20 ELSE 255 END AS a"""


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of plans, as opaque or nearly transparent pixels (plan, gx, gy, r, g, b, a): outer and inner walls,
    shorter strokes and dots."""
    return _pixels_of(drawing_runs(spark, sf_dir))


def drawn_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr("(p_partkey-1) div 20 plan", f"{DRAWN[0]} width", f"{DRAWN[1]} height").distinct()


#: Rectangles of a painted plan: rooms of colour, white pockets in them, walls (closed, too wide or open), red and
#: blue marks. Later ones lie over earlier ones.
_RECTANGLES = """s AS (SELECT k, plan, n, d, CASE WHEN n<4 THEN 10+n%2*56+plan%5 WHEN n<8 THEN 20+n%2*56+d%20 WHEN n=11 THEN CASE plan%3 WHEN 0 THEN 154-plan%2 ELSE 110 END WHEN n<12 THEN CASE plan%3 WHEN 0 THEN 3 ELSE 6 END WHEN n=12 THEN 40+d%30 WHEN n=13 THEN 6 WHEN n<17 THEN 16+(n-14)*34+d%9 WHEN n=17 THEN 12 WHEN n=18 THEN 120+d%20 ELSE 20+d END AS x0,
 CASE WHEN n<4 THEN 10+n//2*48 WHEN n<8 THEN 18+(n-4)//2*48+d%16 WHEN n=9 THEN CASE plan%3 WHEN 0 THEN 114 ELSE 104 END WHEN n<12 THEN CASE plan%3 WHEN 0 THEN 3 ELSE 6 END WHEN n=12 THEN 6 WHEN n=13 THEN 40+d%25 WHEN n<17 THEN 20+d%60 WHEN n=17 THEN 30 WHEN n=18 THEN 112 ELSE 70 END AS y0,
 CASE WHEN n<4 THEN 52 WHEN n<8 THEN 3+d%9 WHEN n<10 THEN CASE plan%3 WHEN 0 THEN 154 ELSE 108 END WHEN n<12 THEN 2+plan%2*2 WHEN n=12 THEN 3 WHEN n=13 THEN 100 WHEN n<17 THEN 7+d%3 WHEN n=17 THEN 90 WHEN n=18 THEN 2+d%3 ELSE 12 END AS w,
 CASE WHEN n<4 THEN 44 WHEN n<8 THEN 3+d%7 WHEN n<10 THEN 2+plan%2*2 WHEN n=11 AND plan%3=2 THEN 60 WHEN n<12 THEN CASE plan%3 WHEN 0 THEN 114 ELSE 100 END WHEN n=12 THEN 98 WHEN n=13 THEN 3 WHEN n<17 THEN 7+d%2 WHEN n=17 THEN 2 WHEN n=18 THEN 2 ELSE 14 END AS h FROM k WHERE n < 20)"""
_COLOURS = """CASE WHEN n<4 THEN CASE plan%2 WHEN 1 THEN 242 ELSE 180+d%4*15 END WHEN n<8 THEN 250 WHEN n<14 THEN 30 WHEN n<18 THEN 220 WHEN n=18 THEN 40 ELSE 60 END AS r, CASE WHEN n<4 THEN CASE plan%2 WHEN 1 THEN 228 ELSE 160+n*20 END WHEN n<8 THEN 250 WHEN n<14 THEN 30 WHEN n<18 THEN 30 WHEN n=18 THEN 40 ELSE 100 END AS g, CASE WHEN n<4 THEN CASE plan%2 WHEN 1 THEN 234 ELSE 140 END WHEN n<8 THEN 250 WHEN n<14 THEN 30 WHEN n<18 THEN 40 WHEN n=18 THEN 40 ELSE 210 END AS b, 255 AS a"""


def _painted_runs(spark: SparkSession, sf_dir: str, each: int, shapes: str, colours: str) -> DataFrame:
    """Runs of equal pixels (plan, gy, x0, x1, r, g, b, a) that parts paint, ``each`` of them on one plan.

    Strokes are dealt by plan to as many tasks as the parts need; a task lays the few strokes of its plans over one another and
    gives only runs, so that nothing is made or moved pixel by pixel."""
    ship(spark)
    parts = _table(spark, sf_dir, "part").selectExpr("p_partkey k", f"(p_partkey-1) div {each} plan", f"(p_partkey-1)%{each} n", "p_size d")
    strokes = spark.sql("WITH k AS (SELECT * FROM {parts}), " + shapes.replace("//", " div ") + " SELECT *, " + colours + " FROM s WHERE w > 0", parts=parts)
    paint = sum((F.shiftleft(F.col(c).cast("long"), k) for c, k in (("n", 32), ("r", 24), ("g", 16), ("b", 8))), F.col("a").cast("long"))
    boxes = strokes.selectExpr("plan", "cast(greatest(x0, 0) as int) x0", "cast(greatest(y0, 0) as int) y0", "cast(greatest(x0+w, 0) as int) x1", "cast(greatest(y0+h, 0) as int) y1", "n", "r", "g", "b", "a").select("plan", "x0", "y0", "x1", "y1", paint.alias("p"))
    dealt = boxes.repartition(max(8, -(-parts.count() // 4000)), "plan").sortWithinPartitions("plan", "p")
    return dealt.mapInPandas(_laid, "plan bigint, gy int, x0 int, x1 int, r int, g int, b int, a int")


def _laid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of plans whose boxes (plan, x0, y0, x1, y1, p) come plan by plan, lower ones first; p holds the colour in its
    lower 32 bits."""
    width, height = DRAWN
    for t in by_groups(batches, ["plan"]):
        names, plan = np.unique(t["plan"].to_numpy(), return_inverse=True)
        image = np.full((len(names), height, width), -1, np.int64)
        for k, x0, y0, x1, y1, p in zip(plan, t["x0"], t["y0"], t["x1"], t["y1"], t["p"].to_numpy() & 0xFFFFFFFF):
            image[k, y0:y1, x0:x1] = p
        lines = image.reshape(-1, width)
        begins = np.ones(lines.shape, bool)
        begins[:, 1:] = lines[:, 1:] != lines[:, :-1]
        first = np.flatnonzero(begins)
        n, p = np.diff(first, append=lines.size), lines.ravel()[first]
        first, n, p = first[p >= 0], n[p >= 0], p[p >= 0]
        line, x0 = np.divmod(first, width)
        out = {"gy": line % height, "x0": x0, "x1": x0 + n - 1, **{c: p >> k & 255 for c, k in (("r", 24), ("g", 16), ("b", 8), ("a", 0))}}
        yield pd.DataFrame({"plan": names[line // height], **{c: v.astype(np.int32) for c, v in out.items()}})


def _pixels_of(runs: DataFrame) -> DataFrame:
    return runs.select("plan", F.explode(F.sequence("x0", "x1")).alias("gx"), "gy", "r", "g", "b", "a")


def drawing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawings as runs of equal pixels (plan, gy, x0, x1, r, g, b, a)."""
    return _painted_runs(spark, sf_dir, 20, _STROKES, _PAINT)


def painting_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paintings as runs of equal pixels (plan, gy, x0, x1, r, g, b, a)."""
    return _painted_runs(spark, sf_dir, 40, _RECTANGLES, _COLOURS)


def paintings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of plans with coloured rooms and marks (plan, gx, gy, r, g, b, a)."""
    return _pixels_of(painting_runs(spark, sf_dir))


def painted_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr("(p_partkey-1) div 40 plan", f"{DRAWN[0]} width", f"{DRAWN[1]} height").distinct()


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: f"named_struct('x', cast(r_regionkey*200+{x} as double), 'y', cast({y} as double))"
    return _table(spark, sf_dir, "region").selectExpr("r_regionkey room_id", "r_name name", f"array({corner(5, 40)}, {corner(195, 40)}, {corner(195, 560)}, {corner(5, 560)}) polygon")


def grid(spark: SparkSession, width: float = WIDTH, height: float = HEIGHT, step: int = 20) -> DataFrame:
    """Cell centres of the plan grid."""
    nx, ny = int(-(-width // step)), int(-(-height // step))
    return spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("gx"), F.floor(F.col("id") / nx).cast("int").alias("gy")).select("gx", "gy", F.least(F.lit(width - 1), F.col("gx") * float(step) + step / 2).alias("tx"), F.least(F.lit(height - 1), F.col("gy") * float(step) + step / 2).alias("ty"))


SQL = {
    "readings": """readings AS (SELECT event_id AS row_idx, event_id*7919%10000/CAST(10 AS DOUBLE) AS x, event_id*104729%6000/CAST(10 AS DOUBLE) AS y,
 CASE user_id%3 WHEN 0 THEN '24ghz' WHEN 1 THEN '5ghz' ELSE '6ghz' END AS band, least(value, CAST(75 AS DOUBLE)) - 95 AS rssi,
 'M' || (user_id%12) AS mac, CASE WHEN event_type='error' THEN '' ELSE event_type END AS ssid FROM events)""",
    "aps": "aps AS (SELECT s_suppkey AS ap_id, CAST(s_suppkey*613%1000 AS DOUBLE) AS ax, CAST(s_suppkey*389%600 AS DOUBLE) AS ay, CAST(s_suppkey%13 AS DOUBLE) AS gain, CAST(-15-s_suppkey%40 AS DOUBLE) AS signal FROM supplier)",
    "walls": """walls AS (SELECT n_nationkey AS wall_id, CAST(n_nationkey*37%1000 AS DOUBLE) AS x0, CAST(n_nationkey*53%600 AS DOUBLE) AS y0, CAST(n_nationkey*37%1000+120 AS DOUBLE) AS x1,
 CAST(n_nationkey*53%600+n_nationkey%7*15 AS DOUBLE) AS y1, (['drywall','glass','wood','brick','concrete'])[n_regionkey+1] AS material FROM nation)""",
    "rooms": "rooms AS (SELECT r_regionkey AS room_id, r_name AS name, CAST(r_regionkey*200+5 AS DOUBLE) AS rx0, CAST(r_regionkey*200+195 AS DOUBLE) AS rx1, 40.0::DOUBLE AS ry0, 560.0::DOUBLE AS ry1 FROM region)",
    "grid": "grid AS (SELECT CAST(id%50 AS INT) AS gx, CAST(id//50 AS INT) AS gy, (id%50)*20.0::DOUBLE+10 AS tx, (id//50)*20.0::DOUBLE+10 AS ty FROM range(1500) r(id))",
    "points": """points AS (SELECT row_idx, 'P' || row_idx AS point_id, CASE WHEN row_idx%97=0 THEN NULL WHEN row_idx%89=0 THEN 'NaN'::DOUBLE ELSE x END AS x, y,
 CASE WHEN row_idx%4=3 THEN NULL WHEN row_idx%101=0 THEN rssi-40 ELSE rssi END AS rssi_24ghz, CASE WHEN row_idx%6=3 THEN NULL ELSE rssi+3 END AS rssi_5ghz, CASE WHEN row_idx%7=0 THEN rssi-2 END AS rssi_6ghz,
 (x+y)/40 AS distance_m, CASE WHEN row_idx%3=0 THEN x/20 END AS csv_distance_m, CASE row_idx%3 WHEN 0 THEN 'csv' WHEN 1 THEN 'manual' ELSE 'detected' END AS source FROM readings)""",
    "plans": """plans AS (SELECT p_partkey AS site, CASE WHEN p_partkey%3=0 THEN 'manual' ELSE 'two-point' END AS mode, CAST(p_partkey%41-2 AS DOUBLE)*30 AS manual_px_per_m,
 CAST(p_partkey%50 AS DOUBLE) AS ax, CAST(p_partkey%30 AS DOUBLE) AS ay, CAST(p_partkey%50+p_partkey%7*12 AS DOUBLE) AS bx, CAST(p_partkey%30+p_partkey%5*9 AS DOUBLE) AS by_, CAST(p_partkey%11-1 AS DOUBLE) AS known_m,
 CAST(p_partkey%13 AS DOUBLE) AS ox, CAST(p_partkey%17 AS DOUBLE) AS oy, CAST(400+p_size*80 AS DOUBLE) AS width, CAST(300+p_partkey%60*50 AS DOUBLE) AS height,
 CASE WHEN p_partkey%4<>0 THEN CAST(10+p_size AS DOUBLE) END AS width_m, CASE WHEN p_partkey%5<>0 THEN CAST(8+p_partkey%40 AS DOUBLE) END AS height_m,
 CAST(p_partkey%60*1000000 AS BIGINT) AS length, (['image/png','image/jpeg','application/pdf','image/webp','image/svg+xml',NULL])[p_partkey%6+1] AS mime, p_name AS name FROM part)""",
    "pixels": """pixels AS (SELECT CAST(p_partkey%40 AS INT) AS gx, CAST(p_partkey//40 AS INT) AS gy, CAST(p_partkey*37%256 AS INT) AS r, CAST(p_partkey*p_size%256 AS INT) AS g, CAST(p_partkey//40*11%256 AS INT) AS b FROM part)""",
    "drawings": f"""k AS (SELECT p_partkey AS k, (p_partkey-1)//20 AS plan, (p_partkey-1)%20 AS n, p_size AS d FROM part), {_STROKES},
drawings AS (SELECT plan, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, arg_max(r, k) AS r, arg_max(g, k) AS g, arg_max(b, k) AS b, arg_max(a, k) AS a FROM (SELECT k, plan, x.i AS gx, y.i AS gy, {_PAINT} FROM s, range({DRAWN[0]}) x(i), range({DRAWN[1]}) y(i) WHERE w > 0 AND x.i >= x0 AND x.i < x0+w AND y.i >= y0 AND y.i < y0+h) GROUP BY plan, gx, gy)""",
    "paintings": f"""k AS (SELECT p_partkey AS k, (p_partkey-1)//40 AS plan, (p_partkey-1)%40 AS n, p_size AS d FROM part), {_RECTANGLES},
paintings AS (SELECT plan, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, arg_max(r, k) AS r, arg_max(g, k) AS g, arg_max(b, k) AS b, arg_max(a, k) AS a FROM (SELECT k, plan, x.i AS gx, y.i AS gy, {_COLOURS} FROM s, range({DRAWN[0]}) x(i), range({DRAWN[1]}) y(i) WHERE x.i >= x0 AND x.i < x0+w AND y.i >= y0 AND y.i < y0+h) GROUP BY plan, gx, gy)""",
    "bins": """bins AS (SELECT CAST(floor(x/32+0.5) AS BIGINT) AS bx, CAST(floor(y/32+0.5) AS BIGINT) AS by_, band, min(row_idx) AS first_idx, count(*) AS n,
 floor(CAST(sum(CAST(x AS DECIMAL(28,6))) AS DOUBLE)/count(x)*100+0.5)/100 AS x, floor(CAST(sum(CAST(y AS DECIMAL(28,6))) AS DOUBLE)/count(y)*100+0.5)/100 AS y, max(rssi) AS rssi FROM readings GROUP BY ALL)""",
}


def with_views(*names: str) -> str:
    """The WITH clause that defines the named views."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"


#: Corners of the hull of each band's ``bins``: a stack for each half, that pops while the turn is not to the left.
HULL_SQL = """hp AS (SELECT band, 1 AS side, x, y, row_number() OVER (PARTITION BY band ORDER BY x, y) AS k, count(*) OVER (PARTITION BY band) AS n FROM bins UNION ALL SELECT band, 2, x, y, row_number() OVER (PARTITION BY band ORDER BY x DESC, y DESC), count(*) OVER (PARTITION BY band) FROM bins),
hs AS (SELECT band, side, k, n, [{'x': x, 'y': y}] AS m FROM hp WHERE k = 1 UNION ALL SELECT band, side, CASE WHEN pop THEN k ELSE k+1 END, n, CASE WHEN pop THEN m[:len(m)-1] ELSE list_append(m, p) END
FROM (SELECT s.band, s.side, s.k, s.n, s.m, {'x': q.x, 'y': q.y} AS p, len(m) > 1 AND (m[-1].x-m[-2].x)*(q.y-m[-2].y)-(m[-1].y-m[-2].y)*(q.x-m[-2].x) <= 0 AS pop FROM hs s JOIN hp q ON q.band=s.band AND q.side=s.side AND q.k=s.k+1)),
ht AS (SELECT band, side, m FROM hs WHERE k = n QUALIFY row_number() OVER (PARTITION BY band, side ORDER BY len(m)) = 1),
hull AS MATERIALIZED (SELECT band, row_number() OVER (PARTITION BY band ORDER BY side, j)-1 AS i, c.x AS x, c.y AS y FROM (SELECT band, side, unnest(m[:len(m)-1]) AS c, generate_subscripts(m[:len(m)-1], 1) AS j FROM ht))"""
