"""All registered queries of the survey operators, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigfield.functions import geometry as G
from sigfield.functions import rf, scores
from sigfield.functions import scalars as S
from sigfield.operators import coverage, ingest, interpolate, place, raster, rules, spatial
from sigfield.plans import drawings as _drawings  # noqa: F401  registers its queries
from sigfield.plans import layers as _layers  # noqa: F401
from sigfield.plans import points as _points  # noqa: F401
from sigfield.plans import radio as _radio  # noqa: F401
from sigfield.plans import rasters as _rasters  # noqa: F401
from sigfield.plans import regions as _regions  # noqa: F401
from sigfield.plans import surveys as _surveys  # noqa: F401
from sigfield.plans import views as V
from sigfield.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from sigfield.plans.views import with_views
from sigfield.runtime import spread
from sigfield.sources import sinks

def _bins(spark: SparkSession, d: str) -> DataFrame:
    return place.consolidate(V.readings(spark, d), V.WIDTH, V.HEIGHT, place.GENERATION_BINS, ["band"])


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


IDW = with_views("readings", "bins", "grid")[:-1] + """,
pairs AS (SELECT b.band, g.gx, g.gy, b.rssi, sqrt((b.x-g.tx)*(b.x-g.tx)+(b.y-g.ty)*(b.y-g.ty)) AS d, b.first_idx FROM bins b CROSS JOIN grid g),
cells AS (SELECT band, gx, gy, coalesce(arg_min(rssi, first_idx) FILTER (d <= 1e-9), sum(CASE WHEN d > 1e-9 THEN rssi/pow(d, 2.2) END)/sum(CASE WHEN d > 1e-9 THEN 1/pow(d, 2.2) END)) AS rssi FROM pairs GROUP BY ALL)
"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return interpolate.idw_grid(_bins(spark, d), V.grid(spark), ["band"])


@query(IDW + "SELECT band, gx, gy, round(rssi, 6) AS rssi FROM cells")
def idw_grid(spark, d):
    return _cells(spark, d).select("band", "gx", "gy", F.round("rssi", 6).alias("rssi"))


@query(with_views("readings", "bins") + "SELECT band, bx, by_, first_idx, n, x, y, rssi, 'P' || row_number() OVER (PARTITION BY band ORDER BY first_idx) AS point_id FROM bins")
def consolidate_grid(spark, d):
    return _bins(spark, d)


LAYER = """layer AS (SELECT band, count(*) AS n_cells, round(min(rssi),1) AS min_rssi, round(max(rssi),1) AS max_rssi,
 round(CAST(sum(CAST(rssi AS DECIMAL(28,6))) AS DOUBLE)/count(rssi),1) AS avg_rssi, round(count(*) FILTER (rssi >= -67)*CAST(100 AS DOUBLE)/count(*),1) AS coverage_pct,
 round(count(*) FILTER (rssi <= -85)*CAST(100 AS DOUBLE)/count(*),1) AS dead_pct FROM {} GROUP BY band)"""


@query(with_views("readings") [:-1] + ",\n" + LAYER.format("readings") + " SELECT * FROM layer")
def layer_stats(spark, d):
    return coverage.layer_stats(V.readings(spark, d), ["band"])


@query(with_views("readings")[:-1] + ",\n" + LAYER.format("readings") + " SELECT '6ghz' AS band, n_cells, round(min_rssi-4.5,1) AS min_rssi, round(max_rssi-4.5,1) AS max_rssi, round(avg_rssi-4.5,1) AS avg_rssi, coverage_pct, dead_pct FROM layer WHERE band='5ghz'")
def derive_6ghz(spark, d):
    return interpolate.derive_6ghz(coverage.layer_stats(V.readings(spark, d), ["band"]))


@query(with_views("readings", "aps")[:-1] + """, best AS (SELECT row_idx, min({'d': sqrt((ax-x)*(ax-x)+(ay-y)*(ay-y)), 'ap': ap_id}) AS b FROM readings CROSS JOIN aps GROUP BY row_idx)
SELECT row_idx, b.ap AS ap_id, round(b.d/20, 2) AS distance_m FROM best""")
def nearest_ap(spark, d):
    return spatial.nearest_ap(V.readings(spark, d), V.aps(spark, d), V.PX_PER_M)


@query(with_views("readings") + """, stats AS (SELECT band, mac, count(*) AS n, max(ssid <> '') AS has_ssid, min(row_idx) AS f FROM readings GROUP BY ALL)
SELECT band, mac, n, has_ssid FROM stats QUALIFY row_number() OVER (PARTITION BY band ORDER BY has_ssid DESC, n DESC, f) = 1""")
def dominant_mac(spark, d):
    return ingest.dominant_mac(V.readings(spark, d))


@query(with_views("readings") + "SELECT band, max_by(row_idx, {'v': rssi, 'i': -row_idx}) AS best_idx, max(rssi) AS best_rssi, min_by(row_idx, {'v': rssi, 'i': row_idx}) AS worst_idx, min(rssi) AS worst_rssi, round(CAST(sum(CAST(rssi AS DECIMAL(28,6))) AS DOUBLE)/count(rssi), 4) AS avg_rssi FROM readings GROUP BY band")
def best_worst_point(spark, d):
    return coverage.best_and_worst(V.readings(spark, d), ["band"])


RANKS = """, s AS (SELECT band, list_sort(list(rssi)) AS l, count(*) AS n FROM readings GROUP BY band)"""


@query(with_views("readings") + RANKS + " SELECT band, l[CAST(floor((n-1)*0.01+0.5) AS INT)+1] AS p01, l[CAST(floor((n-1)*0.5+0.5) AS INT)+1] AS p50, l[CAST(floor((n-1)*0.99+0.5) AS INT)+1] AS p99, n FROM s")
def nearest_rank_pct(spark, d):
    return place.nearest_rank(V.readings(spark, d), "rssi", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, ["band"])


@query(with_views("readings") + RANKS + """, m AS (SELECT band, l[CAST(floor((n-1)*0.5+0.5) AS INT)+1] AS median FROM s),
o AS (SELECT band, list_sort(list(abs(rssi-median))) AS l, count(*) AS n FROM readings JOIN m USING (band) GROUP BY band)
SELECT band, median, l[CAST(floor((n-1)*0.5+0.5) AS INT)+1] AS mad, n FROM o JOIN m USING (band)""")
def mad_outliers(spark, d):
    return place.median_and_mad(V.readings(spark, d), "rssi", ["band"])


@query(with_views("readings") + """, r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY row_idx)-1 AS i, count(*) OVER (PARTITION BY band) AS n FROM readings),
k AS (SELECT DISTINCT band, CAST(floor(k*(n-1)/CAST(99 AS DOUBLE)+0.5) AS BIGINT) AS i FROM (SELECT DISTINCT band, n FROM r), range(100) t(k))
SELECT row_idx, x, y, band, rssi, mac, ssid FROM r WHERE n <= 100 OR (band, i) IN (SELECT (band, i) FROM k)""")
def even_sample(spark, d):
    return place.even_sample(V.readings(spark, d), "row_idx", 100, ["band"])


@query(with_views("readings") + "SELECT row_idx, floor((CAST(24 AS DOUBLE)+x*20)*100+0.5)/100 AS px, least(greatest(x/1000*(600-48)+24, 24), 576) AS fx, 0.0::DOUBLE AS lo FROM readings")
def place_metric(spark, d):
    pad = place.place_metric(F.col("x"), F.lit(0.0), 20.0)
    return V.readings(spark, d).select("row_idx", S.round_half_up(pad, 2).alias("px"), S.clamp(F.col("x") / 1000 * (600 - 48) + 24, 24, 576).alias("fx"), F.lit(0.0).alias("lo"))


@query(with_views("readings") + ", b AS (SELECT band, round(x, -1) AS x, y FROM readings) SELECT band, CAST(floor(avg(CASE WHEN x < 0 OR y < 0 OR x >= 900 OR y >= 500 THEN 1 ELSE 0 END)*100+0.5) AS BIGINT) AS pct, avg(CASE WHEN x < 0 OR y < 0 OR x >= 900 OR y >= 500 THEN 1 ELSE 0 END) > 0.1 AS warn FROM b GROUP BY band")
def out_of_bounds(spark, d):
    return place.out_of_bounds_pct(V.readings(spark, d).withColumn("x", F.round("x", -1)), 900, 500, ["band"])  # some lie on the edge


_OUTSIDE = """, i AS (SELECT row_idx AS point_id, CASE WHEN NOT coalesce(isfinite(x) AND isfinite(y), FALSE) THEN 'point_coordinates' WHEN x < 0 OR y < 0 OR x >= 900 OR y >= 500 THEN 'point_inside' END AS code FROM points)"""


@query(with_views("readings", "points") + _OUTSIDE + " SELECT point_id, 'error' AS severity, code FROM i WHERE code IS NOT NULL")
def validate_points(spark, d):
    return rules.point_issues(V.points(spark, d), 900, 500)


@query(with_views("readings", "points") + _OUTSIDE + " SELECT point_id, 'error' AS severity, code, CAST(row_number() OVER (PARTITION BY code ORDER BY point_id) AS INT) AS place FROM i WHERE code IS NOT NULL QUALIFY place <= 160")
def issue_caps(spark, d):
    return rules.capped(rules.point_issues(V.points(spark, d), 900, 500), 160, ["code"], "point_id")


@query(with_views("readings", "bins") + """, p AS (SELECT band, first_idx AS row_idx, x, y FROM bins)
SELECT a.band, a.row_idx AS i, b.row_idx AS j, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) AS distance_px FROM p a JOIN p b ON a.band = b.band AND a.row_idx < b.row_idx AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) < 30""")
def proximity_pairs(spark, d):
    points = _bins(spark, d).select("band", F.col("first_idx").alias("row_idx"), "x", "y")
    return spatial.proximity_pairs(points, 30.0, by=("band",)).withColumn("distance_px", F.round("distance_px", 6))


@query(with_views("readings", "rooms") + """, r AS (SELECT row_idx, band, x, y, rssi, min(room_id) AS room_id FROM readings JOIN rooms ON (ry0 > y) <> (ry1 > y) AND x < rx1 AND NOT x < rx0 GROUP BY ALL)
SELECT row_idx, room_id FROM r""")
def point_in_room(spark, d):
    return spatial.rooms_of_points(V.readings(spark, d), V.rooms(spark, d)).select("row_idx", "room_id")


def _mean(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(28,6))) AS DOUBLE)/count({c})"


def _half(e: str, digits: int) -> str:
    k = float(10**digits)
    return f"floor(({e})*CAST({k} AS DOUBLE)+0.5)/CAST({k} AS DOUBLE)"


_CLASS = "CASE WHEN rssi >= -50 THEN 'excellent' WHEN rssi >= -67 THEN 'good' WHEN rssi >= -75 THEN 'fair' WHEN rssi > -85 THEN 'weak' ELSE 'dead' END"
_SHARE = lambda c: f"count(*) FILTER ({c})*CAST(100 AS DOUBLE)/count(*)"


@query(with_views("readings", "rooms") + f""", r AS (SELECT row_idx, band, x, y, rssi, {_CLASS} AS c, min(room_id) AS room_id FROM readings JOIN rooms ON (ry0 > y) <> (ry1 > y) AND x < rx1 AND NOT x < rx0 GROUP BY ALL),
a AS (SELECT room_id, band, count(*) AS n, min(rssi) AS lo, max(rssi) AS hi, {_half(_mean('rssi'), 1)} AS avg_rssi, {_half(_mean('x'), 1)} AS cx, {_half(_mean('y'), 1)} AS cy, {_half(_SHARE('rssi >= -67'), 1)} AS cov, {_half(_SHARE('rssi < -75'), 1)} AS wk, {_half(_SHARE('rssi <= -85'), 1)} AS dd,
{', '.join(_half(_SHARE(f"c = '{k}'"), 1) + f' AS {k}_pct' for k in coverage.CLASSES)} FROM r GROUP BY room_id, band),
b AS (SELECT *, {_half("least(greatest((avg_rssi+90)/60*100,0),100)*CAST(0.46 AS DOUBLE)+cov*CAST(0.42 AS DOUBLE)+(100-dd)*CAST(0.12 AS DOUBLE)", 1)} AS channel_quality FROM a)
SELECT room_id, band, n, {_half("n*CAST(1 AS DOUBLE)", 2)} AS area_m2, {_half('lo', 1)} AS min_rssi, {_half('hi', 1)} AS max_rssi, avg_rssi, cx, cy, cov AS coverage_pct, dd AS dead_pct, excellent_pct, good_pct, fair_pct, weak_pct, b.dead_pct AS dead_class_pct,
CASE WHEN avg_rssi >= -45 THEN 940 WHEN avg_rssi >= -55 THEN 720 WHEN avg_rssi >= -65 THEN 420 WHEN avg_rssi >= -72 THEN 190 WHEN avg_rssi >= -80 THEN 55 ELSE 8 END AS throughput_mbps,
{_half("least(80, CASE WHEN avg_rssi >= -55 THEN 0 ELSE abs(avg_rssi+55)*CAST(0.28 AS DOUBLE) END+CAST(4.2 AS DOUBLE)+wk*CAST(0.05 AS DOUBLE)+dd*CAST(0.14 AS DOUBLE))", 1)} AS latency_ms, channel_quality,
{_half("least(100, cov*CAST(0.72 AS DOUBLE)+channel_quality*CAST(0.28 AS DOUBLE))", 1)} AS roaming FROM b""")
def room_coverage(spark, d):
    cells = spatial.rooms_of_points(V.readings(spark, d), V.rooms(spark, d))
    out = coverage.region_stats(cells, ["room_id", "band"], 20.0, V.PX_PER_M)
    names = [c if i != out.columns.index("dead_pct", out.columns.index("dead_pct") + 1) else "dead_class_pct" for i, c in enumerate(out.columns)]
    return out.toDF(*names)


@query(with_views("readings") + f"SELECT {_CLASS} AS class, band, count(*) AS n FROM readings GROUP BY ALL")
def quality_histogram(spark, d):
    return V.readings(spark, d).groupBy(scores.quality_class(F.col("rssi")).alias("class"), "band").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("readings") + "SELECT row_idx, CAST(least(greatest(floor((rssi+80)/(CAST(60 AS DOUBLE)/11)),0),10) AS INT) AS bucket FROM readings")
def legend_bucket(spark, d):
    return V.readings(spark, d).select("row_idx", scores.legend_bucket(F.col("rssi")).alias("bucket"))


_B = "least(greatest(floor((rssi+80)/(CAST(60 AS DOUBLE)/11)),0),10)"


@query(with_views("readings") + f""", b AS (SELECT row_idx, rssi, CAST(-80 AS DOUBLE)+{_B}*(CAST(60 AS DOUBLE)/11) AS lower FROM readings),
t AS (SELECT row_idx, lower, least(greatest((rssi-(lower+CAST(0.65 AS DOUBLE)))/((lower+(CAST(60 AS DOUBLE)/11)-CAST(0.65 AS DOUBLE))-(lower+CAST(0.65 AS DOUBLE))),0),1) AS t FROM b)
SELECT row_idx, round(lower+t*t*(3-2*t)*(CAST(60 AS DOUBLE)/11), 6) AS rssi FROM t""")
def contour_rssi(spark, d):
    return V.readings(spark, d).select("row_idx", F.round(scores.contour_rssi(F.col("rssi")), 6).alias("rssi"))


@query(with_views("readings", "aps") + """, p AS (SELECT row_idx, band, sqrt((x-500)*(x-500)+(y-300)*(y-300))/20 AS d FROM readings)
SELECT row_idx, round(CASE WHEN d > 0 THEN 10*CASE band WHEN '5ghz' THEN 2.12::DOUBLE WHEN '6ghz' THEN 2.34::DOUBLE ELSE 1.72::DOUBLE END*log10(d+1) ELSE 0 END, 6) AS loss_db FROM p""")
def path_loss(spark, d):
    far = F.hypot(F.col("x") - 500, F.col("y") - 300) / 20
    return V.readings(spark, d).select("row_idx", F.round(rf.distance_decay_db(far, F.col("band")), 6).alias("loss_db"))


@query(with_views("readings") + """, a AS (SELECT row_idx, abs(((x%360-y%360)%360+540)%360-180) AS dg FROM readings), t AS (SELECT row_idx, least(greatest((dg-35)/130,0),1) AS t FROM a)
SELECT row_idx, round(t*t*(3-2*t)*14, 6) AS loss_db FROM t""")
def antenna_loss(spark, d):
    return V.readings(spark, d).select("row_idx", F.round(rf.antenna_loss_db(F.lit(True), F.col("x") % 360, F.col("y") % 360), 6).alias("loss_db"))


def _rays(spark: SparkSession, d: str) -> DataFrame:
    return V.readings(spark, d).select("row_idx", "band", "x", "y", F.lit(500.0).alias("tx"), F.lit(300.0).alias("ty"))


_SEG = """, s AS (SELECT row_idx, wall_id, (x-500)*(y0-300)-(y-300)*(x0-500) AS a, (x-500)*(y1-300)-(y-300)*(x1-500) AS b, (x1-x0)*(y-y0)-(y1-y0)*(x-x0) AS c, (x1-x0)*(300-y0)-(y1-y0)*(500-x0) AS e FROM readings CROSS JOIN walls)"""


@query(with_views("readings", "walls") + _SEG + " SELECT row_idx, CAST(count(*) FILTER (sign(CASE WHEN abs(a)<1e-9 THEN 0 ELSE a END)*sign(CASE WHEN abs(b)<1e-9 THEN 0 ELSE b END) < 0 AND sign(CASE WHEN abs(c)<1e-9 THEN 0 ELSE c END)*sign(CASE WHEN abs(e)<1e-9 THEN 0 ELSE e END) < 0) AS INT) AS n_proper FROM s GROUP BY row_idx")
def wall_crossings(spark, d):
    lists, _ = spatial.listed(V.walls(spark, d), "wall_id", ["x0", "y0", "x1", "y1"], "walls")
    ray = (F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))

    def proper(w):
        a, b, c, e = ((w["x0"], w["y0"]), (w["x1"], w["y1"]), ray[:2], ray[2:])
        return (G.orientation(*c, *e, *a) * G.orientation(*c, *e, *b) < 0) & (G.orientation(*a, *b, *c) * G.orientation(*a, *b, *e) < 0)

    return _rays(spark, d).join(spatial.small(lists)).groupBy("row_idx").agg(F.sum(F.size(F.filter("walls", proper))).cast("int").alias("n_proper"))


@query(with_views("rooms") + "SELECT room_id, (rx1-rx0)*(ry1-ry0) AS area_px, (rx0+rx1)/2 AS cx, (ry0+ry1)/2 AS cy FROM rooms")
def polygon_area(spark, d):
    c = G.polygon_centroid(F.col("polygon"))
    return V.rooms(spark, d).select("room_id", G.polygon_area(F.col("polygon")).alias("area_px"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query(with_views("readings") + "SELECT row_idx, (x-50)/20 AS wx, (y-30)/20 AS wy, sqrt(((x-50)/20)*((x-50)/20)+((y-30)/20)*((y-30)/20)) > 25 AS far FROM readings")
def plan_to_world(spark, d):
    r = V.readings(spark, d).select("row_idx", G.plan_to_world(F.col("x"), 50.0, 20.0).alias("wx"), G.plan_to_world(F.col("y"), 30.0, 20.0).alias("wy"))
    return r.withColumn("far", F.hypot("wx", "wy") > 25)


@query(with_views("readings") + "SELECT row_idx, 600-y AS rx, x AS ry, 1000-x AS fx, y AS fy FROM readings")
def rotate_flip(spark, d):
    at = (F.col("x"), F.col("y"), 1000.0, 600.0)
    (rx, ry), (fx, fy) = G.transform_pixel(*at, "rotate_right"), G.transform_pixel(*at, "flip_x")
    return V.readings(spark, d).select("row_idx", rx.alias("rx"), ry.alias("ry"), fx.alias("fx"), fy.alias("fy"))


@query("SELECT event_id, CASE WHEN event_id%250 BETWEEN 1 AND 14 THEN '24ghz' WHEN event_id%250 BETWEEN 32 AND 196 THEN '5ghz' END AS band FROM events")
def band_from_channel(spark, d):
    return _table(spark, d, "events").select("event_id", S.band_from_channel(F.col("event_id") % 250).alias("band"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS dot, floor(o_totalprice) AS comma FROM orders")
def parse_number(spark, d):
    price = F.format_string("%.2f", "o_totalprice")
    grouped = F.concat(F.regexp_replace(F.format_number(F.floor("o_totalprice"), 0), ",", "."), F.lit(",00"))
    return _table(spark, d, "orders").select("o_orderkey", S.parse_number(F.concat(F.lit(" "), price, F.lit(" dBm"))).alias("dot"), S.parse_number(grouped).alias("comma"))


@query("SELECT c_custkey, 'P' || c_custkey AS point_id, c_name AS other FROM customer")
def normalize_id(spark, d):
    return _table(spark, d, "customer").select("c_custkey", S.normalize_point_id(F.concat(F.lit(" Ponto-00"), "c_custkey")).alias("point_id"), S.normalize_point_id(F.col("c_name")).alias("other"))


@query("SELECT 'p-00' || p_partkey AS key, CASE WHEN p_partkey IN (SELECT c_custkey FROM customer) THEN 'ponto ' || p_partkey END AS matched FROM part")
def alias_merge(spark, d):
    points = _table(spark, d, "part").select(F.concat(F.lit("p-00"), "p_partkey").alias("key"))
    rows = _table(spark, d, "customer").select(F.col("c_custkey").alias("row_idx"), F.concat(F.lit("ponto "), "c_custkey").alias("name"))
    return spatial.alias_join(points, rows, S.point_id_aliases, "key", "name")


#: Texts of plans: a name, a scale, an area and a size, each in some of them
_PLAN_TEXT = "concat('Planta ', p_name, CASE WHEN p_partkey%3<>0 THEN concat(' escala 1 : ', CAST(p_size*25 AS VARCHAR(9))) ELSE '' END, CASE WHEN p_partkey%4<>0 THEN concat(' area ', CAST(p_size AS VARCHAR(9)), CASE WHEN p_partkey%2=0 THEN ',5' ELSE '' END, ' M2') ELSE '' END, CASE WHEN p_partkey%5<>0 THEN concat(' ', CAST(p_partkey%1200 AS VARCHAR(9)), ',25 X 8.5 m') ELSE '' END, CASE p_partkey%6 WHEN 0 THEN ' SALA DE ESTAR, Quarto 2' WHEN 1 THEN ' Suíte; bwc' WHEN 2 THEN ' área de serviço' ELSE ' Hall' END)"
_ROOM_SQL = ", ".join(f"CASE WHEN contains(lower(t), '{w}') THEN '{w[0].upper() + w[1:]}' END" for w in S.ROOM_WORDS)
_NUMBER_SQL = "TRY_CAST(replace(nullif({}, ''), ',', '.') AS DOUBLE)"
_SIDE_SQL = [_NUMBER_SQL.format(f"regexp_extract(t, '([0-9]+[,.][0-9]+)\\s*[xX×]\\s*([0-9]+[,.][0-9]+)', {k})") for k in (1, 2)]


@query(f"""WITH p AS (SELECT p_partkey, {_PLAN_TEXT} AS t FROM part), m AS (SELECT p_partkey, '1:' || nullif(regexp_extract(t, '1\\s*[:/]\\s*([0-9]+)', 1), '') AS scale, {_NUMBER_SQL.format("regexp_extract(t, '([0-9]+[,.]?[0-9]*)\\s*[mM][²2]', 1)")} AS area, {_SIDE_SQL[0]} AS w, {_SIDE_SQL[1]} AS h,
array_to_string(list_filter([{_ROOM_SQL}], lambda r: r IS NOT NULL), ', ') AS rooms FROM p) SELECT p_partkey, scale, CASE WHEN area > 0 THEN area END AS area_m2, CASE WHEN w > 0 AND h > 0 AND w < 1000 AND h < 1000 THEN w END AS width_m, CASE WHEN w > 0 AND h > 0 AND w < 1000 AND h < 1000 THEN h END AS height_m, rooms FROM m""")
def text_measurements(spark, d):
    texts = spread(_table(spark, d, "part").select("p_partkey", F.expr(_PLAN_TEXT).alias("text")))  # made once, searched on all cores
    said = texts.select("p_partkey", S.text_measures(F.col("text")).alias("m"))
    return said.select("p_partkey", "m.scale", "m.area_m2", "m.width_m", "m.height_m", F.array_join("m.rooms", ", ").alias("rooms"))


def _mask(spark: SparkSession, d: str) -> DataFrame:
    """Active coarse cells: those with a strong reading of a band."""
    return V.readings(spark, d).where("rssi >= -67").select(F.col("band").alias("layer"), F.floor(F.col("x") / 8).cast("int").alias("gx"), F.floor(F.col("y") / 8).cast("int").alias("gy")).distinct()


_MASK = ", m AS (SELECT DISTINCT band AS layer, CAST(floor(x/8) AS INT) AS gx, CAST(floor(y/8) AS INT) AS gy FROM readings WHERE rssi >= -67)"


@query(with_views("readings") + _MASK + ", o AS (SELECT a.x, b.y FROM (VALUES (-2),(-1),(0),(1),(2)) a(x), (VALUES (-2),(-1),(0),(1),(2)) b(y) WHERE a.x*a.x+b.y*b.y <= 4) SELECT DISTINCT layer, gx+o.x AS gx, gy+o.y AS gy FROM m, o WHERE gx+o.x BETWEEN 0 AND 124 AND gy+o.y BETWEEN 0 AND 74")
def dilate_mask(spark, d):
    return raster.dilate(_mask(spark, d), 2, 125, 75, ["layer"])


@query(with_views("readings") + _MASK + " SELECT layer, gy, count(*) AS n FROM m GROUP BY ALL")
def density_profile(spark, d):
    return raster.density_profile(_mask(spark, d), "gy", ["layer"])


@query(with_views("readings") + _MASK + ", w AS (SELECT *, CASE WHEN gx - lag(gx) OVER (PARTITION BY layer, gy ORDER BY gx) <= 1 THEN 0 ELSE 1 END AS new FROM m), r AS (SELECT *, sum(new) OVER (PARTITION BY layer, gy ORDER BY gx) AS run FROM w) SELECT layer, gy, CAST(run AS BIGINT) AS run, min(gx) AS x0, max(gx) AS x1, count(*) AS n FROM r GROUP BY layer, gy, run")
def scanline_runs(spark, d):
    return raster.runs(_mask(spark, d), ["layer"])


@query(with_views("readings", "grid") + """, c AS (SELECT band, CAST(floor(x/20) AS INT) AS gx, CAST(floor(y/20) AS INT) AS gy, count(*) AS v FROM readings GROUP BY ALL), f AS (SELECT b.band, g.gx, g.gy, coalesce(c.v, 0) AS v FROM grid g CROSS JOIN (SELECT DISTINCT band FROM readings) b LEFT JOIN c ON c.band = b.band AND c.gx = g.gx AND c.gy = g.gy)
, r AS (SELECT *, sum(v) OVER (PARTITION BY band, gy ORDER BY gx) AS s FROM f) SELECT band, gx, gy, v AS value, CAST(sum(s) OVER (PARTITION BY band, gx ORDER BY gy) AS BIGINT) AS total FROM r""")
def summed_area(spark, d):
    r = V.readings(spark, d)
    counts = r.groupBy("band", F.floor(F.col("x") / 20).cast("int").alias("gx"), F.floor(F.col("y") / 20).cast("int").alias("gy")).agg(F.count(F.lit(1)).alias("value"))
    full = V.grid(spark).select("gx", "gy").join(F.broadcast(r.select("band").distinct()))  # one row to a band
    return raster.summed_area(full.join(counts, ["band", "gx", "gy"], "left").select("band", "gx", "gy", F.coalesce("value", F.lit(0)).alias("value")), ["band"])


@query()
def connected_regions(spark, d):
    return raster.component_stats(raster.connected(_mask(spark, d), 125, "layer"), "layer")


_HULL = with_views("readings", "bins").replace("WITH ", "WITH RECURSIVE ", 1)[:-1] + ", " + V.HULL_SQL


@query(_HULL + " SELECT band, CAST(i AS INT) AS i, x, y FROM hull")
def survey_hull(spark, d):
    return raster.convex_hull(_bins(spark, d).select("band", "x", "y"), "band")


@query(_HULL + """, hc AS (SELECT band, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM hull GROUP BY band), he AS (SELECT band, i, n, mx+(x-mx)*(1+60/sqrt((x-mx)**2+(y-my)**2)) AS x, my+(y-my)*(1+60/sqrt((x-mx)**2+(y-my)**2)) AS y FROM hull JOIN hc USING (band)),
cr AS (SELECT a.band, g.i AS gy, a.x+(g.i-a.y)/(b.y-a.y)*(b.x-a.x) AS at_x FROM he a JOIN he b ON a.band=b.band AND b.i=(a.i+1)%a.n, range(600) g(i) WHERE (a.y <= g.i AND b.y > g.i) OR (b.y <= g.i AND a.y > g.i))
SELECT band, CAST(gy AS INT) AS gy, CAST(greatest(0, floor(min(at_x))) AS INT) AS x0, CAST(least(999, ceil(max(at_x))) AS INT) AS x1 FROM cr GROUP BY band, gy""")
def survey_hull_mask(spark, d):
    inner = _bins(spark, d).select("band", "x", "y")
    return raster.hull_mask(raster.convex_hull(inner, "band"), "band", 1000, 600, 60.0)


@query()
def non_max_suppression(spark, d):
    return raster.suppress(_bins(spark, d).select("band", "x", "y", F.col("rssi").alias("score")), "band", 60.0, 40)


_EXPORT = "CASE row_idx%4 WHEN 0 THEN concat('P', CAST(row_idx AS VARCHAR(20))) WHEN 1 THEN concat('sala \"', CAST(row_idx AS VARCHAR(20)), '\"') WHEN 2 THEN concat('a,', CAST(row_idx AS VARCHAR(20)), ';b') ELSE concat('two', chr(10), 'lines') END AS point_id, CASE WHEN row_idx%5=0 THEN NULL ELSE x+CAST(0.004 AS DOUBLE) END AS x_px, y AS y_px, CASE WHEN band='24ghz' THEN floor(rssi)*CAST(1 AS DOUBLE) END AS rssi_24ghz, CASE WHEN band='5ghz' THEN floor(rssi*2)/2 END AS rssi_5ghz, CAST(NULL AS DOUBLE) AS rssi_6ghz, CAST(row_idx%7 AS DOUBLE) AS distance_m, ssid AS timestamp"


def _cell_sql(c: str, number: bool) -> str:
    if number:
        return f"coalesce(CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END, '')"
    return f"""CASE WHEN regexp_matches({c}, '[",\n;]') THEN '"' || replace({c}, '"', '""') || '"' ELSE coalesce({c}, '') END"""


@query(with_views("readings") + f", e AS (SELECT row_idx, {_EXPORT} FROM readings), q AS (SELECT * REPLACE (floor(x_px*100+0.5)/100 AS x_px, floor(y_px*100+0.5)/100 AS y_px) FROM e) SELECT row_idx, " + " || ',' || ".join(_cell_sql(c, c not in ("point_id", "timestamp")) for c in sinks.CSV_COLUMNS) + " AS line FROM q")
def export_csv_rows(spark, d):
    points = spark.sql("SELECT row_idx, " + _EXPORT + " FROM {readings}", readings=V.readings(spark, d))
    return sinks.csv_lines(points, key="row_idx")


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")
def project_json(spark, d):
    return sinks.project_json(_table(spark, d, "region"))


@query(with_views("readings") + ", k AS (SELECT *, 'coord:' || printf('%.6f', x) || ':' || printf('%.6f', y) AS key FROM readings) SELECT key, count(*) AS n, max(rssi) FILTER (band='24ghz') AS rssi_24ghz, max(rssi) FILTER (band='5ghz') AS rssi_5ghz, max(rssi) FILTER (band='6ghz') AS rssi_6ghz FROM k GROUP BY key")
def merge_readings(spark, d):
    r = V.readings(spark, d).withColumn("key", S.coordinate_key(F.col("x"), F.col("y")))
    return r.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *(F.max(F.when(F.col("band") == b, F.col("rssi"))).alias(f"rssi_{b}") for b in ingest.BANDS))
