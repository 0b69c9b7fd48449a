"""Queries over points, plans and rules, with their SQL written from the survey's rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigfield.functions import scalars as S
from sigfield.operators import calibrate, points, rules, spatial
from sigfield.plans import views as V
from sigfield.plans.registry import query
from sigfield.plans.views import with_views

POINTS, PLANS = with_views("readings", "points"), with_views("plans")
W, H = 900.0, 500.0  # a plan smaller than the readings' range

_COORDINATES = """, i AS (SELECT row_idx, CASE WHEN NOT coalesce(isfinite(x) AND isfinite(y), FALSE) THEN 'point_coordinates' WHEN x < 0 OR y < 0 OR x >= 900 OR y >= 500 THEN 'point_inside' END AS code FROM points),
n AS (SELECT *, row_number() OVER (ORDER BY row_idx) AS k FROM i WHERE code IS NOT NULL)"""


@query(POINTS + _COORDINATES + """ SELECT 'error' AS severity, code, row_idx AS point_id, CAST(NULL AS BIGINT) AS omitted FROM n WHERE k <= 160
UNION ALL SELECT 'warning', 'point_issues_truncated', NULL, count(*)-160 FROM n HAVING count(*) > 160""")
def coordinate_report(spark, d):
    found = rules.report(rules.point_issues(V.points(spark, d), W, H), rules.COORDINATE_CAP, ["point_id"], "point_issues_truncated")
    return found.select("severity", "code", "point_id", "omitted")


_RSSI = """, i AS (SELECT row_idx, 0 AS pos, 'error' AS severity, 'rssi_range' AS code, '24ghz' AS band FROM points WHERE rssi_24ghz < -100 OR rssi_24ghz > -10
UNION ALL SELECT row_idx, 1, 'error', 'rssi_range', '5ghz' FROM points WHERE rssi_5ghz < -100 OR rssi_5ghz > -10
UNION ALL SELECT row_idx, 2, 'error', 'rssi_required', NULL FROM points WHERE rssi_24ghz IS NULL AND rssi_5ghz IS NULL
UNION ALL SELECT row_idx, 3, 'warning', 'distance_audit', NULL FROM points WHERE abs(csv_distance_m-distance_m) > greatest(1, distance_m*0.25)),
n AS (SELECT *, row_number() OVER (ORDER BY row_idx, pos) AS k FROM i)"""


@query(POINTS + _RSSI + """ SELECT severity, code, band, row_idx AS point_id, CAST(NULL AS BIGINT) AS omitted FROM n WHERE k <= 160
UNION ALL SELECT 'warning', 'rssi_issues_truncated', NULL, NULL, count(*)-160 FROM n HAVING count(*) > 160""")
def rssi_report(spark, d):
    found = rules.report(rules.rssi_issues(V.points(spark, d)), rules.RSSI_CAP, ["point_id", "pos"], "rssi_issues_truncated")
    return found.select("severity", "code", "band", "point_id", "omitted")


@query(POINTS + _RSSI + " SELECT severity, code, band, row_idx AS point_id FROM i")
def rssi_checks(spark, d):
    return rules.rssi_issues(V.points(spark, d)).select("severity", "code", "band", "point_id")


@query(POINTS + " SELECT 'error' AS severity, 'rssi_band_required' AS code, band FROM (SELECT count(rssi_24ghz) AS a, count(CASE WHEN row_idx < 0 THEN rssi_5ghz END) AS b FROM points) CROSS JOIN (VALUES ('24ghz'), ('5ghz')) t(band) WHERE CASE band WHEN '24ghz' THEN a ELSE b END = 0")
def silent_bands(spark, d):
    return rules.silent_bands(V.points(spark, d).withColumn("rssi_5ghz", F.lit(None).cast("double")))


#: Points marked by hand and imported ones of several surveys; some lie close together.
_MARKED = "SELECT c_custkey AS row_idx, c_custkey//1000 AS site, CASE WHEN c_custkey%10=1 THEN (c_custkey+1)*37%1000+3 ELSE c_custkey*37%1000 END AS x, CASE WHEN c_custkey%10=1 THEN (c_custkey+1)*53%600+4 ELSE c_custkey*53%600 END AS y, CASE c_custkey%7 WHEN 0 THEN 'csv' WHEN 1 THEN 'detected' ELSE 'manual' END AS source"


@query(f"WITH m AS ({_MARKED} FROM customer), z AS (SELECT site FROM m GROUP BY site HAVING count(*) <= 1200)" + """, p AS (SELECT a.site, a.row_idx AS point_id, b.row_idx AS other_id FROM m a JOIN m b ON a.site = b.site AND a.row_idx < b.row_idx AND sqrt((a.x-b.x)**2+(a.y-b.y)**2) < 8 WHERE a.source <> 'csv' AND b.source <> 'csv' AND a.site IN (SELECT site FROM z)),
n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY point_id, other_id) AS k FROM p) SELECT site, 'warning' AS severity, 'point_duplicate' AS code, point_id, other_id, CAST(NULL AS BIGINT) AS omitted FROM n WHERE k <= 40
UNION ALL SELECT site, 'warning', 'point_duplicate_truncated', NULL, NULL, count(*)-40 FROM n GROUP BY site HAVING count(*) > 40""")
def duplicate_report(spark, d):
    marked = spark.sql(_MARKED.replace("//", " div ") + " FROM {customer}", customer=V._table(spark, d, "customer"))
    return rules.close_reports(marked, ["site"]).select("site", "severity", "code", "point_id", "other_id", "omitted")


_ROUTERS = "SELECT 'error' AS severity, 'ap_inside' AS code, CAST(ap_id AS BIGINT) AS ap_id FROM aps WHERE ax < 0 OR ay < 0 OR ax >= 900 OR ay >= 500 UNION ALL SELECT 'error', 'ap_required', NULL FROM aps HAVING count(*) = 0"


@query(with_views("aps") + _ROUTERS)
def router_checks(spark, d):
    return rules.router_issues(V.aps(spark, d), W, H)


@query(PLANS + """, f AS (SELECT *, coalesce(mime = 'application/pdf', FALSE) AS pdf FROM plans), g AS (SELECT *, length > CASE WHEN pdf THEN 50 ELSE 12 END*1048576 AS big, length > CASE WHEN pdf THEN 30 ELSE 8 END*1048576 AS large FROM f)
SELECT site, 'error' AS severity, 'floorplan_type' AS code FROM g WHERE mime IS NULL OR mime NOT IN ('image/png','image/jpeg','image/jpg','image/svg+xml','application/pdf')
UNION ALL SELECT site, 'error', 'floorplan_size' FROM g WHERE big UNION ALL SELECT site, 'warning', 'floorplan_size_warning' FROM g WHERE large AND NOT big""")
def file_checks(spark, d):
    return rules.file_issues(V.plans(spark, d), "site")


@query(PLANS + """SELECT site, 'warning' AS severity, 'floorplan_resolution' AS code FROM plans WHERE width < 600 OR height < 400
UNION ALL SELECT site, 'warning', 'floorplan_resolution_large' FROM plans WHERE width > 3600 OR height > 3600 UNION ALL SELECT site, 'warning', 'floorplan_ratio' FROM plans WHERE width/height < 0.35 OR width/height > 3.2""")
def image_checks(spark, d):
    return rules.image_issues(V.plans(spark, d), "site")


@query(PLANS + """, s AS (SELECT site, mode, manual_px_per_m AS v, site%4 AS n FROM plans)
SELECT site, 'error' AS severity, 'calibration_required' AS code FROM s WHERE v <= 0 UNION ALL SELECT site, 'error', 'scale_required' FROM s WHERE v <= 0
UNION ALL SELECT site, 'warning', 'scale_range' FROM s WHERE v < 5 OR v > 1000 UNION ALL SELECT site, 'error', 'scale_two_points' FROM s WHERE mode = 'two-point' AND n <> 2""")
def scale_checks(spark, d):
    return rules.scale_issues(V.plans(spark, d).selectExpr("site", "mode", "manual_px_per_m px_per_m", "site%4 n_points"), "site")


@query(PLANS + "SELECT site, 'warning' AS severity, 'crop_aspect_mismatch' AS code, CAST(floor(abs(width/height/(width_m/height_m)-1)*100+0.5) AS BIGINT) AS pct FROM plans WHERE abs(width/height/(width_m/height_m)-1) > 0.1")
def aspect_checks(spark, d):
    return rules.aspect_issues(V.plans(spark, d), "site")


@query(with_views("readings", "points", "aps") + f""", a AS (SELECT severity, code FROM ({_ROUTERS})), c AS (SELECT 'error' AS severity, CASE WHEN NOT coalesce(isfinite(x) AND isfinite(y), FALSE) THEN 'point_coordinates' WHEN x < 0 OR y < 0 OR x >= 900 OR y >= 500 THEN 'point_inside' END AS code FROM points),
r AS (SELECT 'error' AS severity, 'rssi_range' AS code FROM points WHERE rssi_24ghz < -100 OR rssi_24ghz > -10 UNION ALL SELECT 'error', 'rssi_range' FROM points WHERE rssi_5ghz < -100 OR rssi_5ghz > -10 UNION ALL SELECT 'error', 'rssi_required' FROM points WHERE rssi_24ghz IS NULL AND rssi_5ghz IS NULL
UNION ALL SELECT 'warning', 'distance_audit' FROM points WHERE abs(csv_distance_m-distance_m) > greatest(1, distance_m*0.25))
SELECT severity, code, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM c WHERE code IS NOT NULL UNION ALL SELECT * FROM r) GROUP BY ALL""")
def readiness(spark, d):
    p = V.points(spark, d)
    parts = [rules.router_issues(V.aps(spark, d), W, H), rules.point_issues(p, W, H), rules.rssi_issues(p), rules.silent_bands(p)]
    found = parts[0].select("severity", "code")
    for more in parts[1:]:
        found = found.unionByName(more.select("severity", "code"))
    return found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query(PLANS + """SELECT site, site%9<>0 AS can_scale, site%9<>0 AND site%2=0 AS can_router, site%9<>0 AND site%3=0 AS can_points, site%5=0 AND site%7=0 AS can_review, site%9<>0 AND site%210=0 AS can_generate FROM plans""")
def step_gates(spark, d):
    found = V.plans(spark, d).selectExpr("site", "site%9<>0 has_plan", "site%2 scale_errors", "site%3 router_errors", "site%5 points_errors", "site%7 rssi_errors")
    return rules.open_steps(found)


_BANDS = "SELECT row_idx, x, y, '24ghz' AS band, '2.4GHz' AS label, rssi_24ghz AS rssi FROM points UNION ALL SELECT row_idx, x, y, '5ghz', '5GHz', rssi_5ghz FROM points UNION ALL SELECT row_idx, x, y, '6ghz', '6GHz', coalesce(rssi_6ghz, rssi_5ghz-4.5) FROM points"


@query(POINTS + f" SELECT * FROM ({_BANDS}) WHERE rssi IS NOT NULL")
def usable_points(spark, d):
    return points.usable(V.points(spark, d), ["row_idx"])


@query(POINTS + " SELECT bool_or(rssi_6ghz IS NOT NULL) AS measured, count(rssi_6ghz) AS n FROM points")
def explicit_6ghz(spark, d):
    return V.points(spark, d).agg(F.bool_or(F.col("rssi_6ghz").isNotNull()).alias("measured"), F.count("rssi_6ghz").alias("n"))


@query(POINTS + """ SELECT row_idx, CASE WHEN row_idx%5=0 THEN 'P' || row_idx ELSE 'P' || (row_idx%1000) END AS point_id, x, y, rssi_24ghz, rssi_5ghz, rssi_6ghz, CAST(NULL AS DOUBLE) AS distance_m, csv_distance_m, CASE WHEN row_idx%2=0 THEN '2024-01-01' ELSE 'now' END AS timestamp, 'csv' AS source FROM points WHERE x IS NOT NULL""")
def import_rows(spark, d):
    rows = V.points(spark, d).drop("distance_m", "point_id", "source").withColumnRenamed("csv_distance_m", "distance_m")
    rows = rows.withColumns({"raw_id": F.expr("case when row_idx%5=0 then '' else concat('ponto-00', row_idx%1000) end"), "timestamp": F.expr("case when row_idx%2=0 then '2024-01-01' else ' ' end")})
    return points.imported(rows, "now")


@query(POINTS + " SELECT row_idx, CASE WHEN source='csv' THEN x+CAST(30 AS DOUBLE) ELSE x END AS x, CASE WHEN source='csv' THEN y-CAST(10 AS DOUBLE) ELSE y END AS y FROM points")
def nudged_points(spark, d):
    return points.nudged(V.points(spark, d), 1.5, -0.5, 20.0).select("row_idx", "x", "y")


@query(POINTS + " SELECT row_idx, x*CAST(0.5 AS DOUBLE) AS x, y*CAST(0.5 AS DOUBLE) AS y FROM points")
def scaled_points(spark, d):
    return points.scaled(V.points(spark, d), 0.5, ["x", "y"]).select("row_idx", "x", "y")


@query(POINTS + """ SELECT row_idx, point_id, CASE WHEN row_idx%10=1 THEN CAST(1 AS DOUBLE) ELSE y END AS y FROM points WHERE row_idx%10<>0 UNION ALL SELECT -row_idx-1, CAST(NULL AS VARCHAR), CAST(1 AS DOUBLE) FROM points WHERE row_idx%10=2""")
def edited_points(spark, d):
    p = V.points(spark, d).select("row_idx", "point_id", "y")
    change = p.where("row_idx%10 < 3").selectExpr("case when row_idx%10=2 then -row_idx-1 else row_idx end row_idx", "row_idx%10=0 removed", "cast(1 as double) y")
    return points.edited(p, change, "row_idx")


@query(with_views("readings", "points", "aps") + "SELECT 'ap' || ap_id AS element, ax AS x, ay AS y, 'router' AS kind FROM aps UNION ALL SELECT point_id, x, y, 'measurement' FROM points")
def spatial_elements(spark, d):
    return points.elements(V.aps(spark, d), V.points(spark, d))


@query(PLANS + "SELECT site, CASE WHEN site%8=0 THEN 'none' ELSE name || ':' || length || ':' || CAST(width AS INT) || 'x' || CAST(height AS INT) || ':' || CASE WHEN site%2=0 THEN 'bw' ELSE 'raw' END END AS key FROM plans")
def plan_keys(spark, d):
    name = F.expr("case when site%8<>0 then name end")
    return V.plans(spark, d).select("site", points.plan_key(name, F.col("length"), F.col("width").cast("int"), F.col("height").cast("int"), F.expr("site%2=0")).alias("key"))


@query(POINTS + " SELECT 'P' || (max(row_idx)+1) AS point_id FROM points")
def next_id(spark, d):
    return points.next_manual_id(V.points(spark, d))


@query(PLANS + "SELECT site, floor(least(greatest(greatest(width,height)*CAST(0.0075 AS DOUBLE),6),42)*10+0.5)/10 AS radius, round(least(greatest(greatest(width,height)/1400,CAST(0.52 AS DOUBLE)),CAST(0.78 AS DOUBLE)),9) AS scale FROM plans")
def marker_sizes(spark, d):
    at = (F.col("width"), F.col("height"))
    return V.plans(spark, d).select("site", points.marker_radius(*at).alias("radius"), F.round(points.marker_scale(*at), 9).alias("scale"))


CALIBRATED = """, m AS (SELECT *, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) AS sep FROM plans),
c AS (SELECT *, CASE WHEN mode='manual' THEN CASE WHEN manual_px_per_m > 0 THEN manual_px_per_m END WHEN known_m > 0 AND sep > 1e-6 THEN sep/known_m END AS px_per_m FROM m)"""


@query(PLANS + CALIBRATED + """ SELECT site, round(px_per_m, 9) AS px_per_m, round(1/px_per_m, 9) AS m_per_px, CASE WHEN px_per_m IS NULL THEN 'uncalibrated' ELSE 'calibrated' END AS status,
concat_ws(',', CASE WHEN CASE WHEN mode='manual' THEN manual_px_per_m ELSE known_m END <= 0 THEN 'scale_required' END, CASE WHEN mode<>'manual' AND sep <= 1e-6 THEN 'scale_two_points' WHEN mode<>'manual' AND sep < 40 THEN 'scale_separation' END, CASE WHEN px_per_m < 5 OR px_per_m > 1000 THEN 'scale_range' END) AS codes FROM c""")
def calibrations(spark, d):
    got = calibrate.derive(V.plans(spark, d).withColumnRenamed("by_", "by"))
    return got.select("site", F.round("px_per_m", 9).alias("px_per_m"), F.round("m_per_px", 9).alias("m_per_px"), "status", F.array_join("codes", ",").alias("codes"))


@query(with_views("plans", "readings") + CALIBRATED + " SELECT row_idx, round((r.x-c.ox)/c.px_per_m, 6) AS wx, round((r.y-c.oy)/c.px_per_m, 6) AS wy FROM readings r LEFT JOIN c ON c.site = r.row_idx%200+1")
def world_places(spark, d):
    sites = calibrate.derive(V.plans(spark, d).withColumnRenamed("by_", "by"))
    placed = calibrate.world(V.readings(spark, d).withColumn("site", F.expr("row_idx%200+1")), sites, ["site"])
    return placed.select("row_idx", F.round("world.x", 6).alias("wx"), F.round("world.y", 6).alias("wy"))


@query(PLANS + CALIBRATED + " SELECT site, round(5*px_per_m+ox, 6) AS x, round(sep/px_per_m, 6) AS length_m, round(width*height/(px_per_m*px_per_m), 4) AS area_m2 FROM c WHERE px_per_m IS NOT NULL")
def gated_measures(spark, d):
    good = calibrate.required(calibrate.require(calibrate.derive(V.plans(spark, d).withColumnRenamed("by_", "by")).where("px_per_m is not null")))
    v = F.col("px_per_m")
    place = calibrate.anchor(F.lit(5.0), F.lit(0.0), v, F.col("ox"), F.col("oy"))
    return good.select("site", F.round(place["x"], 6).alias("x"), F.round(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / v, 6).alias("length_m"), F.round(F.col("width") * F.col("height") / (v * v), 4).alias("area_m2"))


@query(PLANS + """SELECT site, round(coalesce(CASE WHEN width_m > 0 AND height_m > 0 THEN (width/width_m+height/height_m)/2 WHEN width_m > 0 THEN width/width_m WHEN height_m > 0 THEN height/height_m END, 0), 9) AS px_per_m,
greatest(1, floor(width*CAST(0.3 AS DOUBLE)+0.5)) AS side, greatest(2, height_m*CAST(0.1 AS DOUBLE)) AS blur FROM plans""")
def known_sides(spark, d):
    v = calibrate.px_per_m_of_sides(F.col("width"), F.col("height"), F.col("width_m"), F.col("height_m"))
    return V.plans(spark, d).select("site", F.round(v, 9).alias("px_per_m"), calibrate.scaled_side(F.col("width"), 0.3).alias("side"), calibrate.scaled_blur(F.col("height_m"), 0.1).alias("blur"))


_FREQ = "CASE event_id%8 WHEN 0 THEN CAST(2400+event_id%5200 AS VARCHAR) WHEN 1 THEN '5ghz ch 36' WHEN 2 THEN 'Wi-Fi 6GHz' WHEN 3 THEN '2,4 GHz' WHEN 4 THEN '5' WHEN 5 THEN 'banda 6g' WHEN 6 THEN '4.6' ELSE '' END"


@query(f"""SELECT event_id, CASE event_id%8 WHEN 0 THEN CASE WHEN 2400+event_id%5200 < 2500 THEN '24ghz' WHEN 2400+event_id%5200 BETWEEN 4900 AND 5924 THEN '5ghz' WHEN 2400+event_id%5200 BETWEEN 5925 AND 7124 THEN '6ghz'
WHEN contains(CAST(2400+event_id%5200 AS VARCHAR), '24') THEN '24ghz' WHEN contains(CAST(2400+event_id%5200 AS VARCHAR), '5') THEN '5ghz' END WHEN 1 THEN '5ghz' WHEN 2 THEN '6ghz' WHEN 3 THEN '24ghz' WHEN 4 THEN '5ghz' WHEN 5 THEN '6ghz' WHEN 6 THEN '5ghz' END AS band FROM events""")
def band_names(spark, d):
    v = F.expr(_FREQ.replace("VARCHAR", "STRING"))
    return V._table(spark, d, "events").select("event_id", S.normalize_band(v).alias("band"))


@query("SELECT event_id, CASE event_id%6 WHEN 0 THEN '5ghz' WHEN 1 THEN '24ghz' WHEN 2 THEN '6ghz' END AS band FROM events")
def band_of_ssid(spark, d):
    name = F.expr("element_at(array('Casa-5G','casa_2.4GHz','Rede 6GHz','Casa','x5gy',''), cast(event_id%6+1 as int))")
    return V._table(spark, d, "events").select("event_id", S.band_from_ssid(name).alias("band"))


@query("""SELECT o_orderkey, CAST(o_orderkey%1000 AS DOUBLE)/10 AS decimal_comma, CASE WHEN o_orderkey%1000 > 0 THEN CAST(o_orderkey%1000 AS DOUBLE)/10 END AS positive, o_orderkey%4000+1 AS dpi_scale, CASE WHEN o_orderkey%3=0 AND o_orderkey%500 > 0 THEN CAST(o_orderkey%500 AS DOUBLE) END AS area FROM orders""")
def typed_numbers(spark, d):
    v = F.expr("concat(cast(o_orderkey%1000 div 10 as string), ',', cast(o_orderkey%10 as string))")
    scale = F.expr("concat('escala 1:', cast(o_orderkey%4000+1 as string))")
    area = F.expr("case when o_orderkey%3=0 then concat('area ', cast(o_orderkey%500 as string), ' m2') else 'sem area' end")
    return V._table(spark, d, "orders").select("o_orderkey", S.parse_decimal(F.concat(F.lit(" "), v)).alias("decimal_comma"), S.parse_positive(F.concat(v, F.lit(" m"))).alias("positive"), S.plan_scale(scale).alias("dpi_scale"), S.plan_area(area).alias("area"))
