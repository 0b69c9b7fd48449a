"""Queries over survey exports: a CSV written, read back and parsed, placed and merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigfield.functions import scalars as S
from sigfield.operators import ingest, place, points, spatial
from sigfield.plans import views as V
from sigfield.plans.registry import query
from sigfield.plans.views import with_views
from sigfield.runtime import shared_dir

READINGS = with_views("readings")
_PARSED = """, r AS (SELECT row_idx, x, y, rssi, mac, ssid, CASE WHEN band='24ghz' THEN '24ghz' ELSE '5ghz' END AS band FROM readings),
dom AS (SELECT band, mac FROM (SELECT band, mac, count(*) AS n, max(ssid <> '') AS named, min(row_idx) AS f FROM r GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY band ORDER BY named DESC, n DESC, f) = 1),
k AS (SELECT printf('coord:%.6f:%.6f', x, y) AS key, r.row_idx, x, y, CASE WHEN r.mac=dom.mac THEN rssi END AS rssi, r.band FROM r JOIN dom USING (band)),
parsed AS (SELECT key, min_by(x, row_idx) AS x, min_by(y, row_idx) AS y, max(rssi) FILTER (band='24ghz') AS rssi_24ghz, max(rssi) FILTER (band='5ghz') AS rssi_5ghz, 'P' || row_number() OVER (ORDER BY min(row_idx)) AS point_id FROM k GROUP BY key)"""


def _csv(spark, d, sep: str = ";") -> str:
    """Survey exports with the columns, accents and quoting of such exports, in files that follow one another."""
    path = shared_dir(spark, "survey")
    rows = V.readings(spark, d).orderBy("row_idx").select(
        F.lit("2026-01-14T13:07:31").alias("Timestamp"), F.col("x").cast("string").alias("X(Lat)"), F.col("y").cast("string").alias("Y(Lon)"), F.concat(F.col("rssi").cast("string"), F.lit(" dBm")).alias("Sinal"),
        F.lit("-92").alias("Noise"), F.when(F.col("band") == "24ghz", "6").otherwise("36").alias("Ch"), F.lower("mac").alias("MAC"), F.when(F.col("ssid") != "", F.concat(F.col("ssid"), F.lit(';"x"'))).otherwise("").alias("SSID"),
    )
    rows.write.csv(path, header=True, sep=sep, quote='"', escape='"', emptyValue="", nullValue="")
    return path


@query(READINGS + _PARSED + " SELECT point_id, x, y, rssi_24ghz, rssi_5ghz FROM parsed")
def survey_csv(spark, d):
    return ingest.read_survey_csv(spark, _csv(spark, d)).rows.select("point_id", "x", "y", "rssi_24ghz", "rssi_5ghz")


@query(READINGS + _PARSED + " SELECT point_id, x, y, rssi_24ghz, rssi_5ghz FROM parsed")
def survey_tsv(spark, d):
    return ingest.read_survey_csv(spark, _csv(spark, d, "\t")).rows.select("point_id", "x", "y", "rssi_24ghz", "rssi_5ghz")


_SENTINEL = """, t AS (SELECT row_idx, band, CASE WHEN row_idx%500=7 THEN 36600000 ELSE x END AS x, y FROM readings), m AS (SELECT band, list_sort(list(x)) AS lx, list_sort(list(y)) AS ly, count(*) AS n FROM t GROUP BY band),
md AS (SELECT band, lx[CAST(floor((n-1)*0.5+0.5) AS INT)+1] AS mx, ly[CAST(floor((n-1)*0.5+0.5) AS INT)+1] AS my FROM m), o AS (SELECT band, mx, my, list_sort(list(abs(x-mx))) AS lx, list_sort(list(abs(y-my))) AS ly, count(*) AS n FROM t JOIN md USING (band) GROUP BY ALL),
s AS (SELECT band, mx, my, lx[CAST(floor((n-1)*0.5+0.5) AS INT)+1] AS dx, ly[CAST(floor((n-1)*0.5+0.5) AS INT)+1] AS dy FROM o),
w AS (SELECT row_idx, band, NOT (abs(x-mx) > greatest(dx, 0.01)*500 OR abs(y-my) > greatest(dy, 0.01)*500) AS ok, x, y FROM t JOIN s USING (band)), p AS (SELECT row_idx, band, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y FROM w)"""


def _with_sentinels(spark, d):
    return V.readings(spark, d).select("row_idx", "band", F.expr("case when row_idx%500=7 then 36600000D else x end").alias("x"), "y")


@query(READINGS + _SENTINEL + " SELECT row_idx, x, y FROM p")
def sentinels(spark, d):
    return place.reject_sentinels(_with_sentinels(spark, d), ["band"]).select("row_idx", "x", "y")


@query(READINGS + _SENTINEL + ", l AS (SELECT band, min(x) AS x0, min(y) AS y0 FROM p GROUP BY band) SELECT row_idx, floor((24+(x-x0)*CAST(0.5 AS DOUBLE))*100+0.5)/100 AS px, floor((24+(y-y0)*CAST(0.5 AS DOUBLE))*100+0.5)/100 AS py FROM p JOIN l USING (band)")
def placed_metric(spark, d):
    out = place.prepare(_with_sentinels(spark, d), 600.0, 400.0, 0.5, ["band"])
    return out.select("row_idx", F.col("x").alias("px"), F.col("y").alias("py"))


_FIT = "floor(({pad}+(least(greatest({v}, {lo}), {hi})-{lo})/({hi}-{lo})*({size}-2*{pad}-1))*100+0.5)/100"


@query(READINGS + _SENTINEL + """, l AS (SELECT band, list_sort(list(x)) AS lx, list_sort(list(y)) AS ly, count(*) AS n FROM p WHERE x IS NOT NULL GROUP BY band),
q AS (SELECT band, lx[CAST(floor((n-1)*0.01+0.5) AS INT)+1] AS x0, lx[CAST(floor((n-1)*0.99+0.5) AS INT)+1] AS x1, ly[CAST(floor((n-1)*0.01+0.5) AS INT)+1] AS y0, ly[CAST(floor((n-1)*0.99+0.5) AS INT)+1] AS y1 FROM l)
SELECT row_idx, """ + _FIT.format(pad="24.0::DOUBLE", v="x", lo="x0", hi="x1", size="600") + " AS px, " + _FIT.format(pad="16.0::DOUBLE", v="y", lo="y0", hi="y1", size="400") + " AS py FROM t JOIN q USING (band)")
def placed_fit(spark, d):
    return place.prepare(_with_sentinels(spark, d), 600.0, 400.0, None, ["band"]).select("row_idx", F.col("x").alias("px"), F.col("y").alias("py"))


@query(with_views("readings", "points") + """, old AS (SELECT point_id, x, y, rssi_24ghz, source FROM points WHERE row_idx%2=0), new AS (SELECT row_idx, CASE WHEN row_idx%8=0 THEN 'P' || row_idx ELSE 'P' || (row_idx+1000000) END AS point_id, x+1 AS x, y, CASE WHEN row_idx%3=0 THEN NULL ELSE rssi_24ghz-1 END AS rssi_24ghz FROM points WHERE row_idx%4=0 AND x IS NOT NULL AND row_idx%16<>4)
SELECT old.point_id, coalesce(new.x, old.x) AS x, coalesce(new.rssi_24ghz, old.rssi_24ghz) AS rssi_24ghz, CASE WHEN new.x IS NOT NULL THEN 'csv' ELSE old.source END AS source FROM old LEFT JOIN new ON new.point_id=old.point_id
UNION ALL SELECT point_id, x, rssi_24ghz, 'csv' FROM new WHERE point_id NOT IN (SELECT point_id FROM old)""")
def merged_import(spark, d):
    p = V.points(spark, d).withColumn("timestamp", F.lit("t"))
    old = p.where("row_idx%2=0")
    raw = p.where("row_idx%4=0 and row_idx%16<>4").selectExpr("row_idx", "case when row_idx%8=0 then concat('ponto ', row_idx) else concat('p-', row_idx+1000000) end raw_id", "x+1 x", "y", "case when row_idx%3=0 then null else rssi_24ghz-1 end rssi_24ghz", "rssi_5ghz", "rssi_6ghz", "distance_m", "timestamp")
    rows = points.imported(raw, "now")
    matched = spatial.alias_join(old.select("point_id"), rows.select("row_idx", F.col("point_id").alias("name")), S.point_id_aliases, "point_id", "name").where("matched is not null")
    matched = matched.join(rows.select("row_idx", F.col("point_id").alias("matched")), "matched").select("point_id", "row_idx")
    return points.merged_import(old, rows, matched, False).select("point_id", "x", "rssi_24ghz", "source")
