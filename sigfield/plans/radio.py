"""Queries over propagation and interpolation, with their SQL written from the survey's formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigfield.functions import rf
from sigfield.operators import interpolate, place, spatial
from sigfield.plans import views as V
from sigfield.plans.rasters import _smooth, intersect_sql
from sigfield.plans.registry import query
from sigfield.plans.views import with_views

_TABLES = f""", mat(material, att, refl, absorb, pen) AS (VALUES {','.join(f"('{m}',CAST({a} AS DOUBLE),CAST({b} AS DOUBLE),CAST({c} AS DOUBLE),CAST({e} AS DOUBLE))" for m, (a, b, c, e) in rf.MATERIAL.items())}),
prof(band, expo, wmul, rad, shm, diff, loss1, expo2) AS (VALUES {','.join(f"('{b}',{','.join(f'CAST({x} AS DOUBLE)' for x in row)})" for b, row in rf.BAND.items())}), wm AS (SELECT * FROM walls JOIN mat USING (material))"""


def _walls_sql(rays: str, out: str, keys: str) -> str:
    """CTE ``out``: the keys, number and loss of the walls that each ray (x, y, tx, ty, band) crosses."""
    factor = "least(greatest(1/greatest(abs(sin(atan2(r.ty-r.y, r.tx-r.x)-atan2(w.y1-w.y0, w.x1-w.x0))), 0.26), 1), 2.8)"
    loss = f"w.att*p.wmul*{factor}*(1.08-w.pen*0.22)+w.refl*p.wmul*2.6+w.absorb*p.shm*1.8"
    qualified = ", ".join(f"r.{k}" for k in keys.split(", "))
    return f""", {out} AS (SELECT {qualified}, count(w.wall_id) AS n_walls, coalesce(sum({loss}), 0) AS wall_db FROM {rays} r JOIN prof p ON p.band=r.band LEFT JOIN wm w ON {intersect_sql(('r.x', 'r.y', 'r.tx', 'r.ty'), ('w.x0', 'w.y0', 'w.x1', 'w.y1'))} GROUP BY ALL)"""


@query(with_views("readings", "walls")[:-1] + _TABLES + ", ry AS (SELECT row_idx, band, x, y, CAST(500 AS DOUBLE) AS tx, CAST(300 AS DOUBLE) AS ty FROM readings)" + _walls_sql("ry", "wl", "row_idx") + " SELECT row_idx, CAST(n_walls AS INT) AS n_walls, round(wall_db, 6) AS wall_db FROM wl")
def explicit_wall_loss(spark, d):
    rays = V.readings(spark, d).select("row_idx", "band", "x", "y", F.lit(500.0).alias("tx"), F.lit(300.0).alias("ty"))
    return spatial.wall_loss(rays, V.walls(spark, d), ["row_idx"]).withColumn("wall_db", F.round("wall_db", 6))


_SHADOW = "least(18, wall_db*0.18*shm+sqrt(wall_db)*0.45)"
_CREDIT = "CASE WHEN wall_db > 0 THEN least(wall_db*0.18, diff*sqrt({m}+1)) ELSE 0 END"


def _said(m: str, less: str = "") -> str:
    gain = "least(greatest(gain,0),12)"
    return f"least(greatest(least(greatest(signal+loss1-{gain},0),30)+{gain}-(loss1+expo2*10*log10(greatest({m},1)))-wall_db-{_SHADOW}+{_CREDIT.format(m=m)}-{_smooth('radius_m*0.82', 'radius_m*1.35', m)}*18{less}, -96), -24)"


_AP = """, ap AS (SELECT ax, ay, gain, signal FROM aps ORDER BY ap_id LIMIT 1)"""
_RESIDUALS = """, pt AS (SELECT b.*, {radius} AS radius_m, count(*) OVER (PARTITION BY band) AS n_points FROM bins b JOIN prof USING (band)), pr AS (SELECT band, first_idx, ax AS x, ay AS y, pt.x AS tx, pt.y AS ty FROM pt, ap)""" + _walls_sql("pr", "pw", "band, first_idx") + f""",
pq AS (SELECT pt.*, sqrt((pt.x-ax)*(pt.x-ax)+(pt.y-ay)*(pt.y-ay))/20 AS far, wall_db, gain, signal, shm, diff, loss1, expo2 FROM pt JOIN pw USING (band, first_idx) JOIN prof USING (band), ap), pe AS (SELECT *, least(greatest(rssi-{_said('far')}, -32), 32) AS residual_db FROM pq)"""


@query(with_views("readings", "bins", "walls", "aps")[:-1] + _TABLES + _AP + _RESIDUALS.format(radius="rad") + " SELECT band, first_idx, round(residual_db, 6) AS residual_db FROM pe")
def ap_residuals(spark, d):
    points = _bins(spark, d).withColumn("radius_m", rf.of_band(F.col("band"), 2))
    found = interpolate.residuals(points, _ap(spark, d), V.walls(spark, d), V.PX_PER_M, ["band", "first_idx"])
    return found.select("band", "first_idx", F.round("residual_db", 6).alias("residual_db"))


def _bins(spark, d):
    return place.consolidate(V.readings(spark, d), V.WIDTH, V.HEIGHT, place.GENERATION_BINS, ["band"])


def _ap(spark, d):
    return V.aps(spark, d).orderBy("ap_id").limit(1).select("ax", "ay", "gain", "signal")


def _obstacle_sql(rays: str, out: str, keys: str, ppm: int) -> str:
    """CTE ``out``: as _walls_sql, with the loss of drywall pixels of ``obst`` on the way added to ``wall_db``."""
    base = "4*wmul*(CAST(0.1 AS DOUBLE)/0.12)"
    on = lambda a, b: f"CAST(floor({a}+({b}-{a})*(i/CAST(n AS DOUBLE))+0.5) AS INT)"
    # bands' values stand in the text: DuckDB now and then fails on the join with their table above many rays
    of_band = lambda k: "(CASE r.band " + " ".join(f"WHEN '{b}' THEN CAST({row[k]} AS DOUBLE)" for b, row in rf.BAND.items()) + " END)"
    crossed = _walls_sql(rays, f"{out}w", keys).replace(" JOIN prof p ON p.band=r.band", "").replace("p.wmul", of_band(1)).replace("p.shm", of_band(3))
    return crossed + f""", {out}s AS (SELECT *, unnest(generate_series(0, n)) AS i FROM (SELECT {keys}, x, y, tx, ty, greatest(1, CAST(ceil(sqrt((tx-x)*(tx-x)+(ty-y)*(ty-y))/2.5) AS INT)) AS n FROM {rays})),
{out}i AS (SELECT {keys}, i, lag(i) OVER (PARTITION BY {keys} ORDER BY i) AS before FROM (SELECT {', '.join(f's.{k} AS {k}' for k in keys.split(', '))}, i FROM {out}s s JOIN obst o ON o.gx={on('s.x', 's.tx')} AND o.gy={on('s.y', 's.ty')})),
{out}o AS (SELECT {keys}, count(*) FILTER (before IS NULL OR before < i-1) AS runs, count(*) AS blocked FROM {out}i GROUP BY {keys}),
{out} AS (SELECT {keys}, CAST(sum(n_walls) AS BIGINT) AS n_walls, sum(wall_db) AS wall_db FROM (SELECT {keys}, n_walls, wall_db FROM {out}w UNION ALL SELECT {keys}, 0, runs*{base}*(0.44+0.22*0.22)+least(12, blocked/CAST({ppm} AS DOUBLE)*{base}*(0.28+0.08*0.18)) FROM {out}o JOIN prof USING (band)) GROUP BY {keys})"""


def _grid_sql(points: str, cells: str = "CROSS JOIN grid", ppm: int = 20, losses=_walls_sql) -> str:
    """CTE ``cell``: per band and cell what its nearest points say."""
    total = f"(CASE WHEN d > 0 THEN expo*10*log10(d/{ppm}+1) ELSE 0 END+wall_db+{_SHADOW}-{_CREDIT.format(m=f'd/{ppm}')})"
    weight = lambda p, a: f"1/pow(greatest(d+wall_db*{ppm}*0.09, 0.1)+{a}, {p})*falloff"
    r = f"radius_m*{ppm}"
    power = f"least(greatest(2.2+{_smooth(f'{r}*0.2', r, f'd+wall_db*{ppm}*0.09')}*0.36, 1.35), 4.4)"
    return f""", pd AS (SELECT e.band AS band, first_idx, e.x, e.y, rssi, residual_db, radius_m, n_points, gx, gy, tx, ty, sqrt((e.x-tx)*(e.x-tx)+(e.y-ty)*(e.y-ty)) AS d FROM {points} e {cells}), pf AS (SELECT *, 1-{_smooth(f'{r}*0.74', r, 'd')} AS falloff, row_number() OVER (PARTITION BY band, gx, gy ORDER BY d, first_idx) AS k FROM pd),
pn AS MATERIALIZED (SELECT * FROM pf WHERE k = 1 OR (falloff > 0.002 AND k <= CASE WHEN n_points > 120 THEN 24 WHEN n_points > 64 THEN 48 ELSE n_points END))""" + losses("pn", "nw", "band, gx, gy, first_idx") + f""",
po AS (SELECT pn.*, wall_db, expo, shm, diff FROM pn JOIN nw USING (band, gx, gy, first_idx) JOIN prof USING (band)), px AS (SELECT *, {total} AS total, {_SHADOW} AS shade, CASE WHEN falloff > 0.002 THEN {weight(power, f'{ppm}*0.16')} END AS w, CASE WHEN falloff > 0.002 THEN {weight('2.2', f'{ppm}*0.1')} END AS rw FROM po),
cell AS (SELECT band, gx, gy, any_value(tx) AS tx, any_value(ty) AS ty, any_value(radius_m) AS radius_m, min_by(rssi, first_idx) FILTER (d <= 1e-9) AS exact, sum(w*(rssi-total*0.34-wall_db*0.42))/sum(w) AS mean, sum(rw*residual_db)/sum(rw) AS residual, sum(w*wall_db)/sum(w) AS walls, sum(w*shade)/sum(w) AS shades, max(falloff) FILTER (falloff > 0.002) AS near, min(d) AS d,
 min_by(rssi-total*0.42-wall_db*0.28, k) AS lone, min_by(least(greatest((1-{_smooth(r, f'{r}*1.45', 'd')})*0.22,0),0.22), k) AS lone_sure FROM px GROUP BY ALL)"""


_VIEWS = with_views("readings", "bins", "walls", "aps", "grid")[:-1]


@query(_VIEWS + _TABLES + _AP + _RESIDUALS.format(radius="rad") + _grid_sql("pe") + ", cr AS (SELECT band, gx, gy, ax AS x, ay AS y, tx, ty FROM cell, ap)" + _walls_sql("cr", "cw", "band, gx, gy") + f""", of AS (SELECT band, least(greatest(avg(residual_db), -28), 28) AS off FROM pe GROUP BY band),
cs AS (SELECT cell.*, wall_db, sqrt((tx-ax)*(tx-ax)+(ty-ay)*(ty-ay))/20 AS far, gain, signal, shm, diff, loss1, expo2, off FROM cell JOIN cw USING (band, gx, gy) JOIN prof USING (band) JOIN of USING (band), ap), ct AS (SELECT *, {_said('far')} AS said, least(greatest(0.26+{_smooth('radius_m*20*0.16', 'radius_m*20*0.96', 'd')}*0.38+{_smooth('6', '28', 'wall_db')}*0.14, 0.18), 0.72) AS blend FROM cs)
SELECT band, gx, gy, round(CASE WHEN exact IS NOT NULL THEN exact WHEN near IS NOT NULL THEN least(greatest(mean*(1-blend)+(said+residual)*blend, -96), -24) ELSE least(greatest(said+off, -96), -24) END, 5) AS rssi,
round(CASE WHEN exact IS NOT NULL THEN 1 WHEN near IS NOT NULL THEN least(greatest(near*0.82+0.18, 0), 1) ELSE least(greatest(0.12+(1-{_smooth('radius_m*0.9', 'radius_m*1.35', 'far')})*0.34, 0.08), 0.46) END, 5) AS confidence FROM ct""")
def rf_interpolate(spark, d):
    out = interpolate.rf_grid(_bins(spark, d), V.grid(spark), V.walls(spark, d), _ap(spark, d), V.PX_PER_M, ["band"])
    return out.select("band", "gx", "gy", F.round("rssi", 5).alias("rssi"), F.round("confidence", 5).alias("confidence"))


@query(_VIEWS + _TABLES + ", pe AS (SELECT *, CAST(0.8 AS DOUBLE) AS radius_m, CAST(0 AS DOUBLE) AS residual_db, count(*) OVER (PARTITION BY band) AS n_points FROM bins)" + _grid_sql("pe") + """ SELECT band, gx, gy, round(CASE WHEN exact IS NOT NULL THEN exact WHEN near IS NOT NULL THEN least(greatest(mean, -96), -24) ELSE lone END, 5) AS rssi,
round(CASE WHEN exact IS NOT NULL THEN 1 WHEN near IS NOT NULL THEN least(greatest(near*0.82+0.18, 0), 1) ELSE lone_sure END, 5) AS confidence FROM cell""")
def rf_out_of_reach(spark, d):
    out = interpolate.rf_grid(_bins(spark, d), V.grid(spark), V.walls(spark, d), None, V.PX_PER_M, ["band"], radius_m=0.8)
    return out.select("band", "gx", "gy", F.round("rssi", 5).alias("rssi"), F.round("confidence", 5).alias("confidence"))
