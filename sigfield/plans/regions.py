"""Queries over painted plans: houses, obstacles, dividers, rooms by colour and markers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigfield.operators import masks, regions
from sigfield.plans import views as V
from sigfield.plans.registry import query
from sigfield.runtime import cut, spread

# a painted plan has 160 x 120 pixels; fixed thresholds below are those of this size


def _label_sql(source: str, out: str, slack: int = 0, value: str = "0") -> str:
    """Runs {out}r (plan, v, gy, x0, x1, id) of the cells of ``source``, and {out} with their component's label."""
    return f""", {out}n AS (SELECT plan, {value} AS v, gx, gy, gx-row_number() OVER (PARTITION BY plan, {value}, gy ORDER BY gx) AS i FROM {source}),
{out}r AS MATERIALIZED (SELECT plan, v, gy, min(gx) AS x0, max(gx) AS x1, gy*160+min(gx) AS id FROM {out}n GROUP BY plan, v, gy, i),
{out}k AS MATERIALIZED (SELECT a.plan, a.id AS a, b.id AS b FROM {out}r a JOIN {out}r b ON a.plan=b.plan AND a.v=b.v AND (b.gy=a.gy+1 OR b.gy=a.gy-1) AND b.x0 <= a.x1+{slack} AND b.x1 >= a.x0-{slack}),
{out}t AS (SELECT plan, id, id AS t FROM {out}r UNION SELECT t.plan, t.id, k.b FROM {out}t t JOIN {out}k k ON k.plan=t.plan AND k.a=t.t),
{out} AS MATERIALIZED (SELECT r.*, label FROM {out}r r JOIN (SELECT plan, id, min(t) AS label FROM {out}t GROUP BY plan, id) USING (plan, id))"""


def _cells_sql(runs: str) -> str:
    return f"(SELECT u.plan, CAST(x.i AS INT) AS gx, CAST(u.gy AS INT) AS gy FROM {runs} u, range(160) x(i) WHERE x.i BETWEEN u.x0 AND u.x1)"


def _runs_sql(cells: str, more: str = "") -> str:
    """The runs of cells as a query; ``more`` names a further column to keep apart."""
    m = f", {more}" if more else ""
    return f" SELECT plan{m}, CAST(gy AS INT) AS gy, CAST(min(gx) AS INT) AS x0, CAST(max(gx) AS INT) AS x1 FROM (SELECT plan{m}, gx, gy, gx-row_number() OVER (PARTITION BY plan{m}, gy ORDER BY gx) AS i FROM {cells}) GROUP BY plan{m}, gy, i"


def _grow_sql(source: str, r: int) -> str:
    return f"(SELECT DISTINCT plan, CAST(gx+x.i AS INT) AS gx, CAST(gy+y.i AS INT) AS gy FROM {source}, range(-{r},{r + 1}) x(i), range(-{r},{r + 1}) y(i) WHERE x.i*x.i+y.i*y.i <= {r * r} AND gx+x.i BETWEEN 0 AND 159 AND gy+y.i BETWEEN 0 AND 119)"


def _stats_sql(source: str) -> str:
    return f"SELECT *, ww*1.0::DOUBLE/hh AS aspect, greatest(ww,hh) AS lng, least(ww,hh) AS sht, area/CAST(ww*hh AS DOUBLE) AS density FROM (SELECT plan, label, sum(x1-x0+1) AS area, min(x0) AS l, max(x1) AS r, min(gy) AS t, max(gy) AS b, max(x1)-min(x0)+1 AS ww, max(gy)-min(gy)+1 AS hh FROM {source} GROUP BY plan, label)"


_BASE = "WITH RECURSIVE " + V.SQL["paintings"] + """, pl AS (SELECT DISTINCT (p_partkey-1)//40 AS plan FROM part), whole AS (SELECT plan, CAST(x.i AS INT) AS gx, CAST(y.i AS INT) AS gy FROM pl, range(160) x(i), range(120) y(i)),
edge AS (SELECT plan, r, g, b, (CASE WHEN gx%2=0 THEN (gy=0)::INT+(gy=119)::INT ELSE 0 END)+(gx=0)::INT+(gx=159)::INT AS n FROM paintings),
bgs AS (SELECT plan, sum(r*n)/CAST(sum(n) AS DOUBLE) AS br, sum(g*n)/CAST(sum(n) AS DOUBLE) AS bg, sum(b*n)/CAST(sum(n) AS DOUBLE) AS bb FROM edge WHERE n > 0 GROUP BY plan),
col AS MATERIALIZED (SELECT d.*, sqrt((r-coalesce(br,255))**2+(g-coalesce(bg,255))**2+(b-coalesce(bb,255))**2) AS far, (CAST(0.2126 AS DOUBLE)*r+CAST(0.7152 AS DOUBLE)*g+CAST(0.0722 AS DOUBLE)*b)/255 AS light FROM paintings d LEFT JOIN bgs USING (plan)),
bar AS MATERIALIZED """ + _grow_sql("(SELECT plan, gx, gy FROM col WHERE far > 42)", 2) + ", free AS (SELECT * FROM whole ANTI JOIN bar USING (plan, gx, gy))"

_ENCLOSED = _BASE + _label_sql("free", "fl") + f""", extl AS (SELECT DISTINCT plan, label FROM fl WHERE gy IN (0,119) OR x0=0 OR x1=159), ext AS MATERIALIZED {_cells_sql("(SELECT * FROM fl SEMI JOIN extl USING (plan, label))")},
inn AS (SELECT * FROM whole ANTI JOIN ext USING (plan, gx, gy))""" + _label_sql("inn", "il") + f""", big AS (SELECT plan, label, sum(x1-x0+1) AS area FROM il GROUP BY ALL HAVING sum(x1-x0+1) >= 160), fit AS (SELECT plan FROM big GROUP BY plan HAVING sum(area)/CAST(19200 AS DOUBLE) BETWEEN 0.035 AND 0.86),
encl AS MATERIALIZED {_cells_sql("(SELECT * FROM il SEMI JOIN big USING (plan, label) SEMI JOIN fit USING (plan))")}"""

_NOTE = "area < 36 OR (area < 120 AND lng <= 160*CAST(0.12 AS DOUBLE)) OR (lng > 160*CAST(0.08 AS DOUBLE) AND sht <= 10) OR ((aspect > 12 OR aspect < 1/CAST(12 AS DOUBLE)) AND density < 0.72)"


def _spans_sql(line: str, along: str, out: str) -> str:
    return f""", {out}e AS (SELECT plan, {line} AS l, min({along}) AS lo, max({along}) AS hi FROM sel GROUP BY ALL), {out}n AS (SELECT *, lead(l) OVER w-l AS gap, lead(lo) OVER w AS lo2, lead(hi) OVER w AS hi2 FROM {out}e WINDOW w AS (PARTITION BY plan ORDER BY l)),
{out} AS (SELECT plan, l, lo, hi FROM {out}e UNION ALL SELECT plan, l+k, floor(lo+(lo2-lo)*(k/CAST(gap AS DOUBLE))+0.5), floor(hi+(hi2-hi)*(k/CAST(gap AS DOUBLE))+0.5) FROM {out}n, range(1,6) t(k) WHERE gap BETWEEN 2 AND 6 AND k < gap)"""


_HOUSE = _ENCLOSED + ", barx AS (SELECT * FROM bar ANTI JOIN fit USING (plan))" + _label_sql("barx", "bl") + f""", bst AS (SELECT *, {_NOTE} AS note FROM ({_stats_sql("bl")})),
mn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY note, area DESC, label) AS k FROM bst) WHERE k=1),
chosen AS (SELECT s.plan, s.label FROM bst s JOIN mn m ON s.plan=m.plan WHERE s.label=m.label OR (NOT s.note AND s.area >= m.area*CAST(0.018 AS DOUBLE) AND (s.l+s.r)/CAST(2 AS DOUBLE) BETWEEN greatest(0,m.l-2) AND least(159,m.r+2) AND (s.t+s.b)/CAST(2 AS DOUBLE) BETWEEN greatest(0,m.t-2) AND least(119,m.b+2))),
sel AS MATERIALIZED {_cells_sql("(SELECT * FROM bl SEMI JOIN chosen USING (plan, label))")}""" + _spans_sql("gy", "gx", "fr") + _spans_sql("gx", "gy", "fc") + """,
house AS MATERIALIZED (SELECT * FROM encl UNION ALL SELECT w.* FROM whole w JOIN fr ON fr.plan=w.plan AND fr.l=w.gy JOIN fc ON fc.plan=w.plan AND fc.l=w.gx WHERE w.gx BETWEEN fr.lo-1 AND fr.hi+1 AND w.gy BETWEEN fc.lo-1 AND fc.hi+1),
allow AS MATERIALIZED (SELECT * FROM house UNION ALL SELECT * FROM whole ANTI JOIN (SELECT DISTINCT plan FROM house) USING (plan))"""


def _lines_sql(test: str, keep: str, least: int, most: float) -> str:
    return _HOUSE + f", raw AS (SELECT plan, gx, gy FROM col SEMI JOIN allow USING (plan, gx, gy) WHERE {test})" + _label_sql("raw", "rl", 1) + f""", rk AS (SELECT plan, label FROM ({_stats_sql("rl")}) WHERE {keep}), rc AS {_cells_sql("(SELECT * FROM rl SEMI JOIN rk USING (plan, label))")},
om AS (SELECT * FROM {_grow_sql("rc", 1)} SEMI JOIN allow USING (plan, gx, gy)), ok AS (SELECT plan FROM om GROUP BY plan HAVING count(*) >= {least} AND count(*)/CAST(19200 AS DOUBLE) <= {most}), lm AS (SELECT * FROM om SEMI JOIN ok USING (plan))"""


_DIM = "(lng > 160*CAST(0.08 AS DOUBLE) AND sht <= {})".format
_OBSTACLES = _lines_sql("far > 46 OR light < 0.76", f"((lng >= 34 AND area >= 28 AND NOT {_DIM(10)}) OR (area >= 220 AND density > 0.04)) AND NOT (lng < 38 AND density > 0.28) AND NOT (area < 90 AND sht < 12)", 48, 0.42)
_DIVIDERS = _lines_sql("far > 54 OR light < 0.72", f"((lng >= 72 AND area >= 42 AND lng/CAST(sht AS DOUBLE) >= 3.2 AND sht <= 36) OR (lng >= 120 AND area >= 84 AND density BETWEEN 0.015 AND 0.28 AND NOT (lng < 110 AND sht > 14))) AND NOT (density > 0.32 AND lng < 140) AND NOT ({_DIM(8)} AND density < 0.2)", 80, 0.24)

_ROOMS = _HOUSE + """, med AS (SELECT plan, gx, gy, list_sort(list(coalesce(rr, 0)))[13] AS r, list_sort(list(coalesce(gg, 0)))[13] AS g, list_sort(list(coalesce(bb, 0)))[13] AS b FROM (SELECT p.plan, p.gx, p.gy, q.r AS rr, q.g AS gg, q.b AS bb FROM (SELECT p.*, least(greatest(p.gx+x.i, 0), 159) AS qx, least(greatest(p.gy+y.i, 0), 119) AS qy FROM paintings p, range(-2,3) x(i), range(-2,3) y(i)) p LEFT JOIN paintings q ON q.plan=p.plan AND q.gx=p.qx AND q.gy=p.qy) GROUP BY plan, gx, gy),
buck AS (SELECT plan, gx, gy, CAST(floor(r/20.0+0.5)*65536+floor(g/20.0+0.5)*256+floor(b/20.0+0.5) AS BIGINT) AS q FROM med SEMI JOIN allow USING (plan, gx, gy) WHERE NOT (r >= 232 AND g >= 232 AND b >= 232) AND greatest(r,g,b) > 70 AND greatest(r,g,b)-least(r,g,b) >= 10)""" + _label_sql("buck", "cl", 0, "q") + f""", cbig AS (SELECT plan, label, row_number() OVER (PARTITION BY plan ORDER BY label) AS region FROM (SELECT plan, label FROM cl GROUP BY plan, label HAVING sum(x1-x0+1) >= 120)),
room AS MATERIALIZED (SELECT u.plan, CAST(x.i AS INT) AS gx, CAST(u.gy AS INT) AS gy, region FROM (SELECT cl.*, region FROM cl JOIN cbig USING (plan, label)) u, range(160) x(i) WHERE x.i BETWEEN u.x0 AND u.x1),
hole AS (SELECT * FROM allow SEMI JOIN (SELECT DISTINCT plan FROM room) USING (plan) ANTI JOIN room USING (plan, gx, gy))""" + _label_sql("hole", "hl") + f""", hcell AS MATERIALIZED (SELECT u.plan, u.label, CAST(x.i AS INT) AS gx, CAST(u.gy AS INT) AS gy FROM hl u, range(160) x(i) WHERE x.i BETWEEN u.x0 AND u.x1),
hn AS (SELECT h.plan, h.label, h.gx+d.dx AS gx, h.gy+d.dy AS gy FROM hcell h, (VALUES (1,0),(-1,0),(0,1),(0,-1)) d(dx,dy)), hb AS (SELECT hn.plan, hn.label, bool_or(w.plan IS NULL) AS outside, min(region) AS lo, max(region) AS hi FROM hn LEFT JOIN allow w ON w.plan=hn.plan AND w.gx=hn.gx AND w.gy=hn.gy LEFT JOIN room ON room.plan=hn.plan AND room.gx=hn.gx AND room.gy=hn.gy GROUP BY ALL),
pocket AS (SELECT hb.plan, hb.label, lo AS region FROM hb JOIN (SELECT plan, label, count(*) AS n FROM hcell GROUP BY ALL) USING (plan, label) WHERE NOT outside AND lo=hi AND n <= 2000),
rooms2 AS MATERIALIZED (SELECT plan, gx, gy, region FROM room UNION ALL SELECT plan, gx, gy, region FROM hcell JOIN pocket USING (plan, label))"""

_MARKS = _BASE + ", red AS (SELECT plan, gx, gy FROM paintings WHERE a > 80 AND r > 155 AND g < 150 AND b < 140 AND r-g > 44 AND r-b > 58 AND (r-least(g,b))/CAST(r AS DOUBLE) > 0.32), grown AS " + _grow_sql("red", 1) + _label_sql("grown", "gl", 1) + f""", rs AS (SELECT l.plan, l.label, count(*) AS red, sum(r.gx)/CAST(count(*) AS DOUBLE) AS x, sum(r.gy)/CAST(count(*) AS DOUBLE) AS y FROM red r JOIN gl l ON l.plan=r.plan AND l.gy=r.gy AND r.gx BETWEEN l.x0 AND l.x1 GROUP BY ALL),
cand AS (SELECT *, red*least(aspect, 1/aspect)*least(greatest(red/CAST(ww*hh AS DOUBLE)*CAST(4.2 AS DOUBLE), 0.2), 1.4) AS score FROM ({_stats_sql("gl")}) JOIN rs USING (plan, label) WHERE red BETWEEN 18 AND 700 AND sht >= 6 AND lng <= 38 AND aspect BETWEEN 0.5 AND 2 AND red/CAST(ww*hh AS DOUBLE) >= 0.045 AND density <= 0.96 AND NOT {_DIM(8)}),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY score DESC, label) AS k FROM cand),
ac AS (SELECT plan, k, [{{'x': x, 'y': y}}] AS m, true AS taken FROM ordered WHERE k=1 UNION ALL SELECT plan, k, CASE WHEN dup THEN m ELSE list_append(m, {{'x': x, 'y': y}}) END, NOT dup FROM (SELECT o.*, ac.m, len(list_filter(ac.m, lambda q: sqrt((q.x-o.x)**2+(q.y-o.y)**2) < 18)) > 0 AS dup FROM ac JOIN ordered o ON o.plan=ac.plan AND o.k=ac.k+1)),
top AS (SELECT o.*, row_number() OVER (PARTITION BY o.plan ORDER BY o.k) AS place FROM ordered o JOIN ac USING (plan, k) WHERE taken)"""


def _painted(spark, d):
    return cut(V.painting_runs(spark, d), "paintings"), cut(spread(V.painted_plans(spark, d), "plan"), "plans")


def _housed(spark, d):
    pixels, plans = _painted(spark, d)
    return pixels, plans, cut(regions.house_masks(pixels, plans), "house")


@query(_ENCLOSED + _runs_sql("encl"))
def enclosed_areas(spark, d):
    pixels, plans = _painted(spark, d)
    drawn = regions.runs_of(regions._colored(pixels, plans).where("far > 42 * 42"), ["plan"])
    return regions.enclosed(cut(regions.dilated(drawn, plans, F.lit(2)), "barrier"), plans)


@query(_HOUSE + _runs_sql("house"))
def house_masks(spark, d):
    return regions.house_masks(*_painted(spark, d))


@query(_OBSTACLES + _runs_sql("lm"))
def obstacle_masks(spark, d):
    return regions.obstacle_masks(*_housed(spark, d))


@query(_DIVIDERS + _runs_sql("lm"))
def divider_masks(spark, d):
    return regions.divider_masks(*_housed(spark, d))


@query(_OBSTACLES + " SELECT plan, coalesce(floor(n/CAST(19200 AS DOUBLE)*100*100+0.5)/100, 0) AS covered FROM pl LEFT JOIN (SELECT plan, count(*) AS n FROM lm GROUP BY plan) USING (plan)")
def structural_coverage(spark, d):
    pixels, plans, house = _housed(spark, d)
    return regions.covered_share(regions.obstacle_masks(pixels, plans, house), plans)


@query(_ROOMS + _runs_sql("rooms2", "region"))
def color_regions(spark, d):
    return regions.color_regions(*_housed(spark, d))


@query(_ROOMS + """, pt AS (SELECT plan, CAST(plan*37%160 AS INT) AS gx, CAST(plan*53%120 AS INT) AS gy FROM pl UNION SELECT plan, 45, 30 FROM pl UNION SELECT plan, 90, 80 FROM pl), rm AS (SELECT w.plan, w.gx, w.gy, coalesce(region, 0) AS region FROM whole w LEFT JOIN rooms2 USING (plan, gx, gy)),
spot AS (SELECT pt.*, region FROM pt JOIN rm USING (plan, gx, gy)), hit AS (SELECT plan, region FROM spot WHERE region > 0 UNION SELECT a.plan, r.region FROM spot a JOIN rm r ON a.plan=r.plan AND r.gx BETWEEN a.gx-3 AND a.gx+3 AND r.gy BETWEEN a.gy-3 AND a.gy+3 WHERE a.region=0 AND r.region > 0)
SELECT plan, count(*) AS inside FROM rm WHERE region=0 OR EXISTS (SELECT 1 FROM hit WHERE hit.plan=rm.plan AND hit.region=rm.region) GROUP BY plan""")
def measured_color_rooms(spark, d):
    pixels, plans, house = _housed(spark, d)
    rooms = cut(regions.color_regions(pixels, plans, house), "rooms")
    points = plans.select("plan", F.explode(F.array(*(F.struct(F.expr(x).cast("int").alias("gx"), F.expr(y).cast("int").alias("gy")) for x, y in (("plan*37%160", "plan*53%120"), ("45", "30"), ("90", "80"))))).alias("p")).select("plan", "p.*").distinct()
    kept = masks.measured_rooms(rooms, points, plans)
    return kept.groupBy("plan").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("inside"))


@query(_MARKS + " SELECT plan, 'P' || row_number() OVER (PARTITION BY plan ORDER BY y, x) AS point_id, round(x, 6) AS x, round(y, 6) AS y, round(score, 6) AS score FROM top WHERE place <= 8")
def red_markers(spark, d):
    return regions.red_markers(V.painting_runs(spark, d), V.painted_plans(spark, d)).withColumns({c: F.round(c, 6) for c in ("x", "y", "score")})
