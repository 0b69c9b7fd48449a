"""Queries over rasters and masks, with their SQL written from the survey's rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigfield.functions import scores
from sigfield.operators import coverage, interpolate, masks, place, raster
from sigfield.plans import views as V
from sigfield.plans.registry import query
from sigfield.plans.views import with_views

READINGS, BINS = with_views("readings"), with_views("readings", "bins")


def _bins(spark, d):
    return place.consolidate(V.readings(spark, d), V.WIDTH, V.HEIGHT, place.GENERATION_BINS, ["band"])


def _smooth(lo: str, hi: str, v: str) -> str:
    t = f"least(greatest((({v})-({lo}))/greatest(({hi})-({lo}), 1e-9), 0), 1)"
    return f"({t}*{t}*(3-2*{t}))"


# --- blur of a field of signals: readings averaged over cells of 40 pixels, some of them left out

GW, GH = 25, 15
_FIELD = f""", f AS (SELECT band, CAST(floor(x/40) AS INT) AS gx, CAST(floor(y/40) AS INT) AS gy, CAST(sum(CAST(rssi AS DECIMAL(28,6))) AS DOUBLE)/count(rssi) AS value FROM readings GROUP BY ALL),
c0 AS (SELECT band, gx, gy, value, CAST(0.5 AS DOUBLE)+(gx%5)*CAST(0.1 AS DOUBLE) AS alpha FROM f WHERE (gx+gy)%7 <> 0), b AS (SELECT DISTINCT band FROM c0), g AS (SELECT band, x.i AS gx, y.i AS gy FROM b, range({GW}) x(i), range({GH}) y(i))"""


def _field(spark, d):
    at = lambda c: F.floor(F.col(c) / 40).cast("int")
    f = V.readings(spark, d).groupBy("band", at("x").alias("gx"), at("y").alias("gy")).agg(place.exact_mean(F.col("rssi")).alias("value"))
    return f.where("(gx+gy)%7 <> 0").withColumn("alpha", F.lit(0.5) + (F.col("gx") % 5) * F.lit(0.1))


def _gradient_sql(cells: str, out: str, gw: int = GW, gh: int = GH) -> str:
    near = lambda name, x, y: f"LEFT JOIN {cells} {name} ON {name}.band=c.band AND {name}.gx={x} AND {name}.gy={y}"
    return f"""{out} AS (SELECT c.*, coalesce(r.value,0)-coalesce(l.value,0) AS dx, coalesce(d.value,0)-coalesce(u.value,0) AS dy FROM {cells} c {near('r', f'least(c.gx+1,{gw - 1})', 'c.gy')} {near('l', 'greatest(c.gx-1,0)', 'c.gy')}
 {near('d', 'c.gx', f'least(c.gy+1,{gh - 1})')} {near('u', 'c.gx', 'greatest(c.gy-1,0)')})"""


def _pass_sql(cells: str, out: str, radius: int, gw: int = GW, gh: int = GH) -> str:
    kernel = ",".join(f"({k - radius},CAST({w!r} AS DOUBLE))" for k, w in enumerate(raster.gaussian_kernel(radius)))
    return f""", {out}k(o, w) AS (VALUES {kernel}), {out}h AS (SELECT g.band, g.gx, g.gy, sum(c.value*greatest(c.alpha,0.001)*w) AS t, sum(CASE WHEN c.alpha IS NOT NULL THEN greatest(c.alpha,0.001)*w END) AS b FROM g, {out}k LEFT JOIN {cells} c ON c.band=g.band AND c.gy=g.gy AND c.gx=least(greatest(g.gx+o,0),{gw - 1}) GROUP BY ALL),
{out}v AS (SELECT g.band, g.gx, g.gy, sum(t*w) AS t, sum(b*w) AS b FROM g, {out}k LEFT JOIN {out}h h ON h.band=g.band AND h.gx=g.gx AND h.gy=least(greatest(g.gy+o,0),{gh - 1}) GROUP BY ALL), {_gradient_sql(cells, out + 'g', gw, gh)},
{out}p AS (SELECT g.*, v.t, v.b, {_smooth('3.5', '12', 'sqrt(dx*dx+dy*dy)')}*CAST(0.78 AS DOUBLE) AS p FROM {out}g g JOIN {out}v v USING (band, gx, gy)),
{out} AS (SELECT band, gx, gy, CASE WHEN b > 0.0001 THEN value*p+t/b*(1-p) ELSE value END AS value, CASE WHEN b > 0.0001 THEN least(greatest(b,0),1) ELSE alpha END AS alpha FROM {out}p)"""


@query(READINGS + _FIELD + ", " + _gradient_sql("c0", "d") + " SELECT band, gx, gy, round(dx, 6) AS dx, round(dy, 6) AS dy FROM d")
def cell_gradient(spark, d):
    return raster.gradient(_field(spark, d), GW, GH, ["band"]).select("band", "gx", "gy", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@query(READINGS + _FIELD + _pass_sql("c0", "one", 4) + _pass_sql("one", "two", 2) + " SELECT band, gx, gy, round(value, 5) AS value, round(alpha, 5) AS alpha FROM two")
def gaussian_blur(spark, d):
    return raster.blur(_field(spark, d), 4, GW, GH, ["band"]).select("band", "gx", "gy", F.round("value", 5).alias("value"), F.round("alpha", 5).alias("alpha"))


# --- masks of strong readings on cells of 8 pixels

MASK = ", m AS (SELECT DISTINCT band AS layer, CAST(floor(x/8) AS INT) AS gx, CAST(floor(y/8) AS INT) AS gy FROM readings WHERE rssi >= -67)"
_INWARD = f""", o AS (SELECT a.x, b.y FROM (VALUES (-2),(-1),(0),(1),(2)) a(x), (VALUES (-2),(-1),(0),(1),(2)) b(y) WHERE a.x*a.x+b.y*b.y <= 4),
s AS (SELECT m.layer, m.gx, m.gy, count(n.gx)/CAST(13 AS DOUBLE) AS share FROM m CROSS JOIN o LEFT JOIN m n ON n.layer=m.layer AND n.gx=m.gx+o.x AND n.gy=m.gy+o.y GROUP BY ALL),
a AS (SELECT layer, gx, gy, CAST(floor({_smooth('0.44', '0.92', 'share')}*255+0.5) AS INT) AS alpha FROM s)"""


def strong(spark, d, cell: int = 8):
    return V.readings(spark, d).where("rssi >= -67").select(F.col("band").alias("layer"), F.floor(F.col("x") / cell).cast("int").alias("gx"), F.floor(F.col("y") / cell).cast("int").alias("gy")).distinct()


@query(READINGS + MASK + _INWARD + " SELECT layer, gx, gy, alpha FROM a")
def inward_alpha(spark, d):
    return masks.inward_alpha(strong(spark, d), 2, ["layer"])


@query(READINGS + MASK + _INWARD + " SELECT layer, gx, gy, round((CAST(0.5 AS DOUBLE)+gx%3*CAST(0.1 AS DOUBLE))*alpha/255, 9) AS alpha FROM a WHERE gy%2=0")
def masked_alpha(spark, d):
    cells = strong(spark, d).where("gy%2=0").withColumn("alpha", F.lit(0.5) + (F.col("gx") % 3) * F.lit(0.1))
    return masks.masked(cells, masks.inward_alpha(strong(spark, d), 2, ["layer"]), ["layer"]).withColumn("alpha", F.round("alpha", 9))


@query(READINGS + MASK + f" SELECT layer, round(count(*)*CAST(100 AS DOUBLE)/{125 * 75}, 2) AS structural_pct FROM m GROUP BY layer")
def structural_coverage(spark, d):
    return strong(spark, d).groupBy("layer").agg(F.round(F.count(F.lit(1)) * 100.0 / (125 * 75), 2).alias("structural_pct"))


_LABELS = """, m AS (SELECT DISTINCT band AS layer, CAST(floor(x/40) AS INT) AS gx, CAST(floor(y/40) AS INT) AS gy FROM readings WHERE rssi >= -45), e AS (SELECT a.layer, a.gy*25+a.gx AS a, b.gy*25+b.gx AS b FROM m a JOIN m b ON a.layer=b.layer AND abs(a.gx-b.gx)+abs(a.gy-b.gy) <= 1),
r AS (SELECT layer, a, b FROM e UNION SELECT r.layer, r.a, e.b FROM r JOIN e ON e.layer=r.layer AND e.a=r.b), l AS (SELECT layer, CAST(a%25 AS INT) AS gx, CAST(a//25 AS INT) AS gy, min(b) AS label FROM r GROUP BY layer, a)"""
_RECURSIVE = READINGS.replace("WITH ", "WITH RECURSIVE ", 1)


def _coarse(spark, d):
    return V.readings(spark, d).where("rssi >= -45").select(F.col("band").alias("layer"), F.floor(F.col("x") / 40).cast("int").alias("gx"), F.floor(F.col("y") / 40).cast("int").alias("gy")).distinct()


@query(_RECURSIVE + _LABELS + " SELECT layer, label, count(*) AS area, min(gx) AS x0, max(gx) AS x1, min(gy) AS y0, max(gy) AS y1, round(sum(gx)/CAST(count(*) AS DOUBLE), 4) AS cx, round(sum(gy)/CAST(count(*) AS DOUBLE), 4) AS cy FROM l GROUP BY layer, label")
def component_table(spark, d):
    return raster.component_stats(raster.connected(_coarse(spark, d), 25, "layer"), "layer")


@query(_RECURSIVE + _LABELS + """, s AS (SELECT layer, label, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= 3), k AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n DESC, label) AS place, count(*) OVER (PARTITION BY layer) AS of FROM s)
SELECT layer, label, n, CASE WHEN of = 1 THEN 'Floor Area' ELSE 'Room ' || place END AS name FROM k WHERE place <= 18""")
def auto_rooms(spark, d):
    return coverage.auto_rooms(raster.connected(_coarse(spark, d), 25, "layer"), "layer", 3)


@query(_RECURSIVE + _LABELS + """, s AS (SELECT layer, label, count(*) AS n FROM l GROUP BY ALL) SELECT layer, min(label) AS label, max(n) AS area FROM s WHERE n = (SELECT max(n) FROM s t WHERE t.layer = s.layer) GROUP BY layer""")
def largest_component(spark, d):
    return coverage.largest(raster.component_stats(raster.connected(_coarse(spark, d), 25, "layer"), "layer"), ["layer"])


_ROOM_NAMES = "CASE c_custkey%5 WHEN 0 THEN 'Hall' WHEN 1 THEN 'Room ' || c_custkey WHEN 2 THEN 'room 0' || c_custkey || 'a' WHEN 3 THEN 'Wing ' || c_custkey%13 || ' Room ' || c_custkey ELSE 'Ático ' || c_custkey END"


@query(f"""SELECT c_custkey, name, CAST(row_number() OVER (ORDER BY array_to_string(list_transform(regexp_extract_all(strip_accents(name), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(CAST(length(CAST(CAST(p AS BIGINT) AS VARCHAR)) AS VARCHAR), 6, '0') || CAST(CAST(p AS BIGINT) AS VARCHAR) ELSE lower(p) END), ''), c_custkey) AS INT) AS place FROM (SELECT c_custkey, {_ROOM_NAMES} AS name FROM customer)""")
def room_order(spark, d):
    rows = V._table(spark, d, "customer").selectExpr("c_custkey", f"{_ROOM_NAMES} name")
    return coverage.natural_order(rows, "name", "c_custkey")


# --- walls and obstacles

_BARRIER = """, l AS (SELECT x0, y0, x1, y1, greatest(1, CAST(ceil(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))) AS INT)) AS n FROM walls), s AS (SELECT l.*, unnest(generate_series(0, n)) AS i FROM l),
p AS (SELECT DISTINCT CAST(floor(x0+(x1-x0)*(i/CAST(n AS DOUBLE))+0.5) AS INT) AS px, CAST(floor(y0+(y1-y0)*(i/CAST(n AS DOUBLE))+0.5) AS INT) AS py FROM s),
barrier AS (SELECT DISTINCT px+a.x AS gx, py+b.y AS gy FROM p, (VALUES (-3),(-2),(-1),(0),(1),(2),(3)) a(x), (VALUES (-3),(-2),(-1),(0),(1),(2),(3)) b(y) WHERE a.x*a.x+b.y*b.y <= 9 AND px+a.x BETWEEN 0 AND 999 AND py+b.y BETWEEN 0 AND 599)"""


@query(with_views("walls")[:-1] + _BARRIER + " SELECT gx, gy FROM barrier")
def barrier_mask(spark, d):
    return masks.barriers(V.walls(spark, d), 1000, 600, V.PX_PER_M)


_MATERIAL = "(CAST(4 AS DOUBLE)*CAST(1.18 AS DOUBLE)*CAST(0.1 AS DOUBLE)/CAST(0.12 AS DOUBLE))"


@query(with_views("walls", "aps")[:-1] + _BARRIER + f""", ry AS (SELECT ap_id, ax, ay, greatest(1, CAST(ceil(sqrt((500-ax)*(500-ax)+(300-ay)*(300-ay))/2.5) AS INT)) AS n FROM aps), rs AS (SELECT ry.*, unnest(generate_series(0, n)) AS i FROM ry),
h AS (SELECT ap_id, i, CASE WHEN b.gx IS NOT NULL THEN 1 END AS blocked FROM rs LEFT JOIN barrier b ON b.gx=CAST(floor(ax+(500-ax)*(i/CAST(n AS DOUBLE))+0.5) AS INT) AND b.gy=CAST(floor(ay+(300-ay)*(i/CAST(n AS DOUBLE))+0.5) AS INT)),
w AS (SELECT ap_id, blocked, CASE WHEN blocked=1 AND lag(blocked) OVER (PARTITION BY ap_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS st FROM h), c AS (SELECT ap_id, CAST(sum(st) AS BIGINT) AS runs, count(blocked) AS blocked FROM w GROUP BY ap_id)
SELECT ap_id, runs, blocked, round(CASE WHEN runs > 0 THEN runs*{_MATERIAL}*(CAST(0.44 AS DOUBLE)+CAST(0.22 AS DOUBLE)*CAST(0.22 AS DOUBLE))+least(12, blocked/CAST(20 AS DOUBLE)*{_MATERIAL}*(CAST(0.28 AS DOUBLE)+CAST(0.08 AS DOUBLE)*CAST(0.18 AS DOUBLE))) ELSE 0 END, 6) AS obstacle_db FROM c""")
def obstacle_losses(spark, d):
    rays = V.aps(spark, d).selectExpr("ap_id", "ax x", "ay y", "cast(500 as double) tx", "cast(300 as double) ty", "'5ghz' band")
    out = masks.obstacle_loss(rays, masks.barriers(V.walls(spark, d), 1000, 600, V.PX_PER_M), ["ap_id"], V.PX_PER_M)
    return out.select("ap_id", "runs", "blocked", F.round("obstacle_db", 6).alias("obstacle_db"))


@query(with_views("readings", "bins", "grid") + " SELECT band, gx, gy, round(min(sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty))), 6) AS distance_px FROM bins CROSS JOIN grid GROUP BY ALL")
def near_survey(spark, d):
    return interpolate.nearest_distance(_bins(spark, d), V.grid(spark), ["band"]).withColumn("distance_px", F.round("distance_px", 6))


# --- masks at pixels: the plan at a tenth of its size

_SMALL = ", q AS (SELECT band, first_idx, x/10 AS x, y/10 AS y FROM bins WHERE first_idx%10=0)"


def _small(spark, d):
    return _bins(spark, d).where("first_idx%10=0").selectExpr("band", "first_idx", "x/10 x", "y/10 y")


def _blur_sql(source: str, out: str, radius: int, w: int, h: int) -> str:
    kernel = ",".join(f"({k - radius},CAST({v!r} AS DOUBLE))" for k, v in enumerate(raster.gaussian_kernel(radius)))
    return f""", {out}k(o, w) AS (VALUES {kernel}), {out}g AS (SELECT band, x.i AS gx, y.i AS gy FROM (SELECT DISTINCT band FROM {source}), range({w}) x(i), range({h}) y(i)),
{out}h AS (SELECT g.band, g.gx, g.gy, sum(s.v*w) AS v FROM {out}g g, {out}k LEFT JOIN {source} s ON s.band=g.band AND s.gy=g.gy AND s.gx=least(greatest(g.gx+o,0),{w - 1}) GROUP BY ALL),
{out} AS (SELECT g.band, g.gx, g.gy, sum(h.v*w) AS v FROM {out}g g, {out}k LEFT JOIN {out}h h ON h.band=g.band AND h.gx=g.gx AND h.gy=least(greatest(g.gy+o,0),{h - 1}) GROUP BY ALL)"""


@query(BINS + _SMALL + """, o AS (SELECT DISTINCT band, CAST(least(greatest(floor(x/2),0),49) AS INT) AS cx, CAST(least(greatest(floor(y/2),0),29) AS INT) AS cy FROM q),
w AS (SELECT DISTINCT band, cx+a.i AS cx, cy+b.i AS cy FROM o, range(-3,4) a(i), range(-3,4) b(i) WHERE a.i*a.i+b.i*b.i <= 9 AND cx+a.i BETWEEN 0 AND 49 AND cy+b.i BETWEEN 0 AND 29), p AS (SELECT band, cx*2+a.i AS gx, cy*2+b.i AS gy, CAST(255 AS DOUBLE) AS v FROM w, range(2) a(i), range(2) b(i))""" + _blur_sql("p", "z", 2, 100, 60) + " SELECT band, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, CAST(floor(round(v, 10)+0.5) AS INT) AS alpha FROM z WHERE floor(round(v, 10)+0.5) > 0")
def dense_coverage(spark, d):
    return masks.dense_coverage(_small(spark, d), 100, 60, 5.0, ["band"])




def intersect_sql(p: tuple[str, ...], q: tuple[str, ...]) -> str:
    """Whether two segments (x0, y0, x1, y1) meet, touching ones included."""
    turn = lambda a, b, c: f"(CASE WHEN abs(({b[1]}-{a[1]})*({c[0]}-{b[0]})-({b[0]}-{a[0]})*({c[1]}-{b[1]})) < 1e-9 THEN 0 ELSE sign(({b[1]}-{a[1]})*({c[0]}-{b[0]})-({b[0]}-{a[0]})*({c[1]}-{b[1]})) END)"
    on = lambda a, b, c: f"({c[0]} BETWEEN least({a[0]},{b[0]})-1e-9 AND greatest({a[0]},{b[0]})+1e-9 AND {c[1]} BETWEEN least({a[1]},{b[1]})-1e-9 AND greatest({a[1]},{b[1]})+1e-9)"
    a, b, c, e = p[:2], p[2:], q[:2], q[2:]
    return f"(({turn(a, b, c)} <> {turn(a, b, e)} AND {turn(c, e, a)} <> {turn(c, e, b)}) OR ({turn(a, b, c)}=0 AND {on(a, b, c)}) OR ({turn(a, b, e)}=0 AND {on(a, b, e)}) OR ({turn(c, e, a)}=0 AND {on(c, e, a)}) OR ({turn(c, e, b)}=0 AND {on(c, e, b)}))"


@query(with_views("readings", "bins", "walls")[:-1] + _SMALL + f""", v AS (SELECT x0/10 AS x0, y0/10 AS y0, x1/10 AS x1, y1/10 AS y1 FROM walls),
n AS (SELECT band, first_idx, x, y, a.i AS gx, b.i AS gy, a.i//3*3.0::DOUBLE+1.5 AS tx, b.i//3*3.0::DOUBLE+1.5 AS ty, sqrt((a.i-x)*(a.i-x)+(b.i-y)*(b.i-y)) AS far FROM q, range(100) a(i), range(60) b(i) WHERE sqrt((a.i-x)*(a.i-x)+(b.i-y)*(b.i-y)) <= 8),
r AS (SELECT DISTINCT band, first_idx, x, y, tx, ty FROM n), bl AS (SELECT DISTINCT band, first_idx, tx, ty FROM r JOIN v ON NOT (greatest(v.x0,v.x1)+2 < least(r.x,r.tx) OR least(v.x0,v.x1)-2 > greatest(r.x,r.tx) OR greatest(v.y0,v.y1)+2 < least(r.y,r.ty) OR least(v.y0,v.y1)-2 > greatest(r.y,r.ty)) AND {intersect_sql(('r.x', 'r.y', 'r.tx', 'r.ty'), ('v.x0', 'v.y0', 'v.x1', 'v.y1'))}),
k AS (SELECT n.* FROM n ANTI JOIN bl USING (band, first_idx, tx, ty)), a AS (SELECT band, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, CAST(max(floor((1-{_smooth('6', '8', 'far')})*255+0.5)) AS INT) AS alpha FROM k GROUP BY ALL) SELECT * FROM a WHERE alpha > 0""")
def influence_mask(spark, d):
    small = V.walls(spark, d).selectExpr("x0/10 x0", "y0/10 y0", "x1/10 x1", "y1/10 y1")
    return masks.influence(_small(spark, d), small, 100, 60, 8.0, 2.0, ["band"], "first_idx")


_VALID = ", va AS (SELECT a.i AS gx, b.i AS gy FROM range(100) a(i), range(60) b(i) WHERE a.i%11 > 2 AND b.i%7 > 1)"


def _valid(spark):
    return spark.range(6000).selectExpr("cast(id%100 as int) gx", "cast(id div 100 as int) gy").where("gx%11 > 2 and gy%7 > 1")


_SEEDS = """, sd AS (SELECT q.band, q.first_idx, min({'ring': greatest(abs(a.i), abs(b.i)), 'd': a.i*a.i+b.i*b.i, 'dy': b.i, 'dx': a.i, 'gx': va.gx, 'gy': va.gy}) AS s FROM q, range(-4,5) a(i), range(-4,5) b(i), va
WHERE va.gx=least(greatest(floor(q.x+0.5),0),99)+a.i AND va.gy=least(greatest(floor(q.y+0.5),0),59)+b.i GROUP BY ALL)"""


@query(BINS + _SMALL + _VALID + _SEEDS + " SELECT band, first_idx, CAST(s.gx AS INT) AS gx, CAST(s.gy AS INT) AS gy FROM sd")
def seed_cells(spark, d):
    points = _small(spark, d)
    valid = _valid(spark).crossJoin(F.broadcast(points.select("band").distinct()))  # one row to a band
    return masks.seeds(points, valid, 100, 60, ["band"], "first_idx")


@query(BINS + _SMALL + _VALID + _SEEDS + """, t AS (SELECT DISTINCT band, s.gx//11 AS cx, s.gy//7 AS cy FROM sd) SELECT DISTINCT band, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy FROM (SELECT t.band, va.gx, va.gy FROM t JOIN va ON va.gx//11=t.cx AND va.gy//7=t.cy
UNION ALL SELECT band, a.i, b.i FROM (SELECT DISTINCT band FROM q), range(100) a(i), range(60) b(i) WHERE NOT (a.i%11 > 2 AND b.i%7 > 1))""")
def measured_rooms(spark, d):
    points = _small(spark, d)
    bands = F.broadcast(points.select("band").distinct())  # one row to a band
    valid = _valid(spark).crossJoin(bands)
    barrier = spark.range(6000).selectExpr("cast(id%100 as int) gx", "cast(id div 100 as int) gy").where("not (gx%11 > 2 and gy%7 > 1)").crossJoin(bands)
    labelled = raster.connected(valid, 100, "band")
    return masks.measured(labelled, masks.seeds(points, valid, 100, 60, ["band"], "first_idx"), barrier, ["band"])


@query(BINS + """, q AS (SELECT DISTINCT CAST(least(greatest(floor(x/10+0.5),0),99) AS INT) AS gx, CAST(least(greatest(floor(y/10+0.5),0),59) AS INT) AS gy FROM bins WHERE first_idx%50=0),
e AS (SELECT CAST(a.i AS INT) AS gx, CAST(b.i AS INT) AS gy, CAST(CASE WHEN a.i%11 > 2 AND b.i%7 > 1 THEN 1+a.i//11+10*(b.i//7) ELSE 0 END AS INT) AS region FROM range(100) a(i), range(60) b(i)), pr AS (SELECT q.*, region FROM q JOIN e USING (gx, gy)),
hit AS (SELECT region FROM pr WHERE region > 0 UNION SELECT e.region FROM pr, range(-3,4) a(i), range(-3,4) b(i), e WHERE pr.region=0 AND e.gx=least(greatest(pr.gx+a.i,0),99) AND e.gy=least(greatest(pr.gy+b.i,0),59) AND e.region > 0) SELECT gx, gy FROM e WHERE region=0 OR region IN (SELECT region FROM hit)""")
def colored_rooms(spark, d):
    regions = spark.range(6000).selectExpr("cast(id%100 as int) gx", "cast(id div 100 as int) gy").selectExpr("gx", "gy", "cast(case when gx%11 > 2 and gy%7 > 1 then 1 + gx div 11 + 10*(gy div 7) else 0 end as int) region")
    return masks.colored_rooms(regions, _bins(spark, d).where("first_idx%50=0").selectExpr("x/10 x", "y/10 y"), 100, 60)


# --- images

PIXELS = with_views("pixels")


@query(PIXELS + ", s AS (SELECT max(gy)+1 AS h FROM pixels), n AS (SELECT p.*, ((gy=0)::INT+(gy=h-1)::INT)+(CASE WHEN gy%greatest(1,h//80)=0 THEN (gx=0)::INT+(gx=39)::INT ELSE 0 END) AS n FROM pixels p, s) SELECT round(sum(r*n)/CAST(sum(n) AS DOUBLE),6) AS r, round(sum(g*n)/CAST(sum(n) AS DOUBLE),6) AS g, round(sum(b*n)/CAST(sum(n) AS DOUBLE),6) AS b FROM n")
def edge_background(spark, d):
    p = V.pixels(spark, d)
    height = p.agg(F.max("gy")).first()[0] + 1
    return masks.edge_background(p, 40, height).select(*(F.round(c, 6).alias(c) for c in "rgb"))


@query(PIXELS + """, x AS (SELECT *, greatest(r,g,b) AS hi, least(r,g,b) AS lo FROM pixels) SELECT gx, gy, round((CAST(0.2126 AS DOUBLE)*r+CAST(0.7152 AS DOUBLE)*g+CAST(0.0722 AS DOUBLE)*b)/255, 9) AS luminance, round(CASE WHEN hi > 0 THEN (hi-lo)/CAST(hi AS DOUBLE) ELSE 0 END, 9) AS saturation,
round((CASE WHEN hi=lo THEN 0 WHEN hi=r THEN CAST(60 AS DOUBLE)*(g-b)/(hi-lo) WHEN hi=g THEN CAST(60 AS DOUBLE)*(CAST(b-r AS DOUBLE)/(hi-lo)+2) ELSE CAST(60 AS DOUBLE)*(CAST(r-g AS DOUBLE)/(hi-lo)+4) END+360)%360, 6) AS hue, round(sqrt((r-255)*(r-255)+(g-255)*(g-255)+(b-255)*(b-255)), 6) AS from_white, CASE WHEN CAST(0.2126 AS DOUBLE)*r+CAST(0.7152 AS DOUBLE)*g+CAST(0.0722 AS DOUBLE)*b < 200 THEN 0 ELSE 255 END AS enhanced FROM x""")
def pixel_colors(spark, d):
    at = (F.col("r"), F.col("g"), F.col("b"))
    away = F.sqrt(sum((F.col(c) - 255) * (F.col(c) - 255) for c in "rgb"))
    light = scores.luminance(*at)
    return V.pixels(spark, d).select("gx", "gy", F.round(light / 255, 9).alias("luminance"), F.round(scores.saturation(*at), 9).alias("saturation"), F.round(scores.hue_degrees(*at), 6).alias("hue"), F.round(away, 6).alias("from_white"), F.when(light < 200, 0).otherwise(255).alias("enhanced"))


@query(PIXELS + "SELECT CAST(gx//8 AS INT) AS cx, CAST(gy//8 AS INT) AS cy, round(count(*) FILTER (r < 40)/CAST(count(*) AS DOUBLE), 9) AS share, count(*) FILTER (r < 40)/CAST(count(*) AS DOUBLE) >= 0.035 AS dense FROM pixels WHERE gx%8%2=0 AND gy%8%2=0 GROUP BY ALL")
def dark_cells(spark, d):
    return masks.dark_shares(V.pixels(spark, d), F.col("r") < 40, 8, 2).withColumn("share", F.round("share", 9))


@query(PIXELS + ", s AS (SELECT max(gy)+1 AS h FROM pixels), o AS (SELECT p.gx, p.gy, x.i AS dx, y.i AS dy FROM pixels p, range(-2,3) x(i), range(-2,3) y(i)), v AS (SELECT o.gx, o.gy, list_sort(list(n.r)) AS l FROM o, s JOIN pixels n ON n.gx=least(greatest(o.gx+o.dx,0),39) AND n.gy=least(greatest(o.gy+o.dy,0),s.h-1) GROUP BY ALL) SELECT gx, gy, l[13] AS r FROM v")
def median_pixels(spark, d):
    p = V.pixels(spark, d)
    return masks.median_filter(p.select("gx", "gy", "r"), 40, p.agg(F.max("gy")).first()[0] + 1, 2, "r")


_FOOT = """, m AS (SELECT DISTINCT CAST(floor(x/8) AS INT) AS gx, CAST(floor(y/8) AS INT) AS gy FROM readings WHERE rssi >= -25 AND x > 100)"""


def _fill_sql(line: str, along: str, out: str) -> str:
    return f""", {out}e AS (SELECT {line} AS l, min({along}) AS lo, max({along}) AS hi FROM m GROUP BY 1), {out}n AS (SELECT *, lead(l) OVER (ORDER BY l)-l AS gap, lead(lo) OVER (ORDER BY l) AS lo2, lead(hi) OVER (ORDER BY l) AS hi2 FROM {out}e),
{out} AS (SELECT l, lo, hi FROM {out}e UNION ALL SELECT l+k, CAST(floor(lo+(lo2-lo)*(k/CAST(gap AS DOUBLE))+0.5) AS INT), CAST(floor(hi+(hi2-hi)*(k/CAST(gap AS DOUBLE))+0.5) AS INT) FROM {out}n, range(1,6) t(k) WHERE gap BETWEEN 2 AND 6 AND k < gap)"""


@query(READINGS + _FOOT + _fill_sql("gy", "gx", "fr") + _fill_sql("gx", "gy", "fc") + " SELECT CAST(g.i AS INT) AS gx, CAST(fr.l AS INT) AS gy FROM fr, range(125) g(i) JOIN fc ON fc.l=g.i WHERE g.i BETWEEN fr.lo-1 AND fr.hi+1 AND fr.l BETWEEN fc.lo-1 AND fc.hi+1")
def footprint(spark, d):
    cells = V.readings(spark, d).where("rssi >= -25 and x > 100").select(F.floor(F.col("x") / 8).cast("int").alias("gx"), F.floor(F.col("y") / 8).cast("int").alias("gy")).distinct()
    return masks.footprint(cells, 125, 75)


@query(with_views("readings", "rooms") + """, c AS (SELECT band, CAST(floor(x/20) AS INT) AS gx, CAST(floor(y/20) AS INT) AS gy FROM readings) SELECT room_id, band, count(c.gx) AS inside FROM rooms CROSS JOIN (SELECT DISTINCT band FROM readings) b LEFT JOIN c USING (band) WHERE gx >= CAST(rx0/20 AS INT) AND gx < CAST(rx1/20 AS INT) AND gy >= 2 AND gy < 28 GROUP BY ALL""")
def rect_sums(spark, d):
    r = V.readings(spark, d)
    counts = r.groupBy("band", F.floor(F.col("x") / 20).cast("int").alias("gx"), F.floor(F.col("y") / 20).cast("int").alias("gy")).agg(F.count(F.lit(1)).alias("value"))
    bands = F.broadcast(r.select("band").distinct())  # one row to a band
    full = V.grid(spark).select("gx", "gy").join(bands).join(counts, ["band", "gx", "gy"], "left").na.fill(0, ["value"])
    corner = lambda i, c: F.round(F.col("polygon")[i][c] / 20).cast("int")
    boxes = V.rooms(spark, d).select("room_id", corner(0, "x").alias("x0"), F.lit(2).alias("y0"), corner(1, "x").alias("x1"), F.lit(28).alias("y1")).join(bands)
    return raster.box_sums(raster.summed_area(full, ["band"]), boxes, ["band"]).select("room_id", "band", "inside")


# --- painting

def color_sql(v: str, relation: str, keys: str) -> str:
    """A query that gives ``relation``'s keys and the colour (r, g, b) of a signal ``v``."""
    stops = {c: "[" + ",".join(f"CAST({x[k]} AS DOUBLE)" for x in scores.COLORS) + "]" for k, c in enumerate("rgb")}
    linear = lambda e: f"CASE WHEN {e}/255 <= 0.04045 THEN {e}/255/12.92 ELSE pow(({e}/255+CAST(0.055 AS DOUBLE))/CAST(1.055 AS DOUBLE), CAST(2.4 AS DOUBLE)) END"
    mixed = ", ".join(f"({linear(f'({s})[i+1]')})*(1-t)+({linear(f'({s})[i+2]')})*t AS l{c}" for c, s in stops.items())
    back = ", ".join(f"CAST(floor(CASE WHEN l{c} <= 0.0031308 THEN l{c}*12.92 ELSE pow(l{c}, 1/CAST(2.4 AS DOUBLE))*CAST(1.055 AS DOUBLE)-CAST(0.055 AS DOUBLE) END*255+0.5) AS INT) AS {c}" for c in "rgb")
    return f"""SELECT {keys}, {back} FROM (SELECT *, {mixed} FROM (SELECT *, p-i AS t FROM (SELECT *, CAST(least(floor(p), 10) AS INT) AS i FROM (SELECT *, least(greatest(({v}+80)/(CAST(60 AS DOUBLE)/11), 0), 11) AS p FROM {relation}))))"""


@query(READINGS + color_sql("rssi", "readings", "row_idx"))
def rssi_color(spark, d):
    return V.readings(spark, d).select("row_idx", scores.rssi_color(F.col("rssi")).alias("c")).select("row_idx", "c.*")


@query(READINGS + """, s AS (SELECT row_idx, rssi, (row_idx%100)/CAST(100 AS DOUBLE) AS cov, (row_idx%7)*CAST(0.05 AS DOUBLE) AS sh FROM readings) SELECT row_idx, CAST(floor(round(least(greatest(CAST(0.74 AS DOUBLE)+cov*CAST(0.22 AS DOUBLE)+CASE WHEN rssi <= -85 THEN CAST(0.06 AS DOUBLE) ELSE 0 END+CASE WHEN rssi <= -82 THEN CAST(0.08 AS DOUBLE) ELSE 0 END-sh*CAST(0.04 AS DOUBLE), 0), CAST(0.98 AS DOUBLE))*255, 9)+0.5) AS INT) AS a FROM s WHERE cov > 0.025""")
def painted_cells(spark, d):
    cells = V.readings(spark, d).selectExpr("row_idx", "rssi", "(row_idx%100)/100D alpha", "(row_idx%7)*0.05D shadow")
    return scores.painted(cells).select("row_idx", "a")


@query(READINGS + """, k AS (SELECT row_idx, rssi, CASE WHEN rssi >= -67 THEN 100.0::DOUBLE ELSE 0 END AS cov, CASE WHEN rssi <= -85 THEN 100.0::DOUBLE ELSE 0 END AS dd, CASE WHEN rssi < -75 THEN 100.0::DOUBLE ELSE 0 END AS wk, band FROM readings),
q AS (SELECT *, floor((least(greatest((rssi+90)/60*100,0),100)*CAST(0.46 AS DOUBLE)+cov*CAST(0.42 AS DOUBLE)+(100-dd)*CAST(0.12 AS DOUBLE))*10+0.5)/10 AS channel_quality FROM k)
SELECT row_idx, band, rssi, CASE WHEN rssi >= -50 THEN 'excellent' WHEN rssi >= -67 THEN 'good' WHEN rssi >= -75 THEN 'fair' WHEN rssi > -85 THEN 'weak' ELSE 'dead' END AS class, CASE WHEN rssi >= -45 THEN 940 WHEN rssi >= -55 THEN 720 WHEN rssi >= -65 THEN 420 WHEN rssi >= -72 THEN 190 WHEN rssi >= -80 THEN 55 ELSE 8 END AS throughput_mbps,
floor(least(80, CASE WHEN rssi >= -55 THEN 0 ELSE abs(rssi+55)*CAST(0.28 AS DOUBLE) END+CAST(4.2 AS DOUBLE)+wk*CAST(0.05 AS DOUBLE)+dd*CAST(0.14 AS DOUBLE))*10+0.5)/10 AS latency_ms, channel_quality, floor(least(100, cov*CAST(0.72 AS DOUBLE)+channel_quality*CAST(0.28 AS DOUBLE))*10+0.5)/10 AS roaming FROM q""")
def point_coverage(spark, d):
    return coverage.point_table(V.readings(spark, d), ["row_idx", "band"])



@query(with_views("plans") + """, n AS (SELECT *, site%700 AS n FROM plans), t AS (SELECT *, CASE WHEN n > 120 THEN 26000 WHEN n > 64 THEN 62000 ELSE 90000 END AS cells, CASE WHEN n > 120 THEN 24 WHEN n > 64 THEN 48 ELSE n END AS k FROM n)
SELECT site, CAST(least(greatest(greatest(least(greatest(floor(greatest(width,height)/980+0.5),3),6), ceil(sqrt(width*height/cells))),3), CASE WHEN n > 120 THEN 14 ELSE 10 END) AS INT) AS step, CAST(k AS BIGINT) AS neighbours, round(least(greatest(greatest(width,height)/65,13),22),9) AS blur_px, round(least(greatest(greatest(width,height)/900,CAST(1.2 AS DOUBLE)),CAST(4.5 AS DOUBLE)),9) AS feather_px,
round(least(1, CASE WHEN n > 120 THEN 900 ELSE 1200 END/greatest(width,height)), 9) AS factor FROM t""")
def layer_settings(spark, d):
    n = F.expr("site%700")
    s = interpolate.settings(F.col("width"), F.col("height"), n)
    return V.plans(spark, d).select("site", s["step"].alias("step"), s["neighbours"].alias("neighbours"), *(F.round(s[c], 9).alias(c) for c in ("blur_px", "feather_px", "factor")))
