"""Queries that detect walls in drawn plans, with their SQL written from the survey's rules, step upon step."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sigfield.operators import crop, walls
from sigfield.plans import views as V
from sigfield.plans.registry import query
from sigfield.runtime import cut, spread

# a drawn plan has 160 x 120 pixels: scale 1, band 2, gap 4, least length 18, cross gap 6, wide gap 12, frame 8,
# junctions within 8, parallels within 10, graph within 10
_MASK = "WITH RECURSIVE " + V.SQL["drawings"] + """, pl AS (SELECT DISTINCT (p_partkey-1)//20 AS plan FROM part),
edge AS (SELECT plan, r, g, b, (CASE WHEN gx%2=0 THEN (gy=0)::INT+(gy=119)::INT ELSE 0 END)+(CASE WHEN gy%1=0 THEN (gx=0)::INT+(gx=159)::INT ELSE 0 END) AS n FROM drawings WHERE a > 24),
bgs AS (SELECT plan, sum(r*n)/CAST(sum(n) AS DOUBLE) AS br, sum(g*n)/CAST(sum(n) AS DOUBLE) AS bg, sum(b*n)/CAST(sum(n) AS DOUBLE) AS bb FROM edge WHERE n > 0 GROUP BY plan),
col AS (SELECT d.*, sqrt((r-coalesce(br,255))**2+(g-coalesce(bg,255))**2+(b-coalesce(bb,255))**2) AS far, (CAST(0.2126 AS DOUBLE)*r+CAST(0.7152 AS DOUBLE)*g+CAST(0.0722 AS DOUBLE)*b)/255 AS light, CASE WHEN greatest(r,g,b) > 0 THEN (greatest(r,g,b)-least(r,g,b))/CAST(greatest(r,g,b) AS DOUBLE) ELSE 0 END AS vivid FROM drawings d LEFT JOIN bgs USING (plan) WHERE a > 24),
tr AS MATERIALIZED (SELECT * FROM col WHERE far > 42 OR light < 0.74 OR (vivid > 0.24 AND far > 30)),
mask AS MATERIALIZED (SELECT plan, gx, gy FROM tr t WHERE EXISTS (SELECT 1 FROM tr u WHERE u.plan=t.plan AND u.gx BETWEEN t.gx-1 AND t.gx+1 AND u.gy BETWEEN t.gy-1 AND t.gy+1 AND (u.gx, u.gy) <> (t.gx, t.gy)))"""
_MASK = _MASK.replace("WHERE EXISTS (SELECT 1 FROM tr u WHERE u.plan=t.plan AND u.gx BETWEEN t.gx-1 AND t.gx+1 AND u.gy BETWEEN t.gy-1 AND t.gy+1 AND (u.gx, u.gy) <> (t.gx, t.gy))", "SEMI JOIN (SELECT plan, gx+x.i AS gx, gy+y.i AS gy FROM tr, range(-1,2) x(i), range(-1,2) y(i) WHERE x.i <> 0 OR y.i <> 0) u USING (plan, gx, gy)")

_CANDIDATES = _MASK + """, lines AS (SELECT plan, 'horizontal' AS o, gy+t.i AS c, gx AS i, 120 AS lim, 160 AS along FROM mask, range(-2,3) t(i) WHERE gy+t.i BETWEEN 0 AND 119 UNION ALL SELECT plan, 'vertical', gx+t.i, gy, 160, 120 FROM mask, range(-2,3) t(i) WHERE gx+t.i BETWEEN 0 AND 159),
hits AS (SELECT plan, o, c, i, lim, along, count(*) AS n FROM lines GROUP BY ALL), fresh AS (SELECT *, coalesce(i-lag(i) OVER w > 5, true) AS f FROM hits WINDOW w AS (PARTITION BY plan, o, c ORDER BY i)),
runs AS (SELECT *, sum(f::INT) OVER (PARTITION BY plan, o, c ORDER BY i) AS run FROM fresh),
runs2 AS (SELECT plan, o, c, lim, min(i) AS s, CASE WHEN along-1-max(i) <= 4 THEN along-1 ELSE max(i) END AS e, sum(n) AS px FROM runs GROUP BY plan, o, c, lim, along, run),
cand0 AS (SELECT plan, o, s, e, greatest(0, c-2) AS c0, least(lim-1, c+2) AS c1, px FROM runs2 WHERE e-s+1 >= 18),
cand AS MATERIALIZED (SELECT plan, o, s, e, c0, c1, px/CAST((e-s+1)*(c1-c0+1) AS DOUBLE) AS score FROM cand0 WHERE px/CAST((e-s+1)*(c1-c0+1) AS DOUBLE) BETWEEN 0.06 AND 0.92)"""


def _fold_sql(source: str, out: str, order: str, wide: int) -> str:
    """A sequential greedy fold of each plan and orientation: state m, a list of groups in order of their beginnings."""
    return f""", {out}o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY plan, o ORDER BY {order}) AS k, count(*) OVER (PARTITION BY plan, o) AS n FROM {source}),
{out}r AS (SELECT plan, o, k, n, [{{'s': s, 'e': e, 'c0': c0, 'c1': c1, 'score': score, 'k': k}}] AS m FROM {out}o WHERE k = 1 UNION ALL
SELECT plan, o, k, n, CASE WHEN p IS NULL THEN list_append(m, x) ELSE list_concat(list_concat(m[1:p-1], [{{'s': least(m[p].s, x.s), 'e': greatest(m[p].e, x.e), 'c0': least(m[p].c0, x.c0), 'c1': greatest(m[p].c1, x.c1), 'score': greatest(m[p].score, x.score), 'k': m[p].k}}]), m[p+1:]) END
FROM (SELECT f.plan, f.o, c.k, c.n, f.m, {{'s': c.s, 'e': c.e, 'c0': c.c0, 'c1': c.c1, 'score': c.score, 'k': c.k}} AS x, list_position(list_transform(f.m, lambda g: abs(g.c0+g.c1-c.c0-c.c1) <= {2 * wide} AND least(g.e, c.e)-greatest(g.s, c.s) >= -4), true) AS p FROM {out}r f JOIN {out}o c ON c.plan = f.plan AND c.o = f.o AND c.k = f.k+1)),
{out} AS MATERIALIZED (SELECT plan, o, g.s AS s, g.e AS e, g.c0 AS c0, g.c1 AS c1, g.score AS score, g.k AS k FROM (SELECT plan, o, unnest(m) AS g FROM {out}r WHERE k = n))"""


_SHAPE = "(e-s+1)/CAST(greatest(c1-c0+1, 1) AS DOUBLE) >= 4.8 AND c1-c0+1 <= greatest(18, (e-s+1)*CAST(0.2 AS DOUBLE))"
_SEGMENTS = _CANDIDATES + _fold_sql("cand", "f1", "c0+c1, s", 6) + f", f1s AS (SELECT plan, o, s, e, c0, c1, score, k AS k1 FROM f1 WHERE {_SHAPE})" + _fold_sql("f1s", "f2", "c0+c1, s, k1", 12)

_FRAME = "(c <= 8 OR c >= CASE WHEN o='horizontal' THEN 120 ELSE 160 END-8 OR s <= 8 OR e >= CASE WHEN o='horizontal' THEN 160 ELSE 120 END-8)"


def _meet(a: str, b: str, t: int) -> str:
    one = lambda h, v: f"{h}.o='horizontal' AND {v}.o='vertical' AND {v}.c BETWEEN {h}.s-{t} AND {h}.e+{t} AND {h}.c BETWEEN {v}.s-{t} AND {v}.e+{t}"
    return f"(({one(a, b)}) OR ({one(b, a)}))"


_GRAPH = _SEGMENTS + f""", seg AS (SELECT *, e-s+1 AS len, (c0+c1)/CAST(2 AS DOUBLE) AS c, row_number() OVER (PARTITION BY plan ORDER BY o, k) AS id FROM f2),
jn AS (SELECT a.plan, a.id, count(*) FILTER ({_meet('a', 'b', 8)}) AS j, count(*) FILTER (a.o=b.o AND abs(a.c-b.c) <= 10 AND (least(a.e,b.e)-greatest(a.s,b.s)+1)/CAST(least(a.len,b.len) AS DOUBLE) > 0.54) AS p FROM seg a JOIN seg b ON a.plan=b.plan AND a.id<>b.id GROUP BY ALL),
st AS MATERIALIZED (SELECT seg.*, {_FRAME} AS touch FROM seg LEFT JOIN jn USING (plan, id) WHERE len >= 18 AND {_SHAPE} AND (({_FRAME} AND len >= 160*CAST(0.16 AS DOUBLE)) OR (len >= 160*CAST(0.09 AS DOUBLE) AND coalesce(j,0) >= 1) OR (len >= 18*CAST(2.1 AS DOUBLE) AND coalesce(j,0) >= 2)) AND NOT (coalesce(p,0) >= 2 AND len < 160*CAST(0.28 AS DOUBLE) AND NOT {_FRAME})),
ends AS (SELECT plan, id, CASE WHEN o='horizontal' THEN s ELSE c END AS x, CASE WHEN o='horizontal' THEN c ELSE s END AS y FROM st UNION ALL SELECT plan, id, CASE WHEN o='horizontal' THEN e ELSE c END, CASE WHEN o='horizontal' THEN c ELSE e END FROM st),
xs AS (SELECT a.plan, a.id AS a, b.id AS b FROM st a JOIN st b ON a.plan=b.plan AND a.id<>b.id WHERE {_meet('a', 'b', 10)}),
lk AS (SELECT * FROM xs UNION SELECT a.plan, a.id, b.id FROM ends a JOIN ends b ON a.plan=b.plan AND a.id<>b.id WHERE sqrt((a.x-b.x)**2+(a.y-b.y)**2) <= 15),
reach AS (SELECT plan, id, id AS t FROM st UNION SELECT r.plan, r.id, lk.b FROM reach r JOIN lk ON lk.plan=r.plan AND lk.a=r.t),
comp AS (SELECT plan, id, min(t) AS component FROM reach GROUP BY plan, id), stc AS (SELECT st.*, component, (SELECT count(*) FROM xs WHERE xs.plan=st.plan AND xs.a=st.id) AS j FROM st JOIN comp USING (plan, id)),
sums AS (SELECT plan, component, count(*) AS members, sum(len) AS total, count(*) FILTER (touch) AS touching, sum(j) AS j FROM stc GROUP BY ALL),
ok AS (SELECT *, CASE WHEN members=1 THEN touching > 0 AND total >= 160*CAST(0.28 AS DOUBLE) ELSE total >= 160*CAST(0.26 AS DOUBLE) AND (touching > 0 OR j >= 2) END AS main FROM sums),
best AS (SELECT *, bool_or(main) OVER (PARTITION BY plan) AS has_main, row_number() OVER (PARTITION BY plan ORDER BY total DESC, component) AS place FROM ok),
gr AS MATERIALIZED (SELECT stc.*, members FROM stc JOIN best USING (plan, component) WHERE main OR (NOT has_main AND place=1 AND total >= 160*CAST(0.26 AS DOUBLE)))"""

_TENTH = "floor({}*10+0.5)/10"
_WALLS = _GRAPH + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY len*score DESC, component, id) AS number FROM gr),
wl AS MATERIALIZED (SELECT plan, number, {_TENTH.format("CASE WHEN o='horizontal' THEN s ELSE least(c+0.5, 159) END")} AS x0, {_TENTH.format("CASE WHEN o='horizontal' THEN least(c+0.5, 119) ELSE s END")} AS y0, {_TENTH.format("CASE WHEN o='horizontal' THEN e ELSE least(c+0.5, 159) END")} AS x1, {_TENTH.format("CASE WHEN o='horizontal' THEN least(c+0.5, 119) ELSE e END")} AS y1 FROM rk WHERE number <= 110)"""

_PROFILES = _WALLS + """, ln AS (SELECT *, sqrt((x1-x0)**2+(y1-y0)**2) AS len, CAST(greatest(1, ceil(sqrt((x1-x0)**2+(y1-y0)**2)/2)) AS INT) AS steps FROM wl),
lk2 AS (SELECT plan, number, steps, t.i AS i, floor(x0+(x1-x0)*(t.i/CAST(steps AS DOUBLE))-(y1-y0)/len*u.i+0.5) AS gx, floor(y0+(y1-y0)*(t.i/CAST(steps AS DOUBLE))+(x1-x0)/len*u.i+0.5) AS gy FROM ln, range(0,200) t(i), range(-5,6) u(i) WHERE len >= 8 AND t.i <= steps),
hue AS (SELECT plan, gx, gy, light, vivid, (CASE WHEN greatest(r,g,b)=least(r,g,b) THEN 0 WHEN greatest(r,g,b)=r THEN CAST(60 AS DOUBLE)*(g-b)/(greatest(r,g,b)-least(r,g,b)) WHEN greatest(r,g,b)=g THEN CAST(60 AS DOUBLE)*(CAST(b-r AS DOUBLE)/(greatest(r,g,b)-least(r,g,b))+2) ELSE CAST(60 AS DOUBLE)*(CAST(r-g AS DOUBLE)/(greatest(r,g,b)-least(r,g,b))+4) END+360)%360 AS hue FROM tr),
sm AS (SELECT plan, number, steps, i, count(vivid) AS n, sum(CAST(coalesce(vivid, 0) AS DECIMAL(28,9))) AS vs, count(*) FILTER (vivid >= 0.18 AND hue BETWEEN 175 AND 230) AS blue, count(*) FILTER (vivid >= 0.16 AND (hue <= 24 OR hue >= 350)) AS red, count(*) FILTER (vivid >= 0.16 AND hue > 24 AND hue <= 58) AS brown, count(*) FILTER (vivid < 0.18) AS neutral, count(*) FILTER (vivid < 0.2 AND light < 0.34) AS dark FROM lk2 LEFT JOIN hue USING (plan, gx, gy) GROUP BY ALL),
sb AS (SELECT *, n > 0 AND lag(n, 1, 0) OVER (PARTITION BY plan, number ORDER BY i) = 0 AS begins FROM sm),
pf AS MATERIALIZED (SELECT plan, number, count(*) FILTER (n > 0)/CAST(max(steps)+1 AS DOUBLE) AS coverage, sum(n)/CAST(count(*) FILTER (n > 0) AS DOUBLE) AS thickness, CAST(sum(vs) AS DOUBLE)/sum(n) AS saturation, sum(blue)/CAST(sum(n) AS DOUBLE) AS blue, sum(red)/CAST(sum(n) AS DOUBLE) AS red, sum(brown)/CAST(sum(n) AS DOUBLE) AS brown, sum(neutral)/CAST(sum(n) AS DOUBLE) AS neutral, sum(dark)/CAST(sum(n) AS DOUBLE) AS dark, (count(*) FILTER (begins)-1)/CAST(max(steps) AS DOUBLE) AS gaps FROM sb GROUP BY plan, number HAVING sum(n) > 0)"""

_D = "CAST({} AS DOUBLE)".format
_BASE = f"least(greatest({_D(0.4)}+coverage*{_D(0.38)}, {_D(0.32)}), {_D(0.8)})"
_FOUND = _PROFILES + f""", mt AS (SELECT plan, number, coverage, thickness, coverage < 0.12 AS weak, CASE WHEN coverage < 0.12 THEN 'drywall' WHEN blue > 0.34 OR (saturation > 0.26 AND gaps > 0.42 AND thickness <= 3.2) THEN 'glass' WHEN red > 0.38 THEN 'brick' WHEN brown > 0.34 THEN 'wood' WHEN neutral > 0.5 THEN CASE WHEN thickness <= 2.5 THEN 'glass' WHEN thickness <= 5 AND dark < 0.45 THEN 'drywall' WHEN thickness <= 5 OR (thickness <= 10 AND dark < 0.55) THEN 'brick' WHEN thickness <= 20 THEN 'concrete' ELSE 'reinforced_concrete' END ELSE 'drywall' END AS material,
CASE WHEN coverage < 0.12 THEN {_D(0.16)} WHEN blue > 0.34 OR (saturation > 0.26 AND gaps > 0.42 AND thickness <= 3.2) OR red > 0.38 OR brown > 0.34 THEN least(greatest(coverage+saturation*{_D(0.55)}, {_D(0.28)}), {_D(0.95)}) WHEN neutral > 0.5 THEN CASE WHEN thickness <= 2.5 THEN least(greatest({_BASE}-{_D(0.04)}, {_D(0.28)}), {_D(0.7)}) WHEN thickness <= 10 THEN {_BASE} WHEN thickness <= 20 THEN least({_BASE}+{_D(0.04)}, {_D(0.84)}) ELSE least({_BASE}+{_D(0.06)}, {_D(0.86)}) END ELSE least(greatest({_D(0.3)}+coverage*{_D(0.44)}, {_D(0.24)}), {_D(0.82)}) END AS confidence FROM pf),
wm AS MATERIALIZED (SELECT wl.*, coalesce(material, 'drywall') AS material, coalesce(floor(round(confidence, 9)*100+0.5)/100, {_D(0.16)}) AS confidence, coalesce(CASE WHEN weak THEN coverage ELSE floor(round(coverage, 9)*100+0.5)/100 END, 0) AS coverage, coalesce(CASE WHEN weak THEN thickness ELSE floor(round(thickness, 9)*10+0.5)/10 END, 0) AS thickness, abs(y0-y1) < abs(x0-x1) AS flat, (x0+x1)/2 AS mx, (y0+y1)/2 AS my, sqrt((x1-x0)**2+(y1-y0)**2) AS len FROM wl LEFT JOIN mt USING (plan, number)),
ac AS (SELECT plan, number, [{{'f': flat, 'x': mx, 'y': my, 'l': len}}] AS m, true AS taken FROM wm WHERE number = 1 UNION ALL SELECT w.plan, w.number, CASE WHEN dup THEN m ELSE list_append(m, {{'f': w.flat, 'x': w.mx, 'y': w.my, 'l': w.len}}) END, NOT dup FROM (SELECT ac.m, w.*, len(list_filter(ac.m, lambda q: q.f = w.flat AND sqrt((q.x-w.mx)**2+(q.y-w.my)**2) < 4 AND abs(q.l-w.len) < 8)) > 0 AS dup FROM ac JOIN wm w ON w.plan=ac.plan AND w.number=ac.number+1) w),
dw AS MATERIALIZED (SELECT wm.* FROM wm JOIN ac USING (plan, number) WHERE taken)"""


def _drawn(spark, d):
    return cut(V.drawing_runs(spark, d), "drawings"), cut(spread(V.drawn_plans(spark, d), "plan"), "plans")


def _segments(spark, d):
    pixels, plans = _drawn(spark, d)
    candidates = cut(walls.axis_candidates(walls.mask_words(pixels, plans), plans), "candidates")
    return cut(walls.merged_segments(candidates, plans), "segments"), pixels, plans


@query(_MASK + " SELECT plan, gx, gy FROM mask")
def wall_trace_mask(spark, d):
    return walls.trace_mask(*_drawn(spark, d))


@query(_CANDIDATES + ' SELECT plan, o AS orientation, s AS "start", e AS "end", c0 AS cross_start, c1 AS cross_end, round(score, 9) AS score FROM cand')
def wall_candidates(spark, d):
    pixels, plans = _drawn(spark, d)
    return walls.axis_candidates(cut(walls.mask_words(pixels, plans), "mask"), plans).withColumn("score", F.round("score", 9))


@query(_SEGMENTS + ' SELECT plan, o AS orientation, s AS "start", e AS "end", c0 AS cross_start, c1 AS cross_end, round(score, 9) AS score FROM f2')
def wall_segments(spark, d):
    return _segments(spark, d)[0].drop("rank").withColumn("score", F.round("score", 9))


@query(_GRAPH + ' SELECT plan, o AS orientation, s AS "start", e AS "end", c0 AS cross_start, c1 AS cross_end, members FROM gr')
def wall_graph(spark, d):
    segments, _, plans = _segments(spark, d)
    kept = walls.wall_graph(walls.structural_segments(segments, plans), plans)
    members = F.count(F.lit(1)).over(Window.partitionBy("plan", "component"))
    return kept.withColumn("members", members).drop("id", "component", "score")


@query(_PROFILES + " SELECT plan, number, " + ", ".join(f"round({a}, 9) AS {b}" for a, b in (("coverage", "coverage"), ("thickness", "thickness"), ("saturation", "saturation"), ("blue", "blue_share"), ("red", "red_share"), ("brown", "brown_share"), ("neutral", "neutral_share"), ("dark", "dark_share"), ("gaps", "gap_share"))) + " FROM pf")
def wall_profiles(spark, d):
    segments, pixels, plans = _segments(spark, d)
    placed = cut(walls.placed_walls(walls.wall_graph(walls.structural_segments(segments, plans), plans), plans), "walls")
    p = walls.trace_profiles(placed, pixels, plans)
    return p.select("plan", "number", *(F.round(c, 9).alias(c) for c in p.columns[2:]))


@query(_FOUND + " SELECT plan, 'auto-wall-' || number AS wall_id, x0, y0, x1, y1, material, confidence, round(coverage, 9) AS coverage, round(thickness, 9) AS thickness FROM dw")
def detected_walls(spark, d):
    found = walls.detect_walls(*_drawn(spark, d))
    return found.withColumns({c: F.round(c, 9) for c in ("coverage", "thickness")})


@query(_FOUND + """, cv AS (SELECT pl.plan, count(mask.gx) AS n FROM pl LEFT JOIN mask USING (plan) GROUP BY pl.plan), ct AS (SELECT plan, count(*) FILTER (flat) AS h, count(*) FILTER (NOT flat) AS v FROM dw GROUP BY plan)
SELECT cv.plan, coalesce(h, 0) AS horizontal, coalesce(v, 0) AS vertical, floor(n/CAST(19200 AS DOUBLE)*1000+0.5)/1000 AS covered, n >= 40 AND n/CAST(19200 AS DOUBLE) <= 0.46 AS usable FROM cv LEFT JOIN ct USING (plan)""")
def wall_summary(spark, d):
    pixels, plans = _drawn(spark, d)
    return walls.wall_summary(walls.detect_walls(pixels, plans), walls.mask_words(pixels, plans), plans)


@query()
def plan_crops(spark, d):
    """Crops of the drawn plans; the steps depend on one another, so a plain scan stands in for SQL in the tests."""
    return crop.crops(V.drawing_runs(spark, d), V.drawn_plans(spark, d))


@query(V.with_views("plans") + """, k AS (SELECT site, width, height, width/height AS raw, width_m/height_m AS target, width_m > 0 AND height_m > 0 AS known FROM plans), a AS (SELECT *, coalesce(known AND abs(raw-target)/target > 0.02, false) AS applied FROM k)
SELECT site, CAST(CASE WHEN applied AND NOT raw > target THEN floor(height*target+0.5) ELSE width END AS INT) AS out_w, CAST(CASE WHEN applied AND raw > target THEN floor(width/target+0.5) ELSE height END AS INT) AS out_h, applied FROM a""")
def corrected_sizes(spark, d):
    return crop.corrected_sizes(V.plans(spark, d)).select("site", "out_w", "out_h", "applied")
