"""Spatial joins. Access points, walls and rooms of a plan are few; they travel as lists of at most BLOCK,
which are broadcast only up to BROADCAST lists, and joined by shuffle beyond."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigfield.functions import geometry as G
from sigfield.functions import rf
from sigfield.functions.scalars import is_finite, smoothstep
from sigfield.runtime import cut

BROADCAST, BLOCK = 100_000, 1000


def small(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint if a count shows it is small."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def listed(df: DataFrame, key: str, columns: list[str], name: str) -> tuple[DataFrame, bool]:
    """Rows of lists of about BLOCK entries each, in the order of ``columns``, and whether there is only one."""
    n, entries = df.count(), F.array_sort(F.collect_list(F.struct(*columns))).alias(name)
    if n <= BLOCK:
        return df.agg(entries), True
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(-(-n // BLOCK))).alias("block_")).agg(entries).drop("block_"), False


def nearest_site(targets: DataFrame, sites: DataFrame, site_id: str, by: list[str] | None = None) -> DataFrame:
    """Targets (tx, ty) with ``site``, a struct of the nearest site's columns (x, y and others), and its distance ``d``; of
    equally near ones the first by ``site_id``. A target without a finite place, or without any site in its group, has nulls.

    Of sites at one place only the first by ``site_id`` counts. Sites are sent to the nine squares around their own, as lists, and
    targets only to theirs. A site found no farther than the side of a square is the nearest of all; targets without one look
    again in squares of twice the side, until none is left. So the rows that are compared follow from how dense the places are,
    not from the number of sites, and where the lists can be broadcast no target is shuffled."""
    by = by or []
    names = [c for c in sites.columns if c not in by]
    placed = is_finite(F.col("tx")) & is_finite(F.col("ty"))
    site = F.struct(*names)
    at_place = sites.where(is_finite(F.col("x")) & is_finite(F.col("y"))).groupBy(*by, F.col("x").alias("_x"), F.col("y").alias("_y"))
    known = cut(at_place.agg(F.min(F.struct(F.col(site_id).alias("id"), site.alias("site"))).alias("s")).select(*by, "s.site.*"), "sites")
    box = known.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}{c}") for c in "xy" for k, f in (("lo", F.min), ("hi", F.max)))).first()
    kind = known.select(site).schema[0].dataType
    nothing = F.lit(None)
    if not box["n"]:
        return targets.select("*", nothing.cast(kind).alias("site"), nothing.cast("double").alias("d"))
    groups = known.select(*by).distinct().count() if by else 1
    side = max(math.sqrt(max(box["hix"] - box["lox"], 1.0) * max(box["hiy"] - box["loy"], 1.0) * groups / box["n"]), 1e-6)
    has_sites = known.select(*by).distinct() if by else None
    rows = targets.where(placed) if has_sites is None else targets.where(placed).join(small(has_sites), by, "left_semi")
    lost = targets.where(~placed) if has_sites is None else targets.where(~placed).unionByName(targets.where(placed).join(small(has_sites), by, "left_anti"))
    square = lambda c: F.floor(F.col(c) / side).cast("long")
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    keys = [*by, "_cx", "_cy"]
    done = []
    while True:
        around = known.select(*by, site.alias("_site"), square("x").alias("_cx"), square("y").alias("_cy"), F.explode(steps).alias("_o"))
        around = cut(around.select(*by, "_site", (F.col("_cx") + F.col("_o.i")).alias("_cx"), (F.col("_cy") + F.col("_o.j")).alias("_cy")), "around")
        looking = rows.withColumns({"_cx": square("tx"), "_cy": square("ty")})
        best = lambda s: F.struct(F.hypot(s["x"] - F.col("tx"), s["y"] - F.col("ty")).alias("d"), s[site_id].alias("id"), s.alias("site"))
        crowded = around.groupBy(*keys).count().where(F.col("count") > BLOCK).limit(1).count()
        if crowded or around.limit(BROADCAST + 1).count() > BROADCAST:
            named = cut(looking.withColumn("_row", F.monotonically_increasing_id()), "targets")
            pairs = named.select("_row", "tx", "ty", *keys).join(small(around), keys)
            least = pairs.groupBy("_row").agg(F.min(best(F.col("_site"))).alias("b"))
            looked = named.join(least, "_row", "left").drop("_row")
        else:
            lists = around.groupBy(*keys).agg(F.collect_list("_site").alias("_sites"))  # at most BLOCK in each
            looked = looking.join(F.broadcast(lists), keys, "left").withColumn("b", F.array_min(F.transform("_sites", best))).drop("_sites")
        found = cut(looked.select(*targets.columns, F.when(F.col("b.d") <= side, F.col("b")).alias("b")), "nearest")
        done.append(found.where("b is not null").select(*targets.columns, F.col("b.site").alias("site"), F.col("b.d").alias("d")))
        rows = found.where("b is null").drop("b")
        if not rows.limit(1).count():
            break
        side *= 2
    out = lost.select("*", nothing.cast(kind).alias("site"), nothing.cast("double").alias("d"))
    for t in done:
        out = out.unionByName(t)
    return out


def nearest_ap(points: DataFrame, aps: DataFrame, px_per_m: float, key: str = "row_idx") -> DataFrame:
    """Distance in metres to the nearest access point, the first of equally near ones."""
    sites = aps.select("ap_id", F.col("ax").alias("x"), F.col("ay").alias("y"))
    found = nearest_site(points.select(key, F.col("x").alias("tx"), F.col("y").alias("ty")), sites, "ap_id")
    return found.select(key, F.col("site.ap_id").alias("ap_id"), F.round(F.col("d") / px_per_m, 2).alias("distance_m"))


def proximity_pairs(points: DataFrame, within: float, key: str = "row_idx", by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs i < j of a group closer than ``within``: an equi-join on grid squares of that size and their
    neighbours."""
    square = points.select(*by, key, "x", "y", F.floor(F.col("x") / within).alias("cx"), F.floor(F.col("y") / within).alias("cy"))
    near = F.explode(F.expr("flatten(transform(array(-1,0,1), dx -> transform(array(-1,0,1), dy -> struct(cx+dx as cx, cy+dy as cy))))"))
    left = square.select(*by, F.col(key).alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), near.alias("c")).select(*by, "i", "xi", "yi", "c.cx", "c.cy")
    right = square.select(*by, F.col(key).alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), "cx", "cy")
    d = F.hypot(F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj"))
    return left.join(right, [*by, "cx", "cy"]).where((F.col("i") < F.col("j")) & (d < within)).select(*by, "i", "j", d.alias("distance_px"))


def wall_loss(rays: DataFrame, walls: DataFrame, key: list[str], thickness_m: float = 0.12, keep: bool = False) -> DataFrame:
    """Number of crossed walls and their loss for rays (x, y) to (tx, ty) of a band; walls are a bounded
    list per plan, folded where the ray is. Walls whose box lies beside the ray's are passed over first. With ``keep``, all
    columns of the rays stay."""
    lists, one = listed(walls, "wall_id", ["wall_id", "x0", "y0", "x1", "y1", "material"], "walls")
    ray = (F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))
    apart = lambda a, b, c, d: (F.greatest(a, b) < F.least(c, d) - 1) | (F.least(a, b) > F.greatest(c, d) + 1)
    beside = lambda w: apart(ray[0], ray[2], w["x0"], w["x1"]) | apart(ray[1], ray[3], w["y0"], w["y1"])
    hit = F.filter("walls", lambda w: ~beside(w) & G.segments_intersect(ray, (w["x0"], w["y0"], w["x1"], w["y1"])))
    path = F.atan2(F.col("ty") - F.col("y"), F.col("tx") - F.col("x"))
    loss = lambda w: rf.crossing_loss_db(w["material"], F.col("band"), F.lit(thickness_m), path, F.atan2(w["y1"] - w["y0"], w["x1"] - w["x0"]))
    found = rays.join(small(lists)).withColumn("hit", hit)
    kept = rays.columns if keep and one else key
    out = found.select(*kept, F.size("hit").alias("n_walls"), F.aggregate("hit", F.lit(0.0), lambda s, w: s + loss(w)).alias("wall_db"))
    if one:
        return out
    summed = out.groupBy(*key).agg(F.sum("n_walls").cast("int").alias("n_walls"), F.sum("wall_db").alias("wall_db"))
    return rays.join(summed, key) if keep else summed


def rooms_of_points(points: DataFrame, rooms: DataFrame, key: str = "row_idx") -> DataFrame:
    """The first room, by id, whose polygon holds each point; points in none are left out."""
    lists, one = listed(rooms, "room_id", ["room_id", "polygon"], "rooms")
    inside = F.filter("rooms", lambda r: G.point_in_polygon(F.col("x"), F.col("y"), r["polygon"]))
    found = points.join(small(lists)).select(*points.columns, F.get(inside, F.lit(0))["room_id"].alias("room_id")).where("room_id is not null")
    return found if one else found.groupBy(*points.columns).agg(F.min("room_id").alias("room_id"))


def points_in_reach(targets: DataFrame, points: DataFrame, reach: str, by: list[str], most: int) -> DataFrame:
    """Pairs of targets (by, gx, gy, tx, ty) and points (by, x, y, first_idx, ``reach`` in pixels) that are near enough to count,
    with their distance ``d``, ``falloff`` and ``rank`` by distance, at most ``most`` for a target: an equi-join on squares of the
    reach's size around each point, then a window that Spark limits before it sorts."""
    square = lambda c: F.floor(F.col(c) / F.col(reach)).cast("long")
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    sizes = points.select(*by, reach).distinct()
    left = targets.join(small(sizes), by).select(*by, "gx", "gy", "tx", "ty", reach, square("tx").alias("_cx"), square("ty").alias("_cy"))
    right = points.withColumns({"_x": square("x"), "_y": square("y"), "_o": F.explode(steps)}).withColumns({"_cx": F.col("_x") + F.col("_o.i"), "_cy": F.col("_y") + F.col("_o.j")}).drop("_x", "_y", "_o")
    d = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    pairs = left.join(small(right), [*by, reach, "_cx", "_cy"]).drop("_cx", "_cy").withColumn("d", d)
    pairs = pairs.withColumn("falloff", F.lit(1.0) - smoothstep(F.col(reach) * 0.74, F.col(reach), F.col("d"))).where("falloff > 0.002")
    rank = F.row_number().over(Window.partitionBy(*by, "gx", "gy").orderBy("d", "first_idx"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most)


def alias_join(points: DataFrame, rows: DataFrame, aliases, key: str, row_key: str) -> DataFrame:
    """Each point's row: the row whose alias matches the point's earliest alias; of rows with one alias
    the last counts."""
    left = points.select(F.col(key), F.posexplode(aliases(F.col(key))).alias("place", "alias"))
    right = rows.select(F.explode(aliases(F.col(row_key))).alias("alias"), F.struct("row_idx", F.col(row_key).alias("row_key")).alias("row"))
    last = right.groupBy("alias").agg(F.max("row").alias("row"))
    best = left.join(last, "alias").groupBy(key).agg(F.min(F.struct("place", "row")).alias("best"))
    return points.join(best.select(key, F.col("best.row.row_key").alias("matched")), key, "left")
