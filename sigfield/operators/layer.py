"""A band's layer in one call: masks, interpolation, blur, and the tables that are read from its cells."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigfield.functions import rf, scores
from sigfield.functions.scalars import clamp, is_finite, round_half_up, smoothstep
from sigfield.operators import coverage, interpolate, raster, spatial
from sigfield.operators.place import GENERATION_BINS, bin_size, even_sample, exact_mean
from sigfield.operators.ranks import running
from sigfield.operators.spatial import small
from sigfield.runtime import cut

BANDS = ("24ghz", "5ghz", "6ghz")
SIGNALS = [f"rssi_{b}" for b in BANDS]


@dataclass(frozen=True)
class Floor:
    """What a layer is drawn on. ``walls``, ``obstacles`` (pixels gx, gy) and ``house`` (pixels) may be None; ``measured``
    (band, gx, gy) replaces the house and the reach of points. The first access point by ``ap_id`` is the one whose
    prediction is blended in; all of them let cells near them take part."""

    width: int
    height: int
    px_per_m: float
    walls: DataFrame | None = None
    aps: DataFrame | None = None
    rooms: DataFrame | None = None
    obstacles: DataFrame | None = None
    house: DataFrame | None = None
    measured: DataFrame | None = None
    material: str = "drywall"


class Layer(NamedTuple):
    """Cells (band, gx, gy, tx, ty, step, rssi, alpha, shadow), and per band: statistics, rooms, points and colours."""

    cells: DataFrame
    stats: DataFrame
    rooms: DataFrame
    points: DataFrame
    pixels: DataFrame


def compact(points: DataFrame, width: float, height: float, limit: int = GENERATION_BINS) -> DataFrame:
    """Points (row_idx, point_id, x, y, a signal for each band, source) of a survey of more than ``limit``: one for each
    occupied bin, with the mean place, the strongest signals, 'csv' as source if any has it, and ids G1, G2 .. by first
    sight; if still more, evenly spread ones of them. Points without a place are left out. A smaller survey stays as it is."""
    kept = points.select("row_idx", "point_id", "x", "y", *SIGNALS, "source")
    if kept.limit(limit + 1).count() <= limit:
        return kept
    cell = float(bin_size(width, height, limit))
    at = lambda c: F.floor(F.col(c) / cell + 0.5).cast("long")
    source = F.when(F.max(F.col("source") == "csv"), F.lit("csv")).otherwise(F.min_by("source", "row_idx")).alias("source")
    placed = kept.where(is_finite(F.col("x")) & is_finite(F.col("y"))).groupBy(at("x").alias("bx"), at("y").alias("by_"))
    bins = placed.agg(F.min("row_idx").alias("row_idx"), *(round_half_up(exact_mean(F.col(c)), 2).alias(c) for c in "xy"), *(F.max(c).alias(c) for c in SIGNALS), source)
    named = running(bins, ["row_idx"]).withColumn("point_id", F.concat(F.lit("G"), F.col("upto").cast("string")))
    return even_sample(named.select(*kept.columns), "row_idx", limit, [])


def scaled(table: DataFrame, factor: float, columns: list[str]) -> DataFrame:
    """Places brought to a plan that is worked on at another size; other columns stay."""
    return table.withColumns({c: F.col(c) * factor for c in columns})


def usable(points: DataFrame) -> DataFrame:
    """Points of each band (band, point_id, first_idx, x, y, rssi). Without a 6 GHz reading, 5 GHz less 4.5 dB stands for it."""
    six = F.coalesce("rssi_6ghz", F.col("rssi_5ghz") - 4.5)
    each = F.array(*(F.struct(F.lit(b).alias("band"), v.alias("rssi")) for b, v in zip(BANDS, (F.col("rssi_24ghz"), F.col("rssi_5ghz"), six))))
    long = points.select("point_id", F.col("row_idx").alias("first_idx"), "x", "y", F.explode(each).alias("s"))
    return long.select("s.band", "point_id", "first_idx", "x", "y", "s.rssi").where(is_finite(F.col("rssi")) & is_finite(F.col("x")) & is_finite(F.col("y")))


def candidate_cells(points: DataFrame, floor: Floor, step: int, radius: Column, dense: Column) -> DataFrame:
    """Cells (band, gx, gy, tx, ty) of the layers of one step that may hold a signal: in the hull of the points, widened, and
    in the measured mask, or else in the house and near a point of a sparse survey or an access point. The masks are
    semi-joins, so that no other cell meets a point later."""
    gw, gh = math.ceil(floor.width / step), math.ceil(floor.height / step)
    bands = points.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    grid = bands.withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(gw - 1)))).withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(gh - 1))))
    centre = lambda c, most: F.least(F.lit(float(most - 1)), F.col(c) * float(step) + step * 0.5)
    cells = grid.withColumns({"tx": centre("gx", floor.width), "ty": centre("gy", floor.height)}).withColumns({"px": F.floor("tx").cast("int"), "py": F.floor("ty").cast("int")})
    hull = cut(raster.convex_hull(points.select("band", "x", "y"), "band"), "hull")
    spans = small(raster.hull_mask(hull, "band", floor.width, floor.height, max(step * 3.0, 20.0)).withColumnRenamed("gy", "py"))
    hulled = hull.groupBy("band").agg((F.count(F.lit(1)) > 2).alias("hulled"))
    runs = spans.withColumnsRenamed({"x0": "_x0", "x1": "_x1", "py": "_py", "band": "_band"})
    within = cells.join(runs, (F.col("band") == F.col("_band")) & (F.col("py") == F.col("_py")) & F.col("px").between(F.col("_x0"), F.col("_x1")), "left_semi")
    cells = within.unionByName(cells.join(small(hulled.where("not hulled")), "band", "left_semi"))
    if floor.measured is not None:
        mask = floor.measured.select("band", F.col("gx").alias("px"), F.col("gy").alias("py"))
        return cells.join(mask, ["band", "px", "py"], "left_semi").select("band", "gx", "gy", "tx", "ty")
    if floor.house is not None:
        cells = cells.join(small(floor.house.select(F.col("gx").alias("px"), F.col("gy").alias("py")).distinct()), ["px", "py"], "left_semi")
    cells = cells.withColumn("dense", dense)
    thick, thin = cells.where("dense"), cells.where("not dense")
    if not bands.where(~dense).limit(1).count():
        return thick.select("band", "gx", "gy", "tx", "ty")
    side = max(floor.width, floor.height)
    widest = radius
    sources = None
    if floor.aps is not None:
        aps = interpolate.antennas(floor.aps)
        of_ap = clamp(F.coalesce(F.col("ap_radius_m"), radius), 4.0, 120.0)
        sources = bands.select("band").join(small(aps)).select("band", F.col("ax").alias("x"), F.col("ay").alias("y"), of_ap.alias("ap_radius"))
        widest = F.greatest(radius, F.coalesce("most", F.lit(0.0)))
        thin = thin.join(small(sources.groupBy("band").agg(F.max("ap_radius").alias("most"))), "band", "left")
    reach = F.least(widest * floor.px_per_m, F.lit(side * 0.52))
    found = spatial.nearest_site(thin.withColumn("reach", reach), points.select("band", "first_idx", "x", "y"), "first_idx", ["band"])
    near = found.where(F.col("d") <= F.col("reach")).select("band", "gx", "gy", "tx", "ty")
    if sources is not None:
        least = F.least(F.col("ap_radius") * floor.px_per_m, F.lit(side * 0.58))
        heard = thin.select("band", "gx", "gy", "tx", "ty").join(small(sources.withColumn("least", least)), "band").where(F.hypot(F.col("tx") - F.col("x"), F.col("ty") - F.col("y")) <= F.col("least"))
        near = near.unionByName(heard.select("band", "gx", "gy", "tx", "ty")).distinct()
    return thick.select("band", "gx", "gy", "tx", "ty").unionByName(near)


def _blocked(cells: DataFrame, obstacles: DataFrame | None) -> DataFrame:
    """Cells with ``blocked``: whether an obstacle pixel lies at the centre."""
    if obstacles is None:
        return cells.withColumn("blocked", F.lit(False))
    at = obstacles.select(F.col("gx").alias("_ox"), F.col("gy").alias("_oy"), F.lit(True).alias("blocked")).distinct()
    near = cells.withColumns({"_ox": F.floor(F.col("tx") + 0.5).cast("int"), "_oy": F.floor(F.col("ty") + 0.5).cast("int")})
    return near.join(small(at), ["_ox", "_oy"], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False))).drop("_ox", "_oy")


def heatmap_layer(points: DataFrame, floor: Floor, power: float = 2.2, radius_m: float | None = None, blur_px: float | None = None, above: float = -67, weak: float = -68, dead: float = -75) -> Layer:
    """Layers of all bands that ``points`` (row_idx, point_id, x, y, a signal for each band) have readings of.

    Each layer takes its grid step from the plan's size and its number of points; layers of one step are made together (there
    are at most twelve steps). The cells are written once, and statistics, rooms, points and colours are read from them.
    Without rooms, connected open cells are the rooms. A survey without readings gives empty tables."""
    side = max(floor.width, floor.height)
    blur_px = min(max(side / 65, 13.0), 22.0) if blur_px is None else min(max(blur_px, 0.0), max(42.0, side * 0.06))
    readings = cut(usable(points), "usable")
    n = F.col("n")
    sized = cut(readings.groupBy("band").agg(F.count(F.lit(1)).alias("n")).withColumn("step", interpolate.settings(F.lit(float(floor.width)), F.lit(float(floor.height)), n)["step"]), "sized")
    radius = F.lit(float(radius_m)) if radius_m else rf.of_band(F.col("band"), 2)
    primary = None if floor.aps is None else floor.aps.orderBy("ap_id").limit(1)
    parts = []
    for step in sorted(r["step"] for r in sized.select("step").distinct().collect()):  # at most 12
        mine = readings.join(F.broadcast(sized.where(F.col("step") == step).select("band")), "band", "left_semi")  # one row a band
        open_ = cut(candidate_cells(mine, floor, step, radius, n > 120), "open")
        field = interpolate.rf_grid(mine.drop("point_id"), open_, floor.walls, primary, floor.px_per_m, ["band"], radius_m, power, floor.obstacles, floor.material)
        field = _blocked(field.join(open_, ["band", "gx", "gy"]), floor.obstacles)
        shadow = clamp(F.col("wall_db") * 0.012 + F.col("shadow_db") * 0.03, 0.0, 0.3)
        seen = scores.cell_alpha(F.col("confidence"), smoothstep(F.lit(-84.0), F.lit(-52.0), F.col("rssi")))
        field = cut(field.withColumn("shadow", shadow).withColumn("alpha", seen * F.when(F.col("blocked"), 0.84).otherwise(1.0) * (F.lit(1.0) - F.col("shadow") * 0.36)).withColumnRenamed("rssi", "value"), "field")
        gw, gh = math.ceil(floor.width / step), math.ceil(floor.height / step)
        soft = raster.blur(field.select("band", "gx", "gy", "value", "alpha"), math.floor(blur_px / step + 0.5), gw, gh, ["band"])
        parts.append(soft.join(field.drop("value", "alpha"), ["band", "gx", "gy"]).select("band", "gx", "gy", "tx", "ty", F.lit(step).alias("step"), F.col("value").alias("rssi"), "alpha", "shadow", "blocked"))
    empty = "band string, gx int, gy int, tx double, ty double, step int, rssi double, alpha double, shadow double, blocked boolean"
    cells = points.sparkSession.createDataFrame([], empty)
    for part in parts:
        cells = cells.unionByName(part)
    cells = cut(cells, "cells")
    shown = cells.where("alpha > 0.025")
    found = coverage.layer_stats(shown, ["band"], above, dead)
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in found.columns if c != "band"}
    stats = sized.withColumnsRenamed({"n": "n_points"}).join(found, "band", "left").withColumns(zero)
    rooms = _rooms(cells, sized, floor, above, weak, dead)
    pixels = scores.painted(shown, dead).select("band", "gx", "gy", "r", "g", "b", "a")
    return Layer(cells, stats, rooms, point_analysis(points, above, weak, dead), pixels)


def point_analysis(points: DataFrame, above: float = -67, weak: float = -68, dead: float = -75) -> DataFrame:
    """Class and scores of each point's own signal in every band that has one; they don't depend on the cells."""
    return coverage.point_table(usable(points), ["band", "point_id"], above, weak, dead)


def _rooms(cells: DataFrame, sized: DataFrame, floor: Floor, above: float, weak: float, dead: float) -> DataFrame:
    """Rooms' statistics, in each band in natural order of names (``place``)."""
    open_ = cells.where("not blocked").withColumnsRenamed({"tx": "x", "ty": "y"})
    steps = [r["step"] for r in sized.select("step").distinct().collect()]  # at most 12
    found = None
    if floor.rooms is not None:
        inside = spatial.rooms_of_points(open_.where("alpha > 0.02"), floor.rooms, "gx")
        named = inside.join(small(floor.rooms.select("room_id", "name")), "room_id").withColumn("room_id", F.col("room_id").cast("string"))
    else:
        named = None
    for step in steps:
        if named is not None:
            of_step = named.where(F.col("step") == step)
        else:
            gw, gh = math.ceil(floor.width / step), math.ceil(floor.height / step)
            passable = cut(open_.where((F.col("step") == step) & (F.col("alpha") > 0.03)), "passable")
            labels = raster.connected(passable.select("band", "gx", "gy"), gw, "band")
            chosen = coverage.auto_rooms(labels, "band", cells=gw * gh).select("band", "label", "name")
            of_step = passable.join(labels, ["band", "gx", "gy"]).join(small(chosen), ["band", "label"]).withColumn("room_id", F.col("label").cast("string"))
        bounds = of_step.groupBy("band", "room_id").agg(*(round_half_up(f(c), 1).alias(f"{k}_{c}") for c in "xy" for k, f in (("min", F.min), ("max", F.max))))
        stats = coverage.region_stats(of_step, ["band", "room_id", "name"], float(step), floor.px_per_m, above, weak, dead)
        seen = {c: i for i, c in enumerate(stats.columns)}  # the last of two equal names is the class
        stats = stats.toDF(*("dead_class_pct" if c == "dead_pct" and i == seen[c] else c for i, c in enumerate(stats.columns)))
        part = stats.join(bounds, ["band", "room_id"])
        found = part if found is None else found.unionByName(part)
    if found is None:
        return cells.sparkSession.createDataFrame([], "band string, room_id string, name string, place int, n long, roaming double")
    keyed = found.withColumn("_natural", coverage.natural_key(F.col("name")))
    return running(keyed, ["_natural", "room_id"], ["band"]).withColumn("place", F.col("upto").cast("int")).drop("_natural", "upto", "total")


def results(layer: Layer, points: DataFrame) -> DataFrame:
    """One row for each band: its statistics, the first room's roaming score (0 without rooms), and the numbers of rooms, of
    points that were given and of points that were used."""
    first = layer.rooms.groupBy("band").agg(F.min_by("roaming", "place").alias("roaming"), F.count(F.lit(1)).alias("n_rooms"))
    given = points.agg(F.count(F.lit(1)).alias("n_given"))  # one row
    out = layer.stats.join(small(first), "band", "left").join(F.broadcast(given))
    return out.withColumns({"roaming": F.coalesce("roaming", F.lit(0.0)), "n_rooms": F.coalesce("n_rooms", F.lit(0).cast("long"))}).withColumnRenamed("n_points", "n_used")
