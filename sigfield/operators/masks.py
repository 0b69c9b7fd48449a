"""Masks over plans: barriers of walls, reach of a survey, covered and measured areas, footprints.

A mask is a table of its cells or pixels (gx, gy), with ``alpha`` from 0 to 255 where it is soft. Disks and
lines are offsets that are exploded, so work and shuffle grow with the mask, never with the plan's points
times its cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigfield.functions import geometry as G
from sigfield.functions import rf
from sigfield.functions.scalars import clamp, smoothstep
from sigfield.operators.raster import blur_axis, dilate
from sigfield.operators.spatial import small
from sigfield.runtime import ship, spread

TILE = 64


def _rounded(v: Column) -> Column:
    return F.floor(v + 0.5).cast("int")


def disk(radius: int) -> list[tuple[int, int]]:
    return [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if x * x + y * y <= radius * radius]


def _offsets(places: list[tuple[int, int]]) -> Column:
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in places))


def sampled(lines: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Samples (i, px, py) of lines (x0, y0) to (x1, y1), ends included, at most ``step`` apart."""
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / max(step, 1.0)).cast("int"))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("i") / F.col("n"))
    return lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n")))).select(*keys, "i", _rounded(at("x0", "x1")).alias("gx"), _rounded(at("y0", "y1")).alias("gy"))


def barriers(walls: DataFrame, width: int, height: int, px_per_m: float, thickness_m: float = 0.12) -> DataFrame:
    """Pixels within half a wall's thickness, 2 to 10 pixels, of its line."""
    radius = min(max(max(3, math.floor(thickness_m * max(px_per_m, 1.0) / 2 + 0.5)), 2), 10)
    return dilate(sampled(walls, [], 1.0).select("gx", "gy").distinct(), radius, width, height, [])


def obstacle_runs(rays: DataFrame, obstacles: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of blocked samples, and their number, of rays (x, y) to (tx, ty) that meet obstacle pixels: samples lie at most
    2.5 pixels apart, and only blocked ones are ordered. Rays that meet none have no row."""
    n = F.greatest(F.lit(1), F.ceil(F.sqrt((F.col("tx") - F.col("x")) * (F.col("tx") - F.col("x")) + (F.col("ty") - F.col("y")) * (F.col("ty") - F.col("y"))) / 2.5).cast("int"))
    at = lambda a, b: _rounded(F.col(a) + (F.col(b) - F.col(a)) * (F.col("_i") / F.col("_n")))
    samples = rays.select(*keys, "x", "y", "tx", "ty", n.alias("_n")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    blocked = samples.select(*keys, "_i", at("x", "tx").alias("_px"), at("y", "ty").alias("_py"))
    blocked = blocked.join(small(obstacles.select(F.col("gx").alias("_px"), F.col("gy").alias("_py")).distinct()), ["_px", "_py"])
    before = F.lag("_i").over(Window.partitionBy(*keys).orderBy("_i"))
    starts = blocked.withColumn("_starts", before.isNull() | (before < F.col("_i") - 1))
    return starts.groupBy(*keys).agg(F.count_if("_starts").alias("runs"), F.count(F.lit(1)).alias("blocked"))


def obstacle_loss(rays: DataFrame, obstacles: DataFrame, keys: list[str], px_per_m: float, material: str = "drywall") -> DataFrame:
    """Rays (x, y) to (tx, ty) of a band with ``runs`` and ``blocked`` samples in obstacle pixels and their loss, ``obstacle_db``; 0
    where they meet none. The keys tell rays apart; all columns stay."""
    met = rays.join(obstacle_runs(rays, obstacles, keys), keys, "left")
    runs, blocked = F.coalesce("runs", F.lit(0)), F.coalesce("blocked", F.lit(0))
    loss = rf.obstacle_loss_db(F.lit(material), F.col("band"), runs, blocked, F.lit(float(px_per_m)))
    return met.withColumns({"runs": runs, "blocked": blocked, "obstacle_db": F.when(F.col("runs") > 0, loss).otherwise(F.lit(0.0))})


def inward_alpha(mask: DataFrame, radius: int, by: list[str]) -> DataFrame:
    """A mask whose alpha falls toward its edge: by the share of a disk that is inside."""
    if radius <= 0:
        return mask.withColumn("alpha", F.lit(255))
    places = disk(radius)
    keys = [*by, "gx", "gy"]
    near = mask.select(*by, "gx", "gy", F.explode(_offsets(places)).alias("o")).select(*by, (F.col("gx") + F.col("o.x")).alias("gx"), (F.col("gy") + F.col("o.y")).alias("gy"))
    share = near.groupBy(*keys).agg((F.count(F.lit(1)) / len(places)).alias("share"))
    return share.join(mask.select(*keys), keys, "left_semi").select(*keys, _rounded(smoothstep(0.44, 0.92, F.col("share")) * 255).alias("alpha"))


def masked(cells: DataFrame, mask: DataFrame, by: list[str]) -> DataFrame:
    """Cells inside a mask, their alpha multiplied by the mask's."""
    keys = [*by, "gx", "gy"]
    soft = mask.select(*keys, (F.col("alpha") / 255).alias("mask_"))
    return cells.join(soft, keys).withColumn("alpha", F.col("alpha") * F.col("mask_")).drop("mask_")


def dense_coverage(points: DataFrame, width: int, height: int, reach: float, by: list[str]) -> DataFrame:
    """Soft mask around the places of a dense survey: points are binned, bins dilated, pixels blurred."""
    cell = max(2, math.floor(reach / 3 + 0.5))
    gw, gh = max(1, math.ceil(width / cell)), max(1, math.ceil(height / cell))
    at = lambda c, n: clamp(F.floor(F.col(c) / cell).cast("double"), 0.0, n - 1.0).cast("int")
    bins = points.select(*by, at("x", gw).alias("gx"), at("y", gh).alias("gy")).distinct()
    wide = dilate(bins, max(1, math.ceil(reach / cell)), gw, gh, by)
    inner = F.explode(_offsets([(x, y) for x in range(cell) for y in range(cell)]))
    pixels = wide.select(*by, "gx", "gy", inner.alias("o")).select(*by, (F.col("gx") * cell + F.col("o.x")).alias("gx"), (F.col("gy") * cell + F.col("o.y")).alias("gy"), F.lit(255.0).alias("alpha")).where((F.col("gx") < width) & (F.col("gy") < height))
    radius = max(2, math.floor(cell * 0.9 + 0.5))
    for axis, size in (("gx", width), ("gy", height)):
        pixels = blur_axis(pixels, ["alpha"], axis, size, radius, by)
    # rounded to ten digits first, so that the order of sums doesn't decide a half
    return pixels.withColumn("alpha", F.least(F.lit(255), _rounded(F.round("alpha", 10)))).where("alpha > 0")


def influence(points: DataFrame, walls: DataFrame, width: int, height: int, reach: float, feather: float, by: list[str], key: str) -> DataFrame:
    """Soft mask of what points reach without crossing a wall. Walls are looked at once for each point and
    coarse cell, from the point to the cell's centre; ``walls`` must be few, as a plan's are."""
    step = max(3, math.floor(max(width, height) / 360 + 0.5))
    solid = max(1.0, reach - max(feather, 1.0))
    span = lambda c, n: F.sequence(F.greatest(F.lit(0), F.floor(F.col(c) - reach)).cast("int"), F.least(F.lit(n - 1), F.ceil(F.col(c) + reach)).cast("int"))
    near = points.select(*by, key, "x", "y").withColumn("gx", F.explode(span("x", width))).withColumn("gy", F.explode(span("y", height)))
    far = F.hypot(F.col("gx") - F.col("x"), F.col("gy") - F.col("y"))
    near = near.withColumn("far", far).where(F.col("far") <= reach).withColumns({"cx": F.floor(F.col("gx") / step), "cy": F.floor(F.col("gy") / step)})
    coarse = near.select(*by, key, "x", "y", "cx", "cy").distinct().withColumns({"tx": F.col("cx") * float(step) + step * 0.5, "ty": F.col("cy") * float(step) + step * 0.5})
    ray, wall = (F.col("x"), F.col("y"), F.col("tx"), F.col("ty")), (F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    apart = lambda a, b, c, d: (F.greatest(c, d) + 2 < F.least(a, b)) | (F.least(c, d) - 2 > F.greatest(a, b))
    beside = apart(ray[0], ray[2], wall[0], wall[2]) | apart(ray[1], ray[3], wall[1], wall[3])
    blocked = coarse.join(walls.select("x0", "y0", "x1", "y1"), ~beside & G.segments_intersect(ray, wall), "left_semi")
    open_ = near.join(blocked.select(*by, key, "cx", "cy"), [*by, key, "cx", "cy"], "left_anti")
    alpha = _rounded((F.lit(1.0) - smoothstep(solid, reach, F.col("far"))) * 255)
    return open_.groupBy(*by, "gx", "gy").agg(F.max(alpha).alias("alpha")).where("alpha > 0")


def seeds(points: DataFrame, valid: DataFrame, width: int, height: int, by: list[str], key: str) -> DataFrame:
    """Each point's nearest valid pixel: its own, or the nearest on the first square ring that has any."""
    most = max(4, math.floor(max(width, height) * 0.012 + 0.5))
    ring = [(x, y) for x in range(-most, most + 1) for y in range(-most, most + 1)]
    o = F.array(*(F.struct(F.lit(max(abs(x), abs(y))).alias("ring"), F.lit(x * x + y * y).alias("d"), F.lit(y).alias("dy"), F.lit(x).alias("dx")) for x, y in ring))
    at = lambda c, n: clamp(_rounded(F.col(c)).cast("double"), 0.0, n - 1.0).cast("int")
    near = points.select(*by, key, at("x", width).alias("px"), at("y", height).alias("py")).withColumn("o", F.explode(o)).withColumns({"gx": F.col("px") + F.col("o.dx"), "gy": F.col("py") + F.col("o.dy")})
    best = near.join(valid.select(*by, "gx", "gy"), [*by, "gx", "gy"]).groupBy(*by, key).agg(F.min(F.struct("o", "gx", "gy")).alias("b"))
    return best.select(*by, key, "b.gx", "b.gy")


def measured(labelled: DataFrame, seeded: DataFrame, barrier: DataFrame, by: list[str]) -> DataFrame:
    """Components (label) that a seed lies in, and the barriers between them."""
    keys = [*by, "gx", "gy"]
    hit = labelled.join(seeded.select(*keys).distinct(), keys).select(*by, "label").distinct()
    return labelled.join(hit, [*by, "label"], "left_semi").select(*keys).unionByName(barrier.select(*keys)).distinct()


def colored_rooms(regions: DataFrame, points: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of regions (gx, gy, region; 0 is none) with a point in them, or within 3 pixels of a point that
    lies in none, and all pixels of no region."""
    at = lambda c, n: clamp(_rounded(F.col(c)).cast("double"), 0.0, n - 1.0).cast("int")
    place = points.select(at("x", width).alias("gx"), at("y", height).alias("gy")).distinct().join(regions, ["gx", "gy"], "left").withColumn("region", F.coalesce("region", F.lit(0)))
    around = F.explode(_offsets([(x, y) for x in range(-3, 4) for y in range(-3, 4)]))
    side = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c))
    lost = place.where("region = 0").select("gx", "gy", around.alias("o")).select(side(F.col("gx") + F.col("o.x"), width).alias("gx"), side(F.col("gy") + F.col("o.y"), height).alias("gy"))
    hit = place.where("region > 0").select("region").union(lost.join(regions.where("region > 0"), ["gx", "gy"]).select("region")).distinct()
    return regions.where("region > 0").join(hit, "region", "left_semi").select("gx", "gy").unionByName(regions.where("region = 0").select("gx", "gy"))


def filled_spans(cells: DataFrame, line: str, along: str, most_gap: int) -> DataFrame:
    """First and last cell of each line, with lines missing between two that are near filled in evenly."""
    ends = cells.groupBy(line).agg(F.min(along).alias("lo"), F.max(along).alias("hi"))
    w = Window.orderBy(line)  # one row to a line of the raster
    after = ends.withColumns({"next": F.lead(line).over(w), "lo2": F.lead("lo").over(w), "hi2": F.lead("hi").over(w)})
    gap = F.col("next") - F.col(line)
    fill = F.sequence(F.lit(0), F.when((gap > 1) & (gap <= most_gap), gap - 1).otherwise(F.lit(0)))
    t = F.col("k") / gap
    mixed = lambda a, b: F.when(F.col("k") == 0, F.col(a)).otherwise(_rounded(F.col(a) + (F.col(b) - F.col(a)) * t)).alias(a)
    return after.withColumn("k", F.explode(fill)).select((F.col(line) + F.col("k")).alias(line), mixed("lo", "lo2"), mixed("hi", "hi2"))


def footprint(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Cells that lie within the padded spans of both their row and their column."""
    gap, pad = max(6, math.floor(max(width, height) * 0.012 + 0.5)), max(1, math.floor(max(width, height) / 900 + 0.5))
    rows, columns = filled_spans(cells, "gy", "gx", gap), filled_spans(cells, "gx", "gy", gap)
    span = F.sequence(F.greatest(F.lit(0), F.col("lo") - pad), F.least(F.lit(width - 1), F.col("hi") + pad))
    each = rows.select("gy", F.explode(span).alias("gx"))
    return each.join(columns, "gx").where((F.col("gy") >= F.col("lo") - pad) & (F.col("gy") <= F.col("hi") + pad)).select("gx", "gy")


def median_filter(cells: DataFrame, width: int, height: int, radius: int, value: str = "value") -> DataFrame:
    """Upper median of the square around each cell of a full grid; beyond a border its cells repeat. Cells without a number don't
    count, and where they leave less than half a square there is no row. Each tile, with the cells just around it, is one
    small group, however large the grid is."""
    ship(cells.sparkSession)
    side = 2 * radius + 1
    tile = lambda c, n: F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col(c) - radius) / TILE).cast("int"), F.floor(F.least(F.lit(n - 1), F.col(c) + radius) / TILE).cast("int")))
    t = cells.select("gx", "gy", F.col(value).cast("double").alias("v")).withColumn("tx", tile("gx", width)).withColumn("ty", tile("gy", height))

    def median(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(key[0]) * TILE, int(key[1]) * TILE
        x1, y1 = min(width, x0 + TILE), min(height, y0 + TILE)
        left, top, right, low = max(0, x0 - radius), max(0, y0 - radius), min(width, x1 + radius), min(height, y1 + radius)
        image = np.full((low - top, right - left), np.nan)
        image[rows["gy"].to_numpy() - top, rows["gx"].to_numpy() - left] = rows["v"].to_numpy()
        padded = np.pad(image, ((radius - (y0 - top), radius - (low - y1)), (radius - (x0 - left), radius - (right - x1))), mode="edge")
        windows = np.lib.stride_tricks.sliding_window_view(padded, (side, side)).reshape(y1 - y0, x1 - x0, side * side)
        middle = np.sort(windows, axis=-1)[..., side * side // 2]  # what is missing comes last
        gy, gx = np.nonzero(~np.isnan(middle))
        return pd.DataFrame({"gx": (gx + x0).astype(np.int32), "gy": (gy + y0).astype(np.int32), "v": middle[gy, gx]})

    found = spread(t, "tx", "ty").groupBy("tx", "ty").applyInPandas(median, "gx int, gy int, v double")
    return found.select("gx", "gy", F.col("v").cast(cells.schema[value].dataType).alias(value))


def dark_shares(pixels: DataFrame, dark: Column, cell: int, step: int, least: float = 0.035) -> DataFrame:
    """Share of dark pixels, of every ``step``-th looked at, in each coarse cell, and whether that is dense."""
    looked = pixels.where((F.col("gx") % cell % step == 0) & (F.col("gy") % cell % step == 0))
    share = F.count_if(dark) / F.count(F.lit(1))
    return looked.groupBy(F.floor(F.col("gx") / cell).cast("int").alias("cx"), F.floor(F.col("gy") / cell).cast("int").alias("cy")).agg(share.alias("share"), (share >= least).alias("dense"))


def edge_background(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """One row: the mean colour of sampled border pixels; corners count for both of their sides."""
    sx, sy = max(1, width // 80), max(1, height // 80)
    x, y = F.col("gx"), F.col("gy")
    times = (x % sx == 0).cast("int") * ((y == 0).cast("int") + (y == height - 1).cast("int")) + (y % sy == 0).cast("int") * ((x == 0).cast("int") + (x == width - 1).cast("int"))
    counted = pixels.withColumn("n", times).where("n > 0")
    return counted.agg(*((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"))


def measured_rooms(rooms: DataFrame, points: DataFrame, plans: DataFrame) -> DataFrame:
    """Runs (plan, gy, x0, x1) of regions with a point in them, or within 3 pixels of a point that lies in none, and
    of all pixels of no region. ``rooms`` are runs with their region, ``points`` pixels (plan, gx, gy)."""
    from sigfield.operators.regions import complement

    at = rooms.select("plan", "gy", "x0", "x1", "region").hint("merge")
    own = points.select("plan", "gx", "gy").distinct().join(at, ["plan", "gy"]).where("gx between x0 and x1").select("plan", "gx", "gy", "region")
    lost = points.select("plan", "gx", "gy").distinct().join(own, ["plan", "gx", "gy"], "left_anti")
    near = lost.withColumn("gy", F.explode(F.sequence(F.col("gy") - 3, F.col("gy") + 3))).join(at, ["plan", "gy"]).where("x1 >= gx - 3 and x0 <= gx + 3")
    hit = own.select("plan", "region").union(near.select("plan", "region")).distinct()
    return at.join(hit.hint("merge"), ["plan", "region"], "left_semi").select("plan", "gy", "x0", "x1").unionByName(complement(at, plans))
