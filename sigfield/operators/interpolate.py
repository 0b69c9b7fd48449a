"""Interpolation of consolidated points over a plan grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigfield.functions import rf
from sigfield.functions.scalars import clamp, smoothstep
from sigfield.operators.masks import obstacle_loss
from sigfield.operators.spatial import nearest_site, points_in_reach, small, wall_loss
from sigfield.runtime import cut


def idw_grid(points: DataFrame, grid: DataFrame, by: list[str], power: float = 2.2) -> DataFrame:
    """Inverse distance mean of all consolidated points of a group at each grid cell; a point exactly on
    a cell's centre decides it, the first of several. Both sides are bounded per plan by their bins."""
    d = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    pairs = points.join(small(grid)).withColumn("d", d)
    hit = F.col("d") <= 1e-9
    w = rf.idw_weight(F.when(~hit, F.col("d")), power)
    out = pairs.groupBy(*by, "gx", "gy").agg(F.min_by("rssi", F.when(hit, F.col("first_idx"))).alias("exact"), (F.sum(w * F.col("rssi")) / F.sum(w)).alias("mean"))
    return out.select(*by, "gx", "gy", F.coalesce("exact", "mean").alias("rssi"))


def _lossy(rays: DataFrame, walls: DataFrame | None, obstacles: DataFrame | None, material: str, keys: list[str], px_per_m: float) -> DataFrame:
    """Rays (x, y) to (tx, ty) of a band with ``wall_db``: the loss of crossed walls and of obstacle pixels on the way."""
    out = rays.withColumn("wall_db", F.lit(0.0)) if walls is None else wall_loss(rays, walls, keys, keep=True)
    if obstacles is None:
        return out
    met = obstacle_loss(out, obstacles, keys, px_per_m, material)
    return met.withColumn("wall_db", F.col("wall_db") + F.col("obstacle_db")).drop("runs", "blocked", "obstacle_db")


def _said(m: Column, radius_m: Column) -> Column:
    """What an access point (x, y, gain, signal, directional, azimuth) gives at (tx, ty), m metres away."""
    bearing = F.degrees(F.atan2(F.col("ty") - F.col("y"), F.col("tx") - F.col("x")))
    antenna = rf.antenna_loss_db(F.col("directional"), F.col("azimuth"), bearing)
    return rf.predicted_rssi(m, F.col("band"), F.col("signal"), F.col("gain"), radius_m, F.col("wall_db"), antenna)


def antennas(aps: DataFrame) -> DataFrame:
    """Access points (ax, ay, gain, signal) with ``directional``, ``azimuth`` in degrees and ``ap_radius_m``; those without
    them send alike in all directions, to the layer's radius. A gain that is not known is 3 dB."""
    rest = {"gain": F.lit(3.0), "directional": F.lit(False), "azimuth": F.lit(0.0), "ap_radius_m": F.lit(None).cast("double")}
    return aps.select("ax", "ay", "signal", *((F.coalesce(F.col(c), v) if c in aps.columns else v).alias(c) for c, v in rest.items()))


def residuals(points: DataFrame, ap: DataFrame, walls: DataFrame | None, px_per_m: float, keys: list[str], obstacles: DataFrame | None = None, material: str = "drywall") -> DataFrame:
    """Add to points (x, y, rssi, band, radius_m) ``residual_db``: what they have beyond the prediction of
    the access point (one row: ax, ay, gain, signal, and what ``antennas`` adds), within 32 dB."""
    rays = points.join(F.broadcast(antennas(ap))).withColumnsRenamed({"x": "tx", "y": "ty", "ax": "x", "ay": "y"})  # one row
    heard = _lossy(rays, walls, obstacles, material, keys, px_per_m).withColumn("far", F.hypot(F.col("tx") - F.col("x"), F.col("ty") - F.col("y")) / px_per_m)
    said = _said(F.col("far"), F.coalesce("ap_radius_m", "radius_m"))
    places = [F.col({"x": "tx", "y": "ty"}.get(c, c)).alias(c) for c in points.columns]
    return heard.select(*places, clamp(F.col("rssi") - said, -32.0, 32.0).alias("residual_db"))


def rf_grid(points: DataFrame, grid: DataFrame, walls: DataFrame | None, ap: DataFrame | None, px_per_m: float, by: list[str], radius_m: float | None = None, power: float = 2.2, obstacles: DataFrame | None = None, material: str = "drywall") -> DataFrame:
    """Interpolation with propagation losses at each grid cell, over the nearest points within the band's
    radius (24, 48 or all of them, by their number): distances stretched by walls and obstacle pixels, an adaptive power,
    adjusted signals, and a confidence. With an access point, its prediction corrected by the points'
    residuals is blended in, more so far from points and behind walls; a cell out of all points' reach takes
    the prediction, or without an access point the nearest point. A point on the cell decides it. ``wall_db`` and ``shadow_db``
    are the losses that the cell's signal went through.

    The grid has the cells of every layer, or with the layer's keys those of each. Cells meet points in squares of the
    radius' size and keep the nearest before walls are looked at; only cells out of all points' reach look for their
    nearest point."""
    radius = F.lit(radius_m) if radius_m else rf.of_band(F.col("band"), 2)
    sized = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n_points"))
    points = points.join(small(sized), by).withColumn("radius_m", radius).withColumn("residual_db", F.lit(0.0))
    if ap is not None:
        points = residuals(points.drop("residual_db"), ap, walls, px_per_m, [*by, "first_idx"], obstacles, material)
    points = cut(points.withColumn("reach", F.col("radius_m") * px_per_m), "points")
    reach, cell = F.col("reach"), [*by, "gx", "gy"]
    layers = small(points.select(*by).distinct())
    of_layers = [c for c in by if c in grid.columns]
    cells = grid.select(*of_layers, "gx", "gy", "tx", "ty")
    cells = cells.join(layers, of_layers) if of_layers else cells.join(layers)  # the cells of each layer
    near = points_in_reach(cells, points, "reach", by, 64).where(F.col("rank") <= neighbours(F.col("n_points")))
    near = cut(near, "near")
    alone = nearest_site(cells.join(near.select(*cell).distinct(), cell, "left_anti"), points, "first_idx", by)
    alone = alone.select(*cell, "tx", "ty", *(F.col(f"site.{c}").alias(c) for c in points.columns if c not in by), "d", F.lit(0.0).alias("falloff"), F.lit(1).alias("rank"))
    near = near.unionByName(alone)
    lossy = _lossy(near, walls, obstacles, material, [*cell, "first_idx"], px_per_m)
    wall, far, counts, shade = F.col("wall_db"), F.col("d"), F.col("falloff") > 0.002, rf.shadow_db(F.col("wall_db"), F.col("band"))
    total = rf.propagation_loss_db(far / px_per_m, wall, F.col("band"))
    stretched = F.greatest(far + wall * px_per_m * 0.09, F.lit(0.1))
    p = clamp(F.lit(power) + smoothstep(reach * 0.2, reach, far + wall * px_per_m * 0.09) * 0.36, 1.35, 4.4)
    w = F.when(counts, rf.idw_weight(stretched, p, px_per_m * 0.16) * F.col("falloff"))
    rw = F.when(counts, rf.idw_weight(stretched, max(power, 2.2), px_per_m * 0.1) * F.col("falloff"))
    lone = F.struct((F.col("rssi") - total * 0.42 - wall * 0.28).alias("rssi"), clamp((F.lit(1.0) - smoothstep(reach, reach * 1.45, far)) * 0.22, 0.0, 0.22).alias("confidence"), far.alias("d"), wall.alias("wall"), shade.alias("shadow"))
    weighed = lossy.withColumns({"w": w, "rw": rw, "v": F.col("rssi") - total * 0.34 - wall * 0.42, "shade": shade, "lone": F.when(F.col("rank") == 1, lone)})
    mean = lambda c, weight="w": F.sum(F.col(weight) * F.col(c)) / F.sum(weight)
    out = weighed.groupBy(*cell).agg(
        F.min_by("rssi", F.when(far <= 1e-9, F.col("first_idx"))).alias("exact"), mean("v").alias("mean"), mean("residual_db", "rw").alias("residual"), mean("wall_db").alias("mean_wall"), mean("shade").alias("mean_shade"),
        F.max(F.when(counts, F.col("falloff"))).alias("near"), F.max("lone").alias("lone"), F.max("radius_m").alias("radius_m"),
    )
    measured, beyond, sure = F.col("mean"), F.col("lone.rssi"), F.col("lone.confidence")
    lost, shadow = F.coalesce("mean_wall", "lone.wall"), F.coalesce("mean_shade", "lone.shadow")
    if ap is not None:
        offset = small(points.groupBy(*by).agg(clamp(F.avg("residual_db"), -28.0, 28.0).alias("offset")))
        rays = out.join(cells, cell).join(F.broadcast(antennas(ap).withColumnsRenamed({"ax": "x", "ay": "y"})))  # one row
        heard = _lossy(rays, walls, obstacles, material, cell, px_per_m).withColumn("ap_m", F.hypot(F.col("tx") - F.col("x"), F.col("ty") - F.col("y")) / px_per_m)
        ap_radius = F.coalesce("ap_radius_m", "radius_m")
        heard = heard.select(*out.columns, "ap_m", F.col("wall_db").alias("ap_wall"), ap_radius.alias("ap_radius"), _said(F.col("ap_m"), ap_radius).alias("said"))
        out = heard.join(offset, by)
        r = F.col("radius_m") * px_per_m
        blend = clamp(F.lit(0.26) + smoothstep(r * 0.16, r * 0.96, F.col("lone.d")) * 0.38 + smoothstep(6.0, 28.0, F.col("ap_wall")) * 0.14, 0.18, 0.72)
        measured = measured * (F.lit(1.0) - blend) + (F.col("said") + F.col("residual")) * blend
        beyond = clamp(F.col("said") + F.col("offset"), -96.0, -24.0)
        reaches = clamp(F.col("ap_radius"), 4.0, 120.0)
        sure = clamp(F.lit(0.12) + (F.lit(1.0) - smoothstep(reaches * 0.9, reaches * 1.35, F.col("ap_m"))) * 0.34, 0.08, 0.46)
        lost, shadow = F.greatest("mean_wall", "ap_wall"), F.greatest("mean_shade", rf.shadow_db(F.col("ap_wall"), F.col("band")))
    hit = F.col("exact").isNotNull()
    rssi = F.coalesce("exact", clamp(measured, -96.0, -24.0), beyond)
    confidence = F.when(hit, 1.0).when(F.col("near").isNotNull(), clamp(F.col("near") * 0.82 + 0.18, 0.0, 1.0)).otherwise(sure)
    return out.select(*cell, rssi.alias("rssi"), confidence.alias("confidence"), F.when(hit, 0.0).otherwise(lost).alias("wall_db"), F.when(hit, 0.0).otherwise(shadow).alias("shadow_db"))


def derive_6ghz(layer: DataFrame) -> DataFrame:
    """A 6 GHz layer's statistics from the 5 GHz layer's: shifted by -4.5 dB, coverage as it is."""
    return layer.where("band = '5ghz'").withColumns({c: F.round(F.col(c) - 4.5, 1) for c in ("min_rssi", "max_rssi", "avg_rssi")}).withColumn("band", F.lit("6ghz"))


def nearest_distance(points: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """Pixels from each grid cell to the nearest consolidated point of a group."""
    d = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    return points.join(small(grid)).groupBy(*by, "gx", "gy").agg(F.min(d).alias("distance_px"))


def neighbours(n: Column) -> Column:
    """How many points a cell looks at in a survey of n."""
    return F.when(n > 120, F.lit(24)).when(n > 64, F.lit(48)).otherwise(n)


def settings(width: Column, height: Column, n: Column) -> dict[str, Column]:
    """A layer's defaults for a plan's size and number of points: grid step, neighbours, blur and feather in
    pixels, and the factor that brings the plan to the size it is worked on."""
    side, dense = F.greatest(width, height), n > 120
    cells = F.when(dense, 26000.0).when(n > 64, 62000.0).otherwise(90000.0)
    step = F.greatest(clamp(F.floor(side / 980 + 0.5).cast("double"), 3.0, 6.0), F.ceil(F.sqrt(F.greatest(width * height, F.lit(1.0)) / cells)).cast("double"))
    most = F.when(dense, 1.0 * 14).otherwise(10.0)
    return {
        "step": clamp(step, 3.0, most).cast("int"), "neighbours": neighbours(n).cast("long"), "blur_px": clamp(side / 65, 13.0, 22.0), "feather_px": clamp(side / 900, 1.2, 4.5),
        "factor": F.least(F.lit(1.0), F.when(dense, 900.0).otherwise(1200.0) / F.greatest(side, F.lit(1.0))),
    }
