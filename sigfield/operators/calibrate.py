"""Calibration of plans: a scale from two points, by hand, or from known sides; the gate; world places.

Everything takes tables of many plans. ``px_per_m`` is null where a plan is not calibrated; what needs a
scale either gives null there or, behind ``required``, stops the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigfield.functions.scalars import is_finite

# fixed values: pixels between distinct points, between good ones, and the usual scales
DISTINCT, GOOD, LEAST, MOST = 1e-6, 40.0, 5.0, 1000.0


class CalibrationError(ValueError):
    """A plan without a scale was asked for metres."""

    code = "calibration_required"


def derive(plans: DataFrame) -> DataFrame:
    """Add ``px_per_m``, ``m_per_px``, ``status`` and ``codes`` to plans (mode, manual_px_per_m, ax, ay, bx,
    by, known_m): errors leave the plan uncalibrated, warnings don't."""
    manual, known = F.col("manual_px_per_m"), F.col("known_m")
    apart = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    by_hand = F.col("mode") == "manual"
    good = lambda v: is_finite(v) & (v > 0)
    scale = F.when(by_hand & good(manual), manual).when(~by_hand & good(known) & (apart > DISTINCT), apart / F.nullif(known, F.lit(0.0)))
    codes = F.array_compact(
        F.array(
            F.when(F.when(by_hand, ~good(manual)).otherwise(~good(known)), "scale_required"),
            F.when(~by_hand & (apart <= DISTINCT), "scale_two_points").when(~by_hand & (apart < GOOD), "scale_separation"),
            F.when((F.col("px_per_m") < LEAST) | (F.col("px_per_m") > MOST), "scale_range"),
        )
    )
    out = plans.withColumn("px_per_m", scale)
    return out.withColumns({"m_per_px": 1 / F.col("px_per_m"), "status": F.when(F.col("px_per_m").isNull(), "uncalibrated").otherwise("calibrated"), "codes": codes})


def px_per_m_of_sides(width: Column, height: Column, width_m: Column, height_m: Column) -> Column:
    """Mean of the scales that the known sides give; 0 if none is known."""
    sides = F.array_compact(F.array(*(F.when(m > 0, px / F.nullif(m, F.lit(0.0))) for px, m in ((width, width_m), (height, height_m)))))
    return F.when(F.size(sides) > 0, F.aggregate(sides, F.lit(0.0), lambda s, x: s + x) / F.size(sides)).otherwise(F.lit(0.0))


def required(plans: DataFrame) -> DataFrame:
    """The plans, each with a scale; a query over a plan without one fails."""
    fail = F.raise_error(F.lit(f"{CalibrationError.code}: a plan has no scale")).cast("double")
    return plans.withColumn("px_per_m", F.when(F.col("px_per_m").isNotNull(), F.col("px_per_m")).otherwise(fail))


def require(plans: DataFrame) -> DataFrame:
    """The same, checked at once."""
    if plans.where("px_per_m is null").limit(1).count():
        raise CalibrationError("a plan has no scale")
    return plans


def world(elements: DataFrame, plans: DataFrame, by: list[str]) -> DataFrame:
    """Add ``world`` (x, y in metres) to elements (x, y in pixels) of plans (px_per_m, ox, oy): null where
    the plan has no scale. Anchors stay, so a new calibration needs only another call."""
    kept = plans.select(*by, F.col("px_per_m").alias("scale_"), F.col("ox").alias("ox_"), F.col("oy").alias("oy_"))
    place = F.struct(((F.col("x") - F.col("ox_")) / F.col("scale_")).alias("x"), ((F.col("y") - F.col("oy_")) / F.col("scale_")).alias("y"))
    return elements.join(kept, by, "left").withColumn("world", F.when(F.col("scale_").isNotNull(), place)).drop("scale_", "ox_", "oy_")


def anchor(world_x: Column, world_y: Column, px_per_m: Column, ox: Column, oy: Column) -> Column:
    """The plan's pixel of a place in metres."""
    return F.struct((world_x * px_per_m + ox).alias("x"), (world_y * px_per_m + oy).alias("y"))


def scaled_side(v: Column, factor: float | Column) -> Column:
    """A side in pixels after scaling, at least 1."""
    return F.greatest(F.lit(1.0), F.floor(v * factor + 0.5))


def scaled_blur(v: Column, factor: float | Column) -> Column:
    return F.greatest(F.lit(2.0), v * factor)
