"""Quality classes, scores, contour and colours of signal strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigfield.functions.scalars import clamp, round_half_up, smoothstep

FIRST, LAST, STEPS = -80.0, -20.0, 11
# fixed values: the legend's colours from the weakest to the strongest breakpoint
COLORS = [(250, 5, 0), (255, 100, 8), (254, 190, 20), (236, 252, 27), (144, 253, 18), (51, 251, 11), (7, 252, 56), (4, 253, 142), (2, 255, 234), (1, 214, 255), (1, 162, 255), (0, 107, 255)]


def throughput_mbps(rssi: Column) -> Column:
    return F.when(rssi >= -45, 940).when(rssi >= -55, 720).when(rssi >= -65, 420).when(rssi >= -72, 190).when(rssi >= -80, 55).otherwise(8)


def latency_ms(rssi: Column, weak_pct: Column, dead_pct: Column) -> Column:
    far = F.when(rssi >= -55, 0.0).otherwise(F.abs(rssi + 55) * 0.28)
    return round_half_up(F.least(F.lit(80.0), far + 4.2 + weak_pct * 0.05 + dead_pct * 0.14), 1)


def channel_quality(rssi: Column, coverage_pct: Column, dead_pct: Column) -> Column:
    return round_half_up(clamp((rssi + 90) / 60 * 100, 0.0, 100.0) * 0.46 + coverage_pct * 0.42 + (F.lit(100.0) - dead_pct) * 0.12, 1)


def roaming_score(coverage_pct: Column, channel: Column) -> Column:
    return round_half_up(F.least(F.lit(100.0), coverage_pct * 0.72 + channel * 0.28), 1)


def quality_class(rssi: Column, coverage: float = -67, weak: float = -75, dead: float = -85) -> Column:
    return F.when(rssi >= -50, "excellent").when(rssi >= coverage, "good").when(rssi >= weak, "fair").when(rssi > dead, "weak").otherwise("dead")


def contour_rssi(rssi: Column) -> Column:
    """Signal eased toward the middle of its legend band."""
    width = (LAST - FIRST) / STEPS
    band = clamp(F.floor((rssi - FIRST) / width).cast("double"), 0.0, STEPS - 1.0)
    lower = F.lit(FIRST) + band * width
    return lower + smoothstep(lower + 0.65, lower + width - 0.65, rssi) * width


def legend_bucket(rssi: Column) -> Column:
    """Number of the legend's band, 0 to 10."""
    return clamp(F.floor((rssi - FIRST) / ((LAST - FIRST) / STEPS)).cast("double"), 0.0, STEPS - 1.0).cast("int")


def cell_alpha(confidence: Column, lift: Column) -> Column:
    return clamp(F.lit(0.66) + confidence * 0.26 + lift * 0.06, 0.62, 0.96)


def rssi_color(rssi: Column) -> Column:
    """(r, g, b) of a signal: neighbouring legend colours mixed in linear light."""
    width = (LAST - FIRST) / STEPS
    place = clamp((rssi - FIRST) / width, 0.0, float(STEPS))
    i = F.least(F.floor(place), F.lit(STEPS - 1)).cast("int")
    t = place - i

    def linear(c: Column) -> Column:
        v = c / 255
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    def mixed(k: int) -> Column:
        stops = F.array(*(F.lit(float(c[k])) for c in COLORS))
        v = linear(F.get(stops, i)) * (F.lit(1.0) - t) + linear(F.get(stops, i + 1)) * t
        return F.floor(F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055) * 255 + 0.5).cast("int")

    return F.struct(*(mixed(k).alias(n) for k, n in enumerate("rgb")))


def painted(cells: DataFrame, dead: float = -85) -> DataFrame:
    """Colour and opacity (r, g, b, a) of a layer's visible cells (rssi, alpha, shadow)."""
    v = F.col("rssi")
    lift = F.when(v <= dead, 0.06).otherwise(0.0) + F.when(v <= -82, 0.08).otherwise(0.0)
    opacity = clamp(F.lit(0.74) + F.col("alpha") * 0.22 + lift - F.col("shadow") * 0.04, 0.0, 0.98)
    shown = cells.where("alpha > 0.025").withColumn("c", rssi_color(contour_rssi(v)))
    # rounded to nine digits first, so that the last bit doesn't decide a half
    return shown.withColumn("a", F.floor(F.round(opacity * 255, 9) + 0.5).cast("int")).select("*", "c.*").drop("c")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def saturation(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top > 0, (top - low) / F.nullif(top, F.lit(0))).otherwise(F.lit(0.0))


def hue_degrees(r: Column, g: Column, b: Column) -> Column:
    top, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    safe = F.nullif(span, F.lit(0))
    h = F.when(top == r, (g - b) / safe).when(top == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4) * 60
    return F.when(span == 0, F.lit(0.0)).when(h < 0, h + 360).otherwise(h)
