"""Survey points with one column for each band: selecting, editing, importing and combining them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigfield.functions.scalars import clamp, is_finite, normalize_point_id, round_half_up

BANDS = ("24ghz", "5ghz", "6ghz")
# fixed values: names of bands
LABELS = {"24ghz": "2.4GHz", "5ghz": "5GHz", "6ghz": "6GHz"}


def band_label(band: Column) -> Column:
    return F.coalesce(*(F.when(band == b, label) for b, label in LABELS.items()))


def rssi_of(band: str, derived: bool = True) -> Column:
    """A band's signal; 6 GHz, where not measured, is 4.5 dB below 5 GHz."""
    if band != "6ghz" or not derived:
        return F.col(f"rssi_{band}")
    return F.coalesce(F.col("rssi_6ghz"), F.col("rssi_5ghz") - 4.5)


def usable(points: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each point and band that it has a signal of: keys, x, y, band, label, rssi."""
    each = F.array(*(F.struct(F.lit(b).alias("band"), rssi_of(b).alias("rssi")) for b in BANDS))
    rows = points.select(*keys, "x", "y", F.explode(each).alias("b")).select(*keys, "x", "y", "b.*").where(is_finite(F.col("rssi")))
    return rows.withColumn("label", band_label(F.col("band")))


def imported(rows: DataFrame, now: str) -> DataFrame:
    """Points of survey rows that have coordinates; rows without a time get ``now``."""
    kept = rows.where("x is not null and y is not null")
    number = F.concat(F.lit("P"), F.col("row_idx").cast("string"))
    stamp = F.when(F.trim("timestamp") != "", F.col("timestamp")).otherwise(F.lit(now))
    return kept.select("row_idx", normalize_point_id(F.col("raw_id"), number).alias("point_id"), "x", "y", *(f"rssi_{b}" for b in BANDS), F.lit(None).cast("double").alias("distance_m"), F.col("distance_m").alias("csv_distance_m"), stamp.alias("timestamp"), F.lit("csv").alias("source"))


def nudged(points: DataFrame, dx_m: float, dy_m: float, px_per_m: float | None) -> DataFrame:
    """Imported points moved by metres; nothing moves without a scale."""
    if not px_per_m or not 0 < px_per_m < float("inf"):
        return points
    moved = F.col("source") == "csv"
    return points.withColumns({c: F.when(moved, F.col(c) + d * px_per_m).otherwise(F.col(c)) for c, d in (("x", dx_m), ("y", dy_m))})


def scaled(df: DataFrame, factor: float, columns: list[str]) -> DataFrame:
    """Coordinates multiplied by a factor."""
    return df.withColumns({c: F.col(c) * factor for c in columns})


def edited(points: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Points with the rows of ``changes`` (key, removed, and columns to replace where not null) applied:
    removed ones go, known ones change, others are added."""
    fields = [c for c in points.columns if c != key]
    new = changes.select(key, F.coalesce("removed", F.lit(False)).alias("removed_"), *(F.col(c).alias(f"{c}_") if c in changes.columns else F.lit(None).cast(points.schema[c].dataType).alias(f"{c}_") for c in fields))
    both = points.join(new, key, "full").where("not coalesce(removed_, false)")
    return both.select(key, *(F.coalesce(f"{c}_", c).alias(c) for c in fields))


def merged_import(points: DataFrame, rows: DataFrame, matched: DataFrame, survey: bool) -> DataFrame:
    """The points after an import of ``rows`` (as from ``imported``), given which row each point matched
    (point_id, row_idx). Survey rows, or more rows than three quarters of the points and 50, replace all;
    else matched points take what the row knows, and unmatched rows are added."""
    n, m = points.count(), rows.count()
    if not n or survey or m > max(n * 0.75, 50):
        return rows
    fields = ["x", "y", *(f"rssi_{b}" for b in BANDS), "csv_distance_m", "timestamp"]
    new = rows.select("row_idx", *(F.col(c).alias(f"{c}_") for c in fields))
    found = points.drop("row_idx").join(matched.select("point_id", "row_idx"), "point_id", "left").join(new, "row_idx", "left")
    source = F.when(F.col("x_").isNotNull(), "csv").otherwise(F.col("source"))
    kept = found.select("row_idx", "point_id", *(F.coalesce(f"{c}_", c).alias(c) for c in fields), "distance_m", source.alias("source"))
    added = rows.join(matched.select("row_idx").distinct(), "row_idx", "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def elements(aps: DataFrame, points: DataFrame) -> DataFrame:
    """Access points and points as one table of anchors."""
    routers = aps.select(F.concat(F.lit("ap"), F.col("ap_id").cast("string")).alias("element"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit("router").alias("kind"))
    return routers.unionByName(points.select(F.col("point_id").alias("element"), "x", "y", F.lit("measurement").alias("kind")))


def plan_key(name: Column, size: Column, width: Column, height: Column, enhanced: Column) -> Column:
    """What a plan's image is known by: another image has another key, and no calibration."""
    shape = F.concat_ws("x", width.cast("string"), height.cast("string"))
    return F.when(name.isNull(), "none").otherwise(F.concat_ws(":", name, size.cast("string"), shape, F.when(enhanced, "bw").otherwise("raw")))


def next_manual_id(points: DataFrame) -> DataFrame:
    """One row: the id after the highest P number."""
    n = F.regexp_extract(F.upper("point_id"), r"^P([0-9]+)$", 1).try_cast("long")
    return points.agg(F.concat(F.lit("P"), (F.coalesce(F.max(n), F.lit(0)) + 1).cast("string")).alias("point_id"))


def marker_radius(width: Column, height: Column) -> Column:
    """Radius of a point's mark on a plan of that size."""
    return round_half_up(clamp(F.greatest(width, height) * 0.0075, 6.0, 42.0), 1)


def marker_scale(width: Column, height: Column) -> Column:
    """Size of marks drawn over a layer."""
    return clamp(F.greatest(width, height) / 1400, 0.52, 0.78)
