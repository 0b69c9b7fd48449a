"""Data quality rules: rows of (severity, code, ...), one pass over the rows that they judge.

A report is limited as a user reads it, by ``report``: the first issues in the order of the points, and one
row that tells how many were left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigfield.functions.scalars import is_finite
from sigfield.operators.spatial import proximity_pairs

# fixed values: limits of reports and of the search for points that lie close
COORDINATE_CAP, RSSI_CAP, CLOSE_CAP, CLOSE_POINTS = 160, 160, 40, 1200
# fixed values: media types of plans
MIMES = ("image/png", "image/jpeg", "image/jpg", "image/svg+xml", "application/pdf")


def _issue(condition: Column, severity: str, code: str, **more: Column) -> Column:
    return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), *(v.alias(k) for k, v in more.items())))


def _listed(df: DataFrame, keys: list[str], *issues: Column) -> DataFrame:
    """One row for each issue that is not null, with its place in the list."""
    return df.select(*keys, F.posexplode(F.array_compact(F.array(*issues))).alias("pos", "x")).select(*keys, "pos", "x.*")


def inside(x: Column, y: Column, width: float, height: float) -> Column:
    return (x >= 0) & (y >= 0) & (x < width) & (y < height)


def point_issues(points: DataFrame, width: float, height: float, key: str = "row_idx") -> DataFrame:
    """Points without finite coordinates, or outside the plan, whose right and lower edges are outside."""
    x, y = F.col("x"), F.col("y")
    finite = is_finite(x) & is_finite(y)
    found = _listed(points, [key], _issue(~finite, "error", "point_coordinates"), _issue(finite & ~inside(x, y, width, height), "error", "point_inside"))
    return found.select(F.col(key).alias("point_id"), "severity", "code")


def close_points(pairs: DataFrame, n_points: int) -> DataFrame:
    """A warning for each pair (i, j) of points marked by hand that lie close; none for larger surveys."""
    found = pairs.select(F.col("i").alias("point_id"), F.col("j").alias("other_id"), F.lit("warning").alias("severity"), F.lit("point_duplicate").alias("code"))
    return found if n_points <= CLOSE_POINTS else found.where("false")


def close_reports(points: DataFrame, by: list[str], within: float = 8.0) -> DataFrame:
    """For each survey of at most CLOSE_POINTS points (row_idx, x, y, source), a warning for each of the first CLOSE_CAP
    pairs of points closer than ``within`` pixels, and one with the number of the others (``omitted``). Imported points
    are not looked at, but count for the survey's size."""
    few = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= CLOSE_POINTS).select(*by)
    marked = points.where("source is null or source <> 'csv'").join(few, by, "left_semi")
    pairs = proximity_pairs(marked, within, by=tuple(by)).select(*by, F.col("i").alias("point_id"), F.col("j").alias("other_id"))
    group = Window.partitionBy(*by)  # of a survey's few points
    ranked = pairs.withColumn("k", F.row_number().over(group.orderBy("point_id", "other_id")))
    said = lambda code: (F.lit("warning").alias("severity"), F.lit(code).alias("code"))
    first = ranked.where(F.col("k") <= CLOSE_CAP).select(*by, *said("point_duplicate"), "point_id", "other_id", F.lit(None).cast("long").alias("omitted"))
    rest = ranked.groupBy(*by).agg((F.count(F.lit(1)) - CLOSE_CAP).alias("omitted")).where("omitted > 0")
    return first.unionByName(rest.select(*by, *said("point_duplicate_truncated"), "omitted"), allowMissingColumns=True)


def rssi_issues(points: DataFrame, bands: tuple[str, ...] = ("24ghz", "5ghz"), key: str = "row_idx") -> DataFrame:
    """Signals outside -100 to -10 dBm, points without any of the bands, stated distances that are off."""
    values = {b: F.col(f"rssi_{b}") for b in bands}
    ranges = [_issue(is_finite(v) & ((v < -100) | (v > -10)), "error", "rssi_range", band=F.lit(b)) for b, v in values.items()]
    none = ~F.greatest(F.lit(False), *(is_finite(v) for v in values.values()))
    nobody = F.lit(None).cast("string")
    found = _listed(points, [key], *ranges, _issue(none, "error", "rssi_required", band=nobody), _issue(distance_off(), "warning", "distance_audit", band=nobody))
    return found.select(F.col(key).alias("point_id"), "pos", "severity", "code", "band")


def silent_bands(points: DataFrame, bands: tuple[str, ...] = ("24ghz", "5ghz")) -> DataFrame:
    """An error for each band that no point has a signal of."""
    counts = points.agg(*(F.count_if(is_finite(F.col(f"rssi_{b}"))).alias(b) for b in bands))
    return _listed(counts, [], *(_issue(F.col(b) == 0, "error", "rssi_band_required", band=F.lit(b)) for b in bands)).drop("pos")


def report(issues: DataFrame, cap: int, order: list[str], code: str) -> DataFrame:
    """The first ``cap`` issues and, if there are more, a warning with their number (``omitted``)."""
    first = issues.orderBy(*order).limit(cap).withColumn("omitted", F.lit(None).cast("long"))
    rest = issues.agg((F.count(F.lit(1)) - cap).alias("omitted")).where("omitted > 0")
    return first.unionByName(rest.select(F.lit("warning").alias("severity"), F.lit(code).alias("code"), "omitted"), allowMissingColumns=True)


def capped(issues: DataFrame, cap: int, by: list[str], order: str) -> DataFrame:
    """The first ``cap`` issues of each group: a report's limit; Spark limits before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return issues.withColumn("place", rank).where(F.col("place") <= cap)


def distance_off() -> Column:
    """Whether a stated distance is off by more than 1 m and a quarter of the computed one."""
    off = F.abs(F.col("csv_distance_m") - F.col("distance_m"))
    return F.coalesce(off > F.greatest(F.lit(1.0), F.col("distance_m") * 0.25), F.lit(False))


def distance_audit(points: DataFrame) -> DataFrame:
    return points.where(distance_off())


def has_blocking(issues: DataFrame) -> bool:
    return bool(issues.where("severity = 'error'").limit(1).count())


def file_issues(files: DataFrame, key: str = "path") -> DataFrame:
    """Type and size rules over binaryFile metadata (path, length, mime)."""
    size, pdf = F.col("length"), F.coalesce(F.col("mime") == "application/pdf", F.lit(False))
    over = lambda large, small: F.when(pdf, size > large * 1048576).otherwise(size > small * 1048576)
    return _listed(
        files, [key], _issue(F.coalesce(~F.col("mime").isin(*MIMES), F.lit(True)), "error", "floorplan_type"),
        _issue(over(50, 12), "error", "floorplan_size"), _issue(over(30, 8) & ~over(50, 12), "warning", "floorplan_size_warning"),
    ).drop("pos")


def image_issues(images: DataFrame, key: str) -> DataFrame:
    """Resolution and shape rules over (width, height)."""
    w, h = F.col("width"), F.col("height")
    return _listed(
        images, [key], _issue((w < 600) | (h < 400), "warning", "floorplan_resolution"), _issue((w > 3600) | (h > 3600), "warning", "floorplan_resolution_large"),
        _issue((w / h < 0.35) | (w / h > 3.2), "warning", "floorplan_ratio"),
    ).drop("pos")


def scale_issues(plans: DataFrame, key: str) -> DataFrame:
    """Rules over (mode, px_per_m, n_points): the gate, a valid and usual scale, two points for two-point mode."""
    v = F.col("px_per_m")
    bad = ~(is_finite(v) & (v > 0))
    return _listed(
        plans, [key], _issue(bad, "error", "calibration_required"), _issue(bad, "error", "scale_required"), _issue((v < 5) | (v > 1000) & ~F.isnan(v), "warning", "scale_range"),
        _issue((F.col("mode") == "two-point") & (F.col("n_points") != 2), "error", "scale_two_points"),
    ).drop("pos")


def router_issues(aps: DataFrame, width: float, height: float) -> DataFrame:
    """At least one access point; each inside the plan."""
    outside = aps.where(~inside(F.col("ax"), F.col("ay"), width, height)).select(F.lit("error").alias("severity"), F.lit("ap_inside").alias("code"), F.col("ap_id").cast("long").alias("ap_id"))
    none = aps.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("error").alias("severity"), F.lit("ap_required").alias("code"), F.lit(None).cast("long").alias("ap_id"))
    return outside.union(none)


def aspect_issues(crops: DataFrame, key: str, most: float = 0.1) -> DataFrame:
    """Crops whose shape differs by more than a tenth from that of the stated sides."""
    off = F.abs(F.col("width") / F.col("height") / (F.col("width_m") / F.col("height_m")) - 1)
    return crops.where(off > most).select(key, F.lit("warning").alias("severity"), F.lit("crop_aspect_mismatch").alias("code"), F.floor(off * 100 + 0.5).cast("long").alias("pct"))


def open_steps(found: DataFrame) -> DataFrame:
    """Which steps of a site's survey may be opened, from the numbers of errors by rule set: has_plan, and
    scale, router, points, rssi errors."""
    plan, ok = F.col("has_plan"), lambda *c: F.greatest(*(F.col(x) for x in (*c, c[0]))) == 0
    steps = {"scale": plan, "router": plan & ok("scale_errors"), "points": plan & ok("router_errors"), "review": ok("points_errors", "rssi_errors"), "generate": plan & ok("scale_errors", "router_errors", "points_errors", "rssi_errors")}
    return found.select("site", *(v.alias(f"can_{k}") for k, v in steps.items()))
