"""Placing survey rows on a plan: robust ranges, sentinels, fitting, grid consolidation, sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigfield.functions.scalars import clamp, exact_mean, is_finite, round_half_up
from sigfield.operators.ranks import running
from sigfield.operators.spatial import small
from sigfield.runtime import cut

CONSOLIDATE_BINS, GENERATION_BINS = 900, 600


def nearest_rank(df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Percentiles by rank round((n-1)q), one row per group: values are counted before the shuffle, and the
    running count over distinct values is taken range by range."""
    by = by or []
    seen = df.where(is_finite(F.col(value))).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = running(seen, ["v"], by, F.col("c"))
    at = lambda q: F.floor((F.col("total") - 1) * q + 0.5) + 1
    return ranked.groupBy(*by).agg(*(F.min(F.when(F.col("upto") >= at(q), F.col("v"))).alias(n) for n, q in qs.items()), F.max("total").alias("n"))


def median_and_mad(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median and median absolute deviation of each group."""
    middle = nearest_rank(df, value, {"median": 0.5}, by).drop("n")
    off = df.join(small(middle), by).withColumn("off", F.abs(F.col(value) - F.col("median")))
    return middle.join(nearest_rank(off, "off", {"mad": 0.5}, by), by)


def is_sentinel(v: Column, median: Column, mad: Column) -> Column:
    """A placeholder coordinate: absurdly far from the others."""
    return F.abs(v - median) > F.greatest(mad, F.lit(0.01)) * 500


def _with_sentinels(rows: DataFrame, by: list[str]) -> DataFrame:
    """Add ``bad``: whether a row's x or y is a sentinel of its group."""
    stats = None
    for c in ("x", "y"):
        s = median_and_mad(rows, c, by).select(*by, F.col("median").alias(f"median_{c}"), F.col("mad").alias(f"mad_{c}"))
        stats = s if stats is None else stats.join(s, by)
    bad = is_sentinel(F.col("x"), F.col("median_x"), F.col("mad_x")) | is_sentinel(F.col("y"), F.col("median_y"), F.col("mad_y"))
    return rows.join(small(stats), by, "left").withColumn("bad", F.coalesce(bad, F.lit(False))).select(*rows.columns, "bad")


def reject_sentinels(rows: DataFrame, by: list[str]) -> DataFrame:
    """Null the coordinates of rows whose x or y is a sentinel of its group."""
    return _with_sentinels(rows, by).withColumns({c: F.when(~F.col("bad"), F.col(c)) for c in ("x", "y")}).drop("bad")


def place_metric(v: Column, least: Column, px_per_m: float) -> Column:
    """Pixels of a metric coordinate: 24 px from the least one, to two digits."""
    return round_half_up((v - least) * px_per_m + 24, 2)


def place_fit(v: Column, lo: Column, hi: Column, size: float) -> Column:
    """Pixels of a coordinate, kept within lo and hi, stretched over the plan's pixels with 4 % padding, 12 to
    48 px; the middle if lo and hi are one."""
    pad = min(max(size * 0.04, 12.0), 48.0)
    top = max(pad, size - pad - 1)
    fit = F.lit(pad) + (clamp(v, lo, hi) - lo) / F.nullif(hi - lo, F.lit(0.0)) * (top - pad)
    return round_half_up(F.coalesce(fit, F.lit((pad + top) / 2)), 2)


def prepare(rows: DataFrame, width: float, height: float, px_per_m: float | None, by: list[str]) -> DataFrame:
    """Survey rows (x, y in metres or degrees) on the plan: by its scale from the least coordinate of the
    group, sentinels without a place; or, without a scale, stretched over the plan between the group's 1 %
    and 99 % ranks where those differ, else its ends, with whatever lies beyond, sentinels too, at its edge.

    Ranges are those of rows that are no sentinels, or of all where a group has no other. Where there is a column
    ``coordinate_kind``, only rows of kind 'survey' with both coordinates are placed, and become 'pixel'; a rejected
    sentinel's kind is null; other rows stay as they are and decide nothing."""
    kind = "coordinate_kind" in rows.columns
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("coordinate_kind").eqNullSafe("survey") if kind else F.lit(True))
    flagged = rows.withColumn("_placed", placed)
    rest = flagged.where(~F.col("_placed")).drop("_placed")
    survey = cut(_with_sentinels(flagged.where("_placed").drop("_placed"), by), "survey")
    clean = survey.where("not bad")
    lone = survey.join(small(clean.select(*by).distinct()), by, "left_anti") if by else (survey if clean.limit(1).count() == 0 else survey.where("false"))
    base = clean.unionByName(lone)
    if px_per_m:
        ends = base.groupBy(*by).agg(*(F.min(c).alias(f"{c}_lo") for c in "xy"))
        at = {c: F.when(~F.col("bad"), place_metric(F.col(c), F.col(f"{c}_lo"), px_per_m)) for c in "xy"}
    else:
        ends = None
        for c in "xy":
            q = nearest_rank(base, c, {f"{c}_q0": 0.01, f"{c}_q1": 0.99, f"{c}_min": 0.0, f"{c}_max": 1.0}, by).drop("n")
            good = F.col(f"{c}_q1") > F.col(f"{c}_q0")
            q = q.select(*by, F.when(good, F.col(f"{c}_q0")).otherwise(F.col(f"{c}_min")).alias(f"{c}_lo"), F.when(good, F.col(f"{c}_q1")).otherwise(F.col(f"{c}_max")).alias(f"{c}_hi"))
            ends = q if ends is None else ends.join(q, by) if by else ends.crossJoin(q)  # one row without groups
        at = {c: place_fit(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), size) for c, size in (("x", width), ("y", height))}
    if kind:
        at["coordinate_kind"] = F.when(F.col("bad") & F.lit(bool(px_per_m)), F.lit(None).cast("string")).otherwise("pixel")
    joined = survey.join(small(ends), by, "left") if by else survey.crossJoin(F.broadcast(ends))
    return joined.withColumns(at).select(rows.columns).unionByName(rest.select(rows.columns))


BANDS = ("24ghz", "5ghz", "6ghz")


def fit_survey(rows: DataFrame, width: float, height: float, px_per_m: float | None, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Survey rows (row_idx, point_id, x, y, coordinate_kind, a signal of each band, distance_m, timestamp) fitted to
    the plan, and what is to be said about them.

    Rows are placed as by ``prepare`` and merged in cells of the plan: mean place, first known distance and time,
    strongest signals, ids P1, P2 in order of a cell's first row. Rows without a place follow unchanged. A group
    without survey rows stays as it is. The second table has rows (by, severity, code, pct): 'csv_survey_uncalibrated'
    without a scale; else 'csv_survey_out_of_bounds' if more than a tenth of the merged points lie outside the plan,
    whose right and lower edges are outside."""
    surveyed = F.col("coordinate_kind").eqNullSafe("survey") & F.col("x").isNotNull() & F.col("y").isNotNull()
    groups = cut(rows.where(surveyed).select(*by).distinct(), "surveyed")
    known = cut(prepare(rows.join(small(groups), by, "left_semi"), width, height, px_per_m, by), "placed")
    cell = float(bin_size(width, height, CONSOLIDATE_BINS))
    on = F.col("x").isNotNull() & F.col("y").isNotNull()
    at = lambda c: F.floor(F.col(c) / cell + 0.5).cast("long").alias(f"_{c}")
    first = lambda c, ok: F.min_by(c, F.when(ok, F.col("row_idx"))).alias(c)
    merged = known.where(on).groupBy(*by, at("x"), at("y")).agg(
        F.min("row_idx").alias("row_idx"), round_half_up(exact_mean(F.col("x")), 2).alias("x"), round_half_up(exact_mean(F.col("y")), 2).alias("y"), F.lit("pixel").alias("coordinate_kind"),
        *(F.max(f"rssi_{b}").alias(f"rssi_{b}") for b in BANDS), first("distance_m", F.col("distance_m").isNotNull()), first("timestamp", F.col("timestamp") != ""),
    )
    number = F.row_number().over(Window.partitionBy(*by).orderBy("row_idx"))  # at most one row for each cell of the plan
    merged = cut(merged.withColumn("point_id", F.concat(F.lit("P"), number.cast("string"))).select(rows.columns), "merged")
    out = merged.unionByName(known.where(~on)).unionByName(rows.join(small(groups), by, "left_anti"))
    if px_per_m:
        issues = out_of_bounds_pct(merged, width, height, by).where("warn").select(*by, F.lit("warning").alias("severity"), F.lit("csv_survey_out_of_bounds").alias("code"), "pct")
    else:
        issues = groups.select(*by, F.lit("warning").alias("severity"), F.lit("csv_survey_uncalibrated").alias("code"), F.lit(None).cast("long").alias("pct"))
    return out, issues


def bin_size(width: float, height: float, bins: int) -> int:
    return max(8, math.ceil(math.sqrt(width * height / bins)))


def consolidate(points: DataFrame, width: float, height: float, bins: int = CONSOLIDATE_BINS, by: list[str] | None = None, prefix: str = "P") -> DataFrame:
    """One point per occupied bin: mean place, strongest signal, ids in order of first appearance.

    The bins bound the result per group whatever the number of readings, and partial aggregation
    bounds the shuffle. Rows without coordinates don't take part."""
    by, cell = by or [], float(bin_size(width, height, bins))
    at = lambda c: F.floor(F.col(c) / cell + 0.5).cast("long")
    kept = points.where(is_finite(F.col("x")) & is_finite(F.col("y")))
    out = kept.groupBy(*by, at("x").alias("bx"), at("y").alias("by_")).agg(F.min("row_idx").alias("first_idx"), F.count(F.lit(1)).alias("n"), round_half_up(exact_mean(F.col("x")), 2).alias("x"), round_half_up(exact_mean(F.col("y")), 2).alias("y"), F.max("rssi").alias("rssi"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("first_idx"))
    return out.withColumn("point_id", F.concat(F.lit(prefix), rank.cast("string")))


def even_sample(df: DataFrame, order: str, limit: int, by: list[str]) -> DataFrame:
    """Rows at evenly spread places of the order in each group, ends included."""
    ranked = running(df, [order], by).select(*df.columns, (F.col("upto") - 1).alias("i"), F.col("total").alias("n"))
    step = (F.col("n") - 1) / F.lit(float(max(limit - 1, 1)))
    # row i is taken if some k of 0..limit-1 rounds to it
    k = F.ceil((F.col("i") - 0.5) / F.nullif(step, F.lit(0.0)))
    hit = (F.col("n") <= limit) | ((k >= 0) & (k < limit) & (F.floor(k * step + 0.5) == F.col("i")))
    return ranked.where(hit).select(df.columns)


def out_of_bounds_pct(points: DataFrame, width: float, height: float, by: list[str]) -> DataFrame:
    """Share of points outside the plan in whole percent, and whether that deserves a warning. The plan's right and
    lower edges are outside."""
    x, y = F.col("x"), F.col("y")
    outside = ((x < 0) | (x >= width) | (y < 0) | (y >= height)).cast("int")
    return points.groupBy(*by).agg((F.sum(outside) / F.count(F.lit(1))).alias("share")).select(*by, F.floor(F.col("share") * 100 + 0.5).cast("long").alias("pct"), (F.col("share") > 0.1).alias("warn"))
