"""Layer, room and point statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigfield.functions import scores
from sigfield.functions.scalars import ACCENTED, PLAIN, exact_mean, round_half_up
from sigfield.operators.ranks import running

CLASSES = ("excellent", "good", "fair", "weak", "dead")


def _pct(condition: Column) -> Column:
    return F.count_if(condition) * F.lit(100.0) / F.count(F.lit(1))


def layer_stats(cells: DataFrame, by: list[str], coverage: float = -67, dead: float = -85) -> DataFrame:
    """Least, greatest and mean signal, covered and dead share of each layer."""
    v = F.col("rssi")
    return cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.min(v), 1).alias("min_rssi"), F.round(F.max(v), 1).alias("max_rssi"), F.round(exact_mean(v), 1).alias("avg_rssi"), F.round(_pct(v >= coverage), 1).alias("coverage_pct"), F.round(_pct(v <= dead), 1).alias("dead_pct"))


def region_stats(cells: DataFrame, by: list[str], cell_px: float, px_per_m: float, coverage: float = -67, weak: float = -75, dead: float = -85) -> DataFrame:
    """Extent, signal, class shares and scores of each region's cells (x, y, rssi)."""
    v, kind = F.col("rssi"), scores.quality_class(F.col("rssi"), coverage, weak, dead)
    out = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), exact_mean(v).alias("mean"), round_half_up(exact_mean(F.col("x")), 1).alias("cx"), round_half_up(exact_mean(F.col("y")), 1).alias("cy"),
        *(round_half_up(_pct(c), 1).alias(n) for n, c in (("cov", v >= coverage), ("wk", v < weak), ("dd", v <= dead))), *(round_half_up(_pct(kind == c), 1).alias(f"{c}_pct") for c in CLASSES),
    )
    avg = round_half_up(F.col("mean"), 1)
    channel = scores.channel_quality(avg, F.col("cov"), F.col("dd"))
    return out.select(
        *by, "n", round_half_up(F.col("n") * (cell_px / px_per_m) ** 2, 2).alias("area_m2"), round_half_up(F.col("lo"), 1).alias("min_rssi"), round_half_up(F.col("hi"), 1).alias("max_rssi"), avg.alias("avg_rssi"), "cx", "cy",
        F.col("cov").alias("coverage_pct"), F.col("dd").alias("dead_pct"), *(f"{c}_pct" for c in CLASSES), scores.throughput_mbps(avg).alias("throughput_mbps"),
        scores.latency_ms(avg, F.col("wk"), F.col("dd")).alias("latency_ms"), channel.alias("channel_quality"), scores.roaming_score(F.col("cov"), channel).alias("roaming"),
    )


def point_table(points: DataFrame, keys: list[str], coverage: float = -67, weak: float = -75, dead: float = -85) -> DataFrame:
    """Class and scores of each point's own signal."""
    v = F.col("rssi")
    covered, deadly = (F.when(c, 100.0).otherwise(0.0) for c in (v >= coverage, v <= dead))
    channel = scores.channel_quality(v, covered, deadly)
    return points.select(*keys, v.alias("rssi"), scores.quality_class(v, coverage, weak, dead).alias("class"), scores.throughput_mbps(v).alias("throughput_mbps"), scores.latency_ms(v, F.when(v < weak, 100.0).otherwise(0.0), deadly).alias("latency_ms"), channel.alias("channel_quality"), scores.roaming_score(covered, channel).alias("roaming"))


def best_and_worst(points: DataFrame, by: list[str], key: str = "row_idx") -> DataFrame:
    """Strongest and weakest reading of each group, the first of equal ones, and the mean."""
    v = F.col("rssi")
    return points.groupBy(*by).agg(F.max_by(key, F.struct(v, -F.col(key))).alias("best_idx"), F.max(v).alias("best_rssi"), F.min_by(key, F.struct(v, F.col(key))).alias("worst_idx"), F.min(v).alias("worst_rssi"), F.round(exact_mean(v), 4).alias("avg_rssi"))


def auto_rooms(labelled: DataFrame, by: str, least: int | None = None, cells: int = 0, most: int = 18) -> DataFrame:
    """Names of the largest components of each layer's passable cells: those of at least ``least`` cells, or
    18 and 0.15 % of the grid's; a single one is the whole floor."""
    least = least if least is not None else max(18, int(cells * 0.0015 + 0.5))
    sizes = labelled.groupBy(by, "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "label"))
    ranked = sizes.withColumn("place", place).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy(by))).where(F.col("place") <= most)
    return ranked.select(by, "label", "n", F.when(F.col("of") == 1, "Floor Area").otherwise(F.concat(F.lit("Room "), F.col("place").cast("string"))).alias("name"))


def largest(stats: DataFrame, by: list[str]) -> DataFrame:
    """The component with the largest area of each layer, the first of equal ones."""
    return stats.groupBy(*by).agg(F.max_by("label", F.struct("area", -F.col("label"))).alias("label"), F.max("area").alias("area"))


def natural_key(name: Column) -> Column:
    """A text that sorts as people expect: letters by their base form, each number in it by its value."""
    parts = F.regexp_extract_all(F.translate(name, ACCENTED, PLAIN), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    # a number is preceded by its number of digits, so that longer ones come later
    shown = lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 6, "0"), digits(p))).otherwise(F.lower(p))
    return F.array_join(F.transform(parts, shown), "")


def natural_order(rooms: DataFrame, name: str, key: str) -> DataFrame:
    """Places of rooms by name in natural order, then by key. Null names come first."""
    known = rooms.withColumn("_natural", natural_key(F.col(name)))
    return running(known, ["_natural", key]).withColumn("place", F.col("upto").cast("int")).drop("_natural", "upto", "total")
