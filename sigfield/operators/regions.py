"""Regions of plan images: masks of houses, obstacles and dividers, rooms by colour, and red markers.

Masks are kept as runs: rows (plan, gy, x0, x1), ends inclusive, at most one run touching another in a line. A
line's runs are few however wide the image is, so dilation, complements, intersections and connected components work
on runs and only ``cells`` makes pixels of them. Everything is keyed by plan and line; one plan's lines are dealt
singly. ``pixels`` are rows (plan, gx, gy, r, g, b, a), or runs (plan, gy, x0, x1, r, g, b, a) of equal pixels that do not
overlap; a pixel without a row is transparent black. ``plans`` are rows (plan, width, height).

A plan without a mask has no rows. Empty images give none; null colours and an alpha of 24 or less count as
transparent; a repeated pixel counts once in masks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigfield.functions.scalars import clamp, round_half_up
from sigfield.functions.scores import luminance, saturation
from sigfield.operators.graph import by_groups, components, greedy, least_linked
from sigfield.operators.raster import BLOCK, bits_of, words
from sigfield.operators.walls import OPAQUE, backgrounds, of_plans
from sigfield.runtime import cut, ship, spread

TILE, WIDE = 64, 256  # lines and columns of a tile, whose medians one task takes
TILES = 32  # tiles that are made pixels at once
STRIP = 128  # lines of an image that one task labels at once


def _nearest(v: Column) -> Column:
    return F.floor(v + 0.5).cast("int")


def _side() -> Column:
    return F.greatest("width", "height")


def _area() -> Column:
    return F.col("width") * F.col("height")


# --- runs


def joined(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of intervals (keys, gy, x0, x1) that may overlap or touch."""
    w = Window.partitionBy(*keys, "gy").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("x0") > reach + 1).cast("int"), F.lit(1))
    numbered = spread(intervals, *keys, "gy").withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w))
    return numbered.groupBy(*keys, "gy", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def runs_of(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of cells, which may repeat, or of runs, which may overlap."""
    if "x0" in cells.columns:
        return joined(cells.select(*keys, "gy", "x0", "x1"), keys)
    w = F.col("bits")
    starts, ends = w.bitwiseAND(F.bitwise_not(F.shiftleft(w, 1))), w.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(w, 1)))
    pieces = words(cells, keys).select(*keys, "gy", "bx", F.explode(F.arrays_zip(bits_of(starts).alias("x0"), bits_of(ends).alias("x1"))).alias("p"))
    return joined(pieces.select(*keys, "gy", (F.col("bx") * BLOCK + F.col("p.x0")).alias("x0"), (F.col("bx") * BLOCK + F.col("p.x1")).alias("x1")), keys)


def cells(runs: DataFrame) -> DataFrame:
    """The pixels (gx, gy) of runs."""
    return runs.withColumn("gx", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def dilated(runs: DataFrame, plans: DataFrame, radius: Column) -> DataFrame:
    """Runs of all pixels within a disk around a run's; ``radius`` is a column over plans."""
    known = plans.select("plan", "width", "height", radius.cast("int").alias("_r"))
    t = runs.join(known, "plan").withColumn("_dy", F.explode(F.sequence(-F.col("_r"), F.col("_r"))))
    half = F.floor(F.sqrt((F.col("_r") * F.col("_r") - F.col("_dy") * F.col("_dy")).cast("double"))).cast("int")
    moved = t.select("plan", (F.col("gy") + F.col("_dy")).alias("gy"), F.greatest(F.lit(0), F.col("x0") - half).alias("x0"), F.least(F.col("width") - 1, F.col("x1") + half).alias("x1"), "height")
    return joined(moved.where("gy between 0 and height - 1").drop("height"), ["plan"])


def complement(runs: DataFrame, plans: DataFrame) -> DataFrame:
    """Runs of the pixels of each plan that are in none of its runs."""
    ends = plans.select("plan", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("gy"), F.array(F.struct(F.lit(-1).alias("x0"), F.lit(-1).alias("x1")), F.struct(F.col("width").alias("x0"), F.col("width").alias("x1"))).alias("e"))
    edged = runs.select("plan", "gy", "x0", "x1").unionByName(ends.select("plan", "gy", F.explode("e").alias("e")).select("plan", "gy", "e.*"))
    after = F.lead("x0").over(Window.partitionBy("plan", "gy").orderBy("x0"))
    gaps = spread(edged, "plan", "gy").withColumn("_next", after).where("_next > x1 + 1")
    return gaps.select("plan", "gy", (F.col("x1") + 1).alias("x0"), (F.col("_next") - 1).alias("x1"))


def _blocks(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / BLOCK).cast("int"), F.floor(high / BLOCK).cast("int")))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Runs of the pixels that are in runs of both; other columns of ``a`` stay. A pair meets in the block of its
    common pixels' first."""
    right = b.select("plan", "gy", F.col("x0").alias("_x0"), F.col("x1").alias("_x1")).withColumn("_block", _blocks(F.col("_x0"), F.col("_x1")))
    t = a.withColumn("_block", _blocks(F.col("x0"), F.col("x1"))).join(right.hint("merge"), ["plan", "gy", "_block"])
    first = F.greatest("x0", "_x0")
    both = t.where((first <= F.least("x1", "_x1")) & (F.col("_block") == F.floor(first / BLOCK)))
    rest = [c for c in a.columns if c not in ("x0", "x1")]
    return both.select(*rest, first.alias("x0"), F.least("x1", "_x1").alias("x1"))


def _touching(a: DataFrame, b: DataFrame, keys: list[str], lines: tuple[int, ...], slack: int = 0) -> DataFrame:
    """Pairs of ``id`` of runs of a (as ``a``) and b (as ``b``), so many lines on, with a column in common or, with slack, next
    to one; in a run's own line the columns beside it count."""
    t = a.select(*keys, F.col("id").alias("a"), "gy", "x0", "x1", F.explode(F.array(*map(F.lit, lines))).alias("_dy"))
    wide = F.when(F.col("_dy") == 0, 1).otherwise(slack)
    t = t.select(*keys, "a", (F.col("gy") + F.col("_dy")).alias("gy"), (F.col("x0") - wide).alias("lo"), (F.col("x1") + wide).alias("hi")).withColumn("_block", _blocks(F.col("lo"), F.col("hi")))
    u = b.select(*keys, F.col("id").alias("b"), "gy", "x0", "x1").withColumn("_block", _blocks(F.col("x0"), F.col("x1")))
    first = F.greatest("lo", "x0")
    return t.join(u.hint("merge"), [*keys, "gy", "_block"]).where((first <= F.least("hi", "x1")) & (F.col("_block") == F.floor(first / BLOCK))).select(*keys, "a", "b")


def _labelled_strips(batches: Iterator[pd.DataFrame], keys: list[str], slack: int) -> Iterator[pd.DataFrame]:
    """Runs, sorted by keys (the last one is the strip), line and column, with the least ``id`` of those of their strip that they
    are connected with."""
    for t in by_groups(batches, keys):
        group = (t[keys] != t[keys].shift()).any(axis=1).cumsum().to_numpy()
        gy, x0, x1 = (t[c].to_numpy().astype(np.int64) for c in ("gy", "x0", "x1"))
        line = group * (gy.max() - gy.min() + 2) + gy - gy.min()  # next to one another only within a group
        width = x1.max() + 4
        first, last = line * width + x0 + 1, line * width + x1 + 1
        lo, hi = np.searchsorted(last, first + width - slack), np.searchsorted(first, last + width + slack, "right")
        n = np.maximum(hi - lo, 0)
        a = np.repeat(np.arange(len(t)), n)
        b = np.arange(len(a)) + np.repeat(lo - np.cumsum(n) + n, n)
        yield t.assign(label=t["id"].to_numpy()[least_linked(len(t), a, b)]).drop(columns="id")


def labelled(runs: DataFrame, plans: DataFrame, diagonal: bool = False, value: str | None = None) -> DataFrame:
    """Runs with ``label``, the number gy * width + x of their component's first pixel in reading order. With
    ``value``, only runs of an equal value are connected.

    A task labels strips of STRIP lines; then what touches across the strips' borders is joined."""
    ship(runs.sparkSession)
    keys = ["plan", *([value] if value else [])]
    t = runs.join(plans.select("plan", "width"), "plan").select(*keys, F.floor(F.col("gy") / STRIP).cast("int").alias("_strip"), "gy", "x0", "x1", (F.col("gy").cast("long") * F.col("width") + F.col("x0")).alias("id"))
    by = [*keys, "_strip"]
    dealt = spread(t, *by).sortWithinPartitions(*by, "gy", "x0")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema if f.name != "id")
    slack = int(diagonal)
    t = cut(dealt.mapInPandas(lambda batches: _labelled_strips(batches, by, slack), f"{kinds}, label bigint"), "strips")
    if not t.where("_strip > 0").limit(1).count():
        return t.drop("_strip")
    ends = t.select(*keys, "gy", "x0", "x1", F.col("label").alias("id"))
    links = _touching(ends.where(F.col("gy") % STRIP == STRIP - 1), ends.where(F.col("gy") % STRIP == 0), keys, (1,), slack)
    links = cut(links.distinct(), "borders")
    nodes = links.select(*keys, F.explode(F.array("a", "b")).alias("id")).distinct()
    whole = components(nodes, links, keys).select(*keys, F.col("id").alias("label"), F.col("label").alias("_least"))
    return t.join(whole.hint("merge"), [*keys, "label"], "left").withColumn("label", F.coalesce("_least", "label")).drop("_least", "_strip")


def stats(runs: DataFrame) -> DataFrame:
    """Area, bounds and box of each component."""
    s = runs.groupBy("plan", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("gy").alias("top"), F.max("gy").alias("bottom"))
    wide, high = F.col("right") - F.col("left") + 1, F.col("bottom") - F.col("top") + 1
    return s.withColumns({"box_w": wide, "box_h": high, "long": F.greatest(wide, high), "short": F.least(wide, high), "density": F.col("area") / (wide * high)})


# --- masks of houses, obstacles and dividers


def _colored(pixels: DataFrame, plans: DataFrame) -> DataFrame:
    """Opaque pixels, or runs of them, with their squared distance from the background, light and plan size."""
    t = of_plans(pixels.where(F.col("a") > OPAQUE), backgrounds(pixels, plans).join(plans.hint("merge"), "plan"))
    far = sum(((F.col(c) - F.col(f"b{c}")) * (F.col(c) - F.col(f"b{c}")) for c in "rgb"), F.lit(0.0))
    return t.select("plan", *(c for c in ("gx", "x0", "x1") if c in pixels.columns), "gy", far.alias("far"), (luminance(*(F.col(c) for c in "rgb")) / 255).alias("light"))


def _annotation() -> Column:
    """Whether a component looks like text, a dimension line or dust."""
    aspect = F.col("box_w") / F.col("box_h")
    thin = (F.col("long") > _side() * 0.08) & (F.col("short") <= F.greatest(F.lit(10.0), _side() * 0.012))
    stroke = (F.col("area") < F.greatest(F.lit(120.0), _area() * 0.00008)) & (F.col("long") <= _side() * 0.12)
    tiny = F.col("area") < F.greatest(F.lit(36.0), _area() * 0.00004)
    return tiny | stroke | thin | (((aspect > 12) | (aspect < 1 / 12)) & (F.col("density") < 0.72))


def enclosed(barrier: DataFrame, plans: DataFrame) -> DataFrame:
    """Runs of what a barrier shuts off from the plan's border, itself included: pixels that no path of side
    steps around the barrier reaches from the border. Small parts are left out; a plan whose rest is too small or
    nearly everything has none."""
    free = labelled(complement(barrier, plans), plans).join(plans, "plan")
    at_border = (F.col("gy") == 0) | (F.col("gy") == F.col("height") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("width") - 1)
    outside = free.where(at_border).select("plan", "label").distinct()
    inner = labelled(complement(free.join(outside.hint("merge"), ["plan", "label"], "left_semi"), plans), plans)
    least = F.greatest(F.lit(160), _nearest(_area() * 0.0022))
    large = stats(inner).join(plans, "plan").where(F.col("area") >= least)
    share = F.col("kept") / _area()
    right = large.groupBy("plan", "width", "height").agg(F.sum("area").alias("kept")).where(share.between(0.035, 0.86))
    return inner.join(large.join(right.select("plan"), "plan", "left_semi").select("plan", "label").hint("merge"), ["plan", "label"], "left_semi").select("plan", "gy", "x0", "x1")


def _filled(spans: DataFrame, line: str) -> DataFrame:
    """Spans (plan, line, lo, hi) with lines missing between two that are near filled in evenly."""
    w = Window.partitionBy("plan").orderBy(line)  # one row for each line of an image
    after = spans.withColumns({"next": F.lead(line).over(w), "lo2": F.lead("lo").over(w), "hi2": F.lead("hi").over(w)})
    gap = F.col("next") - F.col(line)
    fill = F.sequence(F.lit(0), F.when((gap > 1) & (gap <= F.greatest(F.lit(6), _nearest(_side() * 0.012))), gap - 1).otherwise(F.lit(0)))
    mixed = lambda a, b: F.when(F.col("k") == 0, F.col(a)).otherwise(_nearest(F.col(a) + (F.col(b) - F.col(a)) * (F.col("k") / gap)))
    return after.withColumn("k", F.explode(fill)).select("plan", "width", "height", (F.col(line) + F.col("k")).alias(line), mixed("lo", "lo2").alias("lo"), mixed("hi", "hi2").alias("hi"))


def footprints(runs: DataFrame, plans: DataFrame) -> DataFrame:
    """Runs of the pixels that lie within the padded spans of both their line and their column."""
    t = runs.join(plans, "plan")
    rows = _filled(t.groupBy("plan", "width", "height", "gy").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi")), "gy")
    columns = _filled(cells(t).groupBy("plan", "width", "height", "gx").agg(F.min("gy").alias("lo"), F.max("gy").alias("hi")), "gx")
    pad = F.greatest(F.lit(1), _nearest(_side() / 900))
    across = rows.select("plan", "gy", F.greatest(F.lit(0), F.col("lo") - pad).alias("x0"), F.least(F.col("width") - 1, F.col("hi") + pad).alias("x1"))
    down = columns.select("plan", "gx", F.greatest(F.lit(0), F.col("lo") - pad).alias("lo"), F.least(F.col("height") - 1, F.col("hi") + pad).alias("hi"))
    return common(across, _across(down))


def _across(columns: DataFrame) -> DataFrame:
    """Runs of the pixels of columns (plan, gx, lo, hi; ends inclusive, one row for each gx). A run begins where a column holds a line
    that the one before it does not, and ends likewise, so that only these places are made."""
    w = Window.partitionBy("plan").orderBy("gx")  # one row for each column of an image

    def lines(f: Callable, step: int) -> Column:
        beside = f("gx").over(w) == F.col("gx") + step
        lo, hi = (F.when(beside, f(c).over(w)).otherwise(F.col("hi") + 1) for c in ("lo", "hi"))
        span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.expr("array()"))
        return F.concat(span(F.col("lo"), F.least(F.col("hi"), F.coalesce(lo, F.col("hi") + 1) - 1)), span(F.greatest(F.col("lo"), F.coalesce(hi, F.col("hi") + 1) + 1), F.col("hi")))

    edges = columns.withColumns({"_begins": lines(F.lag, -1), "_ends": lines(F.lead, 1)})
    side = lambda c, k: edges.select("plan", "gx", F.lit(k).alias("_k"), F.explode(c).alias("gy"))
    events = spread(side("_begins", 0).unionByName(side("_ends", 1)), "plan", "gy")
    end = F.lead("gx").over(Window.partitionBy("plan", "gy").orderBy("gx", "_k"))
    return events.withColumn("x1", end).where("_k = 0").select("plan", "gy", F.col("gx").alias("x0"), "x1")


def house_masks(pixels: DataFrame, plans: DataFrame) -> DataFrame:
    """Runs of each plan's house: the area that its thickened drawing encloses, or else the footprint of the main
    component and of the larger ones around its box. Which of the two is decided for each plan by a join."""
    drawn = runs_of(_colored(pixels, plans).where("far > 42 * 42"), ["plan"])
    barrier = cut(dilated(drawn, plans, F.greatest(F.lit(2), _nearest(_side() / 450))), "barrier")
    inside = cut(enclosed(barrier, plans), "enclosed")
    open_ = plans.join(inside.select("plan").distinct(), "plan", "left_anti")
    parts = cut(labelled(barrier.join(open_.select("plan"), "plan", "left_semi"), plans), "parts")
    judged = stats(parts).join(plans, "plan").withColumn("note", _annotation())
    pad = _nearest(_side() * 0.01)
    main = judged.groupBy("plan").agg(F.min(F.struct("note", (-F.col("area")).alias("size"), "label", "left", "right", "top", "bottom")).alias("m"))
    t = judged.join(main.hint("merge"), "plan")
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    within = middle("left", "right").between(F.greatest(F.lit(0), F.col("m.left") - pad), F.least(F.col("width") - 1, F.col("m.right") + pad)) & middle("top", "bottom").between(F.greatest(F.lit(0), F.col("m.top") - pad), F.least(F.col("height") - 1, F.col("m.bottom") + pad))
    chosen = t.where((F.col("label") == F.col("m.label")) | (~F.col("note") & (F.col("area") >= -F.col("m.size") * 0.018) & within)).select("plan", "label")
    built = footprints(parts.join(chosen.hint("merge"), ["plan", "label"], "left_semi").select("plan", "gy", "x0", "x1"), plans)
    return inside.unionByName(built)


def _in_house(runs: DataFrame, house: DataFrame) -> DataFrame:
    """Runs cut to the house, where the plan has one."""
    known = house.select("plan").distinct()
    return common(runs.join(known, "plan", "left_semi"), house).unionByName(runs.join(known, "plan", "left_anti"))


def _line_mask(pixels: DataFrame, plans: DataFrame, house: DataFrame, contrast: float, dark: float, keep: Column, grow: int, least: Column, most: float) -> DataFrame:
    raw = _colored(pixels, plans).where((F.col("far") > contrast * contrast) | (F.col("light") < dark))
    parts = cut(labelled(_in_house(runs_of(raw, ["plan"]), house), plans, diagonal=True), "lines")
    kept = stats(parts).join(plans, "plan").where(keep).select("plan", "label")
    wide = dilated(parts.join(kept.hint("merge"), ["plan", "label"], "left_semi").select("plan", "gy", "x0", "x1"), plans, F.greatest(F.lit(1), _nearest(_side() / grow)))
    mask = cut(_in_house(wide, house), "line-mask")
    n = mask.groupBy("plan").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).join(plans, "plan")
    return mask.join(n.where((F.col("n") >= least) & (F.col("n") / _area() <= most)).select("plan"), "plan", "left_semi")


def obstacle_masks(pixels: DataFrame, plans: DataFrame, house: DataFrame) -> DataFrame:
    """Runs of drawn lines and blocks that stand in the way of signals. A plan with too few or too many has none."""
    marker = (F.col("long") < F.greatest(F.lit(38.0), _side() * 0.026)) & (F.col("density") > 0.28)
    text = (F.col("area") < F.greatest(F.lit(90.0), _area() * 0.000018)) & (F.col("short") < 12)
    dimension = (F.col("long") > _side() * 0.08) & (F.col("short") <= F.greatest(F.lit(10.0), _side() * 0.012))
    line = (F.col("long") >= F.greatest(F.lit(34), _nearest(_side() * 0.028))) & (F.col("area") >= F.greatest(F.lit(28), _nearest(_area() * 0.000006))) & ~dimension
    block = (F.col("area") >= F.greatest(F.lit(220.0), _area() * 0.00008)) & (F.col("density") > 0.04)
    return _line_mask(pixels, plans, house, 46, 0.76, (line | block) & ~marker & ~text, 1100, F.greatest(F.lit(48.0), _area() * 0.00003), 0.42)


def divider_masks(pixels: DataFrame, plans: DataFrame, house: DataFrame) -> DataFrame:
    """Runs of lines and networks of lines that part compartments. A plan with too few or too many has none."""
    aspect = F.col("long") / F.greatest(F.col("short"), F.lit(1))
    furniture = (F.col("long") < F.greatest(F.lit(110.0), _side() * 0.13)) & (F.col("short") > F.greatest(F.lit(14.0), _side() * 0.018))
    symbol = (F.col("density") > 0.32) & (F.col("long") < F.greatest(F.lit(140.0), _side() * 0.16))
    dimension = (F.col("long") > _side() * 0.08) & (F.col("short") <= F.greatest(F.lit(8.0), _side() * 0.01)) & (F.col("density") < 0.2)
    least = F.greatest(F.lit(42), _nearest(_area() * 0.00001))
    line = (F.col("long") >= F.greatest(F.lit(72), _nearest(_side() * 0.075))) & (F.col("area") >= least) & (aspect >= 3.2) & (F.col("short") <= F.greatest(F.lit(36.0), _side() * 0.036))
    network = (F.col("long") >= F.greatest(F.lit(120.0), _side() * 0.12)) & (F.col("area") >= least * 2) & F.col("density").between(0.015, 0.28) & ~furniture
    return _line_mask(pixels, plans, house, 54, 0.72, (line | network) & ~symbol & ~dimension, 950, F.greatest(F.lit(80.0), _area() * 0.00004), 0.24)


def covered_share(mask: DataFrame, plans: DataFrame) -> DataFrame:
    """Each plan's share of pixels in the mask in per cent, two digits; 0 without a mask."""
    n = mask.groupBy("plan").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    return plans.join(n, "plan", "left").na.fill(0, ["n"]).select("plan", round_half_up(F.col("n") / F.greatest(_area(), F.lit(1)) * 100, 2).alias("covered"))


# --- rooms by colour


def _median_runs(batches: Iterator[pd.DataFrame], radius: int, tile: tuple[int, int]) -> Iterator[pd.DataFrame]:
    """Runs of equal medians of the opaque pixels of tiles, from the runs of each tile and around it."""
    side, (tall, across) = 2 * radius + 1, tile
    high = tall + 2 * radius
    for t in by_groups(batches, ["plan", "tx", "ty"]):
        starts = np.append(np.flatnonzero((t[["plan", "tx", "ty"]] != t[["plan", "tx", "ty"]].shift()).any(axis=1).to_numpy()), len(t))
        for k in range(0, len(starts) - 1, TILES):
            ends = starts[k : k + TILES + 1]
            rows = t.iloc[ends[0] : ends[-1]]
            of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            tx, ty, width, height = (t[c].to_numpy()[ends[:-1]].astype(np.int64) for c in ("tx", "ty", "width", "height"))
            left, top = tx * across - radius, ty * tall - radius
            wide = min(across, int((width - tx * across).max())) + 2 * radius
            gy, x0, x1 = (rows[c].to_numpy().astype(np.int64) for c in ("gy", "x0", "x1"))
            line = gy - top[of]
            first = np.maximum(np.maximum(x0, 0) - left[of], 0)
            last = np.minimum(np.minimum(x1, width[of] - 1) - left[of], wide - 1)
            n = np.where((line >= 0) & (line < high) & (gy >= 0) & (gy < height[of]), np.maximum(last - first + 1, 0), 0)
            at = np.repeat((of * high + line) * wide + first - np.cumsum(n) + n, n) + np.arange(n.sum())
            image = np.zeros((len(tx) * high * wide, 4), np.uint8)
            image[at] = np.repeat(rows[["r", "g", "b", "a"]].fillna(0).to_numpy().astype(np.uint8), n, axis=0)
            image = image.reshape(len(tx), high, wide, 4)
            # beyond a border its pixels repeat
            x = np.clip(left[:, None] + np.arange(wide), 0, width[:, None] - 1) - left[:, None]
            y = np.clip(top[:, None] + np.arange(high), 0, height[:, None] - 1) - top[:, None]
            image = image[np.arange(len(tx))[:, None, None], np.clip(y, 0, high - 1)[:, :, None], np.clip(x, 0, wide - 1)[:, None, :]]
            middle = image[:, radius:-radius, radius:-radius, :3].copy()
            inside = (np.arange(tall) + ty[:, None] * tall < height[:, None])[:, :, None] & (np.arange(wide - 2 * radius) + tx[:, None] * across < width[:, None])[:, None, :]
            seen = inside & (image[:, radius:-radius, radius:-radius, 3] > OPAQUE)
            windows = np.lib.stride_tricks.sliding_window_view(image[..., :3], (side, side), (1, 2))
            flat = (image[:, 1:, :, :3] == image[:, :-1, :, :3]).all(axis=-1), (image[:, :, 1:, :3] == image[:, :, :-1, :3]).all(axis=-1)
            plain = np.lib.stride_tricks.sliding_window_view(flat[0], (side - 1, side), (1, 2)).all(axis=(-2, -1)) & np.lib.stride_tricks.sliding_window_view(flat[1], (side, side - 1), (1, 2)).all(axis=(-2, -1))
            mixed = np.nonzero(seen & ~plain)  # where all is equal the pixel is its own median
            found = windows[mixed].reshape(len(mixed[0]), 3, side * side)
            middle[mixed] = np.partition(found, side * side // 2, axis=-1)[..., side * side // 2]
            colour = np.where(seen, middle.astype(np.int32) @ np.array([65536, 256, 1], np.int32), -1)
            begins = np.ones(colour.shape, bool)
            begins[:, :, 1:] = colour[:, :, 1:] != colour[:, :, :-1]
            start = np.flatnonzero(begins)
            n, c = np.diff(start, append=colour.size), colour.ravel()[start]
            start, n, c = start[c >= 0], n[c >= 0], c[c >= 0]
            of, y, x = np.unravel_index(start, colour.shape)
            x = x + tx[of] * across
            out = {"gy": y + ty[of] * tall, "x0": x, "x1": x + n - 1, "r": c >> 16, "g": c >> 8 & 255, "b": c & 255}
            yield pd.DataFrame({"plan": t["plan"].to_numpy()[ends[:-1]][of], **{k: v.astype(np.int32) for k, v in out.items()}})


def median_runs(pixels: DataFrame, plans: DataFrame, radius: int = 2) -> DataFrame:
    """Runs (plan, gy, x0, x1, r, g, b) of opaque pixels with the upper median of each channel over the square around them; beyond a
    border its pixels repeat. A run may go on in the next tile. Each tile of an image comes to one task with the runs in and just
    around it; only TILES of them are pixels at once."""
    ship(pixels.sparkSession)
    ends = ["x0", "x1"] if "x0" in pixels.columns else [F.col("gx").alias("x0"), F.col("gx").alias("x1")]
    tile = lambda lo, hi, n, size: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(lo) - radius) / n)).cast("int"), F.least(F.floor((F.col(size) - 1) / n), F.floor((F.col(hi) + radius) / n)).cast("int")))
    t = of_plans(pixels.select("plan", "gy", *ends, "r", "g", "b", "a"), plans.select("plan", "width", "height")).where("x1 >= 0 and x0 < width and gy >= 0 and gy < height")
    t = t.withColumn("tx", tile("x0", "x1", WIDE, "width")).withColumn("ty", tile("gy", "gy", TILE, "height"))
    keys = ["plan", "tx", "ty"]
    dealt = spread(t, *keys).sortWithinPartitions(*keys)
    kind, size = pixels.schema["plan"].dataType.simpleString(), (TILE, WIDE)
    return dealt.mapInPandas(lambda batches: _median_runs(batches, radius, size), f"plan {kind}, gy int, x0 int, x1 int, r int, g int, b int")


def median_colors(pixels: DataFrame, plans: DataFrame, radius: int = 2) -> DataFrame:
    """The pixels (plan, gx, gy, r, g, b) of ``median_runs``."""
    return cells(median_runs(pixels, plans, radius)).select("plan", "gx", "gy", "r", "g", "b")


def color_regions(pixels: DataFrame, plans: DataFrame, house: DataFrame) -> DataFrame:
    """Runs (plan, gy, x0, x1, region) of rooms: connected pixels of the house whose median colour falls into one
    bucket of 20 steps a channel, neither near white, near black nor grey, of enough pixels. Regions are numbered from
    1 in reading order. Then each pocket of other pixels that touches one region alone, and neither the border nor
    the outside of the house, goes to that region if it is small enough."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    filled = median_runs(pixels, plans).where(~((F.col("r") >= 232) & (F.col("g") >= 232) & (F.col("b") >= 232)) & (top > 70) & (top - low >= 10))
    step = lambda c: _nearest(F.col(c) / 20)
    bucket = (step("r") * 65536 + step("g") * 256 + step("b")).alias("bucket")
    raw = cut(runs_of(filled.select("plan", "gy", "x0", "x1", bucket), ["plan", "bucket"]), "buckets")  # read twice
    parts = cut(labelled(_in_house(raw, house), plans, value="bucket"), "colours")
    size = parts.groupBy("plan", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area")).join(plans, "plan")
    large = size.where(F.col("area") >= F.greatest(F.lit(120), _nearest(_area() * 0.0012)))
    numbered = large.withColumn("region", F.row_number().over(Window.partitionBy("plan").orderBy("label"))).select("plan", "label", "region")
    rooms = cut(parts.join(numbered.hint("merge"), ["plan", "label"]).select("plan", "gy", "x0", "x1", "region"), "rooms")

    with_rooms = plans.join(rooms.select("plan").distinct(), "plan", "left_semi")
    free = _in_house(complement(rooms, with_rooms), house)
    holes = cut(labelled(free, with_rooms).withColumn("id", F.col("label")), "holes")
    outside = complement(house.join(with_rooms, "plan", "left_semi"), with_rooms.join(house.select("plan").distinct(), "plan", "left_semi"))
    around = rooms.withColumnRenamed("region", "id").unionByName(outside.withColumn("id", F.lit(0)))
    beside = _touching(holes, around, ["plan"], (-1, 0, 1)).groupBy("plan", F.col("a").alias("label")).agg(F.min("b").alias("least"), F.max("b").alias("most"))
    t = stats(holes).join(plans, "plan").join(beside.hint("merge"), ["plan", "label"])
    inner = (F.col("left") > 0) & (F.col("right") < F.col("width") - 1) & (F.col("top") > 0) & (F.col("bottom") < F.col("height") - 1)
    small = F.col("area") <= F.greatest(F.lit(2000), _nearest(_area() * 0.004))
    pockets = t.where(inner & small & (F.col("least") > 0) & (F.col("least") == F.col("most"))).select("plan", "label", F.col("least").alias("region"))
    return joined(rooms.unionByName(holes.join(pockets.hint("merge"), ["plan", "label"]).select("plan", "gy", "x0", "x1", "region")), ["plan", "region"])


# --- markers


def red_markers(pixels: DataFrame, plans: DataFrame) -> DataFrame:
    """Points (plan, point_id, x, y, score) of round red marks: connected red pixels, thickened, of marker size and
    shape, best score first, none too near to a better one; numbered by y, then x."""
    whole = lambda v, lo, hi: clamp(v.cast("double"), lo, hi)
    red = (F.col("a") > 80) & (F.col("r") > 155) & (F.col("g") < 150) & (F.col("b") < 140) & (F.col("r") - F.col("g") > 44) & (F.col("r") - F.col("b") > 58) & (saturation(F.col("r"), F.col("g"), F.col("b")) > 0.32)
    marks = cut(runs_of(pixels.where(red), ["plan"]), "red")
    parts = cut(labelled(dilated(marks, plans, whole(_nearest(_side() / 900), 1, 4)), plans, diagonal=True), "marks")
    n = F.col("x1") - F.col("x0") + 1
    own = common(parts, marks).groupBy("plan", "label").agg(F.sum(n).alias("red"), F.sum(n * (F.col("x0") + F.col("x1")) / 2).alias("sx"), F.sum(n * F.col("gy")).alias("sy"))
    t = stats(parts).join(own, ["plan", "label"]).join(plans, "plan")
    aspect, share = F.col("box_w") / F.col("box_h"), F.col("red") / (F.col("box_w") * F.col("box_h"))
    area, side = F.col("red"), lambda f, lo, hi: whole(_nearest(_side() * f), lo, hi)
    fits = (area >= F.greatest(F.lit(18), _nearest(_area() * 0.000006))) & (area <= F.greatest(F.lit(700), F.least(F.lit(6500), _nearest(_area() * 0.0022))))
    fits = fits & (F.col("short") >= side(0.004, 6, 18)) & (F.col("long") <= side(0.055, 38, 118)) & aspect.between(0.5, 2) & (share >= 0.045) & (F.col("density") <= 0.96)
    fits = fits & ~((F.col("long") > _side() * 0.08) & (F.col("short") <= F.greatest(F.lit(8.0), _side() * 0.01)))
    score = area * F.least(aspect, F.lit(1.0) / aspect) * clamp(share * 4.2, 0.2, 1.4)
    far = side(0.018, 18, 62)
    c = t.where(fits).select("plan", "label", (F.col("sx") / area).alias("x"), (F.col("sy") / area).alias("y"), score.alias("score"), far.alias("far"), whole(_nearest(F.sqrt(_area().cast("double")) / 18), 8, 80).alias("most"))
    c = c.withColumns({"_u": F.col("x") / F.col("far"), "_v": F.col("y") / F.col("far")})
    near = lambda a, b: F.hypot(a("x") - b("x"), a("y") - b("y")) < a("far")
    kept = greedy(c, ["plan"], {"_u": 1.0, "_v": 1.0}, [-F.col("score"), F.col("label")], near)
    best = kept.withColumn("_k", F.row_number().over(Window.partitionBy("plan").orderBy(F.desc("score"), "label"))).where(F.col("_k") <= F.col("most"))
    place = F.row_number().over(Window.partitionBy("plan").orderBy("y", "x"))
    return best.select("plan", F.concat(F.lit("P"), place).alias("point_id"), "x", "y", "score")
