"""Cropping plan pages to their drawing, and padding them to a known aspect, for many plans in one job.

``pixels`` are rows (plan, gx, gy, r, g, b), or runs (plan, gy, x0, x1, r, g, b) of equal pixels; a pixel without a row is
white. Dark pixels are kept as runs: a run's pixels in a line, and in a row of cells, are counted by its ends, and columns change
only where a run begins or ends, so no step makes pixels. Each step moves every plan's box by a join with one row for each
plan. A page without dark pixels, or whose drawing is too small or nearly the whole page, stays whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigfield.operators.regions import labelled, runs_of
from sigfield.runtime import cut

# fixed values: lightness of the page, and the densities and shares of the steps
LIGHT, EDGE, DENSE_CELL, DENSE, MOST_STRIP, MOST_CLUSTER, TOLERANCE = 246, 0.003, 0.035, 0.05, 0.25, 0.92, 0.02


def _nearest(v: Column) -> Column:
    return F.floor(v + 0.5).cast("int")


def _multiples(first: Column, last: Column, step: Column) -> Column:
    """How many multiples of step are from first, 0 or more, up to last."""
    return F.floor(last / step) - F.ceil(first / step) + 1


def _known(boxes: DataFrame, lo: Column, hi: Column, parts: int) -> DataFrame:
    known = boxes.select("plan", lo.alias("_lo"), hi.alias("_hi"))
    return known.withColumn("_step", F.greatest(F.lit(1), _nearest((F.col("_hi") - F.col("_lo")) / parts)))


def _dense(n: str, least: float) -> Column:
    return (F.col(n) > 0) & (F.col(n) / F.ceil((F.col("_hi") - F.col("_lo")) / F.col("_step")) >= least)


def _dense_rows(dark: DataFrame, boxes: DataFrame, lo: Column, hi: Column, least: float, parts: int = 600) -> DataFrame:
    """Rows of pixels (plan, from, to, equal here) of each box whose share of dark pixels, of those looked at from lo up to before
    hi, is ``least`` or more; with 0, those with any."""
    known = _known(boxes, lo, hi, parts)
    first, last = F.greatest("x0", "_lo") - F.col("_lo"), F.least(F.col("x1"), F.col("_hi") - 1) - F.col("_lo")
    looked = dark.join(known, "plan").where(first <= last)
    n = looked.groupBy("plan", "gy", "_lo", "_hi", "_step").agg(F.sum(_multiples(first, last, F.col("_step"))).alias("n"))
    return n.where(_dense("n", least)).select("plan", F.col("gy").alias("from"), F.col("gy").alias("to"))


def _dense_columns(dark: DataFrame, boxes: DataFrame, lo: Column, hi: Column, least: float, parts: int = 600) -> DataFrame:
    """The like for columns of pixels, as spans (plan, from, to) of columns next to one another that are equally dark. A window
    orders where the runs of a plan begin and end, at most as many places as it has columns."""
    known = _known(boxes, lo, hi, parts)
    looked = dark.join(known, "plan").where((F.col("gy") >= F.col("_lo")) & (F.col("gy") < F.col("_hi")) & ((F.col("gy") - F.col("_lo")) % F.col("_step") == 0))
    ends = F.explode(F.array(F.struct(F.col("x0").alias("from"), F.lit(1).alias("d")), F.struct((F.col("x1") + 1).alias("from"), F.lit(-1).alias("d")))).alias("e")
    changes = looked.select("plan", "_lo", "_hi", "_step", ends).groupBy("plan", "_lo", "_hi", "_step", "e.from").agg(F.sum("e.d").alias("d")).where("d <> 0")
    w = Window.partitionBy("plan").orderBy("from")
    spans = changes.withColumns({"n": F.sum("d").over(w), "to": F.lead("from").over(w) - 1})
    return spans.where(_dense("n", least)).select("plan", "from", "to")


def _moved(boxes: DataFrame, lines: DataFrame, **ends: tuple[Column, Column, Column, bool]) -> DataFrame:
    """Boxes with each named end at the first (or last) of the plan's lines from one column to another, else at a third."""
    near = boxes.join(lines, "plan", "left")
    within = lambda lo, hi, first: F.when((F.col("from") <= hi) & (F.col("to") >= lo), F.greatest("from", lo) if first else F.least("to", hi))
    found = near.groupBy(*boxes.columns).agg(*((F.min if first else F.max)(within(lo, hi, first)).alias(f"_{name}") for name, (lo, hi, _, first) in ends.items()))
    return found.withColumns({name: F.coalesce(f"_{name}", other) for name, (_, _, other, _) in ends.items()}).drop(*(f"_{name}" for name in ends))


def _main_clusters(dark: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes with cl, ct, cr, cb: the bounds of the largest connected group of dense cells, where it stands out."""
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    b = boxes.withColumns({"w": w, "h": h}).withColumn("cell", F.greatest(F.lit(3), _nearest(F.greatest("w", "h") / 300))).where("w >= 60 and h >= 60")
    b = b.withColumn("step", F.greatest(F.lit(1), _nearest(F.col("cell") / 4)))
    c = F.col
    first, last, row = F.greatest("x0", "left") - c("left"), F.least(c("x1"), c("right") - 1) - c("left"), c("gy") - c("top")
    inside = dark.join(b, "plan").where((first <= last) & (c("gy") >= c("top")) & (c("gy") < c("bottom")) & (row % c("cell") % c("step") == 0))
    inside = inside.select("plan", "w", "h", "cell", "step", F.floor(row / c("cell")).cast("int").alias("gy"), first.alias("first"), last.alias("last"))
    met = inside.withColumn("gx", F.explode(F.sequence(F.floor(c("first") / c("cell")).cast("int"), F.floor(c("last") / c("cell")).cast("int"))))
    begin = c("gx") * c("cell")
    looked = _multiples(F.greatest(c("first") - begin, F.lit(0)), F.least(c("last") - begin, c("cell") - 1), c("step"))
    n = met.groupBy("plan", "gx", "gy", "w", "h", "cell", "step").agg(F.sum(looked).alias("n"))
    seen = lambda g, size: F.ceil(F.least(c("cell"), c(size) - c(g) * c("cell")) / c("step"))
    dense = n.where(c("n") / (seen("gx", "w") * seen("gy", "h")) >= DENSE_CELL).select("plan", "gx", "gy")
    grids = b.select("plan", F.ceil(F.col("w") / F.col("cell")).cast("int").alias("width"), F.ceil(F.col("h") / F.col("cell")).cast("int").alias("height"))
    parts = labelled(runs_of(dense, ["plan"]), grids)
    size = parts.groupBy("plan", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("gx0"), F.max("x1").alias("gx1"), F.min("gy").alias("gy0"), F.max("gy").alias("gy1"))
    best = size.groupBy("plan").agg(F.min(F.struct((-F.col("area")).alias("a"), "label", "gx0", "gx1", "gy0", "gy1")).alias("m")).where("m.a <= -4")
    t = b.join(best, "plan")
    edge = lambda lo, g: F.col(lo) + F.col(g) * F.col("cell")
    t = t.withColumns({"cl": edge("left", "m.gx0"), "ct": edge("top", "m.gy0"), "cr": F.least("right", edge("left", "m.gx1") + F.col("cell")), "cb": F.least("bottom", edge("top", "m.gy1") + F.col("cell"))})
    t = cut(t.where((F.col("cr") - F.col("cl")) * (F.col("cb") - F.col("ct")) < w * h * MOST_CLUSTER).select("plan", "cl", "ct", "cr", "cb"), "clusters")
    t = cut(_moved(t, _dense_rows(dark, t, c("cl"), c("cr"), 0, 500), ct=(c("ct"), c("cb") - 1, c("cb"), True), cb=(c("ct"), c("cb"), c("ct"), False)), "clusters")
    t = cut(_moved(t, _dense_columns(dark, t, c("ct"), c("cb"), 0, 500), cl=(c("cl"), c("cr") - 1, c("cr"), True), cr=(c("cl"), c("cr"), c("cl"), False)), "clusters")
    return t.where("cr - cl >= 40 and cb - ct >= 40")


def crops(pixels: DataFrame, plans: DataFrame) -> DataFrame:
    """Each plan's crop (left, top, right, bottom; ends inclusive) and whether it was cropped: empty borders go, then all but
    the largest dense group of cells, then sparse strips of at most a quarter from each side."""
    dark = pixels.where((F.col("r") < LIGHT) | (F.col("g") < LIGHT) | (F.col("b") < LIGHT))
    dark = cut(runs_of(dark, ["plan"]), "dark")
    c, zero = F.col, F.lit(0)
    last = lambda s: F.col(s) - 1
    boxes = cut(plans.select("plan", "width", "height"), "plans")
    t = _moved(boxes, _dense_rows(dark, boxes, zero, c("width"), EDGE), top=(zero, last("height"), last("height"), True), bottom=(zero, last("height"), last("height"), False))
    t = cut(_moved(t, _dense_columns(dark, boxes, zero, c("height"), EDGE), left=(zero, last("width"), last("width"), True), right=(zero, last("width"), last("width"), False)), "trimmed")
    large = t.where("bottom - top >= 20 and right - left >= 20")
    main = _main_clusters(dark, large)
    t = large.join(main, "plan", "left").select("plan", "width", "height", *(F.coalesce(a, b).alias(b) for a, b in (("cl", "left"), ("ct", "top"), ("cr", "right"), ("cb", "bottom"))))
    share = lambda n, f: _nearest(n * f)
    t = cut(t.withColumns({"ch": c("bottom") - c("top"), "cw": c("right") - c("left")}), "boxes")
    low = F.greatest(c("top") + share(c("ch"), 0.5), c("bottom") - share(c("ch"), MOST_STRIP))
    high = F.least(c("bottom") - share(c("ch"), 0.5), c("top") + share(c("ch"), MOST_STRIP))
    t = cut(_moved(t, _dense_rows(dark, t, c("left"), c("right"), DENSE), y1=(low, c("bottom"), c("bottom"), False), y0=(c("top"), high, c("top"), True)), "strips")
    low = F.greatest(c("left") + share(c("cw"), 0.5), c("right") - share(c("cw"), MOST_STRIP))
    high = F.least(c("right") - share(c("cw"), 0.5), c("left") + share(c("cw"), MOST_STRIP))
    t = _moved(t, _dense_columns(dark, t, c("y0"), c("y1"), DENSE), x1=(low, c("right"), c("right"), False), x0=(c("left"), high, c("left"), True))
    w, h = c("x1") - c("x0") + 1, c("y1") - c("y0") + 1
    good = t.where((w >= 80) & (h >= 80) & ~((w >= c("width") * 0.99) & (h >= c("height") * 0.99))).select("plan", "x0", "y0", "x1", "y1")
    whole = {"x0": zero, "y0": zero, "x1": last("width"), "y1": last("height")}
    names = {"x0": "left", "y0": "top", "x1": "right", "y1": "bottom"}
    return boxes.join(good, "plan", "left").select("plan", *(F.coalesce(k, v).alias(names[k]) for k, v in whole.items()), c("x0").isNotNull().alias("cropped"))


def corrected_sizes(plans: DataFrame) -> DataFrame:
    """Plans (width, height and known width_m, height_m) with the size to which white is added so that pixels are square,
    where the aspect is off by more than TOLERANCE: out_w, out_h, the offsets of the image, and ``applied``."""
    known = (F.col("width_m") > 0) & (F.col("height_m") > 0)
    raw, target = F.col("width") / F.greatest("height", F.lit(1)), F.col("width_m") / F.greatest("height_m", F.lit(0.0001))
    off = F.abs(raw - target) / target
    applied = F.coalesce(known & (off > TOLERANCE), F.lit(False))
    wide = applied & (raw > target)
    out_h = F.when(wide, _nearest(F.col("width") / target)).otherwise(F.col("height")).cast("int")
    out_w = F.when(applied & ~wide, _nearest(F.col("height") * target)).otherwise(F.col("width")).cast("int")
    t = plans.withColumns({"mismatch": F.when(known, off), "applied": applied, "out_w": out_w, "out_h": out_h})
    return t.withColumns({"offset_x": _nearest((F.col("out_w") - F.col("width")) / 2), "offset_y": _nearest((F.col("out_h") - F.col("height")) / 2)})
