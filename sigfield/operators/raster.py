"""Raster operators on sparse cells (layer, gx, gy, value): a missing row is an inactive cell.

Kernels, dilation, difference and prefix sums are equi-joins on offsets, aggregates and windows. Labels
of connected cells come from the links between neighbours, whatever the raster's size, and suppression goes in
rounds of local winners. Hulls are taken of shares of a layer's points first, then of their corners.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigfield.functions.scalars import clamp, smoothstep


def gaussian_kernel(radius: int) -> list[float]:
    sigma = max(radius / 2.5, 0.72)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def blur_axis(cells: DataFrame, columns: list[str], axis: str, size: int, radius: int, by: list[str]) -> DataFrame:
    """One-dimensional Gaussian blur of columns of a grid of ``size`` cells along an axis. A cell at a border
    counts for all places beyond it; missing cells count as 0. Each cell is sent to those it reaches."""
    kernel = gaussian_kernel(radius)
    upto = [sum(kernel[:k]) for k in range(len(kernel) + 1)]
    at = F.col(axis)
    values = lambda v: F.array(*map(F.lit, v))
    offsets = F.sequence(F.greatest(F.lit(-radius), -at), F.least(F.lit(radius), F.lit(size - 1) - at))
    # from the source: the target is at + o, so the source lies -o from the target
    inner = F.get(values(kernel), F.lit(radius) - F.col("o"))
    first = F.get(values(upto), F.lit(radius + 1) - F.col("o"))
    last = F.lit(1.0) - F.get(values(upto), F.lit(radius) - F.col("o"))
    weight = F.lit(1.0) if size == 1 else F.when(at == 0, first).when(at == size - 1, last).otherwise(inner)
    sent = cells.withColumn("o", F.explode(offsets)).withColumn("w", weight).withColumn(axis, at + F.col("o"))
    return sent.groupBy(*by, "gx", "gy").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in columns))


def _blur_pass(cells: DataFrame, radius: int, width: int, height: int, by: list[str]) -> DataFrame:
    weight = F.greatest(F.col("alpha"), F.lit(0.001))
    field = cells.select(*by, "gx", "gy", (F.col("value") * weight).alias("top"), weight.alias("bottom"))
    for axis, size in (("gx", width), ("gy", height)):
        field = blur_axis(field, ["top", "bottom"], axis, size, radius, by)
    keys = [*by, "gx", "gy"]
    both = cells.join(field, keys).join(gradient(cells, width, height, by), keys)
    keep = smoothstep(3.5, 12.0, F.hypot("dx", "dy")) * 0.78
    some = F.col("bottom") > 0.0001
    value = F.col("value") * keep + F.col("top") / F.nullif(F.col("bottom"), F.lit(0.0)) * (F.lit(1.0) - keep)
    return both.select(*keys, F.when(some, value).otherwise(F.col("value")).alias("value"), F.when(some, clamp(F.col("bottom"), 0.0, 1.0)).otherwise(F.col("alpha")).alias("alpha"))


def blur(cells: DataFrame, radius: int, width: int, height: int, by: list[str]) -> DataFrame:
    """Blur of a field (value, alpha) over its active cells: values weigh their alpha, steep places are
    preserved, and beyond radius 2 a second, narrower pass follows."""
    if radius <= 0:
        return cells
    cells = _blur_pass(cells, radius, width, height, by)
    return _blur_pass(cells, max(1, int(radius * 0.46 + 0.5)), width, height, by) if radius > 2 else cells


def dilate(cells: DataFrame, radius: int, width: int, height: int, by: list[str]) -> DataFrame:
    """Cells within a disk of an active cell."""
    disk = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if x * x + y * y <= radius * radius]
    offsets = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in disk))
    moved = cells.select(*by, "gx", "gy", F.explode(offsets).alias("o")).select(*by, (F.col("gx") + F.col("o.x")).alias("gx"), (F.col("gy") + F.col("o.y")).alias("gy"))
    return moved.where(F.col("gx").between(0, width - 1) & F.col("gy").between(0, height - 1)).distinct()


def connected(cells: DataFrame, width: int, by: str, diagonal: bool = False) -> DataFrame:
    """Each cell's component as its least cell number gy * width + gx: the first in scan order.

    Labels fall to the least label among neighbours, then to that label's own label, until none moves;
    each round is written to the shared folder."""
    from sigfield.runtime import cut

    moves = [(1, 0), (0, 1), *([(1, 1), (1, -1)] if diagonal else [])]
    base = cells.select(F.col(by).alias("layer"), "gx", "gy", (F.col("gy") * width + F.col("gx")).cast("long").alias("cell")).distinct()
    step = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in moves))
    ahead = base.select("layer", F.col("cell").alias("a"), F.explode(step).alias("o"), "gx", "gy").select("layer", "a", (F.col("gx") + F.col("o.x")).alias("gx"), (F.col("gy") + F.col("o.y")).alias("gy"))
    links = ahead.join(base.select("layer", "gx", "gy", F.col("cell").alias("b")), ["layer", "gx", "gy"]).select("layer", "a", "b")
    links = cut(links.union(links.select("layer", F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = cut(base.withColumn("label", F.col("cell")), "labels")
    while True:
        near = links.join(labels.select("layer", F.col("cell").alias("b"), F.col("label").alias("l")), ["layer", "b"]).groupBy("layer", F.col("a").alias("cell")).agg(F.min("l").alias("l"))
        fallen = labels.join(near, ["layer", "cell"], "left").withColumn("to", F.least("label", "l"))
        jump = fallen.select("layer", F.col("cell").alias("to"), F.col("to").alias("top"))
        now = cut(fallen.join(jump, ["layer", "to"], "left").select("layer", "gx", "gy", "cell", F.least("to", "top").alias("label"), (F.least("to", "top") != F.col("label")).alias("moved")), "labels")
        labels = now.drop("moved")
        if not now.where("moved").limit(1).count():
            return labels.select(F.col("layer").alias(by), "gx", "gy", "label")


def component_stats(labelled: DataFrame, by: str) -> DataFrame:
    """Area, bounds and centre of each component."""
    return labelled.groupBy(by, "label").agg(F.count(F.lit(1)).alias("area"), F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1"), F.round(F.sum("gx") / F.count(F.lit(1)), 4).alias("cx"), F.round(F.sum("gy") / F.count(F.lit(1)), 4).alias("cy"))


def summed_area(cells: DataFrame, by: list[str]) -> DataFrame:
    """Two-dimensional prefix sums of integer values."""
    row = Window.partitionBy(*by, "gy").orderBy("gx").rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy(*by, "gx").orderBy("gy").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("s", F.sum("value").over(row)).withColumn("total", F.sum("s").over(column)).drop("s")


def box_sums(totals: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """Sum of the values in each box (x0, y0, x1, y1; ends exclusive) from prefix sums: four lookups."""
    corners = F.array(*(F.struct((F.col(x) - 1).alias("gx"), (F.col(y) - 1).alias("gy"), F.lit(s).alias("sign")) for x, y, s in (("x1", "y1", 1), ("x1", "y0", -1), ("x0", "y1", -1), ("x0", "y0", 1))))
    keys = boxes.columns
    looked = boxes.withColumn("c", F.explode(corners)).select(*keys, "c.*").join(totals, [*by, "gx", "gy"], "left")
    return looked.groupBy(*keys).agg(F.sum(F.coalesce("total", F.lit(0)) * F.col("sign")).alias("inside"))


BLOCK = 64  # pixels of a line that one word or join key covers


def words(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells, or runs (x0, x1) of them, as words (keys, gy, bx, bits) of BLOCK pixels of a line, of which a task makes its own before
    the shuffle; repeated cells count once. Words stay as they are."""
    if "bits" in cells.columns:
        return cells.select(*keys, "gy", "bx", "bits")
    shift = lambda name, v, n: F.call_function(name, F.lit(v).cast("long"), n.cast("int"))
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    if "x0" in cells.columns:
        first, last = F.greatest(F.lit(0), F.col("x0") - F.col("bx") * BLOCK), F.least(F.lit(BLOCK - 1), F.col("x1") - F.col("bx") * BLOCK)
        bits = shift("shiftleft", -1, first).bitwiseAND(shift("shiftrightunsigned", -1, F.lit(BLOCK - 1) - last))
        pieces = cells.select(*keys, "gy", "x0", "x1", F.explode(F.sequence(block("x0"), block("x1"))).alias("bx")).withColumn("bits", bits)
    else:
        pieces = cells.select(*keys, "gy", block("gx").alias("bx"), shift("shiftleft", 1, F.pmod(F.col("gx"), F.lit(BLOCK))).alias("bits"))
    return pieces.groupBy(*keys, "gy", "bx").agg(F.bit_or("bits").alias("bits"))


def bits_of(word: Column) -> Column:
    """The places of a word's bits, in order."""
    return F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda k: F.call_function("getbit", word, k) == 1)


def density_profile(cells: DataFrame, axis: str, by: list[str]) -> DataFrame:
    """Number of active cells of each row (gy) or column (gx)."""
    return cells.groupBy(*by, axis).agg(F.count(F.lit(1)).alias("n"))


def gradient(cells: DataFrame, width: int, height: int, by: list[str]) -> DataFrame:
    """Differences ``dx`` and ``dy`` between the cells to the right and left, below and above. Beyond a
    border the cell itself counts, an inactive neighbour as 0. Each value is sent to its neighbours."""
    x, y, v = F.col("gx"), F.col("gy"), F.col("value")
    send = lambda to_x, to_y, dx, dy: F.struct(to_x.alias("gx"), to_y.alias("gy"), (v * dx).alias("dx"), (v * dy).alias("dy"), F.lit(0).alias("here"))
    own = F.struct(x.alias("gx"), y.alias("gy"), (v * ((x == width - 1).cast("int") - (x == 0).cast("int"))).alias("dx"), (v * ((y == height - 1).cast("int") - (y == 0).cast("int"))).alias("dy"), F.lit(1).alias("here"))
    parts = F.array(own, send(x - 1, y, 1, 0), send(x + 1, y, -1, 0), send(x, y - 1, 0, 1), send(x, y + 1, 0, -1))
    sums = cells.select(*by, F.explode(parts).alias("p")).select(*by, "p.*").groupBy(*by, "gx", "gy").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"), F.max("here").alias("here"))
    return sums.where("here = 1").drop("here")


def spans(cells: DataFrame, by: list[str]) -> DataFrame:
    """First and last active cell of each row."""
    return cells.groupBy(*by, "gy").agg(F.min("gx").alias("x0"), F.max("gx").alias("x1"))


def runs(cells: DataFrame, by: list[str], gap: int = 1) -> DataFrame:
    """Maximal runs of a row's cells whose gaps are at most ``gap``."""
    w = Window.partitionBy(*by, "gy").orderBy("gx")
    new = F.coalesce((F.col("gx") - F.lag("gx").over(w) > gap).cast("int"), F.lit(1))
    numbered = cells.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return numbered.groupBy(*by, "gy", "run").agg(F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.count(F.lit(1)).alias("n"))


HULL_SHARES = 64


def convex_hull(points: DataFrame, by: str) -> DataFrame:
    """Corners (by, i, x, y) of each group's hull, counter-clockwise from the leftmost, then lowest; fewer than three points are
    given as they are.

    Only the lowest and highest point of each x matter. They are dealt into shares of a group, and each share's hull is
    taken by itself; the last step sees the corners of HULL_SHARES hulls, however many points there are."""
    from sigfield.runtime import ship

    ship(points.sparkSession)
    top = points.groupBy(by, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    flat = top.select(by, "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"), F.pmod(F.xxhash64("x"), F.lit(HULL_SHARES)).alias("share"))
    kind = points.schema[by].dataType.simpleString()
    shares = flat.groupBy(by, "share").applyInPandas(lambda t: _hull_of(t, by), f"{by} {kind}, i int, x double, y double")
    return shares.groupBy(by).applyInPandas(lambda t: _hull_of(t, by), f"{by} {kind}, i int, x double, y double")


def _hull_of(t: pd.DataFrame, by: str) -> pd.DataFrame:
    p = sorted(set(zip(t["x"], t["y"])))

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    ring = half(p)[:-1] + half(p[::-1])[:-1] if len(p) > 2 else p
    return pd.DataFrame({by: [t[by].iloc[0]] * len(ring), "i": range(len(ring)), "x": [q[0] for q in ring], "y": [q[1] for q in ring]})


def hull_mask(hull: DataFrame, by: str, width: int, height: int, margin: float) -> DataFrame:
    """Runs (by, gy, x0, x1) of the pixels within each hull of three corners or more, whose corners are moved away from their
    mean by the margin: every scanline is filled between its crossings with the outline."""
    centre = hull.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my")).where("n > 2")
    t = hull.join(centre, by)
    d = F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))
    f = F.when(d < 1, 1.0).otherwise(F.lit(1.0) + F.lit(float(margin)) / F.nullif(d, F.lit(0.0)))
    moved = t.select(by, "i", "n", (F.col("mx") + (F.col("x") - F.col("mx")) * f).alias("x"), (F.col("my") + (F.col("y") - F.col("my")) * f).alias("y"))
    after = moved.select(by, F.pmod(F.col("i") - 1, F.col("n")).cast("int").alias("i"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    sides = moved.join(after, [by, "i"])
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    line = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(low)).cast("int"), F.least(F.lit(height - 1), F.ceil(high) - 1).cast("int")))
    crossed = sides.where((F.greatest(F.lit(0), F.ceil(low)) <= F.least(F.lit(height - 1), F.ceil(high) - 1))).withColumn("gy", line)
    at = crossed.select(by, "gy", (F.col("x") + (F.col("gy") - F.col("y")) / (F.col("y2") - F.col("y")) * (F.col("x2") - F.col("x"))).alias("at"))
    lines = at.groupBy(by, "gy").agg(F.array_sort(F.collect_list("at")).alias("at"))  # a few crossings of one line
    pairs = lines.select(by, "gy", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("at") / 2) - 1), lambda k: F.struct(F.get("at", (k * 2).cast("int")).alias("a"), F.get("at", (k * 2 + 1).cast("int")).alias("b")))).alias("p"))
    cut_to = pairs.select(by, "gy", F.greatest(F.lit(0), F.floor("p.a")).cast("int").alias("x0"), F.least(F.lit(width - 1), F.ceil("p.b")).cast("int").alias("x1"))
    return cut_to.where("x0 <= x1")


def suppress(candidates: DataFrame, by: str, least: float, most: int) -> DataFrame:
    """Greedy non-maximum suppression of rows (by, x, y, score): best score first, then by y and x, none nearer than
    ``least``, at most ``most`` of a group. ``place`` numbers those of a group in reading order, by y, then x."""
    from sigfield.operators.graph import greedy

    near = lambda a, b: F.hypot(a("x") - b("x"), a("y") - b("y")) < least
    kept = greedy(candidates, [by], {"x": least, "y": least}, [-F.col("score"), F.col("y"), F.col("x")], near)
    best = Window.partitionBy(by).orderBy(F.desc("score"), "y", "x")
    top = kept.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("y", "x")))
