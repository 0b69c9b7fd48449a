"""Walls from plan images: candidates along both axes, their merging, the graph they form, and their material.

An image is rows (plan, gx, gy, r, g, b, a), or runs (plan, gy, x0, x1, r, g, b, a) of equal pixels; pixels without a row are
transparent. ``plans`` has one row a plan: (plan, width, height). Many plans are worked on in one job, and the pixels of one
are dealt by line, cell or wall, never all to one task. Traced pixels stay runs, then words of BLOCK pixels, so that only
``trace_mask`` makes a row for each. Candidates are rows (plan, orientation, start, end, cross_start, cross_end, score)
in scaled pixels, ends inclusive; ``horizontal`` ones run along x and cross y.

An empty image, or one with too few or too many traced pixels, has no walls. Null colours and an alpha of 24 or
less count as transparent; repeated pixels of one place count once in masks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigfield.functions.scalars import clamp, round_half_up
from sigfield.functions.scores import hue_degrees, luminance, saturation
from sigfield.operators.graph import by_groups, components, greedy
from sigfield.operators.raster import BLOCK, bits_of, words
from sigfield.runtime import cut, ship, spread

# fixed values: thresholds of traced pixels, candidates and structural walls
CONTRAST, LIGHT, VIVID, VIVID_CONTRAST, OPAQUE = 42, 0.74, 0.24, 30, 24
DENSITY, MOST_COVERED, FEWEST, FEWEST_SHARE = (0.06, 0.92), 0.46, 40, 0.00004
ASPECT, MOST_WALLS = 4.8, 110
CELL = 64  # scaled pixels to a side of a cell in which segments meet
SHARES = 8  # tasks that the lines of one plan are dealt to, strip by strip


def _nearest(v: Column) -> Column:
    return F.floor(v + 0.5).cast("int")


def of_plans(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of lines (plan, gy) with what is known of their plan, one row each.

    Files of images are a hundred times smaller than their rows in memory. By the files' size Spark would gather the rows in
    the driver and send them to every task; so both sides are dealt by plan and strip instead."""
    share = F.pmod(F.floor(F.col("gy") / BLOCK), F.lit(SHARES)).cast("int")
    shares = known.withColumn("_share", F.explode(F.array(*map(F.lit, range(SHARES)))))
    return spread(rows.withColumn("_share", share), "plan", "_share").join(spread(shares, "plan", "_share").hint("merge"), ["plan", "_share"]).drop("_share")


def settings(plans: DataFrame) -> DataFrame:
    """Plans with what their sizes decide: scale, scaled size, band, gap, least length and tolerances."""
    whole = lambda v, lo, hi: clamp(v.cast("double"), lo, hi).cast("int")
    p = plans.withColumn("scale", whole(F.ceil(F.greatest("width", "height") / 2400), 1, 5))
    p = p.withColumns({"sw": F.ceil(F.col("width") / F.col("scale")).cast("int"), "sh": F.ceil(F.col("height") / F.col("scale")).cast("int")})
    p = p.withColumn("longest", F.greatest("sw", "sh"))
    share = lambda f: _nearest(F.col("longest") * f)
    p = p.withColumns({"band": whole(_nearest(F.col("longest") / 360), 2, 5), "gap": whole(_nearest(F.col("longest") / 170), 4, 12), "least": whole(share(0.035), 18, 86)})
    at_least = lambda times, f: F.greatest(F.col("band") * times, share(f))
    p = p.withColumns({"cross_gap": F.greatest(F.lit(3), F.col("band") * 3), "frame": F.greatest(F.lit(8), share(0.018)), "junction": at_least(4, 0.012), "parallel": at_least(5, 0.018), "graph": at_least(5, 0.014)})
    return p.withColumn("wide_gap", F.greatest(F.col("cross_gap") * 2, share(0.014)))


def backgrounds(pixels: DataFrame, plans: DataFrame) -> DataFrame:
    """Each plan's mean colour (br, bg, bb) of sampled opaque border pixels, white where there are none. Corners
    count for both of their sides. ``pixels`` may be runs (plan, gy, x0, x1, r, g, b, a)."""
    size = plans.select("plan", "width", "height", *(F.greatest(F.lit(1), F.floor(F.col(c) / 80)).alias(s) for c, s in (("width", "sx"), ("height", "sy"))))
    edge = lambda c, n: (F.col(c) == 0).cast("int") + (F.col(c) == F.col(n) - 1).cast("int")
    on = lambda c, s: (F.col(c) % F.col(s) == 0).cast("int")
    times = on("gx", "sx") * edge("gy", "height") + on("gy", "sy") * edge("gx", "width")
    seen = of_plans(pixels.where(F.col("a") > OPAQUE), size)
    if "x0" in pixels.columns:  # of runs, only pixels that may lie at a border are made
        at_line = (F.col("gy") == 0) | (F.col("gy") == F.col("height") - 1)
        ends = F.when(at_line, F.sequence("x0", "x1")).otherwise(F.array_distinct(F.array("x0", "x1")))
        seen = seen.where(at_line | (F.col("x0") == 0) | (F.col("x1") == F.col("width") - 1)).withColumn("gx", F.explode(ends))
    seen = seen.withColumn("n", times).where("n > 0")
    mean = seen.groupBy("plan").agg(*((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"b{c}") for c in "rgb"))
    return plans.select("plan").join(mean.hint("merge"), "plan", "left").na.fill(255.0, ["br", "bg", "bb"])


def traced(pixels: DataFrame, plans: DataFrame) -> DataFrame:
    """Runs (plan, gy, x0, x1, r, g, b, scale) of opaque pixels that stand out from their plan's background; of pixels, a run each."""
    known = settings(plans).select("plan", "scale").join(backgrounds(pixels, plans).hint("merge"), "plan")
    ends = ["x0", "x1"] if "x0" in pixels.columns else [F.col("gx").alias("x0"), F.col("gx").alias("x1")]
    p = of_plans(pixels.where(F.col("a") > OPAQUE).select("plan", "gy", *ends, "r", "g", "b"), known)
    at = [F.col(c) for c in "rgb"]
    far = sum(((F.col(c) - F.col(f"b{c}")) * (F.col(c) - F.col(f"b{c}")) for c in "rgb"), F.lit(0.0))
    light, vivid = luminance(*at) / 255, saturation(*at)
    return p.where((far > CONTRAST * CONTRAST) | (light < LIGHT) | ((vivid > VIVID) & (far > VIVID_CONTRAST * VIVID_CONTRAST))).drop("br", "bg", "bb")


def mask_words(pixels: DataFrame, plans: DataFrame) -> DataFrame:
    """``trace_mask`` as words (plan, gy, bx, bits) of BLOCK cells of a line."""
    scaled = lambda c: F.floor(F.col(c) / F.col("scale")).cast("int").alias(c)
    w = F.col("bits")
    beside = F.shiftleft(w, 1).bitwiseOR(F.shiftrightunsigned(w, 1))
    nothing = F.lit(0).cast("long")
    sent = lambda dy, dx, near, own=nothing: F.struct((F.col("gy") + dy).alias("gy"), (F.col("bx") + dx).alias("bx"), near.alias("near"), own.alias("own"))
    # each word's bits go to those around them, the outer ones to the words beside
    parts = [part for dy in (-1, 0, 1) for part in (sent(dy, 0, beside if dy == 0 else w.bitwiseOR(beside), w if dy == 0 else nothing), sent(dy, 1, F.shiftrightunsigned(w, 63)), sent(dy, -1, F.shiftleft(w, 63)))]
    own = words(traced(pixels, plans).select("plan", scaled("x0"), scaled("x1"), scaled("gy")), ["plan"])
    moved = own.select("plan", F.explode(F.filter(F.array(*parts), lambda p: p["near"].bitwiseOR(p["own"]) != 0)).alias("p")).select("plan", "p.*")
    joined = moved.groupBy("plan", "gy", "bx").agg(F.bit_or("near").bitwiseAND(F.bit_or("own")).alias("bits"))
    return joined.where("bits <> 0")


def trace_mask(pixels: DataFrame, plans: DataFrame) -> DataFrame:
    """Scaled cells (plan, gx, gy) that hold a traced pixel and have one of the 8 cells around them too."""
    found = spread(mask_words(pixels, plans), "plan", "gy")  # each word becomes many rows
    return found.select("plan", "gy", "bx", F.explode(bits_of(F.col("bits"))).alias("k")).select("plan", (F.col("bx") * BLOCK + F.col("k")).cast("int").alias("gx"), "gy")


def coverage(mask: DataFrame, plans: DataFrame) -> DataFrame:
    """Each plan's share of mask cells, which may come as words, and whether the mask is neither too empty nor too full for walls."""
    size = F.col("sw") * F.col("sh")
    n = F.coalesce(F.col("n"), F.lit(0))
    each = F.sum(F.bit_count("bits")) if "bits" in mask.columns else F.count(F.lit(1))
    counted = settings(plans).join(mask.groupBy("plan").agg(each.alias("n")).hint("merge"), "plan", "left").withColumn("covered", n / F.greatest(size, F.lit(1)))
    usable = (n >= F.greatest(F.lit(float(FEWEST)), size * FEWEST_SHARE)) & (F.col("covered") <= MOST_COVERED)
    return counted.select("plan", "covered", usable.alias("usable"))


def _band_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs that are long enough (plan, orientation, start, end, cross_start, cross_end, pixels) of each strip's lines, from the
    words (gy, bx, bits) of the strip and around it."""
    keys = ["plan", "orientation", "strip"]
    for t in by_groups(batches, keys):
        starts = np.append(np.flatnonzero((t[keys] != t[keys].shift()).any(axis=1).to_numpy()), len(t))
        columns = {c: t[c].to_numpy() for c in t.columns}
        bits = np.unpackbits(columns["bits"].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out = []
        for i, j in zip(starts[:-1], starts[1:]):
            orientation, strip, sw, sh, band, gap, least = (columns[c][i] for c in ("orientation", "strip", "sw", "sh", "band", "gap", "least"))
            gy, bx = columns["gy"][i:j], columns["bx"][i:j]
            if orientation == "horizontal":
                limit, along = sh, sw
                image = np.zeros((BLOCK + 2 * band, -(-sw // BLOCK), BLOCK), np.int32)
                image[gy - strip * BLOCK + band, bx] = bits[i:j]
                image = image.reshape(BLOCK + 2 * band, -1)
            else:
                limit, along = sw, sh
                image = np.zeros((sh, 3, BLOCK), np.int32)
                image[gy, bx - strip + 1] = bits[i:j]
                image = image.reshape(sh, -1)[:, BLOCK - band : 2 * BLOCK + band].T
            upto = np.pad(np.cumsum(image, axis=0), ((1, 0), (0, 0)))
            n = (upto[2 * band + 1 :] - upto[: -2 * band - 1])[: max(0, limit - strip * BLOCK)]
            line, place = np.nonzero(n)
            if not len(line):
                continue
            first = np.flatnonzero(np.r_[True, (np.diff(line) != 0) | (np.diff(place) > gap + 1)])
            last = np.append(first[1:], len(line)) - 1
            end = np.where(along - 1 - place[last] <= gap, along - 1, place[last])
            long = end - place[first] + 1 >= least
            cross = strip * BLOCK + line[first][long]
            pixels = np.add.reduceat(n[line, place], first)[long]
            same = np.full(len(cross), i)
            out.append((same, place[first][long], end[long], np.maximum(0, cross - band), np.minimum(limit - 1, cross + band), pixels))
        if out:
            row, *found = (np.concatenate(c) for c in zip(*out))
            names = ["start", "end", "cross_start", "cross_end", "pixels"]
            yield pd.DataFrame({"plan": columns["plan"][row], "orientation": columns["orientation"][row], **dict(zip(names, found))})


def axis_candidates(mask: DataFrame, plans: DataFrame) -> DataFrame:
    """Runs along every line of both axes. A line is a band of lines around it; a place is hit where the band
    has a mask cell; hits at most ``gap`` misses apart make a run, which reaches the border if that is as near. Runs
    that are long enough stay if the share of mask cells in their box is within DENSITY. ``mask`` may come as words.

    Strips of BLOCK lines are dealt singly, with the lines that the outer bands reach beyond them."""
    ship(mask.sparkSession)
    w, band, bx = F.col("bits"), F.col("band"), F.col("bx")
    of = lambda v: F.floor(v / BLOCK).cast("int")
    outer = w.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), band) - 1) != 0
    upper = F.call_function("shiftrightunsigned", w, F.lit(BLOCK) - band) != 0
    strip = lambda name, k, ok: F.when(ok, F.struct(F.lit(name).alias("orientation"), k.alias("strip")))
    first, last = of(F.col("gy") - band), of(F.col("gy") + band)
    dealt_to = [strip("horizontal", first, first >= 0), strip("horizontal", last, last != first), strip("vertical", bx, F.lit(True)), strip("vertical", bx - 1, outer & (bx > 0)), strip("vertical", bx + 1, upper)]
    known = settings(plans).select("plan", "sw", "sh", "band", "gap", "least")
    each = of_plans(words(mask, ["plan"]), known).select("plan", "gy", "bx", "bits", "sw", "sh", "band", "gap", "least", F.explode(F.filter(F.array(*dealt_to), lambda p: p.isNotNull())).alias("p"))
    keys = ["plan", "orientation", "strip"]
    dealt = each.select(*keys[:1], "p.*", "gy", "bx", "bits", "sw", "sh", "band", "gap", "least")
    dealt = spread(dealt, *keys).sortWithinPartitions(*keys)
    kind = mask.schema["plan"].dataType.simpleString()
    runs = dealt.mapInPandas(_band_runs, f"plan {kind}, orientation string, start int, end int, cross_start int, cross_end int, pixels bigint")
    density = F.col("pixels") / ((F.col("end") - F.col("start") + 1) * (F.col("cross_end") - F.col("cross_start") + 1))
    return runs.withColumn("score", density).where(F.col("score").between(*DENSITY)).select("plan", "orientation", "start", "end", "cross_start", "cross_end", "score")


def _split(rows: DataFrame, by: list[str], low: Column, high: Column, gap: str, name: str) -> DataFrame:
    """Number the groups of intervals that a space wider than ``gap`` parts from the others. The windows order rows of one image;
    rows that begin alike get one number, since only the first of them can be fresh."""
    w = Window.partitionBy(*by).orderBy("_low")
    before = F.max("_high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("_low") - before > F.col(gap)).cast("int"), F.lit(1))
    numbered = rows.withColumns({"_low": low, "_high": high}).withColumn("_fresh", fresh)
    return numbered.withColumn(name, F.sum("_fresh").over(w)).drop("_low", "_high", "_fresh")


_FIELDS = ["start", "end", "cross_start", "cross_end", "score"]


def fold_parallel(candidates: DataFrame, plans: DataFrame, cross_gap: str) -> DataFrame:
    """Merge segments of one orientation, in the order of their cross centre, start and earlier rank: each one
    joins the first group, in order of the groups' beginnings, whose centre is at most the gap away and whose span
    is not further than ``gap`` along the line; the group grows to hold it and keeps the best score.

    The pass is exact though it is cut up. Segments that a space wider than the gaps parts, across or along,
    can't meet whatever is merged, because a group's centre and span stay within those of its members; such
    islands are folded in parallel. Within one the rows stream in order, and a group is given out as soon as its
    centre lies too far behind, which no later row can change: a task holds the groups near the current line only.

    Rows gain ``rank``, the place of the group's first segment: its order in the pass."""
    ship(candidates.sparkSession)
    known = settings(plans).select("plan", "gap", (F.col(cross_gap) * 2).alias("cross_gap2"))
    rank = F.col("rank") if "rank" in candidates.columns else F.array().cast("array<bigint>")
    centre = F.col("cross_start") + F.col("cross_end")  # twice the centre
    rows = candidates.join(known.hint("merge"), "plan").select("plan", "orientation", *_FIELDS, "gap", "cross_gap2", centre.alias("centre2"), F.concat(F.array(centre.cast("long"), F.col("start").cast("long")), rank).alias("rank"))
    by = ["plan", "orientation"]
    rows = _split(spread(rows, *by), by, F.col("centre2"), F.col("centre2"), "cross_gap2", "i1")
    rows = _split(rows, [*by, "i1"], F.col("start"), F.col("end"), "gap", "i2")
    rows = _split(rows, [*by, "i1", "i2"], F.col("centre2"), F.col("centre2"), "cross_gap2", "i3")
    keys = [*by, "i1", "i2", "i3"]
    dealt = spread(rows, *keys).sortWithinPartitions(*keys, "rank").select(*keys, "gap", "cross_gap2", "centre2", "rank", *_FIELDS)
    names = ["plan", "orientation", *_FIELDS, "rank"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, live, done = None, [], []
        for t in batches:
            for *key, gap, wide, centre2, order, start, end, c0, c1, score in t.itertuples(index=False, name=None):
                if key != island:
                    done += live
                    island, live = key, []
                far = [g for g in live if g[4] + g[5] < centre2 - wide]
                if far:
                    done += far
                    live = [g for g in live if g[4] + g[5] >= centre2 - wide]
                for g in live:
                    if abs(g[4] + g[5] - centre2) <= wide and min(g[3], end) - max(g[2], start) >= -gap:
                        g[2:7] = min(g[2], start), max(g[3], end), min(g[4], c0), max(g[5], c1), max(g[6], score)
                        break
                else:
                    live.append([key[0], key[1], start, end, c0, c1, score, order])
            if done:
                yield pd.DataFrame(done, columns=names)
                done = []
        if live:
            yield pd.DataFrame(live, columns=names)

    kind = candidates.schema["plan"].dataType.simpleString()
    return dealt.mapInPandas(fold, f"plan {kind}, orientation string, start int, end int, cross_start int, cross_end int, score double, rank array<bigint>")


def _length() -> Column:
    return F.col("end") - F.col("start") + 1


def _structural(least) -> Column:
    thick = F.col("cross_end") - F.col("cross_start") + 1
    return (_length() >= least) & (_length() / F.greatest(thick, F.lit(1)) >= ASPECT) & (thick <= F.greatest(F.lit(18.0), _length() * 0.2))


def merged_segments(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """Candidates merged by the narrow gap, then those of wall-like shape by the wide one."""
    first = cut(fold_parallel(candidates, plans, "cross_gap"), "merged")
    return fold_parallel(first.where(_structural(1)), plans, "wide_gap")


def _cells(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / CELL).cast("int"), F.floor(high / CELL).cast("int")))


def crossings(segments: DataFrame, reach: str) -> DataFrame:
    """Pairs (plan, h, v) of ids of horizontal and vertical segments that meet, both lengthened by ``reach``. A pair
    can only meet where the vertical one's x and the horizontal one's y cross: it is made once, in the cell of that
    point."""
    centre = (F.col("cross_start") + F.col("cross_end")) / 2
    side = lambda name: segments.where(F.col("orientation") == name).select("plan", "id", centre.alias("at"), (F.col("start") - F.col(reach)).alias("lo"), (F.col("end") + F.col(reach)).alias("hi"))
    h = side("horizontal").select("plan", F.col("id").alias("h"), F.col("at").alias("y"), F.col("lo").alias("hlo"), F.col("hi").alias("hhi"), F.floor(F.col("at") / CELL).cast("int").alias("cy"), _cells(F.col("lo"), F.col("hi")).alias("cx"))
    v = side("vertical").select("plan", F.col("id").alias("v"), F.col("at").alias("x"), F.col("lo").alias("vlo"), F.col("hi").alias("vhi"), F.floor(F.col("at") / CELL).cast("int").alias("cx"), _cells(F.col("lo"), F.col("hi")).alias("cy"))
    return h.join(v.hint("merge"), ["plan", "cx", "cy"]).where("x between hlo and hhi and y between vlo and vhi").select("plan", "h", "v")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("plan", F.explode(F.array(F.struct(F.col("h").alias("id"), F.col("v").alias("other")), F.struct(F.col("v").alias("id"), F.col("h").alias("other")))).alias("p")).select("plan", "p.*")


def parallel_neighbours(segments: DataFrame) -> DataFrame:
    """Each segment's number (plan, id, n) of segments of its orientation whose centre is at most ``parallel`` away and
    whose overlap exceeds .54 of the shorter. A pair meets in the cell where the later one starts."""
    centre = (F.col("cross_start") + F.col("cross_end")) / 2
    s = segments.select("plan", "orientation", "id", "start", "end", "parallel", centre.alias("c"), F.floor(centre / F.col("parallel")).cast("int").alias("row"), _cells(F.col("start"), F.col("end")).alias("cell"))
    t = s.select("plan", "orientation", F.col("id").alias("other"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("c").alias("c2"), F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)).alias("row"), "cell")
    overlap = F.least("end", "e2") - F.greatest("start", "s2") + 1
    near = (F.abs(F.col("c") - F.col("c2")) <= F.col("parallel")) & (overlap > 0) & (overlap / F.greatest(F.lit(1), F.least(_length(), F.col("e2") - F.col("s2") + 1)) > 0.54)
    owner = F.col("cell") == F.floor(F.greatest("start", "s2") / CELL)
    return s.join(t.hint("merge"), ["plan", "orientation", "row", "cell"]).where((F.col("id") != F.col("other")) & owner & near).groupBy("plan", "id").agg(F.count(F.lit(1)).alias("n"))


def _touches_frame() -> Column:
    centre, edge = (F.col("cross_start") + F.col("cross_end")) / 2, F.col("frame")
    flat = F.col("orientation") == "horizontal"
    across, along = F.when(flat, F.col("sh")).otherwise(F.col("sw")), F.when(flat, F.col("sw")).otherwise(F.col("sh"))
    return (centre <= edge) | (centre >= across - edge) | (F.col("start") <= edge) | (F.col("end") >= along - edge)


def structural_segments(segments: DataFrame, plans: DataFrame) -> DataFrame:
    """Merged segments that look like walls: at the frame, or joined to others, and not stripes of furniture.
    Rows gain ``id``: the orientation's number and the rank."""
    turn = F.array(F.when(F.col("orientation") == "horizontal", 0).otherwise(1).cast("long"))
    s = segments.withColumn("id", F.concat(turn, "rank")).join(settings(plans).hint("merge"), "plan")
    met = _both_ways(crossings(s, "junction")).groupBy("plan", "id").agg(F.count(F.lit(1)).alias("junctions"))
    beside = parallel_neighbours(s).withColumnRenamed("n", "stripes")
    t = s.join(met.hint("merge"), ["plan", "id"], "left").join(beside.hint("merge"), ["plan", "id"], "left").na.fill(0, ["junctions", "stripes"]).withColumn("touches", _touches_frame())
    long = lambda f: _length() >= F.col("longest") * f
    boundary, joined, divider = F.col("touches") & long(0.16), long(0.09) & (F.col("junctions") >= 1), (_length() >= F.col("least") * 2.1) & (F.col("junctions") >= 2)
    stripe = (F.col("stripes") >= 2) & ~long(0.28) & ~F.col("touches")
    return t.where(_structural(F.col("least")) & (boundary | joined | divider) & ~stripe).select("plan", "id", "orientation", *_FIELDS)


def wall_graph(segments: DataFrame, plans: DataFrame) -> DataFrame:
    """Structural segments of the graph's main components: those that are long enough and reach the frame or have
    two junctions; where a plan has none, its longest component if that is long enough. Segments are linked
    where they cross or have ends near one another. Rows gain ``component``, its least id."""
    s = cut(segments.join(settings(plans).hint("merge"), "plan"), "structural")
    met = cut(crossings(s, "graph"), "crossings")
    centre = (F.col("cross_start") + F.col("cross_end")) / 2
    flat = F.col("orientation") == "horizontal"
    ends = s.select("plan", "id", (F.col("graph") * 1.5).alias("reach"), centre.alias("c"), flat.alias("flat"), F.explode(F.array("start", "end")).alias("e"))
    ends = ends.select("plan", "id", "reach", F.when(F.col("flat"), F.col("e")).otherwise(F.col("c")).alias("x"), F.when(F.col("flat"), F.col("c")).otherwise(F.col("e")).alias("y"))
    cell = lambda c: F.floor(F.col(c) / F.col("reach")).cast("int")
    a = ends.withColumns({"cx": cell("x"), "cy": cell("y")})
    wide = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    b = a.select("plan", F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), wide("cx").alias("cx"), "cy").withColumn("cy", wide("cy"))
    near = a.withColumnRenamed("id", "a").join(b.hint("merge"), ["plan", "cx", "cy"]).where((F.col("a") < F.col("b")) & (F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= F.col("reach"))).select("plan", "a", "b")
    links = met.select("plan", F.col("h").alias("a"), F.col("v").alias("b")).unionByName(near)
    labels = components(s, links, ["plan"]).withColumnRenamed("label", "component")
    junctions = _both_ways(met).groupBy("plan", "id").agg(F.count(F.lit(1)).alias("n"))
    t = s.join(labels.hint("merge"), ["plan", "id"]).join(junctions.hint("merge"), ["plan", "id"], "left").na.fill(0, ["n"])
    sums = t.groupBy("plan", "component", "longest").agg(F.count(F.lit(1)).alias("members"), F.sum(_length()).alias("total"), F.count_if(_touches_frame()).alias("touching"), F.sum("n").alias("junctions"))
    alone = (F.col("members") == 1) & (F.col("touching") > 0) & (F.col("total") >= F.col("longest") * 0.28)
    several = (F.col("members") > 1) & (F.col("total") >= F.col("longest") * 0.26) & ((F.col("touching") > 0) | (F.col("junctions") >= 2))
    judged = sums.withColumn("main", alone | several)
    best = judged.groupBy("plan").agg(F.bool_or("main").alias("any"), F.min(F.struct((-F.col("total")).alias("t"), "component")).alias("best"))
    fallback = ~F.col("any") & (F.col("component") == F.col("best.component")) & (F.col("total") >= F.col("longest") * 0.26)
    kept = judged.join(best.hint("merge"), "plan").where(F.col("main") | fallback).select("plan", "component")
    return t.join(kept.hint("merge"), ["plan", "component"], "left_semi").select("plan", "id", "component", "orientation", *_FIELDS)


def placed_walls(segments: DataFrame, plans: DataFrame, most: int = MOST_WALLS) -> DataFrame:
    """A plan's best segments by length times score as walls (plan, number, x0, y0, x1, y1) at full size."""
    worth = _length() * F.col("score")
    w = Window.partitionBy("plan").orderBy(F.desc("worth"), "component", "id")
    top = segments.withColumn("worth", worth).withColumn("number", F.row_number().over(w)).where(F.col("number") <= most)
    t = top.join(settings(plans).hint("merge"), "plan")
    flat = F.col("orientation") == "horizontal"
    limit = lambda v, n: round_half_up(clamp(v.cast("double"), F.lit(0.0), (F.col(n) - 1).cast("double")), 1)
    centre = (F.col("cross_start") + F.col("cross_end") + 1) * F.col("scale") * 0.5
    first, last = F.col("start") * F.col("scale"), (F.col("end") + 1) * F.col("scale") - 1
    x = lambda v: F.when(flat, limit(v, "width")).otherwise(limit(centre, "width"))
    y = lambda v: F.when(flat, limit(centre, "height")).otherwise(limit(v, "height"))
    return t.select("plan", "number", x(first).alias("x0"), y(first).alias("y0"), x(last).alias("x1"), y(last).alias("y1"))


def trace_profiles(walls: DataFrame, pixels: DataFrame, plans: DataFrame) -> DataFrame:
    """What the image shows along each wall (plan, number): the share of samples with traced pixels, their mean
    number across, mean saturation, shares of colours, and the share of samples that begin a run after the
    first. Walls shorter than 8 pixels or without a traced pixel have no row."""
    known = settings(plans).select("plan", F.greatest("width", "height").alias("side"))
    size = lambda by, lo, hi: clamp(_nearest(F.col("side") / by).cast("double"), lo, hi)
    t = walls.select("plan", "number", "x0", "y0", "x1", "y1").join(known.hint("merge"), "plan").withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).where("length >= 8")
    t = t.withColumns({"radius": size(240, 5, 13).cast("int"), "steps": F.greatest(F.lit(1), F.ceil(F.col("length") / size(650, 2, 5))).cast("int")})
    t = spread(t, "plan", "number").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps")))).withColumn("o", F.explode(F.sequence(-F.col("radius"), F.col("radius"))))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("i") / F.col("steps"))
    dx, dy = (F.col("x1") - F.col("x0")) / F.col("length"), (F.col("y1") - F.col("y0")) / F.col("length")
    looked = t.select("plan", "number", "steps", "i", _nearest(at("x0", "x1") - dy * F.col("o")).alias("gx"), _nearest(at("y0", "y1") + dx * F.col("o")).alias("gy"))
    rgb = [F.col(c) for c in "rgb"]
    light, vivid, hue = luminance(*rgb) / 255, saturation(*rgb), hue_degrees(*rgb)
    kinds = {"blue": (vivid >= 0.18) & hue.between(175, 230), "red": (vivid >= 0.16) & ((hue <= 24) | (hue >= 350)), "brown": (vivid >= 0.16) & (hue > 24) & (hue <= 58), "neutral": vivid < 0.18, "dark": (vivid < 0.2) & (light < 0.34)}
    seen = traced(pixels, plans).select("plan", "gy", "x0", "x1", vivid.alias("vivid"), *(v.alias(k) for k, v in kinds.items()), F.explode(F.sequence(*(F.floor(F.col(c) / BLOCK) for c in ("x0", "x1")))).alias("bx"))
    found = looked.withColumn("bx", F.floor(F.col("gx") / BLOCK)).join(seen.hint("merge"), ["plan", "gy", "bx"]).where("gx between x0 and x1")
    sample = found.groupBy("plan", "number", "steps", "i").agg(F.count("vivid").alias("n"), F.sum(F.coalesce("vivid", F.lit(0.0)).cast("decimal(28,9)")).alias("vivid"), *(F.count_if(F.col(k)).alias(k) for k in kinds))
    # only samples with traced pixels have a row: one begins a run where the sample before it has none
    before = F.lag("i").over(Window.partitionBy("plan", "number").orderBy("i"))
    sample = sample.where("n > 0").withColumn("begins", F.coalesce(F.col("i") - before > 1, F.lit(True)))
    total = sample.groupBy("plan", "number", "steps").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.sum("vivid").cast("double").alias("vivid"), F.count_if("begins").alias("runs"), *(F.sum(k).alias(k) for k in kinds))
    share = {f"{k}_share": F.col(k) / F.col("n") for k in kinds}
    return total.select("plan", "number", (F.col("rows") / (F.col("steps") + 1)).alias("coverage"), (F.col("n") / F.col("rows")).alias("thickness"), (F.col("vivid") / F.col("n")).alias("saturation"), *(v.alias(k) for k, v in share.items()), clamp((F.col("runs") - 1) / F.col("steps"), 0.0, 1.0).alias("gap_share"))


def materials(profiles: DataFrame, fallback: str = "drywall") -> DataFrame:
    """The material that a profile suggests, with its confidence (two digits), coverage and thickness."""
    c, t, s = F.col("coverage"), F.col("thickness"), F.col("saturation")
    colour = clamp(c + s * 0.55, 0.28, 0.95)
    base = clamp(F.lit(0.40) + c * 0.38, 0.32, 0.80)
    grey, dark = F.col("neutral_share") > 0.50, F.col("dark_share")
    says = lambda material, confidence: F.struct(F.lit(material).alias("material"), confidence.alias("confidence"))
    verdict = F.when(c < 0.12, says(fallback, F.lit(0.16)))
    for test, material, confidence in (
        ((F.col("blue_share") > 0.34) | ((s > 0.26) & (F.col("gap_share") > 0.42) & (t <= 3.2)), "glass", colour),
        (F.col("red_share") > 0.38, "brick", colour),
        (F.col("brown_share") > 0.34, "wood", colour),
        (grey & (t <= 2.5), "glass", clamp(base - 0.04, 0.28, 0.70)),
        (grey & (t <= 5) & (dark < 0.45), "drywall", base),
        (grey & (t <= 5), "brick", base),
        (grey & (t <= 10) & (dark < 0.55), "brick", base),
        (grey & (t <= 10), "concrete", base),
        (grey & (t <= 20), "concrete", clamp(base + 0.04, 0.36, 0.84)),
        (grey, "reinforced_concrete", clamp(base + 0.06, 0.38, 0.86)),
    ):
        verdict = verdict.when(test, says(material, confidence))
    verdict = verdict.otherwise(says(fallback, clamp(F.lit(0.3) + c * 0.44, 0.24, 0.82)))
    two = lambda v, digits: round_half_up(F.round(v, 9), digits)
    weak = c < 0.12  # these figures are not rounded
    return profiles.withColumn("v", verdict).select("plan", "number", "v.material", two(F.col("v.confidence"), 2).alias("confidence"), F.when(weak, c).otherwise(two(c, 2)).alias("coverage"), F.when(weak, t).otherwise(two(t, 1)).alias("thickness"))


def distinct_walls(walls: DataFrame) -> DataFrame:
    """Walls in order of their number without those whose centre is within 4 pixels of an accepted one of the same
    orientation, with a length less than 8 apart."""
    t = walls.withColumns({"_flat": (F.abs(F.col("y0") - F.col("y1")) < F.abs(F.col("x0") - F.col("x1"))).cast("int"), "_cx": (F.col("x0") + F.col("x1")) / 2, "_cy": (F.col("y0") + F.col("y1")) / 2, "_len": F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))})
    same = lambda a, b: (F.hypot(a("_cx") - b("_cx"), a("_cy") - b("_cy")) < 4) & (F.abs(a("_len") - b("_len")) < 8)
    kept = greedy(t, ["plan", "_flat"], {"_cx": 4.0, "_cy": 4.0, "_len": 8.0}, [F.col("number")], same)
    return kept.drop("_flat", "_cx", "_cy", "_len")


def detect_walls(pixels: DataFrame, plans: DataFrame, fallback: str = "drywall") -> DataFrame:
    """Walls (plan, wall_id, x0, y0, x1, y1, material, confidence, coverage, thickness) of every plan."""
    mask = cut(mask_words(pixels, plans), "mask")
    usable = coverage(mask, plans).where("usable").select("plan")
    candidates = cut(axis_candidates(mask.join(usable.hint("merge"), "plan", "left_semi"), plans), "candidates")
    segments = cut(merged_segments(candidates, plans), "segments")
    walls = cut(placed_walls(wall_graph(structural_segments(segments, plans), plans), plans), "walls")
    said = materials(trace_profiles(walls, pixels, plans), fallback)
    none = {"material": fallback, "confidence": 0.16, "coverage": 0.0, "thickness": 0.0}
    known = walls.join(said.hint("merge"), ["plan", "number"], "left").na.fill(none)
    return distinct_walls(known).select("plan", F.concat(F.lit("auto-wall-"), "number").alias("wall_id"), "x0", "y0", "x1", "y1", *none)


def wall_summary(walls: DataFrame, mask: DataFrame, plans: DataFrame) -> DataFrame:
    """Each plan's numbers of walls along and across, and the share of its image that is traced."""
    flat = F.abs(F.col("y0") - F.col("y1")) < F.abs(F.col("x0") - F.col("x1"))
    counted = walls.groupBy("plan").agg(F.count_if(flat).alias("horizontal"), F.count_if(~flat).alias("vertical"))
    return coverage(mask, plans).join(counted.hint("merge"), "plan", "left").na.fill(0, ["horizontal", "vertical"]).select("plan", "horizontal", "vertical", round_half_up(F.col("covered"), 3).alias("covered"), "usable")
