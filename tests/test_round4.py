"""Walls from runs and words: as from pixels, and nothing that grows with the images is sent to the driver."""

import random

import pytest
from pyspark.sql import functions as F

from sigfield.operators import raster, walls
from sigfield.plans import drawings
from sigfield.plans import views as V
from sigfield.runtime import cut


def _same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_walls_take_runs(spark, sf):
    """Each step gives the same for runs and words as for pixels."""
    runs, pixels, plans = V.drawing_runs(spark, sf), V.drawings(spark, sf), cut(V.drawn_plans(spark, sf), "plans")
    mask, words = walls.trace_mask(pixels, plans), cut(walls.mask_words(runs, plans), "mask")
    assert _same(walls.trace_mask(runs, plans), mask)
    assert _same(walls.coverage(words, plans), walls.coverage(mask, plans))
    assert _same(walls.axis_candidates(words, plans), walls.axis_candidates(mask, plans))


def test_scaled_runs(spark):
    """Where an image is scaled down, a run's cells are those of its pixels."""
    rng = random.Random(8)
    runs = [(0, y, x, x + rng.randrange(9), 0, 0, 0, 255) for y in range(0, 60) for x in range(rng.randrange(9), 2490, 300 + rng.randrange(9))]
    t = spark.createDataFrame([(0, 70, 0, 3, 255, 255, 255, 255), *runs], "plan int, gy int, x0 int, x1 int, r int, g int, b int, a int")
    plans = spark.createDataFrame([(0, 2500, 80)], "plan int, width int, height int")
    pixels = t.select("plan", F.explode(F.sequence("x0", "x1")).alias("gx"), "gy", "r", "g", "b", "a")
    assert walls.settings(plans).first().scale == 2
    assert _same(walls.trace_mask(t, plans), walls.trace_mask(pixels, plans))


def test_words_of_runs(spark):
    """Runs that end at, go over and fill words, as bit by bit."""
    runs = [(0, 0, 0, 63), (0, 1, 63, 64), (0, 2, 5, 200), (0, 3, 7, 7), (0, 3, 6, 9), (0, 4, 64, 127)]
    t = spark.createDataFrame(runs, "plan int, gy int, x0 int, x1 int")
    cells = t.select("plan", F.explode(F.sequence("x0", "x1")).alias("gx"), "gy")
    assert _same(raster.words(t, ["plan"]), raster.words(cells, ["plan"]))


@pytest.mark.parametrize("name", ["wall_trace_mask", "wall_candidates", "detected_walls"])
def test_images_are_not_broadcast(spark, sf, monkeypatch, name):
    """No step joins by sending rows to the driver, although the files are small."""
    plans = []
    keep = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, name)
    for module in (drawings, walls, walls.greedy.__globals__):
        monkeypatch.setitem(module if isinstance(module, dict) else vars(module), "cut", keep)
    keep(getattr(drawings, name)(spark, sf), "out")
    assert len(plans) > 2 and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("tile", [(64, 256), (8, 16)])
def test_median_runs(spark, monkeypatch, tile):
    """Medians of runs as those of every pixel's window, with borders that repeat, gaps, and tiles that runs go through."""
    import numpy as np

    from sigfield.operators import regions

    monkeypatch.setattr(regions, "TILE", tile[0])
    monkeypatch.setattr(regions, "WIDE", tile[1])
    rng = random.Random(11)
    sizes, rows, images = {0: (70, 30), 1: (9, 67), 2: (1, 3)}, [], {}
    for plan, (w, h) in sizes.items():
        images[plan] = image = np.zeros((h, w, 4), int)
        for y in range(h):
            x = 0
            while x < w:
                n = min(rng.choice([1, 2, 25]), w - x)
                c = rng.choice([(10, 200, 30, 255), (90, 20, 250, 255), (90, 90, 90, 255), (5, 5, 5, 10), None])
                if c:
                    rows.append((plan, y, x, x + n - 1, *c))
                    image[y, x : x + n] = c
                x += n
    runs = spark.createDataFrame(rows, "plan int, gy int, x0 int, x1 int, r int, g int, b int, a int")
    plans = spark.createDataFrame([(p, w, h) for p, (w, h) in sizes.items()], "plan int, width int, height int")
    want = set()
    for plan, image in images.items():
        padded = np.pad(image[..., :3], ((2, 2), (2, 2), (0, 0)), mode="edge")
        for y, x in zip(*np.nonzero(image[..., 3] > 24)):
            want.add((plan, int(x), int(y), *(int(sorted(padded[y : y + 5, x : x + 5, c].ravel())[12]) for c in range(3))))
    found = list(map(tuple, regions.median_colors(runs, plans).collect()))
    assert set(found) == want and len(found) == len(want)
    assert regions.median_runs(runs, plans).count() < len(want)
