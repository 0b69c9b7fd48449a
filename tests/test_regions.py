"""Run algebra and regions of images against flood fills on arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigfield.operators import masks, regions

PIXEL = "plan int, gx int, gy int, r int, g int, b int, a int"


def _runs(spark, arrays):
    """Runs and plans of boolean arrays by plan."""
    rows = [(k, int(x), int(y)) for k, a in arrays.items() for y, x in zip(*np.nonzero(a))]
    cells = spark.createDataFrame(rows, "plan int, gx int, gy int").repartition(5)
    plans = spark.createDataFrame([(k, a.shape[1], a.shape[0]) for k, a in arrays.items()], "plan int, width int, height int")
    return regions.runs_of(cells, ["plan"]), plans


def _array(runs, arrays, value=None):
    out = {k: np.zeros(a.shape, int) for k, a in arrays.items()}
    for r in runs.collect():
        assert (out[r.plan][r.gy, r.x0 : r.x1 + 1] == 0).all()
        out[r.plan][r.gy, r.x0 : r.x1 + 1] = r[value] + 1 if value else 1
    return out


def _flood(a, diagonal=False):
    """Labels from 1 (0 outside), the first pixel's number plus one."""
    h, w = a.shape
    label = np.zeros(a.shape, int)
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    for y in range(h):
        for x in range(w):
            if a[y, x] and not label[y, x]:
                stack = [(y, x)]
                label[y, x] = y * w + x + 1
                while stack:
                    p, q = stack.pop()
                    for dy, dx in steps:
                        v, u = p + dy, q + dx
                        if 0 <= v < h and 0 <= u < w and a[v, u] == a[y, x] and not label[v, u]:
                            label[v, u] = y * w + x + 1
                            stack.append((v, u))
    return label


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(5)
    # wide enough for several blocks of a line
    return {1: rng.random((20, 150)) < 0.55, 2: rng.random((30, 25)) < 0.4, 3: np.ones((7, 200), bool), 4: np.eye(40, dtype=bool)}


@pytest.mark.parametrize("diagonal", [False, True])
def test_labels(spark, noise, diagonal):
    runs, plans = _runs(spark, noise)
    got = _array(regions.labelled(runs, plans, diagonal), noise, "label")
    for k, a in noise.items():
        assert (got[k] == _flood(a, diagonal)).all()


def test_dilation_complement_and_intersection(spark, noise):
    runs, plans = _runs(spark, noise)
    sparse = {k: a & (np.add.outer(np.arange(a.shape[0]), np.arange(a.shape[1])) % 9 == 0) for k, a in noise.items()}
    thin, _ = _runs(spark, sparse)
    grown = _array(regions.dilated(thin, plans, F.lit(3)), noise)
    inverse = _array(regions.complement(runs, plans), noise)
    both = _array(regions.common(regions.dilated(thin, plans, F.lit(2)), regions.complement(runs, plans)), noise)

    def disk(a, r):
        out = np.zeros(a.shape, bool)
        for y, x in zip(*np.nonzero(a)):
            for dy in range(-r, r + 1):
                for dx in range(-r, r + 1):
                    if dx * dx + dy * dy <= r * r and 0 <= y + dy < a.shape[0] and 0 <= x + dx < a.shape[1]:
                        out[y + dy, x + dx] = True
        return out

    for k, a in noise.items():
        assert (inverse[k].astype(bool) == ~a).all()
        assert (grown[k].astype(bool) == disk(sparse[k], 3)).all()
        assert (both[k].astype(bool) == (disk(sparse[k], 2) & ~a)).all()


def _ring(h, w, boxes, gaps=()):
    a = np.zeros((h, w), bool)
    for x0, y0, x1, y1 in boxes:
        a[y0, x0 : x1 + 1] = a[y1, x0 : x1 + 1] = True
        a[y0 : y1 + 1, x0] = a[y0 : y1 + 1, x1] = True
    for y, x in gaps:
        a[y, x] = False
    return a


def test_enclosed_areas(spark):
    nested = _ring(60, 80, [(5, 5, 60, 50), (15, 15, 40, 40), (20, 20, 30, 30)])
    cases = {
        1: nested,  # rings within a ring are inside with all they hold
        2: _ring(60, 80, [(5, 5, 60, 50), (15, 15, 40, 40)], gaps=[(5, 30)]),  # the outer one is open: only the inner one shuts off
        3: _ring(60, 80, [(1, 1, 78, 58)]),  # nearly the whole plan
        4: _ring(60, 80, [(5, 5, 12, 12)]),  # too small
        5: _ring(60, 80, [(0, 0, 40, 40)]),  # along the border
        6: np.zeros((60, 80), bool),
    }
    runs, plans = _runs(spark, cases)
    got = _array(regions.enclosed(runs, plans), cases)
    want = {}
    for k, a in cases.items():
        free = _flood(~a)
        edge = set(free[0]) | set(free[-1]) | set(free[:, 0]) | set(free[:, -1])
        inner = ~np.isin(free, list(edge - {0}))
        label = _flood(inner)
        keep = np.zeros(a.shape, bool)
        for v in set(label.ravel()) - {0}:
            if (label == v).sum() >= 160:
                keep |= label == v
        want[k] = keep if 0.035 <= keep.mean() <= 0.86 else np.zeros(a.shape, bool)
        assert (got[k].astype(bool) == want[k]).all(), k
    assert [k for k, a in want.items() if a.any()] == [1, 2, 5]


def _image(spark, arrays):
    rows = [(k, x, y, *map(int, a[y, x])) for k, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1]) if a[y, x, 3]]
    return spark.createDataFrame(rows, PIXEL).repartition(4), spark.createDataFrame([(k, a.shape[1], a.shape[0]) for k, a in arrays.items()], "plan int, width int, height int")


def test_median_colors(spark):
    rng = np.random.default_rng(2)
    arrays = {1: rng.integers(0, 256, (70, 131, 4)).astype(np.uint8), 2: rng.integers(0, 256, (3, 2, 4)).astype(np.uint8)}
    arrays[1][::3, ::5] = 0  # transparent
    pixels, plans = _image(spark, arrays)
    got = {(r.plan, r.gx, r.gy): (r.r, r.g, r.b) for r in regions.median_colors(pixels, plans).collect()}
    want = {}
    for k, a in arrays.items():
        h, w = a.shape[:2]
        for y in range(h):
            for x in range(w):
                if a[y, x, 3] > 24:
                    near = [a[min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)] * int(a[min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1), 3] > 0) for dy in range(-2, 3) for dx in range(-2, 3)]
                    want[k, x, y] = tuple(sorted(int(p[c]) for p in near)[12] for c in range(3))
    assert got == want


def test_color_regions_and_pockets(spark):
    a = np.full((60, 80, 4), 255, np.uint8)
    a[5:35, 5:35, :3] = (220, 200, 120)
    a[5:35, 35:65, :3] = (120, 200, 220)
    a[15:22, 10:20, :3] = 250  # a pocket within one room
    a[15:22, 30:40, :3] = 250  # one that touches two rooms
    a[40:55, 20:60, :3] = (200, 120, 200)
    a[50:55, 30:40, :3] = 250  # open to the outside
    a[2:4, 70:78, :3] = (220, 200, 120)  # too small
    pixels, plans = _image(spark, {1: a, 2: np.full((10, 10, 4), 255, np.uint8)})
    nobody = spark.createDataFrame([], "plan int, gy int, x0 int, x1 int")
    found = regions.color_regions(pixels, plans, nobody)
    got = _array(found, {1: a[:, :, 0], 2: np.zeros((10, 10))}, "region")
    assert not got[2].any() and set(got[1].ravel()) == {0, 2, 3, 4}
    assert got[1][18, 14] == 2 and got[1][18, 35] == 0 and got[1][18, 32] == 0 and got[1][53, 35] == 0 and got[1][45, 30] == 4 and got[1][3, 74] == 0
    # a house that leaves a pocket's wall out: what touches its outside is no pocket
    house = np.ones((60, 80), bool)
    house[16, 14] = False
    runs, _ = _runs(spark, {1: house})
    assert _array(regions.color_regions(pixels, plans, runs), {1: a[:, :, 0], 2: np.zeros((10, 10))}, "region")[1][18, 14] == 0
    points = spark.createDataFrame([(1, 10, 10), (1, 38, 18), (1, 79, 59)], "plan int, gx int, gy int")
    rooms = _array(masks.measured_rooms(found, points, plans.where("plan = 1")), {1: a[:, :, 0]})[1]
    assert rooms[10, 10] and rooms[10, 50] == 1 and rooms[45, 30] == 0 and rooms[59, 79]  # the second room lies within 3 pixels of a point in none


def test_markers(spark):
    a = np.full((120, 160, 4), 255, np.uint8)

    def mark(x, y, w, h, colour=(220, 30, 40)):
        a[y : y + h, x : x + w, :3] = colour

    mark(20, 20, 9, 9)
    mark(28, 30, 8, 8)  # joined to the first by a corner of the thickened marks
    mark(100, 20, 8, 8)
    mark(112, 30, 7, 7)  # too near to the larger one
    mark(20, 90, 60, 3)  # a line
    mark(120, 80, 3, 3)  # too small
    mark(60, 60, 20, 8)  # too wide for its height
    mark(130, 100, 9, 9, (200, 190, 40))  # not red
    pixels, plans = _image(spark, {1: a, 2: np.full((20, 20, 4), 255, np.uint8)})
    got = regions.red_markers(pixels, plans).orderBy("point_id").collect()
    assert [(r.plan, r.point_id, round(r.x, 2), round(r.y, 2)) for r in got] == [(1, "P1", 103.5, 23.5), (1, "P2", 27.31, 28.19)]


def test_house_falls_back_to_the_footprint(spark):
    a = np.full((120, 160, 4), 255, np.uint8)
    for x0, y0, x1, y1 in ((2, 2, 157, 4), (2, 115, 157, 117), (2, 2, 4, 117), (155, 2, 157, 117)):
        a[y0 : y1 + 1, x0 : x1 + 1, :3] = 20
    b = np.full((120, 160, 4), 255, np.uint8)
    b[30:33, 20:100, :3] = b[30:90, 20:23, :3] = b[87:90, 20:100, :3] = b[30:90, 97:100, :3] = 20
    b[5:7, 120:132, :3] = 20
    pixels, plans = _image(spark, {1: a, 2: b, 3: np.full((50, 50, 4), 255, np.uint8)})
    house = {k: v.astype(bool) for k, v in _array(regions.house_masks(pixels, plans), {1: a[:, :, 0], 2: b[:, :, 0], 3: np.zeros((50, 50))}).items()}
    assert house[1].sum() > 0.9 * 120 * 160 and house[1][60, 80]  # too large to be shut off: the spans of its outline
    assert house[2][60, 60] and not house[2][6, 130] and house[2].sum() == (90 - 30 + 4) * (100 - 20 + 4) - 4 * 3
    assert not house[3].any()
    none = regions.obstacle_masks(pixels.where("plan = 3"), plans, regions.house_masks(pixels, plans))
    assert none.count() == 0


def test_hull_and_mask(spark):
    from sigfield.operators import raster

    rng = np.random.default_rng(8)
    points = [(g, float(x), float(y)) for g in (1, 2) for x, y in rng.integers(10, 50, (200, 2))] + [(3, 1.0, 1.0), (3, 5.0, 5.0), (4, 0.0, 0.0), (4, 4.0, 0.0), (4, 8.0, 0.0), (4, 0.0, 9.0), (4, 1.0, 2.0)]
    hull = raster.convex_hull(spark.createDataFrame(points, "g int, x double, y double").repartition(4), "g")
    got = {}
    for r in hull.orderBy("g", "i").collect():
        got.setdefault(r.g, []).append((r.x, r.y))
    assert got[4] == [(0.0, 0.0), (8.0, 0.0), (0.0, 9.0)] and got[3] == [(1.0, 1.0), (5.0, 5.0)]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for g in (1, 2):
        ring = got[g]
        assert ring[0] == min(ring) and all(turn(ring[i - 2], ring[i - 1], ring[i]) > 0 for i in range(len(ring)))
        assert all(turn(ring[i - 1], ring[i], (x, y)) >= 0 for i in range(len(ring)) for k, x, y in points if k == g)
    mask = {}
    for r in raster.hull_mask(hull, "g", 60, 40, 3.0).collect():
        mask.setdefault(r.g, {})[r.gy] = (r.x0, r.x1)
    assert set(mask) == {1, 2, 4} and max(mask[1]) == 39
    for g in (1, 2, 4):
        ring = got[g]
        cx, cy = sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring)
        wide = [(cx + (x - cx) * f, cy + (y - cy) * f) for x, y in ring for f in [1 + 3 / np.hypot(x - cx, y - cy)]]
        for y in range(40):
            xs = [a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(wide, wide[1:] + wide[:1]) if (a[1] <= y < b[1]) or (b[1] <= y < a[1])]
            want = (max(0, int(np.floor(min(xs)))), min(59, int(np.ceil(max(xs))))) if xs else None
            assert mask[g].get(y) == want
