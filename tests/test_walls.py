"""Wall detection against sequential readings of the rules, on random segments with ties, chains and crowded spots."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sigfield.operators import raster, walls
from sigfield.operators.graph import components, greedy

SEGMENT = "plan int, orientation string, start int, end int, cross_start int, cross_end int, score double"


def _fold(segments, wide, gap):
    """Groups of (start, end, c0, c1, score), in order of their beginnings."""
    out = []
    for s, e, c0, c1, score in segments:
        for g in out:
            if abs((g[2] + g[3]) / 2 - (c0 + c1) / 2) <= wide and min(g[1], e) - max(g[0], s) >= -gap:
                g[:] = min(g[0], s), max(g[1], e), min(g[2], c0), max(g[3], c1), max(g[4], score)
                break
        else:
            out.append([s, e, c0, c1, score])
    return out


def _shape(g, least=1):
    length, thick = g[1] - g[0] + 1, g[3] - g[2] + 1
    return length >= least and length / thick >= 4.8 and thick <= max(18, length * 0.2)


def _random_segments(seed, n, width=900, height=700):
    rng = random.Random(seed)
    rows = []
    for plan in range(3):
        for _ in range(n):
            flat = rng.random() < 0.5
            along, across = (width, height) if flat else (height, width)
            near = rng.choice([rng.randrange(across - 6), 40 + rng.randrange(30), 300 + 7 * rng.randrange(12)])
            start = rng.choice([rng.randrange(along - 80), 100 + 30 * rng.randrange(20) % (along - 200)])
            end = min(along - 1, start + rng.choice([25, 60, 61, 130, 400]))
            rows.append((plan, "horizontal" if flat else "vertical", start, end, near, near + rng.choice([4, 4, 4, 3]), rng.choice([0.2, 0.5, 0.7])))
    # one line, start and orientation name one candidate
    return list({(r[0], r[1], r[4] + r[5], r[2]): r for r in rows}.values())


def _plans(spark, width=900, height=700):
    return spark.createDataFrame([(k, width, height) for k in range(4)], "plan int, width int, height int")


def _merged(rows):
    out = {}
    for plan in range(3):
        found = []
        for o in ("horizontal", "vertical"):
            mine = sorted((r[2:] for r in rows if r[0] == plan and r[1] == o), key=lambda x: (x[2] + x[3], x[0]))
            first = [g for g in _fold(mine, 9, 5) if _shape(g)]
            order = sorted(first, key=lambda x: (x[2] + x[3], x[0]))  # stable: ties in order of beginnings
            found += [(o, *g) for g in _fold(order, 18, 5)]
        out[plan] = found
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_merging_is_the_sequential_pass(spark, seed):
    rows = _random_segments(seed, 150)
    got = walls.merged_segments(spark.createDataFrame(rows, SEGMENT).repartition(7), _plans(spark)).collect()
    want = sorted((p, *g) for p, groups in _merged(rows).items() for g in groups)
    assert sorted((r.plan, r.orientation, r.start, r.end, r.cross_start, r.cross_end, r.score) for r in got) == want
    for plan in range(3):  # ids keep the order of the pass
        ranked = [(r.orientation, r.start, r.end, r.cross_start) for r in sorted((r for r in got if r.plan == plan), key=lambda r: (r.orientation, r.rank))]
        assert ranked == [(o, g[0], g[1], g[2]) for o, *g in _merged(rows)[plan]]


def _meet(a, b, t):
    if a[0] == b[0]:
        return False
    h, v = (a, b) if a[0] == "horizontal" else (b, a)
    hy, vx = (h[3] + h[4]) / 2, (v[3] + v[4]) / 2
    return h[1] - t <= vx <= h[2] + t and v[1] - t <= hy <= v[2] + t


def _ends(a):
    c = (a[3] + a[4]) / 2
    return [(a[1], c), (a[2], c)] if a[0] == "horizontal" else [(c, a[1]), (c, a[2])]


def _touch(a, w, h):
    c = (a[3] + a[4]) / 2
    across, along = (h, w) if a[0] == "horizontal" else (w, h)
    return c <= 16 or c >= across - 16 or a[1] <= 16 or a[2] >= along - 16


def _structural(segments, w=900, h=700):
    out = []
    for k, a in enumerate(segments):
        others = [b for j, b in enumerate(segments) if j != k]
        length = a[2] - a[1] + 1
        j = sum(_meet(a, b, 12) for b in others)
        beside = 0
        for b in others:
            over = min(a[2], b[2]) - max(a[1], b[1]) + 1
            beside += a[0] == b[0] and abs((a[3] + a[4] - b[3] - b[4]) / 2) <= 16 and over > 0 and over / min(length, b[2] - b[1] + 1) > 0.54
        touch = _touch(a, w, h)
        wall = (touch and length >= 144) or (length >= 81 and j >= 1) or (length >= 32 * 2.1 and j >= 2)
        if _shape(a[1:], 32) and wall and not (beside >= 2 and length < 252 and not touch):
            out.append(a)
    return out


def _graph(segments, w=900, h=700):
    n = len(segments)
    label = list(range(n))
    near = lambda a, b: any(math.hypot(p[0] - q[0], p[1] - q[1]) <= 22.5 for p in _ends(a) for q in _ends(b))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if i != j and (_meet(segments[i], segments[j], 15) or near(segments[i], segments[j])):
                    label[i] = label[j] = min(label[i], label[j])
    parts = {}
    for i, x in enumerate(label):
        parts.setdefault(x, []).append(i)
    length = lambda i: segments[i][2] - segments[i][1] + 1
    kept, sums = [], []
    for x, members in sorted(parts.items()):
        total, touch = sum(map(length, members)), sum(_touch(segments[i], w, h) for i in members)
        j = sum(_meet(segments[i], b, 15) for i in members for k, b in enumerate(segments) if k != i)
        sums.append((-total, x))
        if (touch and total >= 252) if len(members) == 1 else total >= 234 and (touch or j >= 2):
            kept += members
    if not kept and sums and -min(sums)[0] >= 234:
        kept = parts[min(sums)[1]]
    return [segments[i] for i in kept]


@pytest.mark.parametrize(("seed", "n", "short"), [(3, 90, False), (4, 12, False), (5, 25, True)])
def test_structure_and_graph(spark, seed, n, short):
    rows = _random_segments(seed, n)
    if short:  # no plan reaches its frame: the longest component stands in
        rows = [r for r in rows if 60 < r[2] and r[3] < 600 and 60 < r[4] < 600 and r[3] - r[2] < 140]
    merged = cut_segments(spark, rows)
    got = walls.structural_segments(merged, _plans(spark))
    want = {p: _structural([tuple(g) for g in groups]) for p, groups in _merged(rows).items()}
    flat = lambda t: sorted((r.plan, r.orientation, r.start, r.end, r.cross_start, r.cross_end) for r in t.collect())
    assert flat(got) == sorted((p, *g[:5]) for p, groups in want.items() for g in groups)
    every = walls.structural_segments(merged, _plans(spark)) if not short else merged.withColumn("id", F.concat(F.array(F.when(F.col("orientation") == "horizontal", 0).otherwise(1).cast("long")), "rank"))
    source = want if not short else {p: [tuple(g) for g in groups] for p, groups in _merged(rows).items()}
    kept = {p: _graph(groups) for p, groups in source.items()}
    assert flat(walls.wall_graph(every, _plans(spark))) == sorted((p, *g[:5]) for p, groups in kept.items() for g in groups)


def cut_segments(spark, rows):
    from sigfield.runtime import cut

    return cut(walls.merged_segments(spark.createDataFrame(rows, SEGMENT), _plans(spark)), "test-segments")


def test_greedy_is_the_sequential_pass(spark):
    rng = random.Random(9)
    points = [(k % 2, round(rng.random() * 90, 1), round(rng.random() * 90, 1), rng.choice([1.0, 2.0, 3.0]), k) for k in range(300)]
    points += [(0, 50.0, 50.0, 2.0, 1000 + k) for k in range(80)] + [(1, 3.0 * k, 0.0, 4.0 - k / 100, 2000 + k) for k in range(20)]
    table = spark.createDataFrame(points, "layer int, x double, y double, score double, k int").repartition(5)
    got = greedy(table, ["layer"], {"x": 7.0, "y": 7.0}, [-F.col("score"), F.col("k")], lambda a, b: F.hypot(a("x") - b("x"), a("y") - b("y")) < 7)
    want = []
    for layer in (0, 1):
        kept = []
        for p in sorted((p for p in points if p[0] == layer), key=lambda p: (-p[3], p[4])):
            if all(math.hypot(p[1] - q[1], p[2] - q[2]) >= 7 for q in kept):
                kept.append(p)
        want += kept
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert greedy(table.where("false"), ["layer"], {"x": 7.0, "y": 7.0}, [F.col("k")], lambda a, b: F.lit(True)).count() == 0


def test_suppression_takes_the_best_and_orders_them(spark):
    rng = random.Random(4)
    points = sorted({(0, float(rng.randrange(60)), float(rng.randrange(60)), float(rng.randrange(5))) for _ in range(200)})
    got = raster.suppress(spark.createDataFrame(points, "layer int, x double, y double, score double"), "layer", 6.0, 12).collect()
    kept = []
    for p in sorted(points, key=lambda p: (-p[3], p[2], p[1])):
        if len(kept) < 12 and all(math.hypot(p[1] - q[1], p[2] - q[2]) >= 6 for q in kept):
            kept.append(p)
    assert sorted((r.layer, r.x, r.y, r.score) for r in got) == sorted(kept)
    assert [(r.x, r.y) for r in sorted(got, key=lambda r: r.place)] == [(p[1], p[2]) for p in sorted(kept, key=lambda p: (p[2], p[1]))]


def test_components(spark):
    links = [(0, k, k + 1) for k in range(0, 40) if k != 20] + [(1, 7, 3), (1, 9, 7)]
    nodes = [(0, k) for k in range(42)] + [(1, k) for k in (3, 5, 7, 9)]
    got = {(r.g, r.id): r.label for r in components(spark.createDataFrame(nodes, "g int, id int"), spark.createDataFrame(links, "g int, a int, b int"), ["g"]).collect()}
    assert got == {(g, k): (0 if k <= 20 else 21 if k <= 40 else 41) if g == 0 else 5 if k == 5 else 3 for g, k in nodes}


@pytest.mark.parametrize(("profile", "material", "confidence"), [
    # coverage, thickness, saturation, blue, red, brown, neutral, dark, gaps
    ((0.10, 9.0, 0.0, 0, 0, 0, 1, 1, 0), "drywall", 0.16), ((0.50, 4.0, 0.4, 0.35, 0.9, 0, 0, 0, 0), "glass", 0.72),
    ((0.50, 3.2, 0.3, 0, 0, 0, 0.2, 0, 0.5), "glass", 0.67), ((1.0, 4.0, 0.8, 0, 0.39, 0.5, 0, 0, 0), "brick", 0.95), ((0.2, 4.0, 0.1, 0, 0, 0.35, 0, 0, 0), "wood", 0.28),
    ((0.5, 2.5, 0.0, 0, 0, 0, 1, 0, 0), "glass", 0.55), ((0.5, 5.0, 0.0, 0, 0, 0, 1, 0.4, 0), "drywall", 0.59), ((0.5, 5.0, 0.0, 0, 0, 0, 1, 0.45, 0), "brick", 0.59),
    ((1.0, 9.0, 0.0, 0, 0, 0, 1, 0.5, 0), "brick", 0.78), ((1.0, 9.0, 0.0, 0, 0, 0, 1, 0.6, 0), "concrete", 0.78), ((1.0, 20.0, 0.0, 0, 0, 0, 1, 1, 0), "concrete", 0.82),
    ((1.0, 20.1, 0.0, 0, 0, 0, 1, 1, 0), "reinforced_concrete", 0.84), ((0.5, 9.0, 0.0, 0, 0, 0, 0.5, 0, 0), "drywall", 0.52),
])
def test_materials(spark, profile, material, confidence):
    names = ["coverage", "thickness", "saturation", "blue_share", "red_share", "brown_share", "neutral_share", "dark_share", "gap_share"]
    row = spark.createDataFrame([(1, 1, *map(float, profile))], "plan int, number int, " + ", ".join(f"{n} double" for n in names))
    got = walls.materials(row).first()
    assert (got.material, got.confidence) == (material, confidence)


def test_images_without_walls(spark):
    plans = _plans(spark, 60, 40)
    shape = "plan int, gx int, gy int, r int, g int, b int, a int"
    none = spark.createDataFrame([], shape)
    assert walls.detect_walls(none, plans).count() == 0
    full = spark.range(2400).selectExpr("1 plan", "cast(id%60 as int) gx", "cast(id div 60 as int) gy", "0 r", "0 g", "0 b", "255 a")
    dots = spark.createDataFrame([(0, 5, 5, 0, 0, 0, 255), (0, 9, 9, None, None, None, None), (2, 3, 3, 0, 0, 0, 10)], shape)
    mask = walls.trace_mask(full.union(dots), plans)
    assert {r.plan for r in mask.collect()} == {1}
    assert {r.plan: r.usable for r in walls.coverage(mask, plans).collect()} == {0: False, 1: False, 2: False, 3: False}
    assert walls.detect_walls(full.union(dots), plans).count() == 0
