"""Labels and folded links across the borders of strips and shares, words of pixels, and the masks made of them."""

import random

import numpy as np
import pytest

from sigfield.operators import graph, raster, regions, walls


def flood(cells, diagonal):
    """Labels of connected cells of a set, one after another: the least (gy, gx) of each component."""
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    label = {}
    for c in sorted(cells):
        todo = [] if c in label else [c]
        while todo:
            at = todo.pop()
            if at in cells and at not in label:
                label[at] = c
                todo += [(at[0] + y, at[1] + x) for y, x in near]
    return label


@pytest.mark.parametrize("diagonal", [False, True])
def test_labels_across_strips(spark, monkeypatch, diagonal):
    monkeypatch.setattr(regions, "STRIP", 4)
    r = random.Random(5)
    cells = {p: {(y, x) for y in range(23) for x in range(90) if r.random() < 0.45} for p in (0, 1)}
    plans = spark.createDataFrame([(p, 90, 23) for p in cells], "plan long, width int, height int")
    pixels = spark.createDataFrame([(p, x, y) for p, c in cells.items() for y, x in c], "plan long, gx int, gy int")
    found = regions.cells(regions.labelled(regions.runs_of(pixels, ["plan"]), plans, diagonal)).collect()
    got = {(t.plan, t.gy, t.gx): t.label for t in found}
    assert got == {(p, y, x): least[0] * 90 + least[1] for p, c in cells.items() for (y, x), least in flood(c, diagonal).items()}


@pytest.mark.parametrize("share", [100_000, 7])
def test_components_in_shares(spark, monkeypatch, share):
    monkeypatch.setattr(graph, "SHARE", share)
    links = [("a", [0, k], [0, k + 1]) for k in range(1, 40) if k % 13] + [("b", [1, 5], [0, 9])]
    nodes = [("a", [0, k]) for k in range(1, 42)] + [("b", [1, 5]), ("b", [0, 9])]
    got = graph.components(spark.createDataFrame(nodes, "plan string, id array<bigint>"), spark.createDataFrame(links, "plan string, a array<bigint>, b array<bigint>"), ["plan"])
    want = {("a", k): (0, (k - 1) // 13 * 13 + 1) for k in range(1, 41)} | {("a", 41): (0, 41), ("b", 5): (0, 9), ("b", 9): (0, 9)}
    assert {(t.plan, t.id[1]): tuple(t.label) for t in got.collect()} == want


def test_components_need_few_jobs(spark, monkeypatch):
    """A chain is labelled without a round for each doubling of its length."""
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, name, f=graph.cut: written.append(name) or f(df, name))
    chain = spark.range(3000).selectExpr("0 plan", "id a", "id + 1 b")
    assert graph.components(spark.range(3001).selectExpr("0 plan", "id"), chain, ["plan"]).where("label <> 0").count() == 0
    assert len(written) == 1


def test_runs_of_words(spark):
    """Runs go on from one word to the next; repeated pixels count once."""
    pixels = spark.createDataFrame([(0, x, 3) for x in [*range(60, 131), 63, 64, 200]], "plan long, gx int, gy int")
    assert sorted((t.x0, t.x1) for t in regions.runs_of(pixels, ["plan"]).collect()) == [(60, 130), (200, 200)]
    assert raster.words(pixels, ["plan"]).count() == 4


def test_wide_masks_and_candidates(spark):
    """Neighbours and bands are found across words and strips, as in a plain reading of a wide image."""
    w, h, band, gap, least = 200, 150, 2, 4, 18
    image = np.zeros((h, w), bool)
    for y, x, n, m in ((62, 20, 4, 150), (63, 100, 80, 3), (10, 127, 120, 2), (149, 0, 1, 200), (5, 64, 1, 1), (90, 63, 1, 1), (91, 64, 1, 1)):
        image[y : y + n, x : x + m] = True
    plans = spark.createDataFrame([(7, w, h)], "plan long, width int, height int")
    pixels = spark.createDataFrame([(7, int(x), int(y), 0, 0, 0, 255) for y, x in zip(*np.nonzero(image))], "plan long, gx int, gy int, r int, g int, b int, a int")
    pixels = pixels.union(spark.createDataFrame([(7, 0, 0, 255, 255, 255, 255)], pixels.schema))
    padded = np.pad(image, 1)
    near = sum(padded[1 + y : 1 + y + h, 1 + x : 1 + x + w].astype(int) for y in (-1, 0, 1) for x in (-1, 0, 1)) > 1
    mask = walls.trace_mask(pixels, plans)
    dark = image & near
    assert {(t.gx, t.gy) for t in mask.collect()} == {(int(x), int(y)) for y, x in zip(*np.nonzero(dark))}
    want = set()
    for name, m in (("horizontal", dark), ("vertical", dark.T)):
        for c in range(m.shape[0]):
            c0, c1 = max(0, c - band), min(m.shape[0] - 1, c + band)
            n = m[c0 : c1 + 1].sum(axis=0)
            places = np.flatnonzero(n)
            for run in np.split(places, np.flatnonzero(np.diff(places) > gap + 1) + 1) if len(places) else []:
                end = m.shape[1] - 1 if m.shape[1] - 1 - run[-1] <= gap else run[-1]
                score = n[run].sum() / ((end - run[0] + 1) * (c1 - c0 + 1))
                if end - run[0] + 1 >= least and 0.06 <= score <= 0.92:
                    want.add((name, int(run[0]), int(end), c0, c1, round(float(score), 9)))
    got = {(t.orientation, t.start, t.end, t.cross_start, t.cross_end, round(t.score, 9)) for t in walls.axis_candidates(mask, plans).collect()}
    assert got == want and len(want) > 20
