"""Cropping against a plain scan of each image."""

import math
import random

import numpy as np
import pytest

from sigfield.operators import crop


def _round(v):
    return math.floor(v + 0.5)


def _cluster(dark, left, top, right, bottom):
    w, h = right - left, bottom - top
    if w < 60 or h < 60:
        return None
    size = max(3, _round(max(w, h) / 300))
    step = max(1, _round(size / 4))
    dense = set()
    gw, gh = math.ceil(w / size), math.ceil(h / size)
    for gy in range(gh):
        for gx in range(gw):
            ys = range(top + gy * size, min(bottom, top + (gy + 1) * size), step)
            xs = range(left + gx * size, min(right, left + (gx + 1) * size), step)
            if sum(dark[y, x] for y in ys for x in xs) / (len(ys) * len(xs)) >= 0.035:
                dense.add((gy, gx))
    best = None
    for start in sorted(dense):
        if start not in dense:
            continue
        part, stack = set(), [start]
        dense.discard(start)
        while stack:
            y, x = stack.pop()
            part.add((y, x))
            for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if q in dense:
                    dense.discard(q)
                    stack.append(q)
        if best is None or len(part) > len(best):
            best = part
    if best is None or len(best) < 4:
        return None
    x0, y0 = left + min(x for _, x in best) * size, top + min(y for y, _ in best) * size
    x1, y1 = min(right, left + (max(x for _, x in best) + 1) * size), min(bottom, top + (max(y for y, _ in best) + 1) * size)
    if (x1 - x0) * (y1 - y0) >= w * h * 0.92:
        return None
    row = lambda y: dark[y, x0 : x1 : max(1, _round((x1 - x0) / 500))].any()
    column = lambda x: dark[y0 : y1 : max(1, _round((y1 - y0) / 500)), x].any()
    while y0 < y1 and not row(y0):
        y0 += 1
    while y1 > y0 and not row(y1):
        y1 -= 1
    while x0 < x1 and not column(x0):
        x0 += 1
    while x1 > x0 and not column(x1):
        x1 -= 1
    return None if x1 - x0 < 40 or y1 - y0 < 40 else (x0, y0, x1, y1)


def _crop(dark):
    h, w = dark.shape
    row = lambda y, a, b: dark[y, a : b : max(1, _round((b - a) / 600))].mean() if b > a else 0
    column = lambda x, a, b: dark[a : b : max(1, _round((b - a) / 600)), x].mean() if b > a else 0
    whole = (0, 0, w - 1, h - 1, False)
    top, bottom, left, right = 0, h - 1, 0, w - 1
    while top < bottom and row(top, 0, w) < 0.003:
        top += 1
    while bottom > top and row(bottom, 0, w) < 0.003:
        bottom -= 1
    while left < right and column(left, 0, h) < 0.003:
        left += 1
    while right > left and column(right, 0, h) < 0.003:
        right -= 1
    if bottom - top < 20 or right - left < 20:
        return whole
    left, top, right, bottom = _cluster(dark, left, top, right, bottom) or (left, top, right, bottom)
    ch, cw = bottom - top, right - left
    mh, mw = _round(ch * 0.25), _round(cw * 0.25)
    first = lambda seq, test, other: next((v for v in seq if test(v) >= 0.05), other)
    y1 = first(range(bottom, max(top + _round(ch * 0.5), bottom - mh) - 1, -1), lambda y: row(y, left, right), bottom)
    y0 = first(range(top, min(bottom - _round(ch * 0.5), top + mh) + 1), lambda y: row(y, left, right), top)
    x1 = first(range(right, max(left + _round(cw * 0.5), right - mw) - 1, -1), lambda x: column(x, y0, y1), right)
    x0 = first(range(left, min(right - _round(cw * 0.5), left + mw) + 1), lambda x: column(x, y0, y1), left)
    ow, oh = x1 - x0 + 1, y1 - y0 + 1
    return whole if ow < 80 or oh < 80 or (ow >= w * 0.99 and oh >= h * 0.99) else (x0, y0, x1, y1, True)


def _page(seed):
    rng = random.Random(seed)
    w, h = rng.choice([(400, 300), (260, 420), (1300, 200)])
    dark = np.zeros((h, w), bool)
    if seed % 7 == 6:
        return dark
    x, y, dw, dh = rng.randrange(10, 60), rng.randrange(5, 40), w // 2, h // 2
    dark[y : y + dh, x : x + dw] = np.random.default_rng(seed).random((dh, dw)) < 0.15
    dark[y : y + 3, x : x + dw] = dark[y + dh - 3 : y + dh, x : x + dw] = True
    if seed % 2:  # a legend apart from the drawing
        dark[h - 30 : h - 10, w - 70 : w - 5] = True
    if seed % 3 == 0:  # sparse text above it
        dark[max(0, y - 4), x : x + dw : 40] = True
    if seed % 5 == 4:
        dark[:] = True
    return dark


def test_crops(spark):
    pages = {k: _page(k) for k in range(14)}
    rows = [(k, int(x), int(y), *((10, 10, 10) if (x + y) % 2 else (250, 200, 250))) for k, p in pages.items() for y, x in zip(*np.nonzero(p))]
    rows += [(0, 3, 3, 250, 250, 250), rows[0]]  # light pixels don't count, repeated ones once
    plans = spark.createDataFrame([(k, p.shape[1], p.shape[0]) for k, p in pages.items()], "plan int, width int, height int")
    got = crop.crops(spark.createDataFrame(rows, "plan int, gx int, gy int, r int, g int, b int").repartition(6), plans).collect()
    assert {r.plan: (r.left, r.top, r.right, r.bottom, r.cropped) for r in got} == {k: _crop(p) for k, p in pages.items()}
    assert 3 < sum(r.cropped for r in got) < len(got)


@pytest.mark.parametrize(("row", "want"), [((1000, 500, 20.0, 10.0), (1000, 500, 0, 0, False)), ((1000, 500, 20.0, 12.0), (1000, 600, 0, 50, True)), ((1000, 500, 21.0, 10.0), (1050, 500, 25, 0, True)), ((1000, 500, None, 10.0), (1000, 500, 0, 0, False)), ((1000, 500, 20.0, 0.0), (1000, 500, 0, 0, False)), ((1000, 500, 20.3, 10.0), (1000, 500, 0, 0, False))])
def test_aspect(spark, row, want):
    r = crop.corrected_sizes(spark.createDataFrame([row], "width int, height int, width_m double, height_m double")).first()
    assert (r.out_w, r.out_h, r.offset_x, r.offset_y, r.applied) == want
