"""Nearest sites against brute force, where many sites share their places."""

import math
import random

import pytest

from sigfield.operators import spatial


@pytest.mark.parametrize("block", [1000, 1])
def test_shared_places(spark, monkeypatch, block):
    """Places, not sites, are sent to squares, and targets are not written before they are looked up; with crowded squares too the
    first of the nearest ones is found."""
    seen = {}
    monkeypatch.setattr(spatial, "cut", lambda df, name, f=spatial.cut: seen.setdefault(name, []).append(f(df, name)) or seen[name][-1])
    monkeypatch.setattr(spatial, "BLOCK", block)
    rng = random.Random(3)
    places = [(p, float(rng.randrange(90)), float(rng.randrange(60))) for p in (1, 2) for _ in range(7)]
    sites = [(p, 1000 - k, x, y) for k, (p, x, y) in enumerate(places * 60)] + [(1, 5000, float("nan"), 1.0), (2, 5001, None, 1.0)]
    targets = [(p, k, rng.uniform(-40, 130), rng.uniform(-40, 100)) for k in range(300) for p in (1, 2, 3)] + [(1, 300, None, 2.0), (2, 301, float("nan"), 2.0)]
    t = spark.createDataFrame(targets, "plan int, k int, tx double, ty double")
    found = spatial.nearest_site(t, spark.createDataFrame(sites, "plan int, site_id int, x double, y double"), "site_id", ["plan"])
    got = {(r.plan, r.k): (r.site and r.site.site_id, r.d) for r in found.collect()}
    assert len(got) == len(targets)
    for p, k, x, y in targets:
        known = [(math.hypot(sx - x, sy - y), s) for q, s, sx, sy in sites if q == p and sx is not None and sx == sx] if x is not None and x == x else []
        d, s = min(known, default=(None, None))
        assert got[p, k][0] == s and (d is None) == (got[p, k][1] is None) and (d is None or math.isclose(d, got[p, k][1], abs_tol=1e-9))
    assert seen["sites"][0].count() == len(set(places))
    assert ("targets" in seen) == (block == 1)
