"""Images as runs: the same results as pixel by pixel, and no row for each pixel."""

import random

import duckdb
from pyspark.sql import functions as F

from sigfield.operators import regions, walls
from sigfield.plans import views as V


def test_painted_runs(spark, sf):
    """Runs of a painting are the SQL's pixels, strokes that begin left of the image included; they are far fewer."""
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from '{sf}/part.parquet'")
    for name, runs in (("paintings", V.painting_runs), ("drawings", V.drawing_runs)):
        want = duck.execute(f"WITH {V.SQL[name]} SELECT plan, gx, gy, r, g, b, a FROM {name} ORDER BY plan, gy, gx").fetchall()
        found = V._pixels_of(runs(spark, sf)).orderBy("plan", "gy", "gx").collect()
        assert [tuple(t) for t in found] == want
        assert runs(spark, sf).count() * 3 < len(want)


def _same(runs, pixels):
    return sorted(map(tuple, runs.collect())) == sorted(map(tuple, pixels.collect()))


def test_operators_take_runs(spark, sf):
    runs, plans = V.painting_runs(spark, sf), V.painted_plans(spark, sf)
    pixels = V.paintings(spark, sf)
    assert _same(walls.backgrounds(runs, plans), walls.backgrounds(pixels, plans))
    assert _same(regions.red_markers(runs, plans), regions.red_markers(pixels, plans))
    drawn = lambda t: regions.runs_of(regions._colored(t, plans).where("far > 42 * 42"), ["plan"])
    assert _same(drawn(runs), drawn(pixels))


def test_runs_of_columns(spark):
    """Columns that overlap, meet at a corner, lie apart, or hold one another."""
    rng = random.Random(5)
    columns = [(p, x, lo, lo + rng.randrange(6)) for p in range(3) for x in range(40) if rng.random() < 0.8 for lo in [rng.randrange(9)]]
    found = regions._across(spark.createDataFrame(columns, "plan int, gx int, lo int, hi int")).collect()
    cells = [(t.plan, x, t.gy) for t in found for x in range(t.x0, t.x1 + 1)]
    assert len(cells) == len(set(cells)) and set(cells) == {(p, x, y) for p, x, lo, hi in columns for y in range(lo, hi + 1)}
    assert all((t.plan, t.x1 + 1, t.gy) not in set(cells) for t in found)


def test_small_steps_keep_their_tasks(spark):
    """Few bytes that become many rows are not joined to one task."""
    t = spark.createDataFrame([(k, y, 0, 3) for k in range(40) for y in range(3)], "plan int, gy int, x0 int, x1 int")
    assert regions.joined(t, ["plan"]).select(F.spark_partition_id()).distinct().count() > 1
