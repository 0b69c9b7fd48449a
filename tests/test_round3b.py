"""Queries and operators whose tasks held too much, or whose rows differed from their SQL on larger tables."""

import random

from pyspark.sql import functions as F

from sigfield import catalog
from sigfield.operators import masks
from sigfield.plans import layers


def test_median_filter(spark):
    """Across borders of tiles, with missing cells, against a plain reading; no task sees more than a tile and what is around it."""
    rng = random.Random(2)
    width, height, radius = 70, 131, 2
    cells = {(x, y): rng.randrange(50) for x in range(width) for y in range(height) if rng.random() < 0.9 and not (20 <= x < 30 and y < 9)}
    t = spark.createDataFrame([(x, y, v) for (x, y), v in cells.items()], "gx int, gy int, v int")
    out = masks.median_filter(t, width, height, radius, "v")
    assert out.schema["v"].dataType.simpleString() == "int"
    assert "Window" not in out._jdf.queryExecution().toString()
    want = set()
    for x in range(width):
        for y in range(height):
            near = [cells.get((min(max(x + i, 0), width - 1), min(max(y + j, 0), height - 1))) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
            known = sorted(v for v in near if v is not None)
            if len(known) > 12:
                want.add((x, y, known[12]))
    assert set(map(tuple, out.collect())) == want


def test_texts_are_searched_on_all_cores(spark, sf):
    tasks = catalog.QUERIES["text_measurements"](spark, sf).groupBy(F.spark_partition_id()).count()
    assert tasks.count() > 1


def test_layer_results_of_blocked_plans(spark, sf, monkeypatch):
    """As its SQL, the query has no row for a band all of whose cells are blocked; the operator has one."""
    rows = spark.createDataFrame([("24ghz", 0), ("5ghz", 2)], "band string, n_rooms long")
    monkeypatch.setattr(layers.layer, "heatmap_layer", lambda *a: None)
    monkeypatch.setattr(layers.layer, "results", lambda *a: rows)
    assert [r.band for r in layers.layer_results(spark, sf).collect()] == ["5ghz"]
