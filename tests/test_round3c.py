"""Steps that made a row of each pixel, or held several copies of what they read, or worked out a cell's number again for every use."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from sigfield.functions import scalars
from sigfield.llm.search import Shard
from sigfield.operators import crop, ingest
from tests.test_crop import _crop, _page


def test_crops_of_runs(spark):
    """Runs of equal pixels give the crops of their pixels, repeated and touching ones too; pages without rows stay whole."""
    pages = {k: _page(k) for k in range(14)}
    rows = []
    for k, p in pages.items():
        for y, line in enumerate(p):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(int), [0]])))
            for a, z in zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()):
                middle = (a + z) // 2
                rows += [(k, y, a, middle, 10, 10, 10), (k, y, middle + 1, z, 250, 200, 250)][: 1 + (middle < z)]
    rows += [(0, 3, 3, 90, 250, 250, 250), rows[0]]
    plans = spark.createDataFrame([(k, p.shape[1], p.shape[0]) for k, p in pages.items()], "plan int, width int, height int")
    runs = spark.createDataFrame(rows, "plan int, gy int, x0 int, x1 int, r int, g int, b int").repartition(6)
    got = {r.plan: (r.left, r.top, r.right, r.bottom, r.cropped) for r in crop.crops(runs, plans).collect()}
    assert got == {k: _crop(p) for k, p in pages.items()}


def test_shard_memory():
    """An index is made in little more memory than it takes."""
    rng = np.random.default_rng(1)
    n, each = 20_000, 100
    terms = list(np.sort(rng.integers(0, 1 << 40, (n, each)) // (1 << 20), axis=1))
    counts = list(np.ones((n, each), np.int32))
    tracemalloc.start()
    shard = Shard(terms, counts, np.full(n, each), each, 1.2, 0.75)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(shard.term) == n * each and not terms and not counts
    assert peak < 60 * n * each  # 75 with copies


def test_survey_cells_are_read_once(spark):
    """What the transmitters' election and the merge filter upon is not worked out of the texts again."""
    names = ["row_idx", "x", "y", "sinal", "ch", "mac", "ssid"]
    rows = [(1, "1.234,5", "2", "-40 dBm", "6", "aa", "n"), (2, "1,234.5", "2", "-30", "6", "bb", ""), (3, "3", None, "-50", "36", "cc", "home_5g"), (4, "", "2", "x", None, None, None)]
    out = ingest.parse_rows(spark.createDataFrame(rows, names).repartition(2))
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.row_idx: (r.point_id, r.x, r.y, r.rssi_24ghz, r.rssi_5ghz) for r in out.collect()}
    assert got == {1: ("P1", 1234.5, 2.0, -40.0, None), 3: ("P3", 3.0, None, None, -50.0), 4: ("P4", None, 2.0, None, None)}


def test_parse_numbers(spark):
    texts = ["1.234,5", "1,234.5", "-3", "+4,5", "", "abc", None, "1,2,3", "1.2.3", "1,2,3.4", "12 dBm", "-", "1.2,3,4", "5.", ",5"]
    t = spark.createDataFrame([(texts,)], "t array<string>")
    many = t.select(F.explode_outer(scalars.parse_numbers(F.col("t"))).alias("n"))
    single = t.select(F.explode("t").alias("v")).select(scalars.parse_number(F.col("v")).alias("n"))
    assert [r.n for r in many.collect()] == [r.n for r in single.collect()]
    assert [r.n for r in many.collect()][:8] == [1234.5, 1234.5, -3.0, 4.5, None, None, None, None]
