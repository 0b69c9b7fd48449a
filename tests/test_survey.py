"""Survey exports, calibration, rules and interpolation on small fixtures with known results."""

import math

import pytest
from pyspark.sql import functions as F

from sigfield.functions import geometry as G
from sigfield.functions import rf
from sigfield.functions import scalars as S
from sigfield.operators import calibrate, coverage, ingest, interpolate, place, rules

HEADER = "Timestamp,X(Lat),Y(Lon),Signal,Noise,Ch,MAC,SSID"
ROWS = [
    "2026-01-14T13:07:31,13.1120391,10.5510940,-26,-92,36,20:3A:EB:DF:62:3D,CLARO_DF623C-5G",
    "2026-01-14T13:07:31,13.1120391,10.5510940,-40,-92,6,20:3a:eb:df:62:3c,CLARO_DF623C",
    "2026-01-14T13:07:35,14.5,11.25,-61,-92,44,20:3A:EB:DF:62:3D,CLARO_DF623C-5G",
]


def parsed(spark, tmp_path, text, name="s.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return ingest.read_survey_csv(spark, f"file://{path}")


def test_survey_export(spark, tmp_path):
    got = parsed(spark, tmp_path, "\n".join([HEADER, *ROWS]))
    assert got.has_coordinates and not got.errors
    rows = sorted(got.rows.collect(), key=lambda r: r.row_idx)
    assert [(r.x, r.y, r.rssi_24ghz, r.rssi_5ghz, r.rssi_6ghz) for r in rows] == [(13.1120391, 10.551094, -40.0, -26.0, None), (14.5, 11.25, None, -61.0, None)]
    assert {r.coordinate_kind for r in rows} == {"survey"}
    assert [r.point_id for r in rows] == ["P1", "P2"]
    assert rows[0].timestamp == "2026-01-14T13:07:31"


def test_survey_export_without_mac(spark, tmp_path):
    cut = lambda line: ",".join(x for k, x in enumerate(line.split(",")) if k not in (4, 6))
    rows = parsed(spark, tmp_path, "\n".join(map(cut, [HEADER, *ROWS]))).rows.collect()
    assert sorted((r.x, r.rssi_24ghz, r.rssi_5ghz) for r in rows) == [(13.1120391, -40.0, -26.0), (14.5, None, -61.0)]


@pytest.mark.parametrize("sep", [";", "\t"])
def test_dialects(spark, tmp_path, sep):
    """A byte order mark, accents, decimal commas, quoted separators and line breaks, CRLF, blank lines."""
    lines = [sep.join(("﻿Ponto", "Coord X", "Coord Y", "RSSI 2.4 (dBm)", "Sinal 5GHz", "Distância (m)", "Observação")), "", sep.join(("Ponto-007", '"1.234,5"', '"20,25"', "-55 dBm", "", "3,5", f'"a{sep} ""b""\nc"')), sep.join(("x1", "1,234.5", "7", "", "-60", "", ""))]
    rows = sorted(parsed(spark, tmp_path, "\r\n".join(lines)).rows.collect(), key=lambda r: r.row_idx)
    assert [(r.point_id, r.x, r.y, r.rssi_24ghz, r.rssi_5ghz, r.distance_m) for r in rows] == [("P7", 1234.5, 20.25, -55.0, None, 3.5), ("x1", 1234.5, 7.0, None, -60.0, None)]


def test_empty_export(spark, tmp_path):
    got = parsed(spark, tmp_path, "\n \n")
    assert got.rows is None and got.errors


def test_delimiters():
    assert ingest.detect_delimiter('a;"b,c,d";e') == ";"
    assert ingest.detect_delimiter("a,b;c") == ","
    assert ingest.count_delimiter('"x,""y"",z",w', ",") == 1


def test_export_of_a_device(spark, tmp_path):
    """A neighbour's transmitter on the same channel doesn't count; places without ids are numbered as they come."""
    lines = [HEADER, ROWS[0], "2026-01-14T13:07:31,13.1120391,10.5169480,-79,-85,6,6E:02:B8:A0:A3:2C,Clarowifi_1024-IoT", "2026-01-14T13:07:31,13.1120391,10.5169480,-15,-89,6,20:3A:EB:DF:62:3C,CLARO_DF623C"]
    got = ingest.read_survey_csv(spark, f"file://{_write(tmp_path, lines)}", tie="strongest")
    assert got.errors == [] and got.has_coordinates
    rows = [r.asDict() for r in got.rows.orderBy("row_idx").collect()]
    shared = {"coordinate_kind": "survey", "rssi_6ghz": None, "distance_m": None, "timestamp": "2026-01-14T13:07:31"}
    assert rows == [
        {"row_idx": 1, "point_id": "P1", "x": 13.1120391, "y": 10.551094, "rssi_24ghz": None, "rssi_5ghz": -26.0, **shared},
        {"row_idx": 2, "point_id": "P2", "x": 13.1120391, "y": 10.516948, "rssi_24ghz": -15.0, "rssi_5ghz": None, **shared},
    ]


def _write(folder, lines, name="export.csv"):
    (folder / name).write_text("\n".join(lines), encoding="utf-8")
    return folder / name


def test_quotes_within_cells(spark, tmp_path):
    lines = ['id,x,y,rssi_24,note', 'p"3,5",6,7,-52,', 'a"",8,9,-50,"b ""c"", d"', '"two', '', 'lines",1,2,-40,x', '  ', '"never closed,3,4']
    rows = {r.row_idx: r for r in ingest.read_survey_csv(spark, f"file://{_write(tmp_path, lines)}").rows.collect()}
    assert [(r.point_id, r.x, r.y, r.rssi_24ghz) for _, r in sorted(rows.items())] == [("p3,5", 6.0, 7.0, -52.0), ("a", 8.0, 9.0, -50.0), ("two\n\nlines", 1.0, 2.0, -40.0), ("never closed,3,4", None, None, None)]


def test_several_exports(spark, tmp_path):
    """Each file has its own header, delimiter and columns; lines keep one order, and rows without id or place their line."""
    folder = tmp_path / "many"
    folder.mkdir()
    _write(folder, ["x;y;rssi_5ghz", "1,5;2;-50", "1,5;2;-45", ";;-60"], "a.csv")
    _write(folder, ["point_id,rssi_24,latitude,longitude", "p-7,-70,3,4", ",-71,1.5,2"], "b.csv")
    got = ingest.read_survey_csv(spark, f"file://{folder}")
    rows = [(r.row_idx, r.point_id, r.x, r.y, r.rssi_24ghz, r.rssi_5ghz, r.coordinate_kind) for r in got.rows.orderBy("row_idx").collect()]
    assert got.has_coordinates and rows == [(1, "P1", 1.5, 2.0, -71.0, -45.0, "pixel"), (3, "P3", None, None, None, -60.0, "pixel"), (5, "P7", 3.0, 4.0, -70.0, None, "survey")]


def test_sentinel_and_metric_placement(spark):
    walk = [(i, i * 24 / 39, i * 18 / 39) for i in range(40)]
    rows = spark.createDataFrame([*walk, (40, 36600000.123456, 36600000.123456)], "row_idx long, x double, y double").withColumn("g", F.lit(1))
    got = {r.row_idx: (r.x, r.y) for r in place.prepare(rows, 560.0, 420.0, 20.0, ["g"]).collect()}
    half_up = lambda v: math.floor(v * 100 + 0.5) / 100
    assert got == {i: (half_up(24 + x * 20), half_up(24 + y * 20)) for i, x, y in walk} | {40: (None, None)}
    fitted = {r.row_idx: (r.x, r.y) for r in place.prepare(rows, 1000.0, 500.0, None, ["g"]).collect()}
    # the range is that of the walk: 40 to 959 and 20 to 479; the sentinel lies at its end
    want = {i: (half_up(40 + x / 24 * 919), half_up(20 + y / 18 * 459)) for i, x, y in walk} | {40: (959.0, 479.0)}
    assert fitted[39] == fitted[40] == (959.0, 479.0) and fitted[0] == (40.0, 20.0)
    assert all(math.isclose(fitted[i][k], want[i][k], abs_tol=0.011) for i in want for k in (0, 1))
    one = spark.createDataFrame([(1, 5.0, 7.0), (2, 5.0, 9.0)], "row_idx long, x double, y double").withColumn("g", F.lit(1))
    assert {r.row_idx: (r.x, r.y) for r in place.prepare(one, 1000.0, 500.0, None, ["g"]).collect()} == {1: (499.5, 20.0), 2: (499.5, 479.0)}


SURVEYED = "g int, row_idx long, point_id string, x double, y double, coordinate_kind string, rssi_24ghz double, rssi_5ghz double, rssi_6ghz double, distance_m double, timestamp string"


def _surveyed(spark, rows):
    return spark.createDataFrame([(1, i, f"S{i}", x, y, kind, r24, r5, None, None, "t") for i, x, y, kind, r24, r5 in rows], SURVEYED)


def test_survey_fitted_without_scale(spark):
    rows = _surveyed(spark, [(1, 13.1120391, 10.551094, "survey", -15.0, None), (2, 13.0, 10.0, "survey", None, -30.0)])
    out, issues = place.fit_survey(rows, 1000.0, 500.0, None, ["g"])
    got = out.orderBy("row_idx").collect()
    assert [(r.point_id, r.coordinate_kind, r.x, r.y, r.rssi_24ghz, r.rssi_5ghz) for r in got] == [("P1", "pixel", 959.0, 479.0, -15.0, None), ("P2", "pixel", 40.0, 20.0, None, -30.0)]
    assert [(r.severity, r.code, r.pct) for r in issues.collect()] == [("warning", "csv_survey_uncalibrated", None)]


def test_survey_fitted_by_scale(spark):
    walk = [(i, i * 24 / 39, i * 18 / 39, "survey", -50.0, None) for i in range(40)]
    rows = _surveyed(spark, [*walk, (40, 36600000.123456, 36600000.123456, "survey", -50.0, None), (41, 25.0, 25.0, "pixel", None, -60.0), (42, None, 1.0, "survey", -61.0, None)])
    out, issues = place.fit_survey(rows, 560.0, 420.0, 20.0, ["g"])
    got = sorted(out.collect(), key=lambda r: r.row_idx)
    assert issues.count() == 0
    placed = [r for r in got if r.x is not None and r.row_idx < 40]
    assert math.isclose(max(r.x for r in placed) - min(r.x for r in placed), 480, abs_tol=5) and math.isclose(max(r.y for r in placed) - min(r.y for r in placed), 360, abs_tol=5)
    assert [(r.point_id, r.x, r.y, r.coordinate_kind) for r in got if r.row_idx >= 40] == [("S40", None, None, None), ("S42", None, 1.0, "survey")]
    first = got[0]  # the pixel row falls into the first cell
    assert (first.point_id, first.x, first.y, first.rssi_24ghz, first.rssi_5ghz) == ("P1", 24.5, 24.5, -50.0, -60.0)
    _, issues = place.fit_survey(_surveyed(spark, walk[::2]), 100.0, 100.0, 20.0, ["g"])
    assert [r.code for r in issues.collect()] == ["csv_survey_out_of_bounds"]
    plain = _surveyed(spark, [(1, 5.0, 6.0, "pixel", None, None)])
    out, issues = place.fit_survey(plain, 100.0, 100.0, None, ["g"])
    assert out.collect() == plain.collect() and issues.count() == 0


def test_edges_of_the_plan_are_outside(spark):
    rows = spark.createDataFrame([(1, 100.0, 5.0), (1, 99.9, 99.9), (1, 0.0, 0.0), (2, 5.0, 100.0), (2, 1.0, 1.0)], "g int, x double, y double")
    got = {r.g: (r.pct, r.warn) for r in place.out_of_bounds_pct(rows, 100, 100, ["g"]).collect()}
    assert got == {1: (33, True), 2: (50, True)}


def test_rooms_in_natural_order(spark):
    names = ["Wing 10 Room 1", "Room 10a", "Ático", "Wing 2 Room 3", "Room 2a", "room 2", "Room 010", "Zona", "Room 2b", "10", "9"]
    got = coverage.natural_order(spark.createDataFrame(list(enumerate(names)), "k int, name string"), "name", "k")
    assert [r.name for r in got.orderBy("place").collect()] == ["9", "10", "Ático", "room 2", "Room 2a", "Room 2b", "Room 010", "Room 10a", "Wing 2 Room 3", "Wing 10 Room 1", "Zona"]


def test_close_points_of_surveys(spark):
    rows = [(1, k, 20.0 * k, 0.0, "manual") for k in range(10)] + [(1, 20, 3.0, 4.0, "detected"), (1, 21, 8.0, 0.0, "manual"), (1, 22, 21.0, 0.0, "csv"), (1, 23, 41.0, 0.0, None)]
    rows += [(2, 1000 + k, 5.0, 5.0, "manual") for k in range(1201)] + [(3, 3000 + k, 50.0, 5.0, "manual") for k in range(10)]
    got = rules.close_reports(spark.createDataFrame(rows, "site int, row_idx int, x double, y double, source string"), ["site"]).collect()
    assert sorted((r.point_id, r.other_id) for r in got if r.site == 1) == [(0, 20), (2, 23), (20, 21)]  # 8 pixels apart is not close
    assert not [r for r in got if r.site == 2]
    assert [r.omitted for r in got if r.site == 3 and r.code == "point_duplicate_truncated"] == [5] and sum(r.site == 3 for r in got) == 41


def test_running_sums(spark):
    from sigfield.operators.ranks import running

    rows = [(k % 3 if k % 5 else None, k * 7 % 50, k % 4) for k in range(200)]
    got = running(spark.createDataFrame(rows, "g int, v int, w int").distinct(), ["v", "w"], ["g"], F.col("w")).collect()
    seen = {}
    for r in sorted(got, key=lambda r: (repr(r.g), r.v, r.w)):
        seen[r.g] = seen.get(r.g, 0) + r.w
        assert r.upto == seen[r.g]
    assert {r.g: r.total for r in got} == seen


def test_bands(spark):
    cases = {"2437": "24ghz", "2500": None, "2.4 GHz": "24ghz", "5180 MHz": "5ghz", "5925": "6ghz", "7125": "5ghz", "4.6": "5ghz", "5GHz ch 36": "5ghz", "wifi 6ghz": "6ghz", "6g": "6ghz", "802.11ax": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.normalize_band(F.col("t")).alias("b"))
    got = {r.t: r.b for r in df.collect()}
    assert got["2437"] == got["2.4 GHz"] == "24ghz"
    assert got["5180 MHz"] == got["4.6"] == got["5GHz ch 36"] == "5ghz"
    assert got["5925"] == got["wifi 6ghz"] == got["6g"] == "6ghz"
    assert got["7125"] == "5ghz"  # out of all ranges; the text holds a 5
    assert got[""] is None


def plan(spark, **over):
    base = {"mode": "two-point", "manual_px_per_m": None, "ax": 100.0, "ay": 100.0, "bx": 300.0, "by": 100.0, "known_m": 4.0, "ox": 0.0, "oy": 0.0} | over
    kinds = {k: "string" if k == "mode" else "double" for k in base}
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {v}" for k, v in kinds.items()))


@pytest.mark.parametrize(
    "over,scale,codes",
    [
        ({}, 50.0, []), ({"mode": "manual", "manual_px_per_m": 80.0}, 80.0, []), ({"known_m": 0.0}, None, ["scale_required"]), ({"bx": 100.0}, None, ["scale_two_points"]),
        ({"bx": 120.0, "known_m": 1.0}, 20.0, ["scale_separation"]), ({"mode": "manual", "manual_px_per_m": float("nan")}, None, ["scale_required"]), ({"mode": "manual", "manual_px_per_m": 2.0}, 2.0, ["scale_range"]),
    ],
)
def test_calibration(spark, over, scale, codes):
    r = calibrate.derive(plan(spark, **over)).first()
    assert (r.px_per_m, r.codes, r.status) == (scale, codes, "calibrated" if scale else "uncalibrated")
    assert r.m_per_px == (1 / scale if scale else None)


def test_gate(spark):
    bad = calibrate.derive(plan(spark, known_m=0.0))
    with pytest.raises(calibrate.CalibrationError) as e:
        calibrate.require(bad)
    assert e.value.code == "calibration_required"
    with pytest.raises(Exception, match="calibration_required"):
        calibrate.required(bad).collect()


def test_world(spark):
    site = calibrate.derive(plan(spark)).withColumn("site", F.lit(1))
    spots = spark.createDataFrame([(1, 150.0, 300.0), (2, 150.0, 300.0)], "site int, x double, y double")
    got = {r.site: r.world for r in calibrate.world(spots, site, ["site"]).collect()}
    assert (got[1].x, got[1].y) == (3.0, 6.0) and got[2] is None
    square = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (100.0, 0.0), (100.0, 250.0), (0.0, 250.0))))
    assert spark.range(1).select(G.polygon_area(square) / 50**2).first()[0] == 10.0


def test_rules(spark):
    kind = "row_idx int, x double, y double, rssi_24ghz double, rssi_5ghz double, csv_distance_m double, distance_m double"
    rows = [(1, 99.9, 0.0, -50.0, None, None, 2.0), (2, 100.0, 10.0, -5.0, -60.0, 9.0, 2.0), (3, None, 1.0, None, None, 2.5, 2.0), (4, float("nan"), 1.0, -101.0, float("inf"), None, None)]
    points = spark.createDataFrame(rows, kind)
    assert sorted((r.point_id, r.code) for r in rules.point_issues(points, 100, 100).collect()) == [(2, "point_inside"), (3, "point_coordinates"), (4, "point_coordinates")]
    assert sorted((r.point_id, r.code) for r in rules.rssi_issues(points).collect()) == [(2, "distance_audit"), (2, "rssi_range"), (3, "rssi_required"), (4, "rssi_range")]
    assert rules.has_blocking(rules.point_issues(points, 100, 100))
    assert not rules.silent_bands(points).count()
    assert [r.code for r in rules.router_issues(spark.createDataFrame([], "ap_id long, ax double, ay double"), 1, 1).collect()] == ["ap_required"]
    pairs = spark.createDataFrame([(1, 2)], "i int, j int")
    assert rules.close_points(pairs, 1200).count() == 1 and rules.close_points(pairs, 1500).count() == 0


@pytest.mark.parametrize("points,target,power,want", [([(10, 10, -35), (30, 10, -80)], (10, 10), 2.2, -35), ([(0, 0, -40), (10, 0, -80)], (5, 0), 2.2, -60), ([(0, 0, -40), (20, 0, -80)], (5, 0), 2, -44)])
def test_idw(spark, points, target, power, want):
    p = spark.createDataFrame([(i, float(x), float(y), float(v), "a") for i, (x, y, v) in enumerate(points)], "first_idx int, x double, y double, rssi double, band string")
    g = spark.createDataFrame([(0, 0, *map(float, target))], "gx int, gy int, tx double, ty double")
    assert math.isclose(interpolate.idw_grid(p, g, ["band"], power).first().rssi, want, rel_tol=1e-12)


def test_idw_weight(spark):
    r = spark.range(1).select(rf.idw_weight(F.lit(0.0), 2).alias("a"), rf.idw_weight(F.lit(2.0), 2).alias("b")).first()
    assert r.a == math.inf and r.b == 0.25
