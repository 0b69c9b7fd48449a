"""Exports: measurement CSV and project JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigfield.functions.scalars import csv_value, plain_number, round_half_up

# fixed values: columns of a measurement export
CSV_COLUMNS = ("point_id", "x_px", "y_px", "rssi_24ghz", "rssi_5ghz", "rssi_6ghz", "distance_m", "timestamp")


def csv_lines(points: DataFrame, columns: tuple[str, ...] = CSV_COLUMNS, key: str | None = None) -> DataFrame:
    """One text line per point, cells quoted where needed, coordinates to two decimals, whole numbers without a fraction."""
    number = {f.name for f in points.schema if f.dataType.typeName() in ("double", "float")}
    shown = lambda c: round_half_up(F.col(c), 2) if c in ("x_px", "y_px") else F.col(c)
    cell = lambda c: csv_value(plain_number(shown(c)) if c in number else shown(c))
    return points.select(*([key] if key else []), F.concat_ws(",", *(cell(c) for c in columns)).alias("line"))


def write_csv(points: DataFrame, path: str) -> None:
    """Write the lines as text files, each below the header of the columns."""
    points.select(*CSV_COLUMNS).write.csv(path, header=True)


def project_json(project: DataFrame) -> DataFrame:
    """Each row as one JSON document; null fields are left out."""
    return project.select(F.to_json(F.struct("*")).alias("json"))
