"""CSV ingest: dialect, header resolution, bands, transmitter election and keyed merge."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigfield.functions import scalars as S
from sigfield.operators.ranks import running
from sigfield.runtime import cut, ship

# fixed values: header names of each field in order, then what a header may contain
NAMES = {
    "x": (["x_px", "x", "coord_x", "pos_x", "x_lat", "xlat", "lat", "latitude"], ["x_px", "coord_x", "pos_x", "latitude"]),
    "y": (["y_px", "y", "coord_y", "pos_y", "y_lon", "ylon", "lon", "lng", "longitude"], ["y_px", "coord_y", "pos_y", "longitude"]),
    "point_id": (["point_id", "id", "point", "ponto", "ambiente_numero"], ["ponto", "point"]),
    "ssid": (["ssid"], []),
    "band": (["band", "banda", "frequency", "frequencia", "freq"], []),
    "channel": (["channel", "ch", "canal"], []),
    "rssi": (["rssi", "dbm", "signal", "sinal"], []),
    "mac": (["mac", "bssid"], []),
    "distance": (["distance_m", "distance", "distancia_m", "distancia", "dist"], ["distancia", "distance"]),
    "timestamp": (["timestamp", "data_hora", "created_at", "data", "hora"], []),
    "rssi_24ghz": (["rssi_24ghz", "rssi_24", "rssi_2_4ghz", "rssi_2_4", "24ghz", "2_4ghz"], []),
    "rssi_5ghz": (["rssi_5ghz", "rssi_5", "5ghz", "5g"], []),
    "rssi_6ghz": (["rssi_6ghz", "rssi_6", "6ghz", "6g"], []),
}
# fixed values: headers of coordinates that are no pixels
SURVEY_NAMES = ["x_lat", "xlat", "lat", "latitude", "y_lon", "ylon", "lon", "lng", "longitude"]
BANDS = ("24ghz", "5ghz", "6ghz")


def count_delimiter(line: str, delimiter: str) -> int:
    """Occurrences outside quotes."""
    return sum(part.count(delimiter) for k, part in enumerate(line.split('"')) if k % 2 == 0)


def detect_delimiter(line: str) -> str:
    """The most frequent of comma, semicolon and tab; the first of them on a tie."""
    return max(",;\t", key=lambda d: count_delimiter(line, d))


def _looks_like(header: str, band: str) -> bool:
    if not any(t in header for t in ("rssi", "dbm", "sinal", "signal")) or any(t in header for t in ("quality", "qualidade", "nivel")):
        return False
    if band == "24ghz":
        return "24" in header or "2_4" in header
    n = band[0]
    return f"{n}ghz" in header or header == f"{n}g" or header.endswith(f"_{n}")


def resolve(headers: list[str]) -> dict[str, str]:
    """Field to header for normalised headers."""
    out = {}
    for name, (exact, fuzzy) in NAMES.items():
        found = next((h for h in exact if h in headers), None) or next((h for h in headers if any(t in h for t in fuzzy)), None)
        if found is None and name.startswith("rssi_"):
            found = next((h for h in headers if _looks_like(h, name[5:])), None)
        if found:
            out[name] = found
    return out


@dataclass
class Survey:
    """Parsed rows and what went wrong."""

    rows: DataFrame | None
    has_coordinates: bool = False
    errors: list[str] = field(default_factory=list)


FIELDS = [*NAMES, "kind"]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _field_places(headers: pd.Series) -> pd.Series:
    """For the header cells of each file: the place of each field's column as text, and the kind of coordinates."""

    def places(cells) -> list:
        last = {n: i for i, n in enumerate(S.normalize_header(x or "") for x in cells)}  # of equal headers the last counts
        at = resolve([n for n in last if n])
        kind = "survey" if {at.get("x"), at.get("y")} & set(SURVEY_NAMES) else "pixel"
        return [*(str(last[at[f]]) if f in at else None for f in NAMES), kind]

    return headers.map(places)


def _unquoted(cell: Column) -> Column:
    """A cell without the quotes that open and close, wherever they are; two quotes inside quotes are one."""
    parts = F.regexp_extract_all(cell, F.lit('[^"]+|"(?:[^"]+|"")*"?'), F.lit(0))
    inner = lambda p: F.replace(F.regexp_replace(F.substring(p, 2, 1 << 30), '^((?:[^"]+|"")*)"$', "$1"), F.lit('""'), F.lit('"'))
    shown = F.transform(parts, lambda p: F.when(p.startswith('"'), inner(p)).otherwise(p))
    return F.when(cell.contains('"'), F.array_join(shown, "")).otherwise(cell)


def split_cells(record: Column, delimiter: Column) -> Column:
    """The cells of a record; delimiters and line breaks between quotes belong to the cell."""
    pattern = F.concat(F.lit('((?:[^"'), delimiter, F.lit(']+|"(?:[^"]+|"")*"?)*)'), delimiter)
    return F.transform(F.regexp_extract_all(F.concat(record, delimiter), pattern, F.lit(1)), _unquoted)


def _best_delimiter(header: Column) -> Column:
    """The most frequent of comma, semicolon and tab outside quotes; the first of them on a tie."""
    bare = F.regexp_replace(header, '"(?:[^"]|"")*"?', "")
    n = lambda d: F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))
    return F.when((n(",") >= n(";")) & (n(",") >= n("\t")), ",").when(n(";") >= n("\t"), ";").otherwise("\t")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records (file, number, record) of one or several text files, numbered from 1 through all files in the order of
    their names; blank ones don't count. A record ends at a line break outside quotes.

    Whether a line begins inside quotes follows from the number of quotes before it in its file, a running sum taken
    range by range; so a file of any size is read by many tasks. Where no line has an odd number of quotes, each is a
    record and no such sum is needed. A quote that is never closed makes one record of the rest of its file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    order, blank = ["file", "start", "line"], F.trim(F.regexp_replace("value", "\\s", "")) == ""
    if not lines.where(quotes % 2 == 1).limit(1).count():
        return running(lines.where(~blank), order).select("file", F.col("upto").alias("number"), F.col("value").alias("record"))
    counted = running(lines, order[1:], ["file"], quotes).withColumn("inside", (F.col("upto") - quotes) % 2 == 1).drop("upto", "total")
    numbered = running(counted.where(F.col("inside") | ~blank), order, None, (~F.col("inside")).cast("int"))
    each = F.array_sort(F.collect_list(F.struct("start", "line", "value")))
    return numbered.groupBy("file", F.col("upto").alias("number")).agg(F.array_join(F.transform(each, lambda x: x["value"]), "\n").alias("record"))


def read_survey_csv(spark: SparkSession, path: str, tie: str = "first_seen") -> Survey:
    """Parse survey exports with any of three delimiters and known headers, in a file or a folder of files. Each file's
    first record is its header, which decides its delimiter and columns."""
    ship(spark)
    records = cut(read_records(spark, path), "records")
    if not records.limit(1).count():
        return Survey(None, errors=["CSV is empty."])
    heads = records.join(records.groupBy("file").agg(F.min("number").alias("number")), ["file", "number"])
    heads = heads.select("file", F.col("number").alias("first"), _best_delimiter(F.col("record")).alias("delimiter"), F.col("record").alias("header"))
    heads = cut(heads.withColumn("at", _field_places(split_cells(F.col("header"), F.col("delimiter")))).drop("header"), "headers")
    body = records.join(heads, "file").where("number > first").withColumn("cells", split_cells(F.col("record"), F.col("delimiter")))
    value = lambda k: F.when(F.col("at")[k].isNotNull(), F.coalesce(F.get("cells", F.col("at")[k].cast("int")), F.lit(""))).alias(FIELDS[k])
    fields = body.select((F.col("number") - 1).alias("row_idx"), *(value(k) for k in range(len(NAMES))), F.col("at")[len(NAMES)].alias("kind"))
    rows = cut(parse_fields(fields, tie), "survey-rows")
    return Survey(rows, has_coordinates=bool(rows.where("x is not null and y is not null").limit(1).count()))


def parse_rows(body: DataFrame, tie: str = "first_seen") -> DataFrame:
    """Rows of text columns with normalised headers and row_idx, as merged survey rows."""
    at = resolve([c for c in body.columns if c != "row_idx"])
    kind = "survey" if {at.get("x"), at.get("y")} & set(SURVEY_NAMES) else "pixel"
    return parse_fields(body.select("row_idx", *((F.col(at[f]) if f in at else F.lit(None).cast("string")).alias(f) for f in NAMES), F.lit(kind).alias("kind")), tie)


def parse_fields(fields: DataFrame, tie: str = "first_seen") -> DataFrame:
    """Rows of row_idx, the text of each field and the kind of coordinates, as merged survey rows."""
    text, names = F.col, ["x", "y", "band", "channel", "rssi", "distance", *(f"rssi_{b}" for b in BANDS)]
    number = lambda name: F.col("_numbers")[names.index(name)]
    fields = fields.withColumns({"_numbers": S.parse_numbers(F.array(*map(text, names))), "_band": S.normalize_cell(text("band")), "_ssid": S.normalize_cell(text("ssid"))})
    band = F.coalesce(S.band_of(number("band"), F.col("_band")), S.band_from_channel(number("channel")), S.band_of_name(F.col("_ssid")))
    rows = fields.select(
        "row_idx", S.normalize_point_id(text("point_id")).alias("raw_id"), number("x").alias("x"), number("y").alias("y"), F.col("kind").alias("coordinate_kind"), band.alias("band"),
        F.upper(F.trim(text("mac"))).alias("mac"), F.trim(text("ssid")).alias("ssid"), number("rssi").alias("rssi"), number("distance").alias("distance_m"), F.nullif(F.trim(text("timestamp")), F.lit("")).alias("timestamp"),
        *(number(f"rssi_{b}").alias(f"rssi_{b}") for b in BANDS),
    )
    # written once: else each filter upon a value would work out its cell, and what the cell is cut from, for every use in it
    rows = cut(rows, "parsed").withColumns({f"rssi_{b}": F.coalesce(f"rssi_{b}", F.when(F.col("band") == b, F.col("rssi"))) for b in BANDS})
    return merge_rows(keep_dominant(rows, tie))


def dominant_mac(rows: DataFrame, tie: str = "first_seen") -> DataFrame:
    """(band, mac, n, has_ssid) of the transmitter that speaks for each band: named ones first, then the
    most readings, then the first seen or the strongest."""
    stats = rows.where("mac is not null and mac <> '' and band is not null").groupBy("band", "mac").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.col("ssid") != "", F.lit(False))).alias("has_ssid"), F.min("row_idx").alias("first_idx"), F.max("rssi").alias("strongest"))
    last = [F.col("first_idx")] if tie == "first_seen" else [F.desc("strongest"), F.col("first_idx")]
    rank = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("has_ssid"), F.desc("n"), *last))
    return stats.withColumn("rank", rank).where("rank = 1").select("band", "mac", "n", "has_ssid")


def keep_dominant(rows: DataFrame, tie: str = "first_seen") -> DataFrame:
    """Null the band value of readings from other transmitters than the band's dominant one."""
    main = F.broadcast(dominant_mac(rows, tie).select("band", F.col("mac").alias("main_mac")))  # one row to a band
    other = F.coalesce((F.col("mac") != "") & (F.col("mac") != F.col("main_mac")), F.lit(False))
    joined = rows.join(main, "band", "left")
    return joined.withColumns({f"rssi_{b}": F.when(~(other & (F.col("band") == b)) | F.col("band").isNull(), F.col(f"rssi_{b}")) for b in BANDS}).drop("main_mac")


def merge_rows(rows: DataFrame) -> DataFrame:
    """One row per id, or coordinate where there is none: first known place, strongest signal. Coordinates without an id
    are named P1, P2 in the order in which they are first seen, rows without either after their line."""
    key = F.coalesce(F.lower("raw_id"), S.coordinate_key(F.col("x"), F.col("y")), F.concat(F.lit("p"), F.col("row_idx")))
    first = lambda c, ok=None: F.min_by(c, F.when(F.col(c).isNotNull() if ok is None else ok, F.col("row_idx"))).alias(c)
    merged = cut(rows.withColumn("key", key).groupBy("key").agg(
        F.min("row_idx").alias("row_idx"), first("raw_id"), first("x"), first("y"), first("coordinate_kind"), first("distance_m"), first("timestamp", F.col("timestamp") != ""), *(F.max(f"rssi_{b}").alias(f"rssi_{b}") for b in BANDS)
    ), "merged")
    named = F.col("raw_id").isNotNull() | ~F.col("key").startswith("coord:")
    numbered = running(merged.where(~named), ["row_idx"]).withColumn("point_id", F.concat(F.lit("P"), "upto")).drop("upto", "total")
    known = merged.where(named).withColumn("point_id", F.coalesce("raw_id", F.concat(F.lit("P"), F.col("row_idx"))))
    return numbered.unionByName(known).drop("key", "raw_id")
