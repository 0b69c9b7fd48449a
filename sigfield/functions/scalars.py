"""Scalar functions over columns: rounding, parsing, identifiers, bands, plan text."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9

# fixed values: accented letters of the survey exports' languages and their plain forms
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def clamp(v: Column, lo, hi) -> Column:
    """v within [lo, hi]; null stays null."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return F.when(v.isNotNull(), F.least(hi, F.greatest(lo, v)))


def smoothstep(lo, hi, v: Column) -> Column:
    """Cubic ease from 0 at lo to 1 at hi."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    t = clamp((v - lo) / F.greatest(hi - lo, F.lit(EPSILON)), 0.0, 1.0)
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def round_half_up(v: Column, digits: int = 0) -> Column:
    """Nearest multiple of 10**-digits, halves toward plus infinity."""
    k = float(10**digits)
    return F.floor(v * k + 0.5) / F.lit(k)


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def exact_mean(v: Column) -> Column:
    """Mean whose sum is exact to six decimals, so that it doesn't depend on the order of rows."""
    return F.sum(v.cast("decimal(28,6)")).cast("double") / F.count(v)


def normalize_header(name: str) -> str:
    """Header as lower-case ASCII words joined by underscores."""
    plain = unicodedata.normalize("NFD", name.strip().replace("﻿", ""))
    plain = "".join(c for c in plain if not "̀" <= c <= "ͯ").lower()
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")


def normalize_cell(v: Column) -> Column:
    """A cell like a header, for accents of the fixed table."""
    plain = F.lower(F.translate(F.trim(v), ACCENTED, PLAIN))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def parse_number(v: Column) -> Column:
    """Number of a cell whose decimal sign is whichever of comma and dot comes last; else null."""
    return _number(_digits(v))


def parse_numbers(texts: Column) -> Column:
    """The like for each text of an array; a text is cleaned once, however often its number looks at it."""
    return F.transform(F.transform(texts, _digits), _number)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9,.\-+]", "")


def _number(kept: Column) -> Column:
    without = lambda c: F.replace(kept, F.lit(c), F.lit(""))
    last = lambda c: F.instr(F.reverse(kept), c)  # noqa: E731  0 if absent, small if late
    comma_last = (last(",") > 0) & ((last(".") == 0) | (last(",") < last(".")))
    european = F.regexp_replace(without("."), "^([^,]*),", "$1.")
    return F.when(comma_last, european).otherwise(without(",")).try_cast("double")


def parse_decimal(v: Column) -> Column:
    """Number with a decimal comma or dot; blank is null."""
    return F.when(F.trim(v) != "", F.regexp_replace(F.trim(v), "^([^,]*),", "$1.").try_cast("double"))


def parse_positive(v: Column) -> Column:
    """Leading positive number of a text; else null."""
    n = F.regexp_extract(F.regexp_replace(v, "^([^,]*),", "$1."), r"^\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")
    return F.when(n > 0, n)


# fixed value: ids that are a number with an optional word before it
POINT_ID = r"^(?:p|ponto|point)?[\s_-]*0*([0-9]+)$"


def normalize_point_id(v: Column, fallback: Column | None = None) -> Column:
    """P and the number of ids such as p-007 or ponto 7; other ids unchanged; blank ones the fallback."""
    raw = F.trim(v)
    number = F.regexp_extract(F.lower(raw), POINT_ID, 1)
    out = F.when(number != "", F.concat(F.lit("P"), number)).otherwise(raw)
    return F.when((raw == "") | raw.isNull(), fallback if fallback is not None else F.lit(None).cast("string")).otherwise(out)


def point_id_aliases(v: Column) -> Column:
    """All names by which an id may be looked up."""
    raw = F.lower(F.trim(v))
    number = F.regexp_extract(raw, POINT_ID, 1)
    n = F.when(number != "", number)
    return F.array_distinct(F.array_compact(F.array(F.lower(normalize_point_id(v)), n, F.concat(F.lit("p"), n), F.when(raw != "", raw))))


def normalize_band(v: Column) -> Column:
    """Band of a text with a frequency in MHz or GHz, or with a band's name."""
    return band_of(parse_number(v), normalize_cell(v))


def band_of(n: Column, t: Column) -> Column:
    """Band of a text's number and of its form like a header."""
    whole = F.floor(n + 0.5)
    by_number = (
        F.when(((n >= 2400) & (n < 2500)) | ((n >= 2) & (n < 3)) | (whole == 24), "24ghz")
        .when(((n >= 4900) & (n < 5925)) | (whole == 5), "5ghz")
        .when(((n >= 5925) & (n < 7125)) | (whole == 6), "6ghz")
    )
    by_text = F.when(t.contains("2_4") | t.contains("24"), "24ghz").when(t.contains("5ghz") | t.isin("5g", "5"), "5ghz").when(t.contains("6ghz") | t.isin("6g", "6"), "6ghz").when(t.contains("5"), "5ghz")
    return F.coalesce(by_number, by_text)


def band_from_channel(channel: Column) -> Column:
    return F.when(channel.between(1, 14), "24ghz").when(channel.between(32, 196), "5ghz")


def band_from_ssid(ssid: Column) -> Column:
    """Band that a network name states outright."""
    return band_of_name(normalize_cell(ssid))


def band_of_name(t: Column) -> Column:
    """The like for a name in its form like a header."""
    return F.when(t.rlike(r"(^|_)6g(hz)?(_|$)"), "6ghz").when(t.rlike(r"(^|_)5g(hz)?(_|$)"), "5ghz").when(t.rlike(r"(^|_)2_4g(hz)?(_|$)"), "24ghz")


def coordinate_key(x: Column, y: Column) -> Column:
    """A name of the place to six digits; null if a coordinate is."""
    return F.when(x.isNotNull() & y.isNotNull(), F.format_string("coord:%.6f:%.6f", x, y))


def plain_number(v: Column) -> Column:
    """A number as text, whole ones without a fraction; null if it is null."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def csv_value(v: Column) -> Column:
    """A CSV cell, quoted where it needs to be; null is empty."""
    s = F.coalesce(v.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\\n;]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


# fixed values: words for rooms, in the order in which a plan's text is searched
ROOM_WORDS = (
    "sala de estar", "sala de jantar", "sala", "quarto", "dormitório", "dormitorio", "suíte", "suite", "banheiro", "lavabo", "wc", "bwc", "cozinha", "copa", "despensa",
    "lavanderia", "área de serviço", "area de servico", "garagem", "varanda", "sacada", "corredor", "hall", "circulação", "circulacao", "escritório", "escritorio", "closet",
)


def text_measures(text: Column) -> Column:
    """What a plan's text states: scale (1:N as it stands), area_m2, width_m and height_m of the first size below 1000 m a side,
    and the rooms that it names, each with a capital. What is not stated is null; rooms may be empty."""
    n = F.nullif(F.regexp_extract(text, r"1\s*[:/]\s*(\d+)", 1), F.lit(""))
    size = r"(\d+[,.]\d+)\s*[xX×]\s*(\d+[,.]\d+)"
    wide, high = (parse_positive(F.regexp_extract(text, size, k)) for k in (1, 2))
    fits = (wide < 1000) & (high < 1000)
    low = F.lower(text)
    rooms = F.array_compact(F.array(*(F.when(low.contains(r), r[0].upper() + r[1:]) for r in ROOM_WORDS)))
    area = parse_positive(F.regexp_extract(text, r"(?i)(\d+[,.]?\d*)\s*m[²2]", 1))
    return F.struct(F.concat(F.lit("1:"), n).alias("scale"), area.alias("area_m2"), F.when(fits, wide).alias("width_m"), F.when(fits, high).alias("height_m"), rooms.alias("rooms"))


def plan_scale(text: Column) -> Column:
    """N of a drawing scale 1:N, from 1 to 10000."""
    n = F.regexp_extract(text, r"1\s*[:/]\s*([0-9]{1,5})", 1).try_cast("int")
    return F.when(n.between(1, 10000), n)


def px_per_meter_from_scale(text: Column, dpi: float) -> Column:
    return F.floor(F.lit(dpi * 39.3701) / plan_scale(text) + 0.5)


def plan_area(text: Column) -> Column:
    """Square metres that a plan's text states."""
    return parse_positive(F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)?)\s*m(?:²|2)", 1))


# fixed values: names of wall materials
MATERIALS = ("drywall", "glass", "wood", "brick", "concrete", "reinforced_concrete", "stone", "metal")


def wall_material(v: Column) -> Column:
    """A known material; anything else counts as concrete."""
    t = F.lower(F.trim(v))
    return F.when(t.isin(*MATERIALS), t).otherwise(F.lit("concrete"))
