"""Scalar expressions: type names, names, labels, bands, formats. All are built-in functions, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type codes of the warehouse dictionary and their names.
TYPE_NAMES = {
    "I": "INTEGER", "I1": "BYTEINT", "I2": "SMALLINT", "I8": "BIGINT", "F": "FLOAT", "DA": "DATE",
    "TZ": "TIME WITH TIME ZONE", "SZ": "TIMESTAMP WITH TIME ZONE", "CO": "CLOB", "BO": "BLOB", "N": "NUMBER",
    "AN": "ARRAY", "JN": "JSON",
    "DY": "INTERVAL DAY", "DH": "INTERVAL DAY TO HOUR", "DM": "INTERVAL DAY TO MINUTE", "DS": "INTERVAL DAY TO SECOND",
    "HR": "INTERVAL HOUR", "HM": "INTERVAL HOUR TO MINUTE", "HS": "INTERVAL HOUR TO SECOND", "MI": "INTERVAL MINUTE",
    "MS": "INTERVAL MINUTE TO SECOND", "SC": "INTERVAL SECOND", "MO": "INTERVAL MONTH", "YR": "INTERVAL YEAR",
    "YM": "INTERVAL YEAR TO MONTH",
    "PD": "PERIOD(DATE)", "PT": "PERIOD(TIME)", "PS": "PERIOD(TIMESTAMP)", "PM": "PERIOD(TIMESTAMP WITH TIME ZONE)",
}
SCALED = {"TS": "TIMESTAMP", "AT": "TIME"}
SIZED = {"CF": "CHAR", "BF": "BYTE", "CV": "VARCHAR", "BV": "VARBYTE"}
#: Transformation of the log -> (type, subtype, confidence).
TRANSFORMATIONS = {
    "DIRECT": ("DIRECT", "IDENTITY", 0.95), "CALCULATION": ("DIRECT", "TRANSFORMATION", 0.85),
    "AGGREGATION": ("DIRECT", "AGGREGATION", 0.90), "JOIN": ("INDIRECT", "JOIN", 0.80), "FILTER": ("INDIRECT", "FILTER", 0.75),
}
EDGE_COLOURS = {"direct": "#22c55e", "derived": "#3b82f6", "aggregated": "#a855f7", "aggregation": "#a855f7", "joined": "#06b6d4", "calculation": "#f97316"}
OTHER_COLOUR = "#6b7280"


def _lookup(key: Column, values: dict, default: Column) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default)


def type_name(code: Column, length: Column, digits: Column, fraction: Column) -> Column:
    """Name of a dictionary type code: null is UNKNOWN, an unknown code is itself."""
    key, zero = F.trim(code), F.lit(0)
    text = lambda c: F.coalesce(c, zero).cast("string")
    out = F.when(code.isNull(), "UNKNOWN").when(key == "D", F.concat(F.lit("DECIMAL("), text(digits), F.lit(","), text(fraction), F.lit(")")))
    for k, name in SCALED.items():
        out = out.when(key == k, F.concat(F.lit(f"{name}("), text(fraction), F.lit(")")))
    for k, name in SIZED.items():
        out = out.when(key == k, F.concat(F.lit(f"{name}("), text(length), F.lit(")")))
    return out.otherwise(_lookup(key, TYPE_NAMES, key))


def database_of(name: Column) -> Column:
    """What stands before the first dot; without a dot, the name."""
    return F.substring_index(name, ".", 1)


def table_of(name: Column) -> Column:
    """What stands after the first dot; without a dot, the name."""
    return F.when(F.instr(name, ".") > 0, F.substr(name, F.instr(name, ".") + F.lit(1))).otherwise(name)


def transformation(kind: Column) -> tuple[Column, Column, Column]:
    """Type, subtype and confidence of a logged transformation; others are DIRECT, TRANSFORMATION, 0.60."""
    parts = [_lookup(kind, {k: v[i] for k, v in TRANSFORMATIONS.items()}, F.lit(d)) for i, d in enumerate(("DIRECT", "TRANSFORMATION", 0.60))]
    return parts[0], parts[1], parts[2].cast("decimal(3,2)")


def asset_type(kind: Column) -> Column:
    k = F.upper(F.trim(kind))
    return F.when(k.isin("V", "VIEW"), "view").when(k.isin("M", "MATERIALIZED VIEW", "MATERIALIZED_VIEW"), "materialized_view").otherwise("table")


def percent(confidence: Column) -> Column:
    """A confidence as percent; values over 1 are percents already."""
    return F.round(F.when(confidence > 1, confidence).otherwise(confidence * 100)).cast("int")


def confidence_band(confidence: Column) -> Column:
    p = percent(confidence)
    return F.when(p >= 90, "high").when(p >= 70, "medium").when(p >= 50, "low").when(p.isNotNull(), "very_low").otherwise("unknown")


def confidence_opacity(confidence: Column) -> Column:
    p = percent(confidence)
    return F.when(p >= 90, 1.0).when(p >= 70, 0.9).when(p >= 50, 0.8).when(p.isNotNull(), 0.7).otherwise(1.0)


def edge_colour(kind: Column) -> Column:
    return _lookup(F.lower(kind), EDGE_COLOURS, F.lit(OTHER_COLOUR))


def format_bytes(size: Column) -> Column:
    """Bytes in the largest unit that gives 1 or more, with two decimals, rounded half up in whole numbers."""
    out = F.when(size.isNull() | (size <= 0), "0 B")
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        step = 1024**power
        hundredths = F.floor((size % step * 100 + step // 2) / step)
        whole = F.floor(size / step) + F.floor(hundredths / 100)
        out = out.when(size >= step, F.concat(whole.cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(f" {unit}")))
    return out.otherwise(F.concat(size.cast("string"), F.lit(" B")))


def format_duration(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.when(seconds < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))


def time_left(elapsed: Column, progress: Column) -> Column:
    """Seconds left at this pace, from a tenth of the work on."""
    return F.when(progress >= 10, F.round(elapsed / (progress / 100) - elapsed, 2))


def zoom(nodes: Column) -> Column:
    """1.0 up to 20 nodes, 0.5 from 50 on, in proportion between."""
    return F.when(nodes <= 20, 1.0).when(nodes >= 50, 0.5).otherwise(F.round(1.0 - (nodes - 20) / 30.0 * 0.5, 4))


def clean_sql(text: Column) -> Column:
    """White space as single spaces, trimmed, without semicolons at the end."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"[; ]+$", ""))


def parse_datetime(text: Column) -> Column:
    out = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd")]
    return F.coalesce(*out)


def is_latin(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\xFF]")


def match_score(value: Column, query: str) -> Column:
    """1.0 for the query itself, 0.8 at the start, 0.5 inside, else 0; in any case of letters."""
    v, q = F.lower(value), F.lit(query.lower())
    return F.when(v == q, 1.0).when(v.startswith(q), 0.8).when(v.contains(q), 0.5).otherwise(0.0)


def as_boolean(flag: Column, default: bool) -> Column:
    return F.when(flag.isNull(), F.lit(default)).otherwise(F.trim(flag) == "Y")
