"""Numeric closeness, numeric readings of text, and distance on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances of the grading protocol.
ABSOLUTE_TOLERANCE = 1e-2
RELATIVE_TOLERANCE = 1e-9
# Cell texts that mean "no value", and texts that mean a truth value.
NULL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_TEXTS = ["True", "TRUE", "true"]
FALSE_TEXTS = ["False", "FALSE", "false"]
NUMBER_TEXT = r"^\s*[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)\s*$"
INFINITY_TEXT = r"(?i)^\s*[+-]?inf(?:inity)?\s*$"
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
LARGEST_INTEGER = 18446744073709551615
SMALLEST_INTEGER = -9223372036854775808
EARTH_RADIUS_METRES = 6371000.0


def close_sql(a: str, b: str) -> str:
    """Equal, or both finite and within tolerance, as SQL text for use in any expression."""
    return (
        f"({a} = {b} OR (abs({a}) < double('infinity') AND abs({b}) < double('infinity') AND "
        f"abs({a} - {b}) <= greatest({ABSOLUTE_TOLERANCE}D, "
        f"{RELATIVE_TOLERANCE}D * greatest(abs({a}), abs({b})))))"
    )


def is_finite(x: Column) -> Column:
    return F.abs(x) < float("inf")


def is_truth_text(raw: Column) -> Column:
    return raw.isin(TRUE_TEXTS + FALSE_TEXTS)


def number_of_text(raw: Column) -> Column:
    """Numeric reading of a cell text, or NULL.

    Integers beyond 64 bits are not read as numbers, so their column stays text.
    """
    digits = F.length(F.regexp_replace(raw, r"[^0-9]", ""))
    integer = F.btrim(raw).try_cast("decimal(38,0)")
    fits = (digits <= 38) & integer.between(
        F.lit(str(SMALLEST_INTEGER)).cast("decimal(38,0)"),
        F.lit(str(LARGEST_INTEGER)).cast("decimal(38,0)"),
    )
    plain = F.btrim(raw).try_cast("double")
    infinite = F.when(F.btrim(raw).startswith("-"), F.lit(float("-inf"))).otherwise(
        F.lit(float("inf"))
    )
    return (
        F.when(raw.isin(TRUE_TEXTS), F.lit(1.0))
        .when(raw.isin(FALSE_TEXTS), F.lit(0.0))
        .when(raw.rlike(INTEGER_TEXT), F.when(fits, plain))
        .when(raw.rlike(NUMBER_TEXT), plain)
        .when(raw.rlike(INFINITY_TEXT), infinite)
    )


def is_point(lon: Column, lat: Column) -> Column:
    return lon.between(-180, 180) & lat.between(-90, 90)


def metres_between(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance (haversine)."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), 2
    )
    return 2 * EARTH_RADIUS_METRES * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))
