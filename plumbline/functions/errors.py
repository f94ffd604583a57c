"""Error kinds of failed executions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts looked for in an error message, in this order, and their kinds.
ERROR_KINDS = [
    ("SQL compilation error", "syntax"),
    ("Object does not exist", "syntax"),
    ("does not exist or not authorized", "syntax"),
    ("Ambiguous column name", "syntax"),
    ("Window function not allowed", "syntax"),
    ("Unsupported subquery type", "syntax"),
    ("Binding error", "syntax"),
    ("syntax error", "syntax"),
    ("invalid identifier", "syntax"),
    ("unexpected", "syntax"),
    ("Expression type does not match column data type", "runtime"),
    ("Numeric value", "runtime"),
    ("division by zero", "runtime"),
    ("Division by zero", "runtime"),
    ("out of range", "runtime"),
    ("cannot convert", "runtime"),
    ("invalid value", "runtime"),
    ("timed out", "timeout"),
    ("statement timeout", "timeout"),
    ("query timeout", "timeout"),
    ("execution timeout", "timeout"),
    ("Insufficient privileges", "permission"),
    ("not authorized", "permission"),
    ("Access denied", "permission"),
]
OTHER_KIND = "runtime"
UNKNOWN_ERROR = "Unknown error"
NO_ERROR = "none"


def message_kind(message: Column) -> Column:
    """Kind of the first text found in the message, whatever its case."""
    low = F.lower(message)
    kinds = None
    for needle, kind in ERROR_KINDS:
        hit = low.contains(needle.lower())
        kinds = F.when(hit, kind) if kinds is None else kinds.when(hit, kind)
    return kinds.otherwise(OTHER_KIND)


def state_kind(state: Column) -> Column:
    """Kind by the class of an SQLSTATE, NULL where it says nothing."""
    return (
        F.when(state.startswith("42501"), "permission")
        .when(state.startswith("42"), "syntax")
        .when(state.startswith("22"), "runtime")
    )


def execution_kind(success: Column, message: Column, state: Column | None = None) -> Column:
    """``none`` for a success, else the kind by the SQLSTATE or by the message (empty reads as
    unknown)."""
    text = F.when(F.coalesce(message, F.lit("")) == "", UNKNOWN_ERROR).otherwise(message)
    kind = message_kind(text)
    if state is not None:
        kind = F.coalesce(state_kind(state), kind)
    return F.when(success, NO_ERROR).otherwise(kind)
