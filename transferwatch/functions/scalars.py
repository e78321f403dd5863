"""Column functions: built-in expressions only, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the model-selection objective.
RECALL_WEIGHT = 0.6
F1_WEIGHT = 0.3
PRECISION_WEIGHT = 0.1

# Further layouts of the transfer time in text files.
TIME_FORMATS = ["yyyy/MM/dd HH:mm", "yyyy/MM/dd HH:mm:ss"]

# Fixed value: text a missing part takes inside a composite key.
MISSING_PART = "nan"


def parse_timestamp(column: str | Column) -> Column:
    """Timestamp from text in any of the known layouts, or from a zone-less timestamp.

    Unreadable text gives null.
    """
    value = F.col(column) if isinstance(column, str) else column
    readings = [F.try_to_timestamp(value.cast("string"), F.lit(f)) for f in TIME_FORMATS]
    return F.coalesce(value.try_cast("timestamp"), *readings)


def calendar_parts(time: str | Column) -> dict[str, Column]:
    """Day of month, hour and minute."""
    return {"day": F.dayofmonth(time), "hour": F.hour(time), "minute": F.minute(time)}


def epoch_seconds(time: str | Column) -> Column:
    """Whole seconds since the epoch, rounded down."""
    return F.unix_seconds(time)


def ratio(numerator: str | Column, denominator: str | Column, add: float) -> Column:
    """``numerator / (denominator + add)``; null where that denominator is 0."""
    top = F.col(numerator) if isinstance(numerator, str) else numerator
    bottom = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.try_divide(top, bottom + F.lit(add))


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double; null where ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def as_flag(condition: Column) -> Column:
    """1 where the condition holds; 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def or_zero(value: Column) -> Column:
    """``value``, or 0 where it is missing."""
    return F.coalesce(value, F.lit(0.0))


def composite_key(*columns: str | Column) -> Column:
    """Columns joined by ``_`` as text; a missing part is written out, so it counts as a value."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit(MISSING_PART)) for p in parts])


def exact_key(*columns: str | Column) -> Column:
    """One text per combination of values: parts carry their length, a missing part is ``-``."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    marked = [F.coalesce(F.concat(F.length(p), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.concat(*marked)


def to_number(column: str | Column) -> Column:
    """Text as a double; 0 where it is no number or missing."""
    value = F.col(column) if isinstance(column, str) else column
    number = value.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(0.0))


def objective(precision: Column, recall: Column, f1: Column) -> Column:
    """Score by which models are compared; finding laundering counts most."""
    return RECALL_WEIGHT * recall + F1_WEIGHT * f1 + PRECISION_WEIGHT * precision
