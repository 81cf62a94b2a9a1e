"""Lenient casts: a bad value becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed pattern: what counts as a number in text (no trailing type letters).
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def long_from_text(x: Column) -> Column:
    """Integer text stays exact; fractional text rounds half away from zero."""
    text = F.when(x.rlike(NUMBER_TEXT), x)
    fraction = F.round(text.try_cast("double"))
    return F.coalesce(text.try_cast("bigint"), fraction.try_cast("bigint"))


def long_from_double(x: Column) -> Column:
    """Doubles round to the nearest even integer."""
    return F.rint(x).try_cast("bigint")


def lenient_long(df: DataFrame, name: str) -> Column:
    """Long value of ``name``, by the rule of its type in ``df``."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return long_from_text(F.col(name))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return long_from_double(F.col(name).cast("double"))
    return F.col(name).try_cast("bigint")


def strict_date(x: Column) -> Column:
    """Date of a date, timestamp or text; bad text raises under ANSI mode."""
    return x.cast("date")
