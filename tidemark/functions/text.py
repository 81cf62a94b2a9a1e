"""Text and nested-value expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def capitalize(x: Column) -> Column:
    """First letter upper, the rest lower (``initcap`` would raise every word)."""
    return F.concat(F.upper(x.substr(1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))


def is_web_address(x: Column) -> Column:
    return F.coalesce(x.startswith("http"), F.lit(False))


def matches_whole(x: Column, pattern: str) -> Column:
    """True where the pattern matches the whole text."""
    return x.rlike(f"^(?:{pattern})$")


def rows_of(df: DataFrame, array_column: str) -> DataFrame:
    """One row per struct of an array column, fields as columns."""
    return df.select(F.inline(F.col(array_column)))


def entries_of(df: DataFrame, map_column: str, name: str = "name", value: str = "value") -> DataFrame:
    """One row per map entry."""
    return df.select(F.explode(F.col(map_column)).alias(name, value))
