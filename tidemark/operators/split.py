"""Chronological splits measured back from the newest date."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import months_before
from tidemark.operators.latest import newest_per_key


@dataclass(frozen=True)
class SplitSpec:
    date: str = "valuation_date"
    val_months: int = 12
    test_months: int = 12


def _starts(df: DataFrame, spec: SplitSpec) -> tuple[Column, Column]:
    """(validation start, test start) as scalar subqueries: no join, no collect."""
    newest = F.max(F.col(spec.date).cast("date"))
    test_start = months_before(newest, spec.test_months)
    # The second step starts from the first one's result, so month ends clip twice.
    val_start = months_before(test_start, spec.val_months)
    return df.agg(val_start.alias("d")).scalar(), df.agg(test_start.alias("d")).scalar()


def label_split(df: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """Adds ``split``: train, val or test."""
    val_start, test_start = _starts(df, spec)
    day = F.col(spec.date).cast("date")
    return df.withColumn(
        "split",
        F.when(day < val_start, "train").when(day < test_start, "val").otherwise("test"),
    )


def training_rows(
    df: DataFrame, key: str, date: str, positive: str, required: Sequence[str], tie: Sequence[str] = ()
) -> DataFrame:
    """One row per (entity, date), some activity, and no null in a required column."""
    order = [F.col(c).asc_nulls_last() for c in (tie or [positive])]
    first = newest_per_key(df, [key, date], order)
    present = [c for c in required if c in first.columns]
    return first.filter(F.col(positive) > 0).dropna(subset=present)


def chronological_split(
    df: DataFrame, spec: SplitSpec = SplitSpec()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, val, test). Stage or cache ``df`` first: each part scans it."""
    labelled = label_split(df, spec)
    return tuple(
        labelled.filter(F.col("split") == name).drop("split") for name in ("train", "val", "test")
    )


def label_periods(df: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """Adds ``period``: reference (before validation) or current (test); drops the gap."""
    renamed = F.when(F.col("split") == "train", "reference").otherwise("current")
    return (
        label_split(df, spec)
        .filter(F.col("split") != "val")
        .withColumn("period", renamed)
        .drop("split")
    )


def reference_current_split(
    df: DataFrame, spec: SplitSpec = SplitSpec()
) -> tuple[DataFrame, DataFrame]:
    labelled = label_periods(df, spec)
    return tuple(
        labelled.filter(F.col("period") == name).drop("period") for name in ("reference", "current")
    )
