"""Newest, n-th newest and first-known values per key.

Every form is safe when one key holds a large share of the rows: either it is an
aggregate that combines map-side, or a ``row_number() <= k`` filter for which Spark
keeps at most k rows per key before the shuffle (WindowGroupLimit).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int = 1) -> DataFrame:
    """The first ``count`` rows per key in ``order``, ranked in column ``_rank``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= count)


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``. Also "drop duplicates, keep first"."""
    return newest_rows(df, keys, order).drop("_rank")


def newest_two(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]
) -> DataFrame:
    """Newest and second newest on one row: ``<c>_1`` and ``<c>_2`` (null if absent)."""
    ranked = newest_rows(df, keys, order, count=2)
    return ranked.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_rank") == rank, F.col(name))).alias(f"{name}_{rank}")
            for name in columns
            for rank in (1, 2)
        ]
    )


def value_at_newest(value: Column, *order: str) -> Column:
    """Aggregate: ``value`` on the newest row; ties go to the larger value."""
    return F.max_by(value, F.struct(*[F.col(c) for c in order], value.alias("_tie")))


def newest_known(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Per key and column, the newest value that is not null (not the newest row)."""
    return df.groupBy(*keys).agg(
        *[
            F.max_by(
                F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c)))
            ).alias(c)
            for c in columns
        ]
    )
