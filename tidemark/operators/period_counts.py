"""Drift over arriving periods from stored value counts, without reading old rows again.

Each arriving batch is reduced to how often each value of each column occurs in each of its
periods and written under ``counts/batch=<n>``; writing a batch again replaces it. Counts of
any batches and periods add up, so a distance between any two sets of periods is computed
from counts alone: their number grows with distinct values, not with rows. ``compact`` merges
all batches so far into one.

Null and NaN are not counted, as in ``operators.drift``, whose scores these equal. A batch
without rows adds nothing. Before the first batch there is nothing to read, which raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import drift
from tidemark.operators.drift import DriftSpec
from tidemark.operators.ordered import melt

SCHEMA = "batch int, period string, column string, number double, word string, n bigint"


def value_counts(df: DataFrame, numeric: Sequence[str], categories: Sequence[str], period: str = "period") -> DataFrame:
    """period, column, number or word, and n: one row for each value that occurs."""
    named = df.withColumn("period", F.col(period).cast("string"))
    numbers = melt(named, ["period"], numeric, "double").filter("value is not null and not isnan(value) and abs(value) != double('infinity')")
    words = melt(named, ["period"], categories, "string").filter("value is not null")
    none = {"double": F.lit(None).cast("double"), "string": F.lit(None).cast("string")}
    both = []
    if numeric:
        both.append(numbers.select("period", "column", F.col("value").alias("number"), none["string"].alias("word")))
    if categories:
        both.append(words.select("period", "column", none["double"].alias("number"), F.col("value").alias("word")))
    rows = both[0] if len(both) == 1 else both[0].unionByName(both[1])
    return rows.groupBy("period", "column", "number", "word").agg(F.count(F.lit(1)).alias("n"))


def append_batch(df: DataFrame, path: str, batch: int, spec: DriftSpec = DriftSpec(), period: str = "period") -> None:
    """Counts of one arriving batch; of its target and prediction as well."""
    counts = value_counts(df, (spec.target, spec.prediction, *spec.numeric), spec.categories, period)
    counts.write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")


def stored_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/counts")


def compact(spark: SparkSession, path: str, into: str, batch: int = 0) -> None:
    """All batches of one store as one batch of another."""
    whole = stored_counts(spark, path).groupBy("period", "column", "number", "word").agg(F.sum("n").alias("n"))
    whole.write.mode("overwrite").parquet(f"{into}/counts/batch={batch}")


def _weights(reference: Sequence[str], current: Sequence[str]) -> list[Column]:
    def total(periods: Sequence[str], name: str) -> Column:
        return F.sum(F.when(F.col("period").isin(*periods), F.col("n")).otherwise(0)).alias(name)

    return [total(reference, "n_ref"), total(current, "n_cur")]


def stored_drift(
    spark: SparkSession, path: str, reference: Sequence[str], current: Sequence[str], spec: DriftSpec = DriftSpec()
) -> DataFrame:
    """The configured column drift between two sets of periods; they may share periods."""
    rows = stored_counts(spark, path).filter(F.col("period").isin(*reference, *current))
    weights = _weights(reference, current)
    numbers = rows.filter(F.col("column").isin(*spec.numeric)).groupBy("column", F.col("number").alias("value")).agg(*weights)
    words = rows.filter(F.col("column").isin(*spec.categories)).groupBy("column", F.col("word").alias("value")).agg(*weights)
    return drift.wasserstein_of_counts(numbers, spec.numeric, drift.spread_of_counts(numbers), spec.numeric_limit).unionByName(
        drift.psi_of_counts(words, spec.psi_limit)
    )
