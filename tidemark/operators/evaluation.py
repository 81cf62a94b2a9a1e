"""Regression metrics in original units, and the promotion gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import value_from_log

# Fixed values of the quality gate and of the challenger rule.
MAX_MAE = 3_500_000.0
MIN_R2 = 0.90
TOLERANCE = 1.05


def regression_metrics(
    df: DataFrame, actual_log: str, predicted_log: str = "prediction", by: tuple[str, ...] = ()
) -> DataFrame:
    """mae, rmse, r2 after undoing the log; predictions are floored at zero.

    One mergeable aggregate: the total spread comes from the population variance.
    """
    y = F.expm1(F.col(actual_log))
    error = y - value_from_log(F.col(predicted_log))
    spread = F.var_pop(y) * F.count(y)
    return df.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), spread)).alias("r2"),
    )


def promoted(new_mae: Column, current_mae: Column, tolerance: float = TOLERANCE) -> Column:
    """False only if an incumbent was scored and the new error is above its allowance."""
    return ~F.coalesce(new_mae > current_mae * tolerance, F.lit(False))


def passes_quality(mae: Column, r2: Column, max_mae: float = MAX_MAE, min_r2: float = MIN_R2) -> Column:
    return (mae <= max_mae) & (r2 >= min_r2)


def quality_gate(metrics: DataFrame, max_mae: float = MAX_MAE, min_r2: float = MIN_R2) -> DataFrame:
    return metrics.withColumn("passed", passes_quality(F.col("mae"), F.col("r2"), max_mae, min_r2))
