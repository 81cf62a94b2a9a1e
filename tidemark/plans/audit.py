"""Drift audit: split a feature table in two periods, attach predictions, run the gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import value_from_log
from tidemark.operators.drift import (
    DriftSpec,
    column_drift,
    dataset_drift,
    drift_gate,
    gate_summary,
    target_drift,
)
from tidemark.operators.split import SplitSpec, label_periods
from tidemark.sources.sinks import stage


@dataclass
class Audit:
    columns: DataFrame
    dataset: DataFrame
    targets: DataFrame
    tests: DataFrame
    summary: DataFrame


def with_predictions(df: DataFrame, model, name: str = "prediction") -> DataFrame:
    """Predicted value in original units next to every row of both periods."""
    scored = model.transform(df)
    extra = [c for c in scored.columns if c not in df.columns and c != "prediction"]
    return scored.drop(*extra).withColumn(name, value_from_log(F.col("prediction")))


def drift_audit(
    features: DataFrame,
    model,
    spec: DriftSpec = DriftSpec(),
    split: SplitSpec = SplitSpec(),
    gate_method: str = "default",
) -> Audit:
    """All drift tables. The scored periods are staged once; scores are small."""
    periods = stage(with_predictions(label_periods(features, split), model), "drift_periods")
    configured = stage(column_drift(periods, spec, "configured"), "drift_columns")
    tests = stage(drift_gate(periods, spec, gate_method), "drift_tests")
    return Audit(
        columns=configured,
        dataset=dataset_drift(configured, spec.share_limit),
        targets=target_drift(periods, spec),
        tests=tests,
        summary=gate_summary(tests),
    )
