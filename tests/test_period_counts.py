"""Drift from stored counts equals drift computed from all rows at once."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.operators import drift
from tidemark.operators.drift import DriftSpec
from tidemark.operators.period_counts import append_batch, compact, stored_counts, stored_drift

SPEC = DriftSpec(numeric=("x", "y"), categories=("c",), target="t")
SCHEMA = "month string, x double, y double, c string, t double, prediction double"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for i in range(1200):
        month = f"m{i % 4}"
        x = 7.0 if i % 3 == 0 else float(rng.normal(i % 4, 2))
        y = [None, float("nan"), float("inf"), float(rng.integers(0, 9))][min(i % 20, 3)]
        out.append((month, x, y, [None, "p", "q", "r"][int(rng.integers(0, 4))], 1.0, float(rng.random())))
    return out


def from_rows(df, reference, current):
    period = F.when(F.col("month").isin(*reference), "reference").when(F.col("month").isin(*current), "current")
    return drift.column_drift(df.withColumn("period", period).filter("period is not null"), SPEC)


def scores(df):
    return {r["column"]: (r["stattest"], pytest.approx(r["score"], abs=1e-9), r["detected"]) for r in df.collect()}


def test_any_periods_after_any_batches(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    store = str(tmp_path / "store")
    # A period may arrive in parts, and a batch again.
    for batch in (0, 1, 2, 1):
        append_batch(df.filter(F.pmod(F.xxhash64("x", "prediction"), F.lit(3)) == batch), store, batch, SPEC, period="month")
    append_batch(df.limit(0), store, 3, SPEC, period="month")
    for reference, current in ((["m0"], ["m1"]), (["m0", "m1"], ["m2", "m3"]), (["m3"], ["m0", "m1", "m2"])):
        assert scores(stored_drift(spark, store, reference, current, SPEC)) == scores(from_rows(df, reference, current))
    merged = str(tmp_path / "merged")
    compact(spark, store, merged)
    assert scores(stored_drift(spark, merged, ["m0"], ["m2"], SPEC)) == scores(from_rows(df, ["m0"], ["m2"]))
    assert stored_counts(spark, merged).filter("column = 't'").count() == 4


def test_counts_alone_are_read(spark, rows, tmp_path):
    store = str(tmp_path / "store")
    append_batch(spark.createDataFrame(rows, SCHEMA), store, 0, SPEC, period="month")
    counts = stored_counts(spark, store).filter("column = 'c'")
    assert counts.count() == 12 and counts.agg(F.sum("n")).first()[0] == sum(r[3] is not None for r in rows)
    plan = stored_drift(spark, store, ["m0"], ["m1"], SPEC)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan


def test_nothing_stored(spark, tmp_path):
    with pytest.raises(AnalysisException):
        stored_drift(spark, str(tmp_path / "none"), ["a"], ["b"], SPEC)
