"""Boosting with median leaves against plain numpy over the same trees."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidemark.operators import absolute_loss, tournament
from tidemark.operators.preprocessing import ModelSpec
from tidemark.sources.sinks import fresh_path

SPEC = ModelSpec(numeric=("a", "b"), categories=("c",), target="y")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    # A third of all rows are the same, and residuals have a long tail.
    rows = [(float(a), float(b), "xyz"[i % 3], float(np.sin(a) * 3 + b + rng.pareto(1.5))) for i, (a, b) in enumerate(rng.normal(0, 2, (300, 2)))]
    return spark.createDataFrame(rows + [(0.5, 0.5, "x", 7.0)] * 150, "a double, b double, c string, y double").repartition(5).cache()


@pytest.fixture(scope="module")
def fitted(table):
    made = tournament.make_candidates({"Absolute": {"kind": "median_gbt", "maxIter": 20, "stepSize": 0.3, "maxDepth": 3}}, SPEC)
    return tournament.fit_model(table, made["Absolute"], SPEC)


def test_leaves_hold_medians_of_what_is_left(table, fitted):
    model = fitted.stages[-1]
    coded = PipelineModel(fitted.stages[:-1]).transform(table)
    rows = absolute_loss._leaf_numbers(model.grown, coded).select("y", "_leaf_numbers", *SPEC.numeric).collect()
    y, leaves = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    total = np.zeros(len(y))
    for t, weight in enumerate(model.grown.treeWeights):
        step = np.zeros(model.values.shape[1])
        for leaf in np.unique(leaves[:, t]):
            step[leaf] = np.median((y - total)[leaves[:, t] == leaf])
        assert model.values[t] == pytest.approx(step, abs=1e-9)
        total += weight * step[leaves[:, t]]
    got = {(r["a"], r["b"], r["y"]): r["prediction"] for r in fitted.transform(table).collect()}
    for r, p in zip(rows, total):
        assert got[r["a"], r["b"], r["y"]] == pytest.approx(p, abs=1e-9)


def test_medians_beat_the_grown_leaves(table, fitted):
    grown = tournament.fit_model(table, GBTRegressor(lossType="absolute", labelCol="y", maxIter=20, stepSize=0.3, maxDepth=3, seed=42), SPEC)
    error = [m.transform(table).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0] for m in (fitted, grown)]
    assert error[0] < error[1]


def test_saved_and_loaded(spark, table, fitted):
    path = fresh_path(spark, "absolute")
    fitted.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a, b = (sorted(r[0] for r in m.transform(table).select("prediction").collect()) for m in (fitted, loaded))
    assert a == b
    names = {r["name"] for r in tournament.feature_importances(loaded, SPEC).collect()}
    assert names <= {"a", "b", "c_x", "c_y", "c_z", "c_unknown"} and "a" in names


def test_rows_without_target_and_unreached_leaves(spark, table, fitted):
    model = fitted.stages[-1]
    coded = PipelineModel(fitted.stages[:-1]).transform(table)
    some = coded.filter("a > 0").withColumn("y", F.when(F.col("b") > 0, F.col("y")))
    values = absolute_loss.refit_leaves(model.grown, some, "y")
    assert values.shape == model.values.shape and np.isfinite(values).all() and (values == 0).any()
    assert model.transform(coded.limit(0)).count() == 0
