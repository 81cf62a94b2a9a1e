"""Trees grown over the slots a row has, against Spark's own learner and plain numpy."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tidemark.operators import tournament, wide_trees
from tidemark.operators.preprocessing import ModelSpec, fit_preprocessor
from tidemark.sources.sinks import fresh_path

SPEC = ModelSpec(numeric=("a", "b"), categories=("c",), target="y")
NAMED = {"featuresCol": "features", "labelCol": "y", "seed": 42}


@pytest.fixture(scope="module")
def coded(spark):
    rng = np.random.default_rng(8)
    # Few values of each number, so that both learners have the same thresholds.
    rows = [
        (float(a), float(b), f"c{c}", float(a * 2 + (b > 2) * 5 + (c % 7) + rng.normal()))
        for a, b, c in zip(rng.integers(0, 9, 900), rng.integers(0, 5, 900), rng.integers(0, 40, 900))
    ]
    df = spark.createDataFrame([*rows, *rows[:60]], "a double, b double, c string, y double").repartition(4)
    return fit_preprocessor(df, SPEC).transform(df).select("features", "y").cache()


@pytest.fixture
def wide(monkeypatch):
    monkeypatch.setattr(wide_trees, "MOST_CELLS", 0)


def predictions(model, df):
    return np.array([r[0] for r in model.transform(df).select("prediction").collect()])


@pytest.mark.parametrize("loss", ["squared", "absolute"])
def test_boosted_trees_are_those_of_spark(wide, coded, loss):
    grower = GBTRegressor(lossType=loss, maxIter=3, stepSize=0.3, maxDepth=3, **NAMED)
    ours, theirs = wide_trees.fit(grower, coded), grower.fit(coded)
    assert type(ours) is type(theirs) and ours.treeWeights == theirs.treeWeights
    assert [t.numNodes for t in ours.trees] == [t.numNodes for t in theirs.trees]
    assert predictions(ours, coded) == pytest.approx(predictions(theirs, coded), abs=1e-9)
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-9)


def test_forest_is_as_good_as_sparks(wide, coded):
    grower = RandomForestRegressor(numTrees=10, maxDepth=5, **NAMED)
    y = np.array([r[0] for r in coded.select("y").collect()])
    ours, theirs = (((predictions(m, coded) - y) ** 2).mean() for m in (wide_trees.fit(grower, coded), grower.fit(coded)))
    assert ours < 1.15 * theirs and ours < 0.5 * y.var()


def test_many_values_are_cut_at_quantiles(wide, spark):
    df = spark.range(3000).select((F.col("id") * 0.37 % 100).alias("a"), F.lit(1.0).alias("b"), (F.col("id") % 5).cast("string").alias("c"))
    df = df.withColumn("y", F.when(F.col("a") > 50, 10.0).otherwise(0.0))
    model = tournament.fit_model(df, GBTRegressor(maxIter=1, maxDepth=2, **NAMED), SPEC)
    error = model.transform(df).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert error < 0.2


def test_wide_models_are_saved_and_loaded(wide, spark, coded):
    made = tournament.make_candidates({"Absolute": {"kind": "median_gbt", "maxIter": 3, "maxDepth": 3, "subsamplingRate": 0.8}}, SPEC)
    model, path = made["Absolute"].fit(coded), fresh_path(spark, "wide")
    PipelineModel([model]).write().overwrite().save(path)
    assert predictions(PipelineModel.load(path), coded).tolist() == predictions(model, coded).tolist()


def test_wide_rows_leave_sparks_learner(monkeypatch, coded):
    """A row of 40 categories counts as one number per slot: 960 rows and 42 slots."""
    grower = GBTRegressor(maxIter=1, maxDepth=2, **NAMED)
    used = []
    monkeypatch.setattr(wide_trees._Learner, "fit", lambda self: used.append(self.slots))
    monkeypatch.setattr(wide_trees, "MOST_CELLS", 960 * 42)
    wide_trees.fit(grower, coded)
    assert not used
    monkeypatch.setattr(wide_trees, "MOST_CELLS", 960 * 42 - 1)
    wide_trees.fit(grower, coded)
    assert used == [42]
