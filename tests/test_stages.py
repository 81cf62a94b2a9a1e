"""All stages in their order, over the small tables."""

from pyspark.ml import PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

from tidemark.operators.ordered import exact_quantile, melt
from tidemark.operators.preprocessing import ModelSpec
from tidemark.plans.stages import run_stages
from tidemark.registry import standin
from tidemark.sources.sinks import fresh_path

SMALL = "/root/testdata/sf0.001"


def test_all_stages_twice(spark):
    spec = ModelSpec()
    named = {"featuresCol": spec.features, "labelCol": spec.target, "predictionCol": spec.prediction}
    candidates = {"Mean": DecisionTreeRegressor(maxDepth=0, **named), "Line": LinearRegression(regParam=0.1, **named)}
    raw, out = standin.raw_tables(spark, SMALL), fresh_path(spark, "all")
    made = run_stages(raw, out, standin.SETTINGS, candidates)
    assert made["features"].count() > 0 and made["serving"].count() == made["catalog"].count() > 0
    assert {r["model"] for r in made["leaderboard"].collect()} == {"Mean", "Line"}
    gate = made["gate"].first()
    assert gate["total_tests"] == 2 == sum(gate["by_status"].values())
    first = spark.read.json(f"{out}/champion").first()["model_name"]
    run_stages(raw, out, standin.SETTINGS, candidates)
    assert spark.read.json(f"{out}/leaderboard").count() == 4
    assert spark.read.json(f"{out}/champion").first()["model_name"] == first
    assert "prediction" in PipelineModel.load(f"{out}/model").transform(made["features"].dropna()).columns


def test_more_columns_than_cuts_fit(spark, monkeypatch):
    from tidemark.operators import ordered

    monkeypatch.setattr(ordered, "MOST_CUTS", 130)
    df = spark.range(101).selectExpr(*[f"CAST(id * {k} AS DOUBLE) AS c{k}" for k in range(1, 8)])
    names = df.columns
    got = exact_quantile(melt(df, [], names, "double"), ["column"], "value", 0.5, "m", "column", names)
    assert {r["column"]: r["m"] for r in got.collect()} == {f"c{k}": 50.0 * k for k in range(1, 8)}
