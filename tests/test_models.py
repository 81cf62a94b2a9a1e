"""Preprocessing, tournament, gates and scoring."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import evaluation, scoring, tournament
from tidemark.operators.preprocessing import ModelSpec, feature_names, fit_preprocessor
from tidemark.operators.split import SplitSpec
from tidemark.plans.audit import drift_audit
from tidemark.plans.training import train
from tidemark.sources import schemas
from tidemark.sources.sinks import fresh_path

SPEC = ModelSpec(numeric=("x", "flat"), categories=("c",), target="y")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), 4, "ab"[i % 2], float(x + (i % 2))) for i, x in enumerate(rng.normal(3, 2, 200))]
    return spark.createDataFrame([*rows, (None, 4, None, 3.0)], "x double, flat long, c string, y double")


def test_preprocessor(spark, table):
    model = fit_preprocessor(table, SPEC)
    assert feature_names(model, SPEC) == ["x", "flat", "c_a", "c_b", "c_unknown"]
    known = np.array([r["x"] for r in table.collect() if r["x"] is not None])
    filled = np.append(known, np.median(known))
    odd = spark.createDataFrame([(None, None, "zzz", 0.0), (5.0, 4, "b", 0.0)], table.schema)
    got = [r[0] for r in model.transform(odd).select(vector_to_array("features")).collect()]
    assert got[0] == pytest.approx([(np.median(known) - filled.mean()) / filled.std(), 0, 0, 0, 0])
    assert got[1] == pytest.approx([(5 - filled.mean()) / filled.std(), 0, 0, 1, 0])


def test_nan_is_a_missing_value(spark, table):
    holed = table.withColumn("x", F.when(F.col("x") > 4, float("nan")).otherwise(F.col("x")))
    plain = table.withColumn("x", F.when(F.col("x") > 4, None).otherwise(F.col("x")))
    a, b = ([r[0] for r in fit_preprocessor(df, SPEC).transform(holed).select(vector_to_array("features")).collect()] for df in (holed, plain))
    assert a == b and not any(math.isnan(v) for row in a for v in row)


def test_candidates_follow_the_config():
    made = tournament.make_candidates({"Only": {"kind": "forest", "numTrees": 5, "maxDepth": 12}})
    assert list(made) == ["Only"] and made["Only"].getNumTrees() == 5 and made["Only"].getSeed() == 42
    full = tournament.make_candidates()
    assert len(full) == 5 and full["GradientBoosting"].getMaxIter() == 200


def test_metrics_in_original_units(spark):
    rows = [(math.log1p(10), math.log1p(12)), (math.log1p(20), math.log1p(16)), (math.log1p(30), -5.0)]
    row = evaluation.regression_metrics(spark.createDataFrame(rows, "y double, prediction double"), "y").first()
    y, p = np.array([10, 20, 30.0]), np.array([12, 16, 0.0])
    assert row["mae"] == pytest.approx(np.abs(y - p).mean())
    assert row["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_gates(spark):
    def promoted(new, cur):
        return spark.range(1).select(evaluation.promoted(F.lit(new), F.lit(cur).cast("double"))).first()[0]

    assert promoted(105.0, 100.0) and not promoted(105.01, 100.0) and promoted(1e9, None)
    metrics = spark.createDataFrame([(3.5e6, 0.9), (3.5e6 + 1, 0.9), (1.0, 0.89)], "mae double, r2 double")
    assert [r["passed"] for r in evaluation.quality_gate(metrics).collect()] == [True, False, False]


def test_champion_is_the_first_of_the_lowest(spark):
    rows = [("r", 0, "a", "val", 2.0, 1.0, 0.1), ("r", 1, "b", "val", 1.0, 1.0, 0.1), ("r", 2, "c", "val", 1.0, 0.0, 0.9), ("r", 3, "d", "val", None, None, None)]
    board = spark.createDataFrame(rows, tournament.LEADERBOARD)
    assert tournament.champion_of(board).first()["model"] == "b"


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=int(i * 6))
        last = float(rng.normal(14, 1))
        rows.append((
            i, f"P{i}", day, day - dt.timedelta(days=100), int(math.expm1(last + 0.1)), int(math.expm1(last)),
            "ab"[i % 2], "cd"[i % 2], "left", f"Club {i % 3}", 20.0 + i % 10, 100 + i % 7, round(last, 4),
            round(last + 0.1 + 0.05 * (i % 2), 4), 900 + i % 100, i % 5, i % 90, 0.1 * (i % 9), 800, 0.2, True,
        ))
    return spark.createDataFrame(rows, schemas.FEATURES)


def test_training_end_to_end(spark, features):
    config = {
        "Forest": {"kind": "forest", "numTrees": 5, "maxDepth": 4},
        "Boosted": {"kind": "gbt", "lossType": "squared", "maxIter": 5, "maxDepth": 3},
    }
    candidates = tournament.make_candidates(config)
    board, champion = train(features, candidates, parallelism=2)
    rows = {r["model"]: r for r in board.collect()}
    assert set(rows) == set(config) and champion.name == min(rows, key=lambda n: rows[n]["mae"])
    assert champion.promoted and champion.metrics["r2"] > 0.3
    model_path, metrics_path = fresh_path(spark, "champion"), fresh_path(spark, "champion.json")
    assert tournament.save_champion(spark, champion, model_path, metrics_path)
    assert spark.read.json(metrics_path).first()["model_name"] == champion.name
    path = tournament.save_leaderboard(board, fresh_path(spark, "board"))
    assert spark.read.json(path).count() == 2

    loaded = PipelineModel.load(model_path)
    a = champion.model.transform(features).agg(F.sum("prediction")).first()[0]
    assert loaded.transform(features).agg(F.sum("prediction")).first()[0] == pytest.approx(a)
    scores = tournament.feature_importances(loaded).collect()
    assert scores[0]["name"] == "log_last_known_value" and sum(r["score"] for r in scores) == pytest.approx(1.0)

    spec = ModelSpec()
    gate = lambda mae, path: tournament.should_promote(spark, mae, features, path, spec)
    mine = evaluation.regression_metrics(loaded.transform(features), spec.target).first()["mae"]
    assert gate(mine * 1.04, model_path) and not gate(mine * 1.06, model_path)
    assert gate(1e12, fresh_path(spark, "missing"))  # an incumbent that fails to load

    audit = drift_audit(features, loaded, split=SplitSpec())
    assert audit.columns.count() == 13 and audit.targets.count() == 2
    assert audit.summary.first()["total_tests"] == 2


def profile(**kw):
    base = dict.fromkeys(schemas.SERVING.names, 0)
    base.update(
        player_id=1, player_name="Ann", image_url="", country_of_citizenship="X", club_name="Arsenal FC", position="Attack",
        sub_position="W", dominant_foot="left", age_at_valuation=20.0, target_market_value_eur=1000,
        current_market_value_eur=1000, prior_market_value_eur=800, days_between_valuations=100, window_minutes=900,
        goal_contributions_per_90=0.5, contrib_per_90_prior=0.25, minutes_since_last_val=700, minutes_prior_window=600,
    )
    return tuple({**base, **kw}[n] for n in schemas.SERVING.names)


ECHO = "log_last_known_value"


def test_scoring_single_and_keyed(spark):
    profiles = spark.createDataFrame([profile(), profile(player_id=2, age_at_valuation=46.0)], schemas.SERVING)
    model = scoring.FormulaModel(ECHO)
    ids = spark.createDataFrame([(1,), (2,), (3,)], "player_id long")
    scored, failed = scoring.score_ids(ids, profiles, model)
    rows = scored.collect()
    assert [r["player_id"] for r in rows] == [1]
    assert dict(map(tuple, failed.collect())) == {2: "age_at_valuation", 3: "unknown id"}
    assert rows[0]["log_market_value"] == 6.9088
    assert rows[0]["predicted_market_value_eur"] == round(math.expm1(6.9088), 2)
    assert (rows[0]["valuation_currency"], rows[0]["model_version"]) == ("EUR", "LightGBM-v6")
    assert [r["player_id"] for r in scoring.score_profiles(profiles, model)[1].collect()] == [2]
    valued, failed = scoring.page_valuation(profiles, model)
    assert [tuple(r) for r in failed.collect()] == [(2, "age_at_valuation")]
    page = valued.first()
    assert page["growth_eur"] == pytest.approx(page["predicted_market_value_eur"] - 800)
    assert page["growth_pct"] == pytest.approx(page["growth_eur"] / 800 * 100)


def test_version_label(spark):
    doc = spark.createDataFrame([(None, "Forest"), ("mine", "Forest"), (None, None)], "model_version string, model_name string")
    assert [r[0] for r in scoring.model_version(doc).collect()] == ["Forest-v6", "mine", "LightGBM-v6"]


def test_scenarios(spark):
    profiles = spark.createDataFrame([profile()], schemas.SERVING)
    rows = [
        (1, 1800, 4, None, None, None, "", None),  # defaults, own club
        (1, 89, 9, 9, 0, 0, "Chelsea FC", 365),  # too short for a rate
        (1, 4501, 0, 0, 0, 0, None, 180),
        (1, 100, 0, 0, 0, 0, None, 29),
        (7, 100, 0, 0, 0, 0, None, 180),
    ]
    scenarios = spark.createDataFrame(rows, schemas.SCENARIO_ROW)
    asked = scoring.with_defaults(scenarios, scoring.SCENARIO_DEFAULTS, schemas.SCENARIO_ROW)
    built = scoring.scenario_rows(profiles, asked.filter("player_id = 1")).orderBy("minutes_since_last_val").collect()
    assert [r["goal_contributions_per_90"] for r in built] == [0.0, 0.0, 0.2, 0.0]
    assert [r["club_name"] for r in built] == ["Chelsea FC", "Arsenal FC", "Arsenal FC", "Arsenal FC"]
    assert built[2]["age_at_valuation"] == pytest.approx(20 + 180 / 365.25)
    assert (built[2]["minutes_prior_window"], built[2]["contrib_per_90_prior"], built[2]["last_known_value_eur"]) == (700, 0.5, 1000.0)
    answers, rejected = scoring.simulate(profiles, scenarios, scoring.FormulaModel(f"{ECHO} + 0.1"))
    assert answers.count() == 2
    assert sorted(map(tuple, rejected.collect())) == [(1, "days_elapsed"), (1, "simulated_minutes"), (7, "unknown id")]
    row = answers.first()
    # The club may be left out altogether.
    told, _ = scoring.simulate(profiles, scenarios.drop("simulated_club").filter("simulated_goals = 4"), scoring.FormulaModel(ECHO))
    assert told.count() == 1
    assert row["value_change_pct"] == pytest.approx((row["predicted_market_value_eur"] - 1000) / 10, abs=0.01)


def test_what_if_defaults_and_overrides(spark):
    profiles = spark.createDataFrame([profile(), profile(player_id=2, window_minutes=0, target_market_value_eur=0)], schemas.SERVING)
    overrides = spark.createDataFrame([(1, 22.0, 900.0), (2, None, None)], "player_id long, sim_age double, sim_goals double")
    more = overrides.union(spark.createDataFrame([(1, 60.0, None), (8, None, None)], overrides.schema))
    answers, failed = scoring.what_if(profiles, more, scoring.FormulaModel(ECHO), 1e6)
    assert sorted(map(tuple, failed.collect())) == [(1, "age_at_valuation"), (8, "unknown id")]
    rows = {r["player_id"]: r for r in answers.collect()}
    assert len(rows) == answers.count() == 2
    assert rows[1]["goal_contributions_per_90"] == 4.0
    assert rows[2]["goal_contributions_per_90"] == 0.4  # (5 + 3) * 90 / 1800
    assert rows[2]["projected_eur"] == pytest.approx(5e6, rel=1e-4)
    assert rows[1]["low_eur"] == 0.0 and rows[1]["high_eur"] == pytest.approx(rows[1]["projected_eur"] + 1e6)


def test_payload_arrays(spark):
    row = (31.0, "Keeper", "Sweeper", "both", "Riverside", 1.2e6, 64, 411, None, None, None, None, None)
    old, poor = (99.0, *row[1:]), (*row[:5], -5.0, *row[6:])
    batches = spark.createDataFrame([("a", [row, old, poor, row]), ("b", [])], f"request_id string, players array<{schemas.SCORING_ROW.simpleString()}>")
    answers, failed = scoring.score_payloads(batches, scoring.FormulaModel(ECHO))
    assert sorted((r["request_id"], r["position_in_request"]) for r in answers.collect()) == [("a", 0), ("a", 3)]
    assert sorted(map(tuple, failed.collect())) == [("a", 1, "age_at_valuation"), ("a", 2, "last_known_value_eur")]
