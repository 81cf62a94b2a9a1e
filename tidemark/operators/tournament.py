"""Candidate regressors, their tournament, the champion and the leaderboard."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import wide_trees
from tidemark.operators.absolute_loss import MedianBoosting
from tidemark.operators.evaluation import TOLERANCE, promoted, regression_metrics
from tidemark.operators.preprocessing import ModelSpec, feature_names, fit_preprocessor
from tidemark.sources.sinks import append_records

log = logging.getLogger(__name__)

# Candidate name -> kind and parameters.
CANDIDATES: dict[str, dict[str, object]] = {
    "BoostedAbsolute": {"kind": "median_gbt", "maxIter": 250, "stepSize": 0.05, "maxDepth": 5},
    "BoostedAbsoluteDeep": {"kind": "median_gbt", "maxIter": 250, "stepSize": 0.05, "maxDepth": 6},
    "BoostedAbsoluteSampled": {
        "kind": "median_gbt", "maxIter": 250, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8,
    },
    "RandomForest": {"kind": "forest", "numTrees": 150, "maxDepth": 12},
    "GradientBoosting": {"kind": "gbt", "lossType": "squared", "maxIter": 200, "stepSize": 0.05, "maxDepth": 5},
}
SEED = 42

LEADERBOARD = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
    ]
)


def _median_boosting(**params) -> MedianBoosting:
    return MedianBoosting(GBTRegressor(lossType="absolute", **params))


def make_candidates(
    config: Mapping[str, Mapping[str, object]] = CANDIDATES,
    spec: ModelSpec = ModelSpec(),
) -> dict[str, Estimator]:
    """The configured regressors only.

    Kinds: ``gbt`` and ``forest`` are Spark's, ``median_gbt`` boosts the absolute loss and
    refits leaf values as medians.
    """
    kinds = {"gbt": GBTRegressor, "forest": RandomForestRegressor, "median_gbt": _median_boosting}
    out = {}
    for name, entry in config.items():
        params = dict(entry)
        out[name] = kinds[params.pop("kind")](
            featuresCol=spec.features,
            labelCol=spec.target,
            predictionCol=spec.prediction,
            seed=SEED,
            **params,
        )
    return out


def _metrics(df: DataFrame, spec: ModelSpec) -> dict[str, float]:
    return regression_metrics(df, spec.target, spec.prediction).first().asDict()


def leaderboard(
    train: DataFrame,
    val: DataFrame,
    candidates: Mapping[str, Estimator],
    run_id: str,
    spec: ModelSpec = ModelSpec(),
    parallelism: int = 1,
) -> DataFrame:
    """Fit each candidate on train, score it on validation; one row per candidate.

    The preprocessor is the same for all, so it is fitted once and train and validation
    are encoded and cached once. Fits are Spark jobs; ``parallelism`` overlaps them.
    """
    spark = train.sparkSession
    prep = fit_preprocessor(train, spec)
    keep = [spec.features, spec.target]
    coded = [prep.transform(df).select(*keep).persist(StorageLevel.MEMORY_AND_DISK) for df in (train, val)]

    def run(item: tuple[int, tuple[str, Estimator]]) -> tuple:
        place, (name, estimator) = item
        m = _metrics(wide_trees.fit(estimator, coded[0]).transform(coded[1]), spec)
        return run_id, place, name, "val", m["mae"], m["rmse"], m["r2"]

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            records = list(pool.map(run, enumerate(candidates.items())))
    finally:
        for df in coded:
            df.unpersist()
    return spark.createDataFrame(records, LEADERBOARD)


def champion_of(board: DataFrame) -> DataFrame:
    """The strictly lowest error; the earlier candidate wins a tie."""
    return board.orderBy(F.col("mae").asc_nulls_last(), "position").limit(1)


@dataclass
class Champion:
    name: str
    model: PipelineModel
    metrics: dict[str, float]
    promoted: bool


def fit_model(df: DataFrame, estimator: Estimator, spec: ModelSpec = ModelSpec()) -> PipelineModel:
    """Preprocessor and regressor as one saved-and-loaded unit."""
    prep = fit_preprocessor(df, spec)
    coded = prep.transform(df).select(spec.features, spec.target).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel([*prep.stages, wide_trees.fit(estimator, coded)])
    finally:
        coded.unpersist()


def should_promote(
    spark: SparkSession, new_mae: float, test: DataFrame, incumbent_path: str | None, spec: ModelSpec,
    tolerance: float = TOLERANCE,
) -> bool:
    """Challenger rule. No incumbent, or one that cannot be scored, means promotion."""
    if incumbent_path is None:
        return True
    try:
        current = PipelineModel.load(incumbent_path).transform(test)
        row = regression_metrics(current, spec.target, spec.prediction).select(
            promoted(F.lit(new_mae), F.col("mae"), tolerance).alias("ok")
        )
        return bool(row.first()["ok"])
    except Exception as err:  # the incumbent must never block a new champion by failing
        log.warning("incumbent could not be scored: %s", err)
        return True


def crown(
    train: DataFrame,
    val: DataFrame,
    test: DataFrame,
    name: str,
    estimator: Estimator,
    spec: ModelSpec = ModelSpec(),
    incumbent_path: str | None = None,
) -> Champion:
    """Retrain the winner on train and validation together, test it, apply the gate."""
    model = fit_model(train.unionByName(val), estimator, spec)
    metrics = _metrics(model.transform(test), spec)
    ok = should_promote(train.sparkSession, metrics["mae"], test, incumbent_path, spec)
    return Champion(name, model, metrics, ok)


def save_champion(spark: SparkSession, champion: Champion, model_path: str, metrics_path: str) -> bool:
    """Persist model and metrics document if promoted."""
    if not champion.promoted:
        return False
    champion.model.write().overwrite().save(model_path)
    m = champion.metrics
    # One document, one file: a single row by construction.
    spark.createDataFrame(
        [(champion.name, m["mae"], m["rmse"], m["r2"])],
        "model_name string, test_mae double, test_rmse double, test_r2 double",
    ).coalesce(1).write.mode("overwrite").json(metrics_path)
    return True


def save_leaderboard(board: DataFrame, path: str) -> str:
    return append_records(board, path)


def board_document(rows: DataFrame, run_id: str) -> DataFrame:
    """One run of saved leaderboard rows as the map that ``ranked_board`` takes."""
    scores = F.struct(F.col("mae").alias("val_mae"), F.col("rmse").alias("val_rmse"), F.col("r2").alias("val_r2"))
    entry = F.struct(F.col("model"), scores.alias("scores"))
    # As many entries as the run has candidates.
    return rows.filter(F.col("run_id") == run_id).agg(F.map_from_entries(F.collect_list(entry)).alias("entries"))


def ranked_board(metrics: DataFrame, champion: str, missing: float = 99999999.0) -> DataFrame:
    """Candidates by validation error (missing counts as very large), champion marked.

    ``metrics`` has a map column ``entries``: name -> {val_mae, val_rmse, val_r2}, in one
    document or spread over several rows.
    """
    rows = metrics.select(F.explode("entries").alias("name", "m"))
    return rows.select(
        "name",
        F.coalesce("m.val_mae", F.lit(missing)).alias("mae"),
        (F.col("name") == champion).alias("is_champion"),
    ).orderBy("mae", "name")


def feature_importances(model: PipelineModel, spec: ModelSpec = ModelSpec()) -> DataFrame:
    """(name, score) for every slot the regressor used."""
    spark = SparkSession.active()
    names = feature_names(model, spec)
    scores = model.stages[-1].featureImportances
    used = [(names[int(i)], float(v)) for i, v in zip(scores.indices, scores.values)]
    return spark.createDataFrame(used, "name string, score double").orderBy(F.col("score").desc(), "name")
