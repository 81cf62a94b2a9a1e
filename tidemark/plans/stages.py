"""The stages in their order, each written to a folder and read by the next ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Estimator
from pyspark.sql import DataFrame

from tidemark.config import Settings
from tidemark.operators.drift import DriftSpec, save_gate
from tidemark.operators.preprocessing import ModelSpec
from tidemark.operators.split import SplitSpec
from tidemark.operators.tournament import save_champion, save_leaderboard
from tidemark.plans.audit import drift_audit
from tidemark.plans.features import feature_windows, latest_window_stats
from tidemark.plans.serving import active_catalog, serving_features
from tidemark.plans.training import train
from tidemark.sources.raw import RawTables
from tidemark.sources.sinks import stage


def run_stages(
    raw: RawTables,
    out: str,
    settings: Settings = Settings(),
    candidates: Mapping[str, Estimator] | None = None,
    spec: ModelSpec = ModelSpec(),
    split: SplitSpec = SplitSpec(),
    drift: DriftSpec = DriftSpec(),
) -> dict[str, DataFrame]:
    """Features, serving tables, tournament, champion and drift gate, in ``out``.

    The champion is kept only if it beats the one that ``out`` holds from an earlier run.
    """
    spark = raw.players.sparkSession
    features = stage(feature_windows(raw, settings), "features", f"{out}/features")
    stats = stage(latest_window_stats(features, raw, settings), "stats", f"{out}/stats")
    catalog = stage(active_catalog(raw, settings), "catalog", f"{out}/catalog")
    serving = stage(serving_features(catalog, raw, stats, settings), "serving", f"{out}/serving")
    board, champion = train(features, candidates, spec, split, f"{out}/model")
    save_leaderboard(board, f"{out}/leaderboard")
    save_champion(spark, champion, f"{out}/model", f"{out}/champion")
    audit = drift_audit(features, champion.model, drift, split)
    gate = save_gate(audit.tests, f"{out}/gate")
    return {
        "features": features,
        "stats": stats,
        "catalog": catalog,
        "serving": serving,
        "leaderboard": board,
        "drift": audit.columns,
        "gate": gate,
    }
