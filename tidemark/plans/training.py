"""Tournament over a feature table, end to end."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.ml import Estimator
from pyspark.sql import DataFrame

from tidemark.operators.preprocessing import ModelSpec
from tidemark.operators.split import SplitSpec, chronological_split, training_rows
from tidemark.operators.tournament import Champion, champion_of, crown, leaderboard, make_candidates
from tidemark.sources.sinks import stage


def training_table(features: DataFrame, spec: ModelSpec = ModelSpec()) -> DataFrame:
    return training_rows(
        features,
        "player_id",
        "valuation_date",
        "minutes_since_last_val",
        [*spec.numeric, *spec.categories, spec.target],
        tie=["prev_valuation_date"],
    )


def train(
    features: DataFrame,
    candidates: Mapping[str, Estimator] | None = None,
    spec: ModelSpec = ModelSpec(),
    split: SplitSpec = SplitSpec(),
    incumbent_path: str | None = None,
    parallelism: int = 1,
) -> tuple[DataFrame, Champion]:
    """(leaderboard, champion). The cleaned rows are staged once and split three ways."""
    candidates = make_candidates(spec=spec) if candidates is None else candidates
    rows = stage(training_table(features, spec), "training_rows")
    train_rows, val_rows, test_rows = chronological_split(rows, split)
    board = leaderboard(train_rows, val_rows, candidates, uuid.uuid4().hex, spec, parallelism)
    best = champion_of(board).first()
    if best is None or best["mae"] is None:
        raise ValueError("no candidate could be scored on the validation period")
    name = best["model"]
    return board, crown(train_rows, val_rows, test_rows, name, candidates[name], spec, incumbent_path)
