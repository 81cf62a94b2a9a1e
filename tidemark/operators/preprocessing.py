"""Fitted preprocessing: median fill and standardising, constant fill and one-hot.

Fitting yields an ordinary ``PipelineModel`` of built-in stages, so it is saved, loaded
and applied like any Spark ML model, in batch and on streams.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import CATEGORY_INPUTS, NUMERIC_INPUTS, TARGET
from tidemark.operators.ordered import exact_quantile, melt

UNKNOWN = "unknown"


@dataclass(frozen=True)
class ModelSpec:
    numeric: tuple[str, ...] = NUMERIC_INPUTS
    categories: tuple[str, ...] = CATEGORY_INPUTS
    target: str = TARGET
    features: str = "features"
    prediction: str = "prediction"


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, median): exact, without holding a column in one buffer; NaN is a missing value."""
    melted = melt(df, [], columns, "double").filter(~F.isnan("value"))
    return exact_quantile(melted, ["column"], "value", 0.5, "median", "column", columns)


def moments(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    """(column, mean, std): after filling nulls and NaN, with the population deviation."""
    filled = df.select(
        [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(v)).alias(c) for c, v in fills.items()]
    )
    row = filled.agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in fills]
    )
    return row.unpivot([], list(fills), "column", "m").select("column", "m.mean", "m.std")


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """column -> (median, mean, std). Only one row per column reaches the driver."""
    if not columns:
        return {}
    found = {r["column"]: r["median"] for r in medians(df, columns).collect()}
    fills = {c: float(found.get(c) or 0.0) for c in columns}
    spread = {r["column"]: (r["mean"], r["std"]) for r in moments(df, fills).collect()}
    return {c: (fills[c], spread[c][0] or 0.0, spread[c][1] or 0.0) for c in columns}


def _double(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _scaled_sql(name: str, stats: tuple[float, float, float]) -> str:
    median, mean, std = stats
    # A constant column is centred only.
    return (
        f"(coalesce(nanvl(CAST(`{name}` AS DOUBLE), CAST(NULL AS DOUBLE)), {_double(median)}) - {_double(mean)})"
        f" / {_double(std or 1.0)} AS `{name}__scaled`"
    )


def fit_preprocessor(df: DataFrame, spec: ModelSpec = ModelSpec()) -> PipelineModel:
    """Numeric block, then one-hot block, assembled into ``spec.features``.

    Categories are ordered alphabetically; an unseen one scores as all zeros (the
    encoder's dropped last slot is the indexer's bucket for unseen values). The encoder
    is as wide as the column has categories.
    """
    stats = numeric_stats(df, spec.numeric)
    scaled = [_scaled_sql(c, stats[c]) for c in spec.numeric]
    filled = [f"coalesce(`{c}`, '{UNKNOWN}') AS `{c}__filled`" for c in spec.categories]
    prepare = SQLTransformer(statement=f"SELECT *, {', '.join(scaled + filled)} FROM __THIS__")
    if not spec.categories:
        numbers = VectorAssembler(inputCols=[f"{c}__scaled" for c in spec.numeric], outputCol=spec.features)
        return PipelineModel([prepare, numbers])
    prepared = prepare.transform(df)
    indexer = StringIndexer(
        inputCols=[f"{c}__filled" for c in spec.categories],
        outputCols=[f"{c}__index" for c in spec.categories],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    ).fit(prepared)
    encoder = OneHotEncoder(
        inputCols=[f"{c}__index" for c in spec.categories],
        outputCols=[f"{c}__onehot" for c in spec.categories],
        handleInvalid="error",
        dropLast=True,
    ).fit(indexer.transform(prepared))
    assembler = VectorAssembler(
        inputCols=[f"{c}__scaled" for c in spec.numeric] + [f"{c}__onehot" for c in spec.categories],
        outputCol=spec.features,
    )
    return PipelineModel([prepare, indexer, encoder, assembler])


def feature_names(preprocessor: PipelineModel, spec: ModelSpec = ModelSpec()) -> list[str]:
    """Name of each slot of the assembled vector."""
    labels = preprocessor.stages[1].labelsArray if spec.categories else []
    onehot = [f"{c}_{v}" for c, values in zip(spec.categories, labels) for v in values]
    return list(spec.numeric) + onehot
