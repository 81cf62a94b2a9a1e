"""Boosting for the absolute loss with leaf values refitted as exact medians.

Spark's boosting follows the sign of the residuals, but a leaf then takes their mean, a
number between -1 and 1 whatever the residuals' size. The value that lowers the absolute
loss most is the median of the residuals in the leaf. So the trees are grown by Spark and
their leaf values refitted in order: for each tree the exact median of what is left, per
leaf, by the distributed quantiles of ``ordered`` (a leaf may hold any share of the rows),
then the tree's share of it is taken off.

Only medians reach the driver: one number per leaf. Rows keep their leaf numbers and the
running prediction, which is written every few trees, so lost executors cost little.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import wide_trees
from tidemark.operators.ordered import exact_quantile
from tidemark.sources.sinks import stage

TREES_PER_STAGE = 16
_LEAVES = "_leaf_numbers"


def _leaf_numbers(model: GBTRegressionModel, df: DataFrame) -> DataFrame:
    """df with the number of the leaf of every tree."""
    marked = model.copy().setLeafCol(_LEAVES).setPredictionCol("_grown")
    return marked.transform(df).drop("_grown").withColumn(_LEAVES, vector_to_array(_LEAVES).cast("array<int>"))


def refit_leaves(model: GBTRegressionModel, df: DataFrame, target: str) -> np.ndarray:
    """Median of the remaining residual for each tree (row) and leaf (column), in boosting order.

    A leaf that no row of df reaches keeps the value 0; rows without a target are left out.
    """
    rows = _leaf_numbers(model, df.filter(F.col(target).isNotNull()))
    rows = stage(rows.select(F.col(target).alias("_y"), _LEAVES, F.lit(0.0).alias("_f")), "leaves")
    widths = [tree.numNodes // 2 + 1 for tree in model.trees]
    values = np.zeros((len(widths), max(widths, default=1)))
    for t, weight in enumerate(model.treeWeights):
        left = rows.select(F.get(F.col(_LEAVES), t).alias("leaf"), (F.col("_y") - F.col("_f")).alias("left"))
        # As many rows as the tree has leaves.
        for row in exact_quantile(left, ["leaf"], "left", 0.5, "median").collect():
            values[t, row["leaf"]] = row["median"]
        step = F.get(F.lit(weight * values[t]), F.get(F.col(_LEAVES), t))
        rows = rows.withColumn("_f", F.col("_f") + step)
        if t % TREES_PER_STAGE == TREES_PER_STAGE - 1:
            rows = stage(rows, "leaves")
    return values


def _prediction(values: np.ndarray, weights: list[float]) -> Column:
    """Weighted sum of the leaf values a row falls into."""
    width = values.shape[1]
    flat = F.lit((values * np.array(weights)[:, None]).ravel())
    steps = F.transform(F.col(_LEAVES), lambda leaf, t: F.get(flat, t * width + leaf))
    return F.aggregate(steps, F.lit(0.0), lambda total, step: total + step)


class MedianBoosting(Estimator):
    """A GBTRegressor whose leaf values are refitted as medians."""

    def __init__(self, grower: GBTRegressor):
        super().__init__()
        self.grower = grower

    def _fit(self, df: DataFrame) -> MedianBoostingModel:
        grown = wide_trees.fit(self.grower, df)
        return MedianBoostingModel(grown, refit_leaves(grown, df, self.grower.getLabelCol()))


class MedianBoostingModel(Model, MLWritable, MLReadable):
    """Grown trees and their refitted leaf values; saved and loaded like any Spark model."""

    def __init__(self, grown: GBTRegressionModel | None = None, values: np.ndarray | None = None):
        super().__init__()
        self.grown, self.values = grown, values

    @property
    def featureImportances(self):
        return self.grown.featureImportances

    def _transform(self, df: DataFrame) -> DataFrame:
        out = _leaf_numbers(self.grown, df)
        name = self.grown.getPredictionCol()
        return out.withColumn(name, _prediction(self.values, list(self.grown.treeWeights))).drop(_LEAVES)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: MedianBoostingModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        self.model.grown.write().save(f"{path}/grown")
        rows = [(t, row.tolist()) for t, row in enumerate(self.model.values)]
        # One row per tree: a small table by construction.
        spark.createDataFrame(rows, "tree int, medians array<double>").coalesce(1).write.parquet(f"{path}/values")


class _Reader(MLReader):
    def load(self, path: str) -> MedianBoostingModel:
        spark = self.sparkSession
        DefaultParamsReader.loadMetadata(path, spark)
        rows = spark.read.parquet(f"{path}/values").orderBy("tree").collect()
        return MedianBoostingModel(GBTRegressionModel.load(f"{path}/grown"), np.array([r["medians"] for r in rows]))
