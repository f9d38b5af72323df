"""Boosted trees and robust linear models of Spark ML on feature arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.session import settled


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without a missing feature."""
    return df.where(~F.exists("features", lambda v: v.isNull() | F.isnan(v)))


def with_vector(df: DataFrame) -> DataFrame:
    return df.withColumn("_vector", array_to_vector("features"))


@dataclass(frozen=True)
class SparkModel:
    """A fitted Spark ML model; rows with a missing feature get no prediction."""

    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        unknown = F.exists("features", lambda v: v.isNull() | F.isnan(v))
        filled = F.when(unknown, F.transform("features", lambda v: F.lit(0.0))).otherwise(F.col("features"))
        scored = self.model.transform(df.withColumn("_vector", array_to_vector(filled)))
        return scored.withColumn("pred", F.when(~unknown, F.col("_pred"))).drop("_vector", "_pred")

    def importances(self, names: list[str]) -> DataFrame:
        values = self.model.featureImportances.toArray()
        from pyspark.sql import SparkSession

        rows = [(n, float(v)) for n, v in zip(names, values)]
        return SparkSession.active().createDataFrame(rows, "feature string, importance double")

    def staged_loss(self, df: DataFrame, loss: str) -> list[float]:
        scored = with_vector(complete_rows(df)).withColumnRenamed("y", "label")
        return list(self.model.evaluateEachIteration(scored.select("_vector", "label"), loss))


def _training_table(df: DataFrame) -> DataFrame:
    known = complete_rows(df.where(F.col("y").isNotNull()))
    return settled(with_vector(known).select("_vector", F.col("y").cast("double").alias("label")))


@dataclass(frozen=True)
class BoostedTrees:
    """Gradient boosting; the defaults are the reference run, queries pass smaller sizes."""

    loss: str = "absolute"
    trees: int = 2000
    depth: int = 6
    rate: float = 0.02
    min_leaf: int = 9
    max_features: str = "30"
    subsample: float = 1.0
    seed: int = 1

    def fit(self, df: DataFrame) -> SparkModel:
        learner = GBTRegressor(
            featuresCol="_vector", labelCol="label", predictionCol="_pred", lossType=self.loss,
            maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, minInstancesPerNode=self.min_leaf,
            featureSubsetStrategy=self.max_features, subsamplingRate=self.subsample, seed=self.seed,
        )
        return SparkModel(learner.fit(_training_table(df)))


@dataclass(frozen=True)
class Forest:
    trees: int = 50
    depth: int = 6
    seed: int = 1

    def fit(self, df: DataFrame) -> SparkModel:
        learner = RandomForestRegressor(
            featuresCol="_vector", labelCol="label", predictionCol="_pred", numTrees=self.trees, maxDepth=self.depth, seed=self.seed
        )
        return SparkModel(learner.fit(_training_table(df)))


@dataclass(frozen=True)
class Huber:
    """Robust linear regression; Spark ML has no boosted trees with this loss."""

    iterations: int = 100
    penalty: float = 0.0

    def fit(self, df: DataFrame) -> SparkModel:
        learner = LinearRegression(
            featuresCol="_vector", labelCol="label", predictionCol="_pred", loss="huber", maxIter=self.iterations, regParam=self.penalty
        )
        return SparkModel(learner.fit(_training_table(df)))
