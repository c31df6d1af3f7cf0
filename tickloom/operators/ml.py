"""Model training, scoring and evaluation on pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import neutral_band


def classification_metrics(rows: DataFrame) -> DataFrame:
    """(accuracy, weighted_f1) of labels y and predictions p, 0 or 1; null labels are passed over."""
    y, p = F.col("y"), F.col("p")
    f1, support = [], []
    for c in (0, 1):
        n = F.count_if(y == c)
        support.append(n)
        f1.append(F.coalesce(F.try_divide(F.count_if((y == c) & (p == c)) * 2.0, n + F.count_if(p == c)), F.lit(0.0)) * n)
    return rows.where(y.isNotNull()).agg(F.avg(F.when(y == p, 1.0).otherwise(0.0)).alias("accuracy"), F.try_divide(f1[0] + f1[1], support[0] + support[1]).alias("weighted_f1"))


def regression_metrics(rows: DataFrame) -> DataFrame:
    error = F.col("y") - F.col("p")
    return rows.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"))


def directional_accuracy(up: Column, move: Column, threshold: float) -> tuple[Column, Column]:
    """(moves, share foreseen) as aggregates; only moves of at least `threshold` count."""
    counts = F.abs(move) >= threshold
    right = F.count_if(counts & (up == (move > 0)))
    return F.count_if(counts), F.try_divide(right.cast("double"), F.count_if(counts))


def train_gbt(rows: DataFrame, features: Sequence[str], label: str = "label", trees: int = 20, depth: int = 4, weight: float = 1.0, seed: int = 7):
    """A pipeline model of gradient-boosted trees; the positive class weighs `weight`. Rows without a label are passed
    over. It is saved and loaded as any PipelineModel."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    data = rows.where(F.col(label).isNotNull()).withColumn("_weight", F.when(F.col(label) == 1, weight).otherwise(1.0))
    tree = GBTClassifier(featuresCol="_features", labelCol=label, weightCol="_weight", maxIter=trees, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=[*features], outputCol="_features"), tree]).fit(data)


def train_gbt_regressor(rows: DataFrame, features: Sequence[str], label: str = "label", trees: int = 20, depth: int = 4, seed: int = 7):
    """As `train_gbt`, for a number: a forward return. Predictions are in the column `prediction`."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    tree = GBTRegressor(featuresCol="_features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=[*features], outputCol="_features"), tree]).fit(rows.where(F.col(label).isNotNull()))


def predict(model, rows: DataFrame, out: str = "confidence") -> DataFrame:
    """`rows` with the probability of the positive class, the neutral band taken as 0.5."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows).withColumn(out, neutral_band(vector_to_array("probability")[1]))
    return scored.drop("_features", "rawPrediction", "probability", "prediction")


def importances(model, features: Sequence[str]) -> dict[str, float]:
    return dict(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True))
