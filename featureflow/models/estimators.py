"""Models and their scores (M6-M9, A15): Spark ML estimators under task names."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.operators import aggs
from featureflow.operators.sampling import with_fold
from featureflow.session import remove_path, scratch_dir, stage, staged_path


def without_summary(model, df: DataFrame):
    """`model` without the summary of its training on `df`.

    A summary of two classes holds the session and goes into every task with the model. Once the session
    has made an Observation, it can't be sent, and the model scores no row. A written model has no summary.
    """
    if not model.hasSummary:
        return model
    path = f"{scratch_dir(df.sparkSession)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    out = type(model).load(path)
    remove_path(df.sparkSession, path)
    return out


class Forest(RandomForestClassifier):
    def _fit(self, dataset: DataFrame):
        return without_summary(super()._fit(dataset), dataset)


class Logistic(LogisticRegression):
    def _fit(self, dataset: DataFrame):
        return without_summary(super()._fit(dataset), dataset)


def boosted_classifier(y: str = "label", iterations: int = 20, depth: int = 5, seed: int = 0) -> GBTClassifier:
    """Binary classifier by boosted trees; the label is 0/1."""
    return GBTClassifier(labelCol=y, featuresCol="features", maxIter=iterations, maxDepth=depth, seed=seed)


def multiclass_classifier(y: str = "label", kind: str = "forest", trees: int = 40, depth: int = 8, seed: int = 0):
    """Classifier with class probabilities; the label is an index."""
    if kind == "forest":
        return Forest(labelCol=y, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return Logistic(labelCol=y, featuresCol="features", regParam=0.01)


def regressor(y: str = "label", kind: str = "boosted", iterations: int = 20, depth: int = 5, seed: int = 0):
    if kind == "boosted":
        return GBTRegressor(labelCol=y, featuresCol="features", maxIter=iterations, maxDepth=depth, seed=seed)
    return LinearRegression(labelCol=y, featuresCol="features", regParam=0.01)


def evaluator(scoring: str, y: str):
    """Evaluator for validation inside Spark ML; larger is better except for mse."""
    if scoring in ("mse", "r2"):
        return RegressionEvaluator(labelCol=y, metricName=scoring)
    if scoring == "roc_auc":
        return BinaryClassificationEvaluator(labelCol=y, metricName="areaUnderROC")
    if scoring == "f1":  # of class 1, as `score` has it
        return MulticlassClassificationEvaluator(labelCol=y, metricName="fMeasureByLabel", metricLabel=1.0)
    names = {"accuracy": "accuracy", "f1_weighted": "f1"}
    return MulticlassClassificationEvaluator(labelCol=y, metricName=names[scoring])


def score(pred: DataFrame, y: str, scoring: str) -> float:
    """One number from a frame with a `prediction` column."""
    if scoring == "roc_auc":
        return evaluator(scoring, y).evaluate(pred)
    kind = "regression" if scoring in ("mse", "r2") else "classification"
    p = pred.withColumns({"_y": F.col(y).cast("double"), "_p": F.col("prediction").cast("double")})
    value = aggs.metrics(p, "_y", "_p", kind=kind).first()[scoring]
    return float("nan") if value is None else value


def cross_validate(pipe, df: DataFrame, y: str, k: int = 3, scoring: str = "f1", key=None, seed: int = 0) -> DataFrame:
    """(fold, score): each fold is scored by a model fitted on the others."""
    folded = stage(with_fold(df, k, key, seed))
    rows = []
    for f in range(k):
        model = pipe.fit(folded.where(F.col("fold") != f))
        rows.append((f, float(score(model.transform(folded.where(F.col("fold") == f)), y, scoring))))
    remove_path(df.sparkSession, staged_path(folded))
    return df.sparkSession.createDataFrame(rows, "fold int, score double")


def as_pipeline(*stages) -> Pipeline:
    return Pipeline(stages=list(stages))
