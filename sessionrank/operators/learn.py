"""Cross-fitted boosted trees on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionrank.operators.dataset import encode, positive_sessions
from sessionrank.settings import stage


def _features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature vector of the cleaned columns; NULL becomes -1."""
    names = [f"_f{i}" for i in range(len(features))]
    copy = df.withColumns({n: F.col(c) for n, c in zip(names, features)})
    clean = encode(copy, [], names)
    return VectorAssembler(inputCols=names, outputCol="_x").transform(clean).drop(*names)


def _fit(rows: DataFrame, label: str, n_iter: int, params: dict | None) -> Model:
    settings = {"maxDepth": 5, "stepSize": 0.1, "seed": 0, **(params or {})}
    ready = rows.select("_x", F.col(label).cast("double").alias("_y"))
    return GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=n_iter, **settings).fit(ready)


def fit_all(df: DataFrame, features: Sequence[str], label: str, n_iter: int = 20, params: dict | None = None) -> Model:
    """One model on all rows with a fixed number of rounds.

    Boosting reads its rows in every round, so they are written once in assembled form.
    """
    return _fit(stage(_features(df, features).select("_x", label)), label, n_iter, params)


def _score(model: Model, rows: DataFrame, name: str) -> DataFrame:
    shown = model.transform(rows)
    extra = ("rawPrediction", "probability", "prediction")
    return shown.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop(*extra)


def cross_fit(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    n_folds: int = 5,
    params: dict | None = None,
    n_iter: int = 20,
    fold: str = "fold",
    only_positive_sessions: bool = False,
) -> tuple[list[Model], DataFrame]:
    """A model per fold on the other folds, and the score of every row by the model that did
    not see its session, as (session, aid, pred).

    ``only_positive_sessions`` trains on sessions with a positive candidate; all are scored. Fold numbers
    from ``n_folds`` up count from 0 again and NULL is 0, so that every row has a model that leaves it out.
    """
    number = F.coalesce(F.pmod(F.col(fold).cast("long"), F.lit(n_folds)), F.lit(0)).alias(fold)
    rows = stage(_features(df, features).select("session", "aid", number, label, "_x"))
    models, parts = [], []
    for i in range(n_folds):
        train = rows.where(F.col(fold) != i)
        if only_positive_sessions:
            train = positive_sessions(train, label)
        model = _fit(train, label, n_iter, params)
        models.append(model)
        parts.append(_score(model, rows.where(F.col(fold) == i), "pred").select("session", "aid", "pred"))
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return models, oof


def add_oof(df: DataFrame, oof: DataFrame, name: str) -> DataFrame:
    """Add an earlier model's out-of-fold score as a feature of the next one."""
    return df.join(oof.select("session", "aid", F.col("pred").alias(name)), ["session", "aid"], "left")


def predict_mean(models: Sequence[Model], df: DataFrame, features: Sequence[str], name: str = "pred") -> DataFrame:
    """Mean score of the fold models."""
    out = _features(df, features)
    names = []
    for i, model in enumerate(models):
        names.append(f"_p{i}")
        out = _score(model, out, names[-1])
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    return out.withColumn(name, mean).drop("_x", *names)


def importances(spark: SparkSession, models: Sequence[GBTClassificationModel], features: Sequence[str]) -> DataFrame:
    """Mean and deviation over the folds of a feature's importance, greatest first."""
    rows = [(f, float(v)) for m in models for f, v in zip(features, m.featureImportances.toArray())]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return (
        table.groupBy("feature")
        .agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"))
        .orderBy(F.col("mean").desc(), "feature")
    )


def best_features(table: DataFrame, n: int) -> list[str]:
    """Names of the ``n`` most important features."""
    return [r["feature"] for r in table.orderBy(F.col("mean").desc(), "feature").limit(n).collect()]
