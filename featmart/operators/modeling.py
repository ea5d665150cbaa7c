"""Training tables, distributed classifiers behind one facade, folds, scoring, run log."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featmart.operators import scoring
from featmart.operators.cleaning import impute_median
from featmart.operators.ordering import HASH_MODULUS, spread
from featmart.operators.sampling import assign_folds
from featmart.session import cut_lineage, shared_folder, with_row


def scale_min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to [0, 1]; a constant column becomes 0. Bounds are one broadcast row."""
    bounds = df.agg(
        *[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns]
    )
    scaled = {
        c: F.coalesce(
            F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")),
            F.when(F.col(c).isNotNull(), F.lit(0.0)),
        )
        for c in columns
    }
    return df.transform(with_row, bounds).withColumns(scaled).select(*df.columns)


def prepare_training(df: DataFrame, label: str, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Labelled rows with gaps filled by medians, ids dropped, features scaled."""
    labelled = impute_median(df.filter(F.col(label) > -1), features, label)
    return scale_min_max(labelled.drop(*ids), features)


#: Rounds of boosting that stops by itself, and the gain in validation error that a round must bring.
ROUNDS, LEAST_GAIN = 30, 0.01


def classifier(kind: str, label: str, seed: int = 0, validation: str | None = None):
    """An untrained classifier by family name.

    With `validation`, a boolean column, "boosted" stops at the round after which the error
    on those rows no longer falls. "dummy" gives every row the share of positives.
    """
    common = {"labelCol": label, "featuresCol": "features"}
    if kind == "logistic":
        return LogisticRegression(maxIter=20, regParam=0.01, **common)
    if kind == "forest":
        return RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, **common)
    if kind == "boosted" and validation:
        return GBTClassifier(
            maxIter=ROUNDS, maxDepth=3, seed=seed, validationIndicatorCol=validation, validationTol=LEAST_GAIN, **common
        )
    if kind == "boosted":
        return GBTClassifier(maxIter=10, maxDepth=3, seed=seed, **common)
    if kind == "dummy":
        return DecisionTreeClassifier(maxDepth=0, seed=seed, **common)
    raise ValueError(f"unknown model family {kind!r}")


def fit(
    df: DataFrame, label: str, features: Sequence[str], kind: str,
    resample: Callable[[DataFrame], DataFrame] | None = None, seed: int = 0, key: str | None = None, held: float = 0.0,
) -> PipelineModel:
    """Resample the training rows if asked, then fit assembler, scaler and classifier.

    With a `held` share, boosting is stopped early on that share of the rows, picked by the
    hash of `key` before resampling, so that no copy of a held row is trained on. The bounds
    of the scaler come from all rows.
    """
    validation = "_held" if held > 0 and kind == "boosted" else None
    if validation:
        marked = df.withColumn(validation, spread(key, seed + 101) < int(held * HASH_MODULUS))
        train = marked.filter(~F.col(validation))
        train = (resample(train) if resample else train).unionByName(marked.filter(validation), allowMissingColumns=True)
    else:
        train = resample(df) if resample else df
    if resample:
        # Every pass of the fit reads these rows: they are picked once.
        train = cut_lineage(train)
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="keep"),
        MinMaxScaler(inputCol="raw_features", outputCol="features"),
        classifier(kind, label, seed, validation),
    ]
    return Pipeline(stages=stages).fit(train)


def predict(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Probability of the positive class; a plain map over the rows."""
    scored = model.transform(df).withColumn(name, F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select(*df.columns, name)


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Importance of each feature, or its absolute coefficient; equal for the dummy family."""
    last = model.stages[-1]
    if getattr(last, "depth", None) == 0:
        return [(f, 1 / len(features)) for f in features]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return [(f, abs(float(v))) for f, v in zip(features, values.toArray())]


def rounds(model: PipelineModel) -> int:
    """Boosting rounds of the model: its best round where it was stopped early."""
    return model.stages[-1].getNumTrees


def cross_fit(
    df: DataFrame, key: str, label: str, features: Sequence[str], kind: str, folds: int = 5,
    resample: Callable[[DataFrame], DataFrame] | None = None, seed: int = 0, held: float = 0.0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stratified folds: out-of-fold scores, scores of the unlabelled rows averaged over the
    folds' models, and (feature, fold, importance).

    The prepared rows are written once to the shared folder, so every fit re-reads them
    instead of the whole feature plan. The k models score the unlabelled rows as k columns
    of one scan. A `held` share of each fold's training rows stops boosting early.
    """
    rows = cut_lineage(df.select(key, label, *features))
    labelled = cut_lineage(assign_folds(rows.filter(F.col(label) > -1), key, folds, by=label, seed=seed))
    unlabelled = rows.filter(F.col(label) == -1)
    parts, weights = [], []
    for fold in range(folds):
        model = fit(labelled.filter(F.col("fold") != fold), label, features, kind, resample, seed, key, held)
        parts.append(predict(model, labelled.filter(F.col("fold") == fold)).select(key, label, "fold", "score"))
        unlabelled = predict(model, unlabelled, f"_score_{fold}")
        weights += [(name, fold, value) for name, value in importances(model, features)]
    total = reduce(lambda a, b: a + b, [F.col(f"_score_{i}") for i in range(folds)])
    averaged = unlabelled.select(key, (total / folds).alias("score"))
    table = df.sparkSession.createDataFrame(weights, "feature string, fold int, importance double")
    return reduce(DataFrame.unionByName, parts), averaged, table


def fold_scores(held_out: DataFrame, label: str, folds: int, threshold: float = 0.5) -> DataFrame:
    """Metrics of the out-of-fold scores for each fold and over all, in one pass."""
    subsets = {f"fold_{i}": F.col("fold") == i for i in range(folds)} | {"overall": F.lit(True)}
    return scoring.metrics_by_subset(held_out, label, F.col("score") >= threshold, subsets)


def mean_importance(table: DataFrame) -> DataFrame:
    return table.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature")


def score_all(model: PipelineModel, df: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """Score of every client and its risk class."""
    return predict(model, df).select(
        key, "score", F.when(F.col("score") >= threshold, "risky").otherwise("safe").alias("risk_class")
    )


def save_model(model: PipelineModel, spark: SparkSession, name: str, folder: str | None = None) -> str:
    path = f"{folder or shared_folder(spark)}/models/{name}"
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


RUN_SCHEMA = "run string, params string, metric string, value double, at double"


def log_run(spark: SparkSession, path: str, run: str, params: dict, metrics: dict[str, float]) -> DataFrame:
    """Append the parameters and metrics of a run to the run table."""
    text = json.dumps(params, sort_keys=True)
    rows = [(run, text, name, float(value), time.time()) for name, value in metrics.items()]
    spark.createDataFrame(rows, RUN_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(RUN_SCHEMA).parquet(path)
