"""Training as one job: split, encoders fitted on the training part, boosting, threshold by cost, test figures, promotion."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysleuth.operators import boost, learn, metrics, selection
from paysleuth.operators.deploy import promote_model
from paysleuth.operators.encoders import EncoderSet
from paysleuth.operators.features import featurize
from paysleuth.operators.split import temporal_split
from paysleuth.plans.sizing import with_row
from paysleuth.schemas import MODEL_INPUT
from paysleuth.session import materialized


class Parts(NamedTuple):
    """The labelled feature matrix in time order, and the encoders that saw its training part only."""

    train: DataFrame
    validation: DataFrame
    test: DataFrame
    encoders: EncoderSet


def training_parts(transactions: DataFrame) -> Parts:
    """Split the labelled rows by time, fit the encoders on the first part, build the matrix of all.

    The behaviour features of a row look back over all transactions, labelled or not.
    """
    labelled = temporal_split(transactions.filter(F.col("is_fraud").isNotNull())).select("transaction_id", "timestamp", "split")
    labelled = materialized(labelled, "split")
    first = labelled.filter("split != 'train'").agg(F.min("timestamp")).first()[0]
    encoders = EncoderSet.fit(transactions, until=first)
    matrix = featurize(transactions, encoders, keep=("transaction_id", "timestamp", "is_fraud"))
    rows = matrix.join(labelled.drop("timestamp"), "transaction_id").withColumn("label", F.col("is_fraud").cast("int"))
    rows = materialized(rows.drop("is_fraud"), "training")
    part = lambda name: rows.filter(F.col("split") == name).drop("split")
    return Parts(part("train"), part("validation"), part("test"), encoders)


def selected_features(train: DataFrame, features: list[str] | None = None, trees: int = 50, seed: int = 42) -> DataFrame:
    """``selection.select_features`` by the importances of a forest and the correlations of the training part."""
    features = features or MODEL_INPUT
    pairs = selection.redundant_pairs(train, features)
    return selection.select_features(features, learn.forest_importance(train, features, seed=seed, trees=trees), pairs)


def scored(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """label and score of a labelled part."""
    return learn.score(rows, model, keep=("label",)).select("label", F.col("prediction_score").alias("score"))


class Trained(NamedTuple):
    model: PipelineModel
    features: list[str]
    report: DataFrame  # one row


def train_and_evaluate(parts: Parts, features: list[str] | None = None, select: bool = False, seed: int = 42, **parameters) -> Trained:
    """Boost with patience on the validation part, choose the threshold of least cost there, measure on the test part."""
    features = features or MODEL_INPUT
    if select:
        chosen = selected_features(parts.train, features, seed=seed).filter("selected").orderBy("position")
        features = [r["feature"] for r in chosen.collect()]
    fitted = boost.train_boosted(parts.train, parts.validation, features, seed=seed, **parameters)
    # a table: the threshold's grid would score a row once for each of its points
    best = metrics.optimal_threshold(materialized(scored(parts.validation, fitted.model), "validation-scores")).first()
    test = materialized(scored(parts.test, fitted.model), "test-scores")
    report = metrics.binary_metrics(test, best["threshold"])
    report = with_row(with_row(report, metrics.roc_auc(test)), metrics.pr_auc(test))
    sizes = {f"n_{name}": getattr(parts, name).count() for name in ("train", "validation", "test")}
    report = report.withColumns(
        {
            **{name: F.lit(n).cast("long") for name, n in sizes.items()},
            "trees": F.lit(fitted.trees),
            "threshold": F.lit(best["threshold"]),
            "validation_cost": F.lit(best["total_cost"]),
            "best_validation_pr_auc": F.lit(fitted.gains[fitted.trees - 1]),
        }
    )
    return Trained(fitted.model, features, materialized(report, "training-report"))


def register(deployments: DataFrame, trained: Trained, parts: Parts, run_id: str, version: str, as_of) -> DataFrame:
    """The deployments with this run's row as the only active one."""
    row = trained.report.first().asDict()
    names = {"f1_score": "f1_score", "precision": "precision", "recall": "recall", "auc_roc": "roc_auc"}
    span = parts.train.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).select(
        F.date_format("a", "yyyy-MM-dd HH:mm:ss").alias("a"), F.date_format("b", "yyyy-MM-dd HH:mm:ss").alias("b")
    ).first()
    scores = {to: row[name] for to, name in names.items()}
    return promote_model(deployments, run_id, version, scores, as_of, span["a"], span["b"])
