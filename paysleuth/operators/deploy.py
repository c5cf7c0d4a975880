"""The model_deployments table: promotion as a snapshot rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysleuth.functions.scalars import ts


def activate(deployments: DataFrame, model_version_id: int) -> DataFrame:
    """Exactly the given version is active; fails if it does not exist."""
    if deployments.filter(F.col("id") == model_version_id).limit(1).count() == 0:
        raise ValueError(f"model_version_id {model_version_id} does not exist in model_deployments")
    return deployments.withColumn("is_active", F.col("id") == model_version_id)


def promote_model(
    deployments: DataFrame,
    run_id: str,
    version: str,
    scores: dict[str, float],
    as_of,
    training_from,
    training_to,
    model_name: str = "payment-fraud",
) -> DataFrame:
    """Reuse the row of this run or append one, then make it the only active version."""
    known = deployments.filter(F.col("run_id") == run_id).select("id").head()
    if known is not None:
        return activate(deployments, known["id"])
    top = deployments.agg(F.max("id")).head()[0]
    new_id = (top or 0) + 1
    values = {
        "id": F.lit(new_id).cast("long"),
        "model_name": F.lit(model_name),
        "version": F.lit(version),
        "run_id": F.lit(run_id),
        "created_at": ts(as_of),
        "is_active": F.lit(False),
        **{c: F.lit(scores.get(c)).cast("double") for c in ("f1_score", "precision", "recall", "auc_roc")},
        "training_data_from": ts(training_from),
        "training_data_to": ts(training_to),
    }
    row = deployments.sparkSession.range(1).select(*[v.alias(c) for c, v in values.items()])
    return activate(deployments.unionByName(row), new_id)
