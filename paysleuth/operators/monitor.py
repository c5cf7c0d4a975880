"""Dashboard lists: newest rows, the active model, drift history. Every limit is the report's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysleuth.functions.scalars import ts
from paysleuth.schemas import FEATURE_DRIFTS


def recent_alerts(alert_log: DataFrame, top: int = 50) -> DataFrame:
    newest = alert_log.orderBy(F.desc("triggered_at"), F.desc("id")).limit(top)
    return newest.select("triggered_at", "alert_type", "severity", "message")


def drift_status(score: Column) -> Column:
    return F.when(score >= 0.30, "DRIFT").when(score >= 0.20, "WARNING").otherwise("OK")


def latest_drift(reports: DataFrame) -> DataFrame:
    """Status and score of the newest report: one aggregate, no sort."""
    newest = reports.agg(F.max_by("drift_score", F.struct("report_date", "id")).alias("s"))
    return newest.filter(F.col("s").isNotNull()).select(
        drift_status(F.col("s")).alias("status"), F.round("s", 4).alias("drift_score")
    )


def drift_series(reports: DataFrame) -> DataFrame:
    return reports.select(
        F.col("report_date").alias("time"),
        "drift_score",
        F.when(F.col("alert_triggered"), F.col("drift_score")).alias("alert_score"),
    )


def drift_alerts_7d(reports: DataFrame, as_of) -> DataFrame:
    recent = F.col("report_date") >= ts(as_of) - F.expr("INTERVAL 7 DAYS")
    return reports.filter(F.col("alert_triggered") & recent).agg(F.count(F.lit(1)).alias("alerts"))


def parsed_reports(reports: DataFrame) -> DataFrame:
    """The reports with their JSON read into the columns the drift policy works on."""
    parsed = reports.withColumn("_f", F.from_json("feature_drifts", FEATURE_DRIFTS))
    return parsed.select(
        "id",
        "drift_score",
        F.col("_f.data_drift").alias("feature_drifts"),
        F.col("_f.model_drift.detected").alias("model_drift_detected"),
        F.col("_f.model_drift.f1_degradation").alias("f1_degradation"),
    )


def json_explode(reports: DataFrame) -> DataFrame:
    """One row per report and drifted feature in its JSON."""
    parsed = reports.select("id", "report_date", F.from_json("feature_drifts", FEATURE_DRIFTS).alias("_f"))
    pairs = parsed.select("id", "report_date", F.explode("_f.data_drift").alias("feature", "_v"))
    return pairs.select("id", "report_date", "feature", F.col("_v.drift_score").alias("drift_score"))


def latest_report_features(reports: DataFrame) -> DataFrame:
    """Per-feature scores of the newest report date."""
    newest = reports.agg(F.max("report_date").alias("report_date"))
    # one row
    last = reports.join(F.broadcast(newest), "report_date", "left_semi")
    return json_explode(last).select("feature", F.round("drift_score", 4).alias("drift_score"))


def drift_alert_history(reports: DataFrame, deployments: DataFrame, top: int = 30) -> DataFrame:
    """Newest alerting reports with the version of their model.

    Only reports whose model exists count, so the existence check comes before the limit and the
    version is looked up for the rows of the report alone.
    """
    alerts = reports.filter("alert_triggered").join(
        deployments.select(F.col("id").alias("model_version_id"), F.col("version").alias("model_version")),
        "model_version_id",
    )
    newest = alerts.orderBy(F.desc("report_date"), F.desc("id")).limit(top)
    return newest.select(
        "report_date",
        F.round("drift_score", 4).alias("drift_score"),
        "alert_triggered",
        "remediation_action",
        "model_version",
    )


def score_series(predictions: DataFrame) -> DataFrame:
    return predictions.select(F.col("timestamp").alias("time"), F.col("prediction_score").alias("score"))


def slow_requests(predictions: DataFrame, limit_ms: float = 50.0) -> DataFrame:
    return predictions.filter(F.col("latency_ms") > limit_ms).select("transaction_id", "latency_ms")


def active_model(deployments: DataFrame) -> DataFrame:
    active = deployments.filter("is_active").orderBy(F.desc("created_at"), F.desc("id")).limit(1)
    return active.select("id", "version", "f1_score", "auc_roc", "precision", "recall", "training_data_to")


def champion_challenger(deployments: DataFrame, top: int = 5) -> DataFrame:
    newest = deployments.orderBy(F.desc("created_at"), F.desc("id")).limit(top)
    rounded = [F.round(c, 4).alias(c) for c in ("f1_score", "precision", "recall", "auc_roc")]
    role = F.when(F.col("is_active"), "Champion").otherwise("Challenger").alias("role")
    return newest.select("version", role, *rounded, "created_at")


def label_backfill(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Attach ground truth to predictions by transaction id; rows without truth keep what they had.

    An id that the truth holds several times (at several times) is fraud if any of its rows is, so no
    prediction is repeated.
    """
    known = truth.groupBy("transaction_id").agg(F.max("is_fraud").alias("_truth"))
    joined = predictions.join(known, "transaction_id", "left")
    filled = F.coalesce(F.col("_truth"), F.col("actual_label"))
    return joined.withColumn("actual_label", filled).drop("_truth")


# The columns that may not be null, by table.
NOT_NULL = {
    "transactions": ["transaction_id", "user_id", "merchant_id", "amount", "timestamp"],
    "model_deployments": ["model_name", "version", "run_id", "created_at", "is_active", "training_data_from", "training_data_to"],
    "predictions_history": [
        "transaction_id", "model_version_id", "prediction_score", "prediction_label", "timestamp", "latency_ms",
    ],
    "drift_reports": ["report_date", "model_version_id", "drift_score", "feature_drifts", "alert_triggered"],
    "alert_log": ["alert_type", "severity", "message", "triggered_at"],
}


def constraint_audit(
    deployments: DataFrame, predictions: DataFrame, reports: DataFrame, alert_log: DataFrame, transactions: DataFrame
) -> DataFrame:
    """(table, rule, violations): the constraints of all tables as counts, one pass per table and one per key."""
    unit = lambda c: F.col(c).isNotNull() & ~F.col(c).between(0, 1)
    checks = {
        "model_deployments": (
            deployments,
            {
                "training_range": F.col("training_data_from") > F.col("training_data_to"),
                **{f"{c}_range": unit(c) for c in ("f1_score", "precision", "recall", "auc_roc")},
            },
        ),
        "predictions_history": (
            predictions,
            {"score_range": unit("prediction_score"), "latency_negative": F.col("latency_ms") < 0},
        ),
        "drift_reports": (reports, {"score_range": unit("drift_score")}),
        "alert_log": (
            alert_log,
            {"severity_domain": ~F.col("severity").isin("INFO", "WARNING", "HIGH", "CRITICAL")},
        ),
        "transactions": (transactions, {}),
    }
    parts = []
    for name, (df, rules) in checks.items():
        rules |= {f"{c}_null": F.col(c).isNull() for c in NOT_NULL[name]}
        counted = df.agg(*[F.count_if(rule).alias(rule_name) for rule_name, rule in rules.items()])
        parts.append(
            counted.unpivot([], list(rules), "rule", "violations").select(F.lit(name).alias("table"), "rule", "violations")
        )
    keys = {
        "model_deployments": (deployments, ["id"], "primary_key"),
        "model_deployments_run": (deployments, ["run_id"], "run_id_unique"),
        "predictions_history": (predictions, ["id"], "primary_key"),
        "drift_reports": (reports, ["id"], "primary_key"),
        "alert_log": (alert_log, ["id"], "primary_key"),
        "transactions": (transactions, ["transaction_id", "timestamp"], "primary_key"),
    }
    for name, (df, cols, rule_name) in keys.items():
        repeated = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        parts.append(
            repeated.agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit(name.replace("_run", "")).alias("table"), F.lit(rule_name).alias("rule"), "violations"
            )
        )
    ids = deployments.select(F.col("id").alias("model_version_id"))
    for name, df in (("predictions_history", predictions), ("drift_reports", reports)):
        # combine the references first: one row per version instead of one per prediction
        used = df.groupBy("model_version_id").agg(F.count(F.lit(1)).alias("n"))
        orphans = used.join(ids, "model_version_id", "left_anti")
        total = F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("violations")
        parts.append(orphans.agg(total).select(F.lit(name).alias("table"), F.lit("foreign_key").alias("rule"), "violations"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
