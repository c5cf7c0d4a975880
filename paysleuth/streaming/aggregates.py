"""Continuous aggregates, deduplication and scoring on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysleuth.functions.scalars import cents, safe_ratio
from paysleuth.operators.alerts import publish_alerts
from paysleuth.operators.learn import score
from paysleuth.sources.streams import batch_dir


def stream_hourly(stream: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Hourly totals and fraud rate; an hour is emitted once the watermark has passed it."""
    grouped = (
        stream.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("total_transactions"), F.count_if("is_fraud").alias("total_fraud_transactions"))
    )
    return grouped.select(
        F.col("w.start").alias("bucket_hour"),
        "total_transactions",
        "total_fraud_transactions",
        safe_ratio("total_fraud_transactions", "total_transactions").alias("fraud_rate"),
    )


def stream_merchant_daily(stream: DataFrame, delay: str = "5 minutes") -> DataFrame:
    grouped = (
        stream.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 day").alias("w"), "merchant_id")
        .agg(F.sum(cents("amount")).alias("c"), F.count(F.lit(1)).alias("transaction_count"))
    )
    return grouped.select(
        F.col("w.start").alias("bucket_day"), "merchant_id", (F.col("c") / 100.0).alias("total_amount"),
        "transaction_count",
    )


def stream_fraud_rate(
    predictions: DataFrame, window: str = "15 minutes", slide: str = "1 minute", delay: str = "5 minutes",
    threshold: float = 0.05,
) -> DataFrame:
    """Predicted-fraud rate of sliding windows; ``alert`` where it exceeds the threshold."""
    grouped = (
        predictions.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", window, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("total_count"), F.count_if("prediction_label").alias("fraud_count"))
    )
    rate = F.col("fraud_count") / F.col("total_count")
    return grouped.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "total_count",
        "fraud_count",
        rate.alias("fraud_rate"),
        (rate > threshold).alias("alert"),
    )


def stream_dedup(stream: DataFrame, horizon: str = "60 seconds", key: str = "transaction_id") -> DataFrame:
    """The first row of each id; repeats within the horizon are dropped."""
    return stream.withWatermark("timestamp", horizon).dropDuplicatesWithinWatermark([key])


def stream_label_backfill(
    predictions: DataFrame, truth: DataFrame, delay: str = "1 hour", horizon: str = "7 days"
) -> DataFrame:
    """Predictions with the label that arrives within the horizon; NULL once it has passed without one.

    truth: transaction_id, is_fraud, labelled_at. Both sides keep state for the horizon only.
    """
    left = predictions.drop("actual_label").withWatermark("timestamp", delay)
    right = truth.select(
        F.col("transaction_id").alias("_id"), F.col("is_fraud").alias("actual_label"), "labelled_at"
    ).withWatermark("labelled_at", delay)
    due = F.col("timestamp") + F.expr(f"INTERVAL {horizon}")
    match = (F.col("transaction_id") == F.col("_id")) & F.col("labelled_at").between(F.col("timestamp"), due)
    return left.join(right, match, "left_outer").drop("_id")


def score_batches(model, prediction_path: str, alert_path: str, model_version_id: int, threshold: float = 0.5,
                  prepare=None):
    """foreachBatch writer: score a micro-batch of enriched rows into predictions and alerts.

    Both tables get one folder per micro-batch, overwritten on replay: a failed batch is scored again
    and nothing is lost or doubled. A row has no latency of its own in a batch (``latency_ms`` is NULL).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        scored = score(rows, model, threshold, str(model_version_id), ("transaction_id",))
        predictions = scored.select(
            "transaction_id",
            "prediction_score",
            "prediction_label",
            F.lit(model_version_id).cast("long").alias("model_version_id"),
            F.current_timestamp().alias("timestamp"),
            F.lit(None).cast("double").alias("latency_ms"),
        )
        here = batch_dir(prediction_path, batch_id)
        predictions.write.mode("overwrite").parquet(here)
        written = batch.sparkSession.read.schema(predictions.schema).parquet(here)
        publish_alerts(written).write.mode("overwrite").parquet(batch_dir(alert_path, batch_id))

    return write
