"""Hourly data-quality checks and threshold rules; each check is one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysleuth.functions.scalars import cents, ts
from paysleuth.operators.aggregates import since
from paysleuth.plans.sizing import with_row


def _low_count(df: DataFrame, as_of, minimum: int, kind: str, noun: str, span: str) -> DataFrame:
    counted = since(df, as_of, span).agg(F.count(F.lit(1)).alias("count"))
    low = F.col("count") < minimum
    message = F.format_string(f"Only %d {noun} in last hour (min: {minimum})", F.col("count"))
    return counted.select(
        "count",
        low.alias("alert_triggered"),
        F.when(low, kind).alias("alert_type"),
        F.when(low, "WARNING").alias("severity"),
        F.when(low, message).alias("message"),
    )


def dq_volume(transactions: DataFrame, as_of, minimum: int = 10, span: str = "1 HOUR") -> DataFrame:
    return _low_count(transactions, as_of, minimum, "LOW_TRANSACTION_VOLUME", "transactions", span)


def dq_predictions(predictions: DataFrame, as_of, minimum: int = 5, span: str = "1 HOUR") -> DataFrame:
    return _low_count(predictions, as_of, minimum, "LOW_PREDICTION_RATE", "predictions", span)


def dq_amount(
    transactions: DataFrame, as_of, minimum: int = 10, low: float = 1.0, high: float = 100_000.0, span: str = "24 HOURS"
) -> DataFrame:
    rows = since(transactions, as_of, span)
    stats = rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.sum(cents("amount")) / 100.0 / F.count("amount")).alias("avg_amount"),
        F.coalesce(F.stddev_samp(F.col("amount").cast("double")), F.lit(0.0)).alias("std_amount"),
        F.max(F.col("amount").cast("double")).alias("max_amount"),
    )
    enough = F.col("row_count") >= minimum
    bad = enough & ((F.col("avg_amount") < low) | (F.col("max_amount") > high))
    message = F.format_string(
        "Anomalous amount distribution: avg=%.2f, max=%.2f", F.col("avg_amount"), F.col("max_amount")
    )
    known = lambda c: F.when(enough, F.col(c)).alias(c)
    return stats.select(
        "row_count",
        F.when(enough, "ok").otherwise("insufficient_data").alias("status"),
        known("avg_amount"),
        known("std_amount"),
        known("max_amount"),
        F.coalesce(bad, F.lit(False)).alias("alert_triggered"),
        F.when(bad, "ANOMALOUS_AMOUNT_DISTRIBUTION").alias("alert_type"),
        F.when(bad, "HIGH").alias("severity"),
        F.when(bad, message).alias("message"),
    )


def dq_summary(volume: DataFrame, predictions: DataFrame, amount: DataFrame) -> DataFrame:
    """One line on all checks (three one-row inputs)."""
    counts = with_row(
        volume.select(F.col("count").alias("transaction_count")),
        predictions.select(F.col("count").alias("prediction_count")),
    )
    joined = with_row(counts, amount.select("avg_amount"))
    shown = F.coalesce(F.format_string("%.2f", F.col("avg_amount")), F.lit("N/A (insufficient data)"))
    shown = F.when(F.col("avg_amount").isNull(), "N/A (insufficient data)").otherwise(shown)
    line = F.format_string(
        "transactions: %d/h, predictions: %d/h, amount_avg: %s",
        F.col("transaction_count"),
        F.col("prediction_count"),
        shown,
    )
    return joined.select("transaction_count", "prediction_count", shown.alias("amount_avg"), line.alias("summary"))


def _fires(df: DataFrame, value, threshold: float) -> DataFrame:
    return df.select(value.alias("value"), F.coalesce(value > threshold, F.lit(False)).alias("firing"))


def rule_fraud_rate(hourly: DataFrame, as_of, threshold: float = 5.0, span: str = "1 HOUR") -> DataFrame:
    """Fraud rate (%) of the newest hourly bucket within the span; no bucket, no alert."""
    newest = since(hourly, as_of, span, "bucket_hour").agg(F.max_by("fraud_rate", "bucket_hour").alias("r"))
    return _fires(newest, F.col("r") * 100, threshold)


def rule_fraud_spike(transactions: DataFrame, as_of, threshold: float = 5.0, span: str = "5 MINUTES") -> DataFrame:
    frauds = since(transactions, as_of, span).agg(F.count_if("is_fraud").cast("double").alias("n"))
    return _fires(frauds, F.col("n"), threshold)


def rule_drift(reports: DataFrame, as_of, threshold: float = 0.30, span: str = "24 HOURS") -> DataFrame:
    newest = since(reports, as_of, span, "report_date").agg(F.max_by("drift_score", "report_date").alias("s"))
    return _fires(newest, F.col("s"), threshold)


def rule_drift_stale(reports: DataFrame, as_of, threshold: float = 24.0, none: float = 9999.0) -> DataFrame:
    age = (F.unix_micros(ts(as_of)) - F.unix_micros(F.max("report_date"))) / 3_600_000_000
    hours = reports.agg(F.coalesce(age, F.lit(none)).alias("h"))
    return _fires(hours, F.col("h"), threshold)
