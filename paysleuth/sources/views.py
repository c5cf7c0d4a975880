"""The payment tables as views over the given star-schema and event tables.

Every view is a projection or join of the given tables, so its size follows theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories and countries of the payment domain, in natural order.
CATEGORIES = ["retail", "food", "travel", "entertainment", "gas_station", "online", "pharmacy"]
COUNTRIES = ["AR", "BR", "US", "MX", "CL", "CO", "PE", "UY", "PY", "BO", "ES", "UK", "FR", "DE"]

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def padded(number: Column) -> Column:
    """At least four digits; longer numbers stay whole."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), "0")


def _number_in_props() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def stored_user(user_id: str) -> int | None:
    """The key of the stored table that the view shows as this user, if there is one."""
    digits = user_id.removeprefix("user_")
    number = int(digits) if digits.isdecimal() else None
    return number if number is not None and user_id == f"user_{number:04d}" else None


def transactions(spark: SparkSession, sf_dir: str, user_id: str | None = None) -> DataFrame:
    """All transactions, or one user's: that condition is put to the stored key, where the file scan can use it."""
    source = table(spark, sf_dir, "events")
    if user_id is not None:
        source = source.filter(F.col("user_id") == F.lit(stored_user(user_id)))
    return transactions_of(source)


def transactions_of(source: DataFrame) -> DataFrame:
    """The transactions in an events table or stream."""
    k = F.col("k")
    events = source.withColumn("k", _number_in_props())
    user = F.concat(F.lit("user_"), padded(F.col("user_id")))
    country = _pick(
        COUNTRIES,
        F.when(F.col("event_id") % 20 < 17, F.col("user_id")).otherwise(F.col("event_id")) % len(COUNTRIES),
    )
    device = (
        F.when(F.col("event_id") % 10 < 6, "mobile").when(F.col("event_id") % 10 < 9, "web").otherwise("pos")
    )
    label = F.when((F.col("event_type") == "signup") & (k >= 90), F.lit(None)).otherwise(
        (F.col("event_type") == "error") & (k < 10)
    )
    at = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        user.alias("user_id"),
        F.concat(F.lit("merchant_"), padded(k)).alias("merchant_id"),
        _pick(CATEGORIES, k % len(CATEGORIES)).alias("merchant_category"),
        F.col("value").alias("amount"),
        country.alias("country"),
        at.alias("timestamp"),
        device.alias("device_type"),
        F.sha2(F.concat(user, F.lit("|"), F.date_format(at, "yyyyMMddHH")), 256).alias("ip_hash"),
        label.alias("is_fraud"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of day grain with ties and repeated ids (order lines by ship date)."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_suppkey").cast("string").alias("merchant_id"),
        F.col("l_linestatus").alias("merchant_category"),
        F.col("l_extendedprice").alias("amount"),
        F.col("o_orderstatus").alias("country"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("o_orderpriority").alias("device_type"),
        (F.col("l_returnflag") == "R").alias("is_fraud"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursty transactions: the lines of an order, one minute apart from the order's date."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    minutes = F.col("l_linenumber") * F.lit(60_000_000)
    at = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + minutes)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_suppkey").cast("string").alias("merchant_id"),
        F.col("l_extendedprice").alias("amount"),
        F.col("o_orderstatus").alias("country"),
        at.alias("timestamp"),
    )


def predictions_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_of(table(spark, sf_dir, "events"))


def predictions_of(events: DataFrame) -> DataFrame:
    """The predictions in an events table or stream."""
    source = events.withColumn("k", _number_in_props())
    label = F.when((F.col("event_type") == "signup") & (F.col("k") >= 90), F.lit(None)).otherwise(
        (F.col("event_type") == "error") & (F.col("k") < 10)
    )
    score = F.least(F.col("value") / 200, F.lit(1.0))
    return source.select(
        F.col("event_id").alias("id"),
        F.col("event_id").cast("string").alias("transaction_id"),
        (F.col("event_id") % 3 + 1).alias("model_version_id"),
        score.alias("prediction_score"),
        (score >= 0.5).alias("prediction_label"),
        label.alias("actual_label"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        ((F.col("k") + 1) * 0.5).alias("latency_ms"),
    )


def model_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    start = F.lit(1_701_388_800_000_000)  # 2023-12-01 00:00:00 UTC
    created = F.timestamp_micros(start + key * F.lit(3_600_000_000))
    return table(spark, sf_dir, "supplier").select(
        (key + 1).alias("id"),
        F.lit("payment-fraud").alias("model_name"),
        (key + 1).cast("string").alias("version"),
        F.concat(F.lit("run_"), key.cast("string")).alias("run_id"),
        created.alias("created_at"),
        (key == 1).alias("is_active"),
        ((key * 37) % 101 / 100).alias("f1_score"),
        ((key * 53) % 101 / 100).alias("precision"),
        ((key * 71) % 101 / 100).alias("recall"),
        ((key * 89) % 101 / 100).alias("auc_roc"),
        F.timestamp_micros(start - F.lit(86_400_000_000) * 30).alias("training_data_from"),
        created.alias("training_data_to"),
    )


def drift_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per ``view`` event; the drift JSON is spelled out from the event's number."""
    source = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    source = source.withColumn("k", _number_in_props())
    number = lambda c: F.concat(F.lit("0."), F.lpad(c.cast("string"), 2, "0"))
    k = F.col("k")
    body = F.concat(
        F.lit('{"data_drift": {"tx_count_1h": {"drift_score": '),
        number(k),
        F.lit('}, "amount_sum_1h": {"drift_score": '),
        number((k * 7) % 100),
        F.lit('}, "log_amount": {"drift_score": '),
        number((k * 13) % 100),
        F.lit('}}, "model_drift": {"detected": '),
        F.when(k % 2 == 0, "true").otherwise("false"),
        F.lit(', "f1_degradation": -'),
        number(k % 20),
        F.lit("}}"),
    )
    return source.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("report_date"),
        (F.col("event_id") % 3 + 1).alias("model_version_id"),
        (k / 100).alias("drift_score"),
        body.alias("feature_drifts"),
        (k >= 30).alias("alert_triggered"),
        F.when(k >= 30, "triggered_retraining_dag").alias("remediation_action"),
    )


# Severities of the alert log and the alert types written by the checks.
SEVERITIES = ["INFO", "WARNING", "HIGH", "CRITICAL"]
ALERT_TYPES = ["HIGH_FRAUD_RATE", "LOW_TRANSACTION_VOLUME", "LOW_PREDICTION_RATE"]


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per ``error`` event; a fifth of them acknowledged ten minutes later."""
    source = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    source = source.withColumn("k", _number_in_props())
    at = F.col("ts").cast("timestamp")
    return source.select(
        F.col("event_id").alias("id"),
        _pick(ALERT_TYPES, F.col("k") % 3).alias("alert_type"),
        _pick(SEVERITIES, F.col("k") % 4).alias("severity"),
        F.concat(F.lit("alert "), F.col("event_id").cast("string")).alias("message"),
        at.alias("triggered_at"),
        F.when(F.col("k") % 5 == 0, at + F.expr("INTERVAL 10 MINUTES")).alias("acknowledged_at"),
        F.when(F.col("k") % 5 == 0, "operator").alias("acknowledged_by"),
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON messages of the transactions, the time as ISO text or in milliseconds.

    Some are empty, cut short, of a wrong type or without a field.
    """
    tx = transactions(spark, sf_dir)
    number = F.col("transaction_id").cast("long")

    def message(time: Column) -> Column:
        return F.to_json(
            F.struct(
                "transaction_id",
                "user_id",
                "merchant_id",
                "merchant_category",
                "amount",
                "country",
                time.alias("timestamp"),
                "device_type",
                "ip_hash",
            )
        )

    good = message(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    whole = F.unix_micros("timestamp") % 1000 == 0
    good = F.when((number % 10 == 4) & whole, message(F.unix_millis("timestamp"))).otherwise(good)
    value = (
        F.when(number % 10 == 1, F.lit(""))
        .when(number % 10 == 2, F.expr("substring(body, 1, 20)"))
        .when(number % 10 == 3, F.expr("replace(body, '\"amount\":', '\"amount\":\"x\",\"was\":')"))
        .when(number % 10 == 5, F.expr("replace(body, '\"country\":', '\"was\":')"))
        .otherwise(F.col("body"))
    )
    return tx.withColumn("body", good).select(number.alias("offset"), value.alias("value"))
