"""Reports over transactions and predictions.

All of them are plain aggregates: they combine on the map side, so a busy hour or merchant costs one
row per map task. "Now" is the argument ``as_of``; windows are filters on the time column and reach
the scan as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysleuth.functions.scalars import cents, epoch_bucket, safe_ratio, ts
from paysleuth.plans.ordered import DEFAULT_POLICY, SplitPolicy, exact_quantiles
from paysleuth.plans.sizing import with_row

FRAUD = "is_fraud"


def since(df: DataFrame, as_of, span: str, column: str = "timestamp") -> DataFrame:
    """Rows not older than ``span`` (an interval such as '24 HOURS') at ``as_of``."""
    return df.filter(F.col(column) >= ts(as_of) - F.expr(f"INTERVAL {span}"))


def money(total_cents) -> Column:
    return total_cents / F.lit(100.0)


def percent(part, whole, digits: int | None = None) -> Column:
    value = safe_ratio(part, whole) * 100
    return value if digits is None else F.round(value, digits)


def fraud_volume_hourly(df: DataFrame) -> DataFrame:
    grouped = df.groupBy(F.date_trunc("hour", "timestamp").alias("bucket_hour")).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if("is_fraud").alias("total_fraud_transactions"),
    )
    return grouped.withColumn("fraud_rate", safe_ratio("total_fraud_transactions", "total_transactions"))


def fraud_volume_24h(hourly: DataFrame, as_of) -> DataFrame:
    return since(hourly, as_of, "24 HOURS", "bucket_hour").orderBy("bucket_hour")


def merchant_amount_daily(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_trunc("day", "timestamp").alias("bucket_day"), "merchant_id").agg(
        money(F.sum(cents("amount"))).alias("total_amount"), F.count(F.lit(1)).alias("transaction_count")
    )


def merchant_daily_top50(daily: DataFrame, as_of, top: int = 50) -> DataFrame:
    recent = since(daily, as_of, "7 DAYS", "bucket_day")
    return recent.orderBy(F.desc("total_amount"), "bucket_day", "merchant_id").limit(top)


def top_merchants_fraud(df: DataFrame, as_of, span: str = "24 HOURS", top: int = 10) -> DataFrame:
    grouped = (
        since(df, as_of, span)
        .groupBy("merchant_id", "merchant_category")
        .agg(F.count_if("is_fraud").alias("fraud_count"), F.count(F.lit(1)).alias("total_count"))
    )
    rated = grouped.withColumn("fraud_rate_pct", percent("fraud_count", "total_count", 2))
    return rated.orderBy(F.desc("fraud_count"), "merchant_id", "merchant_category").limit(top)


def fraud_rate_1h(predictions: DataFrame, as_of, span: str = "1 HOUR") -> DataFrame:
    return since(predictions, as_of, span).agg(
        percent(F.count_if("prediction_label"), F.count(F.lit(1))).alias("fraud_rate_pct")
    )


def volume_per_minute(predictions: DataFrame, seconds: int = 60) -> DataFrame:
    return predictions.groupBy(epoch_bucket("timestamp", seconds).alias("time")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("prediction_label").alias("fraud")
    )


def count_per_bucket(df: DataFrame, seconds: int, out: str) -> DataFrame:
    return df.groupBy(epoch_bucket("timestamp", seconds).alias("time")).agg(F.count(F.lit(1)).alias(out))


def fraud_count_1h(predictions: DataFrame, as_of, span: str = "1 HOUR") -> DataFrame:
    return since(predictions, as_of, span).agg(F.count_if("prediction_label").alias("fraud_count"))


def txn_total_1h(hourly: DataFrame, as_of, span: str = "1 HOUR") -> DataFrame:
    return since(hourly, as_of, span, "bucket_hour").agg(F.sum("total_transactions").alias("total_transactions"))


def volume_24h(transactions: DataFrame, predictions: DataFrame, as_of) -> DataFrame:
    """Counts of both tables over the last day, as one row per table."""
    parts = [
        since(df, as_of, "24 HOURS").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("series"), "n")
        for name, df in (("predictions", predictions), ("transactions", transactions))
    ]
    return parts[0].unionByName(parts[1])


def txn_vs_pred_rate(transactions: DataFrame, predictions: DataFrame, seconds: int = 120) -> DataFrame:
    """Both volumes on one time axis; each side is aggregated before the join."""
    left = count_per_bucket(transactions, seconds, "transactions")
    right = count_per_bucket(predictions, seconds, "predictions")
    return left.join(right, "time", "full_outer")


def latency_percentiles(predictions: DataFrame, seconds: int = 300, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """Exact p50, p95 and p99 (linear interpolation) per time bucket."""
    bucketed = predictions.select(epoch_bucket("timestamp", seconds).alias("time"), "latency_ms")
    points = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    return exact_quantiles(bucketed, ["time"], "latency_ms", points, policy)


def labeled_summary(df: DataFrame, minimum: int = 1000) -> DataFrame:
    labelled = df.filter(F.col(FRAUD).isNotNull()).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("timestamp").alias("data_from"),
        F.max("timestamp").alias("data_to"),
    )
    return labelled.withColumn("enough", F.col("row_count") >= minimum)


def seed_summary(df: DataFrame) -> DataFrame:
    """Per country: rows and share; with the totals and the date range on each row."""
    per = df.groupBy("country").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_fraud").alias("_fraud"),
        F.min("timestamp").alias("_min"),
        F.max("timestamp").alias("_max"),
    )
    whole = per.agg(
        F.sum("n").alias("total"),
        F.sum("_fraud").alias("total_fraud"),
        F.min("_min").alias("min_ts"),
        F.max("_max").alias("max_ts"),
    )
    joined = with_row(per, whole)
    share = F.round(F.col("n") / F.col("total") * 100, 1).alias("share_pct")
    return joined.select("country", "n", share, "total", "total_fraud", "min_ts", "max_ts")


def class_distribution(df: DataFrame) -> DataFrame:
    """Count and percentage per class; a row without a label counts as legitimate."""
    one_row = df.agg(
        F.count_if(F.col(FRAUD).eqNullSafe(True)).alias("fraud"), F.count_if(~F.col(FRAUD).eqNullSafe(True)).alias("legit")
    )
    total = F.col("fraud") + F.col("legit")
    stacked = one_row.withColumn("total", total).unpivot(["total"], ["legit", "fraud"], "class", "count")
    return stacked.select("class", "count", F.round(safe_ratio("count", "total") * 100, 2).alias("percent"))


def amount_stats(df: DataFrame, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """Mean, median, deviation, range and upper quantiles of the amount per class."""
    rows = df.select(F.col(FRAUD).eqNullSafe(True).alias("is_fraud"), F.col("amount").cast("double").alias("amount"))
    moments = rows.groupBy("is_fraud").agg(
        F.avg("amount").alias("mean"),
        F.stddev_samp("amount").alias("std"),
        F.min("amount").alias("min"),
        F.max("amount").alias("max"),
    )
    tails = exact_quantiles(rows, ["is_fraud"], "amount", {"median": 0.5, "p95": 0.95, "p99": 0.99}, policy)
    return moments.join(tails, "is_fraud")


def amount_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins of the positive amounts, per class over the range of that class."""
    rows = df.filter(F.col("amount") > 0).select(
        F.col(FRAUD).eqNullSafe(True).alias("is_fraud"), F.col("amount").cast("double").alias("amount")
    )
    ranges = rows.groupBy("is_fraud").agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    # at most two rows
    joined = rows.join(F.broadcast(ranges), "is_fraud")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    raw = F.floor(F.try_divide(F.col("amount") - F.col("lo"), width))
    index = F.coalesce(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("int")
    counted = joined.groupBy("is_fraud", "lo", width.alias("width"), index.alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return counted.select("is_fraud", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_from"), "count")


def _by_domain(df: DataFrame, key: Column, size: int, name: str) -> DataFrame:
    """Totals per value of a small fixed domain; absent values appear with zero."""
    grouped = df.groupBy(key.cast("long").alias(name)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_fraud").alias("fraud")
    )
    domain = df.sparkSession.range(size).withColumnRenamed("id", name)
    filled = domain.join(grouped, name, "left").na.fill(0, ["total", "fraud"])
    rated = filled.withColumn("fraud_rate_pct", F.try_divide(F.col("fraud") * 100.0, F.col("total")))
    top = rated.filter(F.col("fraud_rate_pct").isNotNull()).agg(
        F.max_by(name, F.struct("fraud_rate_pct", -F.col(name))).alias("_peak"),
        F.min_by(name, F.struct("fraud_rate_pct", name)).alias("_low"),
    )
    marked = with_row(rated, top)
    return marked.select(
        name,
        "total",
        "fraud",
        "fraud_rate_pct",
        F.coalesce(F.col(name) == F.col("_peak"), F.lit(False)).alias("is_peak"),
        F.coalesce(F.col(name) == F.col("_low"), F.lit(False)).alias("is_low"),
    )


def by_hour(df: DataFrame) -> DataFrame:
    return _by_domain(df, F.hour("timestamp"), 24, "hour")


def by_dow(df: DataFrame) -> DataFrame:
    return _by_domain(df, F.weekday("timestamp"), 7, "dow")


def by_category(df: DataFrame, column: str, top: int | None = 10) -> DataFrame:
    """Volume and fraud rate per value, the most frequent first (the report shows the top 10)."""
    grouped = df.groupBy(column).agg(
        F.count(F.lit(1)).alias("count"),
        safe_ratio(F.count_if("is_fraud"), F.count(F.lit(1))).alias("fraud_rate"),
    )
    return grouped.orderBy(F.desc("count"), column).limit(top) if top else grouped


def daily_series(df: DataFrame, deviations: float = 2.0) -> DataFrame:
    """Daily totals; a day is an outlier if its rate exceeds the mean by ``deviations`` deviations."""
    daily = df.groupBy(F.date_trunc("day", "timestamp").alias("date")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_fraud").alias("fraud")
    )
    daily = daily.withColumn("fraud_rate_pct", F.col("fraud") / F.col("total") * 100)
    stats = daily.agg(F.avg("fraud_rate_pct").alias("_mean"), F.stddev_samp("fraud_rate_pct").alias("_sd"))
    joined = with_row(daily, stats)
    high = F.col("fraud_rate_pct") > F.col("_mean") + F.lit(deviations) * F.col("_sd")
    return joined.select("date", "total", "fraud", "fraud_rate_pct", F.coalesce(high, F.lit(False)).alias("is_outlier"))


# Names of the weekdays, Monday first.
DOW_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def heatmap_hour_dow(df: DataFrame) -> DataFrame:
    """Fraud percentage, hours down and weekdays across; cells without rows are NULL."""
    cells = df.select(
        F.hour("timestamp").cast("long").alias("hour"),
        F.weekday("timestamp").alias("dow"),
        F.coalesce(F.col(FRAUD).cast("int"), F.lit(0)).alias("y"),
    )
    wide = cells.groupBy("hour").pivot("dow", list(range(7))).agg(F.avg("y") * 100)
    hours = df.sparkSession.range(24).withColumnRenamed("id", "hour")
    named = [F.col(str(i)).alias(label) for i, label in enumerate(DOW_LABELS)]
    return hours.join(wide, "hour", "left").select("hour", *named)


def top_combos(heatmap: DataFrame, top: int = 5) -> DataFrame:
    long = heatmap.unpivot(["hour"], DOW_LABELS, "day", "fraud_rate_pct")
    ranked = long.filter(F.col("fraud_rate_pct").isNotNull())
    return ranked.orderBy(F.desc(F.round("fraud_rate_pct", 9)), "hour", "day").limit(top)


def describe(df: DataFrame, columns: list[str], policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = doubles.unpivot([], columns, "column", "value").filter(F.col("value").isNotNull())
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, policy)
    return moments.join(quartiles, "column")


def missing_domain(df: DataFrame) -> DataFrame:
    """How an unknown label enters each rate: it is never fraud, and only the mean leaves it out."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(FRAUD).isNull()).alias("unlabelled"),
        F.count_if("is_fraud").alias("fraud"),
        safe_ratio(F.count_if("is_fraud"), F.count(F.lit(1))).alias("rate_of_all"),
        F.avg(F.col(FRAUD).cast("int")).alias("rate_of_labelled"),
    )
