"""Data drift, model drift and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysleuth.functions.scalars import ts
from paysleuth.operators.metrics import prf
from paysleuth.plans.ordered import DEFAULT_POLICY, SplitPolicy, running
from paysleuth.plans.sizing import with_row
from paysleuth.session import materialized

# The features watched most closely, and the thresholds of the policy.
CRITICAL_FEATURES = [
    "amount_ratio_vs_user_avg",
    "amount_sum_1h",
    "is_country_new",
    "seconds_since_last_tx",
    "tx_count_1h",
]
CRITICAL_THRESHOLD = 0.20
GLOBAL_THRESHOLD = 0.30
F1_DEGRADATION = 0.05

# measure -> distance from which a column counts as drifted
TESTS = {"ks": 0.1, "wasserstein": 0.1, "jensen_shannon": 0.1, "psi": 0.2}


def drift_rows_guard(current: DataFrame, minimum: int = 100) -> DataFrame:
    """One row: are there enough production rows for a drift report?"""
    return current.agg(F.count(F.lit(1)).alias("row_count")).withColumn("enough", F.col("row_count") >= minimum)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each value occurs, combined before the shuffle; parts of a table add up."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = doubles.unpivot([], columns, "column", "value").filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def store_reference(df: DataFrame, columns: list[str], path: str) -> None:
    """Save a reference matrix with its value counts: drift reports read the counts, never the rows."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    value_counts(rows, columns).write.mode("overwrite").partitionBy("column").parquet(f"{path}/counts")


def reference_counts(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The stored counts of a reference, of some columns only if asked for."""
    counts = spark.read.schema("value double, n long, column string").parquet(f"{path}/counts")
    return counts if columns is None else counts.filter(F.col("column").isin(columns))


def _sides(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(column, value, ref, cur) from the value counts of both sides."""
    zero = F.lit(0).cast("long")
    ref = reference.select("column", "value", F.col("n").alias("ref"), zero.alias("cur"))
    cur = current.select("column", "value", zero.alias("ref"), F.col("n").alias("cur"))
    return ref.unionByName(cur).groupBy("column", "value").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))


def _totals(counts: DataFrame) -> DataFrame:
    square = F.col("ref") * F.col("value") * F.col("value")
    mean = F.try_divide(F.sum(F.col("ref") * F.col("value")), F.sum("ref"))
    return counts.groupBy("column").agg(
        F.sum("ref").alias("n_ref"),
        F.sum("cur").alias("n_cur"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.sqrt(F.greatest(F.try_divide(F.sum(square), F.sum("ref")) - mean * mean, F.lit(0.0))).alias("sd"),
    )


def _share(part: Column, whole: str) -> Column:
    """NULL if the side is empty: without rows there is no distance."""
    return F.try_divide(part.cast("double"), F.col(whole).cast("double"))


def _cdf_scores(counts: DataFrame, totals: DataFrame, test: str, policy: SplitPolicy) -> DataFrame:
    scan = {"_r": ("sum", "ref"), "_c": ("sum", "cur"), "_prev": ("max", "value")}
    before = running(counts, ["column"], "value", scan, policy=policy)
    zero = F.lit(0).cast("long")
    r, c = F.coalesce("_r", zero), F.coalesce("_c", zero)
    # one row per column
    joined = before.join(F.broadcast(totals), "column")
    if test == "ks":
        gap = F.abs(_share(r + F.col("ref"), "n_ref") - _share(c + F.col("cur"), "n_cur"))
        return joined.groupBy("column").agg(F.max(gap).alias("score"))
    area = F.abs(_share(r, "n_ref") - _share(c, "n_cur")) * (F.col("value") - F.col("_prev"))
    summed = joined.groupBy("column").agg(
        F.sum(area).alias("_area"),
        F.any_value("sd").alias("_sd"),
        F.any_value(F.least("n_ref", "n_cur")).alias("_smaller"),
    )
    norm = F.greatest(F.col("_sd"), F.lit(0.001))
    # a single value everywhere has no area; an empty side has no distance
    area = F.when(F.col("_smaller") > 0, F.coalesce("_area", F.lit(0.0)))
    return summed.select("column", (area / norm).alias("score"))


def _binned_scores(counts: DataFrame, totals: DataFrame, test: str, bins: int) -> DataFrame:
    joined = counts.join(F.broadcast(totals), "column")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    index = F.coalesce(
        F.least(F.floor(F.try_divide(F.col("value") - F.col("lo"), width)), F.lit(bins - 1)), F.lit(0)
    ).cast("int")
    per_bin = joined.groupBy("column", index.alias("bin"), "n_ref", "n_cur").agg(
        F.sum("ref").alias("r"), F.sum("cur").alias("c")
    )
    p, q = _share(F.col("r"), "n_ref"), _share(F.col("c"), "n_cur")
    if test == "psi":
        tiny = F.lit(1e-4)
        # greatest() would skip a NULL share
        p, q = (F.when(x.isNotNull(), F.greatest(x, tiny)) for x in (p, q))
        term = (q - p) * F.ln(q / p)
        return per_bin.groupBy("column").agg(F.sum(term).alias("score"))
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).when(x == 0, F.lit(0.0))
    divergence = F.sum((part(p) + part(q)) / 2)
    # rounding can leave a sum of zero slightly negative
    return per_bin.groupBy("column").agg(F.sqrt(F.when(divergence > 0, divergence).when(divergence <= 0, F.lit(0.0)))
                                         .alias("score"))


def data_drift(
    reference: DataFrame,
    current: DataFrame,
    columns: list[str],
    test: str = "ks",
    threshold: float | None = None,
    bins: int = 20,
    policy: SplitPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Per column: the distance between both tables (larger is more drift) and whether it exceeds the threshold."""
    return counted_drift(value_counts(reference, columns), value_counts(current, columns), test, threshold, bins, policy)


def counted_drift(
    reference: DataFrame,
    current: DataFrame,
    test: str = "ks",
    threshold: float | None = None,
    bins: int = 20,
    policy: SplitPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """The same from the value counts of both sides (``value_counts``, ``reference_counts``).

    Measures: "ks" (largest gap of the distribution functions), "wasserstein" (area between them over
    the reference deviation), "jensen_shannon" and "psi" (on equal-width bins over both sides).
    """
    if test not in TESTS:
        raise ValueError(f"test must be one of {sorted(TESTS)}")
    limit = TESTS[test] if threshold is None else threshold
    # read several times, and far smaller than the rows that both sides are computed from
    counts = materialized(_sides(reference, current), "drift-counts")
    totals = _totals(counts)
    if test in ("ks", "wasserstein"):
        scores = _cdf_scores(counts, totals, test, policy)
    else:
        scores = _binned_scores(counts, totals, test, bins)
    return scores.select(
        "column",
        F.col("score").alias("drift_score"),
        F.coalesce(F.col("score") > limit, F.lit(False)).alias("drift_detected"),
        F.lit(test).alias("stattest_name"),
    )


def dataset_drift(per_column: DataFrame, share: float = 0.5) -> DataFrame:
    """One row: share of drifted columns, the dataset flag, and the scores as a map."""
    drifted = F.count_if("drift_detected") / F.count(F.lit(1))
    entries = F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("column", F.struct("drift_score").alias("v"))))
    )
    names = F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("column"))))
    one = per_column.agg(drifted.alias("drift_share"), names.alias("drifted_features"), entries.alias("feature_drifts"))
    return one.withColumn("dataset_drift", F.col("drift_share") >= share)


def model_drift(
    predictions: DataFrame,
    reference: DataFrame,
    model_version_id: int,
    as_of,
    days: int = 7,
    minimum: int = 50,
    degradation: float = F1_DEGRADATION,
) -> DataFrame:
    """F1 of the labelled predictions of the last days against the deployment's F1."""
    rows = predictions.filter(
        (F.col("model_version_id") == model_version_id)
        & F.col("actual_label").isNotNull()
        & (F.col("timestamp") >= ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    )
    y, p = F.col("actual_label"), F.col("prediction_label")
    counted = prf(
        rows.agg(
            F.count_if(y & p).alias("tp"),
            F.count_if(~y & p).alias("fp"),
            F.count_if(y & ~p).alias("fn"),
            F.count(F.lit(1)).alias("labeled_rows"),
        )
    )
    base = reference.filter(F.col("id") == model_version_id).select(
        F.col("f1_score").alias("_f1"),
        F.col("precision").alias("_precision"),
        F.col("recall").alias("_recall"),
    )
    joined = with_row(counted, base)
    enough = F.col("labeled_rows") >= minimum
    diff = F.col("f1_score") - F.col("_f1")
    known = lambda c: F.when(enough, c)
    return joined.select(
        "labeled_rows",
        enough.alias("has_sufficient_data"),
        known(F.col("_f1")).alias("reference_f1"),
        known(F.col("f1_score")).alias("current_f1"),
        known(F.col("_precision")).alias("reference_precision"),
        known(F.col("precision")).alias("current_precision"),
        known(F.col("_recall")).alias("reference_recall"),
        known(F.col("recall")).alias("current_recall"),
        known(diff).alias("f1_degradation"),
        F.coalesce(enough & (diff < -degradation), F.lit(False)).alias("drift_detected"),
    )


def _listed(names: Column) -> Column:
    quoted = F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def drift_policy(
    reports: DataFrame,
    critical: float = CRITICAL_THRESHOLD,
    overall: float = GLOBAL_THRESHOLD,
    features: list[str] = CRITICAL_FEATURES,
) -> DataFrame:
    """Severity, message and action per report.

    reports: drift_score, feature_drifts map<name, struct<drift_score>>, model_drift_detected and
    f1_degradation; further columns are kept.
    """
    score = lambda n: F.coalesce(F.col("feature_drifts")[n]["drift_score"], F.lit(0.0))
    names = F.array_compact(F.array(*[F.when(score(n) > critical, F.lit(n)) for n in sorted(features)]))
    df = reports.withColumn("critical_features", names)
    any_critical = F.size("critical_features") > 0
    model = F.coalesce(F.col("model_drift_detected"), F.lit(False))
    total = F.format_string("%.3f", F.col("drift_score"))
    severity = (
        F.when(any_critical & model, "CRITICAL")
        .when(any_critical | model, "HIGH")
        .when(F.col("drift_score") > overall, "WARNING")
        .otherwise("INFO")
    )
    shown = _listed(F.col("critical_features"))
    f1 = F.format_string("%.3f", F.col("f1_degradation"))
    message = (
        F.when(
            any_critical & model,
            F.concat(
                F.lit("CRITICAL drift: critical features drifted="), shown,
                F.lit(", model drift detected, global score="), total,
            ),
        )
        .when(any_critical, F.concat(F.lit("High drift: critical features drifted="), shown,
                                     F.lit(", global score="), total))
        .when(model, F.concat(F.lit("High drift: model F1 degradation="), f1, F.lit(", global score="), total))
        .when(
            F.col("drift_score") > overall,
            F.concat(F.lit("Global data drift score="), total, F.lit(f" exceeds threshold={overall}")),
        )
        .otherwise(F.concat(F.lit("Drift within acceptable bounds: global score="), total))
    )
    acts = F.col("severity") != "INFO"
    return (
        df.withColumn("severity", severity)
        .withColumn("alert_message", message)
        .withColumn("alert_triggered", acts)
        .withColumn("trigger_retraining", acts)
        .withColumn("remediation_action", F.when(acts, "triggered_retraining_dag"))
    )


def drift_report_row(
    per_column: DataFrame, model: DataFrame, model_version_id: int, as_of, share: float = 0.5
) -> DataFrame:
    """The drift_reports record: share of drifted columns as score, both results nested as JSON."""
    data = dataset_drift(per_column, share).withColumnRenamed("drift_share", "drift_score")
    m = model.select(F.col("drift_detected").alias("model_drift_detected"), "f1_degradation")
    judged = drift_policy(with_row(data, m))
    body = F.to_json(
        F.struct(
            F.col("feature_drifts").alias("data_drift"),
            F.struct(F.col("model_drift_detected").alias("detected"), "f1_degradation").alias("model_drift"),
        ),
        {"ignoreNullFields": "false"},
    )
    return judged.select(
        ts(as_of).alias("report_date"),
        F.lit(model_version_id).cast("long").alias("model_version_id"),
        "drift_score",
        body.alias("feature_drifts"),
        "alert_triggered",
        "remediation_action",
        "severity",
        "alert_message",
    )
