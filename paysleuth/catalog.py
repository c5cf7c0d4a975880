"""Every operator as a named query over the given tables: name -> (spark, folder of the tables) -> DataFrame.

Doubles are rounded to six decimals on the way out, so that results compare by value.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysleuth.functions import scalars
from paysleuth.operators import aggregates as agg
from paysleuth.operators import alerts, continuous, deploy, detect, drift, imbalance, learn, maintain, metrics, monitor, quality, search, training
from paysleuth.operators import encoders as enc
from paysleuth.operators import features as feat
from paysleuth.operators import selection as sel
from paysleuth.operators import split as cut
from paysleuth.plans.ordered import SplitPolicy, global_index
from paysleuth.plans.sizing import with_row
from paysleuth.schemas import FEATURES, MODEL_INPUT, PROFILE_FEATURES, RAW_TRANSACTION, WINDOW_FEATURES
from paysleuth.session import materialized, scratch_path
from paysleuth.sources import daytable, streams, tables, views
from paysleuth.streaming import aggregates as sagg
from paysleuth.streaming import features as sfeat
from paysleuth.streaming import history

AS_OF = views.AS_OF
MIDDLE = "2024-01-16 00:00:00"

# Cuts groups on tables of any size: the same results by the path that very large groups take.
FORCED = SplitPolicy(rows_per_segment=40, max_segments=64)

QUERIES = {}


def rounded(df):
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c), 6) for c in doubles}) if doubles else df


def query(fn, name=None):
    @wraps(fn)
    def run(spark, sf):
        return rounded(fn(spark, sf))

    QUERIES[name or fn.__name__] = run
    return fn


# ---- sources, sinks, ingest


@query
def scan_transactions(spark, sf):
    return tables.scan_transactions(views.transactions(spark, sf), "2024-01-05 00:00:00", "2024-01-25 00:00:00", True)


@query
def scan_recent(spark, sf):
    return tables.scan_recent(views.transactions(spark, sf), AS_OF, path=scratch_path(spark, "recent"))


@query
def user_history_7d(spark, sf):
    return tables.user_history_7d(views.transactions(spark, sf, user_id="user_0007"), "user_0007", AS_OF)


def _messages_folder(spark, sf):
    """The messages of all transactions as text files, a few per run, as a stream would find them."""
    path = scratch_path(spark, "messages")
    views.raw_messages(spark, sf).select("value").repartition(4).write.text(path)
    return path


@query
def stream_source(spark, sf):
    decoded = streams.stream_source(spark, _messages_folder(spark, sf), maxFilesPerTrigger="2")
    return streams.run_to_table(streams.good_rows(decoded))


@query
def stream_source_features(spark, sf):
    path = scratch_path(spark, "enriched")
    enriched = feat.feature_map(feat.behaviour_features(views.transactions(spark, sf).drop("is_fraud")))
    shown = enriched.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    shown.select(F.to_json(F.struct(*shown.columns))).write.text(path)
    decoded = streams.good_rows(streams.stream_source_features(spark, path))
    table = streams.run_to_table(decoded)
    return table.select("transaction_id", "timestamp", *[F.col("features")[n].alias(n) for n in WINDOW_FEATURES + PROFILE_FEATURES])


@query
def dead_letter_split(spark, sf):
    good, dead = tables.dead_letter_split(views.raw_messages(spark, sf))
    kept = good.select(F.lit("good").alias("sink"), "transaction_id", F.col("amount"))
    lost = dead.select(
        F.lit("dead").alias("sink"), F.col("offset").cast("string").alias("transaction_id"),
        F.lit(None).cast("double").alias("amount"),
    )
    return kept.unionByName(lost)


@query
def stream_dead_letters(spark, sf):
    good, dead = scratch_path(spark, "good"), scratch_path(spark, "dead")
    decoded = streams.stream_source(spark, _messages_folder(spark, sf), maxFilesPerTrigger="2")
    streams.run_batches(decoded, streams.split_sinks(good, dead))
    counts = [
        spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(sink).alias("sink"), "n")
        for sink, path in (("good", good), ("dead", dead))
    ]
    return counts[0].unionByName(counts[1])


@query
def validate_uuid(spark, sf):
    hexes = F.md5("transaction_id")
    part = lambda a, n: F.substring(hexes, a, n)
    dashed = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    n = F.col("transaction_id").cast("long") % 5
    spelled = (
        F.when(n == 0, dashed)
        .when(n == 1, hexes)
        .when(n == 2, F.concat(F.lit("{"), dashed, F.lit("}")))
        .when(n == 3, F.concat(F.lit("urn:uuid:"), dashed))
        .otherwise(part(1, 31))
    )
    tx = views.transactions(spark, sf).select(F.col("transaction_id").alias("number"), spelled.alias("transaction_id"))
    return tables.validate_uuid(tx)


@query
def validate_request(spark, sf):
    tx = views.transactions(spark, sf)
    n = F.col("transaction_id").cast("long")
    broken = tx.withColumns(
        {
            "amount": F.when(n % 7 == 0, -F.col("amount")).otherwise(F.col("amount")),
            "country": F.when(n % 11 == 0, F.lit(None)).otherwise(F.col("country")),
        }
    )
    given = {c: F.lit(1.0) for c in WINDOW_FEATURES + PROFILE_FEATURES}
    pairs = [x for c, v in given.items() if c != "tx_count_7d" for x in (F.lit(c), v)]
    full = F.create_map(*pairs, F.lit("tx_count_7d"), F.lit(1.0))
    requests = broken.withColumn("features", F.when(n % 13 == 0, F.create_map(*pairs)).otherwise(full))
    return tables.validate_request(requests).select("transaction_id", "valid", "reason")


@query
def upsert_transactions(spark, sf):
    """Half of the table, then all of it twice over: each row is stored once."""
    tx = views.transactions(spark, sf)
    path = scratch_path(spark, "transactions")
    tables.upsert_transactions(spark, tx.filter(F.col("timestamp") < F.lit(MIDDLE).cast("timestamp")), path)
    table = tables.upsert_transactions(spark, tx.unionByName(tx), path)
    return table.select(*tx.columns)


@query
def publish_features(spark, sf):
    enriched = feat.feature_map(feat.behaviour_features(views.transactions(spark, sf)))
    path = scratch_path(spark, "features")
    tables.append(enriched, path)
    stored = spark.read.schema(enriched.schema).parquet(path)
    names = WINDOW_FEATURES + PROFILE_FEATURES
    return stored.select("transaction_id", *[F.col("features")[n].alias(n) for n in names])


@query
def publish_alerts(spark, sf):
    return alerts.publish_alerts(views.predictions_history(spark, sf))


@query
def alert_log_sink(spark, sf):
    """Alerts of the stream of predictions appended to the alert log."""
    found = alerts.fraud_rate_alerts(views.predictions_history(spark, sf), threshold=0.4)
    path = scratch_path(spark, "alert-log")
    tables.append(found, path)
    return spark.read.schema(found.schema).parquet(path)


@query
def reference_snapshot(spark, sf):
    matrix = _selected(_matrix(spark, sf))
    return tables.reference_snapshot(matrix, scratch_path(spark, "reference"))


_REFERENCES = {}


def _reference(spark, sf):
    """(matrix with the stored encoders, path of the stored reference): the first half of the month, stored once."""
    key = (spark.sparkContext.applicationId, sf)
    tx = views.transactions(spark, sf)
    if key not in _REFERENCES:
        path = scratch_path(spark, "drift-reference")
        enc.EncoderSet.fit(tx, until=MIDDLE).save(f"{path}/encoders")
        matrix = feat.featurize(tx, enc.EncoderSet.load(spark, f"{path}/encoders"))
        drift.store_reference(matrix.filter(F.col("timestamp") < F.lit(MIDDLE).cast("timestamp")), MODEL_INPUT, path)
        _REFERENCES[key] = path
    path = _REFERENCES[key]
    return feat.featurize(tx, enc.EncoderSet.load(spark, f"{path}/encoders")), path


def _input_drift(spark, sf, **parameters):
    """All model inputs of the second half, featured over their whole history, against the stored counts of the first."""
    matrix, path = _reference(spark, sf)
    current = matrix.filter(F.col("timestamp") >= F.lit(MIDDLE).cast("timestamp"))
    return drift.counted_drift(drift.reference_counts(spark, path), drift.value_counts(current, MODEL_INPUT), **parameters)


@query
def drift_report_sink(spark, sf):
    """Drift as one job: stored encoders and reference, all inputs, the model's figures, policy, stored report."""
    ph, md = views.predictions_history(spark, sf), views.model_deployments(spark, sf)
    row = drift.drift_report_row(_input_drift(spark, sf), drift.model_drift(ph, md, 2, AS_OF), 2, AS_OF)
    path = scratch_path(spark, "drift-reports")
    tables.append(row, path)
    stored = spark.read.schema(row.schema).parquet(path)
    return stored.select(
        "report_date", "model_version_id", "drift_score", "alert_triggered", "remediation_action", "severity", "alert_message",
        F.get_json_object("feature_drifts", "$.data_drift.tx_count_1h.drift_score").cast("double").alias("tx_count_1h_drift"),
        F.get_json_object("feature_drifts", "$.model_drift.detected").alias("model_drift_detected"),
    )


# ---- scalar functions


@query
def direct_features(spark, sf):
    df = feat.direct_features(views.transactions(spark, sf))
    return df.select("transaction_id", "log_amount", "hour_of_day", "day_of_week")


@query
def log_amount_clip(spark, sf):
    return feat.log_amount_clip(views.transactions(spark, sf)).select("transaction_id", "log_amount")


@query
def cyclic_time(spark, sf):
    df = feat.cyclic_time(views.transactions(spark, sf))
    return df.select("transaction_id", "hour_sin", "hour_cos", "dow_sin", "dow_cos")


@query
def request_vector(spark, sf):
    tx = views.transactions(spark, sf)
    requests = feat.feature_map(feat.behaviour_features(tx))
    return feat.request_vector(requests, enc.EncoderSet.fit(tx))


@query
def severity(spark, sf):
    ph = views.predictions_history(spark, sf)
    return ph.select("transaction_id", scalars.severity("prediction_score").alias("severity"))


@query
def sql_functions(spark, sf):
    """The scalar helpers registered as SQL functions."""
    scalars.register(spark)
    views.predictions_history(spark, sf).createOrReplaceTempView("paysleuth_predictions")
    return spark.sql(
        "SELECT transaction_id, fraud_severity(prediction_score) AS severity, "
        "session_bucket(transaction_id, timestamp, 30) AS session FROM paysleuth_predictions"
    )


@query
def score_label(spark, sf):
    ph = views.predictions_history(spark, sf)
    return ph.select("transaction_id", (F.col("prediction_score") >= 0.5).alias("prediction_label"))


@query
def slow_requests(spark, sf):
    return monitor.slow_requests(views.predictions_history(spark, sf), 40.0)


@query
def session_bucket(spark, sf):
    tx = views.transactions(spark, sf)
    return tx.select(
        "transaction_id",
        scalars.session_start("timestamp").alias("session_start"),
        scalars.session_hash("user_id", "timestamp").alias("session"),
    )


@query
def epoch_bucket(spark, sf):
    tx = views.transactions(spark, sf)
    buckets = {f"bucket_{n}": scalars.epoch_bucket("timestamp", n) for n in (60, 120, 300)}
    return tx.select("transaction_id", *[c.alias(n) for n, c in buckets.items()])


@query
def json_explode(spark, sf):
    return monitor.json_explode(views.drift_reports(spark, sf))


@query
def rate_message(spark, sf):
    hourly = agg.fraud_volume_hourly(views.transactions(spark, sf))
    return hourly.select("bucket_hour", scalars.rate_text("fraud_rate").alias("message"))


@query
def safe_ratio(spark, sf):
    hourly = agg.fraud_volume_hourly(views.transactions(spark, sf))
    return hourly.select(
        "bucket_hour", scalars.safe_ratio("total_transactions", "total_fraud_transactions").alias("per_fraud")
    )


@query
def constraint_audit(spark, sf):
    md = views.model_deployments(spark, sf)
    return monitor.constraint_audit(
        md, views.predictions_history(spark, sf), views.drift_reports(spark, sf), views.alert_log(spark, sf),
        views.transactions(spark, sf),
    )


# ---- joins


@query
def drift_alert_history(spark, sf):
    return monitor.drift_alert_history(views.drift_reports(spark, sf), views.model_deployments(spark, sf))


@query
def latest_report_features(spark, sf):
    return monitor.latest_report_features(views.drift_reports(spark, sf))


@query
def recent_open_alert(spark, sf):
    ph = views.predictions_history(spark, sf).select("transaction_id", "timestamp")
    return alerts.recent_open_alert(ph, views.alert_log(spark, sf), minutes=1440)


@query
def encode_lookup(spark, sf):
    tx = views.transactions(spark, sf)
    fitted = enc.target_encode_fit(tx.filter("country <> 'AR'"), "country").filter("category IS NOT NULL")
    return enc.encode_lookup(tx, fitted, "country", F.lit(-1.0)).select("transaction_id", "country_encoded")


@query
def label_backfill(spark, sf):
    ph = views.predictions_history(spark, sf).withColumn("actual_label", F.lit(None).cast("boolean"))
    truth = views.transactions(spark, sf).filter(F.col("is_fraud").isNotNull())
    return monitor.label_backfill(ph, truth).select("transaction_id", "prediction_label", "actual_label")


@query
def txn_vs_pred_rate(spark, sf):
    ph = views.predictions_history(spark, sf).filter("prediction_label")
    return agg.txn_vs_pred_rate(views.transactions(spark, sf), ph)


@query
def smote_neighbors(spark, sf):
    """The five nearest frauds of each: how far they are (which of two at the same distance comes first is open)."""
    fraud = _labelled_matrix(spark, sf).filter("label = 1")
    return imbalance.nearest_rows(fraud, "transaction_id", MODEL_INPUT, 5).select("key", "rank", "distance")


# ---- per-user features


def _matrix(spark, sf):
    tx = views.transactions(spark, sf)
    return feat.featurize(tx, enc.EncoderSet.fit(tx))


def _labelled_matrix(spark, sf):
    matrix = _matrix(spark, sf).filter(F.col("is_fraud").isNotNull())
    return matrix.withColumn("label", F.col("is_fraud").cast("int"))


def _selected(matrix):
    return feat.select_columns(matrix, MODEL_INPUT)


@query
def featurize(spark, sf):
    return _matrix(spark, sf)


@query
def featurize_large_groups(spark, sf):
    """The same matrix with every user treated as too large for one task."""
    tx = views.transactions(spark, sf)
    return feat.featurize(tx, enc.EncoderSet.fit(tx), policy=FORCED)


def _new_shipments(spark, sf):
    """The shipments of distinct keys, computed once: users are counted before their rows are read."""
    return materialized(tables.new_rows(views.shipments(spark, sf), None), "shipments")


@query
def featurize_ties(spark, sf):
    """Behaviour features over shipments, where many rows share a user and a time."""
    ship = _new_shipments(spark, sf)
    return _behaviour(feat.behaviour_features(ship))


@query
def featurize_ties_large_groups(spark, sf):
    ship = _new_shipments(spark, sf)
    return _behaviour(feat.behaviour_features(ship, policy=FORCED))


@query
def featurize_arrival(spark, sf):
    """Rows of the same time count in id order; velocity per minute."""
    ship = _new_shipments(spark, sf)
    return _behaviour(feat.behaviour_features(ship, velocity="per_minute", ties="arrival"))


@query
def featurize_arrival_large_groups(spark, sf):
    ship = _new_shipments(spark, sf)
    return _behaviour(feat.behaviour_features(ship, velocity="per_minute", ties="arrival", policy=FORCED))


def _behaviour(df):
    return df.select("transaction_id", "user_id", "timestamp", *WINDOW_FEATURES, *PROFILE_FEATURES)


def _one_feature(name):
    def run(spark, sf):
        return feat.behaviour_features(views.transactions(spark, sf)).select("transaction_id", name)

    run.__name__ = name
    query(run)


for _name in WINDOW_FEATURES + PROFILE_FEATURES:
    _one_feature(_name)


@query
def select_columns(spark, sf):
    return _selected(_matrix(spark, sf))


@query
def user_profile(spark, sf):
    profile = feat.user_profile(views.transactions(spark, sf))
    texts = {c: F.array_join(c, ",") for c in ("countries_seen", "merchants_seen")}
    return profile.withColumns(texts)


@query
def user_window(spark, sf):
    return feat.user_window(views.transactions(spark, sf), AS_OF).select("transaction_id", "user_id")


@query
def hydrate_filter(spark, sf):
    return feat.hydrate_filter(views.transactions(spark, sf), AS_OF).select("transaction_id", "user_id", "timestamp")


# ---- fraud patterns


def _behaviour_of_tx(spark, sf):
    return feat.behaviour_features(views.transactions(spark, sf))


@query
def detect_amount_anomaly(spark, sf):
    return detect.detect_amount_anomaly(_behaviour_of_tx(spark, sf), ratio=3.0, amount=100.0)


@query
def detect_unusual_country(spark, sf):
    return detect.detect_unusual_country(_behaviour_of_tx(spark, sf), views.transactions(spark, sf))


@query
def detect_high_frequency(spark, sf):
    return detect.detect_high_frequency(views.purchases(spark, sf))


@query
def detect_high_frequency_large_groups(spark, sf):
    return detect.detect_high_frequency(views.purchases(spark, sf), policy=FORCED)


@query
def burst_users(spark, sf):
    return detect.burst_users(views.purchases(spark, sf), "2001-07-01 00:30:00", minutes=30 * 24 * 60)


@query
def detect_unknown_merchant_high(spark, sf):
    return detect.detect_unknown_merchant_high(_behaviour_of_tx(spark, sf), amount=100.0)


@query
def detect_any(spark, sf):
    tx = views.transactions(spark, sf)
    return detect.detect_any(feat.behaviour_features(tx), tx)


# ---- aggregations


@query
def fraud_volume_hourly(spark, sf):
    return agg.fraud_volume_hourly(views.transactions(spark, sf))


_AGGREGATES = {}


def _continuous(spark, sf, name, rollup):
    """The stored aggregate of this folder's transactions, refreshed up to a day before ``AS_OF`` when first asked for."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _AGGREGATES:
        stored = continuous.ContinuousAggregate(spark, scratch_path(spark, name), rollup)
        stored.refresh(views.transactions(spark, sf), "2024-01-30 00:05:00")
        _AGGREGATES[key] = stored
    return _AGGREGATES[key]


@query
def fraud_volume_24h(spark, sf):
    """Stored hours and the raw rows of the last day."""
    hourly = _continuous(spark, sf, "fraud-hourly", continuous.FRAUD_HOURLY)
    return agg.fraud_volume_24h(hourly.read(views.transactions(spark, sf), since="2024-01-30 00:00:00"), AS_OF)


@query
def merchant_amount_daily(spark, sf):
    return agg.merchant_amount_daily(views.transactions(spark, sf))


@query
def merchant_daily_top50(spark, sf):
    """Stored days and the raw rows of the last one."""
    daily = _continuous(spark, sf, "merchant-daily", continuous.MERCHANT_DAILY)
    return agg.merchant_daily_top50(daily.read(views.transactions(spark, sf), since="2024-01-24 00:00:00"), AS_OF)


@query
def continuous_hourly(spark, sf):
    """A stored aggregate through three refreshes, a late row's addition and a second look at the last days."""
    tx = views.transactions(spark, sf)
    late = (F.pmod(F.xxhash64("transaction_id"), F.lit(50)) == 0) & (F.col("timestamp") < F.lit("2024-01-05").cast("timestamp"))
    hourly = continuous.ContinuousAggregate(spark, scratch_path(spark, "hourly"), continuous.FRAUD_HOURLY)
    hourly.refresh(tx.filter(~late), "2024-01-10 07:30:00")
    hourly.add(tx.filter(late))
    hourly.refresh(tx.filter(~late), "2024-01-20 00:00:00")
    hourly.refresh(tx, "2024-01-25 12:00:00", days=7)
    return hourly.read(tx)


@query
def refresh_aggregate(spark, sf):
    tx = views.transactions(spark, sf)
    old = agg.fraud_volume_hourly(tx.filter(F.col("timestamp") < F.lit("2024-01-12").cast("timestamp")))
    return maintain.refresh_aggregate(old, tx, agg.fraud_volume_hourly, "bucket_hour", "hour", AS_OF, days=20)


@query
def top_merchants_fraud(spark, sf):
    return agg.top_merchants_fraud(views.transactions(spark, sf), AS_OF)


@query
def fraud_rate_1h(spark, sf):
    return agg.fraud_rate_1h(views.predictions_history(spark, sf), AS_OF)


@query
def volume_per_minute(spark, sf):
    return agg.volume_per_minute(views.predictions_history(spark, sf))


@query
def fraud_count_1h(spark, sf):
    return agg.fraud_count_1h(views.predictions_history(spark, sf), AS_OF)


@query
def txn_total_1h(spark, sf):
    return agg.txn_total_1h(agg.fraud_volume_hourly(views.transactions(spark, sf)), AS_OF)


@query
def volume_24h(spark, sf):
    return agg.volume_24h(views.transactions(spark, sf), views.predictions_history(spark, sf), AS_OF)


@query
def txn_2min(spark, sf):
    return agg.count_per_bucket(views.transactions(spark, sf), 120, "transactions")


@query
def pred_2min(spark, sf):
    return agg.count_per_bucket(views.predictions_history(spark, sf), 120, "predictions")


@query
def latency_percentiles(spark, sf):
    return agg.latency_percentiles(views.predictions_history(spark, sf))


@query
def latency_percentiles_large_groups(spark, sf):
    return agg.latency_percentiles(views.predictions_history(spark, sf), 864_000, FORCED)


@query
def drift_alerts_7d(spark, sf):
    return monitor.drift_alerts_7d(views.drift_reports(spark, sf), AS_OF)


@query
def labeled_summary(spark, sf):
    return agg.labeled_summary(views.transactions(spark, sf))


@query
def seed_summary(spark, sf):
    return agg.seed_summary(views.transactions(spark, sf))


@query
def class_distribution(spark, sf):
    return agg.class_distribution(views.transactions(spark, sf))


@query
def amount_stats(spark, sf):
    return agg.amount_stats(views.transactions(spark, sf))


@query
def amount_histogram(spark, sf):
    return agg.amount_histogram(views.transactions(spark, sf))


@query
def by_hour(spark, sf):
    return agg.by_hour(views.transactions(spark, sf))


@query
def by_dow(spark, sf):
    return agg.by_dow(views.transactions(spark, sf))


@query
def by_country(spark, sf):
    return agg.by_category(views.transactions(spark, sf), "country")


@query
def by_category(spark, sf):
    return agg.by_category(views.transactions(spark, sf), "merchant_category")


@query
def by_device(spark, sf):
    return agg.by_category(views.transactions(spark, sf), "device_type", top=None)


@query
def daily_series(spark, sf):
    return agg.daily_series(views.transactions(spark, sf))


@query
def heatmap_hour_dow(spark, sf):
    return agg.heatmap_hour_dow(views.transactions(spark, sf))


@query
def top_combos(spark, sf):
    return agg.top_combos(agg.heatmap_hour_dow(views.transactions(spark, sf)))


@query
def describe(spark, sf):
    return agg.describe(feat.direct_features(views.transactions(spark, sf)), ["amount", "log_amount", "hour_of_day"])


@query
def missing_domain(spark, sf):
    return agg.missing_domain(views.transactions(spark, sf))


# ---- newest rows


@query
def recent_alerts(spark, sf):
    return monitor.recent_alerts(views.alert_log(spark, sf))


@query
def latest_drift(spark, sf):
    return monitor.latest_drift(views.drift_reports(spark, sf))


@query
def drift_series(spark, sf):
    return monitor.drift_series(views.drift_reports(spark, sf))


@query
def score_series(spark, sf):
    return monitor.score_series(views.predictions_history(spark, sf))


@query
def active_model(spark, sf):
    return monitor.active_model(views.model_deployments(spark, sf))


@query
def champion_challenger(spark, sf):
    return monitor.champion_challenger(views.model_deployments(spark, sf))


# ---- feature statistics and preparation


@query
def target_encode_fit(spark, sf):
    return enc.target_encode_fit(views.transactions(spark, sf), "merchant_category")


@query
def target_encode(spark, sf):
    tx = views.transactions(spark, sf)
    fitted = enc.target_encode_fit(tx.filter("country <> 'AR'"), "country")
    return enc.target_encode(tx, fitted, "country").select("transaction_id", "country_encoded")


@query
def ordinal_encode_fit(spark, sf):
    return enc.ordinal_encode_fit(views.transactions(spark, sf), "merchant_id")


@query
def ordinal_encode(spark, sf):
    tx = views.transactions(spark, sf)
    fitted = enc.ordinal_encode_fit(tx.filter("device_type <> 'pos'"), "device_type")
    return enc.ordinal_encode(tx, fitted, "device_type").select("transaction_id", "device_type_encoded")


@query
def label_encode(spark, sf):
    tx = views.transactions(spark, sf)
    return enc.label_encode(tx, "merchant_id", policy=FORCED).select("transaction_id", "merchant_id_enc")


@query
def encoder_set(spark, sf):
    """The three encoders fitted, saved, loaded again and applied."""
    tx = views.transactions(spark, sf)
    path = scratch_path(spark, "encoders")
    enc.EncoderSet.fit(tx).save(path)
    coded = enc.EncoderSet.load(spark, path).transform(tx)
    return coded.select("transaction_id", "merchant_category_encoded", "country_encoded", "device_type_encoded")


@query
def encoder_set_until(spark, sf):
    """Encoders fitted on the rows before a time only."""
    tx = views.transactions(spark, sf)
    coded = enc.EncoderSet.fit(tx, until=MIDDLE).transform(tx)
    return coded.select("transaction_id", "merchant_category_encoded", "country_encoded", "device_type_encoded")


CORRELATED = ["amount", "log_amount", "hour_of_day", "day_of_week", "tx_count_7d", "amount_sum_24h"]


def _with_direct(spark, sf):
    return feat.direct_features(_behaviour_of_tx(spark, sf))


@query
def correlation_matrix(spark, sf):
    return sel.correlation_matrix(_with_direct(spark, sf), CORRELATED)


@query
def redundant_pairs(spark, sf):
    return sel.redundant_pairs(_with_direct(spark, sf), [*CORRELATED, "tx_count_24h"], 0.5)


def _fixed_importances(df, columns):
    """Importances with plain values: the share of rows in which a column is positive."""
    shares = df.agg(*[F.avg((F.col(c) > 0).cast("int")).alias(c) for c in columns])
    return shares.unpivot([], columns, "feature", "importance")


@query
def select_features(spark, sf):
    df = materialized(_with_direct(spark, sf), "selection")
    columns = [*CORRELATED, "tx_count_24h", "tx_count_1h"]
    pairs = sel.redundant_pairs(df, columns, 0.5)
    return sel.select_features(columns, _fixed_importances(df, columns), pairs, ["hour_of_day"], 0.1)


@query
def feature_importance(spark, sf):
    return learn.feature_importance(_training_rows(spark, sf), MODEL_INPUT, trees=20)


def _training_rows(spark, sf):
    """The feature matrix with its label, computed once for the fits that read it many times."""
    return materialized(_labelled_matrix(spark, sf).drop("is_fraud"), "training")


_PARTS, _MODELS = {}, {}


def _parts(spark, sf):
    """The training parts of this folder's transactions, built when first asked for."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PARTS:
        _PARTS[key] = training.training_parts(views.transactions(spark, sf))
    return _PARTS[key]


def _trained(spark, sf):
    """The model trained on them with the default parameters, once for all queries that use it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = training.train_and_evaluate(_parts(spark, sf))
    return _MODELS[key]


@query
def forest_importance(spark, sf):
    return learn.forest_importance(_training_rows(spark, sf), MODEL_INPUT, trees=50)


@query
def shadow_feature_test(spark, sf):
    return learn.shadow_feature_test(_parts(spark, sf).train, MODEL_INPUT, trees=20)


@query
def scale_pos_weight(spark, sf):
    return imbalance.scale_pos_weight(views.transactions(spark, sf).filter(F.col("is_fraud").isNotNull()))


@query
def smote(spark, sf):
    return imbalance.smote(_training_rows(spark, sf), MODEL_INPUT)


@query
def smote_class_counts(spark, sf):
    grown = imbalance.smote(_training_rows(spark, sf), MODEL_INPUT)
    return grown.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query
def imbalance_compare(spark, sf):
    parts = _parts(spark, sf)
    return learn.imbalance_compare(parts.train, parts.validation, MODEL_INPUT)


@query
def temporal_split(spark, sf):
    labelled = views.transactions(spark, sf).filter(F.col("is_fraud").isNotNull())
    return cut.temporal_split(labelled).select("transaction_id", "split")


@query
def temporal_split_ties(spark, sf):
    """The split over shipments of day grain, with the cuts inside a day of many rows."""
    ship = tables.new_rows(views.shipments(spark, sf), None)
    return cut.temporal_split(ship, policy=FORCED).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )


@query
def test_slice(spark, sf):
    tx = views.transactions(spark, sf)
    rows = cut.test_slice(tx, "2024-01-03 00:00:00", "2024-01-27 00:00:00", minimum=10)
    return rows.select("transaction_id", "timestamp")


@query
def global_row_index(spark, sf):
    tx = views.transactions(spark, sf)
    return global_index(tx.select("transaction_id", "timestamp"), ["timestamp", "transaction_id"], policy=FORCED)


@query
def train_model(spark, sf):
    """Up to 300 trees of depth 6 with patience, the threshold of least cost, and figures on the test part."""
    return _trained(spark, sf).report


@query
def training_parts(spark, sf):
    """Sizes and frauds of the three parts, and the codes of the encoders that saw the first one only."""
    parts = _parts(spark, sf)
    counted = [
        getattr(parts, name).agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("label").alias("frauds"), F.sum("country_encoded").alias("codes"))
        for name in ("train", "validation", "test")
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query
def register_model(spark, sf):
    """The deployments after the trained model's promotion; its figures are in ``train_model``."""
    parts, trained = _parts(spark, sf), _trained(spark, sf)
    table = training.register(views.model_deployments(spark, sf), trained, parts, "run_new", "new", AS_OF)
    return table.select("id", "run_id", "version", "is_active", "training_data_from", "training_data_to")


@query
def tune_model(spark, sf):
    """The whole search: 30 trials of 100 to 600 trees, each grown until patience ends it."""
    parts = _parts(spark, sf)
    return search.tune_boosted(parts.train, parts.validation, MODEL_INPUT)


@query
def score(spark, sf):
    matrix = feat.featurize(views.transactions(spark, sf), _parts(spark, sf).encoders)
    return learn.score(matrix, _trained(spark, sf).model, model_version="2")


@query
def score_facts(spark, sf):
    """Every transaction is scored once, between 0 and 1, and labelled by the threshold."""
    scored = score(spark, sf)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("transaction_id").alias("ids"),
        F.count_if(F.col("prediction_score").between(0, 1)).alias("in_range"),
        F.count_if(F.col("prediction_label") == (F.col("prediction_score") >= 0.5)).alias("labelled"),
        F.count_if(F.col("model_version") == "2").alias("versioned"),
    )


# ---- evaluation


def _scores(spark, sf):
    return metrics.labelled_scores(views.predictions_history(spark, sf), "actual_label", "prediction_score")


@query
def confusion(spark, sf):
    return metrics.confusion(_scores(spark, sf))


@query
def binary_metrics(spark, sf):
    return metrics.binary_metrics(_scores(spark, sf), 0.3)


@query
def roc_auc(spark, sf):
    return metrics.roc_auc(_scores(spark, sf))


@query
def roc_auc_large_groups(spark, sf):
    return metrics.roc_auc(_scores(spark, sf), FORCED)


@query
def pr_auc(spark, sf):
    return metrics.pr_auc(_scores(spark, sf))


@query
def roc_curve(spark, sf):
    return metrics.roc_curve(_scores(spark, sf))


@query
def pr_curve(spark, sf):
    return metrics.pr_curve(_scores(spark, sf), FORCED)


@query
def threshold_metrics(spark, sf):
    return metrics.threshold_metrics(_scores(spark, sf))


@query
def optimal_threshold(spark, sf):
    return metrics.optimal_threshold(_scores(spark, sf))


@query
def quality_gates(spark, sf):
    scores = _scores(spark, sf)
    f1 = metrics.binary_metrics(scores).select("f1_score")
    auc = metrics.roc_auc(scores).select(F.col("roc_auc").alias("auc_roc"))
    ph = views.predictions_history(spark, sf)
    p99 = agg.exact_quantiles(ph, [], "latency_ms", {"latency_p99_ms": 0.99})
    return metrics.quality_gates(with_row(with_row(f1, auc), p99))


@query
def champion_compare(spark, sf):
    md = views.model_deployments(spark, sf)
    champion = md.filter("is_active")
    challengers = md.filter("NOT is_active")
    newest = challengers.orderBy(F.desc("created_at"), F.desc("id")).limit(1)
    return metrics.champion_compare(newest, champion)


@query
def promote_model(spark, sf):
    md = views.model_deployments(spark, sf)
    return deploy.promote_model(
        md, "run_new", "new", {"f1_score": 0.5, "precision": 0.6, "recall": 0.4, "auc_roc": 0.9}, AS_OF,
        "2024-01-01 00:00:00", "2024-01-30 00:00:00",
    )


@query
def promote_model_known_run(spark, sf):
    md = views.model_deployments(spark, sf)
    return deploy.promote_model(md, "run_4", "5", {}, AS_OF, AS_OF, AS_OF).select("id", "run_id", "is_active")


# ---- drift and data quality


def _drift_sides(spark, sf):
    rows = feat.direct_features(views.transactions(spark, sf))
    middle = F.lit(MIDDLE).cast("timestamp")
    return rows.filter(F.col("timestamp") < middle), rows.filter(F.col("timestamp") >= middle)


DRIFT_COLUMNS = ["amount", "log_amount", "hour_of_day", "day_of_week"]


def _drift_query(test, policy=None):
    def run(spark, sf):
        reference, current = _drift_sides(spark, sf)
        current = current.withColumn("amount", F.col("amount") * 5)
        extra = {} if policy is None else {"policy": policy}
        return drift.data_drift(reference, current, DRIFT_COLUMNS, test, **extra)

    return run


query(_drift_query("ks"), "data_drift_direct")


@query
def data_drift(spark, sf):
    return _input_drift(spark, sf)


@query
def data_drift_large_groups(spark, sf):
    return _input_drift(spark, sf, policy=FORCED)


query(_drift_query("wasserstein"), "data_drift_wasserstein")
query(_drift_query("jensen_shannon"), "data_drift_jensen_shannon")
query(_drift_query("psi"), "data_drift_psi")


@query
def dataset_drift(spark, sf):
    one = drift.dataset_drift(_input_drift(spark, sf), 0.25)
    return one.select("drift_share", "dataset_drift", F.array_join("drifted_features", ",").alias("drifted_features"))


@query
def drift_rows_guard(spark, sf):
    return drift.drift_rows_guard(agg.since(views.transactions(spark, sf), AS_OF, "24 HOURS"))


@query
def model_drift(spark, sf):
    ph, md = views.predictions_history(spark, sf), views.model_deployments(spark, sf)
    return drift.model_drift(ph, md, 2, AS_OF)


@query
def drift_policy(spark, sf):
    reports = views.drift_reports(spark, sf)
    parsed = monitor.parsed_reports(reports)
    judged = drift.drift_policy(parsed)
    return judged.select(
        "id", "severity", "alert_message", "alert_triggered", "trigger_retraining", "remediation_action"
    )


@query
def dq_volume(spark, sf):
    return quality.dq_volume(views.transactions(spark, sf), AS_OF, minimum=100)


@query
def dq_predictions(spark, sf):
    return quality.dq_predictions(views.predictions_history(spark, sf), AS_OF)


@query
def dq_amount(spark, sf):
    return quality.dq_amount(views.transactions(spark, sf), AS_OF, high=100.0)


@query
def dq_summary(spark, sf):
    tx, ph = views.transactions(spark, sf), views.predictions_history(spark, sf)
    return quality.dq_summary(quality.dq_volume(tx, AS_OF), quality.dq_predictions(ph, AS_OF), quality.dq_amount(tx, AS_OF))


@query
def rule_fraud_rate(spark, sf):
    hourly = agg.fraud_volume_hourly(views.transactions(spark, sf))
    return quality.rule_fraud_rate(hourly, AS_OF)


@query
def rule_fraud_spike(spark, sf):
    return quality.rule_fraud_spike(views.transactions(spark, sf), AS_OF, threshold=1.0, span="6 HOURS")


@query
def rule_drift(spark, sf):
    return quality.rule_drift(views.drift_reports(spark, sf), AS_OF)


@query
def rule_drift_stale(spark, sf):
    return quality.rule_drift_stale(views.drift_reports(spark, sf), AS_OF)


def _minute_ticks(spark, sf):
    per_minute = agg.volume_per_minute(views.predictions_history(spark, sf), 600)
    return per_minute.select("time", (F.col("fraud") / F.col("total") > 0.1).alias("high"))


@query
def rule_hold(spark, sf):
    return alerts.rule_hold(_minute_ticks(spark, sf), "high", 1200, 600)


@query
def rule_hold_large_groups(spark, sf):
    return alerts.rule_hold(_minute_ticks(spark, sf), "high", 1200, 600, FORCED)


@query
def fraud_rate_alerts(spark, sf):
    return alerts.fraud_rate_alerts(views.predictions_history(spark, sf), threshold=0.4)


@query
def fraud_rate_alerts_large_groups(spark, sf):
    return alerts.fraud_rate_alerts(views.predictions_history(spark, sf), threshold=0.4, policy=FORCED)


# ---- streams


def _tx_stream(spark, sf):
    """The transactions as a stream: the view's projection over the streamed events table."""
    schema = views.table(spark, sf, "events").schema
    return views.transactions_of(streams.table_stream(spark, sf, "events", schema))


@query
def stream_features(spark, sf):
    return _behaviour(streams.run_to_table(sfeat.stream_features(_tx_stream(spark, sf))))


def _deliveries(spark, sf, parts, late):
    """The transactions arrive in ``parts`` by time, as a stream: (stream, its offsets) after each arrival.

    With ``late``, one row in twenty comes with the part after its own.
    """
    tx = views.transactions(spark, sf)
    path, offsets = scratch_path(spark, "arrivals"), scratch_path(spark, "offsets")
    first, last = tx.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    width = (last - first) // parts + 1
    part = F.floor((F.unix_micros("timestamp") - F.lit(first)) / F.lit(width))
    if late:
        part = F.least(part + F.when(F.pmod(F.xxhash64("transaction_id"), F.lit(20)) == 0, 1).otherwise(0), F.lit(parts - 1))
    for k in range(parts):
        tx.filter(part == k).write.mode("append").parquet(path)
        yield spark.readStream.schema(tx.schema).parquet(path), offsets


@query
def stream_features_batches(spark, sf):
    """Five micro-batches with the state of the users in between."""
    out = scratch_path(spark, "sink")
    for stream, offsets in _deliveries(spark, sf, 5, late=False):
        result = streams.run_to_table(sfeat.stream_features(stream), offsets, out)
    return _behaviour(result)


@query
def stream_features_history(spark, sf):
    """The same by the stored history, which splits busy users; rows come late by days and change later ones."""
    store = history.HistoryStore(spark, scratch_path(spark, "history"), buckets=8)
    for stream, offsets in _deliveries(spark, sf, 5, late=True):
        streams.run_batches(stream, store.write, offsets)
    return _behaviour(store.features())


@query
def compressed_history(spark, sf):
    """Features of the second half of the month over a compressed first week."""
    tx = views.transactions(spark, sf)
    week = F.lit("2024-01-08 00:00:00").cast("timestamp")
    old = feat.compress_history(tx.filter(F.col("timestamp") < week))
    recent = tx.filter(F.col("timestamp") >= week).withColumn(feat.WEIGHT, F.lit(1).cast("long"))
    featured = feat.behaviour_features(recent.unionByName(old, allowMissingColumns=True))
    return _behaviour(featured.filter(F.col("timestamp") >= F.lit(MIDDLE).cast("timestamp")))


@query
def stream_label_backfill(spark, sf):
    """Predictions joined with their labels as two streams, labels arriving up to seven days later."""
    schema = views.table(spark, sf, "events").schema
    predictions = views.predictions_of(streams.table_stream(spark, sf, "events", schema))
    truth = _tx_stream(spark, sf).filter(F.col("is_fraud").isNotNull()).select(
        "transaction_id", "is_fraud", F.col("timestamp").alias("labelled_at")
    )
    joined = sagg.stream_label_backfill(predictions, truth)
    return streams.run_to_table(joined).select("transaction_id", "prediction_label", "actual_label")


@query
def stream_hourly(spark, sf):
    return streams.run_to_table(sagg.stream_hourly(_tx_stream(spark, sf)))


@query
def stream_merchant_daily(spark, sf):
    return streams.run_to_table(sagg.stream_merchant_daily(_tx_stream(spark, sf)))


@query
def stream_fraud_rate(spark, sf):
    schema = views.table(spark, sf, "events").schema
    predictions = views.predictions_of(streams.table_stream(spark, sf, "events", schema))
    return streams.run_to_table(sagg.stream_fraud_rate(predictions))


@query
def stream_dedup(spark, sf):
    schema = views.table(spark, sf, "lineitem").schema
    lines = streams.table_stream(spark, sf, "lineitem", schema).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
    )
    return streams.run_to_table(sagg.stream_dedup(lines)).select("transaction_id")


def _scored_stream(spark, sf):
    model, encoders = _trained(spark, sf).model, _parts(spark, sf).encoders
    enriched = sfeat.on_time(sfeat.stream_features(_tx_stream(spark, sf)))
    predictions, found = scratch_path(spark, "predictions"), scratch_path(spark, "alerts")
    prepare = lambda batch: encoders.transform(feat.direct_features(batch))
    streams.run_batches(enriched, sagg.score_batches(model, predictions, found, 2, prepare=prepare))
    return spark.read.parquet(predictions), spark.read.parquet(found)


@query
def stream_score(spark, sf):
    predictions, found = _scored_stream(spark, sf)
    marked = found.select("transaction_id", "severity")
    return predictions.join(marked, "transaction_id", "left").select(
        "transaction_id", "prediction_score", "prediction_label", "model_version_id", "severity"
    )


@query
def stream_score_facts(spark, sf):
    """The stream scores every transaction once, as the batch does, and alerts on those labelled fraud."""
    predictions, found = _scored_stream(spark, sf)
    batch = score(spark, sf).select("transaction_id", F.col("prediction_score").alias("batch_score"))
    same = F.abs(F.col("prediction_score") - F.col("batch_score")) < 1e-6
    both = predictions.join(batch, "transaction_id").join(found.select("transaction_id", "severity"), "transaction_id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("transaction_id").alias("ids"),
        F.count_if(same).alias("as_in_batch"),
        F.count_if(F.col("severity").isNotNull() == F.col("prediction_label")).alias("alerted"),
    )


@query
def publish_predictions(spark, sf):
    predictions, _ = _scored_stream(spark, sf)
    return predictions.select("transaction_id", "prediction_label", "model_version_id")


@query
def late_data(spark, sf):
    """Two deliveries, the second one with the first half of the month: its rows are late and set aside."""
    tx = views.transactions(spark, sf)
    path = scratch_path(spark, "late-input")
    middle = F.lit(MIDDLE).cast("timestamp")
    offsets, out = scratch_path(spark, "offsets"), scratch_path(spark, "sink")
    for part in (tx.filter(F.col("timestamp") >= middle), tx.filter(F.col("timestamp") < middle)):
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(tx.schema).parquet(path)
        result = streams.run_to_table(sfeat.stream_features(stream), offsets, out)
    return result.groupBy("late").agg(F.count(F.lit(1)).alias("n"), F.count("tx_count_1h").alias("with_features"))


# ---- table maintenance


@query
def partition_daily(spark, sf):
    stored = maintain.partition_daily(views.transactions(spark, sf), scratch_path(spark, "daily"))
    return stored.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


@query
def compact_old(spark, sf):
    path = scratch_path(spark, "compacted")
    maintain.partition_daily(views.transactions(spark, sf), path)
    return maintain.compact_old(spark, path, AS_OF).drop("event_date").select(
        *RAW_TRANSACTION.fieldNames(), "is_fraud"
    )


@query
def upsert_stream(spark, sf):
    """The transactions through a replay-safe sink, in four batches whose files come twice."""
    tx = views.transactions(spark, sf)
    table = daytable.DayTable(spark, scratch_path(spark, "upserts"), tx.schema)
    for stream, offsets in _deliveries(spark, sf, 4, late=True):
        streams.run_batches(stream, table.insert, offsets)
    streams.run_batches(stream, table.insert)  # all files again, as one batch of another stream
    return table.read().drop("event_date")


@query
def compact_incremental(spark, sf):
    """Two inserts with a compaction after each: only days with new rows are rewritten."""
    tx = views.transactions(spark, sf)
    table = daytable.DayTable(spark, scratch_path(spark, "days"), tx.schema)
    for k, as_of in enumerate(("2024-01-20 00:00:00", AS_OF)):
        table.insert(tx.filter(F.pmod(F.xxhash64("transaction_id"), F.lit(2)) == k), k)
        table.compact(as_of)
    if table.compact(AS_OF):
        raise RuntimeError("a second compaction found days to rewrite")
    return table.read().drop("event_date")


@query
def retention(spark, sf):
    return maintain.retention(views.shipments(spark, sf), "2000-01-01 00:00:00").groupBy(
        F.date_trunc("month", "timestamp").alias("month")
    ).agg(F.count(F.lit(1)).alias("n"))


__all__ = ["FEATURES", "QUERIES"]
