"""Declared schemas of the event records and tables. Nothing is inferred at read time."""

from pyspark.sql import types as T

RAW_TRANSACTION = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("ip_hash", T.StringType()),
    ]
)

ENRICHED_TRANSACTION = T.StructType(
    RAW_TRANSACTION.fields + [T.StructField("features", T.MapType(T.StringType(), T.DoubleType()))]
)

TRANSACTION_TABLE = T.StructType(RAW_TRANSACTION.fields + [T.StructField("is_fraud", T.BooleanType())])

FEATURE_DRIFTS = T.StructType(
    [
        T.StructField(
            "data_drift",
            T.MapType(T.StringType(), T.StructType([T.StructField("drift_score", T.DoubleType())])),
        ),
        T.StructField(
            "model_drift",
            T.StructType(
                [T.StructField("detected", T.BooleanType()), T.StructField("f1_degradation", T.DoubleType())]
            ),
        ),
    ]
)

# Column order of the feature matrix and of the model input.
DIRECT_FEATURES = [
    "log_amount",
    "hour_of_day",
    "day_of_week",
    "merchant_category_encoded",
    "country_encoded",
    "device_type_encoded",
]
WINDOW_FEATURES = [
    "tx_count_1h",
    "tx_count_24h",
    "tx_count_7d",
    "amount_sum_1h",
    "amount_sum_24h",
    "tx_velocity_1h",
    "seconds_since_last_tx",
]
PROFILE_FEATURES = [
    "amount_ratio_vs_user_avg",
    "is_country_new",
    "distinct_countries_seen",
    "is_merchant_new",
    "distinct_merchants_seen",
]
FEATURES = DIRECT_FEATURES + WINDOW_FEATURES + PROFILE_FEATURES
MODEL_INPUT = [f for f in FEATURES if f not in ("tx_velocity_1h", "distinct_countries_seen")]
REQUEST_FEATURES = [f for f in MODEL_INPUT if f not in DIRECT_FEATURES]

REQUIRED_COLUMNS = {
    "transaction_id",
    "user_id",
    "merchant_id",
    "merchant_category",
    "amount",
    "country",
    "device_type",
    "timestamp",
    "is_fraud",
}
