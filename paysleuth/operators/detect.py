"""Fraud patterns as filters over behaviour features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysleuth.functions.scalars import null_as_text, ts
from paysleuth.plans.ordered import DEFAULT_POLICY, SplitPolicy, hot_groups, running, to_cut
from paysleuth.plans.sizing import as_lookup

# Region of each country.
LATAM = ["AR", "BR", "MX", "CL", "CO", "PE", "UY", "PY", "BO"]
NON_LATAM = ["US", "ES", "UK", "FR", "DE"]

HIGH_AMOUNT = 300.0
KEYS = ["transaction_id", "user_id", "timestamp"]


def _amount_anomaly(ratio: float, amount: float) -> Column:
    return (F.col("amount_ratio_vs_user_avg") >= ratio) & (F.col("amount") >= amount)


def _unknown_merchant(amount: float) -> Column:
    return (F.col("is_merchant_new") == 1.0) & (F.col("amount") >= amount)


def _region(country: Column) -> Column:
    return F.when(country.isin(*LATAM), 1).when(country.isin(*NON_LATAM), 2)


def _unusual_country() -> Column:
    other = _region(F.col("country")) != _region(F.col("home_country"))
    return (F.col("is_country_new") == 1.0) & other


def detect_amount_anomaly(features: DataFrame, ratio: float = 5.0, amount: float = HIGH_AMOUNT) -> DataFrame:
    return features.filter(_amount_anomaly(ratio, amount)).select(*KEYS)


def detect_unknown_merchant_high(features: DataFrame, amount: float = HIGH_AMOUNT) -> DataFrame:
    return features.filter(_unknown_merchant(amount)).select(*KEYS)


def home_country(df: DataFrame) -> DataFrame:
    """The most frequent country of each user (ties: first by name)."""
    counts = df.groupBy("user_id", null_as_text("country").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by("_c", F.struct((-F.col("_n")).alias("n"), F.col("_c").alias("c")))
    return counts.groupBy("user_id").agg(best.alias("home_country"))


def detect_unusual_country(features: DataFrame, transactions: DataFrame) -> DataFrame:
    """A country that is new for the user and lies in the other region than the user's home."""
    new = features.filter(F.col("is_country_new") == 1.0)
    return new.join(home_country(transactions), "user_id").filter(_unusual_country()).select(*KEYS)


def detect_high_frequency(
    df: DataFrame, minimum: int = 5, minutes: int = 30, policy: SplitPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Rows with at least ``minimum`` rows of the user in the trailing window, the row included.

    The count at t is (rows up to t) - (rows before t - window), two running counts over the rows and
    their echoes one window later. Users that fit one task need a single exchange.
    """
    width = F.lit(minutes * 60_000_000)
    rows = df.select(*KEYS, F.unix_micros(F.col("timestamp").cast("timestamp")).alias("_us"))
    hot = hot_groups(rows, ["user_id"], policy)
    if hot is None:
        return _frequent_light(rows, minimum, width)
    users = as_lookup(hot.select("user_id"))
    light = rows.join(users, "user_id", "left_anti")
    heavy = rows.join(users, "user_id", "left_semi")
    found = _frequent_heavy(heavy, minimum, width, policy, to_cut(hot, policy, 2))
    return _frequent_light(light, minimum, width).unionByName(found)


def _frequent_light(rows: DataFrame, minimum: int, width: Column) -> DataFrame:
    one = F.lit(1).cast("long")
    points = rows.repartition("user_id").select(
        "user_id", "transaction_id", "timestamp", F.posexplode(F.array("_us", F.col("_us") + width)).alias("_kind", "_at")
    )
    by_time = Window.partitionBy("user_id").orderBy("_at")
    up_to = F.sum(F.when(F.col("_kind") == 0, one)).over(by_time.rangeBetween(Window.unboundedPreceding, 0))
    gone = F.sum(F.when(F.col("_kind") == 1, one)).over(by_time.rangeBetween(Window.unboundedPreceding, -1))
    counted = points.withColumn("tx_in_window", up_to - F.coalesce(gone, F.lit(0)))
    return counted.filter((F.col("_kind") == 0) & (F.col("tx_in_window") >= minimum)).select(*KEYS, "tx_in_window")


def _frequent_heavy(
    rows: DataFrame, minimum: int, width: Column, policy: SplitPolicy, hot: list[tuple]
) -> DataFrame:
    """The same for users too large for one task: points combined per time, time segments, join back."""
    zero = F.lit(0).cast("long")
    per_time = rows.groupBy("user_id", "_us").agg(F.count(F.lit(1)).alias("_cnt"))
    points = per_time.select(
        "user_id",
        F.explode(
            F.array(
                F.struct(F.col("_us").alias("at"), F.col("_cnt").alias("own"), zero.alias("gone")),
                F.struct((F.col("_us") + width).alias("at"), zero.alias("own"), F.col("_cnt").alias("gone")),
            )
        ).alias("_p"),
    ).select("user_id", "_p.*")
    merged = points.groupBy("user_id", "at").agg(F.sum("own").alias("own"), F.sum("gone").alias("gone"))
    scan = {"_own": ("sum", "own"), "_gone": ("sum", "gone")}
    before = running(merged, ["user_id"], "at", scan, policy=policy, hot=hot)
    inside = F.coalesce("_own", zero) + F.col("own") - F.coalesce("_gone", zero)
    hits = before.filter((F.col("own") > 0) & (inside >= minimum)).select(
        "user_id", F.col("at").alias("_us"), inside.alias("tx_in_window")
    )
    return rows.join(hits, ["user_id", "_us"]).select(*KEYS, "tx_in_window")


def burst_users(df: DataFrame, as_of, minimum: int = 5, minutes: int = 30) -> DataFrame:
    recent = df.filter(F.col("timestamp") >= ts(as_of) - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    counted = recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("tx_count"))
    return counted.filter(F.col("tx_count") >= minimum)


def detect_any(features: DataFrame, transactions: DataFrame, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """All detections with the patterns' names and how many patterns each transaction matched.

    The three patterns that read the features are tested in one pass over them.
    """
    rules = {
        "amount_anomaly": _amount_anomaly(5.0, HIGH_AMOUNT),
        "unknown_merchant_high_amount": _unknown_merchant(HIGH_AMOUNT),
        "unusual_country": _unusual_country(),
    }
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    by_feature = features.join(home_country(transactions), "user_id", "left").select(
        *KEYS, F.explode(names).alias("pattern")
    )
    frequent = detect_high_frequency(transactions, policy=policy).select(*KEYS, F.lit("high_frequency").alias("pattern"))
    return by_feature.unionByName(frequent).groupBy(*KEYS).agg(
        F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias("patterns"),
        F.count(F.lit(1)).alias("pattern_count"),
    )
