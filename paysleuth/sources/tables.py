"""Batch sources and sinks: pruned scans, validation, idempotent writes and extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysleuth.functions.scalars import is_uuid, ts
from paysleuth.schemas import RAW_TRANSACTION, REQUEST_FEATURES
from paysleuth.session import materialized

DATE = "event_date"

# Fixed value: time format of JSON messages.
ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"


def with_date(df: DataFrame) -> DataFrame:
    return df.withColumn(DATE, F.to_date("timestamp"))


def time_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """start <= timestamp <= end; on a table partitioned by day the same bounds prune the partitions."""
    dated = DATE in df.columns
    if start is not None:
        df = df.filter(F.col("timestamp") >= ts(start))
        df = df.filter(F.col(DATE) >= F.to_date(ts(start))) if dated else df
    if end is not None:
        df = df.filter(F.col("timestamp") <= ts(end))
        df = df.filter(F.col(DATE) <= F.to_date(ts(end))) if dated else df
    return df


def scan_transactions(
    df: DataFrame, start=None, end=None, labeled_only: bool = False, limit: int | None = None, ordered: bool = False
) -> DataFrame:
    """Rows of the table in a time range; ``limit`` takes the earliest rows."""
    rows = time_range(df, start, end)
    if labeled_only:
        rows = rows.filter(F.col("is_fraud").isNotNull())
    if ordered or limit is not None:
        rows = rows.orderBy("timestamp", "transaction_id")
    return rows if limit is None else rows.limit(limit)


def scan_recent(df: DataFrame, as_of, span: str = "24 HOURS", path: str | None = None) -> DataFrame:
    """The rows of the last day, written to Parquet if a path is given."""
    recent = time_range(df, ts(as_of) - F.expr(f"INTERVAL {span}"))
    if path is None:
        return recent
    recent.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(recent.schema).parquet(path)


def user_history_7d(df: DataFrame, user_id: str, as_of) -> DataFrame:
    mine = df.filter(F.col("user_id") == user_id)
    return time_range(mine, ts(as_of) - F.expr("INTERVAL 7 DAYS")).orderBy("timestamp", "transaction_id")


def decode(messages: DataFrame, value: str = "value", schema: T.StructType = RAW_TRANSACTION) -> DataFrame:
    """Parse JSON messages with the declared schema; adds ``_bad`` for what cannot be decoded.

    The time is a number of milliseconds since 1970 or ISO text. A message is bad if it is empty, is not
    JSON of the schema's types, or lacks any field.
    """
    corrupt = T.StructField("_corrupt", T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    # read as a number, a time would be taken for seconds
    fields = [T.StructField("timestamp", T.StringType()) if f.name == "timestamp" else f for f in schema.fields]
    parsed = messages.withColumn(
        "_tx", F.from_json(F.col(value).cast("string"), T.StructType([*fields, corrupt]), options)
    )
    text = F.col("_tx.timestamp")
    millis = F.when(text.rlike("^-?[0-9]{1,15}$"), F.timestamp_millis(text.try_cast("long")))
    time = F.coalesce(millis, F.try_to_timestamp(text, F.lit(ISO_TIME)))
    parsed = parsed.withColumn("_tx", F.col("_tx").withField("timestamp", time))
    bad = F.col("_tx").isNull() | F.col("_tx._corrupt").isNotNull()
    for name in schema.fieldNames():
        bad = bad | F.col(f"_tx.{name}").isNull()
    return parsed.withColumn("_bad", F.coalesce(bad, F.lit(True)))


def dead_letter_split(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(decoded rows, undecodable messages). Decoding is deterministic, so there is nothing to retry."""
    parsed = decode(messages, value)
    good = parsed.filter(~F.col("_bad")).select(*[F.col(f"_tx.{f}").alias(f) for f in RAW_TRANSACTION.fieldNames()])
    dead = parsed.filter("_bad").drop("_tx", "_bad")
    return good, dead


def validate_uuid(df: DataFrame, column: str = "transaction_id") -> DataFrame:
    return df.filter(is_uuid(column))


def validate_request(df: DataFrame) -> DataFrame:
    """Add (valid, reason): the first rule of a scoring request that a row breaks."""
    checks: list[tuple[Column, str]] = [
        (F.col(c).isNull(), f"missing {c}") for c in RAW_TRANSACTION.fieldNames()
    ]
    checks.append((~(F.col("amount") > 0), "amount must be greater than 0"))
    if "features" in df.columns:
        checks.append((F.col("features").isNull(), "missing features"))
        checks += [(F.col("features")[n].isNull(), f"missing feature {n}") for n in REQUEST_FEATURES]
    reason = F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in checks])
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


KEY = ["transaction_id", "timestamp"]


def new_rows(incoming: DataFrame, existing: DataFrame | None, key: list[str] = KEY) -> DataFrame:
    """The rows to insert: the first of each key that the table does not hold yet.

    Of rows with the same key the one with the smallest content is kept, so a rerun keeps the same
    one. The choice is an aggregate (combined before the shuffle): copies of a row never meet in one task.
    """
    rest = [c for c in incoming.columns if c not in key]
    chosen = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")) if rest else incoming.distinct()
    rows = chosen.select(*key, "_row.*").select(*incoming.columns) if rest else chosen
    return rows if existing is None else rows.join(existing.select(*key), key, "left_anti")


def upsert_transactions(spark: SparkSession, incoming: DataFrame, path: str) -> DataFrame:
    """Append the new rows to the table partitioned by day and return the table.

    Only the days that occur in the input are read for the comparison.
    """
    dated = with_date(incoming)
    if path_exists(spark, path):
        table = spark.read.parquet(path)
        days = [r[0] for r in dated.select(DATE).distinct().collect()]
        fresh = new_rows(dated, table.filter(F.col(DATE).isin(days)))
        fresh = _staged(spark, fresh)
    else:
        fresh = new_rows(dated, None)
    write_daily(fresh, path, "append")
    return spark.read.parquet(path)


def write_daily(df: DataFrame, path: str, mode: str, **options: str) -> None:
    """Write to day partitions. The rebalance lets AQE merge small days and split a very large one."""
    df.hint("rebalance", F.col(DATE)).write.mode(mode).options(**options).partitionBy(DATE).parquet(path)


def _staged(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The new rows written down before the append, because they are computed from the same table."""
    return materialized(df, "upsert")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def reference_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Save a feature matrix and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
