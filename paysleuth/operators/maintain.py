"""Upkeep of the day-partitioned transaction table and of its aggregates.

Rewrites go through day partitions: only the days concerned are read and replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysleuth.functions.scalars import ts
from paysleuth.session import materialized
from paysleuth.sources.tables import DATE, path_exists, with_date, write_daily


def partition_daily(df: DataFrame, path: str) -> DataFrame:
    """Write the table with one partition per day."""
    write_daily(with_date(df), path, "overwrite")
    return df.sparkSession.read.parquet(path)


def _replace_days(df: DataFrame, path: str) -> None:
    write_daily(df, path, "overwrite", partitionOverwriteMode="dynamic")


def compact_old(spark, path: str, as_of, days: int = 7, rows_per_file: int = 5_000_000) -> DataFrame:
    """Rewrite the days older than ``days``: clustered by user, newest first, compressed.

    A range exchange on (day, user, time) gives files that hold narrow user ranges, so a filter on a
    user reads few of them, and it splits a heavy user or day by time.
    """
    table = spark.read.parquet(path)
    old = table.filter(F.col(DATE) < F.to_date(ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")))
    # written down first: the new files replace the ones being read
    staged = materialized(old, "compact")
    count = staged.count()
    if count == 0:
        return table
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // rows_per_file))
    ranged = staged.repartitionByRange(files, DATE, "user_id", F.desc("timestamp"))
    clustered = ranged.sortWithinPartitions(DATE, "user_id", F.desc("timestamp"))
    clustered.write.mode("overwrite").options(
        partitionOverwriteMode="dynamic", compression="zstd"
    ).partitionBy(DATE).parquet(path)
    return spark.read.parquet(path)


def retention(df: DataFrame, as_of, years: int = 2) -> DataFrame:
    """The rows that stay: those of days not older than ``years``."""
    first_day = F.to_date(ts(as_of) - F.expr(f"INTERVAL {int(years)} YEARS"))
    day = F.col(DATE) if DATE in df.columns else F.to_date("timestamp")
    return df.filter(day >= first_day)


def drop_expired(spark, path: str, as_of, years: int = 2) -> list[str]:
    """Remove the partitions of expired days; returns their names."""
    limit = spark.range(1).select(F.to_date(ts(as_of) - F.expr(f"INTERVAL {int(years)} YEARS"))).head()[0]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    removed = []
    for entry in fs.listStatus(hadoop):
        name = entry.getPath().getName()
        if name.startswith(DATE + "=") and name.split("=", 1)[1] < limit.isoformat():
            fs.delete(entry.getPath(), True)
            removed.append(name)
    return sorted(removed)


def refresh_aggregate(
    stored: DataFrame | None,
    source: DataFrame,
    aggregate: Callable[[DataFrame], DataFrame],
    bucket: str,
    unit: str,
    as_of,
    days: int = 30,
    minutes: int = 5,
) -> DataFrame:
    """The aggregate after a refresh: buckets inside the window are recomputed, the others are kept.

    unit: "hour" or "day"; only complete buckets inside the window are replaced.
    """
    start = F.date_trunc(unit, ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    end = F.date_trunc(unit, ts(as_of) - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    inside = (F.col("timestamp") >= start) & (F.col("timestamp") < end)
    fresh = aggregate(source.filter(inside))
    if stored is None:
        return fresh
    kept = stored.filter((F.col(bucket) < start) | (F.col(bucket) >= end))
    return kept.unionByName(fresh)


def refresh_stored(
    spark, path: str, source: DataFrame, aggregate: Callable[[DataFrame], DataFrame], bucket: str, as_of,
    days: int = 30, minutes: int = 5, unit: str = "hour",
) -> DataFrame:
    """Refresh an aggregate table partitioned by day: only the days of the window are overwritten.

    unit: "hour" or "day", the size of a bucket; only complete buckets are recomputed. Buckets of the
    last day that the window does not reach are carried over from the table.
    """
    start = F.date_trunc("day", ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    end = F.date_trunc(unit, ts(as_of) - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    rows = source.filter((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    fresh = aggregate(rows).withColumn(DATE, F.to_date(bucket))
    if path_exists(spark, path):
        later = spark.read.parquet(path).filter((F.col(DATE) == F.to_date(end)) & (F.col(bucket) >= end))
        fresh = materialized(fresh.unionByName(later.select(*fresh.columns)), "refresh")
    _replace_days(fresh, path)
    return spark.read.parquet(path).drop(DATE)
