"""Continuous aggregates: stored partials up to a mark, and the raw rows after it.

A report over time buckets is kept as mergeable partials (counts, sums of whole cents) in a table partitioned by day. A
refresh adds the complete buckets since the mark and moves the mark; a read takes the stored days it needs, groups
only the raw rows after the mark, and merges both, so it is always up to date and never groups the history again.

Below ``path``: ``data/version=N/event_date=D`` holds partials, ``marks/version=N`` says what version N stands for: all
rows of [start, until), or (``start`` null) rows that came late and are added to what is stored. A version that covers a
bucket replaces earlier ones there. Every version is written whole before its mark; a refresh that is run again
overwrites itself. After ``MOST_VERSIONS`` a refresh folds them into one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysleuth.functions.scalars import cents, safe_ratio, ts
from paysleuth.sources.tables import DATE, path_exists

MOST_VERSIONS = 32
_MARK = "start long, until long, version long"


@dataclass(frozen=True)
class Rollup:
    """A report: bucket column and unit, further keys, partials (name -> aggregate), and the report's columns from them."""

    bucket: str
    unit: str
    by: tuple[str, ...]
    partials: Callable[[], dict[str, Column]]
    report: Callable[[], dict[str, Column]]

    @property
    def keys(self) -> list[str]:
        return [self.bucket, *self.by]

    def group(self, rows: DataFrame) -> DataFrame:
        bucket = F.date_trunc(self.unit, "timestamp").alias(self.bucket)
        return rows.groupBy(bucket, *self.by).agg(*[c.alias(name) for name, c in self.partials().items()])

    def merge(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.keys).agg(*[F.sum(name).alias(name) for name in self.partials()])

    def shown(self, partials: DataFrame) -> DataFrame:
        return partials.select(*self.keys, *[c.alias(name) for name, c in self.report().items()])


FRAUD_HOURLY = Rollup(
    "bucket_hour",
    "hour",
    (),
    lambda: {"n": F.count(F.lit(1)), "frauds": F.count_if("is_fraud")},
    lambda: {
        "total_transactions": F.col("n"),
        "total_fraud_transactions": F.col("frauds"),
        "fraud_rate": safe_ratio("frauds", "n"),
    },
)
MERCHANT_DAILY = Rollup(
    "bucket_day",
    "day",
    ("merchant_id",),
    lambda: {"cents": F.sum(cents("amount")), "n": F.count(F.lit(1))},
    lambda: {"total_amount": F.col("cents") / 100.0, "transaction_count": F.col("n")},
)


class ContinuousAggregate:
    def __init__(self, spark: SparkSession, path: str, rollup: Rollup):
        self.spark, self.path, self.rollup = spark, path.rstrip("/"), rollup

    def _marks(self) -> list[tuple[int, int | None, int | None]]:
        """(version, start, until), at most ``MOST_VERSIONS`` and the late ones since."""
        if not path_exists(self.spark, f"{self.path}/marks"):
            return []
        rows = self.spark.read.schema(_MARK).parquet(f"{self.path}/marks").collect()
        marks = sorted((r["version"], r["start"], r["until"]) for r in rows)
        whole = max((v for v, start, _ in marks if start == 0), default=None)  # a folded version stands for all before it
        return [m for m in marks if whole is None or m[0] >= whole]

    def mark(self) -> int | None:
        """Up to when (microseconds) the stored buckets are complete."""
        return max((until for _, _, until in self._marks() if until is not None), default=None)

    def _write(self, partials: DataFrame, version: int, start: int | None, until: int | None) -> None:
        dated = partials.withColumn(DATE, F.to_date(self.rollup.bucket))
        dated.hint("rebalance", DATE).write.mode("overwrite").partitionBy(DATE).parquet(f"{self.path}/data/version={version}")
        mark = self.spark.createDataFrame([(start, until)], "start long, until long")
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/version={version}")

    def _end(self, as_of, minutes: int) -> int:
        end = F.date_trunc(self.rollup.unit, ts(as_of) - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
        return self.spark.range(1).select(F.unix_micros(end)).first()[0]

    def refresh(self, source: DataFrame, as_of, minutes: int = 5, days: int | None = None) -> None:
        """Store the complete buckets since the mark; with ``days``, those of the last days again."""
        marks, until = self._marks(), self._end(as_of, minutes)
        start = self.mark()
        if days is not None:
            first = self._end(as_of, minutes + 24 * 60 * int(days))
            start = first if start is None else min(start, first)
        if start is not None and start >= until:
            return
        version = max((v for v, _, _ in marks), default=0) + 1
        at = F.timestamp_micros
        rows = source.filter(F.col("timestamp") < at(F.lit(until)))
        if start is None:
            self._write(self.rollup.group(rows), version, 0, until)
            return
        fresh = self.rollup.group(rows.filter(F.col("timestamp") >= at(F.lit(start))))
        if len(marks) < MOST_VERSIONS:
            self._write(fresh, version, start, until)
        else:  # fold
            kept = self.stored().filter(F.col(self.rollup.bucket) < at(F.lit(start)))
            self._write(kept.unionByName(fresh), version, 0, until)

    def add(self, late: DataFrame, version: int | None = None) -> None:
        """Add rows that came after their bucket was stored; rows after the mark are not counted here, reads see them."""
        mark = self.mark()
        if mark is None:
            return
        version = version or max(v for v, _, _ in self._marks()) + 1
        rows = late.filter(F.col("timestamp") < F.timestamp_micros(F.lit(mark)))
        self._write(self.rollup.group(rows), version, None, None)

    def stored(self, since=None) -> DataFrame:
        """The stored partials, of days from ``since`` on."""
        marks = self._marks()
        bucket = F.unix_micros(self.rollup.bucket)
        held = F.lit(False)
        for version, start, until in marks:
            span = F.lit(True) if start is None else (bucket >= F.lit(start)) & (bucket < F.lit(until))
            if start == 0:
                span = bucket < F.lit(until)
            for later, s, u in marks:  # a later version replaces its buckets
                if later > version and s is not None:
                    span = span & ~((bucket >= F.lit(s)) & (bucket < F.lit(u)))
            held = held | ((F.col("version") == version) & span)
        paths = [f"{self.path}/data/version={v}" for v, _, _ in marks]
        table = self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths)
        if since is not None:
            table = table.filter(F.col(DATE) >= F.to_date(ts(since)))
        return self.rollup.merge(table.filter(held))

    def read(self, source: DataFrame, since=None) -> DataFrame:
        """The report as of now, of buckets from ``since`` on: stored partials and the raw rows after the mark."""
        mark = self.mark()
        first = None if since is None else F.date_trunc(self.rollup.unit, ts(since))
        if mark is None:
            rows = source if since is None else source.filter(F.col("timestamp") >= first)
            return self.rollup.shown(self.rollup.group(rows))
        # complete buckets are stored, the open one is in the tail: they never overlap
        tail = self.rollup.group(source.filter(F.col("timestamp") >= F.timestamp_micros(F.lit(mark))))
        both = self.stored(since).unionByName(tail)
        return self.rollup.shown(both if since is None else both.filter(F.col(self.rollup.bucket) >= first))
