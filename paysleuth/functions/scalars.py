"""Scalar helpers as Column expressions; all of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(value) -> Column:
    """A timestamp literal from text, or the column itself."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def null_as_text(c) -> Column:
    """A missing category is the category 'None'."""
    return F.coalesce(as_column(c).cast("string"), F.lit("None"))


def cents(c) -> Column:
    """Money as whole cents: exact sums in any order, in one long."""
    return (as_column(c).cast("decimal(20,2)") * 100).cast("long")


def safe_ratio(numerator, denominator) -> Column:
    return F.try_divide(as_column(numerator).cast("double"), as_column(denominator).cast("double"))


def epoch_bucket(at, width_seconds: int) -> Column:
    """Start of the fixed-width bucket (counted from the epoch) that holds the time."""
    width = F.lit(width_seconds * 1_000_000)
    micros = F.unix_micros(as_column(at))
    return F.timestamp_micros(micros - F.pmod(micros, width))


def severity(score) -> Column:
    s = as_column(score)
    return F.when(s >= 0.90, "CRITICAL").when(s >= 0.75, "HIGH").otherwise("WARNING")


def session_start(at, minutes: int = 30) -> Column:
    """Start of the session slot; slots are counted from midnight, so the last one may be shorter."""
    micros = F.unix_micros(as_column(at))
    in_day = F.pmod(micros, F.lit(DAY_US))
    return F.timestamp_micros(micros - F.pmod(in_day, F.lit(minutes * 60_000_000)))


def session_hash(user, at, minutes: int = 30) -> Column:
    start = F.unix_seconds(session_start(at, minutes)).cast("string")
    return F.sha2(F.concat(as_column(user), F.lit("|"), start), 256)


def is_uuid(c) -> Column:
    """32 hexadecimal digits, with or without dashes, braces or a URN prefix."""
    bare = F.regexp_replace(F.regexp_replace(as_column(c), "urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", "")
    return F.coalesce(bare.rlike("^[0-9a-fA-F]{32}$"), F.lit(False))


def rate_text(rate) -> Column:
    """A rate as a percentage with two decimals."""
    return F.format_string("%.2f", as_column(rate).cast("double") * 100)


def register(spark: SparkSession) -> None:
    """Make the scalar helpers callable from SQL."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION fraud_severity(score DOUBLE) RETURNS STRING RETURN "
        "CASE WHEN score >= 0.90 THEN 'CRITICAL' WHEN score >= 0.75 THEN 'HIGH' ELSE 'WARNING' END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION session_bucket(user STRING, at TIMESTAMP, minutes INT) RETURNS STRING "
        "RETURN sha2(concat(user, '|', CAST((unix_micros(at) - pmod(pmod(unix_micros(at), 86400000000L), "
        "minutes * 60000000L)) DIV 1000000L AS STRING)), 256)"
    )
