"""Checks of size made before a plan commits to a broadcast or to one window per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own estimate for the optimised plan (file sizes carried through the operators)."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a table of at most one row, as a scalar subquery; NULL if it has none."""
    packed = one_row.select(F.struct("*").alias("_row")).scalar()
    return df.withColumn("_scalar_row", packed).select(*df.columns, "_scalar_row.*")


def small_table(df: DataFrame, max_rows: int = 100_000) -> DataFrame | None:
    """The rows of a small table as a local relation, or None if there are more than ``max_rows``."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def as_lookup(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A lookup table ready to join: broadcast if it has at most ``max_rows`` rows, else as it is.

    The check is made on the rows themselves, so a broadcast is never larger than ``max_rows``;
    beyond it the join stays a shuffle join and AQE splits its skewed partitions.
    """
    local = small_table(df, max_rows)
    return df if local is None else F.broadcast(local)
