"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partition, overfull ranges cut.

Only light rows (id, size, checksum) move. The ranges are many times finer than the shards; their exact totals, a
table of bounded size, give each row its place in one global order, and the shards are equal stretches of bytes of it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysleuth.llm.common import free_name, whole_text
from paysleuth.session import materialized

_LEAST = -(2**63)


def _cell_of(splitters: np.ndarray, cells: np.ndarray):
    """Column function: the cell of a (key, spread) pair; a range of several cells is cut by the hash ``spread``."""
    first = np.concatenate([[0], np.cumsum(cells)[:-1]])

    @F.pandas_udf("long")
    def cell(key: pd.Series, spread: pd.Series) -> pd.Series:
        at = np.searchsorted(splitters, key.to_numpy(), side="right")
        unit = (spread.to_numpy().view(np.uint64) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        return pd.Series(first[at] + np.floor(unit * cells[at]).astype(np.int64))

    return cell


def _unit(*columns: Column | str) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *columns), 11)).cast("double") / float(1 << 53)


def size_weighted_splitters(light: DataFrame, total: int, ranges: int, per_range: int) -> np.ndarray:
    """Boundaries of about ``ranges`` ranges of equal weight.

    A row is drawn size * rate times on average, by a hash of itself, so a run that is repeated draws the same rows;
    the number drawn does not depend on the input (``ranges * per_range`` expected).
    """
    rate = ranges * per_range / total
    hits = F.floor(F.col("_size") * F.col("_copies") * F.lit(rate) + _unit("_key", "_spread"))
    drawn = light.select("_key", hits.alias("n")).filter("n > 0").groupBy("_key").agg(F.sum("n").alias("n")).toPandas()
    drawn = drawn.sort_values("_key")
    reached = np.cumsum(drawn["n"].to_numpy())
    if not len(reached):
        return np.array([], dtype=np.int64)
    picks = np.searchsorted(reached, reached[-1] * np.arange(1, ranges) / ranges)
    return np.unique(drawn["_key"].to_numpy()[picks]).astype(np.int64)


def shard_rows(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_ranges: int = 512,
    rows_per_range: int = 1_000_000,
    per_range: int = 16,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    law is ``bytes``: the sizes of shards differ by at most the largest document. size is the text's UTF-8 bytes plus 1
    (null: none). The order inside is id (null first), then size and checksum; repeated rows are equal in all columns,
    so it does not matter which comes first. grown_shard belongs to another law and is null. An empty table gives an
    empty result; with fewer documents than shards some shards stay empty. Other columns play no part.
    """
    text = whole_text(text_col)
    light = (
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
        )
        .groupBy("doc_id", "_size", "_crc")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumns(
            {
                "_key": F.coalesce("doc_id", F.lit(_LEAST)),
                "_spread": F.xxhash64("_size", "_crc"),
            }
        )
    )
    light = materialized(light, "shard-rows")  # small; read by each of the passes below
    totals = light.agg(F.sum(F.col("_size") * F.col("_copies")), F.sum("_copies")).first()
    total, rows = int(totals[0] or 0), int(totals[1] or 0)
    ranges = max(least_ranges, math.ceil(rows / rows_per_range))
    splitters = size_weighted_splitters(light, max(total, 1), ranges, per_range)

    def with_cell(cells: np.ndarray) -> DataFrame:
        return light.withColumn("_cell", _cell_of(splitters, cells)("_key", "_spread"))

    def measured(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = with_cell(cells).groupBy("_cell").agg(
            F.sum(F.col("_size") * F.col("_copies")).alias("b"), F.sum("_copies").alias("n")
        ).collect()  # one row per cell: bounded by ``ranges``
        size, count = np.zeros(int(cells.sum()), dtype=np.int64), np.zeros(int(cells.sum()), dtype=np.int64)
        for r in got:
            size[r["_cell"]], count[r["_cell"]] = r["b"], r["n"]
        return size, count

    cells = np.ones(len(splitters) + 1, dtype=np.int64)
    size, count = measured(cells)
    fair_size, fair_count = max(1, total / len(cells)), max(1, rows / len(cells))
    cut = np.maximum(np.ceil(size / (2 * fair_size)), np.ceil(count / (2 * fair_count))).astype(np.int64)
    if (cut > 1).any():
        cells = np.maximum(cut, 1)
        size, count = measured(cells)
    before = docs.sparkSession.createDataFrame(
        pd.DataFrame(
            {
                "_cell": np.arange(len(size), dtype=np.int64),
                "_size_before": np.concatenate([[0], np.cumsum(size)[:-1]]),
                "_rows_before": np.concatenate([[0], np.cumsum(count)[:-1]]),
            }
        )
    )
    inside = Window.partitionBy("_cell").orderBy("_key", "_size", "_crc").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = (
        with_cell(cells)
        .withColumns(
            {
                "_start": F.coalesce(F.sum(F.col("_size") * F.col("_copies")).over(inside), zero),
                "_index": F.coalesce(F.sum("_copies").over(inside), zero),
            }
        )
        .join(F.broadcast(before), "_cell")  # bounded: at most about 3 * ranges rows
        .withColumn("_copy", F.explode(F.sequence(zero, F.col("_copies") - 1)))
    )
    start = F.col("_size_before") + F.col("_start") + F.col("_copy") * F.col("_size")
    shard = F.floor((start + F.floor(F.col("_size") / 2)) * shards / F.lit(float(max(total, 1))))
    placed = placed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.least(shard, F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("_rows_before") + F.col("_index") + F.col("_copy")).alias("_place"),
    )
    placed = materialized(placed, "sharded")
    firsts = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row per shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_place") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the records as Parquet folders ``shard=N``, in slot order inside each file, with a column ``slot``.

    If the records have columns of these names already, ours get underscores in front. Null texts are empty, null ids a value like any other; an empty table gives an empty folder.
    Rows meet their place by id, size and checksum; rows that agree in these keep their own columns.
    """
    text = whole_text(text_col)
    keys = {
        "_id": F.col(id_col).cast("long"),
        "_bytes": (F.octet_length(text) + 1).cast("long"),
        "_sum": F.crc32(text.cast("binary")),
    }
    places = shard_rows(docs, shards, id_col, text_col)
    places = places.groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_bytes"), F.col("text_crc32").alias("_sum"))
    places = places.agg(F.min(F.struct("shard", "slot")).alias("_at"))
    named = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(k) for k, c in keys.items()])
    on = [named[k].eqNullSafe(places[k]) for k in keys]
    shard, slot = (free_name(docs, name) for name in ("shard", "slot"))
    placed = named.join(places, on).select("row.*", F.col("_at.shard").alias(shard), F.col("_at.slot").alias(slot))
    placed.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
