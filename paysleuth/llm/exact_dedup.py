"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

The group key is (hash, text): the hash spreads the groups, and the aggregation compares the bytes of the texts that
share one, so texts whose hashes collide stay apart. Copies are combined before the shuffle: a text that a third of
the rows share costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysleuth.llm.common import others, row_fingerprint, whole_text


def md5_bits(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = md5_bits,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The largest id of each group of equal texts stays. A null text is an empty one. A null id stays only in a group
    without any other id (keep_id is then null). Of a repeated row (same id, same text) one is kept. Other columns
    play no part; an empty table gives an empty result.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("_text"))
    keyed = keyed.withColumn("_hash", content_hash(F.col("_text")))
    groups = (
        keyed.groupBy("_hash", "_text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") > 1)
        .select("_hash", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    # one light row per (id, text); repeated rows are counted and spread out again at the end
    rows = (
        keyed.select("doc_id", "_hash", F.sha2("_text", 256).alias("text_sha256"))
        .groupBy("doc_id", "_hash", "text_sha256")
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    joined = rows.join(groups, ["_hash", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        "text_sha256",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"),
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("_copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = md5_bits,
) -> DataFrame:
    """The rows that stay, with all their columns: of each group of equal texts the row with the largest id.

    One shuffle: the text is the group key, the other columns ride along. Ties of ids go by a hash of the other
    columns, so exactly one row of each group stays on every run. Null ids lose to any id; a null text is kept as null.
    """
    rest = others(docs, text_col)
    keyed = docs.select(
        whole_text(text_col).alias("_text"),
        F.struct(F.col(text_col).isNull().alias("_null"), F.struct(*rest).alias("_rest")).alias("_row"),
        F.struct(F.col(id_col).alias("_id"), row_fingerprint(docs, rest).alias("_tie")).alias("_order"),
    )
    best = (
        keyed.groupBy(content_hash(F.col("_text")).alias("_hash"), "_text")
        .agg(F.max_by("_row", "_order").alias("_row"))
    )
    text = F.when(F.col("_row._null"), F.lit(None).cast("string")).otherwise(F.col("_text"))
    return best.select(
        *[text.alias(c) if c == text_col else F.col("_row._rest")[c].alias(c) for c in docs.columns]
    )
