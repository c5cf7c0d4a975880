"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import math
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysleuth.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str) -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """A 64-bit hash of columns that breaks ties the same way on every run (maps cannot be hashed, so they take no part)."""
    kinds = dict(df.dtypes)
    usable = [F.col(c) for c in columns if "map<" not in kinds[c] and "variant" not in kinds[c]]
    return F.xxhash64(*usable) if usable else F.lit(0).cast("long")


def others(df: DataFrame, *used: str) -> list[str]:
    return [c for c in df.columns if c not in used]


def free_name(df: DataFrame, name: str) -> str:
    """The name with as many underscores in front as it takes to be no column of ``df``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, on whichever store ``spark.checkpoint.dir`` names."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if urlparse(uri).scheme == "file":
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables of our own from the shared folder."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables in the shared folder that one operator writes on its way, and deletes when they are spent."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.made: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((made, path))
        return made

    def drop_all_but(self, *kept: DataFrame) -> None:
        stays = [(df, path) for df, path in self.made if any(df is k for k in kept)]
        delete_tables(self.spark, [path for df, path in self.made if not any(df is k for k in kept)])
        self.made = stays


class BitTable:
    """A set of 64-bit hashes as a table of bits: it answers yes for all members, and for few others while it is sparse.

    Its size is fixed by ``MOST_BITS`` (2 MB); with more members it says yes more often, and what follows has more to do.
    """

    MOST_BITS = 24

    def __init__(self, spark: SparkSession, words: np.ndarray):
        self.shared = spark.sparkContext.broadcast(words)

    @classmethod
    def of(cls, df: DataFrame, column: str) -> BitTable:
        spark = df.sparkSession
        bits = min(cls.MOST_BITS, max(10, math.ceil(math.log2(16 * max(1, df.count())))))
        slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
        filled = df.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(bit).alias("v"))
        words = np.zeros(1 << (bits - 6), dtype=np.int64)
        for r in filled.collect():  # at most 2^18 rows
            words[r["w"]] = r["v"]
        return cls(spark, words)

    def held(self, hashes: pd.Series) -> np.ndarray:
        """Inside a task: which of the hashes may be in the set."""
        words = self.shared.value
        slot = hashes.to_numpy(dtype=np.int64) & (len(words) * 64 - 1)
        return words[slot >> 6] >> (slot & 63) & 1 == 1

    def column(self):
        """Column function: whether a hash may be in the set."""

        @F.pandas_udf("boolean")
        def held(hashes: pd.Series) -> pd.Series:
            return pd.Series(self.held(hashes), index=hashes.index)

        return held
