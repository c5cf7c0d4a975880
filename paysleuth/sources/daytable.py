"""A table by day with versions: replay-safe inserts that open few files, and compaction of new days only.

Below ``path``:

* ``data/<name>/event_date=D``: the files of one insert or compaction, never changed.
* ``index/<name>``: for each of its files the rows, the least and the largest id, and Bloom bits of the ids.
* ``manifest/version=N``: which (name, day) folders make up version N; ``current`` names the version in force. It is
  written beside and moved into place, so a reader sees one version or the next, and a failed write is never read.

An insert asks the index which files of its days may hold its ids, reads the ids of those files alone, and adds what
is new. A compaction rewrites the days older than some days that have files of inserts, clustered by user and newest
first; days that were compacted and got nothing since are left alone. One writer at a time.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysleuth.functions.scalars import ts
from paysleuth.session import materialized
from paysleuth.sources.tables import DATE, KEY, new_rows, with_date

_MANIFEST = "name string, event_date date, rows long, compacted boolean"
_INDEX = "file string, event_date date, rows long, low string, high string, bits binary"
_BITS_A_ROW, _PROBES, _MOST_BITS = 16, 3, 1 << 26
_IDS_AT_ONCE = 1_000_000


def _bloom(hashes: np.ndarray) -> bytes:
    """Bits of a set of 64-bit hashes; the number of bits follows that of the hashes."""
    size = min(_MOST_BITS, 1 << max(6, math.ceil(math.log2(_BITS_A_ROW * max(1, len(hashes))))))
    bits = np.zeros(size, dtype=bool)
    for place in _places(hashes, size):
        bits[place] = True
    return np.packbits(bits).tobytes()


def _places(hashes: np.ndarray, size: int):
    """Where the bits of each hash stand: probes by steps of its upper half."""
    whole = hashes.astype(np.int64).view(np.uint64)
    start, step = whole & np.uint64(0xFFFFFFFF), (whole >> np.uint64(32)) | np.uint64(1)
    for k in range(_PROBES):
        yield ((start + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


def _may_hold(bits: bytes, hashes: np.ndarray) -> bool:
    known = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
    held = np.ones(len(hashes), dtype=bool)
    for place in _places(hashes, len(known)):
        held &= known[place]
    return bool(held.any())


class DayTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        """schema: of the rows, without the day."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.opened: list[str] = []  # files whose ids the last insert read

    # ---- versions

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The version in force; 0 before the first write."""
        place, fs = self._fs(f"{self.path}/current")
        if not fs.exists(place):
            return 0
        stream = fs.open(place)
        try:
            return int(stream.readLong())
        finally:
            stream.close()

    def _point_to(self, version: int) -> None:
        beside, fs = self._fs(f"{self.path}/current-{uuid.uuid4().hex}")
        stream = fs.create(beside)
        stream.writeLong(version)
        stream.close()
        place, _ = self._fs(f"{self.path}/current")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(context.makeQualified(beside), context.makeQualified(place), options)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={version}")

    def _commit(self, entries: DataFrame) -> None:
        version = self.version() + 1
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        self._point_to(version)

    # ---- reading

    def _folders(self, entries: DataFrame) -> list[str]:
        """One folder per (write, day) of the days asked for."""
        return sorted(f"{self.path}/data/{r['name']}/{DATE}={r[DATE]}" for r in entries.select("name", DATE).collect())

    def _read(self, folders: list[str]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(DATE, T.DateType())])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return with_date(self.spark.read.schema(self.schema).parquet(*folders))

    def read(self, start=None, end=None, version: int | None = None) -> DataFrame:
        """The rows of a version, of some days only if asked for: other days are not even listed."""
        entries = self.manifest(version)
        if start is not None:
            entries = entries.filter(F.col(DATE) >= F.to_date(ts(start)))
        if end is not None:
            entries = entries.filter(F.col(DATE) <= F.to_date(ts(end)))
        return self._read(self._folders(entries))

    # ---- writing

    def _store(self, rows: DataFrame, name: str, **options: str) -> DataFrame:
        """Write the files of one insert or compaction, then their index; returns its manifest rows."""
        rows.write.mode("overwrite").options(**options).partitionBy(DATE).parquet(f"{self.path}/data/{name}")
        schema = T.StructType([*self.schema.fields, T.StructField(DATE, T.DateType())])
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/data/{name}")
        ids = stored.select(F.input_file_name().alias("file"), DATE, F.col(KEY[0]).alias("id"), F.xxhash64(KEY[0]).alias("h"))

        def of_file(file: pd.DataFrame) -> pd.DataFrame:
            one = file.iloc[0]
            return pd.DataFrame(
                [(one["file"], one[DATE], len(file), file["id"].min(), file["id"].max(), _bloom(file["h"].to_numpy()))],
                columns=["file", DATE, "rows", "low", "high", "bits"],
            )

        index = ids.groupBy("file", DATE).applyInPandas(of_file, _INDEX)
        index.write.mode("overwrite").parquet(f"{self.path}/index/{name}")
        index = self.spark.read.schema(_INDEX).parquet(f"{self.path}/index/{name}")
        return index.groupBy(F.lit(name).alias("name"), DATE).agg(F.sum("rows").alias("rows"))

    def _candidates(self, incoming: DataFrame) -> list[str]:
        """The files that may hold one of the rows' ids."""
        days = incoming.select(DATE).distinct()
        entries = self.manifest().join(F.broadcast(days), DATE)  # at most one row a day of the batch
        names = [r["name"] for r in entries.select("name").distinct().collect()]
        if not names:
            return []
        index = self.spark.read.schema(_INDEX).parquet(*[f"{self.path}/index/{n}" for n in names])
        asked = incoming.select(DATE, F.xxhash64(KEY[0]).alias("h"), F.col(KEY[0]).alias("id"))
        blocks = F.ceil(F.count(F.lit(1)) / _IDS_AT_ONCE).alias("_blocks")
        spans = asked.groupBy(DATE).agg(F.min("id").alias("_low"), F.max("id").alias("_high"), blocks)
        near = index.join(F.broadcast(spans), DATE).filter((F.col("low") <= F.col("_high")) & (F.col("high") >= F.col("_low")))

        def holding(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            hashes = right["h"].to_numpy()
            files = [f for f, bits in zip(left["file"], left["bits"], strict=True) if len(hashes) and _may_hold(bits, hashes)]
            return pd.DataFrame({"file": pd.Series(files, dtype="object")})

        # a day of very many ids is asked in blocks
        files = near.select(DATE, "file", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("block"))
        asked = asked.join(F.broadcast(spans.select(DATE, "_blocks")), DATE).withColumn("block", F.pmod("h", "_blocks"))
        groups = files.groupBy(DATE, "block").cogroup(asked.select(DATE, "block", "h").groupBy(DATE, "block"))
        return sorted(r["file"] for r in groups.applyInPandas(holding, "file string").distinct().collect())

    def insert(self, batch: DataFrame, batch_id: int | None = None) -> int:
        """Add the rows whose key (id, time) the table does not hold; returns how many. Fits foreachBatch.

        A batch that is run again writes to the same place and finds its rows there, so it adds nothing.
        """
        name = f"insert-{uuid.uuid4().hex}" if batch_id is None else f"batch-{batch_id:012d}"
        held = self.manifest()
        if batch_id is not None and held.filter(F.col("name") == name).limit(1).count():
            return 0  # it was committed already
        incoming = materialized(with_date(batch.select(*self.schema.fieldNames())), "insert")
        self.opened = self._candidates(incoming)
        known = None
        if self.opened:
            known = self.spark.read.schema(self.schema).parquet(*self.opened).select(*KEY)
        fresh = materialized(new_rows(incoming, known), "insert")
        entries = self._store(fresh.hint("rebalance", F.col(DATE)), name).withColumn("compacted", F.lit(False))
        added = entries.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        if added:
            self._commit(held.unionByName(entries))
        return added

    def compact(self, as_of, days: int = 7, rows_per_file: int = 5_000_000) -> list[str]:
        """Rewrite the days older than ``days`` that inserts have touched since; returns these days."""
        held = self.manifest()
        old = held.filter(F.col(DATE) < F.to_date(ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")))
        touched = old.groupBy(DATE).agg(F.sum("rows").alias("rows"), F.bool_and("compacted").alias("done")).filter("NOT done")
        due = {r[DATE]: r["rows"] for r in touched.collect()}  # at most one row a day
        if not due:
            return []
        entries = held.filter(F.col(DATE).isin(list(due)))
        files = max(len(due), -(-sum(due.values()) // rows_per_file))
        order = [F.col(DATE), F.col("user_id"), F.desc("timestamp")]
        rows = self._read(self._folders(entries)).repartitionByRange(files, *order).sortWithinPartitions(*order)
        made = self._store(rows, f"compacted-{uuid.uuid4().hex}", compression="zstd").withColumn("compacted", F.lit(True))
        self._commit(held.filter(~F.col(DATE).isin(list(due))).unionByName(made))
        return sorted(str(d) for d in due)
