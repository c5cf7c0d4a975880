"""Streaming features over a stored history, bucketed by user and day.

``streaming.features`` keeps a user's last 7 days in the state of one key. Where one user can hold a large part of the
stream, that state and its task grow with them, and a row that comes late gets no features. Here the history is a
table, and each micro-batch computes its features with the batch operator, which splits busy users by time.

Below ``path``:

* ``rows/batch=N/bucket=B/event_date=D``: the rows of each micro-batch, bucket = hash of the user.
* ``files/batch=N``: which (bucket, day) folders the batch has written. A micro-batch picks the folders it needs
  from this list; no folder is listed and no other file opened.
* ``profiles/version=N/bucket=B``: everything of a bucket before a time, one weighted row per (user, country, merchant),
  and ``profile_index/version=N``: bucket, that time (``until``), and the last batch it holds (``upto``).
* ``features/batch=N``: rows with their features. A later batch supersedes an earlier one for the same transaction.

A micro-batch reads the folders of its buckets since their ``until`` (7 days of windows and ``slack_days``) and their
profiles; both are bounded by the users and the rows of the last days, however long the stream has run. A row that comes
late changes what was said about later rows of its user: these are computed again from the first such row on, and
written anew. If it is so late that a profile has swallowed its windows, that user's rows are read from the start.

Every write goes to a folder of its micro-batch, and a micro-batch reads only what earlier ones wrote, so a replayed
batch overwrites itself with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysleuth.functions.scalars import null_as_text
from paysleuth.operators.features import WEIGHT, behaviour_features, compress_history, features_since
from paysleuth.plans.ordered import DEFAULT_POLICY, SplitPolicy, hot_groups
from paysleuth.plans.sizing import as_lookup, small_table
from paysleuth.session import materialized
from paysleuth.sources.tables import DATE, path_exists, with_date

WINDOW_DAYS = 7  # the longest window
NEEDED = ["transaction_id", "user_id", "merchant_id", "country", "amount", "timestamp"]
_DAY = 86_400_000_000  # times are microseconds since 1970 here
_NEVER = -(1 << 62)
_FILES = "bucket int, event_date date, n long, oldest long, newest long"
_INDEX = "bucket int, until long, upto long"


def _days_from(us: int) -> Column:
    """Folders that may hold rows from this time on, in whatever time zone their day was named."""
    return F.unix_date(DATE) >= F.lit(max(us // _DAY - 1, -(1 << 31)))


class HistoryStore:
    """The stored history of a stream of transactions, and a foreachBatch writer that features it.

    buckets: into how many the users are dealt. slack_days: how late a row may come before it needs more than its
    bucket's last days. roll_days: how often a bucket's profile moves on, in days of event time.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        buckets: int = 64,
        slack_days: int = 1,
        roll_days: int = 1,
        velocity: str = "per_hour",
        policy: SplitPolicy = DEFAULT_POLICY,
    ):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.slack_days, self.roll_days, self.velocity, self.policy = slack_days, roll_days, velocity, policy

    def _at(self, name: str, batch_id: int | None = None, key: str = "batch") -> str:
        return f"{self.path}/{name}" if batch_id is None else f"{self.path}/{name}/{key}={batch_id}"

    def _list(self, name: str, schema: str, batch_id: int, key: str) -> DataFrame | None:
        """What batches before this one have noted."""
        if not path_exists(self.spark, self._at(name)):
            return None
        table = self.spark.read.schema(f"{schema}, {key} long").parquet(self._at(name))
        return table.filter(F.col(key) < batch_id)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Store a micro-batch and write the features of its rows and of the rows they change."""
        spark = self.spark
        bucket = F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int")
        dated = with_date(batch.withColumn("user_id", null_as_text("user_id"))).withColumn("bucket", bucket)
        here = self._at("rows", batch_id)
        dated.hint("rebalance", "bucket", DATE).write.mode("overwrite").partitionBy("bucket", DATE).parquet(here)
        fresh = spark.read.schema(dated.schema).parquet(here)
        time = F.unix_micros("timestamp")
        noted = fresh.groupBy("bucket", DATE).agg(
            F.count(F.lit(1)).alias("n"), F.min(time).alias("oldest"), F.max(time).alias("newest")
        )
        noted.write.mode("overwrite").parquet(self._at("files", batch_id))
        own = spark.read.schema(_FILES).parquet(self._at("files", batch_id)).collect()  # at most buckets x days rows
        if not own:
            return
        reach = self._reach(batch_id, {r["bucket"] for r in own})
        firsts = materialized(self._firsts(fresh, reach), "history-firsts")
        deep = {r["bucket"] for r in firsts.filter("deep").select("bucket").distinct().collect()}
        rows = self._rows(batch_id, dated.schema, reach, own, deep)
        featured = self._featured(rows, firsts, reach, batch_id, batch.columns)
        featured.write.mode("overwrite").parquet(self._at("features", batch_id))
        self._roll(batch_id, dated.schema, reach, own)

    def _reach(self, batch_id: int, buckets: set[int]) -> dict[int, tuple[int, int, int | None]]:
        """Of each bucket: until when and up to which batch its profile goes, and the profile's version."""
        reach = dict.fromkeys(buckets, (_NEVER, -1, None))
        index = self._list("profile_index", _INDEX, batch_id, "version")
        if index is not None:
            newest = F.max(F.struct("version", "until", "upto")).alias("_p")
            for r in index.filter(F.col("bucket").isin(sorted(buckets))).groupBy("bucket").agg(newest).collect():
                reach[r["bucket"]] = (r["_p"]["until"], r["_p"]["upto"], r["_p"]["version"])
        return reach

    def _reach_table(self, reach: dict) -> DataFrame:
        """At most one row per bucket."""
        rows = [(b, until, upto) for b, (until, upto, _) in reach.items()]
        return F.broadcast(self.spark.createDataFrame(rows, _INDEX))

    def _firsts(self, fresh: DataFrame, reach: dict) -> DataFrame:
        """user_id, bucket, first (earliest row of the batch), deep (its windows reach into the profile)."""
        firsts = fresh.groupBy("user_id", "bucket").agg(F.min(F.unix_micros("timestamp")).alias("first"))
        wide = F.col("first") - F.lit(WINDOW_DAYS * _DAY)
        return firsts.join(self._reach_table(reach), "bucket").withColumn("deep", wide < F.col("until"))

    def _paths(self, batch_id: int, wanted) -> list[str]:
        """Folders of earlier batches; ``wanted`` is a condition on batch, bucket, event_date."""
        files = self._list("files", _FILES, batch_id, "batch")
        if files is None:
            return []
        picked = files.filter(wanted).select("batch", "bucket", DATE).collect()
        return [f"{self._at('rows', r['batch'])}/bucket={r['bucket']}/{DATE}={r[DATE]}" for r in picked]

    def _read_rows(self, paths: list[str], schema: T.StructType) -> DataFrame:
        schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self._at("rows")).parquet(*paths)

    def _rows(self, batch_id: int, schema: T.StructType, reach: dict, own: list, deep: set[int]) -> DataFrame:
        """The stored rows of the batch's buckets that the profiles do not hold, and all rows of buckets in ``deep``."""
        wanted = F.lit(False)
        for bucket, (until, upto, _) in reach.items():
            recent = _days_from(until) | (F.col("batch") > upto)
            wanted = wanted | ((F.col("bucket") == bucket) & (F.lit(True) if bucket in deep else recent))
        paths = self._paths(batch_id, wanted)
        paths += [f"{self._at('rows', batch_id)}/bucket={r['bucket']}/{DATE}={r[DATE]}" for r in own]
        return self._read_rows(paths, schema)

    def _profiles(self, reach: dict) -> DataFrame | None:
        paths = [f"{self._at('profiles', v, 'version')}/bucket={b}" for b, (_, _, v) in reach.items() if v is not None]
        return self.spark.read.option("basePath", self._at("profiles")).parquet(*paths) if paths else None

    def _featured(self, rows: DataFrame, firsts: DataFrame, reach: dict, batch_id: int, columns: list[str]) -> DataFrame:
        """Users that fit a task are scanned as they lie; those to be cut go to the batch operator."""
        one = F.lit(1).cast("long")
        rows = rows.withColumns({WEIGHT: one, "_old": F.lit(False)}).select(*columns, WEIGHT, "bucket", "batch", "_old")
        profiles = self._profiles(reach)
        if profiles is not None:
            old = profiles.select(*NEEDED, WEIGHT, "bucket").withColumns({"batch": F.lit(-1).cast("long"), "_old": F.lit(True)})
            rows = rows.unionByName(old, allowMissingColumns=True)
        few = small_table(firsts.select("user_id"))
        if few is not None:
            rows = rows.join(F.broadcast(few), "user_id", "left_semi")
        counted = Observation()  # in the job that counts the users' rows
        hot = hot_groups(rows.select("user_id").observe(counted, F.count(F.lit(1)).alias("n")), ["user_id"], self.policy)
        reached = {b: (until, upto) for b, (until, upto, _) in reach.items()}
        if hot is None:
            return features_since(rows, batch_id, reached, columns, counted.get["n"], self.velocity)
        names = as_lookup(hot.select("user_id"))
        light = rows.join(names, "user_id", "left_anti")
        light = features_since(light, batch_id, reached, columns, counted.get["n"], self.velocity)
        return light.unionByName(self._cut(rows.join(names, "user_id", "left_semi"), firsts, columns))

    def _cut(self, rows: DataFrame, firsts: DataFrame, columns: list[str]) -> DataFrame:
        mine = rows.join(firsts.drop("bucket"), "user_id")
        time = F.unix_micros("timestamp")
        outside = F.col("deep") | (time >= F.col("until")) | (F.col("batch") > F.col("upto"))
        mine = mine.filter(F.when(F.col("_old"), ~F.col("deep")).otherwise(outside))
        mine = mine.withColumn("_emit", ~F.col("_old") & (time >= F.col("first"))).select(*columns, WEIGHT, "_emit")
        return behaviour_features(mine, self.velocity, policy=self.policy).filter("_emit").drop("_emit", WEIGHT)

    def _roll(self, batch_id: int, schema: T.StructType, reach: dict, own: list) -> None:
        """Move the profiles of the batch's buckets on, where their newest row is far enough ahead."""
        due: dict[int, int] = {}
        for r in own:
            target = (r["newest"] // _DAY - WINDOW_DAYS - self.slack_days) * _DAY
            until = reach[r["bucket"]][0]
            if target >= until + self.roll_days * _DAY:
                due[r["bucket"]] = max(target, due.get(r["bucket"], target))
        if not due:
            return
        wanted = F.lit(False)
        for bucket, target in due.items():
            until, upto, _ = reach[bucket]
            span = ~_days_from(target + 2 * _DAY) & (_days_from(until) | (F.col("batch") > upto))
            wanted = wanted | ((F.col("bucket") == bucket) & span)
        paths = self._paths(batch_id, wanted)
        paths += [f"{self._at('rows', batch_id)}/bucket={r['bucket']}/{DATE}={r[DATE]}" for r in own if r["bucket"] in due]
        moved = {b: reach[b] for b in due}
        targets = self.spark.createDataFrame(list(due.items()), "bucket int, target long")
        rows = self._read_rows(paths, schema).join(self._reach_table(moved), "bucket").join(F.broadcast(targets), "bucket")
        time = F.unix_micros("timestamp")
        left = (time >= F.col("until")) | (F.col("batch") > F.col("upto"))
        rows = rows.filter((time < F.col("target")) & left)
        rows = rows.select(*NEEDED, F.lit(1).cast("long").alias(WEIGHT))
        before = self._profiles(moved)
        if before is not None:
            rows = rows.unionByName(before.select(*NEEDED, WEIGHT))
        bucket = F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int")
        profiles = compress_history(rows).withColumn("bucket", bucket)
        at = self._at("profiles", batch_id, "version")
        profiles.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        written = {r[0] for r in self.spark.read.schema(profiles.schema).parquet(at).select("bucket").distinct().collect()}
        # a bucket without rows before its target has no profile yet
        entries = [(b, t, batch_id) for b, t in due.items() if b in written]
        index = self.spark.createDataFrame(entries, _INDEX)
        index.coalesce(1).write.mode("overwrite").parquet(self._at("profile_index", batch_id, "version"))

    def features(self) -> DataFrame:
        """Every transaction with its features as they are now: of several batches the latest."""
        table = self.spark.read.parquet(self._at("features"))
        columns = [c for c in table.columns if c != "batch"]
        # sorted by a hash first: it compares faster than ids that begin alike
        key = [F.xxhash64("transaction_id", "timestamp").alias("_hash"), "transaction_id", "timestamp"]
        latest = table.groupBy(*key).agg(F.max_by(F.struct(*columns), "batch").alias("_row"))
        return latest.select("_row.*").drop("bucket", DATE)
