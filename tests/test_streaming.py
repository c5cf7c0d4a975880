import random
from datetime import timedelta

import pytest
from helpers import BASE
from pyspark.sql import functions as F
from test_features import random_rows

from paysleuth.operators import features as feat
from paysleuth.schemas import PROFILE_FEATURES, WINDOW_FEATURES
from paysleuth.sources import streams, tables
from paysleuth.streaming import aggregates as sagg
from paysleuth.streaming import features as sfeat
from paysleuth.streaming import history

NAMES = WINDOW_FEATURES + PROFILE_FEATURES


def in_files(df, path, parts):
    """Append the table in time order, one file per part."""
    rows = sorted(df.collect(), key=lambda r: (r["timestamp"], r["transaction_id"]))
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        df.sparkSession.createDataFrame(rows[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(path)
        yield


def values(df):
    return sorted(tuple(r) for r in df.select("transaction_id", *[F.round(n, 6) for n in NAMES]).collect())


@pytest.fixture
def tx(make):
    return make(random_rows(160, 11))


def stream_of(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_equals_batch_in_one_batch(tx, spark, tmp_path):
    list(in_files(tx, str(tmp_path / "in"), 1))
    out = streams.run_to_table(sfeat.stream_features(stream_of(spark, tx, str(tmp_path / "in"))))
    assert values(out) == values(feat.behaviour_features(tx))


def test_stream_equals_batch_over_restarts(make, spark, tmp_path):
    """Three runs on one checkpoint, each with new files, give what one batch gives (no tie crosses a file)."""
    rng = random.Random(2)
    rows = random_rows(120, 12)
    for i, r in enumerate(sorted(rows, key=lambda r: r["at"])):
        r["at"] = BASE + timedelta(minutes=150 * i, seconds=rng.randrange(60))
    df = make(rows)
    path, offsets, out = (str(tmp_path / n) for n in ("in", "offsets", "out"))
    for _ in in_files(df, path, 3):
        result = streams.run_to_table(sfeat.stream_features(stream_of(spark, df, path)), offsets, out)
    assert values(result) == values(feat.behaviour_features(df))


def test_late_rows_are_set_aside(make, spark, tmp_path):
    path, offsets, out = (str(tmp_path / n) for n in ("in", "offsets", "out"))
    first = make([{"id": "a", "minute": 0}, {"id": "b", "minute": 200}])
    second = make([{"id": "late", "minute": 100}, {"id": "near", "minute": 150}, {"id": "c", "minute": 210}])
    for df in (first, second):
        df.coalesce(1).write.mode("append").parquet(path)
        result = streams.run_to_table(sfeat.stream_features(stream_of(spark, df, path)), offsets, out)
    assert [r["transaction_id"] for r in sfeat.late_rows(result).collect()] == ["late"]
    good = {r["transaction_id"]: r for r in sfeat.on_time(result).collect()}
    assert good["near"]["tx_count_24h"] == 1  # only "a" is before it
    assert good["c"]["tx_count_24h"] == 3 and good["c"]["seconds_since_last_tx"] == 600.0


def test_warm_start_fills_the_state(make, spark, tmp_path):
    df = make([{"id": "old", "minute": 0}, {"id": "new", "minute": 30}])
    df = df.withColumn("warm_start", F.col("transaction_id") == "old")
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    out = streams.run_to_table(sfeat.stream_features(stream_of(spark, df, path), starting=True))
    (row,) = out.collect()
    assert row["transaction_id"] == "new" and row["tx_count_1h"] == 1


def test_old_rows_leave_the_windows_but_not_the_profile(make, spark, tmp_path):
    df = make([{"id": "a", "minute": 0, "amount": 10.0}, {"id": "b", "minute": 9 * 1440, "amount": 30.0},
               {"id": "c", "minute": 20 * 1440, "amount": 40.0, "country": "BR"}])
    path, offsets, out = (str(tmp_path / n) for n in ("in", "offsets", "out"))
    for _ in in_files(df, path, 3):
        result = streams.run_to_table(sfeat.stream_features(stream_of(spark, df, path)), offsets, out)
    assert values(result) == values(feat.behaviour_features(df))


def test_dead_letters_and_replay(spark, tmp_path):
    good = (
        '{"transaction_id":"%s","user_id":"u","merchant_id":"m","merchant_category":"food","amount":1.0,"country":"AR",'
        '"timestamp":"2024-01-01T00:00:00.000000Z","device_type":"web","ip_hash":"h"}'
    )
    lines = [good % "a", "{broken", good % "b", ""]
    path = str(tmp_path / "in")
    spark.createDataFrame([(v,) for v in lines], "value string").write.text(path)
    sinks = [str(tmp_path / n) for n in ("good", "dead")]
    decoded = streams.stream_source(spark, path)
    write = streams.split_sinks(*sinks)
    streams.run_batches(decoded, write)
    # the same batches again, as after a failure before the commit
    streams.run_batches(decoded, write)
    assert sorted(r["transaction_id"] for r in spark.read.parquet(sinks[0]).collect()) == ["a", "b"]
    assert sorted(r["value"] for r in spark.read.parquet(sinks[1]).collect()) == ["", "{broken"]


def test_dedup_keeps_the_first(make, spark, tmp_path):
    df = make([{"id": "a", "minute": 0}, {"id": "a", "minute": 0.5}, {"id": "b", "minute": 1}])
    path = str(tmp_path / "in")
    for _ in in_files(df, path, 3):
        pass
    out = streams.run_to_table(sagg.stream_dedup(stream_of(spark, df, path)))
    assert sorted((r["transaction_id"], r["timestamp"].second) for r in out.collect()) == [("a", 0), ("b", 0)]


def test_continuous_aggregate_equals_batch_for_closed_hours(make, spark, tmp_path):
    from paysleuth.operators.aggregates import fraud_volume_hourly

    df = make([{"minute": 13 * i, "fraud": i % 4 == 0} for i in range(60)])
    path = str(tmp_path / "in")
    for _ in in_files(df, path, 4):
        pass
    out = streams.run_to_table(sagg.stream_hourly(stream_of(spark, df, path)))
    whole = {str(tuple(r)) for r in fraud_volume_hourly(df).collect()}
    closed = {str(tuple(r)) for r in out.collect()}
    assert closed < whole and len(whole - closed) == 1


def test_enriched_messages_round_trip(make, spark, tmp_path):
    enriched = feat.feature_map(feat.behaviour_features(make([{"minute": 0}, {"minute": 5}]).drop("is_fraud")))
    path = str(tmp_path / "in")
    enriched.select(F.to_json(F.struct(*enriched.columns))).write.text(path)
    out = streams.run_to_table(streams.good_rows(streams.stream_source_features(spark, path)))
    got = {r["transaction_id"]: r["features"] for r in out.collect()}
    assert got["t0001"]["tx_count_1h"] == 1.0 and len(got["t0001"]) == 12
    assert set(tables.decode(spark.createDataFrame([("{}",)], "value string")).columns) >= {"_bad", "_tx"}


@pytest.fixture
def days(make):
    """Forty days of rows; in ``order`` of delivery some come late by hours, days or weeks."""
    rng = random.Random(21)
    rows = random_rows(320, 31)
    for i, r in enumerate(rows):
        r["at"] = BASE + timedelta(days=40 * i / len(rows), seconds=rng.randrange(3600))
        r["id"] = f"t{i:04d}"
    late = {i: rng.choice([0.2, 3, 9, 20]) for i in rng.sample(range(len(rows)), 40)}
    arrival = sorted(range(len(rows)), key=lambda i: (rows[i]["at"] + timedelta(days=late.get(i, 0)), i))
    return make(rows), arrival


def deliver(df, arrival, path, files):
    rows = {r["transaction_id"]: r for r in df.collect()}
    size = -(-len(arrival) // files)
    for i in range(0, len(arrival), size):
        some = [rows[f"t{k:04d}"] for k in arrival[i : i + size]]
        df.sparkSession.createDataFrame(some, df.schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("large", [False, True])
def test_stored_history_equals_batch(days, spark, tmp_path, large):
    """Eight micro-batches with rows late by up to weeks, profiles in between, busy users cut or not."""
    from helpers import TINY

    df, arrival = days
    path = str(tmp_path / "in")
    deliver(df, arrival, path, 8)
    policy = {"policy": TINY} if large else {}
    store = history.HistoryStore(spark, str(tmp_path / "store"), buckets=4, **policy)
    streams.run_batches(stream_of(spark, df, path), store.write)
    batches = spark.read.parquet(f"{store.path}/files").select("batch").distinct().count()
    versions = spark.read.parquet(f"{store.path}/profile_index").select("version").distinct().count()
    written = spark.read.parquet(f"{store.path}/features").count()
    assert batches == 8 and versions > 3 and written > 320  # rows after a late one were written again
    assert store.features().count() == 320
    assert values(store.features()) == values(feat.behaviour_features(df))


def test_a_replayed_batch_changes_nothing(days, spark, tmp_path):
    df, arrival = days
    rows = {r["transaction_id"]: r for r in df.collect()}
    parts = [[rows[f"t{k:04d}"] for k in arrival[i : i + 80]] for i in range(0, 320, 80)]
    store = history.HistoryStore(spark, str(tmp_path / "store"), buckets=4)
    for n, part in enumerate(parts):
        batch = spark.createDataFrame(part, df.schema)
        for _ in range(2 if n in (1, 3) else 1):  # as after a failure before the commit
            store.write(batch, n)
        store.write(batch.limit(0), 100 + n) if n == 3 else None
    assert values(store.features()) == values(feat.behaviour_features(df))


def test_a_batch_reads_its_buckets_last_days_only(make, spark, tmp_path, monkeypatch):
    """What a micro-batch opens does not grow with the history: the rows since the profile, of the users' buckets."""
    df = make([{"user": f"u{i % 6}", "minute": 360 * i, "id": f"t{i:04d}"} for i in range(400)])  # 100 days
    rows = sorted(df.collect(), key=lambda r: r["timestamp"])
    store = history.HistoryStore(spark, str(tmp_path / "store"), buckets=8)
    opened = []
    read = store._read_rows
    monkeypatch.setattr(store, "_read_rows", lambda paths, schema: opened.append(paths) or read(paths, schema))
    sizes = []
    for n in range(10):
        opened.clear()
        store.write(spark.createDataFrame(rows[40 * n : 40 * n + 40], df.schema), n)
        sizes.append(len(opened[0]))
    assert max(sizes[3:]) <= 1.3 * min(sizes[3:]) and sizes[-1] < 160
    one = spark.createDataFrame([rows[-1]], df.schema)
    opened.clear()
    store.write(one.withColumn("transaction_id", F.lit("one")), 10)
    buckets = {p.split("bucket=")[1].split("/")[0] for p in opened[0]}
    assert len(buckets) == 1
    assert values(store.features().filter("transaction_id != 'one'")) == values(feat.behaviour_features(df))


def test_profiles_grow_and_hold_late_rows(make, spark, tmp_path):
    store = history.HistoryStore(spark, str(tmp_path / "store"), buckets=1)
    store.write(make([{"minute": 1440 * i, "amount": 10.0 + i} for i in range(12)]), 0)
    late = make([{"id": "late", "minute": 700, "amount": 5.0}])
    store.write(late, 1)  # before the profile's end: its user is read from the start
    store.write(make([{"id": "next", "minute": 1440 * 14, "amount": 1.0}]), 2)
    profile = spark.read.parquet(f"{store.path}/profiles/version=2").collect()
    assert [(r["tx_weight"], r["amount"]) for r in profile] == [(7, 80.0)]  # six days and the late row
    last = store.features().filter("transaction_id = 'next'").first()
    assert last["amount_ratio_vs_user_avg"] == pytest.approx(1.0 / ((sum(range(10, 22)) + 5) / 13))


def test_one_users_update_works_on_plain_lists():
    import numpy as np

    from paysleuth.streaming import features as sfeat

    first = sfeat._first_times(["AR", "BR"], [5, 9], ["BR", "CL", "CL"], [7, 8, 6])
    assert first == {"AR": 5, "BR": 7, "CL": 6}
    unseen, seen = sfeat._novelty(first, ["BR", "CL", "CL"], np.array([7, 8, 6]))
    assert unseen.tolist() == [1.0, 0.0, 1.0] and seen.tolist() == [2, 3, 1]
    live = np.array([True, False, True])
    assert sfeat._nullable("tx_count_1h", live, np.array([3, 4])).tolist()[::2] == [3, 4]
    ratio = sfeat._nullable("amount_ratio_vs_user_avg", live, np.array([1.5, np.nan]))
    assert ratio.isna().tolist() == [False, True, True]
    assert sfeat._nullable("tx_count_1h", live, None).isna().all()


def test_users_that_fit_a_task_are_scanned_without_echoes(make, spark):
    """Whole users cut by Arrow batches, ties and nulls: as the batch operator, without a window or four points a row."""
    rng = random.Random(5)
    rows = [r | {"user": f"u{i % 5}", "merchant": f"m{i % 7}" if i % 9 else None} for i, r in enumerate(random_rows(120, 15))]
    df = make(rows).withColumn("amount", F.when(F.col("transaction_id") != "r00007", F.col("amount")))
    said = F.col("transaction_id").isin([f"r{i:05d}" for i in rng.sample(range(120), 6)])
    marked = df.withColumns({"bucket": F.lit(0), "batch": F.when(said, 3).otherwise(2).cast("long"), "_old": F.lit(False)})
    marked = marked.withColumn(feat.WEIGHT, F.lit(1).cast("long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = feat.features_since(marked, 3, {0: (-(1 << 62), -1)}, df.columns, 120, "per_hour")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Generate" not in plan
        got = values(out)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    firsts = df.filter(said).groupBy("user_id").agg(F.min("timestamp").alias("first"))
    want = feat.behaviour_features(df).join(firsts, "user_id").filter("timestamp >= first")
    assert got == values(want) and 6 < len(got) < 120
