import pytest
from pyspark.sql import functions as F

from paysleuth.functions import scalars
from paysleuth.operators import aggregates, deploy, maintain, split
from paysleuth.sources import tables, views


def test_upsert_is_idempotent(make, spark, tmp_path):
    path = str(tmp_path / "tx")
    df = make([{"minute": i} for i in range(5)])
    assert tables.upsert_transactions(spark, df, path).count() == 5
    more = df.unionByName(df).unionByName(make([{"id": "fresh"}]))
    table = tables.upsert_transactions(spark, more, path)
    assert sorted(r[0] for r in table.select("transaction_id").collect()) == ["fresh"] + [f"t000{i}" for i in range(5)]
    assert tables.upsert_transactions(spark, more, path).count() == 6


def test_dead_letters(spark):
    good = (
        '{"transaction_id":"a","user_id":"u","merchant_id":"m","merchant_category":"food","amount":1.5,"country":"AR",'
        '"timestamp":"2024-01-01T00:00:01.000002Z","device_type":"web","ip_hash":"h"}'
    )
    bad = ["", "{", "[]", "null", good.replace("1.5", '"x"'), good.replace('"a"', "null"), good[:40]]
    df = spark.createDataFrame([(v,) for v in [good, *bad]], "value string")
    kept, dead = tables.dead_letter_split(df)
    (row,) = kept.collect()
    assert row["amount"] == 1.5 and row["timestamp"].microsecond == 2
    assert sorted(r["value"] for r in dead.collect()) == sorted(bad)


@pytest.mark.parametrize(
    ("text", "ok"),
    [
        ("550e8400-e29b-41d4-a716-446655440000", True),
        ("550e8400e29b41d4a716446655440000", True),
        ("{550E8400-E29B-41D4-A716-446655440000}", True),
        ("urn:uuid:550e8400-e29b-41d4-a716-446655440000", True),
        ("550e8400-e29b-41d4-a716-44665544000", False),
        ("not-a-uuid", False),
        (None, False),
    ],
)
def test_uuid(spark, text, ok):
    df = spark.createDataFrame([(text,)], "transaction_id string")
    assert (tables.validate_uuid(df).count() == 1) is ok


def test_scan_limit_takes_the_earliest(make):
    df = make([{"minute": 9 - i} for i in range(10)])
    assert [r["transaction_id"] for r in tables.scan_transactions(df, limit=2).collect()] == ["t0009", "t0008"]


def test_time_range_prunes_day_partitions(make, spark, tmp_path):
    path = str(tmp_path / "daily")
    maintain.partition_daily(make([{"minute": i * 1440} for i in range(5)]), path)
    recent = tables.time_range(spark.read.parquet(path), "2025-01-18 00:00:00")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and recent.count() == 2


def test_compaction_keeps_content_and_drops_nothing(make, spark, tmp_path):
    path = str(tmp_path / "daily")
    df = make([{"minute": i * 700, "user": f"u{i % 3}"} for i in range(30)])
    maintain.partition_daily(df, path)
    before = sorted(map(str, spark.read.parquet(path).collect()))
    maintain.compact_old(spark, path, "2025-01-28 00:00:00")
    spark.catalog.refreshByPath(path)
    assert sorted(map(str, spark.read.parquet(path).collect())) == before


def test_retention_drops_partitions(make, spark, tmp_path):
    path = str(tmp_path / "daily")
    df = make([{"minute": 0}, {"minute": -800 * 1440}])
    maintain.partition_daily(df, path)
    assert maintain.drop_expired(spark, path, "2025-01-16 00:00:00") == ["event_date=2022-11-07"]
    spark.catalog.refreshByPath(path)
    assert spark.read.parquet(path).count() == 1
    assert maintain.retention(df, "2025-01-16 00:00:00").count() == 1


def test_refresh_equals_full_recompute(make, spark, tmp_path):
    df = make([{"minute": -i * 37, "fraud": i % 5 == 0} for i in range(300)])
    stale = aggregates.fraud_volume_hourly(df.filter("transaction_id < 't0200'"))
    fresh = maintain.refresh_aggregate(
        stale, df, aggregates.fraud_volume_hourly, "bucket_hour", "hour", "2025-01-15 13:05:00", days=30
    )
    whole = aggregates.fraud_volume_hourly(df)
    assert sorted(map(str, fresh.collect())) == sorted(map(str, whole.collect()))
    path = str(tmp_path / "hourly")
    for part in (df.filter("transaction_id > 't0100'"), df):
        stored = maintain.refresh_stored(
            spark, path, part, aggregates.fraud_volume_hourly, "bucket_hour", "2025-01-15 13:05:00"
        )
    assert sorted(map(str, stored.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_temporal_split_sizes_and_order(make):
    df = make([{"minute": i // 3} for i in range(101)])
    parts = split.temporal_split(df)
    sizes = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert sizes == {"train": 70, "validation": 15, "test": 16}
    assert parts.filter("split = 'train'").agg(F.max("transaction_id")).head()[0] == "t0069"


def test_small_test_slice_is_refused(make):
    with pytest.raises(RuntimeError, match="Only 5 labeled"):
        split.test_slice(make([{} for _ in range(5)]))


def test_promotion(spark):
    md = views.model_deployments(spark, "/root/testdata/sf0.001")
    args = ("2024-01-31", "2024-01-01", "2024-01-30")
    new = deploy.promote_model(md, "run_x", "x", {"f1_score": 0.5}, *args)
    assert new.count() == md.count() + 1
    assert [r["run_id"] for r in new.filter("is_active").collect()] == ["run_x"]
    again = deploy.promote_model(new, "run_x", "x", {}, *args)
    assert again.count() == new.count()
    with pytest.raises(ValueError, match="does not exist"):
        deploy.activate(md, 10**9)


def test_session_slots_restart_at_midnight(spark):
    df = spark.sql("SELECT explode(array(timestamp '2024-01-01 23:59:00', timestamp '2024-01-02 00:10:00')) AS t")
    starts = [r[0].strftime("%d %H:%M") for r in df.select(scalars.session_start("t", 50)).collect()]
    assert starts == ["01 23:20", "02 00:00"]


def test_long_user_numbers_stay_whole(spark):
    from paysleuth.sources.views import padded

    df = spark.createDataFrame([(7,), (10000,), (10009,), (150000,)], "n long")
    assert [r[0] for r in df.select(padded(F.col("n"))).collect()] == ["0007", "10000", "10009", "150000"]


def test_decoded_times_and_missing_fields(spark):
    import json
    from datetime import datetime

    whole = {"transaction_id": "1", "user_id": "u", "merchant_id": "m", "merchant_category": "food", "amount": 1.5,
             "country": "AR", "timestamp": 1706659200000, "device_type": "web", "ip_hash": "h"}
    good = [whole, whole | {"timestamp": "2024-01-31T00:00:00Z"}, whole | {"timestamp": "2024-01-31T01:00:00+01:00"}]
    bad = [{k: v for k, v in whole.items() if k != name} for name in whole]
    bad += [whole | {"timestamp": "soon"}, whole | {"timestamp": 10**18}, whole | {"amount": None}]
    rows = spark.createDataFrame([(json.dumps(m),) for m in good + bad], "value string")
    decoded, dead = tables.dead_letter_split(rows)
    assert [r["timestamp"] for r in decoded.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp")).collect()] == [
        str(datetime(2024, 1, 31))
    ] * 3
    assert dead.count() == len(bad)


def test_refresh_of_stored_buckets_leaves_the_open_one(make, spark, tmp_path):
    path = str(tmp_path / "hourly")
    df = make([{"minute": i * 7, "fraud": i % 5 == 0} for i in range(60)])  # 12:00 to 18:53
    whole = sorted(map(str, aggregates.fraud_volume_hourly(df).collect()))
    columns = aggregates.fraud_volume_hourly(df).columns
    run = lambda at: maintain.refresh_stored(spark, path, df, aggregates.fraud_volume_hourly, "bucket_hour", at)
    assert run("2025-01-15 14:40:00").count() == 2
    assert sorted(map(str, run("2025-01-16 00:00:00").select(*columns).collect())) == whole
    assert sorted(map(str, run("2025-01-15 14:40:00").select(*columns).collect())) == whole


def test_truth_with_repeated_ids_repeats_no_prediction(spark):
    from paysleuth.operators.monitor import label_backfill

    predictions = spark.createDataFrame([("a", None), ("b", True)], "transaction_id string, actual_label boolean")
    truth = spark.createDataFrame([("a", False), ("a", True), ("a", None)], "transaction_id string, is_fraud boolean")
    got = {r["transaction_id"]: r["actual_label"] for r in label_backfill(predictions, truth).collect()}
    assert got == {"a": True, "b": True}
