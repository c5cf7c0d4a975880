import pytest
from pyspark.sql import functions as F

from paysleuth.operators import aggregates as agg
from paysleuth.operators import continuous
from paysleuth.sources import tables, views

PLAIN = {continuous.FRAUD_HOURLY: agg.fraud_volume_hourly, continuous.MERCHANT_DAILY: agg.merchant_amount_daily}


def shown(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("rollup", list(PLAIN), ids=["hourly", "daily"])
def test_reads_equal_a_full_grouping_at_every_step(make, spark, tmp_path, monkeypatch, rollup):
    monkeypatch.setattr(continuous, "MOST_VERSIONS", 3)
    rows = [{"minute": 97 * i, "fraud": i % 5 == 0, "merchant": f"m{i % 3}", "amount": 1.5 * i} for i in range(120)]
    df = make(rows)
    stored = continuous.ContinuousAggregate(spark, str(tmp_path / "cagg"), rollup)
    plain = PLAIN[rollup]
    assert shown(stored.read(df)) == shown(plain(df))
    for day in range(16, 24):
        seen = df.filter(F.col("timestamp") < F.lit(f"2025-01-{day} 09:10:00").cast("timestamp"))
        stored.refresh(seen, f"2025-01-{day} 09:00:00")
        stored.refresh(seen, f"2025-01-{day} 09:00:00")  # again: nothing to do
        assert shown(stored.read(seen)) == shown(plain(seen))
        assert shown(stored.read(df)) == shown(plain(df))
    late = make([{"id": "late", "minute": 60, "fraud": True, "merchant": "m9"}])
    both = df.unionByName(late)
    stored.add(late)
    assert shown(stored.read(both)) == shown(plain(both))
    stored.refresh(both, "2025-01-24 09:00:00", days=30)  # all buckets anew, the late row among them
    assert shown(stored.read(both)) == shown(plain(both))
    recent = plain(both).filter(F.col(rollup.bucket) >= F.lit("2025-01-20").cast("timestamp"))
    assert shown(stored.read(both, since="2025-01-20 00:00:00")) == shown(recent)


def test_a_read_prunes_days_and_scans_the_tail_only(make, spark, tmp_path):
    df = tables.with_date(make([{"minute": 60 * i} for i in range(24 * 12)]))
    df.write.partitionBy("event_date").parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    stored = continuous.ContinuousAggregate(spark, str(tmp_path / "cagg"), continuous.FRAUD_HOURLY)
    stored.refresh(raw, "2025-01-26 06:00:00")
    report = stored.read(raw, since="2025-01-25 00:00:00")
    plan = report._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "GreaterThanOrEqual(timestamp,2025-01-26 05:00:00" in plan
    assert report.count() == 24 + 24 + 12  # three days, the last one to noon


def test_one_users_filter_reaches_the_stored_key(spark):
    assert [views.stored_user(u) for u in ("user_0007", "user_7", "user_12345", "user_012345", "x", "user_")] == [7, None, 12345, None, None, None]
    folder = "/root/testdata/sf0.001"
    mine = tables.user_history_7d(views.transactions(spark, folder, user_id="user_0007"), "user_0007", views.AS_OF)
    plan = mine._jdf.queryExecution().toString()
    assert "EqualTo(user_id,7)" in plan and "GreaterThanOrEqual(ts," in plan
    every = tables.user_history_7d(views.transactions(spark, folder), "user_0007", views.AS_OF)
    assert shown(mine) == shown(every)
    assert views.transactions(spark, folder, user_id="nobody").count() == 0
