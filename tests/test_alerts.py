import random

import numpy as np

import pytest
from helpers import TINY

from paysleuth.operators import alerts, detect, quality
from paysleuth.plans.ordered import DEFAULT_POLICY

MINUTE = 60_000_000


def walk(times, gap):
    kept, last = [], None
    for t in sorted(set(times)):
        if last is None or t > last + gap:
            kept.append(t)
            last = t
    return kept


@pytest.mark.parametrize("policy", [DEFAULT_POLICY, TINY])
def test_suppression_is_the_greedy_walk(spark, policy):
    rng = random.Random(3)
    times = [rng.randrange(0, 400 * MINUTE) for _ in range(120)] + [0, 15 * MINUTE, 30 * MINUTE + 1]
    df = spark.createDataFrame([(t,) for t in times], "at long")
    kept = alerts.suppress_chain(df, 15 * MINUTE, policy)
    assert sorted(r["at"] for r in kept.collect()) == walk(times, 15 * MINUTE)


@pytest.mark.parametrize("step", [1, 7, 400])
def test_exits_are_those_of_walks(step):
    rng = np.random.default_rng(step)
    for gap in (3, 50, 1000):
        times = np.unique(rng.integers(0, 300 * step, 300))
        entries, exits = alerts._exits(times, gap)
        for e in range(int(times[0]) - 2, int(times[0]) + gap + 1):
            kept = alerts._walk(times, e, gap)
            k = int(np.searchsorted(entries, e))
            assert (exits[k] if k < len(entries) else None) == (kept[-1] + gap + 1 if len(kept) else None)


def test_many_exits_are_looked_up_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(alerts, "_MOST_EXITS", 0)
    rng = random.Random(8)
    times = sorted({rng.randrange(400 * MINUTE) for _ in range(60)})
    df = spark.createDataFrame([(t,) for t in times], "at long")
    kept = alerts.suppress_chain(df, 15 * MINUTE, TINY)
    assert sorted(r["at"] for r in kept.collect()) == walk(times, 15 * MINUTE)


def test_suppression_of_few(spark):
    for times in ([], [5], [5, 6]):
        df = spark.createDataFrame([(t,) for t in times], "at long")
        kept = alerts.suppress_chain(df, MINUTE, TINY)
        assert sorted(r["at"] for r in kept.collect()) == walk(times, MINUTE)


def predictions(spark, flags):
    rows = [(i * MINUTE, f) for i, f in flags]
    return spark.createDataFrame(rows, "us long, prediction_label boolean").selectExpr(
        "timestamp_micros(us) AS timestamp", "prediction_label"
    )


@pytest.mark.parametrize("policy", [DEFAULT_POLICY, TINY])
def test_rate_window_is_inclusive_and_peers_see_each_other(spark, policy):
    df = predictions(spark, [(0, True), (15, False), (15, False), (31, False)])
    points = {r["at"] // MINUTE: r for r in alerts.fraud_rate_points(df, threshold=0.05, policy=policy).collect()}
    assert set(points) == {0, 15}
    assert (points[15]["fraud_count"], points[15]["total_count"]) == (1, 3)


def test_alert_message_and_open_alerts(spark):
    df = predictions(spark, [(0, True), (1, True), (40, True)])
    got = sorted(alerts.fraud_rate_alerts(df).collect(), key=lambda r: r["triggered_at"])
    assert [r["message"] for r in got] == [
        "High fraud rate detected: 100.00% over the last 15 minutes (1/1 predictions).",
    ] * 2
    before = spark.sql("SELECT timestamp_micros(-60000000) AS triggered_at")
    muted = alerts.fraud_rate_alerts(df, open_alerts=before).collect()
    assert [r["triggered_at"].minute for r in muted] == [40]


@pytest.mark.parametrize("policy", [DEFAULT_POLICY, TINY])
def test_rule_hold(spark, policy):
    states = [1, 1, 0] + [1] * 12 + [0] + [1] * 4
    rows = [(i * MINUTE, bool(s)) for i, s in enumerate(states)]
    ticks = spark.createDataFrame(rows, "us long, high boolean").selectExpr("timestamp_micros(us) AS time", "high")
    held = alerts.rule_hold(ticks, "high", 600, 60, policy).collect()
    assert sorted((r["time"].minute, r["held_seconds"]) for r in held) == [(13, 600), (14, 660)]


@pytest.mark.parametrize("policy", [DEFAULT_POLICY, TINY])
def test_high_frequency(make, policy):
    rows = [{"minute": m} for m in (0, 10, 20, 30, 30, 31)] + [{"user": "b", "minute": m} for m in range(4)]
    found = detect.detect_high_frequency(make(rows), policy=policy).collect()
    assert sorted((r["transaction_id"], r["tx_in_window"]) for r in found) == [
        ("t0003", 5), ("t0004", 5), ("t0005", 5)
    ]


@pytest.mark.parametrize(
    ("amounts", "status", "fires"),
    [([5.0] * 5, "insufficient_data", False), ([200.0] * 20, "ok", False), ([200.0] * 19 + [500_000.0], "ok", True),
     ([0.5] * 20, "ok", True)],
)
def test_amount_check(make, amounts, status, fires):
    (row,) = quality.dq_amount(make([{"amount": a} for a in amounts]), "2025-01-15 13:00:00").collect()
    assert (row["status"], row["alert_triggered"]) == (status, fires)


@pytest.mark.parametrize(("n", "fires"), [(50, False), (2, True)])
def test_volume_check(make, n, fires):
    (row,) = quality.dq_volume(make([{} for _ in range(n)]), "2025-01-15 12:30:00").collect()
    assert (row["count"], row["alert_triggered"]) == (n, fires)
    if fires:
        assert row["message"] == "Only 2 transactions in last hour (min: 10)"


def test_stale_rule_without_reports(spark):
    none = spark.sql("SELECT cast(null as timestamp) AS report_date LIMIT 0")
    (row,) = quality.rule_drift_stale(none, "2024-01-31").collect()
    assert (row["value"], row["firing"]) == (9999.0, True)


def test_fraud_patterns(make):
    from paysleuth.operators.features import behaviour_features

    rows = [{"minute": i, "amount": 50.0} for i in range(3)]
    rows += [{"minute": 60, "amount": 400.0}, {"minute": 90, "country": "US", "merchant": "new", "amount": 310.0}]
    df = make(rows)
    found = {r["transaction_id"]: r for r in detect.detect_any(behaviour_features(df), df).collect()}
    assert found["t0003"]["patterns"] == "amount_anomaly"
    assert found["t0004"]["patterns"] == "unknown_merchant_high_amount,unusual_country"
    assert set(found) == {"t0003", "t0004"}
