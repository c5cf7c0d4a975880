import random

import pytest
from helpers import TINY

from paysleuth.operators import drift
from paysleuth.plans.ordered import DEFAULT_POLICY

COLUMNS = ["tx_count_1h", "amount_sum_1h", "seconds_since_last_tx"]


def frame(spark, ranges, seed, n=500):
    rng = random.Random(seed)
    rows = [tuple(rng.uniform(a, b) for a, b in ranges) for _ in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLUMNS))


@pytest.fixture(scope="module")
def sides(spark):
    usual = [(0, 5), (10, 100), (60, 3600)]
    return (
        frame(spark, usual, 1).persist(),
        frame(spark, usual, 2).persist(),
        frame(spark, [(20, 80), (5000, 20000), (0.1, 2)], 3).persist(),
    )


@pytest.mark.parametrize("test", sorted(drift.TESTS))
def test_identical_sides_do_not_drift_and_shifted_sides_do(sides, test):
    reference, _, shifted = sides
    same = drift.data_drift(reference, reference, COLUMNS, test).collect()
    assert [r["drift_detected"] for r in same] == [False] * 3
    assert [r["drift_score"] for r in same] == pytest.approx([0.0] * 3)
    moved = drift.data_drift(reference, shifted, COLUMNS, test)
    assert [r["drift_detected"] for r in moved.collect()] == [True] * 3
    whole = drift.dataset_drift(moved).collect()[0]
    assert whole["dataset_drift"] and whole["drift_share"] == 1.0
    assert whole["drifted_features"] == sorted(COLUMNS)


@pytest.mark.parametrize("policy", [DEFAULT_POLICY, TINY])
def test_ks_equals_its_definition(sides, policy):
    reference, other, _ = sides
    got = {r["column"]: r["drift_score"] for r in drift.data_drift(reference, other, COLUMNS, policy=policy).collect()}
    for c in COLUMNS:
        a, b = ([r[0] for r in side.select(c).collect()] for side in (reference, other))
        cdf = lambda xs, v: sum(x <= v for x in xs) / len(xs)
        assert got[c] == pytest.approx(max(abs(cdf(a, v) - cdf(b, v)) for v in a + b))


@pytest.mark.parametrize("test", sorted(drift.TESTS))
def test_an_empty_side_has_no_distance(sides, test):
    rows = drift.data_drift(sides[0], sides[1].limit(0), COLUMNS, test).collect()
    assert [(r["drift_score"], r["drift_detected"]) for r in rows] == [(None, False)] * 3


def test_unknown_measure(sides):
    with pytest.raises(ValueError, match="test must be one of"):
        drift.data_drift(sides[0], sides[1], COLUMNS, "nope")


@pytest.mark.parametrize(
    ("score", "critical", "model", "severity"),
    [
        (0.5, 0.9, True, "CRITICAL"),
        (0.4, 0.75, False, "HIGH"),
        (0.1, None, True, "HIGH"),
        (0.45, None, False, "WARNING"),
        (0.05, 0.05, False, "INFO"),
    ],
)
def test_policy(spark, score, critical, model, severity):
    drifts = {} if critical is None else {"tx_count_1h": (critical,)}
    schema = (
        "drift_score double, feature_drifts map<string,struct<drift_score:double>>, model_drift_detected boolean, "
        "f1_degradation double"
    )
    (row,) = drift.drift_policy(spark.createDataFrame([(score, drifts, model, -0.1)], schema)).collect()
    assert row["severity"] == severity
    assert row["alert_triggered"] is row["trigger_retraining"] is (severity != "INFO")
    assert row["remediation_action"] == (None if severity == "INFO" else "triggered_retraining_dag")
    if critical and critical > 0.2:
        assert "['tx_count_1h']" in row["alert_message"]


@pytest.mark.parametrize(("n", "enough"), [(49, False), (50, True)])
def test_model_drift_needs_rows(spark, n, enough):
    predictions = spark.range(n).selectExpr(
        "1L AS model_version_id", "id % 2 = 0 AS prediction_label", "id % 4 = 0 AS actual_label",
        "timestamp '2024-01-30' AS timestamp",
    )
    base = spark.sql("SELECT 1L AS id, 0.9D AS f1_score, 0.9D AS precision, 0.9D AS recall")
    (row,) = drift.model_drift(predictions, base, 1, "2024-01-31").collect()
    assert row["has_sufficient_data"] is enough
    assert row["drift_detected"] is enough
    if enough:
        assert row["current_recall"] == 1.0 and row["f1_degradation"] == pytest.approx(row["current_f1"] - 0.9)


def test_model_drift_within_tolerance(spark):
    predictions = spark.range(100).selectExpr(
        "1L AS model_version_id", "id < 50 AS prediction_label", "id < 50 AS actual_label",
        "timestamp '2024-01-30' AS timestamp",
    )
    base = spark.sql("SELECT 1L AS id, 1.04D AS f1_score, 1D AS precision, 1D AS recall")
    assert not drift.model_drift(predictions, base, 1, "2024-01-31").collect()[0]["drift_detected"]
    old = drift.model_drift(predictions, base, 1, "2024-03-31").collect()[0]
    assert old["labeled_rows"] == 0 and not old["has_sufficient_data"]


def test_the_counts_of_both_sides_are_computed_once(spark):
    from paysleuth.operators import drift

    sides = [spark.range(n).selectExpr("cast(id as double) AS amount") for n in (50, 80)]
    scores = drift.data_drift(*sides, ["amount"])
    assert scores.inputFiles() and all("drift-counts" in f for f in scores.inputFiles())
