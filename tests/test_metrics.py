import random

import pytest
from helpers import TINY

from paysleuth.operators import metrics
from paysleuth.plans.ordered import DEFAULT_POLICY

Y = [0, 0, 1, 1, 1]
P = [0.1, 0.4, 0.6, 0.8, 0.9]


def table(spark, y=Y, p=P):
    return spark.createDataFrame(list(zip(y, p, strict=True)), "label int, score double")


def one(df):
    return df.collect()[0].asDict()


@pytest.mark.parametrize(
    ("threshold", "tp", "fp"), [(0.0, 3, 2), (0.3, 3, 1), (0.5, 3, 0), (0.7, 2, 0), (1.0, 0, 0)]
)
def test_confusion(spark, threshold, tp, fp):
    got = one(metrics.confusion(table(spark), threshold))
    assert got == {"tp": tp, "fp": fp, "tn": 2 - fp, "fn": 3 - tp}


def test_binary_metrics_costs_and_zero_division(spark):
    got = one(metrics.binary_metrics(table(spark), 0.7))
    assert got["precision"] == 1.0 and got["recall"] == pytest.approx(2 / 3) and got["f1_score"] == pytest.approx(0.8)
    assert got["total_cost"] == 100.0 and got["cost_per_transaction"] == 20.0
    assert got["fnr"] == pytest.approx(1 / 3) and got["fpr"] == 0.0
    none = one(metrics.binary_metrics(table(spark), 1.0))
    assert (none["precision"], none["recall"], none["f1_score"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("policy", [DEFAULT_POLICY, TINY])
def test_areas_with_ties(spark, policy):
    rng = random.Random(1)
    y = [int(rng.random() < 0.3) for _ in range(200)]
    p = [round(rng.random(), 1) for _ in y]
    df = table(spark, y, p)
    pairs = [(a, b) for a, ya in zip(p, y, strict=True) if ya for b, yb in zip(p, y, strict=True) if not yb]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    assert one(metrics.roc_auc(df, policy))["roc_auc"] == pytest.approx(auc)
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp = sum(1 for a, ya in zip(p, y, strict=True) if a >= t and ya)
        n = sum(1 for a in p if a >= t)
        ap += (tp / sum(y) - last) * tp / n
        last = tp / sum(y)
    assert one(metrics.pr_auc(df, policy))["pr_auc"] == pytest.approx(ap)


def test_curves_end_points(spark):
    roc = sorted(tuple(r)[1:] for r in metrics.roc_curve(table(spark)).collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0) and len(roc) == 6
    pr = metrics.pr_curve(table(spark)).filter("threshold IS NULL").collect()
    assert tuple(pr[0])[1:] == (1.0, 0.0)


def test_threshold_grid_and_optimum(spark):
    grid = metrics.threshold_grid()
    assert len(grid) == 81 and grid[0] == 0.1 and grid[-1] == 0.9
    rows = {r["threshold"]: r for r in metrics.threshold_metrics(table(spark), [0.0, 0.3, 0.5, 0.7, 1.0]).collect()}
    assert [(rows[t]["tp"], rows[t]["fp"]) for t in (0.0, 0.3, 0.5, 0.7, 1.0)] == [(3, 2), (3, 1), (3, 0), (2, 0), (0, 0)]
    best = one(metrics.optimal_threshold(table(spark)))
    # every threshold in (0.4, 0.6] costs nothing; the first one wins
    assert best == {"threshold": 0.41, "total_cost": 0.0}


def test_quality_gates(spark):
    rows = [(0.31, 0.95, 20.0), (0.29, 0.95, 20.0), (0.31, 0.89, 20.0), (0.31, 0.95, 51.0)]
    df = spark.createDataFrame(rows, "f1_score double, auc_roc double, latency_p99_ms double")
    assert [r["passed"] for r in metrics.quality_gates(df).collect()] == [True, False, False, False]


@pytest.mark.parametrize(("challenger", "wins"), [(0.80, True), (0.785, True), (0.77, False)])
def test_champion(spark, challenger, wins):
    side = lambda f1: spark.createDataFrame([(f1, 0.9)], "f1_score double, auc_roc double")
    got = one(metrics.champion_compare(side(challenger), side(0.80)))
    assert got["challenger_wins"] is wins
    assert ("regresses" in got["reason"]) is (not wins)
    alone = one(metrics.champion_compare(side(challenger), side(0.8).limit(0)))
    assert alone["challenger_wins"] and alone["champion_f1"] is None
