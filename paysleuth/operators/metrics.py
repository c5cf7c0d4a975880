"""Model evaluation as table queries over (label, score).

Curves need the scores in order over the whole table. Scores are combined per distinct value first
and the cumulative counts come from the segmented scan in ``plans.ordered``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysleuth.functions.scalars import safe_ratio
from paysleuth.plans.ordered import DEFAULT_POLICY, SplitPolicy, running
from paysleuth.plans.sizing import with_row

COST_FALSE_NEGATIVE = 100.0
COST_FALSE_POSITIVE = 5.0


def labelled_scores(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("label"), F.col(score).cast("double").alias("score")
    )


def confusion(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    flagged, positive = F.col("score") >= F.lit(threshold), F.col("label") == 1
    return scores.agg(
        F.count_if(flagged & positive).alias("tp"),
        F.count_if(flagged & ~positive).alias("fp"),
        F.count_if(~flagged & ~positive).alias("tn"),
        F.count_if(~flagged & positive).alias("fn"),
    )


def _or_zero(part, whole):
    return F.coalesce(safe_ratio(part, whole), F.lit(0.0))


def prf(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp, fn; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns(
        {
            "precision": _or_zero(tp, tp + fp),
            "recall": _or_zero(tp, tp + fn),
            "f1_score": _or_zero(2 * tp, 2 * tp + fp + fn),
        }
    )


def binary_metrics(
    scores: DataFrame,
    threshold: float = 0.5,
    cost_fn: float = COST_FALSE_NEGATIVE,
    cost_fp: float = COST_FALSE_POSITIVE,
) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    cost = fn * F.lit(cost_fn) + fp * F.lit(cost_fp)
    return prf(confusion(scores, threshold)).withColumns(
        {
            "fpr": _or_zero(fp, fp + tn),
            "fnr": _or_zero(fn, fn + tp),
            "threshold": F.lit(float(threshold)),
            "total_cost": cost,
            "cost_per_transaction": _or_zero(cost, tp + fp + tn + fn),
            "fraud_detected_pct": _or_zero(tp, tp + fn),
            "legitimate_blocked_pct": _or_zero(fp, fp + tn),
        }
    )


def ranked(scores: DataFrame, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """One row per distinct score with the counts at or above it.

    Columns: score, pos, neg (at the score), tp, fp (at or above it), total_pos, total_neg.
    """
    per = scores.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    before = running(per, [], "score", {"_p": ("sum", "pos"), "_n": ("sum", "neg")}, policy=policy)
    totals = scores.agg(
        F.count_if(F.col("label") == 1).alias("total_pos"), F.count_if(F.col("label") != 1).alias("total_neg")
    )
    joined = with_row(before, totals)
    zero = F.lit(0).cast("long")
    return joined.select(
        "score",
        "pos",
        "neg",
        (F.col("total_pos") - F.coalesce("_p", zero)).alias("tp"),
        (F.col("total_neg") - F.coalesce("_n", zero)).alias("fp"),
        "total_pos",
        "total_neg",
    )


def roc_auc(scores: DataFrame, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """Share of (fraud, legitimate) pairs in the right order; equal scores count one half."""
    table = ranked(scores, policy)
    below = F.col("total_neg") - F.col("fp")
    wins = F.col("pos").cast("double") * (below + F.col("neg") / 2)
    pairs = F.any_value("total_pos").cast("double") * F.any_value("total_neg")
    return table.agg(F.try_divide(F.sum(wins), pairs).alias("roc_auc"))


def pr_auc(scores: DataFrame, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """Average precision: sum over scores of (gain in recall) x precision."""
    table = ranked(scores, policy)
    part = F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return table.agg(F.try_divide(F.sum(part), F.any_value("total_pos").cast("double")).alias("pr_auc"))


def roc_curve(scores: DataFrame, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """(threshold, fpr, tpr), one point per distinct score; the origin has a NULL threshold."""
    points = ranked(scores, policy).select(
        F.col("score").alias("threshold"),
        _or_zero("fp", "total_neg").alias("fpr"),
        _or_zero("tp", "total_pos").alias("tpr"),
    )
    origin = scores.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def pr_curve(scores: DataFrame, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """(threshold, precision, recall); the end point (1, 0) has a NULL threshold."""
    points = ranked(scores, policy).select(
        F.col("score").alias("threshold"),
        _or_zero("tp", F.col("tp") + F.col("fp")).alias("precision"),
        _or_zero("tp", "total_pos").alias("recall"),
    )
    end = scores.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def threshold_grid(start: float = 0.10, stop: float = 0.90, step: float = 0.01) -> list[float]:
    count = int(round((stop - start) / step)) + 1
    return [round(start + i * step, 10) for i in range(count)]


def threshold_metrics(scores: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Precision, recall, F1 and cost at each threshold of a grid, in one pass.

    Each row is put into the interval of the grid it falls in; the grid's counts are then added up from the
    top. No row meets more than one threshold.
    """
    grid = sorted(thresholds or threshold_grid())
    spark = scores.sparkSession
    marks = F.array(*[F.lit(t) for t in grid])
    passed = F.size(F.filter(marks, lambda t: t <= F.col("score")))
    hist = scores.groupBy(passed.alias("passed")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    # at most len(grid) + 1 rows on either side of this join
    steps = spark.createDataFrame([(i, t) for i, t in enumerate(grid)], "i int, threshold double")
    spread = hist.select(
        "pos", "neg", "passed", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("i")
    )
    above = F.col("passed") > F.col("i")
    counts = spread.groupBy("i").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~above, F.col("neg")).otherwise(0)).alias("tn"),
    )
    return prf(steps.join(counts, "i")).drop("i")


def optimal_threshold(
    scores: DataFrame,
    thresholds: list[float] | None = None,
    cost_fn: float = COST_FALSE_NEGATIVE,
    cost_fp: float = COST_FALSE_POSITIVE,
) -> DataFrame:
    """The threshold of least cost; the smallest one among equals."""
    cost = F.col("fn") * F.lit(cost_fn) + F.col("fp") * F.lit(cost_fp)
    priced = threshold_metrics(scores, thresholds).withColumn("cost", cost)
    order = F.struct("cost", "threshold")
    return priced.agg(F.min_by("threshold", order).alias("threshold"), F.min("cost").alias("total_cost"))


def quality_gates(
    metrics: DataFrame, min_f1: float = 0.30, min_auc: float = 0.90, max_latency_ms: float = 50.0
) -> DataFrame:
    """metrics: one row with f1_score, auc_roc and latency_p99_ms."""
    gates = {
        "f1_passed": F.col("f1_score") >= min_f1,
        "auc_roc_passed": F.col("auc_roc") >= min_auc,
        "latency_passed": F.col("latency_p99_ms") <= max_latency_ms,
    }
    checked = metrics.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in gates.items()})
    return checked.withColumn("passed", F.col("f1_passed") & F.col("auc_roc_passed") & F.col("latency_passed"))


def champion_compare(challenger: DataFrame, champion: DataFrame, max_regression: float = 0.02) -> DataFrame:
    """Each side is at most one row (f1_score, auc_roc); without a champion the challenger wins."""
    left = challenger.select(
        F.col("f1_score").alias("challenger_f1"), F.col("auc_roc").alias("challenger_auc_roc")
    )
    right = champion.select(
        F.col("f1_score").alias("champion_f1"), F.col("auc_roc").alias("champion_auc_roc")
    )
    both = with_row(left, right)
    diff = F.col("challenger_f1") - F.col("champion_f1")
    wins = F.coalesce(F.col("challenger_f1") >= F.col("champion_f1") - F.lit(max_regression), F.lit(True))
    within = F.format_string(
        f"Challenger F1 (%.4f) is within acceptable range of champion F1 (%.4f) — max allowed regression: "
        f"{max_regression:.2f} (diff: %+.4f)",
        F.col("challenger_f1"),
        F.col("champion_f1"),
        diff,
    )
    worse = F.format_string(
        f"Challenger F1 (%.4f) regresses champion F1 (%.4f) by more than {max_regression:.2f} (diff: %+.4f)",
        F.col("challenger_f1"),
        F.col("champion_f1"),
        diff,
    )
    none = F.lit("No champion model in Production stage — challenger wins by default")
    reason = F.when(F.col("champion_f1").isNull(), none).when(wins, within).otherwise(worse)
    return both.select(
        "*", diff.alias("f1_difference"), wins.alias("challenger_wins"), reason.alias("reason")
    )
