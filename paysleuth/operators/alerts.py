"""Fraud-rate alerts, the alert log and rules that must hold for a while."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysleuth.functions.scalars import rate_text, severity
from paysleuth.plans.ordered import DEFAULT_POLICY, SplitPolicy, running
from paysleuth.plans.sizing import with_row
from paysleuth.session import materialized

MINUTE_US = 60_000_000


def fraud_rate_points(
    predictions: DataFrame, minutes: int = 15, threshold: float = 0.05, policy: SplitPolicy = DEFAULT_POLICY
) -> DataFrame:
    """The times at which the predicted-fraud rate of [t - window, t] exceeds the threshold.

    One row per distinct time (predictions of the same instant see each other). Counts per instant
    are combined first; then two running sums over time give the window's counts.
    """
    at = F.unix_micros("timestamp")
    width = F.lit(minutes * MINUTE_US)
    per_time = predictions.groupBy(at.alias("_us")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("prediction_label").alias("_f")
    )
    zero = F.lit(0).cast("long")
    points = per_time.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("_us").alias("at"), F.col("_n").alias("n"), F.col("_f").alias("f"),
                    zero.alias("old_n"), zero.alias("old_f"),
                ),
                F.struct(
                    (F.col("_us") + width).alias("at"), zero.alias("n"), zero.alias("f"),
                    F.col("_n").alias("old_n"), F.col("_f").alias("old_f"),
                ),
            )
        ).alias("p")
    ).select("p.*")
    merged = points.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "f", "old_n", "old_f")])
    scan = {f"_{c}": ("sum", c) for c in ("n", "f", "old_n", "old_f")}
    before = running(merged, [], "at", scan, policy=policy)
    value = {c: F.coalesce(F.col(f"_{c}"), zero) for c in ("n", "f", "old_n", "old_f")}
    total = value["n"] + F.col("n") - value["old_n"]
    fraud = value["f"] + F.col("f") - value["old_f"]
    rated = before.filter(F.col("n") > 0).select("at", total.alias("total_count"), fraud.alias("fraud_count"))
    rated = rated.withColumn("fraud_rate", F.col("fraud_count") / F.col("total_count"))
    return rated.filter(F.col("fraud_rate") > threshold)


def _walk(times: np.ndarray, entry: int, gap_us: int) -> np.ndarray:
    """The times kept from ``entry`` on: the first, the first one after its gap, and so on. times: ascending."""
    kept = []
    while (i := int(np.searchsorted(times, entry))) < len(times):
        kept.append(int(times[i]))
        entry = kept[-1] + gap_us + 1
    return np.array(kept, dtype=np.int64)


def _exits(times: np.ndarray, gap_us: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, exits): who enters after the entry before and up to an entry leaves at its exit.

    Only the first candidates can be entered at: those up to the gap after the first, and one more. All their walks go on
    together and become one where they meet.
    """
    entries = times[: int(np.searchsorted(times, times[0] + gap_us, side="right")) + 1]
    exits = entries + gap_us + 1
    now, back = np.unique(exits, return_inverse=True)
    while True:
        at = np.searchsorted(times, now)
        inside = at < len(times)
        if not inside.any():
            break
        further = np.where(inside, times[np.minimum(at, len(times) - 1)] + gap_us + 1, now)
        now, merged = np.unique(further, return_inverse=True)
        back = merged[back]
    exits = now[back]
    last = np.append(exits[1:] != exits[:-1], True)
    return entries[last], exits[last]


_MOST_EXITS = 200_000  # rows that the driver composes at once


def _compose(exits: DataFrame, blocks: list[int], now: int) -> list[tuple[int, int]]:
    """(block, time of entry) of the blocks one after another, the first entered at ``now``."""
    steps: dict[int, list] = {}
    if exits.count() <= _MOST_EXITS:
        for r in exits.collect():
            steps.setdefault(r["block"], []).append((r["entry"], r["exit"]))
        steps = {b: sorted(rows) for b, rows in steps.items()}
    entered = []
    for block in blocks:
        if block in steps:
            after = next((r for r in steps[block] if r[0] >= now), None)
        else:  # one look-up a block
            own = exits.filter((F.col("block") == block) & (F.col("entry") >= now))
            after = own.agg(F.min(F.struct("entry", "exit"))).first()[0]
        if after is not None:
            entered.append((block, now))
            now = after[1]
    return entered


def suppress_chain(candidates: DataFrame, gap_us: int, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """The candidates that remain if each one kept mutes the next ``gap_us`` microseconds.

    Keeping is a walk: first candidate, then the first one after the gap, and so on. Time is cut into blocks longer than
    the gap. What a block does depends on when it is entered only: all blocks at once work out for each entry when
    it would be left, a short scan over the blocks composes these, and all blocks at once walk from their real entry.
    """
    times = candidates.select("at")
    n, first, last = times.agg(F.count(F.lit(1)), F.min("at"), F.max("at")).first()
    if not n:
        return times
    blocks = min(math.ceil(n / policy.rows_per_segment), policy.max_segments)
    width = max(gap_us + 1, (last - first) // blocks + 1)
    times = times.withColumn("block", F.floor((F.col("at") - F.lit(first)) / F.lit(width)).cast("long"))

    def leave(block: pd.DataFrame) -> pd.DataFrame:
        entries, exits = _exits(np.unique(block["at"].to_numpy()), gap_us)
        return pd.DataFrame({"block": block["block"].iloc[0], "entry": entries, "exit": exits})

    if last - first < width:  # one block, entered at its start
        entered = [(0, first)]
    else:
        exits = materialized(times.groupBy("block").applyInPandas(leave, "block long, entry long, exit long"), "block-exits")
        entered = _compose(exits, sorted(r[0] for r in exits.select("block").distinct().collect()), first)
    entries = candidates.sparkSession.createDataFrame(entered, "block long, entry long")  # one row a block at most

    def walk(block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": _walk(np.unique(block["at"].to_numpy()), int(block["entry"].iloc[0]), gap_us)})

    return times.join(F.broadcast(entries), "block").groupBy("block").applyInPandas(walk, "at long")


def fraud_rate_alerts(
    predictions: DataFrame,
    minutes: int = 15,
    threshold: float = 0.05,
    policy: SplitPolicy = DEFAULT_POLICY,
    open_alerts: DataFrame | None = None,
) -> DataFrame:
    """HIGH_FRAUD_RATE alerts: rate above the threshold and no open alert in the window before.

    open_alerts: existing unacknowledged alert times (``triggered_at``) that mute as well.
    """
    # written once: the chain and the join below read it
    points = materialized(fraud_rate_points(predictions, minutes, threshold, policy), "rate-points")
    gap = minutes * MINUTE_US
    if open_alerts is not None:
        points = _drop_muted(points, open_alerts, gap, policy)
    kept = suppress_chain(points, gap, policy)
    alerts = points.join(kept, "at")
    message = F.format_string(
        f"High fraud rate detected: %s%% over the last {minutes} minutes (%d/%d predictions).",
        rate_text("fraud_rate"),
        F.col("fraud_count"),
        F.col("total_count"),
    )
    return alerts.select(
        F.lit("HIGH_FRAUD_RATE").alias("alert_type"),
        F.lit("HIGH").alias("severity"),
        message.alias("message"),
        F.timestamp_micros("at").alias("triggered_at"),
    )


def _drop_muted(points: DataFrame, open_alerts: DataFrame, gap: int, policy: SplitPolicy) -> DataFrame:
    """Candidates without an existing alert at or after (candidate - gap), as the trigger checks it."""
    latest = open_alerts.agg(F.max(F.unix_micros("triggered_at")).alias("latest"))
    keyed = with_row(points, latest)
    free = F.col("latest").isNull() | (F.col("latest") < F.col("at") - F.lit(gap))
    return keyed.filter(free).drop("latest")


def recent_open_alert(
    points: DataFrame, alert_log: DataFrame, alert_type: str = "HIGH_FRAUD_RATE", minutes: int = 15
) -> DataFrame:
    """Points (column ``timestamp``) for which an open alert of the type exists, not older than the window.

    EXISTS (open alert at or after t - window) is the same as "the latest open alert is", so one row
    decides for all points.
    """
    open_ = alert_log.filter(F.col("acknowledged_at").isNull() & (F.col("alert_type") == alert_type))
    latest = open_.agg(F.max("triggered_at").alias("_latest"))
    keyed = with_row(points, latest)
    hit = F.col("_latest") >= F.col("timestamp") - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return keyed.filter(hit).drop("_latest")


def publish_alerts(predictions: DataFrame) -> DataFrame:
    """The alert record of each prediction labelled fraud."""
    return predictions.filter("prediction_label").select(
        "transaction_id",
        F.lit("FRAUD_DETECTED").alias("alert_type"),
        severity("prediction_score").alias("severity"),
        "prediction_score",
        "timestamp",
    )


def rule_hold(
    ticks: DataFrame,
    condition: str,
    hold_seconds: int = 600,
    tick_seconds: int = 60,
    policy: SplitPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Evaluation ticks at which a condition has held for ``hold_seconds``.

    ticks: one row per evaluation time (``time``), a missing tick counts as "not true". The start of
    the current run is the last tick that was not true or did not follow its predecessor.
    """
    us = F.unix_micros("time")
    true_ticks = ticks.filter(F.col(condition)).select(us.alias("at"))
    with_last = running(true_ticks, [], "at", {"_prev": ("max", "at")}, policy=policy)
    starts = F.col("_prev").isNull() | (F.col("at") - F.col("_prev") > tick_seconds * 1_000_000)
    marked = with_last.withColumn("_start", F.when(starts, F.col("at")))
    run = running(marked, [], "at", {"_open": ("max", "_start")}, policy=policy)
    start = F.greatest(F.col("_open"), F.col("_start"))
    held = (F.col("at") - start) / 1_000_000
    return run.filter(held >= hold_seconds).select(
        F.timestamp_micros("at").alias("time"), held.cast("long").alias("held_seconds")
    )
