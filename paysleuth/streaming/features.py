"""Behaviour features on a stream: keyed state per user, equal to the batch features.

State of a user: the transactions of the last 7 days as (time, cents) arrays, where rows of one
instant are merged into one entry, the lifetime totals of what has left the arrays, and the first time of
each country and merchant. A micro-batch's times are merged in order with the user's before they are counted. One call
serves one user, so it works on plain arrays: pandas' own operations cost more than the counting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paysleuth.functions.scalars import cents, null_as_text
from paysleuth.schemas import PROFILE_FEATURES, WINDOW_FEATURES

_US = 1_000_000
_HOUR, _DAY, _WEEK = 3600 * _US, 86_400 * _US, 604_800 * _US
_END = 1 << 63  # later than any time

_WHOLE = {"tx_count_1h", "tx_count_24h", "tx_count_7d", "distinct_countries_seen", "distinct_merchants_seen"}
_FEATURE_FIELDS = [
    T.StructField(n, T.LongType() if n in _WHOLE else T.DoubleType()) for n in WINDOW_FEATURES + PROFILE_FEATURES
]
STATE = T.StructType(
    [
        T.StructField("at", T.ArrayType(T.LongType())),
        T.StructField("n", T.ArrayType(T.LongType())),
        T.StructField("cents", T.ArrayType(T.LongType())),
        T.StructField("old_n", T.LongType()),
        T.StructField("old_cents", T.LongType()),
        T.StructField("newest", T.LongType()),
        T.StructField("countries", T.ArrayType(T.StringType())),
        T.StructField("country_at", T.ArrayType(T.LongType())),
        T.StructField("merchants", T.ArrayType(T.StringType())),
        T.StructField("merchant_at", T.ArrayType(T.LongType())),
    ]
)


def _first_times(values: list, times: list, new_values: list, new_times: list) -> dict:
    first = dict(zip(values, times, strict=True))
    for value, at in zip(new_values, new_times, strict=True):
        if at < first.get(value, _END):
            first[value] = at
    return first


def _novelty(first: dict, values: list, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(was the value unseen strictly before the row, how many values were seen strictly before)."""
    unseen = np.array([first[v] for v in values], dtype="int64") >= at
    seen = np.searchsorted(np.sort(np.fromiter(first.values(), dtype="int64")), at, side="left")
    return unseen.astype("float64"), seen.astype("int64")


def _nullable(name: str, live: np.ndarray, values: np.ndarray | None):
    """A feature's column: the values in the rows that are ``live``, null in the others and for NaN."""
    whole = name in _WHOLE
    column = np.zeros(len(live), dtype="int64" if whole else "float64")
    if values is None:
        none = np.ones(len(live), dtype=bool)
    elif whole:
        column[live], none = values, ~live
    else:
        column[live] = values
        none = ~live | np.isnan(column)
    return (pd.arrays.IntegerArray if whole else pd.arrays.FloatingArray)(column, none)


def stream_features(
    stream: DataFrame,
    velocity: str = "per_hour",
    lateness_seconds: int = 3600,
    profile_ttl_ms: int | None = None,
    starting: bool = False,
) -> DataFrame:
    """One row out per row in: the transaction columns, 12 features, and ``late``.

    late: the row is older than the user's newest row by more than the allowed lateness. It gets no features and
        leaves the state as it is; route it to a side table.
    profile_ttl_ms: forget a user after this long without rows (never by default).
    starting: the stream carries a boolean column ``warm_start``; rows with it fill the state (replay
        of history before going live) and come out flagged, to be filtered away.
    """
    fields = [f for f in stream.schema.fields if f.name != "user_id"]
    keep = [f.name for f in fields]
    out = T.StructType([T.StructField("user_id", T.StringType()), *fields, *_FEATURE_FIELDS,
                        T.StructField("late", T.BooleanType())])
    per = 1.0 if velocity == "per_hour" else 60.0
    slack = lateness_seconds * _US

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(batches)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        at_row = rows["_us"].to_numpy()
        if state.exists:
            at0, n0, c0, old_n, old_c, newest, cs, cat, ms, mat = state.get
        else:
            at0, n0, c0, old_n, old_c, newest, cs, cat, ms, mat = [], [], [], 0, 0, None, [], [], [], []
        late = np.zeros(len(rows), dtype=bool)
        if newest is not None:
            late = at_row < newest - slack
        live = ~late
        values = dict.fromkeys(f.name for f in _FEATURE_FIELDS)
        if live.any():
            us = at_row[live].astype("int64")
            money = rows["_cents"].to_numpy()[live].astype("int64")
            # history and new rows, one entry per instant
            times = np.concatenate([np.asarray(at0, dtype="int64"), us])
            weights = np.concatenate([np.asarray(n0, dtype="int64"), np.ones(len(us), dtype="int64")])
            amounts = np.concatenate([np.asarray(c0, dtype="int64"), money])
            at, where = np.unique(times, return_inverse=True)
            n = np.zeros(len(at), dtype="int64")
            c = np.zeros(len(at), dtype="int64")
            np.add.at(n, where, weights)
            np.add.at(c, where, amounts)
            n_to = np.concatenate([[0], np.cumsum(n)])
            c_to = np.concatenate([[0], np.cumsum(c)])
            end = np.searchsorted(at, us, side="left")
            begin = {w: np.searchsorted(at, us - w, side="left") for w in (_HOUR, _DAY, _WEEK)}
            counts = {w: n_to[end] - n_to[b] for w, b in begin.items()}
            total_n = old_n + n_to[end]
            total_c = old_c + c_to[end]
            mean = np.divide(total_c / 100.0, total_n, out=np.zeros(len(us)), where=total_n > 0)
            ratio = np.divide(rows["amount"].to_numpy(dtype="float64")[live], mean, out=np.ones(len(us)), where=mean > 0)
            gap = (us - at[np.maximum(end - 1, 0)]) / 1e6
            # rows that have left the arrays are older than all windows; their time is only a lower bound
            countries, merchants = (rows[c].to_numpy()[live].tolist() for c in ("_country", "_merchant"))
            times = us.tolist()
            first_c = _first_times(cs, cat, countries, times)
            first_m = _first_times(ms, mat, merchants, times)
            new_c, seen_c = _novelty(first_c, countries, us)
            new_m, seen_m = _novelty(first_m, merchants, us)
            values = {
                "tx_count_1h": counts[_HOUR],
                "tx_count_24h": counts[_DAY],
                "tx_count_7d": counts[_WEEK],
                "amount_sum_1h": (c_to[end] - c_to[begin[_HOUR]]) / 100.0,
                "amount_sum_24h": (c_to[end] - c_to[begin[_DAY]]) / 100.0,
                "tx_velocity_1h": counts[_HOUR] / per,
                "seconds_since_last_tx": np.where(end > 0, gap, -1.0),
                "amount_ratio_vs_user_avg": ratio,
                "is_country_new": new_c,
                "distinct_countries_seen": seen_c,
                "is_merchant_new": new_m,
                "distinct_merchants_seen": seen_m,
            }
            newest = int(max(at[-1], newest if newest is not None else at[-1]))
            # the newest entry always stays: the next row needs its distance to it
            cut = min(int(np.searchsorted(at, newest - _WEEK - slack, side="left")), len(at) - 1)
            state.update(
                (
                    at[cut:].tolist(),
                    n[cut:].tolist(),
                    c[cut:].tolist(),
                    int(old_n + n_to[cut]),
                    int(old_c + c_to[cut]),
                    newest,
                    list(first_c),
                    list(first_c.values()),
                    list(first_m),
                    list(first_m.values()),
                )
            )
        if profile_ttl_ms is not None and state.exists:
            state.setTimeoutDuration(profile_ttl_ms)
        given = {c: rows[c].array for c in ("user_id", *keep)}
        yield pd.DataFrame(given | {n: _nullable(n, live, v) for n, v in values.items()} | {"late": late})

    prepared = stream.withColumns(
        {
            "user_id": null_as_text("user_id"),
            "_us": F.unix_micros("timestamp"),
            "_cents": cents("amount"),
            "_country": null_as_text("country"),
            "_merchant": null_as_text("merchant_id"),
        }
    )
    timeout = GroupStateTimeout.NoTimeout if profile_ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    features = prepared.groupBy("user_id").applyInPandasWithState(update, out, STATE, "append", timeout)
    return features.filter(~F.col("warm_start")).drop("warm_start") if starting else features


def late_rows(features: DataFrame) -> DataFrame:
    return features.filter("late")


def on_time(features: DataFrame) -> DataFrame:
    return features.filter(~F.col("late")).drop("late")
