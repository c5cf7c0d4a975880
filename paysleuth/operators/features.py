"""Per-user behaviour features without look-ahead, and the feature matrix.

A trailing window [t-w, t) is the difference of two prefix counts: rows before t, and rows before
t-w. The second is read off in the same pass by letting each row appear again at its time + w
("echo"), so the whole feature set is one running window per user and stays linear in the rows, where a sliding
RANGE frame would recompute each frame.

Users of one segment: one exchange on user_id; the echoes are made after it. A task gets about ``ROWS_A_TASK`` rows
however large the table is.
Users that are cut (above ``rows_per_segment`` rows, found by a count, ``max_segments`` at most): their points are combined per
(user, time), cut into time segments and scanned by ``plans.ordered.running``; the results join back to the rows. A user above
``rows_per_segment`` who would get a single segment, as there are too many such users, is one window in one task either way;
without the tables and joins between them that costs one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysleuth.functions.scalars import cents, null_as_text, ts
from paysleuth.plans.ordered import DEFAULT_POLICY, SplitPolicy, hot_groups, running, to_cut
from paysleuth.plans.sizing import as_lookup
from paysleuth.schemas import (
    FEATURES,
    MODEL_INPUT,
    PROFILE_FEATURES,
    REQUEST_FEATURES,
    REQUIRED_COLUMNS,
    WINDOW_FEATURES,
)
from paysleuth.session import materialized

HOUR_US = 3_600_000_000
# optional column: how many transactions a row stands for (its amount is then their sum)
WEIGHT = "tx_weight"
# of whole users in one task of the scan; each stands for four points
ROWS_A_TASK = 100_000
WINDOWS_US = {"1h": HOUR_US, "24h": 24 * HOUR_US, "7d": 168 * HOUR_US}


def require_columns(df: DataFrame, needed: set[str] = REQUIRED_COLUMNS) -> None:
    missing = sorted(needed - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def direct_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "log_amount": F.log1p("amount"),
            "hour_of_day": F.hour("timestamp"),
            "day_of_week": F.weekday("timestamp"),
        }
    )


def log_amount_clip(df: DataFrame) -> DataFrame:
    return df.withColumn("log_amount", F.ln(F.greatest(F.col("amount"), F.lit(1e-9))))


def cyclic_time(df: DataFrame) -> DataFrame:
    import math

    hour = F.hour("timestamp") * F.lit(2 * math.pi / 24)
    dow = F.weekday("timestamp") * F.lit(2 * math.pi / 7)
    return df.withColumns(
        {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "dow_sin": F.sin(dow), "dow_cos": F.cos(dow)}
    )


def _prepared(df: DataFrame) -> DataFrame:
    weight = F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1)
    return df.withColumns(
        {
            "_w": weight.cast("long"),
            "user_id": null_as_text("user_id"),
            "_us": F.unix_micros(F.col("timestamp").cast("timestamp")),
            "_cents": cents("amount"),
            "_country": null_as_text("country"),
            "_merchant": null_as_text("merchant_id"),
        }
    )


def _echo(at: Column) -> Column:
    """Array of (kind, time): the row itself and its three echoes."""
    points = [F.struct(F.lit(0).alias("kind"), at.alias("at"))]
    for i, width in enumerate(WINDOWS_US.values(), start=1):
        points.append(F.struct(F.lit(i).alias("kind"), (at + F.lit(width)).alias("at")))
    return F.array(*points)


def _of_kind(kind: int, value: Column) -> Column:
    return F.when(F.col("_kind") == kind, value)


# output of the scan -> (aggregate, per-point column)
_SCAN = {
    "_n": ("sum", "_p_n"),
    "_n1h": ("sum", "_p_n1h"),
    "_n24h": ("sum", "_p_n24h"),
    "_n7d": ("sum", "_p_n7d"),
    "_c": ("sum", "_p_c"),
    "_c1h": ("sum", "_p_c1h"),
    "_c24h": ("sum", "_p_c24h"),
    "_last": ("max", "_p_last"),
    "_dc": ("sum", "_p_dc"),
    "_dm": ("sum", "_p_dm"),
}


def _point_columns(count: Column, money: Column, new_country: Column, new_merchant: Column) -> dict[str, Column]:
    own_time = F.col("_at")
    return {
        "_p_n": _of_kind(0, count),
        "_p_n1h": _of_kind(1, count),
        "_p_n24h": _of_kind(2, count),
        "_p_n7d": _of_kind(3, count),
        "_p_c": _of_kind(0, money),
        "_p_c1h": _of_kind(1, money),
        "_p_c24h": _of_kind(2, money),
        "_p_last": _of_kind(0, own_time),
        "_p_dc": _of_kind(0, new_country),
        "_p_dm": _of_kind(0, new_merchant),
    }


def _by_user(rows: DataFrame, total: int) -> DataFrame:
    """Whole users dealt to tasks. The number of tasks is given where Spark, going by bytes, would make larger ones."""
    tasks = math.ceil(total / ROWS_A_TASK)
    if tasks <= rows.sparkSession.sparkContext.defaultParallelism:
        return rows.repartition("user_id")
    return rows.repartition(tasks, "user_id")


def _light_users(rows: DataFrame, ties: str, total: int) -> DataFrame:
    """Scan of users that fit one task: a single exchange, everything else happens inside it. total: rows of the table."""
    one = F.lit(1).cast("long")
    spread = _by_user(rows, total)
    payload = [c for c in rows.columns if c != "user_id"]
    for value, is_new, first in (("_country", "_new_c", "_first_c"), ("_merchant", "_new_m", "_first_m")):
        seen = Window.partitionBy("user_id", value).orderBy("_us", "transaction_id")
        nth = F.row_number().over(seen)
        spread = spread.withColumn(first, F.when(nth == 1, one))
        if ties == "strict":
            earliest = F.min("_us").over(seen.rowsBetween(Window.unboundedPreceding, 0))
            spread = spread.withColumn(is_new, F.col("_us") == earliest)
        else:
            spread = spread.withColumn(is_new, F.col(first).isNotNull())
    payload += ["_new_c", "_new_m"]
    points = spread.select(
        "user_id",
        F.struct(*payload).alias("_row"),
        "_w",
        "_cents",
        "_first_c",
        "_first_m",
        F.explode(_echo(F.col("_us"))).alias("_e"),
    ).select(
        "user_id",
        F.col("_e.kind").alias("_kind"),
        F.col("_e.at").alias("_at"),
        # echoes carry no payload through the sort
        F.when(F.col("_e.kind") == 0, F.col("_row")).alias("_row"),
        "_w",
        "_cents",
        "_first_c",
        "_first_m",
    )
    points = points.withColumns(_point_columns(F.col("_w"), F.col("_cents"), F.col("_first_c"), F.col("_first_m")))
    by_user = Window.partitionBy("user_id")
    if ties == "strict":
        before = by_user.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    else:
        before = by_user.orderBy("_at", "_kind", "_row.transaction_id").rowsBetween(Window.unboundedPreceding, -1)
    scanned = points.withColumns({out: getattr(F, fn)(c).over(before) for out, (fn, c) in _SCAN.items()})
    return scanned.filter(F.col("_kind") == 0).select("user_id", "_row.*", *_SCAN)


def _heavy_users(rows: DataFrame, ties: str, policy: SplitPolicy, hot: list[tuple]) -> DataFrame:
    """Scan of users too large for one task: time segments instead of one window per user.

    hot: the users to cut and their points, four for each row.
    """
    one = F.lit(1).cast("long")
    when = F.struct("_us", "transaction_id")
    first_c = rows.groupBy("user_id", "_country").agg(F.min(when).alias("_fc"))
    first_m = rows.groupBy("user_id", "_merchant").agg(F.min(when).alias("_fm"))
    flagged = rows.join(first_c, ["user_id", "_country"]).join(first_m, ["user_id", "_merchant"])
    if ties == "strict":
        flagged = flagged.withColumn("_new_c", F.col("_us") == F.col("_fc._us"))
        flagged = flagged.withColumn("_new_m", F.col("_us") == F.col("_fm._us")).drop("_fc", "_fm")
        # all rows of a user at one time share their history, so the scan needs one point for them
        points = rows.groupBy("user_id", "_us").agg(F.sum("_w").alias("_cnt"), F.sum("_cents").alias("_sum"))
        points = points.select("user_id", "_cnt", "_sum", F.explode(_echo(F.col("_us"))).alias("_e"))
        points = points.select("user_id", F.col("_e.kind").alias("_kind"), F.col("_e.at").alias("_at"), "_cnt", "_sum")
        none = F.lit(None).cast("long")
        points = points.withColumns({"_nc": none, "_nm": none})
        for table, first, column in ((first_c, "_fc", "_nc"), (first_m, "_fm", "_nm")):
            seen = table.groupBy("user_id", F.col(first)["_us"].alias("_at")).agg(F.count(F.lit(1)).alias(column))
            points = points.unionByName(seen.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
        points = points.withColumns(
            _point_columns(F.col("_cnt"), F.col("_sum"), F.col("_nc"), F.col("_nm"))
        )
        merged = points.groupBy("user_id", "_at").agg(
            *[getattr(F, fn)(c).alias(c) for fn, c in _SCAN.values()],
        )
        scanned = running(merged, ["user_id"], "_at", _SCAN, policy=policy, hot=hot)
        scanned = scanned.filter(F.col("_p_n").isNotNull())
        history = scanned.select("user_id", F.col("_at").alias("_us"), *_SCAN)
        # a single (user, time) may hold very many rows: AQE splits the skewed side of this join
        return flagged.join(history, ["user_id", "_us"])
    flagged = flagged.withColumns(
        {
            "_new_c": F.col("_fc") == when,
            "_new_m": F.col("_fm") == when,
        }
    ).drop("_fc", "_fm")
    payload = [c for c in flagged.columns if c != "user_id"]
    points = flagged.select(
        "user_id", F.struct(*payload).alias("_row"), F.explode(_echo(F.col("_us"))).alias("_e")
    ).select(
        "user_id",
        F.col("_e.kind").alias("_kind"),
        F.col("_e.at").alias("_at"),
        F.struct(
            F.col("_e.at").alias("at"), F.col("_e.kind").alias("kind"), F.col("_row.transaction_id").alias("id")
        ).alias("_key"),
        F.when(F.col("_e.kind") == 0, F.col("_row")).alias("_row"),
        F.col("_row._w").alias("_w"),
        F.col("_row._cents").alias("_cents"),
        F.when(F.col("_row._new_c"), one).alias("_first_c"),
        F.when(F.col("_row._new_m"), one).alias("_first_m"),
    )
    points = points.withColumns(_point_columns(F.col("_w"), F.col("_cents"), F.col("_first_c"), F.col("_first_m")))
    scanned = running(points, ["user_id"], "_key", _SCAN, policy=policy, hot=hot)
    return scanned.filter(F.col("_kind") == 0).select("user_id", "_row.*", *_SCAN)


def _scan_arrays(user: np.ndarray, us: np.ndarray, weight: np.ndarray, money: np.ndarray, values: dict[str, np.ndarray]):
    """The outputs of the scan for rows of whole users, strict ties: {output: (values, which are null)}.

    user: ascending numbers from 0, us ascending within a user; money: cents, 0 for null; values: codes of country (c)
    and merchant (m).
    """
    times, rank = np.unique(us, return_inverse=True)
    span = len(times) + 1
    place = user * span + rank
    before = np.searchsorted(place, place)  # the first row of the same user and time
    start = np.searchsorted(user, user)
    total = lambda x: np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(x, dtype=np.int64)])
    counts, sums = total(weight), total(money)
    none = before == start
    outs = {"_n": (counts[before] - counts[start], none), "_c": (sums[before] - sums[start], none)}
    for name, width in WINDOWS_US.items():
        left = np.searchsorted(place, user * span + np.searchsorted(times, us - width))
        outs[f"_n{name}"] = (counts[left] - counts[start], none)
        if f"_c{name}" in _SCAN:
            outs[f"_c{name}"] = (sums[left] - sums[start], none)
    outs["_last"] = (us[np.maximum(before - 1, 0)], none)
    for x, codes in values.items():
        _, first, which = np.unique(user * (int(codes.max(initial=0)) + 1) + codes, return_index=True, return_inverse=True)
        seen = np.zeros(len(us), dtype=np.int64)
        seen[first] = 1
        seen = total(seen)
        outs[f"_d{x}"] = (seen[before] - seen[start], none)
        outs[f"_new_{x}"] = (us == us[first[which]], np.zeros(len(us), dtype=bool))
    return outs


def _whole_users(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in which users stand together, as tables of whole users."""
    kept: list[pa.RecordBatch] = []
    for batch in tables:
        if not batch.num_rows:
            continue
        user = batch.column("user_id")
        same = pc.equal(user, user[-1]).to_numpy(zero_copy_only=False)
        cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        if kept and (cut or kept[-1].column("user_id")[-1] != user[0]):
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)] if cut else kept)
            kept = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def features_since(
    rows: DataFrame, batch_id: int, reach: dict[int, tuple[int, int]], columns: list[str], total: int, velocity: str
) -> DataFrame:
    """``behaviour_features`` of the rows that a micro-batch says something new about, users small enough for a task.

    rows: columns, tx_weight, bucket, batch, _old (a row of a profile); reach: until when and up to which batch a
    bucket's profile goes. Of each user with rows of the batch: rows from the first of these on. Earlier ones count as
    history: the profile and the rows it does not hold, or all rows and no profile, where the windows reach into it.
    total: rows of the table.
    """
    window = WINDOWS_US["7d"]
    known = np.array(sorted(reach), dtype=np.int64)
    until, upto = (np.array([reach[b][i] for b in sorted(reach)], dtype=np.int64) for i in (0, 1))
    prepared = _prepared(rows)
    kinds = {"_new_c": "boolean", "_new_m": "boolean"}
    outs = [*_SCAN, *kinds]
    schema = T.StructType([prepared.schema[c] for c in (*columns, "_us")])
    for c in outs:
        schema.add(c, kinds.get(c, "long"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda t, c: t.column(c).to_numpy()
        coded = lambda t, c: plain(pa.table({c: t.column(c).combine_chunks().dictionary_encode().indices}), c)
        for t in _whole_users(batches):
            name, us, batch, old = coded(t, "user_id").astype(np.int64), plain(t, "_us"), plain(t, "batch"), plain(t, "_old")
            first = np.full(int(name.max()) + 1, np.iinfo(np.int64).max)
            own = ~old & (batch == batch_id)
            np.minimum.at(first, name[own], us[own])
            first = first[name]
            at = np.searchsorted(known, plain(t, "bucket"))
            deep = first - window < until[at]
            held = np.where(old, ~deep, deep | (us >= until[at]) | (batch > upto[at])) & (first < np.iinfo(np.int64).max)
            order = np.flatnonzero(held)
            order = order[np.lexsort((us[order], name[order]))]
            if not len(order):
                continue
            money = t.column("_cents").fill_null(0).to_numpy()
            values = {x: coded(t, c).astype(np.int64)[order] for x, c in (("c", "_country"), ("m", "_merchant"))}
            found = _scan_arrays(name[order], us[order], plain(t, "_w")[order], money[order], values)
            said = np.flatnonzero((us >= first)[order] & ~old[order])
            picked = t.select([*columns, "_us"]).take(pa.array(order[said]))
            for c in outs:
                value, null = found[c]
                picked = picked.append_column(c, pa.array(value[said], mask=null[said]))
            yield from picked.to_batches(max_chunksize=10_000)

    needed = ["_us", "_w", "_cents", "_country", "_merchant", "bucket", "batch", "_old"]
    spread = _by_user(prepared.select(*columns, *needed), total)
    # whole users together; hashes compare faster than names that begin alike
    together = spread.sortWithinPartitions(F.xxhash64("user_id"), "user_id")
    return _described(together.mapInArrow(scan, schema), velocity, columns)


def _described(scanned: DataFrame, velocity: str, columns: list[str]) -> DataFrame:
    """The columns and the features that the outputs of the scan give."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    n1h = count("_n") - count("_n1h")
    mean = F.col("_c") / 100.0 / F.col("_n")
    per = 1.0 if velocity == "per_hour" else 60.0
    outs = {
        "tx_count_1h": n1h,
        "tx_count_24h": count("_n") - count("_n24h"),
        "tx_count_7d": count("_n") - count("_n7d"),
        "amount_sum_1h": (count("_c") - count("_c1h")) / 100.0,
        "amount_sum_24h": (count("_c") - count("_c24h")) / 100.0,
        "tx_velocity_1h": n1h / F.lit(per),
        "seconds_since_last_tx": F.coalesce((F.col("_us") - F.col("_last")) / 1e6, F.lit(-1.0)),
        "amount_ratio_vs_user_avg": F.when(mean > 0, F.col("amount").cast("double") / mean).otherwise(F.lit(1.0)),
        "is_country_new": F.col("_new_c").cast("double"),
        "distinct_countries_seen": count("_dc"),
        "is_merchant_new": F.col("_new_m").cast("double"),
        "distinct_merchants_seen": count("_dm"),
    }
    return scanned.withColumns(outs).select(*columns, *outs)


def behaviour_features(
    df: DataFrame,
    velocity: str = "per_hour",
    ties: str = "strict",
    policy: SplitPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Append the 7 window and 5 profile features to each transaction.

    velocity: "per_hour" is the 1-hour count, "per_minute" divides it by 60.
    ties: "strict" counts rows of strictly earlier time; "arrival" also counts rows of the same
        time with a smaller transaction_id (ids must then be unique per user and time).
    """
    if velocity not in ("per_hour", "per_minute"):
        raise ValueError("velocity must be per_hour or per_minute")
    if ties not in ("strict", "arrival"):
        raise ValueError("ties must be strict or arrival")
    require_columns(df, {"transaction_id", "user_id", "merchant_id", "amount", "country", "timestamp"})
    rows = _prepared(df)
    counted = Observation()  # in the job that counts the users' rows
    sizes = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("_us").isNull()).alias("untimed")]
    hot = hot_groups(rows.select("user_id", "_us").observe(counted, *sizes), ["user_id"], policy)
    total = counted.get["n"]
    cut = [] if hot is None else to_cut(hot, policy, len(WINDOWS_US) + 1)
    untimed = hot is not None and ties == "strict" and counted.get["untimed"] > 0
    if cut or untimed:
        names = df.sparkSession.createDataFrame([(r[0],) for r in cut], "user_id string")
        if untimed:  # a point needs a time: rows without one are left out, for all large users alike
            some = rows.filter(F.col("_us").isNull()).select("user_id")
            names = names.unionByName(hot.select("user_id").join(some, "user_id", "left_semi")).distinct()
        names = as_lookup(names)
        light = rows.join(names, "user_id", "left_anti")
        heavy = materialized(rows.join(names, "user_id", "left_semi"), "heavy-users")  # read several times
        scanned = _light_users(light, ties, total).unionByName(_heavy_users(heavy, ties, policy, cut))
    else:
        scanned = _light_users(rows, ties, total)

    return _described(scanned, velocity, df.columns)


def compress_history(df: DataFrame) -> DataFrame:
    """Old transactions as one weighted row per (user, country, merchant).

    For rows more than 7 days younger than all of these, the compressed rows give the same lifetime
    features as the transactions themselves: same totals, same countries, same merchants.
    """
    weight = F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1)
    grouped = df.groupBy("user_id", "country", "merchant_id").agg(
        F.max("timestamp").alias("timestamp"),
        (F.sum(cents("amount")) / 100).cast("decimal(20,2)").cast("double").alias("amount"),
        F.sum(weight.cast("long")).alias(WEIGHT),
    )
    ident = F.concat(F.lit("history-"), F.sha2(F.to_json(F.struct("user_id", "country", "merchant_id")), 256))
    return grouped.withColumn("transaction_id", ident)


def featurize(
    df: DataFrame,
    encoders,
    velocity: str = "per_hour",
    ties: str = "strict",
    keep: tuple[str, ...] = ("transaction_id", "user_id", "timestamp", "is_fraud"),
    policy: SplitPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """The feature matrix: one row per transaction, the 18 features after the ``keep`` columns."""
    require_columns(df)
    full = encoders.transform(direct_features(behaviour_features(df, velocity, ties, policy)))
    return full.select(*keep, *FEATURES)


def select_columns(df: DataFrame, selected: list[str], keep: tuple[str, ...] = ("transaction_id",)) -> DataFrame:
    return df.select(*keep, *selected)


def user_profile(df: DataFrame) -> DataFrame:
    """Lifetime totals and the sorted countries and merchants of each user.

    Values are made distinct before they are gathered, so a busy user costs one row per distinct
    value and not one per transaction.
    """
    rows = df.select("user_id", cents("amount").alias("c"), null_as_text("country").alias("country"), "merchant_id")
    totals = rows.groupBy("user_id").agg(
        (F.sum("c") / 100.0).alias("amount_total"), F.count(F.lit(1)).alias("amount_count")
    )
    for column, out in (("country", "countries_seen"), ("merchant_id", "merchants_seen")):
        values = rows.select("user_id", column).distinct()
        sets = values.groupBy("user_id").agg(F.array_sort(F.collect_list(column)).alias(out))
        totals = totals.join(sets, "user_id", "left")
    return totals


def user_window(df: DataFrame, as_of, days: int = 7, newest: int = 500) -> DataFrame:
    """The rows kept as a user's recent state at ``as_of``: at most ``days`` old, the newest 500.

    500 is the retention rule of the state. Spark drops the surplus before the shuffle
    (window group limit), so a busy user sends at most 500 rows per map task.
    """
    end = ts(as_of)
    recent = df.filter((F.col("timestamp") >= end - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("timestamp") <= end))
    newest_first = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("transaction_id"))
    ranked = recent.withColumn("_rank", F.row_number().over(newest_first))
    return ranked.filter(F.col("_rank") <= newest).drop("_rank")


def hydrate_filter(df: DataFrame, as_of, seconds: int = 604_800) -> DataFrame:
    """Rows in [as_of - seconds, as_of], in time order."""
    end = ts(as_of)
    start = end - F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return df.filter((F.col("timestamp") >= start) & (F.col("timestamp") <= end)).orderBy(
        "timestamp", "transaction_id"
    )


def feature_map(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Raw event plus a ``map<string,double>`` of its behaviour features."""
    names = names or WINDOW_FEATURES + PROFILE_FEATURES
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    raw = [c for c in df.columns if c not in names]
    return df.select(*raw, F.create_map(*pairs).alias("features"))


def request_vector(df: DataFrame, encoders) -> DataFrame:
    """The 16 model inputs of a scoring request: direct features, codes, and values from ``features``."""
    coded = encoders.transform(direct_features(df))
    given = {n: F.col("features")[n] for n in REQUEST_FEATURES}
    return coded.select("transaction_id", *[given[c].alias(c) if c in given else F.col(c) for c in MODEL_INPUT])
