"""Running aggregates in key order that stay parallel when one group, or the whole table, is huge.

``running`` is a window ``sum/max/min ... ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING``.
A plain window puts each group into one task. Here a group larger than ``rows_per_segment`` is cut
into key ranges ("segments"); the window runs inside each segment and the totals of the earlier
segments are added from a table of at most a few thousand rows.

Every decision (which groups are large, where the cuts lie) is a literal of the final plan, so a
task that is run again after the loss of an executor sees the same segments.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysleuth.plans.sizing import small_table
from paysleuth.session import materialized

SEG = "_seg"
_FANOUT = 64
_DAY_US = 86_400_000_000


@dataclass(frozen=True)
class SplitPolicy:
    """When to cut a group.

    rows_per_segment: groups above this many rows are cut.
    max_segments: about how many segments the cut groups get in all; if their rows are more than
        ``max_segments`` times ``rows_per_segment``, the segments become larger, and groups of one segment stay whole.
    """

    rows_per_segment: int = 1_000_000
    max_segments: int = 65_536


DEFAULT_POLICY = SplitPolicy()


def hot_groups(df: DataFrame, by: list[str], policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame | None:
    """The groups above ``rows_per_segment`` with their rows ``_n``, or None if there are none.

    Up to ``max_segments`` of them are a local table; more are written down and stay distributed. The count combines
    on the map side, so a hot key costs one row per map task.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > policy.rows_per_segment)
    local = small_table(counts, policy.max_segments)
    if local is None:
        return materialized(counts, "hot-groups")
    return None if local.isEmpty() else local


def to_cut(hot: DataFrame, policy: SplitPolicy = DEFAULT_POLICY, points: int = 1) -> list[tuple]:
    """Those of the hot groups that get more than one segment, largest first, as (key..., rows): ``max_segments`` at most.

    The segments are as small as ``max_segments`` of them allow, for the groups that are cut: with very many hot groups the
    largest ones are still cut. points: how many rows of the table to cut stand for one counted row.
    """
    sized = hot.withColumn("_n", F.col("_n") * F.lit(points))
    total = sized.agg(F.sum("_n")).first()[0] or 0
    size = max(policy.rows_per_segment, math.ceil(total / policy.max_segments))
    # a group that is cut has two segments at least
    largest = sized.orderBy(F.desc("_n")).limit(policy.max_segments // 2 + 1).collect()
    size = min(size, _least_size([r["_n"] for r in largest], policy))
    return sorted(map(tuple, sized.filter(F.col("_n") > size).collect()), key=lambda r: -r[-1])


def _least_size(counts: list[int], policy: SplitPolicy) -> int:
    """The smallest size of a segment at which the groups above it have ``max_segments`` segments at most."""
    low, high = policy.rows_per_segment, max(counts, default=policy.rows_per_segment)
    while low < high:
        size = (low + high) // 2
        if sum(math.ceil(n / size) for n in counts if n > size) <= policy.max_segments:
            high = size
        else:
            low = size + 1
    return low


def large_groups(df: DataFrame, by: list[str], policy: SplitPolicy = DEFAULT_POLICY) -> list[tuple]:
    """The groups to cut, largest first, as (key..., rows): ``max_segments`` at most."""
    hot = hot_groups(df, by, policy)
    return [] if hot is None else to_cut(hot, policy)


def _cuts(sample: list, parts: int) -> list:
    ordered = sorted(filter(_known, sample))
    picks = [ordered[len(ordered) * i // parts] for i in range(1, parts)] if ordered else []
    return [k for k, _ in groupby(picks)]


def _known(value) -> bool:
    """A key that can be a cut; rows of any other, which come first, are in the first segment."""
    return value is not None and not (isinstance(value, tuple) and any(v is None for v in value))


def _chunks(cuts: list) -> list[list]:
    return [cuts[i : i + _FANOUT] for i in range(0, len(cuts), _FANOUT)]


def _segment_of(key: Column, chunks: Column) -> Column:
    """Number of cuts at or below ``key``: first the chunk by its head, then the place inside it."""
    chunk = F.size(F.filter(chunks, lambda c: c[0] <= key))
    inside = F.size(F.filter(F.get(chunks, chunk - 1), lambda c: c <= key))
    return F.when(chunk > 0, (chunk - 1) * F.lit(_FANOUT) + inside).otherwise(F.lit(0))


def _key_literal(value, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        parts = [_key_literal(v, f.dataType).alias(f.name) for v, f in zip(value, dtype.fields, strict=True)]
        return F.struct(*parts)
    return F.lit(value).cast(dtype)


def _plain(value):
    """Rows (struct keys) compare as tuples."""
    return tuple(value) if isinstance(value, tuple) else value


def with_segments(
    df: DataFrame,
    by: list[str],
    order: str,
    policy: SplitPolicy = DEFAULT_POLICY,
    hot: list[tuple] | None = None,
    total: int | None = None,
) -> tuple[DataFrame, bool]:
    """Add the segment number ``_seg``; the flag tells whether any group was cut.

    total: the rows of the table, if the caller has counted them already.

    Cut points come from a hash sample of the keys, which only balances the segments: the result
    does not depend on where they lie.
    """
    spark = df.sparkSession
    dtype = df.schema[order].dataType
    if not by:
        total = df.count() if total is None else total
        parts = min(math.ceil(total / policy.rows_per_segment), policy.max_segments)
        if parts <= 1:
            return df.withColumn(SEG, F.lit(0)), False
        every = max(1, total // (20 * parts))
        picked = df.filter(F.pmod(F.xxhash64(order), F.lit(every)) == 0).select(order)  # about 20 a segment
        cuts = _cuts([_plain(r[0]) for r in picked.collect()], parts)
        if not cuts:
            return df.withColumn(SEG, F.lit(0)), False
        chunks = F.array(*[F.array(*[_key_literal(c, dtype) for c in chunk]) for chunk in _chunks(cuts)])
        return df.withColumn(SEG, _segment_of(F.col(order), chunks)), True

    if hot is None:
        hot = large_groups(df, by, policy)
    if not hot:
        return df.withColumn(SEG, F.lit(0)), False
    # hot groups are at most max_segments; raise the segment size until their parts are as well
    hot_rows = sum(h[-1] for h in hot)
    size = max(policy.rows_per_segment, math.ceil(hot_rows / policy.max_segments))
    key_fields = [df.schema[b] for b in by]
    parts = {tuple(h[:-1]): math.ceil(h[-1] / size) for h in hot}
    hot_df = spark.createDataFrame(list(parts), T.StructType(key_fields))
    every = max(1, hot_rows // (20 * sum(parts.values())))
    picked = (
        df.join(F.broadcast(hot_df), by, "left_semi")
        .filter(F.pmod(F.xxhash64(*by, order), F.lit(every)) == 0)
        .select(*by, order)  # about 20 a segment
        .collect()
    )
    samples: dict[tuple, list] = {}
    for row in picked:
        samples.setdefault(tuple(row[: len(by)]), []).append(_plain(row[len(by)]))
    table = [(*k, _chunks(_cuts(samples.get(k, []), p))) for k, p in parts.items()]
    cuts_schema = T.StructType([*key_fields, T.StructField("_cuts", T.ArrayType(T.ArrayType(dtype)))])
    cuts_df = spark.createDataFrame(table, cuts_schema)
    joined = df.join(F.broadcast(cuts_df), by, "left")
    seg = F.coalesce(F.when(F.col("_cuts").isNotNull(), _segment_of(F.col(order), F.col("_cuts"))), F.lit(0))
    return joined.withColumn(SEG, seg).drop("_cuts"), True


_MERGE = {
    "sum": lambda a, b: b if a is None else (a if b is None else a + b),
    "max": lambda a, b: b if a is None else (a if b is None else max(a, b)),
    "min": lambda a, b: b if a is None else (a if b is None else min(a, b)),
}
_COMBINE = {
    "sum": lambda local, before: F.when(local.isNull(), before).when(before.isNull(), local).otherwise(local + before),
    "max": F.greatest,
    "min": F.least,
}


def running(
    df: DataFrame,
    by: list[str],
    order: str,
    aggs: dict[str, tuple[str, str]],
    *,
    policy: SplitPolicy = DEFAULT_POLICY,
    hot: list[tuple] | None = None,
) -> DataFrame:
    """For each row, aggregates over the rows of its group with a smaller ``order`` key (NULL if none).

    The key must be unique within a group (combine rows of equal key first); any orderable type.
    aggs: {output: ("sum" | "max" | "min", input column)}.
    hot: the groups to cut as (key..., rows), if the caller has counted them already.

    The rows are counted first. Only when a group is cut, the input is written down once: the cut points, the totals
    and the result all read it.
    """
    spark = df.sparkSession
    total = None
    if by:
        hot = large_groups(df, by, policy) if hot is None else hot
    else:
        total = df.count()
    if hot or (total or 0) > policy.rows_per_segment:
        df = materialized(df, "running")
    cut, split = with_segments(df, by, order, policy, hot, total)
    window = Window.partitionBy(*by, SEG).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = {out: getattr(F, fn)(col).over(window) for out, (fn, col) in aggs.items()}
    if not split:
        return cut.withColumns(local).drop(SEG)

    totals = cut
    if by:
        hot_df = spark.createDataFrame([tuple(h[:-1]) for h in hot], T.StructType([df.schema[b] for b in by]))
        totals = totals.join(F.broadcast(hot_df), by, "left_semi")
    totals = totals.groupBy(*by, SEG).agg(*[getattr(F, fn)(col).alias(out) for out, (fn, col) in aggs.items()])
    # one row per segment: bounded by the number of segments, not by the data
    rows = sorted(totals.collect(), key=lambda r: (*[str(r[b]) for b in by], r[SEG]))
    offsets = []
    for key, group in groupby(rows, key=lambda r: tuple(r[b] for b in by)):
        acc: dict[str, object] = dict.fromkeys(aggs)
        for r in group:
            offsets.append((*key, r[SEG], *acc.values()))
            acc = {out: _MERGE[fn](acc[out], r[out]) for out, (fn, _) in aggs.items()}
    fields = [totals.schema[b] for b in by] + [T.StructField(SEG, T.IntegerType())]
    fields += [T.StructField("_before_" + out, totals.schema[out].dataType) for out in aggs]
    offsets_df = spark.createDataFrame(offsets, T.StructType(fields))
    merged = cut.withColumns(local).join(F.broadcast(offsets_df), [*by, SEG], "left")
    combined = {
        out: _COMBINE[fn](F.col(out), F.col("_before_" + out)) for out, (fn, _) in aggs.items()
    }
    return merged.withColumns(combined).drop(SEG, *["_before_" + out for out in aggs])


def global_index(df: DataFrame, order: list[str], out: str = "row_index", policy: SplitPolicy = DEFAULT_POLICY):
    """0-based position of each row in the order of unique ``order`` columns, without one global task."""
    keyed = df.withColumn("_order_key", F.struct(*order)).withColumn("_unit", F.lit(1).cast("long"))
    numbered = running(keyed, [], "_order_key", {out: ("sum", "_unit")}, policy=policy)
    return numbered.withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long"))).drop("_order_key", "_unit")


def hashed_index(
    df: DataFrame, hashed: str, order: list[str], out: str, total: int, policy: SplitPolicy = DEFAULT_POLICY
) -> DataFrame:
    """``global_index`` in the order of (``hashed``, ``order``) for a column of 64-bit hashes.

    Hashes lie evenly, so even ranges of them are the segments: no cut is looked for, and only the hashes are read
    before the rows are numbered. total: the rows of the table.
    """
    parts = max(1, min(math.ceil(total / policy.rows_per_segment), policy.max_segments))
    place = F.floor((F.col(hashed).cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(parts))
    cut = df.withColumn(SEG, F.least(place, F.lit(parts - 1)).cast("int"))
    counts = sorted(map(tuple, cut.groupBy(SEG).agg(F.count(F.lit(1)).alias("n")).collect())) if parts > 1 else [(0, total)]
    before, offsets = 0, []
    for seg, n in counts:
        offsets.append((seg, before))
        before += n
    offsets_df = df.sparkSession.createDataFrame(offsets, T.StructType([T.StructField(SEG, T.IntegerType()), T.StructField("_before", T.LongType())]))
    nth = F.row_number().over(Window.partitionBy(SEG).orderBy(hashed, *order))
    placed = cut.withColumn(out, nth.cast("long")).join(F.broadcast(offsets_df), SEG)
    return placed.withColumn(out, F.col(out) + F.col("_before") - 1).drop(SEG, "_before")


def keys_at_ranks(df: DataFrame, order: list[str], ranks: list[int], policy: SplitPolicy = DEFAULT_POLICY) -> list:
    """The ``order`` keys of the rows at the given 0-based positions (None past the end).

    Only the days that hold a wanted position are numbered; the rest of the table is just counted.
    """
    day = F.floor(F.unix_micros(F.col(order[0])) / F.lit(_DAY_US)).cast("long")
    days = df.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("n")).collect()
    if any(d["_day"] is None for d in days):
        raise ValueError(f"rows without {order[0]} have no place in the order")
    found: dict[int, object] = dict.fromkeys(ranks)
    start, wanted = 0, {}  # day -> its first position
    sizes = {d["_day"]: d["n"] for d in days}
    for number in sorted(sizes):
        if any(start <= r < start + sizes[number] for r in ranks):
            wanted[number] = start
        start += sizes[number]
    if not wanted:
        return [None] * len(ranks)
    inside, hit = F.lit(False), F.lit(False)
    for number, base in wanted.items():
        begin, end = (F.timestamp_micros(F.lit(d * _DAY_US)) for d in (number, number + 1))
        inside = inside | ((F.col(order[0]) >= begin) & (F.col(order[0]) < end))
        places = [r - base for r in ranks if base <= r < base + sizes[number]]
        hit = hit | ((F.col("_day") == number) & F.col("_pos").isin(places))
    some = df.filter(inside).select(F.struct(*order).alias("_key"), day.alias("_day"), F.lit(1).cast("long").alias("_unit"))
    hot = [(d, sizes[d]) for d in wanted if sizes[d] > policy.rows_per_segment]
    numbered = running(some, ["_day"], "_key", {"_pos": ("sum", "_unit")}, policy=policy, hot=hot)
    numbered = numbered.withColumn("_pos", F.coalesce(F.col("_pos"), F.lit(0).cast("long")))
    for h in numbered.filter(hit).collect():
        found[h["_pos"] + wanted[h["_day"]]] = tuple(h["_key"])
    return [found[r] for r in ranks]


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, points: dict[str, float], policy: SplitPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Linear-interpolated quantiles per group, exact, from counts per distinct value.

    The values are combined before the shuffle and the positions come from ``running``, so neither a
    large group nor a frequent value ends up in one task's memory.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    before = running(counts, by, value, {"_before": ("sum", "_n")}, policy=policy)
    before = before.withColumn("_before", F.coalesce("_before", F.lit(0).cast("long")))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    placed = before.join(totals, by) if by else before.withColumn("_total", F.lit(totals.collect()[0][0]))
    outs = []
    for name, q in points.items():
        at = (F.col("_total") - 1) * F.lit(q)
        low, high = F.floor(at), F.ceil(at)
        inside = lambda pos: (F.col("_before") <= pos) & (pos < F.col("_before") + F.col("_n"))
        low_value = F.max(F.when(inside(low), F.col(value)))
        high_value = F.max(F.when(inside(high), F.col(value)))
        weight = F.max(at - low)
        outs.append((low_value + (high_value - low_value) * weight).alias(name))
    return placed.groupBy(*by).agg(*outs) if by else placed.agg(*outs)
