"""Packing into sequences by non-negative least squares on the histogram of lengths.

Texts become pieces of at most one window. Lengths are counted in steps (``quantum``); the patterns are the ways to
fill a window with up to ``depth`` steps-lengths. Least squares says how often to use each pattern; the counts are
rounded, what is left is packed greedily, largest piece first. All of this works on the histogram, whose size does not
depend on the input; the pieces then find their place by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysleuth.llm.common import whole_text
from paysleuth.llm.tokens import MAX_WORDS, broadcast_spec, ids_with_end
from paysleuth.session import materialized

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces_of(
    docs: DataFrame,
    tokenizer: str,
    window: int,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """The pieces of all texts (null: empty): whole documents, long ones cut at multiples of the window."""
    spec = broadcast_spec(docs.sparkSession, tokenizer)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            ids = ids_with_end(spec.value, batch["_text"], end_id, max_words)
            for key, raw in zip(batch["doc_id"], ids, strict=True):
                total = len(raw) // 4
                for start in range(0, total, window):
                    piece = raw[4 * start : 4 * (start + window)]
                    found.append((key, start, len(piece) // 4, zlib.crc32(piece), total))
            table = pd.DataFrame(found, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield table.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("_text"))
    return rows.mapInPandas(cut, PIECES)


def fillings(steps: int, depth: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """All ways to fill ``steps`` with 2 to ``depth`` lengths that occur, each way once, lengths descending."""
    found: list[tuple[int, ...]] = []
    lengths = [int(x) for x in np.flatnonzero(present) if 0 < x < steps]
    there = set(lengths)

    def extend(chosen: tuple[int, ...], left: int) -> None:
        last = chosen[-1] if chosen else steps
        if chosen and left <= last and left in there:
            found.append((*chosen, left))
        if len(chosen) + 2 > depth - 0 and chosen:
            return
        for x in lengths:
            if x <= last and x < left and x * (depth - len(chosen)) >= left:
                extend((*chosen, x), left - x)

    extend((), steps)
    return [f for f in found if len(f) <= depth]


def nonnegative_least_squares(columns: list[tuple[int, ...]], target: np.ndarray, most: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |A x - target|, by the active-set method; A's columns count the lengths of a pattern."""
    x = np.zeros(len(columns))
    if not columns:
        return x
    width = max(map(len, columns))
    places = np.zeros((len(columns), width), dtype=np.int64)  # row 0 of the padded residual is always 0
    for j, c in enumerate(columns):
        places[j, : len(c)] = c
    scale = max(1.0, float(target.max()))
    goal = target / scale
    passive: list[int] = []
    rest = goal.copy()
    for _ in range(most):
        rest[0] = 0.0
        gain = rest[places].sum(1)
        gain[passive] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= 1e-7:
            break
        passive.append(j)
        while True:
            a = np.zeros((len(goal), len(passive)))
            for k, p in enumerate(passive):
                for at in columns[p]:
                    a[at, k] += 1
            s = np.linalg.lstsq(a, goal, rcond=None)[0]
            if (s > 1e-12).all():
                x[:] = 0
                x[passive] = s
                rest = goal - a @ s
                break
            now = x[passive]
            down = s <= 1e-12
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha = np.nanmin(np.where(down, now / np.where(now - s == 0, np.inf, now - s), np.inf))
            moved = now + min(1.0, max(0.0, alpha)) * (s - now)
            keep = ~(down & (moved <= 1e-12))
            if keep.all():
                keep[int(np.argmin(np.where(down, moved, np.inf)))] = False
            x[:] = 0
            passive = [p for p, k in zip(passive, keep, strict=True) if k]
            x[passive] = moved[keep]
            if not passive:
                rest = goal.copy()
                break
    return x * scale


@dataclass(frozen=True)
class Plan:
    """patterns: (lengths in steps, how many sequences are filled this way)."""

    steps: int
    patterns: list[tuple[tuple[int, ...], int]]

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def make_plan(histogram: np.ndarray, depth: int = 3) -> Plan:
    """histogram[k]: pieces of k steps, k from 1 to the window. Every piece gets a place in some pattern."""
    steps = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []
    if left[steps]:
        patterns.append(((steps,), int(left[steps])))
        left[steps] = 0
    columns = fillings(steps, depth, left > 0)
    x = nonnegative_least_squares(columns, left.astype(np.float64))
    for j in np.argsort(-x, kind="stable"):
        uses = np.bincount(columns[j], minlength=steps + 1) if columns else None
        n = int(round(x[j]))
        if n <= 0:
            break
        lengths = np.flatnonzero(uses)
        n = min(n, int((left[lengths] // uses[lengths]).min()))
        if n > 0:
            patterns.append((columns[j], n))
            left[lengths] -= n * uses[lengths]
    while left.any():  # each round uses up some length, or as often as its place allows
        chosen: list[int] = []
        used = np.zeros_like(left)
        space = steps
        while space:
            fits = np.flatnonzero((left - used)[: space + 1])
            if not len(fits):
                break
            k = int(fits[-1])
            chosen.append(k)
            used[k] += 1
            space -= k
        lengths = np.flatnonzero(used)
        n = int((left[lengths] // used[lengths]).min())
        patterns.append((tuple(chosen), n))
        left[lengths] -= n * used[lengths]
    return Plan(steps, patterns)


def _places(plan: Plan, histogram: np.ndarray):
    """Column function: (rank among all pieces in the order of their lengths) -> (sequence, place in it)."""
    begin = np.concatenate([[0], np.cumsum(histogram)[:-1]])  # first rank of each length
    taken = np.zeros(len(histogram), dtype=np.int64)
    rows: list[tuple[int, int, int, int]] = []  # first rank, first sequence, first place, pieces of it in a sequence
    sequence = 0
    for lengths, n in plan.patterns:
        place = 0
        for k in dict.fromkeys(lengths):
            each = lengths.count(k)
            rows.append((int(begin[k] + taken[k]), sequence, place, each))
            taken[k] += n * each
            place += each
        sequence += n
    table = np.array(sorted(rows) or [(0, 0, 0, 1)], dtype=np.int64)

    @F.pandas_udf("struct<sequence:long,place:long>")
    def place_of(rank: pd.Series) -> pd.DataFrame:
        r = rank.to_numpy()
        first, seq, place, each = table[np.searchsorted(table[:, 0], r, side="right") - 1].T
        return pd.DataFrame({"sequence": seq + (r - first) // each, "place": place + (r - first) % each})

    return place_of


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 4096,
    end_id: int = 2,
    quantum: int = 16,
    depth: int = 3,
    cells: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is an empty one and still holds its end id. Repeated rows and null ids are packed like any other; an
    empty table gives an empty result. Sequences are meant to be padded to the window. Other columns play no part.
    max_words: words whose ids a worker keeps at most; it changes speed and memory only.
    """
    spark = docs.sparkSession
    pieces = materialized(pieces_of(docs, tokenizer, window, end_id, id_col, text_col, max_words), "pieces")
    steps = -(-window // quantum)
    bins = pieces.withColumn("_bin", F.ceil(F.col("length") / quantum).cast("int"))
    histogram = np.zeros(steps + 1, dtype=np.int64)
    for r in bins.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per length in steps
        histogram[r["_bin"]] = r["n"]
    plan = make_plan(histogram, depth)

    # ranks inside a length: frequent lengths are dealt over cells, at most ``cells`` + one per length in all
    total = int(histogram.sum())
    dealt = np.maximum(1, -(-histogram * cells // max(total, 1)))
    first = np.concatenate([[0], np.cumsum(dealt)[:-1]])
    # Arrow tables reach the JVM as they are; lists and pandas tables would take workers of plain Python on the executors
    known = spark.createDataFrame(pa.table({"_bin": np.arange(steps + 1, dtype=np.int32), "_first": first, "_cells": dealt}))
    celled = bins.join(F.broadcast(known), "_bin").withColumn(  # one row per length in steps
        "_cell", F.col("_first") + F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("_cells"))
    )
    sizes = np.zeros(int(dealt.sum()), dtype=np.int64)
    for r in celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per cell
        sizes[r["_cell"]] = r["n"]
    earlier = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    before = spark.createDataFrame(pa.table({"_cell": np.arange(len(sizes), dtype=np.int64), "_before": earlier}))
    order = Window.partitionBy("_cell").orderBy("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    ranked = (
        celled.withColumn("_row", F.row_number().over(order) - 1)
        .join(F.broadcast(before), "_cell")
        .withColumn("_at", _places(plan, histogram)(F.col("_before") + F.col("_row")))
    )
    inside = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranked.select(
            *(c.split()[0] for c in PIECES.split(", ")),
            F.col("_at.sequence").alias("sequence_id"),
            F.col("_at.place").alias("_place"),
        )
        .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0).cast("long")))
        .drop("_place")
    )
