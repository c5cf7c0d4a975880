"""Maximal periodic runs of words, by common extensions over a difference cover.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``max(least, 2 q)`` long, that
no neighbour extends. Every run of period p holds exactly one pair (i, i + p), i a multiple of p, with i among its first
p words; how far that pair extends to the right and to the left gives the run. The multiples of 1, 2, 3, ... are the
harmonic grid: about n ln n pairs for n words.

Extensions come from suffixes at the positions of a difference cover modulo 31 only: these are sorted by doubling,
neighbours in that order get their common length, and a sparse table gives the least of any range. Two positions are at
most 30 words before a pair of covered ones, which are compared directly. Many short texts are worked on as one
array, with a word of its own after each, which no extension crosses. All is numpy within a task; nothing is shuffled.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysleuth.llm.common import whole_text

MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)  # fixed values: every remainder modulo 31 is a difference of two of these
AT_ONCE = 1 << 16  # words of short texts worked on together
PAIRS = 1 << 20  # grid pairs at a time


@lru_cache(maxsize=1)
def _steps() -> np.ndarray:
    """Words until both of two positions with these remainders are covered."""
    steps = np.empty((MODULUS, MODULUS), dtype=np.int64)
    for i in range(MODULUS):
        for j in range(MODULUS):
            steps[i, j] = min(d for d in range(MODULUS) if (i + d) % MODULUS in COVER and (j + d) % MODULUS in COVER)
    return steps


class Extensions:
    """Lengths of common prefixes of suffixes. words: non-negative integers, with the last of each text occurring once."""

    def __init__(self, words: np.ndarray):
        v, n = MODULUS, len(words)
        self.words = np.concatenate([words + 1, np.zeros(v + 1, dtype=np.int64)])  # 0: beyond the end
        at = np.arange(n)
        covered = at[np.isin(at % v, COVER)]
        self.number = np.full(n + 1, len(covered), dtype=np.int64)
        self.number[covered] = np.arange(len(covered))
        levels = [self._blocks(covered)]
        span = v
        while levels[-1].max(initial=0) < len(covered):  # ranks from 1; 0 beyond the end
            rank = levels[-1]
            later = rank[self.number[np.minimum(covered + span, n)]]
            key = rank[:-1] * (len(covered) + 1) + later
            levels.append(self._ranked(key))
            span *= 2
        self.rank = levels[-1][:-1] - 1
        order = np.empty(len(covered), dtype=np.int64)
        order[self.rank] = np.arange(len(covered))
        a, b = covered[order[:-1]], covered[order[1:]]
        common = np.zeros(len(a), dtype=np.int64)
        for k in range(len(levels) - 2, -1, -1):
            rank = levels[k]
            x, y = np.minimum(a + common, n), np.minimum(b + common, n)
            same = (rank[self.number[x]] == rank[self.number[y]]) & (x < n) & (y < n)
            common[same] += v << k
        common += self._direct(a + common, b + common, np.full(len(a), v))
        self.table = [common]
        half = 1
        while 2 * half <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))
            half *= 2

    @staticmethod
    def _ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])[: len(order)]
        rank = np.zeros(len(key) + 1, dtype=np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def _blocks(self, covered: np.ndarray) -> np.ndarray:
        """Ranks of the blocks of ``MODULUS`` words, several words packed into one key."""
        bits = max(1, int(self.words.max(initial=1)).bit_length())
        each = max(1, 62 // bits)
        keys = []
        for start in range(0, MODULUS, each):
            key = np.zeros(len(covered), dtype=np.int64)
            for t in range(start, min(start + each, MODULUS)):
                key = (key << bits) | self.words[np.minimum(covered + t, len(self.words) - 1)]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(covered), dtype=bool)
        new[:1] = True
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.zeros(len(covered) + 1, dtype=np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def _direct(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many of the next ``most`` words are equal, word by word."""
        found = np.zeros(len(a), dtype=np.int64)
        open_ = np.arange(len(a))
        end = len(self.words) - 1
        for t in range(int(most.max(initial=0))):
            open_ = open_[most[open_] > t]
            x, y = a[open_] + t, b[open_] + t
            open_ = open_[(self.words[np.minimum(x, end)] == self.words[np.minimum(y, end)]) & (np.maximum(x, y) < end - MODULUS)]
            if not len(open_):
                break
            found[open_] = t + 1
        return found

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common length of the suffixes at i and at j, i != j."""
        step = _steps()[i % MODULUS, j % MODULUS]
        found = self._direct(i, j, step)
        n = len(self.number) - 1
        far = np.flatnonzero((found == step) & (np.maximum(i, j) + step < n))
        if not len(far):
            return found
        p = self.rank[self.number[i[far] + step[far]]]
        q = self.rank[self.number[j[far] + step[far]]]
        low, high = np.minimum(p, q), np.maximum(p, q)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        least = np.empty(len(far), dtype=np.int64)
        for k in np.unique(level):
            of = np.flatnonzero(level == k)
            row = self.table[k]
            least[of] = np.minimum(row[low[of]], row[high[of] - (1 << int(k))])
        found[far] += least
        return found


class Runs(NamedTuple):
    """By start, then period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _grid(starts: np.ndarray, lengths: np.ndarray):
    """(i, p) for all pairs (i, i + p) of all texts, whole periods and about ``PAIRS`` at a time."""
    halves = lengths // 2
    period = np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    begin, counts = np.repeat(starts, halves), (np.repeat(lengths, halves) - 1) // period
    block = np.cumsum(counts) // PAIRS
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        many, p = counts[low:high], np.repeat(period[low:high], counts[low:high])
        turn = np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
        yield np.repeat(begin[low:high], many) + turn * p, p


def array_runs(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int) -> Runs:
    """Runs of all texts in one array; text k is words[starts[k] : starts[k] + lengths[k]] with a word of its own after it."""
    total, ahead, behind = len(words), None, None
    hits = [np.zeros((0, 3), dtype=np.int64)]
    for first, period in _grid(starts, lengths):
        same = np.flatnonzero(words[first] == words[first + period])
        if not len(same):
            continue
        if ahead is None:
            ahead, behind = Extensions(words), Extensions(words[::-1].copy())
        first, period = first[same], period[same]
        right = ahead.common(first, first + period)
        left = np.zeros(len(first), dtype=np.int64)
        back = np.flatnonzero(first > 0)
        left[back] = behind.common(total - first[back], total - first[back] - period[back])
        good = np.flatnonzero((right + left >= period) & (right + left + period >= least))
        begin, end = first[good] - left[good], first[good] + period[good] + right[good]
        hits.append(np.unique(np.stack([begin, end, period[good]], axis=1), axis=0))
    hits = np.concatenate(hits)
    # a stretch that also has a shorter period shows up with that one
    hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
    new = np.ones(len(hits), dtype=bool)
    new[1:] = (hits[1:, :2] != hits[:-1, :2]).any(axis=1)
    hits = hits[new]
    hits = hits[np.lexsort((hits[:, 2], hits[:, 0]))]
    return Runs(hits[:, 0], hits[:, 1] - hits[:, 0], hits[:, 2])


def _together(lists: list[list[bytes]]):
    """Indices of neighbouring texts with at most ``AT_ONCE`` words in all, a longer one by itself."""
    now, words = [], 0
    for k, text in enumerate(lists):
        if now and words + len(text) + 1 > AT_ONCE:
            yield now
            now, words = [], 0
        now.append(k)
        words += len(text) + 1
    if now:
        yield now


def _blocks(texts: pd.Series):
    """Neighbouring texts of about ``AT_ONCE`` words in all."""
    now, size = [], 0
    for t in texts:
        now.append(t)
        size += len(t or "")
        if size >= 6 * AT_ONCE:
            yield now
            now, size = [], 0
    if now:
        yield now


def runs_of_texts(lists: list[list[bytes]], least: int = 12) -> list[Runs]:
    """The runs of each list of words."""
    result: list[Runs] = []
    for group in _together(lists):
        known: dict[bytes, int] = {}
        lengths = np.array([len(lists[k]) for k in group], dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        total = int(lengths.sum()) + len(group)
        words = np.empty(total, dtype=np.int64)
        for k, begin in zip(group, starts.tolist(), strict=True):
            words[begin : begin + len(lists[k])] = [known.setdefault(w, len(known)) for w in lists[k]]
        words[starts + lengths] = len(known) + np.arange(len(group))
        runs = array_runs(words, starts, lengths, least)
        cuts = np.searchsorted(runs.start, np.append(starts, total))
        for k, begin in enumerate(starts.tolist()):
            part = slice(cuts[k], cuts[k + 1])
            result.append(Runs(runs.start[part] - begin, runs.length[part], runs.period[part]))
    return result


def collapsed(words: list[bytes], runs: Runs) -> bytes:
    """The words outside any run's repeats (what follows its first period), joined by one space."""
    if not len(runs.start):
        return b" ".join(words)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(inside, runs.start + runs.period, 1)
    np.add.at(inside, runs.start + runs.length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(inside[:-1]) == 0).tolist()])


def runs_column(least: int):
    """Column function: start, length, period (arrays, by start and period) and the collapsed text."""

    @F.pandas_udf("start array<long>, length array<long>, period array<long>, collapsed string")
    def runs(text: pd.Series) -> pd.DataFrame:
        rows = []
        for some in _blocks(text):  # only these texts' words are held at once
            lists = [(t or "").encode().split() for t in some]
            found = runs_of_texts(lists, least)
            rows += [(*r, collapsed(w, r).decode()) for w, r in zip(lists, found, strict=True)]
        return pd.DataFrame(rows, columns=["start", "length", "period", "collapsed"], dtype="object")

    return runs


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """One row per row of ``docs``: doc_id, runs (array of start, length, period, numbers of words), collapsed (text).

    Words are what ASCII white space parts. A null or empty text has no words, no runs and the collapsed text ''.
    Null ids and repeated rows stay as they are; other columns play no part; an empty table gives an empty result.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), runs_column(least)(F.col(text_col)).alias("_r"))
    return found.select(
        "doc_id",
        F.arrays_zip(F.col("_r.start").alias("start"), F.col("_r.length").alias("length"), F.col("_r.period").alias("period")).alias("runs"),
        F.col("_r.collapsed").alias("collapsed"),
    )


def planted_column():
    """Column function of (id, text): the words with a periodic rest where the id's crc32 h is a multiple of ten.

    From word a = g % n on (g = h // 10), word i becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). Texts
    without words and rows with a null id stay as they are.
    """
    import zlib

    @F.pandas_udf("string")
    def planted(ids: pd.Series, text: pd.Series) -> pd.Series:
        made = []
        for i, t in zip(ids, text, strict=True):
            h = zlib.crc32(i.encode()) if i is not None else 1
            if h % 10 == 0:
                words = (t or "").encode().split()
                if n := len(words):
                    g = h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    piece = words[a : a + p]
                    rest = piece * ((n - a) // p + 1)
                    t = b" ".join(words[:a] + rest[: n - a]).decode()
            made.append(t)
        return pd.Series(made, index=text.index, dtype="object")

    return planted


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """Per row of ``docs``, after ``planted_column``: number of runs, the longest one, digests of all and of what is kept.

    The longest run goes by length, then smallest start, then period; without runs start, length, period and
    exponent_milli are null and runs_sha256 is that of ''. Nulls, repeats and empty tables as in ``find_runs``.
    """
    text = planted_column()(F.col(id_col).cast("string"), whole_text(text_col))
    found = find_runs(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")), "doc_id", "text", least)
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    found = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), listed.alias("_l"))
    length, period = F.col("_b.length"), -F.col("_b.short")
    return found.select(
        "doc_id",
        "n_runs",
        (-F.col("_b.before")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(F.expr("1000 * _b.length div -_b.short")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("_l").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
