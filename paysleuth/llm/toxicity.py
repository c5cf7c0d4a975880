"""Toxicity by weak supervision: many noisy voters, a generative label model over them, a linear classifier.

1. Voters. A general lexicon, and words and word beginnings that the labelled rows make suspicious; each votes at
   several levels of count and of share in the text.
2. Label model. Expectation maximisation estimates how often each voter (the given label is one of them) votes in
   toxic and in clean texts, and how correlated voters are within a class; correlated voters share their weight.
3. Classifier. Logistic regression on the votes, fitted to the model's posterior labels.

The voters, the model and the classifier are fitted on at most ``max_rows`` labelled rows, drawn by a hash of the id
(``Settings.max_rows``, the documented bound). Scoring reads every row and whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysleuth.session import materialized

# Insults of everyday English; what they are worth is estimated, not assumed.
LEXICON = (
    "idiot moron imbecile fool stupid dumb loser clown scum trash garbage filth worthless pathetic disgusting "
    "useless hate ugly vermin pig jerk"
).split()

_LEXICON = frozenset(LEXICON)
_WORD = re.compile(r"\w+")
PREFIXES = range(3, 9)  # lengths of the word beginnings that may become voters
# A voter fires from so many hits on, and from such a share of the words on.
LEVELS = ((1, 0.0), (2, 0.0), (4, 0.0), (2, 0.005), (2, 0.01), (1, 0.02), (3, 0.02), (3, 0.04))


# Two voters sum over many words: any word of the lexicon, and any word with a beginning that is nearly always toxic.
ANY_LEXICON, ANY_TELLING = "@lexicon", "@telling"


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled rows used for fitting. telling: the smallest share of toxic texts among those with
    a word for the word to count as telling, and the smallest share of all toxic texts that must hold it."""

    max_rows: int = 12_000
    telling: tuple[float, float] = (0.97, 0.02)
    penalty: float = 0.2
    max_bases: int = 2_000
    max_voters: int = 256
    least_rows: int = 3
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """bases: word or word beginning (with ``*``) -> number; telling: those that sum up in one voter;
    voters: (base number, level number); weights: bias first."""

    bases: dict[str, int]
    telling: frozenset[str]
    voters: list[tuple[int, int]]
    weights: np.ndarray


def _counts(text: str | None) -> tuple[Counter, int]:
    words = Counter(_WORD.findall((text or "").lower()))
    return words, sum(words.values())


def _base_hits(words: Counter, bases: dict[str, int], telling: frozenset[str]) -> dict[int, int]:
    """Hits of each base in a text; a word counts once for each base it matches and for each of the two sums."""
    hits: Counter = Counter()
    for word, n in words.items():
        found = [word] if word in bases else []
        for k in PREFIXES:
            if len(word) <= k:
                break
            start = word[:k] + "*"
            if start in bases:
                found.append(start)
        if not found:
            continue
        for token in found:
            hits[bases[token]] += n
        if ANY_TELLING in bases and not telling.isdisjoint(found):
            hits[bases[ANY_TELLING]] += n
        if ANY_LEXICON in bases and word in _LEXICON:
            hits[bases[ANY_LEXICON]] += n
    return hits


def _seen_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of each class that hold a word or word beginning, summed within the task."""
    seen = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch["_text"], batch["_toxic"], strict=True):
            words, _ = _counts(text)
            seen[toxic].update(set(words) | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k})
    tokens = list(seen[0].keys() | seen[1].keys())
    for i in range(0, len(tokens), 50_000):
        part = tokens[i : i + 50_000]
        yield pd.DataFrame({"token": part, "bad": [seen[1][t] for t in part], "good": [seen[0][t] for t in part]})


def association(bad: Column, good: Column, n_bad: int, n_good: int) -> Column:
    """The G statistic of the 2 x 2 table token x class; 0 where the token does not speak for toxicity."""
    n = n_bad + n_good
    cells = [
        (bad, (bad + good) * n_bad / n),
        (good, (bad + good) * n_good / n),
        (n_bad - bad, (n - bad - good) * n_bad / n),
        (n_good - good, (n - bad - good) * n_good / n),
    ]
    g = sum((F.when(o > 0, o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))
    return F.when(bad * n_good > 2 * good * n_bad, g).otherwise(0.0)


def in_held_out(id_col: str) -> Column:
    """Rows that labels are never learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    ids = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~in_held_out(id_col))
    ids = ids.groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(settings.max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sample = texts.join(F.broadcast(ids), "_id")  # at most max_rows ids
    return sample.dropDuplicates(["_id"]).select("_text", "_toxic", F.md5("_text").alias("_copy")).dropDuplicates(["_copy"])


def _fired(count: int, total: int) -> list[int]:
    return [k for k, (n, share) in enumerate(LEVELS) if count >= n and count >= share * total]


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Posterior probability of the toxic class for each row.

    votes: rows x voters, 0 or 1. gold: the given labels, a voter whose accuracy is estimated like the others'.
    A voter's log odds are divided by the number of voters it repeats: 1 + the sum of its squared correlations with
    the others within the classes.
    """
    posterior = np.where(gold == 1, 0.98, 0.02)
    table = np.column_stack([votes, gold]).astype(np.float64)
    for _ in range(rounds):
        bad, good = posterior.sum(), (1 - posterior).sum()
        fires_bad = (posterior @ table + 0.5) / (bad + 1)
        fires_good = ((1 - posterior) @ table + 0.5) / (good + 1)
        within = table - np.outer(posterior, fires_bad) - np.outer(1 - posterior, fires_good)
        spread = np.sqrt((within**2).sum(0)) + 1e-9
        correlation = (within / spread).T @ (within / spread)
        repeats = (correlation**2).sum(1)  # the diagonal is the 1
        repeats[-1] = 1.0  # labels are given independently of the patterns
        on = np.log(fires_bad / fires_good) / repeats
        off = np.log((1 - fires_bad) / (1 - fires_good)) / repeats
        odds = np.log(bad / good) + table @ on + (1 - table) @ off
        posterior = np.clip(1 / (1 + np.exp(-np.clip(odds, -30, 30))), 1e-4, 1 - 1e-4)
    return posterior


def logistic(votes: np.ndarray, target: np.ndarray, penalty: float, steps: int = 25) -> np.ndarray:
    """Weights (bias first) of ridge logistic regression on soft labels, by Newton steps."""
    x = np.column_stack([np.ones(len(votes)), votes]).astype(np.float64)
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + ridge * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _choose_voters(fired: dict[tuple[int, int], set[int]], bad: np.ndarray, settings: Settings, names: list[str]) -> list:
    """The most telling voters; of those that fire on the same rows the most specific one."""
    n_bad, n_good = int(bad.sum()), int((~bad).sum())
    best: dict[tuple, tuple] = {}
    for voter, rows in fired.items():
        at = np.fromiter(rows, dtype=np.int64)
        hits, false = int(bad[at].sum()), int((~bad[at]).sum())
        if hits < min(settings.least_rows, n_bad) or hits * max(n_good, 1) <= 4 * false * max(n_bad, 1):
            continue
        n, g = n_bad + n_good, 0.0
        for o, e in (
            (hits, len(at) * n_bad / n),
            (false, len(at) * n_good / n),
            (n_bad - hits, (n - len(at)) * n_bad / n),
            (n_good - false, (n - len(at)) * n_good / n),
        ):
            g += o * math.log(o / e) if o else 0.0
        key = hash(frozenset(rows))
        rank = (g, len(names[voter[0]]), -voter[1], names[voter[0]])
        if key not in best or rank > best[key][0]:
            best[key] = (rank, voter)
    chosen = sorted(best.values(), reverse=True)[: settings.max_voters]
    return [voter for _, voter in chosen]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings | None = None,
) -> Model:
    """Fit on the labelled rows outside the held-out third (see the module text for the bound).

    Without any labelled toxic row only the lexicon votes, each word with equal weight.
    """
    settings = settings or Settings()
    sample = materialized(_training_sample(docs, labels, id_col, text_col, settings), "toxic-sample")
    sizes = {r["_toxic"]: r["n"] for r in sample.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        bases = {w: i for i, w in enumerate(LEXICON)}
        weights = np.array([-3.0] + [2.0] * len(LEXICON))
        return Model(bases, frozenset(), [(i, 0) for i in range(len(LEXICON))], weights)
    tokens = (
        sample.repartition(F.col("_copy"))
        .mapInPandas(_seen_tokens, "token string, bad long, good long")
        .groupBy("token")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .filter(F.col("bad") >= min(settings.least_rows, n_bad))
        .withColumn("g", association(F.col("bad"), F.col("good"), n_bad, n_good))
        .filter("g > 0")
        .orderBy(F.desc("g"), F.desc(F.length("token")), "token")
        .limit(settings.max_bases)
        .collect()
    )
    names = list(dict.fromkeys([*LEXICON, ANY_LEXICON, ANY_TELLING, *(r["token"] for r in tokens)]))
    bases = {t: i for i, t in enumerate(names)}
    purity, reach = settings.telling
    telling = frozenset(
        r["token"]
        for r in tokens
        if r["bad"] / n_bad >= purity * (r["bad"] / n_bad + r["good"] / n_good) and r["bad"] >= reach * n_bad
    )

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["_text"]:
                words, total = _counts(text)
                got = _base_hits(words, bases, telling)
                found.append((batch["_toxic"].iloc[len(found)], total, list(got.keys()), list(got.values())))
            yield pd.DataFrame(found, columns=["toxic", "total", "base", "n"])

    rows = sample.mapInPandas(hits, "toxic int, total long, base array<int>, n array<int>").toPandas()
    # the order of the rows is immaterial to all that follows
    bad = rows["toxic"].to_numpy() == 1
    fired: dict[tuple[int, int], set[int]] = {}
    for i, (total, base, n) in enumerate(zip(rows["total"], rows["base"], rows["n"], strict=True)):
        for b, c in zip(base, n, strict=True):
            for level in _fired(c, total):
                fired.setdefault((int(b), level), set()).add(i)
    voters = _choose_voters(fired, bad, settings, names)
    votes = np.zeros((len(rows), len(voters)))
    for j, voter in enumerate(voters):
        votes[list(fired[voter]), j] = 1
    posterior = label_model(votes, bad.astype(np.float64))
    return Model(bases, telling, voters, logistic(votes, posterior, settings.penalty))


def scorer(model: Model):
    """Column function: the score of a text, from 0 to 1. An empty or null text gets the score of no votes."""
    used = {b for b, _ in model.voters}
    bases = {t: b for t, b in model.bases.items() if b in used or t in model.telling or t in _LEXICON}
    telling = model.telling
    weight: dict[int, list[tuple[int, float]]] = {}
    for (b, level), w in zip(model.voters, model.weights[1:].tolist(), strict=True):
        weight.setdefault(b, []).append((level, w))
    bias = float(model.weights[0])

    def score_one(text: str | None) -> float:
        words, total = _counts(text)
        odds = bias
        for b, n in _base_hits(words, bases, telling).items():
            if b in weight:
                levels = _fired(n, total)
                odds += sum(w for level, w in weight[b] if level in levels)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(score_one).astype("float64")

    return score


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Only the text enters a score.

    A null text is an empty one and gets the score of no votes. Null ids are held out by the crc of '' and never learned
    from; equal texts and repeated rows have equal scores. Other columns play no part. An empty table gives an empty
    result; without labels of both kinds the general lexicon decides.
    """
    settings = settings or Settings()
    score = scorer(fit(docs, labels, id_col, text_col, settings))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    scored = rows.select("doc_id", in_held_out("doc_id").alias("held_out"), score("_text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))


def without_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings | None = None,
) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns, whatever their names.

    Nulls, repeats and empty tables as in ``score_documents``.
    """
    settings = settings or Settings()
    score = scorer(fit(docs, labels, id_col, text_col, settings))
    return docs.filter(score(F.coalesce(F.col(text_col), F.lit(""))) < settings.threshold)
