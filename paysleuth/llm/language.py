"""Language identification as a fusion of evidence: text, declared markup language, address suffix, host.

posterior(language) ~ text likelihood ^ temper x P(declared | language) x P(suffix | language) x prior(host). The text
likelihood is that of byte trigrams, counted over all documents whose language is given. All other terms come from
grouped sums of the text posteriors over all rows: the host prior is smoothed towards its registered domain's, that
towards the prior over everything, and leaves out the row itself.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysleuth.plans.sizing import as_lookup
from paysleuth.session import materialized

BUCKETS = 1 << 16
TEMPER = 0.1  # neighbouring trigrams repeat each other's evidence
STRENGTH = 5.0  # rows that a prior of the level above counts for
LOOKUP_VALUES = 2_000_000  # numbers of a table of sums that is sent to all tasks at most

_DROP = re.compile(r"<!--.*?-->|<(script|style|nav|head|template)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


def visible_text(page: str | None) -> str:
    """What a reader sees of a page: no head, scripts, styles, navigation or comments, entities resolved."""
    return markup.unescape(_TAG.sub(" ", _DROP.sub(" ", page or "")))


def trigram_buckets(text: str) -> np.ndarray:
    raw = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, dtype=np.uint32)
    mixed = (raw[:-2] * np.uint32(65599) + raw[1:-1]) * np.uint32(65599) + raw[2:]
    return (mixed ^ mixed >> np.uint32(16)) & np.uint32(BUCKETS - 1)


def trigram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, counts: languages x BUCKETS) over all rows with a language and a text.

    Each task sends one count per language and bucket; the sums that reach the driver are bounded by those two numbers.
    """
    given = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    languages = sorted(r["l"] for r in given.select(F.col(lang_col).alias("l")).distinct().collect())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["_text"], batch["_lang"], strict=True):
                total = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                total += np.bincount(trigram_buckets(text), minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    rows = given.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    sums = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), BUCKETS))
    got = sums.toPandas()
    where = {lang: i for i, lang in enumerate(languages)}
    counts[got["lang"].map(where).to_numpy(dtype=np.int64), got["bucket"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    return languages, counts


def log_likelihoods(counts: np.ndarray) -> np.ndarray:
    """BUCKETS x languages: smoothed log probabilities, relative to the mean over the languages."""
    p = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * BUCKETS))
    return (p - p.mean(0, keepdims=True)).T.astype(np.float32)


def _evidence(spark: SparkSession, table: np.ndarray, is_page: bool):
    """Column function: text evidence per language of a text, or of a page's visible text."""
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("array<double>")
    def evidence(text: pd.Series) -> pd.Series:
        weights, found = shared.value, []
        for t in text:
            at = trigram_buckets(visible_text(t) if is_page else (t or ""))
            found.append(sum((weights[at[i : i + 65536]].sum(0, dtype=np.float64) for i in range(0, len(at), 65536)), np.zeros(weights.shape[1])))
        return pd.Series(found, index=text.index)

    return evidence


def _host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:@]+)", 1))
    return F.regexp_replace(host, r"^(www|m|blog)\.", "")


def page_rows(spark: SparkSession, pages: DataFrame, table: np.ndarray, id_col="page_id", url_col="url", html_col="html"):
    """kind, id, host, domain, suffix, declared, text evidence of each page."""
    host = _host(F.col(url_col))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    return pages.select(
        F.lit("page").alias("kind"),
        F.col(id_col).cast("long").alias("id"),
        host.alias("host"),
        F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"),
        F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"),
        F.nullif(declared, F.lit("")).alias("declared"),
        _evidence(spark, table, True)(F.coalesce(F.col(html_col), F.lit(""))).alias("evidence"),
    )


def document_rows(spark: SparkSession, docs: DataFrame, table: np.ndarray, id_col="doc_id", source_col="source", text_col="text"):
    """The same of documents: their source stands for the host; there is no markup and no address."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.lit("document").alias("kind"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("host"),
        none.alias("domain"),
        none.alias("suffix"),
        none.alias("declared"),
        _evidence(spark, table, False)(F.coalesce(F.col(text_col), F.lit(""))).alias("evidence"),
    )


def _normalised(scores: Column) -> Column:
    """exp of the scores, scaled to sum 1."""
    top = F.array_max(scores)
    parts = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(parts, lambda p: p / F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def _sums(n: int) -> list[Column]:
    return [F.sum(F.col("soft")[i]).alias(f"_s{i}") for i in range(n)]


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """kind, id, lang, confidence, text_lang, declared, host for each row of ``page_rows`` / ``document_rows``.

    A row without text, markup and host gets the most frequent language. Without any language known lang is null.
    """
    n = len(languages)
    if not n:
        nothing = F.lit(None).cast("string")
        return rows.select("kind", "id", nothing.alias("lang"), F.lit(None).cast("double").alias("confidence"), nothing.alias("text_lang"), "declared", "host")
    soft = rows.withColumn("_scores", F.transform("evidence", lambda e: e * TEMPER)).withColumn("soft", _normalised(F.col("_scores")))
    soft = materialized(soft.drop("evidence"), "language-evidence")
    every = soft.agg(F.count(F.lit(1)).alias("_n"), *_sums(n)).first()
    total = float(every["_n"] or 0) + n
    base = [(float(every[f"_s{i}"] or 0.0) + 1.0) / total for i in range(n)]

    def looked_up(table: DataFrame) -> DataFrame:
        """Few hosts, many rows of each: the sums go to the rows, unless they are too many for that."""
        return as_lookup(table, max(1000, LOOKUP_VALUES // (n + 3)))

    out = soft
    for key, name in (("host", "h"), ("domain", "d")):
        known = soft.filter(F.col(key).isNotNull())
        table = known.groupBy("kind", key).agg(F.count(F.lit(1)).alias(f"_n_{name}"), F.array(*_sums(n)).alias(f"_sum_{name}"))
        table = table.withColumnsRenamed({key: f"_key_{name}", "kind": f"_kind_{name}"})
        same = (F.col(key) == F.col(f"_key_{name}")) & (F.col("kind") == F.col(f"_kind_{name}"))
        out = out.join(looked_up(table), same, "left").drop(f"_kind_{name}", f"_key_{name}")
    whole, values = {}, {}
    for key in ("declared", "suffix"):
        given = soft.filter(F.col(key).isNotNull())
        table = given.groupBy(key).agg(F.array(*_sums(n)).alias(f"_sum_{key}"))
        out = out.join(looked_up(table), key, "left")
        *sums, values[key] = given.agg(*_sums(n), F.count_distinct(key)).first()
        whole[key] = [float(x or 0.0) for x in sums]

    def prior(i: int) -> Column:
        own = F.col("soft")[i]
        smoothed = (F.col("_sum_d")[i] - own + F.lit(STRENGTH * base[i])) / (F.col("_n_d") - 1 + STRENGTH)
        domain = F.coalesce(smoothed, F.lit(base[i]))
        return F.coalesce((F.col("_sum_h")[i] - own + STRENGTH * domain) / (F.col("_n_h") - 1 + STRENGTH), domain)

    def stated(key: str, i: int) -> Column:
        """log P(value of the key | language) from the sums of all rows but this one; nothing where there is no value.

        Before any row is seen, a value that is the language's own code (de, fr) counts as ``STRENGTH`` rows.
        """
        own, before = F.col("soft")[i], F.when(F.col(key) == F.lit(languages[i]), STRENGTH).otherwise(0.0) + 0.5
        p = (F.col(f"_sum_{key}")[i] - own + before) / (F.lit(whole[key][i] + STRENGTH + 0.5 * (values[key] + 1)) - own)
        return F.coalesce(F.log(F.greatest(p, F.lit(1e-6))), F.lit(0.0))

    scores = F.array(
        *[F.col("_scores")[i] + F.log(F.greatest(prior(i), F.lit(1e-6))) + stated("declared", i) + stated("suffix", i) for i in range(n)]
    )
    names = F.array(*[F.lit(x) for x in languages])

    def best(values: Column) -> Column:
        return F.get(names, (F.array_position(values, F.array_max(values)) - 1).cast("int"))

    fused = out.withColumn("_final", scores).withColumn("_posterior", _normalised(F.col("_final")))
    return fused.select(
        "kind",
        "id",
        best(F.col("_posterior")).alias("lang"),
        F.array_max("_posterior").alias("confidence"),
        best(F.col("soft")).alias("text_lang"),
        "declared",
        "host",
    )


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each document and each page: doc_id or page_id (the other is null), lang, confidence, text_lang, ...

    Null texts and pages are empty, null addresses have no host; repeated rows and null ids are rows like any other.
    Ties go to the language that comes first in the alphabet. Other columns play no part.
    """
    spark = docs.sparkSession
    languages, counts = trigram_counts(docs)
    table = log_likelihoods(counts) if languages else np.zeros((BUCKETS, 0), dtype=np.float32)
    rows = page_rows(spark, pages, table).unionByName(document_rows(spark, docs, table))
    fused = fuse(rows, languages)
    return fused.select(
        F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"),
        F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
        "lang",
        F.round("confidence", 6).alias("confidence"),
        "text_lang",
        "declared",
        "host",
    )
