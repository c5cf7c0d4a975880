"""A training corpus in five stages: toxicity, exact dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that the stage before it kept; its result is written
as Parquet in the shared folder and read again. All but the last return the columns of documents.

All stages: a null text is an empty one; an empty table gives an empty result; rows of null id stay unless a stage's rule
removes them; other columns come back as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paysleuth.llm.common import table
from paysleuth.llm.decontaminate import decontaminate
from paysleuth.llm.exact_dedup import exact_dedup
from paysleuth.llm.packing import pack
from paysleuth.llm.queries import word_tokenizer
from paysleuth.llm.fuzzy_near_dedup import near_dedup
from paysleuth.llm.toxicity import without_toxic
from paysleuth.session import materialized


# what a worker holds at once beside the other stages': texts of an Arrow batch, words whose token ids it keeps
TEXTS_A_BATCH, WORDS_KEPT = 1_000, 100_000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_A_BATCH)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Equal texts, repeated rows among them, share their fate."""
    small_batches(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; null ids lose, of repeated rows one stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays.

    Null ids lose, ties go by hashes of text and other columns, of repeated rows one stays.
    """
    small_batches(spark)
    return near_dedup(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; empty items are held by none. Repeated rows share their fate."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, packed into sequences of 4096: one row per piece, repeated rows each by itself."""
    small_batches(spark)
    return pack(docs, word_tokenizer(), max_words=WORDS_KEPT)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("decontamination", benchmarks),
    ("packing", packing),
]

# Classifier, fingerprints and tokenizer are beyond SQL: tests/llm/test_pipeline.py holds the rows against planted cases,
# the other tests there each operator against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, whole; nulls, repeats and empty tables as each stage says."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
