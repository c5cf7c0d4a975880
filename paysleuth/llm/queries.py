"""The operators as named queries over the given tables, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysleuth.llm import (
    decontaminate,
    exact_dedup,
    language,
    packing,
    periodic_runs,
    pii,
    sharding,
    simhash_dedup,
    suffix_dedup,
    token_alignment,
    token_files,
    toxicity,
    warc,
)
from paysleuth.llm.common import table

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark, sf):
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


SQL["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op10_sharding(spark, sf):
    return sharding.shard_rows(table(spark, sf, "documents"))


@query
def op3_toxicity(spark, sf):
    return toxicity.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op4_pii(spark, sf):
    return pii.pii_digest(table(spark, sf, "documents"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_token_files(spark, sf):
    return token_files.token_digest(table(spark, sf, "documents"), word_tokenizer())


@query
def op5_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), word_tokenizer())


@query
def op7_simhash_dedup(spark, sf):
    return simhash_dedup.simhash_components(table(spark, sf, "documents"))


@query
def op8_warc(spark, sf):
    return warc.archive_digest(table(spark, sf, "pages"))


SQL["op8_warc"] = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
       sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER same
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER same
            THEN max(page_id) OVER same END AS refers_to
FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))
"""


@query
def op6_decontamination(spark, sf):
    leaks = decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return leaks.drop("text_hash").withColumn("similarity", F.round("similarity", 6))


@query
def op9_language(spark, sf):
    return language.identify(table(spark, sf, "documents"), table(spark, sf, "pages"))


@query
def op12_periodic_runs(spark, sf):
    return periodic_runs.run_digest(table(spark, sf, "documents"))


@query
def op13_token_alignment(spark, sf):
    import public_tokenizers

    byte_level, pieces = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.alignment_digest(table(spark, sf, "documents"), byte_level, pieces)


@query
def op11_suffix_dedup(spark, sf):
    return suffix_dedup.span_digest(table(spark, sf, "documents"))
