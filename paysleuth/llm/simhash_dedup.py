"""Near-duplicates by 64-bit SimHash, found by Golay-code fuzzy hashing.

The binary Golay code of length 23 corrects 3 errors. A 23-bit word is decoded to the code words within distance 4:
one if the nearest is at most 2 away, six otherwise. Two words at most 2 bits apart always share one of these. A
fingerprint is cut into three segments; if two fingerprints differ in at most 2 bits, at least one segment is equal
(pigeonhole) and the others are at most 2 apart. So a key is (an exact segment, a code word near the next segment): at
most 18 keys of about 33 bits for each fingerprint. Fingerprints that share a key are compared.

All of this runs on distinct fingerprints; copies cost one row. A bucket of more than ``bucket`` fingerprints is not
paired: its members are linked through the words one bit away, which is exact and linear (two fingerprints are within
2 bits just if they share a word within 1 bit of both).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysleuth.llm.common import row_fingerprint, whole_text
from paysleuth.llm.components import connected
from paysleuth.session import materialized

SEED = 42
GENERATOR = 0b110001110101  # of the binary Golay code
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, bits)
_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text: ASCII lower case, words between ASCII white space, XXH64 of shingles, repeats included.

    A bit is 1 if it is set in over half of the shingles' hashes. With fewer words than a shingle the whole sequence
    is the one shingle; without any word the fingerprint is 0.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    digest = xxhash.xxh64_digest
    if len(found) < words:
        hashes = [digest(b" ".join(found), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(found[i:] for i in range(words)), strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        part = np.frombuffer(b"".join(hashes[i : i + _AT_ONCE]), dtype=np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint_column(words: int):
    """Column function: the fingerprint's 64 bits as a long."""

    @F.pandas_udf("long")
    def simhash(text: pd.Series) -> pd.Series:
        bits = np.array([fingerprint(t, words) for t in text], dtype=np.uint64)
        return pd.Series(bits.view(np.int64), index=text.index)

    return simhash


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


def golay_word(number: int) -> int:
    """The code word with this number in its upper 12 bits."""
    return number << 11 ^ _remainder(number << 11)


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(remainder of each byte value at each of three places; per remainder the error patterns of weight 4 or less).

    Patterns are padded to six by repeating the first, which is the one of least weight.
    """
    remainders = np.array([[_remainder((b << 8 * k) & 0x7FFFFF) for b in range(256)] for k in range(3)], dtype=np.int64)
    patterns: dict[int, list[int]] = {}
    for weight in range(5):
        for places in combinations(range(23), weight):
            error = sum(1 << p for p in places)
            patterns.setdefault(_remainder(error), []).append(error)
    table = np.array([(p + p[:1] * 6)[:6] for _, p in sorted(patterns.items())], dtype=np.int64)
    return remainders, table


def near_codewords(words: np.ndarray) -> np.ndarray:
    """For 23-bit words the numbers of the code words within distance 4 (six columns, repeats where there are fewer)."""
    remainders, patterns = golay_tables()
    left = remainders[0][words & 255] ^ remainders[1][words >> 8 & 255] ^ remainders[2][words >> 16]
    return (words[:, None] ^ patterns[left]) >> 11  # the code is systematic: its upper 12 bits are its number


def fuzzy_keys(fingerprints: np.ndarray) -> np.ndarray:
    """18 keys per fingerprint; two fingerprints within 2 bits share at least one."""
    bits = fingerprints.view(np.uint64)
    parts = [((bits >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    keys = []
    for k in range(3):
        exact, near = parts[k], near_codewords(parts[(k + 1) % 3])
        keys.append((np.int64(k) << 40) | (exact[:, None] << 12) | near)
    return np.concatenate(keys, axis=1)


def keys_column():
    @F.pandas_udf("array<long>")
    def keys(fingerprints: pd.Series) -> pd.Series:
        found = fuzzy_keys(fingerprints.to_numpy(dtype=np.int64))
        return pd.Series([np.unique(row) for row in found], index=fingerprints.index)

    return keys


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, radius: int = 2, bucket: int = 128) -> DataFrame:
    """Edges (a, b) between fingerprints at most ``radius`` (1 or 2) bits apart whose components are those of all such links.

    distinct: one column ``fp`` of distinct fingerprints. Buckets of at most ``bucket`` members give all their links;
    for members of larger ones a chain of links through their common neighbours, which connects the same fingerprints.
    """
    if radius not in (1, 2):
        raise ValueError("the code words shared within 2 bits cover a radius of 1 or 2")
    keyed = distinct.select("fp", F.explode(keys_column()("fp")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialized(keyed.join(shared, "key"), "fuzzy-buckets")
    few = members.filter(F.col("n") <= bucket)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
    edges = pairs.filter((F.col("a") < F.col("b")) & (_distance(F.col("a"), F.col("b")) <= radius)).select("a", "b")
    crowded = members.filter(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    if radius == 2:  # a word within 1 bit of both
        around = F.concat(F.array("fp"), F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m)))
    else:  # the two words that differ in bit i share the word with that bit cleared, kept apart by i
        around = F.transform(flips, lambda m: F.xxhash64(m, F.col("fp").bitwiseAND(F.bitwise_not(m)), F.lit(1)))
    near = crowded.select("fp", F.explode(around).alias("word"))
    heads = near.groupBy("word").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = near.join(heads, "word").filter((F.col("fp") != F.col("b")) & (_distance(F.col("fp"), F.col("b")) <= radius))
    return edges.unionByName(stars.select(F.col("fp").alias("a"), "b")).distinct()


def fingerprint_groups(prints: DataFrame, radius: int = 2, bucket: int = 128) -> DataFrame:
    """(fp, first) for each fingerprint that several rows or linked fingerprints share.

    prints: rows with ``fp`` and ``rank``; ``first`` is the smallest rank of the component. Anything orderable is a rank.
    """
    distinct = materialized(
        prints.groupBy("fp").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n")), "fingerprints"
    )
    nodes = connected(links(distinct.select("fp"), radius, bucket)).withColumnRenamed("node", "fp")
    rooted = distinct.join(nodes, "fp", "left").filter(F.col("root").isNotNull() | (F.col("n") > 1))
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("rank").alias("first"))
    return materialized(rooted.join(firsts, "root").select("fp", "first"), "fingerprint-groups")


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    radius: int = 2,
    bucket: int = 128,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    A null text is an empty one. Null ids are never the smallest; a component of null ids only has a null component_id.
    Repeated rows stay repeated. Other columns play no part; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("_text"))
    prints = materialized(rows.select("doc_id", fingerprint_column(words)("_text").alias("fp")), "simhash")
    groups = fingerprint_groups(prints.withColumn("rank", F.col("doc_id")), radius, bucket)
    alone = F.col("_in").isNull()
    return prints.join(groups.withColumn("_in", F.lit(True)), "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first")).alias("component_id"),
    )


def simhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    radius: int = 2,
    bucket: int = 128,
) -> DataFrame:
    """The rows that stay, with all their columns: of each component one row, that of the smallest id.

    Ties (equal ids in one component, repeated rows) go by hashes of the text and of the other columns; null ids lose.
    """
    place = F.struct(F.col(id_col).isNull().alias("_null"), F.col(id_col).alias("_id"), F.xxhash64(whole_text(text_col)).alias("_hash"))
    prints = materialized(
        docs.select(place.alias("rank"), fingerprint_column(words)(whole_text(text_col)).alias("fp")), "simhash"
    )
    groups = fingerprint_groups(prints, radius, bucket)
    # rows that have to go, by (id, hash of the text): those of a component that are not its first
    last = F.col("rank") != F.col("first")
    gone = prints.join(groups, "fp").filter(last).select(F.xxhash64("rank._null", "rank._id").alias("_a"), F.col("rank._hash").alias("_b")).distinct()
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.xxhash64(F.col(id_col).isNull(), F.col(id_col)).alias("_a"),
        F.xxhash64(whole_text(text_col)).alias("_b"),
        row_fingerprint(docs, docs.columns).alias("tie"),
    )
    kept = keyed.join(gone, ["_a", "_b"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("_a", "_b").orderBy("tie"))
    return kept.withColumn("nth", nth).filter("nth = 1").select("row.*")
