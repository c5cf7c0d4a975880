"""Near-duplicates by similarity, found by Golay-code fuzzy hashing of wide SimHash fingerprints.

Texts are near-duplicates if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Fingerprint. A text's distinct shingles vote on each of ``24 * segments`` bits. At a similarity of 0.8 about 15 % of the
   bits differ, which no exact part of a fingerprint survives.
2. Keys. Each segment of 24 votes is decoded to the two nearest code words of the extended Golay code, nearest by the
   weight of the votes, so doubtful bits give way first. A key is the numbers of the nearest code words of
   ``per_key`` segments, or of all but one and the second nearest of that one: a few keys for each group of segments.
   Two texts at 0.8 share one of a group's keys with a probability of about a quarter, those at 0.9 of a half, so
   among twenty groups they nearly always meet. Unrelated texts meet by chance; longer keys keep that rare as
   the table grows.
3. Pairs. In a bucket of texts with a common key every text is paired with a head, the one that shares most with others,
   and in buckets of up to ``bucket`` texts all are paired. What differs in too many bits of the fingerprint goes
   before any shingles move; the exact similarity of the rest decides. Heads come first; in small buckets only pairs
   that these have not brought into one component are left.
4. Larger buckets go on with one representative for each component: heads against all others, round by round, or
   all of them once they are few. All texts of crowded buckets that still hold several components then meet through
   their rarest shingles: texts at 0.8 share one among the first fifth of each, in any common order. Buckets of these go
   the same way; where components stay apart in a crowded one, all pairs across them are compared, block by block.

Found links are exact. What can be missed is measured in the tests and stated in the README.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paysleuth.llm.common import BitTable, Scratch, row_fingerprint, whole_text
from paysleuth.llm.components import connected
from paysleuth.llm.simhash_dedup import golay_word

WIDTH = 24  # votes to a segment
GROUPS = {2: 20, 3: 44, 4: 96}  # groups of segments, by segments to a key
MOST_TEXTS = {2: 500_000, 3: 200_000_000}  # up to so many texts; beyond, the next
SAMPLE_ROWS, MOST_COMMON, COMMON_FROM = 20_000, 200_000, 4
BLOCK = 1024  # members of a bucket that are paired with the others in one group
_DOCS = 12  # texts decoded together


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def runs(words: list[bytes], k: int) -> list[bytes]:
    """All runs of k words; the whole of fewer; nothing of none."""
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return [b" ".join(r) for r in zip(*(words[i:] for i in range(k)), strict=False)]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of the distinct runs of words, ascending."""
    return np.unique(np.array([xxhash.xxh64_intdigest(r) for r in runs(words_of(text), words)], dtype=np.uint64))


@lru_cache(maxsize=1)
def code_words() -> np.ndarray:
    """The 4096 words of the extended Golay code as rows of +1 and -1."""
    words = [golay_word(n) for n in range(4096)]
    words = [w | (w.bit_count() & 1) << 23 for w in words]
    return np.array([[1.0 if w >> i & 1 else -1.0 for i in range(WIDTH)] for w in words], dtype=np.float32)


def votes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """For each bit how many of the hashes set it, less how many do not. Each hash is drawn out to ``bits`` bits."""
    steps = np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(bits, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        z = hashes[i : i + 4096, None] + steps
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z ^= z >> np.uint64(shift)
            z *= np.uint64(factor)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * ones - len(hashes)


def fuzzy_keys(tallies: np.ndarray, per_key: int) -> np.ndarray:
    """Keys of texts (rows of votes): for each group of segments per_key + 1 of them."""
    segments = tallies.reshape(-1, WIDTH).astype(np.float32)
    near = segments @ code_words().T
    first = near.argmax(axis=1)
    near[np.arange(len(near)), first] = -np.inf
    second = near.argmax(axis=1)
    shape = (len(tallies), -1, per_key)
    first, second = first.reshape(shape), second.reshape(shape)
    keys = []
    for instead in range(-1, per_key):
        key = np.broadcast_to(np.arange(first.shape[1]), first.shape[:2]).astype(np.int64)
        for k in range(per_key):
            key = (key << 12) | (second if k == instead else first)[:, :, k]
        keys.append(key)
    return np.concatenate(keys, axis=1)


def segments_to_a_key(texts: int) -> int:
    return next((k for k, most in MOST_TEXTS.items() if texts <= most), max(GROUPS))


def fingerprint_bits(per_key: int) -> int:
    return -(-GROUPS[per_key] * per_key * WIDTH // 64) * 64


def sketch_column(words: int, per_key: int):
    """Column function: size (distinct shingles), bits of the fingerprint, keys; the one key -1 for a text without words."""
    used = GROUPS[per_key] * per_key * WIDTH
    bits = fingerprint_bits(per_key)

    @F.pandas_udf("size int, bits array<long>, keys array<long>")
    def sketch(text: pd.Series) -> pd.DataFrame:
        sizes, prints, keys = [], [], []
        for i in range(0, len(text), _DOCS):
            hashes = [shingle_hashes(t, words) for t in text.iloc[i : i + _DOCS]]
            tallies = np.stack([votes(h, bits) for h in hashes])
            prints += list(np.packbits(tallies > 0, axis=1).view(np.int64))
            decoded = fuzzy_keys(tallies[:, :used], per_key)
            keys += [k if len(h) else np.array([-1]) for k, h in zip(decoded, hashes, strict=True)]
            sizes += [len(h) for h in hashes]
        return pd.DataFrame({"size": pd.Series(sizes, dtype="int32"), "bits": pd.Series(prints, dtype="object"), "keys": pd.Series(keys, dtype="object")})

    return sketch


def most_bits(least: float, bits: int) -> int:
    """Differing bits that a pair of that similarity exceeds with a probability below 1e-11."""
    share = math.acos(min(1.0, 2 * least / (1 + least))) / math.pi
    return math.ceil(bits * share + 7 * math.sqrt(bits * share * (1 - share)) + 1)


def hashes_of(rows: DataFrame, words: int, asked: BitTable) -> DataFrame:
    """node, hashes of the text's distinct shingles, ascending; of nodes that may be asked for. rows: node, text.

    One function for both: a second one, or a filter on its result, would take a second Python worker for each task.
    """

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some = batch[asked.held(batch["node"])]
            found = [shingle_hashes(t, words).view(np.int64) for t in some["text"]]
            yield pd.DataFrame({"node": some["node"], "hashes": pd.Series(found, index=some.index, dtype="object")})

    return rows.select("node", "text").mapInPandas(hashes, "node long, hashes array<long>")


def jaccard(a: str, b: str) -> Column:
    """The Jaccard similarity of two columns of shingle hashes; 1 for two texts without words."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(1.0)


def common_shingles(bodies: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, how often) of the shingles that a sample of the texts holds most often. bodies: node, hashes."""
    every = -(-bodies.count() // SAMPLE_ROWS) or 1
    sample = bodies.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0)
    counts = sample.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = counts.filter(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "h").limit(MOST_COMMON).toPandas()
    h, n = top["h"].to_numpy(dtype=np.int64).view(np.uint64), top["n"].to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def rare_keys_column(least: float, common: tuple[np.ndarray, np.ndarray], spark: SparkSession):
    """Column function of shingle hashes: a text's rarest, as many as hold one of any text of at least that similarity.

    The order puts shingles that a sample holds often last, the others go by hash; any order gives the same guarantee.
    """
    shared = spark.sparkContext.broadcast(common)

    @F.pandas_udf("array<long>")
    def keys(hashes: pd.Series) -> pd.Series:
        known, often = shared.value
        found = []
        for own in hashes:
            h = np.asarray(own, dtype=np.int64).view(np.uint64)
            seen = np.zeros(len(h), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                seen = np.where(known[at] == h, often[at], 0)
            first = np.lexsort((h, seen))[: len(h) - math.ceil(least * len(h) - 1e-9) + 1]
            found.append(h[first].view(np.int64) if len(h) else np.zeros(1, dtype=np.int64))
        return pd.Series(found, index=hashes.index, dtype="object")

    return keys


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def with_shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows whose key several rows have, with n, how many. keyed: node, key and others."""
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(shared, "key").select(*keyed.columns, "n")


def _with_pull(members: DataFrame) -> DataFrame:
    """``pull``: how many members all buckets of the node have; the text in the middle of a group has the most."""
    return members.withColumn("pull", F.sum("n").over(Window.partitionBy("node")))


def _starred(members: DataFrame) -> DataFrame:
    """Pairs of each member with its bucket's head."""
    heads = members.groupBy("key").agg(F.max(F.struct("pull", "node")).alias("_h")).select("key", F.col("_h.node").alias("head"))
    pairs = members.join(heads, "key").filter(F.col("node") != F.col("head"))
    return pairs.select(*_ordered(F.col("node"), F.col("head"))).distinct()


def _paired(members: DataFrame) -> DataFrame:
    """All pairs of different components inside the buckets. members: key, node, root."""
    left, right = (members.select("key", F.col("node").alias(f"_{x}"), F.col("root").alias(f"_r{x}")) for x in "xy")
    across = (left["key"] == right["key"]) & (F.col("_x") > F.col("_y")) & (F.col("_rx") != F.col("_ry"))
    return left.join(right, across).select(F.col("_x").alias("a"), F.col("_y").alias("b")).distinct()


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members with the root of their component."""
    return members.join(connected(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))


class Linker:
    """Pairs to links: by the fingerprints first, then by the shingles.

    prints: node, size, bits; bodies: node (unique), hashes.
    """

    def __init__(self, prints: DataFrame, least: float, per_key: int, scratch: Scratch):
        self.prints, self.least, self.scratch = prints, least, scratch
        self.limit = most_bits(least, fingerprint_bits(per_key))
        self.bodies: DataFrame | None = None

    def close(self, size_a: Column, size_b: Column, bits_a: Column, bits_b: Column) -> Column:
        """Whether sizes and fingerprints allow the similarity."""
        differing = F.aggregate(F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return (F.least(size_a, size_b) >= self.least * F.greatest(size_a, size_b) - 1e-9) & (differing <= self.limit)

    def first_shared(self, size_a: Column, size_b: Column, rest_a: Column, rest_b: Column) -> Column:
        """Whether a key can be the first of its order that two texts of the similarity share.

        Then they share nothing before it: what is left of the shorter rest must hold all they have in common. A pair
        that is similar enough passes at the first key it shares, so others need not bring it together again.
        """
        needed = (size_a + size_b) * self.least / (1 + self.least)
        return F.least(rest_a, rest_b) >= needed - 1e-9

    def across(self, members: DataFrame) -> DataFrame:
        """All possible pairs of different components inside the buckets, of any size. members: key, node, n, root.

        A bucket is cut into blocks, each a group of its own against the whole bucket; what is not close enough goes
        before any shuffle. members also: place of the key among the node's, in the common order of all texts.
        """
        blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")
        light = members.withColumn("_blocks", blocks).join(self.prints, "node")
        light = light.withColumn("rest", F.col("size") - F.col("place"))

        def side(x: str, block: Column) -> DataFrame:
            return light.select("key", block.alias("_block"), *[F.col(c).alias(f"_{c}{x}") for c in ("node", "root", "size", "rest", "bits")])

        left = side("a", F.pmod(F.xxhash64("node"), F.col("_blocks")))
        right = side("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        apart = (F.col("_nodea") > F.col("_nodeb")) & (F.col("_roota") != F.col("_rootb"))
        pairs = left.join(right, ["key", "_block"]).filter(apart)
        pairs = pairs.filter(self.first_shared(F.col("_sizea"), F.col("_sizeb"), F.col("_resta"), F.col("_restb")))
        pairs = pairs.filter(self.close(F.col("_sizea"), F.col("_sizeb"), F.col("_bitsa"), F.col("_bitsb")))
        return pairs.select(F.col("_nodea").alias("a"), F.col("_nodeb").alias("b")).distinct()

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and fingerprints allow the similarity."""
        for side in ("a", "b"):
            light = self.prints.select(F.col("node").alias(side), F.col("size").alias(f"_s{side}"), F.col("bits").alias(f"_f{side}"))
            pairs = pairs.join(light, side)
        close = self.close(F.col("_sa"), F.col("_sb"), F.col("_fa"), F.col("_fb"))
        return pairs.filter(close).select("a", "b").distinct()

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the similarity or more, as a table."""
        for side in ("b", "a"):
            pairs = pairs.join(self.bodies.select(F.col("node").alias(side), F.col("hashes").alias(f"_h{side}")), side)
        return self.scratch.table(pairs.filter(jaccard("_ha", "_hb") >= self.least).select("a", "b"), "near-links")


def _crowded_apart(members: DataFrame, edges: DataFrame, bucket: int) -> DataFrame:
    """The members of crowded buckets that hold more than one component, with their root."""
    labelled = _labelled(members.filter(F.col("n") > bucket), edges)
    several = labelled.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo < _hi")
    return labelled.join(several.select("key"), "key").select(*members.columns, "root")


def crowded_links(members: DataFrame, edges: DataFrame, linker: Linker, bucket: int, rounds: int) -> DataFrame:
    """Edges with those found in crowded buckets; the rounds join most of what belongs together, not all.

    members: node, key, n, pull. Each bucket takes part with one representative of each component, the one of
    most pull: the head of the round against all others, all of them when they are at most ``bucket``.
    """
    scratch = linker.scratch
    labelled = _labelled(members, edges)
    best = F.max(F.struct("pull", "node")).alias("_best")
    state = labelled.groupBy("key", "root").agg(best, F.max("n").alias("n")).filter(F.col("n") > bucket)
    state = scratch.table(state.select("key", "root", F.col("_best.pull").alias("pull"), F.col("_best.node").alias("node")), "crowded")
    tried = scratch.table(edges, "tried-pairs")
    for _ in range(rounds):
        several = state.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        live = scratch.table(state.join(several, "key"), "crowded-open")
        if live.isEmpty():
            return edges
        few, many = live.filter(F.col("c") <= bucket), live.filter(F.col("c") > bucket)
        # a head that was compared with all others gives way to the next
        free = many.withColumn("pull", F.xxhash64("key", "node", F.lit(_))) if _ else many
        pairs = _paired(few).unionByName(_starred(free)).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, "crowded-pairs")
        if pairs.isEmpty():
            return edges
        found = linker.links(linker.possible(pairs))
        tried = scratch.table(tried.unionByName(pairs), "tried-pairs")
        if not found.isEmpty():
            edges = scratch.table(edges.unionByName(found), "near-edges")
            roots = connected(edges)
            moved = live.join(roots.withColumnRenamed("root", "_to"), "node", "left").withColumn("root", F.coalesce("_to", "root"))
            best = F.max(F.struct("pull", "node")).alias("_best")
            state = moved.groupBy("key", "root").agg(best).select("key", "root", F.col("_best.pull").alias("pull"), F.col("_best.node").alias("node"))
            state = scratch.table(state, "crowded")
        else:
            state = live.drop("c")
    return edges


def near_links(prints: DataFrame, bodies_of, least: float, per_key: int, bucket: int, rounds: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) of similarity ``least`` or more, whose components are those of the near-duplicates.

    prints: node, size, bits, keys; bodies_of: nodes (a table of node) -> their shingles (node, hashes).
    """
    linker = Linker(prints.select("node", "size", "bits"), least, per_key, scratch)
    members = scratch.table(_with_pull(with_shared_keys(prints.select("node", F.explode("keys").alias("key")))), "shared-keys")
    star = scratch.table(linker.possible(_starred(members)), "head-pairs")
    ends = star.select(F.explode(F.array("a", "b")).alias("node"))
    linker.bodies = bodies_of(ends.unionByName(members.filter(F.col("n") > bucket).select("node")).distinct())
    edges = linker.links(star)
    # what the heads have joined needs no pairs of its own
    small = scratch.table(_labelled(members.filter(F.col("n") <= bucket), edges), "small-buckets")
    rest = scratch.table(linker.possible(_paired(small)).join(star, ["a", "b"], "left_anti"), "bucket-pairs")
    ends = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    more = bodies_of(ends.join(linker.bodies.select("node"), "node", "left_anti"))
    linker.bodies = linker.bodies.unionByName(more)
    edges = scratch.table(edges.unionByName(linker.links(rest)), "near-edges")
    edges = crowded_links(members, edges, linker, bucket, rounds)
    apart = scratch.table(_crowded_apart(members, edges, bucket).select("node").distinct(), "crowded-apart")
    if not apart.isEmpty():
        bodies = scratch.table(linker.bodies.join(apart, "node"), "crowded-bodies")
        keys = rare_keys_column(least, common_shingles(bodies), prints.sparkSession)
        members = with_shared_keys(bodies.select("node", F.posexplode(keys("hashes")).alias("place", "key")))
        members = scratch.table(_with_pull(members), "rare-keys")
        small = _labelled(members.filter(F.col("n") <= bucket), edges)
        pairs = _starred(members).unionByName(_paired(small)).distinct()
        edges = scratch.table(edges.unionByName(linker.links(linker.possible(pairs))), "near-edges")
        edges = crowded_links(members, edges, linker, bucket, rounds)
        rest = scratch.table(linker.across(_crowded_apart(members, edges, bucket)), "crowded-rest")
        if not rest.isEmpty():
            edges = scratch.table(edges.unionByName(linker.links(rest)), "near-edges")
    return edges


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    bucket: int = 16,
    rounds: int = 8,
    per_key: int | None = None,
) -> DataFrame:
    """The rows that stay, with all their columns: of each component of near-duplicates the row of the smallest id.

    Ties of ids go by hashes of text and other columns; null ids lose to any id. A null text is an empty one; texts
    without words are duplicates of each other, texts of fewer than ``words`` words are one shingle. Of repeated rows
    one stays. An empty table gives an empty result. Columns of any name are kept as they are.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text, given = whole_text(text_col), F.col(id_col)
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.xxhash64(given.isNull(), given, text).alias("node"),
        F.struct(given.isNull().alias("null"), given.alias("id"), F.xxhash64(F.lit(1), text).alias("check")).alias("rank"),
        row_fingerprint(docs, docs.columns).alias("tie"),
        text.alias("text"),
    )
    per_key = per_key or segments_to_a_key(docs.count())
    sketched = rows.select("node", "rank", sketch_column(words, per_key)("text").alias("s"))
    prints = scratch.table(sketched.select("node", "rank", "s.size", "s.bits", "s.keys"), "sketches")

    def bodies_of(nodes: DataFrame) -> DataFrame:
        nodes = scratch.table(nodes, "near-nodes")
        some = hashes_of(rows, words, BitTable.of(nodes, "node"))
        return scratch.table(some.join(nodes, "node").dropDuplicates(["node"]), "near-bodies")

    edges = near_links(prints, bodies_of, similarity, per_key, bucket, rounds, scratch)
    nodes = connected(edges).join(prints.select("node", "rank"), "node")
    firsts = nodes.groupBy("root").agg(F.min("rank").alias("first"))
    gone = nodes.join(firsts, "root").filter(F.col("rank") != F.col("first")).select("node", "rank.check").distinct()
    twins = prints.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    gone, twins = scratch.table(gone, "near-gone"), scratch.table(twins, "repeated-rows")
    scratch.drop_all_but(gone, twins)
    # most rows are in neither table and stay without moving
    asked = BitTable.of(gone.select("node").unionByName(twins), "node").column()
    sure = rows.filter(~asked("node")).select("row.*")
    checked = rows.filter(asked("node")).withColumn("check", F.col("rank.check")).join(gone, ["node", "check"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("node", "check").orderBy("tie"))
    checked = checked.withColumn("nth", nth).filter("nth = 1").select("row.*")
    return sure.unionByName(checked).select(*docs.columns)
