"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

A text leaks an item if a window of the item's size (in shingles of five words) has a weighted Jaccard similarity of
0.8 or more with it; a shingle weighs as often as it occurs.

1. Windows. Such a window must share one of ``anchors``: any (1 - 0.8) * size + 1 of the item's shingles. Texts are
   tested against a bit table of the anchors row by row, nothing is shuffled. Of a text and an item that share one, the
   places of all the item's shingles in the text are counted; windows are laid at every start whose window holds as many
   as a similarity of 0.8 needs, in whatever order they stand. Other windows are below 0.8 with every item.
2. SimHash of each distinct window, and of the items.
3. Multi-index: the 64 bits fall into four blocks; within 19 bits at least one block differs in at most 4. Items are
   filed under all block values within 4 bits, windows look up their four block values. All fingerprints within the
   radius meet. (At a similarity of 0.8 the expected distance is about 10 bits, its deviation 3.)
4. The exact similarity of each pair that met decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysleuth.llm.common import whole_text
from paysleuth.session import materialized

BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 4
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BROADCAST_BYTES = 64 << 20


def with_shingles(df: DataFrame, text: Column, k: int) -> DataFrame:
    """``df`` with ``shingles``: hashes of all runs of k words (lower-case runs of letters and digits).

    Of fewer words there is one hash of all, of no words none. Word hashes are a column of their own: an expression
    inside the loop over runs would be evaluated anew in each step.
    """
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    hashed = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("_words") - k), lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(k)])
    )
    none = F.array().cast("array<long>")
    shingles = F.when(F.size("_words") >= k, runs).when(F.size("_words") > 0, F.array(F.xxhash64("_words"))).otherwise(none)
    return hashed.withColumn("shingles", shingles).drop("_words")


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


def simhash_columns(hash_col: str) -> list[Column]:
    """One aggregate for each bit: in how many of the group's hashes it is set."""
    return [F.sum(F.shiftright(F.col(hash_col), i).bitwiseAND(F.lit(1))).alias(f"_b{i}") for i in range(64)]


def simhash_value(count_col: str) -> Column:
    """Bits that are set in over half of the hashes."""
    bits = [F.when(F.col(f"_b{i}") * 2 > F.col(count_col), F.lit(_bit(i))).otherwise(F.lit(0)) for i in range(64)]
    value = bits[0]
    for b in bits[1:]:
        value = value.bitwiseOR(b)
    return value.cast("long")


def _blocks(fp: Column) -> Column:
    """(block number, its bits) of a fingerprint."""
    return F.array(
        *[
            F.struct(
                F.lit(b).alias("block"),
                F.shiftrightunsigned(fp, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("bits"),
            )
            for b in range(BLOCKS)
        ]
    )


def _small(df: DataFrame, cells: Column) -> DataFrame:
    """Broadcast a materialised table if its rows take at most BROADCAST_BYTES; else Spark chooses the join.

    cells: the 8-byte values of a row.
    """
    size = df.agg(F.coalesce(F.sum(8 * cells + 32), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def benchmark_shingles(benchmark: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """item_id, item (number of the distinct text), size, shingles; items without words or with null ids are left out."""
    texts = benchmark.filter(F.col(id_col).isNotNull())
    texts = texts.select(F.col(id_col).alias("item_id"), whole_text(text_col).alias("_text"))
    texts = with_shingles(texts, F.col("_text"), k).drop("_text")
    sized = texts.withColumn("size", F.size("shingles")).filter("size > 0")
    return sized.withColumn("item", F.xxhash64("shingles", F.lit(1)))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    k: int = 5,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    table_bits: int | None = None,
) -> DataFrame:
    """One row per (document, item) that leaks: doc_id, text_hash, item_id, similarity, start, size, distance.

    start is the first word of the most similar window (the first such), size its shingles, distance the bits between
    the fingerprints. Null and empty texts leak nothing, nor do empty items; a text shorter than an item is one window.
    Texts or items of fewer than ``k`` words are a single shingle, so they match only as a whole. Repeated rows give one
    row; items of equal words give a row each. Other columns play no part.
    """
    items = materialized(
        benchmark_shingles(benchmark, item_col, item_text_col, k), "benchmark-items"
    )
    distinct = items.select("item", "size", "shingles").dropDuplicates(["item", "size"])
    placed = distinct.select("item", "size", F.posexplode("shingles").alias("offset", "h"))
    # anchors: of each item its (1 - similarity) * size + 1 rarest distinct shingles; ties by hash
    rarity = placed.groupBy("h").agg(F.count(F.lit(1)).alias("_seen"))
    first = placed.join(rarity, "h").groupBy("item", "size", "h").agg(F.first("_seen").alias("_seen"))
    needed = F.col("size") - F.ceil(F.col("size") * similarity) + 1
    order = Window.partitionBy("item", "size").orderBy("_seen", "h")
    anchors = first.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= needed)
    anchors = materialized(anchors.select("h", "item", "size"), "benchmark-anchors")

    count = anchors.select("h").distinct().count()
    bits = table_bits or min(24, max(12, math.ceil(math.log2(max(count, 1) * 256))))

    def slots_of(h: Column) -> list[Column]:
        """The two places of a hash in the table."""
        return [F.shiftrightunsigned(h, by).bitwiseAND(F.lit((1 << bits) - 1)) for by in (0, 32)]

    slots = anchors.select(F.explode(F.array(*slots_of(F.col("h")))).alias("slot")).distinct()
    words64 = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))).alias("v")
    )
    table = [0] * (1 << max(bits - 6, 0))
    for r in words64.collect():  # the table's size is fixed by ``bits``, 2 MB at most
        table[r["w"]] = r["v"]
    known = F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>")  # folded to one constant

    def marked(h: Column) -> Column:
        def set_at(slot: Column) -> Column:
            word = F.get(known, F.shiftright(slot, 6).cast("int"))
            return F.call_function("shiftright", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

        first, second = slots_of(h)
        return set_at(first) & set_at(second)

    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(whole_text(text_col)).alias("text_hash"),
        whole_text(text_col).alias("_text"),
    )
    texts = with_shingles(texts, F.col("_text"), k)
    # rows that hold no anchor end here, before anything moves; a filter would be pushed down and hash the text again
    anchored = F.when(F.exists("shingles", marked), F.array("shingles"))
    near = materialized(texts.select("doc_id", "text_hash", F.explode(anchored).alias("shingles")), "anchored-texts")
    # from here on by distinct text; its documents come back at the end
    owners = near.select("doc_id", "text_hash").distinct()
    bodies = materialized(near.select("text_hash", "shingles").dropDuplicates(["text_hash"]), "anchored-bodies")
    hits = bodies.select("text_hash", F.explode(F.filter(F.array_distinct("shingles"), marked)).alias("h"))
    asked = hits.join(_small(anchors, F.lit(3)), "h").select("text_hash", "item", "size").distinct()
    # an upper bound of what text and item have in common, before places are looked at
    wanted = distinct.select("item", "size", F.col("shingles").alias("_item"))
    pairs = asked.join(_small(wanted, F.col("size") + 2), ["item", "size"]).join(bodies, "text_hash")
    length = F.least(F.size("shingles"), F.col("size"))
    fewest = F.ceil((length + F.col("size")) * (similarity / (1 + similarity)) - 1e-9).cast("int")
    shared = F.size(F.array_intersect("shingles", "_item")) + F.col("size") - F.size(F.array_distinct("_item"))
    pairs = pairs.withColumns({"_fewest": fewest, "_last": F.greatest(F.size("shingles") - F.col("size"), F.lit(0))})
    pairs = materialized(pairs.filter(shared >= F.col("_fewest")).drop("_item"), "decontamination-pairs")
    # a shingle of the item at pos counts in the windows that start at pos - size + 1 .. pos; windows with enough are laid
    at = pairs.select("text_hash", "item", "size", "_fewest", "_last", F.posexplode("shingles").alias("pos", "h"))
    at = at.join(placed.select("item", "size", "h").distinct(), ["item", "size", "h"])
    change = F.array(
        F.struct(F.greatest(F.col("pos") - F.col("size") + 1, F.lit(0)).alias("at"), F.lit(1).alias("by")),
        F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("by")),
    )
    key = ["text_hash", "item", "size", "_fewest", "_last"]
    steps = at.select(*key, F.explode(change).alias("_c")).groupBy(*key, "_c.at").agg(F.sum("_c.by").alias("by"))
    along = Window.partitionBy("text_hash", "item", "size").orderBy("at")
    steps = steps.withColumns({"_held": F.sum("by").over(along), "_next": F.lead("at").over(along)})
    steps = steps.filter((F.col("_held") >= F.col("_fewest")) & (F.col("at") <= F.col("_last")))
    to = F.least(F.col("_next") - 1, F.col("_last"))
    starts = steps.select("text_hash", "size", F.explode(F.sequence(F.col("at"), to)).alias("start")).distinct()
    cut = starts.join(bodies, "text_hash").withColumn("window", F.slice("shingles", F.col("start") + 1, F.col("size")))
    cut = cut.withColumns({"w1": F.xxhash64("window"), "w2": F.xxhash64(F.lit(2), "window")})
    windows = materialized(cut.select("text_hash", "size", "start", "w1", "w2", "window"), "windows")
    contents = windows.groupBy("size", "w1", "w2").agg(F.first("window").alias("window"))
    spread = contents.select("size", "w1", "w2", F.size("window").alias("n"), F.explode("window").alias("h"))
    prints = spread.groupBy("size", "w1", "w2", "n").agg(*simhash_columns("h"))
    prints = prints.select("size", "w1", "w2", "n", simhash_value("n").alias("fp"))
    item_prints = placed.groupBy("item", "size").agg(*simhash_columns("h"))
    item_prints = item_prints.select("item", "size", simhash_value("size").alias("item_fp"))

    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda m: F.bit_count(m) <= BLOCK_RADIUS)
    filed = item_prints.select("item", "size", "item_fp", F.explode(_blocks(F.col("item_fp"))).alias("_k"))
    filed = filed.select("item", "size", "item_fp", "_k.block", F.col("_k.bits").alias("_bits"), F.explode(masks).alias("_m"))
    filed = filed.select("item", "size", "item_fp", "block", F.col("_bits").bitwiseXOR(F.col("_m")).alias("bits"))
    looked = prints.select("size", "w1", "w2", "n", "fp", F.explode(_blocks(F.col("fp"))).alias("_k"))
    looked = looked.select("size", "w1", "w2", "n", "fp", "_k.block", "_k.bits")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    # thousands of rows an item, which Spark's estimate does not see: the table is never to be broadcast
    met = looked.join(filed.hint("merge"), ["size", "block", "bits"]).withColumn("distance", distance)
    met = met.filter(F.col("distance") <= RADIUS).select("size", "w1", "w2", "n", "item", "distance").distinct()

    weighed = spread.groupBy("size", "w1", "w2", "h").agg(F.count(F.lit(1)).alias("cw"))
    item_weights = placed.groupBy("item", "size", "h").agg(F.count(F.lit(1)).alias("ci"))
    common = (
        met.join(weighed, ["size", "w1", "w2"])
        .join(item_weights, ["item", "size", "h"])
        .groupBy("size", "w1", "w2", "n", "item", "distance")
        .agg(F.sum(F.least("cw", "ci")).alias("m"))
    )
    exact = F.col("m") / (F.col("n") + F.col("size") - F.col("m"))
    leaking = common.select("size", "w1", "w2", "item", "distance", exact.alias("similarity"))
    leaking = leaking.filter(F.col("similarity") >= similarity)
    found = windows.drop("window").join(leaking, ["size", "w1", "w2"]).join(owners, "text_hash").join(items.select("item_id", "item", "size"), ["item", "size"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("_early"), "size", "distance")).alias("_best")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best).select(
        "doc_id",
        "text_hash",
        "item_id",
        F.col("_best.similarity").alias("similarity"),
        (-F.col("_best._early")).alias("start"),
        F.col("_best.size").alias("size"),
        F.col("_best.distance").cast("int").alias("distance"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters
) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns, whatever their names.

    Null and empty texts leak nothing; repeated rows and rows of one id and text share their fate, a null id is a value
    like any other. An empty table of either kind changes nothing.
    """
    leaks = materialized(find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **parameters), "leaks")
    gone = leaks.select(F.col("text_hash").alias("_hash"), F.col("doc_id").alias("_id")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(whole_text(text_col)).alias("hash"), F.col(id_col).alias("id"))
    same = (keyed["hash"] == gone["_hash"]) & keyed["id"].eqNullSafe(gone["_id"])
    return keyed.join(gone, same, "left_anti").select("row.*")
