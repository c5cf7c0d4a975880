import zlib

from paysleuth.llm.sharding import shard_rows, write_shards


def test_every_row_has_one_slot_and_shards_are_even(spark, awkward):
    rows = [tuple(r) for r in awkward.collect()] + [(i % 900, f"text {i % 7} " * (i % 50), "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, awkward.schema)
    got = shard_rows(docs, least_ranges=40).collect()
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows if i is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == want
    assert len(got) == len(rows)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(16):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 16) <= largest
    assert shard_rows(docs.limit(0)).count() == 0


def test_one_key_with_most_rows_is_cut(spark):
    docs = spark.createDataFrame([(7, f"t{i:04d}") for i in range(4000)], "doc_id long, text string")
    got = shard_rows(docs, least_ranges=64).groupBy("shard").count().collect()
    assert len(got) == 16 and max(r["count"] for r in got) - min(r["count"] for r in got) <= 1


def test_written_shards_hold_the_records(spark, awkward, tmp_path):
    write_shards(awkward.dropDuplicates(), str(tmp_path / "s"), shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == awkward.dropDuplicates().count() and {"shard", "slot", "kept"} <= set(back.columns)


def test_columns_named_like_ours_come_back(spark, tmp_path):
    rows = [(i, f"text {i}", 100 + i, 200 + i, 300 + i) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long, slot long, _at long")
    write_shards(docs, str(tmp_path / "s"), shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(tuple(r) for r in back.select(*docs.columns).collect()) == rows
    assert back.select("_shard").distinct().count() == 3 and "_slot" in back.columns
