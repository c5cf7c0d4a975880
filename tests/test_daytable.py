import numpy as np
import pytest
from pyspark.sql import functions as F

from paysleuth.sources import daytable, streams
from paysleuth.sources.daytable import DayTable


def shown(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def rows(make):
    return make([{"id": f"t{i:04d}", "minute": 97 * i, "user": f"u{i % 7}"} for i in range(300)])  # 20 days


def test_inserts_are_replay_safe_and_open_few_files(rows, spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), rows.schema)
    parts = [rows.filter(F.substring("transaction_id", 2, 4).cast("int").between(50 * k, 50 * k + 49)) for k in range(6)]
    assert [table.insert(p, k) for k, p in enumerate(parts)] == [50] * 6
    assert table.opened == []  # no file can hold the new ids
    assert table.insert(parts[2], 2) == 0 and table.insert(parts[2]) == 0  # the same batch, the same rows in another
    assert 0 < len(table.opened) <= 6
    files = spark.read.option("recursiveFileLookup", "true").parquet(f"{table.path}/data").inputFiles()
    assert len(table.opened) < len(files) / 3
    mixed = parts[1].limit(3).unionByName(parts[0].limit(2).withColumn("transaction_id", F.concat(F.lit("new"), "transaction_id")))
    assert table.insert(mixed) == 2
    assert table.read().count() == 302 and shown(table.read().drop("event_date").filter("transaction_id < 'u' AND transaction_id LIKE 't%'")) == shown(rows)


def test_a_stream_feeds_the_table_once(rows, spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        rows.filter(F.col("user_id").isin(f"u{2 * k}", f"u{2 * k + 1}")).coalesce(1).write.mode("append").parquet(source)
    table = DayTable(spark, str(tmp_path / "t"), rows.schema)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # a second run without its offsets: the same batches again
        streams.run_batches(stream, table.insert, str(tmp_path / f"offsets{_}"))
    assert shown(table.read().drop("event_date")) == shown(rows.filter("user_id != 'u6'"))


def test_compaction_rewrites_new_days_only(rows, spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), rows.schema)
    table.insert(rows.filter("user_id != 'u3'"), 0)
    before, version = shown(table.read()), table.version()
    first = table.compact("2025-01-30 00:00:00")
    assert len(first) > 3 and shown(table.read()) == before and table.version() == version + 1
    assert table.compact("2025-01-30 00:00:00") == [] and table.version() == version + 1
    assert shown(table.read(version=version)) == before  # the old version can still be read
    later = table.compact("2025-02-02 00:00:00")
    assert later and not set(later) & set(first)
    late = rows.filter("user_id = 'u3'").filter(F.col("timestamp") < F.lit("2025-01-17").cast("timestamp"))
    table.insert(late, 1)
    assert set(table.compact("2025-02-02 00:00:00")) <= set(first)
    assert table.read().count() == rows.filter("user_id != 'u3'").count() + late.count()
    assert table.insert(rows.filter("user_id != 'u3'")) == 0  # compacted rows are known as well
    day = table.read("2025-01-16 00:00:00", "2025-01-16 23:00:00")
    assert {str(r[0]) for r in day.select("event_date").distinct().collect()} == {"2025-01-16"}


def test_a_write_that_fails_before_its_commit_is_never_read(rows, spark, tmp_path, monkeypatch):
    table = DayTable(spark, str(tmp_path / "t"), rows.schema)
    table.insert(rows.limit(100), 0)
    monkeypatch.setattr(table, "_point_to", lambda version: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.insert(rows, 1)
    monkeypatch.undo()
    assert table.read().count() == 100 and table.insert(rows, 1) == 200 and table.read().count() == 300


def test_bloom_bits_hold_all_members_and_few_others():
    rng = np.random.default_rng(1)
    own, other = rng.integers(-(2**62), 2**62, 5000), rng.integers(-(2**62), 2**62, 2000)
    bits = daytable._bloom(own)
    assert all(daytable._may_hold(bits, own[i : i + 1]) for i in range(0, 5000, 7))
    assert sum(daytable._may_hold(bits, other[i : i + 1]) for i in range(2000)) < 40
    assert not daytable._may_hold(daytable._bloom(own[:0]), other[:5])
