import random

import pytest
from helpers import TINY

from paysleuth.plans import ordered
from paysleuth.plans.ordered import SplitPolicy, exact_quantiles, global_index, keys_at_ranks, running
from paysleuth.plans.sizing import as_lookup, estimated_bytes

POLICIES = [ordered.DEFAULT_POLICY, TINY, SplitPolicy(rows_per_segment=1, max_segments=7)]


@pytest.mark.parametrize("policy", POLICIES)
@pytest.mark.parametrize("kind", ["long", "string", "double", "struct"])
def test_running_by_group(spark, policy, kind):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, rng.randrange(100)) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i long, v long")
    key = {
        "long": "i",
        "string": "lpad(cast(i as string), 5, '0')",
        "double": "cast(i as double) / 7",
        "struct": "struct(i div 10 as a, i as b)",
    }[kind]
    df = df.selectExpr("g", "i", "v", f"{key} AS k")
    got = running(df, ["g"], "k", {"s": ("sum", "v"), "m": ("max", "v"), "l": ("min", "v")}, policy=policy)
    for r in got.collect():
        prior = [v for g, i, v in rows if g == r["g"] and i < r["i"]]
        assert r["s"] == (sum(prior) if prior else None)
        assert r["m"] == max(prior, default=None)
        assert r["l"] == min(prior, default=None)
    assert got.count() == 200


@pytest.mark.parametrize("policy", POLICIES)
def test_global_index(spark, policy):
    rows = [(i % 7, f"x{i:04d}") for i in range(150)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    got = {(r["a"], r["b"]): r["row_index"] for r in global_index(df, ["a", "b"], policy=policy).collect()}
    assert [got[k] for k in sorted(rows)] == list(range(150))


@pytest.mark.parametrize("policy", POLICIES)
def test_order_of_hashes_is_numbered_without_writing_the_rows(spark, policy, monkeypatch):
    ends = [-(2**63), -(2**63) + 1, -1, 0, 1, 2**63 - 1]
    keyed = spark.range(150).selectExpr("id", "xxhash64(id) AS h")
    df = keyed.unionByName(spark.createDataFrame([(200 + i, h) for i, h in enumerate([*ends, 0])], "id long, h long")).repartition(5)
    want = {r["id"]: r["row_index"] for r in global_index(df, ["h", "id"], policy=policy).collect()}
    monkeypatch.setattr(ordered, "materialized", None)
    got = ordered.hashed_index(df, "h", ["id"], "at", 157, policy)
    assert {r["id"]: r["at"] for r in got.collect()} == want and got.columns == ["id", "h", "at"]
    assert ordered.hashed_index(df.limit(0), "h", ["id"], "at", 0, policy).isEmpty()


@pytest.mark.parametrize("policy", POLICIES)
def test_exact_quantiles(spark, policy):
    import numpy as np

    rng = random.Random(2)
    rows = [("hot" if i % 3 else "b", float(rng.randrange(15))) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    for r in exact_quantiles(df, ["g"], "v", points, policy).collect():
        values = [v for g, v in rows if g == r["g"]]
        assert [r[n] for n in points] == pytest.approx([np.quantile(values, q) for q in points.values()])
    (whole,) = exact_quantiles(df, [], "v", points, policy).collect()
    assert list(whole) == pytest.approx([np.quantile([v for _, v in rows], q) for q in points.values()])


def test_segments_are_bounded_and_cover_hot_groups(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id as string) END AS g", "id AS k")
    policy = SplitPolicy(rows_per_segment=100, max_segments=64)
    assert [tuple(h) for h in ordered.large_groups(df, ["g"], policy)] == [("hot", 1667)]
    cut, split = ordered.with_segments(df, ["g"], "k", policy)
    assert split
    sizes = [r["count"] for r in cut.filter("g = 'hot'").groupBy("_seg").count().collect()]
    assert sum(sizes) == 1667 and len(sizes) > 8 and max(sizes) < 400
    assert cut.filter("g <> 'hot' AND _seg <> 0").count() == 0


def test_many_large_groups_stay_out_of_the_driver(spark, monkeypatch):
    policy = SplitPolicy(rows_per_segment=4, max_segments=8)
    df = spark.range(6000).selectExpr("id % 600 AS g", "id AS k", "1L AS v")
    df = df.unionByName(spark.range(5000).selectExpr("1000L AS g", "10000 + id AS k", "1L AS v"))
    assert ordered.large_groups(df, ["g"], policy) == [(1000, 5000)]
    most, collect = [0], type(df).collect

    def counted(self):
        rows = collect(self)
        most[0] = max(most[0], len(rows))
        return rows

    monkeypatch.setattr(type(df), "collect", counted)
    got = running(df, ["g"], "k", {"s": ("sum", "v")}, policy=policy)
    assert most[0] < 300
    monkeypatch.undo()
    small, hot = got.filter("g < 1000"), got.filter("g = 1000")
    assert small.filter("coalesce(s, 0) <> floor(k / 600)").isEmpty() and small.count() == 6000
    assert hot.filter("coalesce(s, 0) <> k - 10000").isEmpty() and hot.count() == 5000


def test_keys_at_ranks(spark):
    df = spark.sql(
        "SELECT timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id div 10 as int), 0, 0, 0) AS timestamp, "
        "lpad(cast(id as string), 3, '0') AS transaction_id FROM range(95)"
    )
    for policy in POLICIES:
        found = keys_at_ranks(df, ["timestamp", "transaction_id"], [0, 66, 94, 95], policy)
        assert [None if k is None else k[1] for k in found] == ["000", "066", "094", None]


def test_lookup_is_broadcast_only_below_its_limit(spark):
    small = as_lookup(spark.range(10).withColumnRenamed("id", "k"), max_rows=10)
    large = as_lookup(spark.range(11).withColumnRenamed("id", "k"), max_rows=10)
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small) and not hinted(large)
    assert estimated_bytes(spark.range(10)) == 80
