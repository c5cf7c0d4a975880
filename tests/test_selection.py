import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paysleuth.operators import imbalance
from paysleuth.operators import selection as sel


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    a, b, c = rng.normal(size=(3, 200))
    rows = [(float(x), float(y), float(z), float(0.99 * x + 0.01 * y), 1.0) for x, y, z in zip(a, b, c, strict=True)]
    return spark.createDataFrame(rows, "feat_a double, feat_b double, feat_c double, feat_d double, flat double")


COLUMNS = ["feat_a", "feat_b", "feat_c", "feat_d", "flat"]


def test_correlation_matrix(frame):
    got = {(r["a"], r["b"]): r["r"] for r in sel.correlation_matrix(frame, COLUMNS).collect()}
    data = np.array([tuple(r) for r in frame.collect()])
    want = np.corrcoef(data[:, :4], rowvar=False)
    assert len(got) == 25
    for i, a in enumerate(COLUMNS[:4]):
        for j, b in enumerate(COLUMNS[:4]):
            assert got[a, b] == pytest.approx(want[i, j])
    assert got["flat", "feat_a"] is None


def test_redundant_pairs(frame):
    pairs = [(r["a"], r["b"]) for r in sel.redundant_pairs(frame, COLUMNS).collect()]
    assert pairs == [("feat_a", "feat_d")]


def test_select_features_rules(spark):
    columns = ["a", "b", "c", "d", "e"]
    weights = spark.createDataFrame(
        [("a", 0.4), ("b", 0.3), ("c", 0.005), ("d", 0.3), ("e", 0.2)], "feature string, importance double"
    )
    pairs = spark.createDataFrame([("b", "d", 0.9), ("a", "b", -0.95), ("a", "c", 0.99)], "a string, b string, r double")
    got = {r["feature"]: r["drop_reason"] for r in sel.select_features(columns, weights, pairs, ["e", "c"]).collect()}
    # b loses to a; b also ties with d and is already gone; c keeps its first reason
    assert got == {"a": None, "b": "redundant", "c": "low_importance", "d": None, "e": "shadow_rejected"}


@pytest.mark.parametrize(("neg", "pos", "ratio"), [(90, 10, 9.0), (999, 1, 999.0)])
def test_scale_pos_weight(spark, neg, pos, ratio):
    df = spark.range(neg + pos).select((F.col("id") < pos).alias("is_fraud"))
    assert imbalance.scale_pos_weight(df).collect()[0]["scale_pos_weight"] == ratio


def test_scale_pos_weight_needs_positives(spark):
    df = spark.range(5).select(F.lit(False).alias("is_fraud"))
    with pytest.raises(Exception, match="No positive examples"):
        imbalance.scale_pos_weight(df).collect()


@pytest.mark.parametrize("block", [8, 64, 2048])
def test_nearest_rows_equal_brute_force(spark, block):
    rng = random.Random(4)
    points = [(f"p{i:03d}", rng.gauss(i % 4 * 5, 1), rng.gauss(0, 1)) for i in range(90)]
    points += [(f"q{i:03d}", 3.0, 3.0) for i in range(45)]  # a third are copies
    df = spark.createDataFrame(points, "id string, x double, y double")
    got = imbalance.nearest_rows(df, "id", ["x", "y"], 4, block_rows=block).collect()
    found = {}
    for r in got:
        assert r["key"] != r["neighbour"]
        found.setdefault(r["key"], []).append(r["distance"])
    for key, x, y in points:
        want = sorted(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for k, a, b in points if k != key)[:4]
        assert sorted(found[key]) == pytest.approx(want)


def test_cells_are_one_block_each_or_equal_rows(spark):
    rng = random.Random(6)
    points = [(i, [rng.gauss(i % 5, 1), rng.random(), 7.0]) for i in range(3000)] + [(5000 + i, [0.5, 0.5, 7.0]) for i in range(700)]
    df = spark.createDataFrame(points, "key long, vec array<double>")
    cells, rounds = imbalance.space_cells(df, 20)
    by = {}
    for r in cells.collect():
        by.setdefault(r["cell"], []).append(tuple(r["vec"]))
    assert rounds >= 2 and sum(map(len, by.values())) == 3700 and len(by) > 150
    for vectors in by.values():
        assert len(vectors) <= 20 or len(set(vectors)) == 1


def test_visits_a_row_do_not_grow_with_the_table(spark):
    """Four times the rows: as many blocks looked at for each."""
    rng = np.random.default_rng(3)
    visits = []
    for n in (2000, 8000):
        rows = [(i, *map(float, x)) for i, x in enumerate(rng.normal(size=(n, 3)))]
        df = spark.createDataFrame(rows, "id long, x double, y double, z double")
        imbalance.nearest_rows(df, "id", ["x", "y", "z"], 5, block_rows=32, visits=visits).count()
    assert visits[1] / 8000 <= 1.3 * visits[0] / 2000


def test_nearest_rows_of_few_and_of_none(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, x double")
    got = imbalance.nearest_rows(df, "id", ["x"], 5).collect()
    assert sorted((r["key"], r["neighbour"], r["distance"]) for r in got) == [("a", "b", 1.0), ("b", "a", 1.0)]
    assert imbalance.nearest_rows(df.limit(0), "id", ["x"], 5).count() == 0


def test_smote_grows_the_minority(spark):
    rng = random.Random(9)
    rows = [(i, rng.random(), rng.random(), int(i < 12)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, y double, label int")
    grown = imbalance.smote(df, ["x", "y"], key="id", ratio=0.1)
    counts = {(r["label"], r["synthetic"]): r["count"] for r in grown.groupBy("label", "synthetic").count().collect()}
    assert counts == {(0, False): 388, (1, False): 12, (1, True): int(388 * 0.1) - 12}
    xs = [r[1] for r in rows if r[3]]
    made = grown.filter("synthetic").collect()
    assert all(min(xs) <= r["x"] <= max(xs) for r in made)
    again = imbalance.smote(df, ["x", "y"], key="id", ratio=0.1).filter("synthetic").collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, again))


def test_smote_leaves_a_balanced_table_alone(spark):
    df = spark.range(10).selectExpr("id", "cast(id as double) AS x", "cast(id % 2 as int) AS label")
    assert imbalance.smote(df, ["x"], key="id").filter("synthetic").count() == 0
