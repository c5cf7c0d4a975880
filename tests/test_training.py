import numpy as np
import pytest
from pyspark.sql import functions as F

from paysleuth.operators import drift, learn, training
from paysleuth.operators.encoders import EncoderSet
from paysleuth.schemas import MODEL_INPUT
from paysleuth.sources import views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    return training.training_parts(views.transactions(spark, SF))


def test_encoders_see_the_training_part_only(parts, spark):
    tx = views.transactions(spark, SF)
    spans = [p.agg(F.min("timestamp"), F.max("timestamp")).first() for p in parts[:3]]
    assert spans[0][1] <= spans[1][0] <= spans[1][1] <= spans[2][0]
    labelled = tx.filter(F.col("is_fraud").isNotNull()).count()
    assert sum(p.count() for p in parts[:3]) == labelled
    own = EncoderSet.fit(tx.filter(F.col("timestamp") < F.lit(spans[1][0])))
    as_dict = lambda e: {(r["column"], r["category"]): round(r["code"], 9) for r in e.codes.collect()}
    assert as_dict(parts.encoders) == as_dict(own)


def test_training_reports_on_the_test_part_and_is_promoted(parts, spark):
    trained = training.train_and_evaluate(parts, trees=6, depth=3, patience=2)
    (report,) = trained.report.collect()
    assert report["n_test"] == parts.test.count() and 1 <= report["trees"] <= 6 and 0.1 <= report["threshold"] <= 0.9
    scored = training.scored(parts.test, trained.model).collect()
    hits = sum(r["label"] == 1 and r["score"] >= report["threshold"] for r in scored)
    claimed = sum(r["score"] >= report["threshold"] for r in scored)
    assert report["precision"] == pytest.approx(hits / claimed if claimed else 0.0)
    table = training.register(views.model_deployments(spark, SF), trained, parts, "run_x", "9", views.AS_OF)
    (active,) = table.filter("is_active").collect()
    assert active["run_id"] == "run_x" and active["f1_score"] == pytest.approx(report["f1_score"])


def test_selection_by_a_forest(parts):
    rows = training.selected_features(parts.train, trees=5).collect()
    assert [r["feature"] for r in rows] == MODEL_INPUT and any(r["selected"] for r in rows)


def test_shadow_test_confirms_what_is_useful_and_rejects_what_is_not(spark):
    rng = np.random.default_rng(2)
    names = ["good", "fine", *[f"noise{k}" for k in range(6)]]
    x = rng.normal(size=(400, 8))
    y = (x[:, 0] + x[:, 1] > 0.3).astype(int)
    rows = [(f"k{i}", *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{n} double" for n in names) + ", label int")
    got = learn.shadow_feature_test(df, names, key="id", rounds=26, trees=6)
    decided = {r["feature"]: (r["decision"], r["rounds"]) for r in got.collect()}
    assert decided["good"][0] == decided["fine"][0] == "confirmed" and decided["good"][1] < 20
    useless = [decided[n][0] for n in names[2:]]
    assert "confirmed" not in useless and "rejected" in useless


def test_a_round_of_the_shadow_test_is_assembled_once(spark, monkeypatch):
    df = spark.range(300).select(F.format_string("k%03d", "id").alias("id"), (F.col("id") * 7 % 11).alias("a"), (F.col("id") % 2).cast("int").alias("label"))
    made, kept = [], learn.materialized
    monkeypatch.setattr(learn, "materialized", lambda t, label: made.append((label, t.columns)) or kept(t, label))
    learn.shadow_feature_test(df, ["a"], key="id", rounds=2, trees=3)
    assert made[1:] == [("vectors", ["label", "_vector"])] * 2


def test_rounds_that_decide_nothing_run_beside_each_other(spark, monkeypatch):
    """The table is that of rounds one by one, and no round is begun that a decision could have changed."""
    import threading

    rng = np.random.default_rng(4)
    rows = [(f"k{i}", float(a), float(b), int(a > 0.2)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "id string, good double, noise double, label int")
    together, running, most, lock, real = threading.Barrier(2, timeout=60), [0], [0], threading.Lock(), learn.forest_importance
    seeds = []

    def forest(*args):
        with lock:
            seeds.append(args[3])
            running[0] += 1
            most[0] = max(most[0], running[0])
        if args[3] < 44:  # the first two
            together.wait()
        found = real(*args)
        with lock:
            running[0] -= 1
        return found

    monkeypatch.setattr(learn, "forest_importance", forest)
    shown = lambda n, seed: [tuple(r) for r in learn.shadow_feature_test(df, ["good", "noise"], "id", rounds=12, trees=3, seed=seed, at_once=n).collect()]
    beside = shown(2, 42)
    assert most[0] == 2 and len(seeds) == max(r[2] for r in beside)
    monkeypatch.setattr(learn, "forest_importance", real)
    assert shown(1, 42) == beside and beside[0][3] == "confirmed"
    # a feature of 16 can be decided after 13 rounds of 20 at the earliest
    assert [learn._undecided(0, 0, 0.05 / 320, n) for n in (20, 13, 4, 1)] == [13, 13, 4, 1]
    assert learn._undecided(12, 12, 0.05 / 320, 8) == 1 and learn._undecided(6, 13, 0.05 / 320, 7) == 7


def test_stored_counts_give_the_drift_of_the_tables(spark, tmp_path):
    rng = np.random.default_rng(5)
    make = lambda shift: spark.createDataFrame([(float(a), float(round(b, 1))) for a, b in rng.normal(shift, 1, (300, 2))], "a double, b double")
    old, new = make(0.0), make(0.4)
    path = str(tmp_path / "reference")
    drift.store_reference(old, ["a", "b"], path)
    for test in drift.TESTS:
        direct = sorted(map(tuple, drift.data_drift(old, new, ["a", "b"], test).collect()))
        stored = drift.counted_drift(drift.reference_counts(spark, path), drift.value_counts(new, ["a", "b"]), test)
        got = sorted(map(tuple, stored.collect()))
        assert [(g[0], g[2]) for g in got] == [(d[0], d[2]) for d in direct]
        assert [g[1] for g in got] == pytest.approx([d[1] for d in direct])
    only = drift.reference_counts(spark, path, ["a"])
    assert "PartitionFilters: [isnotnull(column" in only._jdf.queryExecution().toString()
