import random
from datetime import timedelta

import pytest
from helpers import BASE, TINY
from pyspark.sql import functions as F

from paysleuth.operators import features as feat
from paysleuth.operators.encoders import EncoderSet
from paysleuth.schemas import FEATURES, PROFILE_FEATURES, WINDOW_FEATURES

NAMES = WINDOW_FEATURES + PROFILE_FEATURES


def by_id(df):
    return {r["transaction_id"]: r for r in df.collect()}


def test_first_row_has_no_history(make):
    row = by_id(feat.behaviour_features(make([{}])))["t0000"]
    assert [row[n] for n in WINDOW_FEATURES] == [0, 0, 0, 0.0, 0.0, 0.0, -1.0]
    assert [row[n] for n in PROFILE_FEATURES] == [1.0, 1.0, 0, 1.0, 0]


def test_window_counts_and_sums(make):
    rows = [
        {"minute": -8 * 24 * 60, "amount": 5.0},
        {"minute": -90, "amount": 50.0},
        {"minute": -40, "amount": 75.0},
        {"minute": 0, "amount": 30.0},
    ]
    last = by_id(feat.behaviour_features(make(rows)))["t0003"]
    assert (last["tx_count_1h"], last["tx_count_24h"], last["tx_count_7d"]) == (1, 2, 2)
    assert (last["amount_sum_1h"], last["amount_sum_24h"]) == (75.0, 125.0)
    assert last["tx_velocity_1h"] == 1.0
    assert last["seconds_since_last_tx"] == 2400.0


def test_velocity_per_minute(make):
    rows = [{"minute": m} for m in (0, 20, 40)]
    last = by_id(feat.behaviour_features(make(rows), velocity="per_minute"))["t0002"]
    assert last["tx_velocity_1h"] == pytest.approx(2 / 60)


def test_lower_window_bound_is_inclusive(make):
    rows = [{"minute": 0}, {"minute": 60}, {"minute": 24 * 60}]
    got = by_id(feat.behaviour_features(make(rows)))
    assert got["t0001"]["tx_count_1h"] == 1
    assert got["t0002"]["tx_count_24h"] == 2


def test_ratio_and_first_seen(make):
    rows = [
        {"minute": 0, "amount": 100.0, "country": "AR", "merchant": "a"},
        {"minute": 1, "amount": 100.0, "country": "AR", "merchant": "b"},
        {"minute": 2, "amount": 300.0, "country": "BR", "merchant": "a"},
        {"minute": 3, "amount": 10.0, "country": None, "merchant": "a"},
    ]
    got = by_id(feat.behaviour_features(make(rows)))
    assert got["t0002"]["amount_ratio_vs_user_avg"] == 3.0
    assert [got[f"t000{i}"]["is_country_new"] for i in range(4)] == [1.0, 0.0, 1.0, 1.0]
    assert [got[f"t000{i}"]["is_merchant_new"] for i in range(4)] == [1.0, 1.0, 0.0, 0.0]
    assert [got[f"t000{i}"]["distinct_countries_seen"] for i in range(4)] == [0, 1, 1, 2]
    assert [got[f"t000{i}"]["distinct_merchants_seen"] for i in range(4)] == [0, 1, 2, 2]


def test_zero_mean_gives_neutral_ratio(make):
    rows = [{"minute": 0, "amount": 0.0}, {"minute": 1, "amount": 50.0}]
    assert by_id(feat.behaviour_features(make(rows)))["t0001"]["amount_ratio_vs_user_avg"] == 1.0


def test_ties_do_not_see_each_other_unless_asked(make):
    rows = [{"minute": 0}, {"minute": 0}, {"minute": 0}]
    strict = by_id(feat.behaviour_features(make(rows)))
    assert [strict[f"t000{i}"]["tx_count_1h"] for i in range(3)] == [0, 0, 0]
    assert [strict[f"t000{i}"]["is_merchant_new"] for i in range(3)] == [1.0, 1.0, 1.0]
    arrival = by_id(feat.behaviour_features(make(rows), ties="arrival"))
    assert [arrival[f"t000{i}"]["tx_count_1h"] for i in range(3)] == [0, 1, 2]
    assert arrival["t0002"]["seconds_since_last_tx"] == 0.0
    assert [arrival[f"t000{i}"]["is_merchant_new"] for i in range(3)] == [1.0, 0.0, 0.0]


def test_users_are_independent(make):
    got = by_id(feat.behaviour_features(make([{"user": "a"}, {"user": "b", "minute": 1}])))
    assert [got[i]["tx_count_1h"] for i in ("t0000", "t0001")] == [0, 0]


def random_rows(n, seed):
    rng = random.Random(seed)
    span = 12 * 24 * 60
    rows = []
    for i in range(n):
        # one user holds about a third of the rows, a tenth of all rows share one instant
        user = "hot" if rng.random() < 0.35 else f"u{rng.randrange(8)}"
        at = BASE + timedelta(minutes=5000 if rng.random() < 0.1 else rng.randrange(span), seconds=rng.randrange(3))
        rows.append(
            {
                "id": f"r{i:05d}",
                "user": user,
                "at": at,
                "amount": rng.randrange(1, 50_000) / 100,
                "country": rng.choice(["AR", "BR", "US", None]),
                "merchant": f"m{rng.randrange(12)}",
            }
        )
    return rows


def brute(rows, ties):
    """The definition, pair by pair."""
    out = {}
    for r in rows:
        if ties == "strict":
            prior = [p for p in rows if p["user"] == r["user"] and p["at"] < r["at"]]
        else:
            prior = [p for p in rows if p["user"] == r["user"] and (p["at"], p["id"]) < (r["at"], r["id"])]
        within = lambda h: [p for p in prior if r["at"] - p["at"] <= timedelta(hours=h)]  # noqa: B023, E731
        total = sum(round(p["amount"] * 100) for p in prior)
        mean = total / 100 / len(prior) if prior else 0
        out[r["id"]] = {
            "tx_count_1h": len(within(1)),
            "tx_count_24h": len(within(24)),
            "tx_count_7d": len(within(168)),
            "amount_sum_1h": sum(round(p["amount"] * 100) for p in within(1)) / 100,
            "amount_sum_24h": sum(round(p["amount"] * 100) for p in within(24)) / 100,
            "tx_velocity_1h": float(len(within(1))),
            "seconds_since_last_tx": (r["at"] - max(p["at"] for p in prior)).total_seconds() if prior else -1.0,
            "amount_ratio_vs_user_avg": r["amount"] / mean if mean > 0 else 1.0,
            "is_country_new": float(r["country"] not in {p["country"] for p in prior}),
            "distinct_countries_seen": len({p["country"] for p in prior}),
            "is_merchant_new": float(r["merchant"] not in {p["merchant"] for p in prior}),
            "distinct_merchants_seen": len({p["merchant"] for p in prior}),
        }
    return out


@pytest.mark.parametrize("ties", ["strict", "arrival"])
@pytest.mark.parametrize("large", [False, True])
def test_matches_brute_force(make, ties, large):
    rows = random_rows(300, 7)
    extra = {"policy": TINY} if large else {}
    got = by_id(feat.behaviour_features(make(rows), ties=ties, **extra))
    want = brute(rows, ties)
    assert len(got) == len(rows)
    for key, features in want.items():
        for name, value in features.items():
            assert got[key][name] == pytest.approx(value, abs=1e-6), (key, name)


def many_large_users(make):
    """Two users to cut; of the others each is above the size of a segment, but there are too many of them to cut."""
    rows = random_rows(60, 11)
    rows += [r | {"id": f"x{k}-{r['id']}", "user": f"v{k}"} for k in range(40) for r in random_rows(7, 20 + k)]
    return make([r | {"user": f"big{i % 2}"} if i < 60 else r for i, r in enumerate(rows)])


@pytest.mark.parametrize("ties", ["strict", "arrival"])
def test_only_users_that_are_cut_are_written_down(make, monkeypatch, ties):
    """A large user of one segment costs one exchange, and the features are those of the plain scan."""
    df, written, kept = many_large_users(make), [], feat.materialized
    monkeypatch.setattr(feat, "materialized", lambda t, label: written.append(kept(t, label)) or written[-1])
    got = by_id(feat.behaviour_features(df, ties=ties, policy=TINY))
    (table,) = written
    assert {r["user_id"] for r in table.select("user_id").distinct().collect()} == {"big0", "big1"}
    assert len(got) == 340 and got == by_id(feat.behaviour_features(df, ties=ties))


@pytest.mark.parametrize("ties", ["strict", "arrival"])
def test_large_users_may_lack_times(make, ties):
    """No cut lies at a missing time; rows without one stay in arrival order and do not hold up the others."""
    df = many_large_users(make)
    holes = df.withColumn("timestamp", F.when(F.pmod(F.xxhash64("transaction_id"), F.lit(3)) > 0, F.col("timestamp")))
    plain, large = (by_id(feat.behaviour_features(holes, ties=ties, **more)) for more in ({}, {"policy": TINY}))
    timed = {r["transaction_id"] for r in holes.filter("timestamp IS NOT NULL").collect()}
    assert 0 < len(timed) < len(plain) == 340 and timed <= set(large)
    if ties == "arrival":
        assert large == plain


def test_row_order_of_the_input_does_not_matter(make):
    rows = random_rows(80, 3)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    pick = lambda df: sorted(tuple(r) for r in feat.behaviour_features(df).select("transaction_id", *NAMES).collect())
    assert pick(make(rows)) == pick(make(shuffled))


def test_featurize_checks_columns_and_keeps_one_row_each(make):
    df = make(random_rows(40, 5)).withColumn("is_fraud", F.col("amount") > 400)
    encoders = EncoderSet.fit(df)
    matrix = feat.featurize(df, encoders)
    assert matrix.columns[-18:] == FEATURES
    assert matrix.count() == 40
    assert matrix.filter(" OR ".join(f"{c} IS NULL" for c in FEATURES)).count() == 0
    with pytest.raises(ValueError, match="merchant_id"):
        feat.featurize(df.drop("merchant_id"), encoders)


def test_one_exchange_when_no_user_is_large(spark):
    from paysleuth.sources import views

    plan = feat.behaviour_features(views.transactions(spark, "/root/testdata/sf0.001"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_user_window_keeps_the_newest(make):
    df = make([{"minute": m} for m in range(6)] + [{"minute": -9 * 24 * 60, "id": "old"}])
    kept = feat.user_window(df, "2025-01-15 12:10:00", newest=3)
    assert sorted(r[0] for r in kept.select("transaction_id").collect()) == ["t0003", "t0004", "t0005"]


def test_user_profile(make):
    df = make([{"amount": 10.0, "country": "BR"}, {"amount": 20.0, "country": "AR", "merchant": "a"}])
    (row,) = feat.user_profile(df).collect()
    assert (row["amount_total"], row["amount_count"]) == (30.0, 2)
    assert (row["countries_seen"], row["merchants_seen"]) == (["AR", "BR"], ["a", "m1"])


def test_a_task_gets_a_bounded_number_of_rows(make, spark, monkeypatch):
    """Tasks grow with the rows, and the features do not depend on how many there are."""
    df = make([{"id": f"t{i}", "user": f"u{i % 150}", "minute": i, "country": f"c{i % 7}"} for i in range(1500)])
    whole = by_id(feat.behaviour_features(df))
    monkeypatch.setattr(feat, "ROWS_A_TASK", 30)
    few = feat.behaviour_features(df)
    sizes = [r["count"] for r in few.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1500 and len(sizes) > 30 and max(sizes) <= 100
    assert by_id(few) == whole
