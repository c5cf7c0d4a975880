import pytest
from pyspark.sql import functions as F

from paysleuth.operators import encoders as enc


def codes(df):
    return {r["category"]: r["code"] for r in df.collect()}


def test_target_encoding(make):
    df = make([{"category": "A", "fraud": True}, {"category": "A", "fraud": True}, {"category": "B", "fraud": False}])
    got = codes(enc.target_encode_fit(df, "merchant_category"))
    mean = 2 / 3
    assert got[None] == pytest.approx(mean)
    assert got["A"] == pytest.approx((2 + 10 * mean) / 12)
    assert got["B"] == pytest.approx((0 + 10 * mean) / 11)
    unseen = make([{"category": "X"}, {"category": "A"}])
    out = enc.target_encode(unseen, enc.target_encode_fit(df, "merchant_category"), "merchant_category")
    values = {r["merchant_category"]: r["merchant_category_encoded"] for r in out.collect()}
    assert values == {"X": pytest.approx(mean), "A": pytest.approx(got["A"])}


def test_no_smoothing_gives_the_category_mean(make):
    df = make([{"category": "A", "fraud": True}, {"category": "B", "fraud": False}])
    got = codes(enc.target_encode_fit(df, "merchant_category", smoothing=0.0))
    assert (got["A"], got["B"]) == (1.0, 0.0)


def test_ordinal_encoding_by_first_appearance(make):
    df = make([{"device": d, "minute": i} for i, d in enumerate(["z", "a", "m", "a"])])
    fitted = enc.ordinal_encode_fit(df, "device_type")
    assert codes(fitted) == {"z": 0, "a": 1, "m": 2}
    out = enc.ordinal_encode(make([{"device": "kiosk"}, {"device": "m"}]), fitted, "device_type")
    assert sorted(r["device_type_encoded"] for r in out.collect()) == [-1, 2]


def test_missing_category_is_a_category(make):
    df = make([{"category": None, "fraud": True}, {"category": "A", "fraud": False}])
    assert set(codes(enc.target_encode_fit(df, "merchant_category"))) == {None, "None", "A"}


def test_encoder_set_equals_single_encoders_and_survives_saving(make, spark, tmp_path):
    rows = [
        {"category": c, "country": k, "device": d, "fraud": f, "minute": i}
        for i, (c, k, d, f) in enumerate(
            [("A", "AR", "web", True), ("B", "AR", "pos", False), ("A", "BR", "web", None), ("B", "US", "mobile", False)]
        )
    ]
    df = make(rows)
    fitted = enc.EncoderSet.fit(df)
    fitted.save(str(tmp_path / "codes"))
    loaded = enc.EncoderSet.load(spark, str(tmp_path / "codes"))
    fresh = make([{"category": "A", "country": "BR", "device": "pos"}, {"category": "?", "country": "?", "device": "?"}])
    names = ["merchant_category_encoded", "country_encoded", "device_type_encoded"]
    a, b = (sorted(tuple(r[n] for n in names) for r in s.transform(fresh).collect()) for s in (fitted, loaded))
    assert a == b
    labelled = df.filter(F.col("is_fraud").isNotNull())
    target = codes(enc.target_encode_fit(labelled, "country"))
    # BR occurs only without a label, so it is unseen
    assert [x[1] for x in a] == pytest.approx([target[None]] * 2)
    assert {x[2] for x in a} == {-1, 1}


def test_until_keeps_later_rows_out(make):
    df = make([{"category": "A", "fraud": False}, {"category": "A", "fraud": True, "minute": 10}])
    early = enc.EncoderSet.fit(df, until="2025-01-15 12:05:00")
    assert early.unseen()["merchant_category"] == 0.0


def test_label_encoding_by_sorted_value(make):
    df = make([{"category": c} for c in ("pear", "apple", "fig", "apple")])
    out = enc.label_encode(df, "merchant_category")
    assert {r["merchant_category"]: r["merchant_category_enc"] for r in out.collect()} == {"apple": 0, "fig": 1, "pear": 2}
