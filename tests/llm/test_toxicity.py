import random
import zlib

import numpy as np

from paysleuth.llm import toxicity


def corpus(n, seed):
    """Clean texts of invented words; toxic ones hold words that start with 'grumf' besides."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if bad:
            text[rng.randrange(len(text))] = "Grumf" + rng.choice(words)
            text[rng.randrange(len(text))] = rng.choice(["idiot", "grumf" + rng.choice(words)])
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus(900, 5)
    odd = [(10_000, None, "x"), (10_001, "", "x"), (None, "idiot " * 50_000, None), (3, rows[3][1], "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    given = spark.createDataFrame(labels + [(5, None), (None, 1), (20_000, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, given).collect()
    assert len(got) == len(rows) + len(odd)
    truth = dict(labels)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(r["score"] < 0.5 for r in got if r["doc_id"] in (10_000, 10_001))
    kept = toxicity.without_toxic(docs, given)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got)


def test_without_labels_only_the_lexicon_speaks(spark):
    docs = spark.createDataFrame([(1, "you idiot and moron"), (2, "good day")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, none).collect()}
    assert got[1] > got[2]
    assert toxicity.score_documents(docs.limit(0), none).count() == 0


def test_label_model_mends_wrong_labels_and_discounts_copies():
    rng = np.random.default_rng(2)
    truth = rng.random(2000) < 0.3
    votes = np.column_stack([np.where(truth, rng.random(2000) < 0.8, rng.random(2000) < 0.05) for _ in range(6)])
    gold = np.where(rng.random(2000) < 0.1, ~truth, truth)
    posterior = toxicity.label_model(votes.astype(float), gold.astype(float))
    assert ((posterior > 0.5) == truth).mean() > 0.98 > (gold == truth).mean()
    bad_copies = np.column_stack([votes[:, :3], np.repeat((rng.random(2000) < 0.3)[:, None], 30, axis=1)])
    posterior = toxicity.label_model(bad_copies.astype(float), gold.astype(float))
    assert ((posterior > 0.5) == truth).mean() > 0.95
