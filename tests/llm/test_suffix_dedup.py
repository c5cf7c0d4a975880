import hashlib
import random

import numpy as np
import pytest

from paysleuth.llm import suffix_dedup as sd


def plain(rows, length=50):
    """Every string of every document in a dictionary of the smallest id that has it."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            least[s] = min(least.get(s, sd.NULL_ID), sd.NULL_ID if i is None else i)
    result = []
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if least[t[k : k + length]] < (sd.NULL_ID if i is None else i):
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        result.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return result


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9))) for _ in range(60)]

    def text(k):
        return " ".join(rng.choice(words) for _ in range(k))

    passages = [text(rng.randint(6, 40)) for _ in range(12)] + ["-" * 70, "ab" * 40]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):  # whole passages, and pieces of them cut anywhere
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : rng.randint(a, len(p))] if rng.random() < 0.6 else p, text(rng.randint(0, 8))]
        rows.append((i * 7 % 1009, rng.choice(["", " "]).join(parts)))
    rows += [(2000 + i, rows[i][1]) for i in range(0, n, 9)]  # copies of smaller and of larger id
    rows += [(-5 - i, rows[i][1]) for i in range(0, n, 31)]
    rows += [(3000 + i, rows[i][1][: rng.randint(40, 400)] + "x" + rows[i + 1][1]) for i in range(0, n - 1, 5)]
    return rows


def test_documents_equal_brute_force(spark):
    rows = corpus(220, 5) + [(None, corpus(3, 5)[1][1]), (None, ""), (5000, None), (5001, "\x00" * 60), (5002, "\x00" * 55 + "a")]
    rows += [rows[3], rows[3], rows[240]]  # repeated rows take nothing from each other
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, chunk int, kept string").repartition(3)
    want = sorted(plain(rows), key=str)
    assert sum(r[2] for r in want) > 10_000 and any(r[3] > 2 for r in want)
    for sizes in ((4000, 5000, 3000, 3), (9000, 5000, 9000, 40), (sd.CHUNK_BYTES, sd.PART_BYTES, sd.RANGE_BYTES, 0), (1 << 20, 1 << 20, 1 << 20, 1 << 20)):
        found = sd.repeated_spans(docs, chunk_bytes=sizes[0], part_bytes=sizes[1], range_bytes=sizes[2], most_strings=sizes[3]).collect()
        got = []
        for r in found:
            gone = sum(s["end"] - s["start"] for s in r["spans"])
            assert len(r["kept"]) + gone == r["n_bytes"]
            got.append((r["doc_id"], r["n_bytes"], gone, len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()))
        assert sorted(got, key=str) == want


@pytest.mark.parametrize("length", [1, 2, 3, 5, 16, 64])
def test_other_lengths(spark, length):
    rng = random.Random(length)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 3 * length + 4)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sd.span_digest(docs, length=length).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, length))


def test_awkward_tables(spark, awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 1000]
    got = sorted(map(tuple, sd.span_digest(awkward).collect()), key=str)
    assert [r for r in got if r[1] < 1000] == sorted(plain(short), key=str)
    assert [r[1:4] for r in got if r[1] >= 1000] == [(150_000, 0, 0)]
    assert sd.span_digest(awkward.limit(0)).count() == 0


def test_loser_tree_compares_no_known_prefix():
    """Matches look at bytes only beyond what both strings share with the last one put out."""
    rng = random.Random(3)
    runs = [sorted({bytes(rng.choice(b"ab") for _ in range(24)) for _ in range(200)}) for _ in range(5)] + [[]]
    coded = []
    for run in runs:
        shared, rest = sd.front_coded(np.frombuffer(b"".join(run), dtype=np.uint8).reshape(-1, 24))
        coded.append((shared.tolist(), rest))
    tree = sd.LoserTree(coded, 24)
    found = list(tree.groups())
    out = [[runs[r][k] for r, k in group] for _, group in found]
    assert all({string} == set(group) for (string, _), group in zip(found, out, strict=True))
    assert [g[0] for g in out] == sorted({s for run in runs for s in run})
    assert sum(map(len, out)) == sum(map(len, runs))
    # each byte of a run is looked at a bounded number of times: known lengths only grow while a string waits
    assert sum(len(rest) for _, rest in coded) < sum(24 * len(run) for run in runs)


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(1)
    piece = rng.integers(97, 100, 300).astype(np.uint8)
    text = np.concatenate([rng.integers(97, 123, 150_000).astype(np.uint8), piece, rng.integers(97, 123, 777).astype(np.uint8), piece])
    places, hashes, anchors = sd.anchor_changes(text, 50)

    def anchor(p):
        of = np.searchsorted(places, p, side="right") - 1
        return hashes[of], anchors[of] - p

    for k in range(250):
        assert anchor(150_000 + k) == anchor(151_077 + k)
