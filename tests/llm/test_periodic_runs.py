import hashlib
import random
import zlib

import numpy as np
import pytest

from paysleuth.llm import periodic_runs as pr


def plain_runs(words, least=12):
    """Every stretch, every period: cubic, and only for small texts."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, 2 * q):
                found.setdefault((s, e), q)  # q ascends: the smallest period comes first
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_digest(doc_id, text, least=12):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(plain_runs(words, least), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def some_text(rng, n, letters):
    words = [rng.choice("abcdefghij"[:letters]) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):  # stretches that repeat, nested ones too
        if n > 4:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, n // 3))
            for i in range(a + p, min(n, a + p * rng.randint(2, 9))):
                words[i] = words[i - p]
    return words


def test_every_remainder_is_a_difference_of_the_cover():
    assert {(a - b) % pr.MODULUS for a in pr.COVER for b in pr.COVER} == set(range(pr.MODULUS))


@pytest.mark.parametrize("letters", [1, 2, 3, 9])
def test_common_extensions(letters):
    rng = np.random.default_rng(letters)
    words = rng.integers(0, letters, 400)
    words[200:300] = words[20:120]
    words[-1] = 99
    found = pr.Extensions(words)
    i, j = rng.integers(0, 400, 3000), rng.integers(0, 400, 3000)
    i, j = i[i != j], j[i != j]
    for a, b, got in zip(i.tolist(), j.tolist(), found.common(i, j).tolist(), strict=True):
        m = 0
        while max(a, b) + m < 400 and words[a + m] == words[b + m]:
            m += 1
        assert got == m


@pytest.mark.parametrize("at_once", [40, 1 << 16])
def test_runs_of_many_texts_equal_brute_force(monkeypatch, at_once):
    monkeypatch.setattr(pr, "AT_ONCE", at_once)
    monkeypatch.setattr(pr, "PAIRS", 64 if at_once == 40 else 1 << 20)
    rng = random.Random(at_once)
    texts = [some_text(rng, rng.choice([0, 1, 2, 11, 12, 13, 24, 60, 150]), rng.choice([1, 2, 3, 10])) for _ in range(300)]
    for least in (2, 12):
        found = pr.runs_of_texts([[w.encode() for w in t] for t in texts], least)
        for t, r in zip(texts, found, strict=True):
            got = list(zip(r.start.tolist(), r.length.tolist(), r.period.tolist(), strict=True))
            assert got == plain_runs(t, least)


def test_long_texts():
    words = [b"x"] * 30_000
    (only,) = pr.runs_of_texts([words])
    assert [x.tolist() for x in only] == [[0], [30_000], [1]] and pr.collapsed(words, only) == b"x"
    words = [str(i % 7001).encode() for i in range(21_100)]
    (only,) = pr.runs_of_texts([words])
    assert [x.tolist() for x in only] == [[0], [21_100], [7001]]


def test_query_equals_plain_code(spark, awkward):
    rng = random.Random(12)
    rows = [(i, " ".join(some_text(rng, rng.choice([0, 5, 40, 120]), 3)), "x") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in pr.run_digest(docs).collect()}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in got) > 10
    assert got == {i: plain_digest(i, t) for i, t, _ in rows}
    short = awkward.filter("length(text) < 1000 or text is null")
    got = sorted(map(str, pr.run_digest(short).collect()))
    assert len(got) == 8
    assert sorted((r["doc_id"] or 0, r["n_runs"]) for r in pr.run_digest(awkward).collect())[-1] == (6, 1)
    assert pr.run_digest(docs.limit(0)).count() == 0


def test_runs_and_kept_text_are_whole(spark):
    docs = spark.createDataFrame([(1, "see: " + "la di " * 8 + "end")], "doc_id long, text string")
    row = pr.find_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 16, 2)] and row["collapsed"] == "see: la di end"
