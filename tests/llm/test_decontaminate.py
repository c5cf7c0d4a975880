import random
import re
from collections import Counter

from paysleuth.llm import decontaminate as module
from paysleuth.llm.decontaminate import decontaminate, find_leaks


def shingles(text, k=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else [])


def plain(docs, items, threshold=0.8):
    found = {}
    for doc_id, text in docs:
        s = shingles(text)
        for item_id, item in items:
            want = Counter(shingles(item))
            size = sum(want.values())
            if not size or not s:
                continue
            best = 0
            for p in range(max(1, len(s) - size + 1)):
                have = Counter(s[p : p + size])
                m = sum((have & want).values())
                best = max(best, m / (size + sum(have.values()) - m))
            if best >= threshold:
                found[doc_id, item_id] = round(best, 6)
    return found


def test_leaks_equal_the_search_of_all_windows(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(2000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([20, 30, 45, 59])))) for i in range(30)]
    items += [(90, "two words"), (91, ""), (92, None), (93, items[0][1]), (94, "same same same same same same same same")]
    docs = [(0, None), (1, ""), (2, "Two, words!"), (3, "x two words y"), (4, "same " * 9), (5, items[3][1][:-3])]
    for i in range(10, 120):
        text = [word() for _ in range(rng.randint(0, 150))]
        leak = rng.choice(items[:30])[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(leak))
            kind = rng.randrange(3)
            if kind == 0:
                leak[at] = word()
            elif kind == 1:
                leak.insert(at, word())
            else:
                del leak[at]
        if i % 4:
            at = rng.randint(0, len(text))
            text[at:at] = leak
        docs.append((i, (". " if i % 2 else " ").join(text).upper()))
    docs.append(docs[-1])
    frame = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, similarity double").repartition(3)
    benchmark = spark.createDataFrame([*items, (None, "a b c d e f")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in find_leaks(frame, benchmark).collect()}
    want = plain(docs, items)
    assert got == want and len(want) > 40
    kept = decontaminate(frame, benchmark)
    dirty = {d for d, _ in want}
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in docs if d not in dirty)


def test_swapped_halves_leak(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([100, 160, 80, 100, 60])]
    docs = []
    for i, item in items:
        leak, before = item.split(), [word() for _ in range(30 * i)]
        half = len(leak) // 2
        docs.append((i, " ".join(before + leak[half:] + leak[:half] + [word() for _ in range(40)])))
    docs += [(7, docs[0][1]), (None, docs[1][1])]  # copies, one without an id
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in find_leaks(frame, benchmark).collect()}
    want = plain(docs, items)
    assert got == want and len(want) == 7
    assert decontaminate(frame, benchmark).count() == 0


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, none).count() == 0 and decontaminate(docs, none).count() == 1
    assert find_leaks(docs.limit(0), none).count() == 0


def test_columns_named_like_helpers_come_back(spark):
    names = ["_hash", "_id", "hash", "id", "row", "text_hash", "shingles", "h", "item", "size"]
    item = " ".join(f"leak{i}" for i in range(30))
    rows = [(i, f"clean text number {i} " * 5 if i else item, *range(100 * i, 100 * i + len(names))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows[1:]


def test_a_pair_at_the_threshold_is_within_the_radius():
    """Differing bits of fingerprints at a weighted similarity of 0.8: beyond the radius in fewer than one of 1,000."""
    import numpy as np

    rng, far, turns = np.random.default_rng(4), 0, 4000
    for _ in range(turns):
        n = int(rng.integers(20, 200))
        new = n // 9  # similarity (n - new) / (n + new) = 0.8
        bits = rng.integers(0, 2, (n + new, 64))
        a, b = bits[:n].sum(axis=0) * 2 > n, bits[new:].sum(axis=0) * 2 > n
        far += int((a != b).sum() > module.RADIUS)
    assert far / turns < 0.001


def test_an_item_in_a_very_long_text(spark):
    item = " ".join(f"leak{i}" for i in range(60))
    long_text = "filler words here " * 40_000 + item + " more filler" * 30_000
    docs = spark.createDataFrame([(1, long_text), (2, "filler words here " * 40_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    (leak,) = find_leaks(docs, bench).collect()
    assert (leak["doc_id"], leak["item_id"], leak["start"]) == (1, 7, 120_000) and leak["similarity"] == 1.0
