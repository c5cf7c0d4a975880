import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from paysleuth.llm.exact_dedup import exact_dedup, exact_groups


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in sorted(set(ids), key=str):
            for copy in range(ids.count(i)):
                digest = hashlib.sha256(text.encode()).hexdigest()
                out.append((i, keep, len(ids), copy == 0 and i == keep, digest))
    return sorted(out, key=str)


def test_groups_equal_plain_code(awkward):
    want = plain([(r["doc_id"], r["text"]) for r in awkward.collect()])
    got = sorted((tuple(r) for r in exact_groups(awkward).collect()), key=str)
    assert got == want
    assert exact_groups(awkward.limit(0)).count() == 0


def test_colliding_hashes_stay_apart(awkward):
    weak = lambda text: F.length(text) % 2
    want = sorted((tuple(r) for r in exact_groups(awkward).collect()), key=str)
    assert sorted((tuple(r) for r in exact_groups(awkward, content_hash=weak).collect()), key=str) == want
    assert exact_dedup(awkward, content_hash=weak).count() == exact_dedup(awkward).count() == 5


def test_dedup_keeps_one_whole_row_of_each_text(awkward):
    got = {r["text"]: (r["doc_id"], r["kept"]) for r in exact_dedup(awkward).collect()}
    assert got["one two three four five six seven"] == (2, "b")
    assert got.get("", got.get(None)) == (4, None) and got["lonely null id"] == (None, None)
    assert exact_dedup(awkward).columns == awkward.columns
    assert exact_dedup(awkward.limit(0)).count() == 0
