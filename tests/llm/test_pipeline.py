import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from paysleuth.llm import toxicity


def test_stages_drop_what_they_should_and_nothing_else(spark, word_bpe, tmp_path):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(3, 8))) for _ in range(3000)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    docs, labels, want = [], [], set()
    for i in range(600):
        words = text(rng.randint(30, 200))
        if i % 3 == 2:
            words[0] = words[5] = words[9] = "grumf" + words[1]
        docs.append([i, " ".join(words)])
        labels.append((i, int(i % 3 == 2)))
        if i % 3 != 2:
            want.add(i)
    items = [(k, " ".join(text(40))) for k in range(5)]
    for k in range(5):  # leaks
        docs.append([1300 + k, " ".join(text(50)) + " " + items[k][1] + " " + " ".join(text(50))])
    for k in range(5):  # copies: the largest id stays; near copies: the smallest
        docs.append([1400 + k, docs[3 * k][1]])
        want = want - {3 * k} | {1400 + k}
        words = docs[3 * k + 1][1].split()
        words[-1] = "altered"
        docs.append([1500 + k, " ".join(words)])
    docs += [[1600, ""], [1601, None], [1602, "long " * 9000]]
    want |= {1601, 1602}
    folder = str(tmp_path)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    # the classifier has some 130 toxic texts to learn from; what it rejects goes, whatever that is
    scored = toxicity.score_documents(
        spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    )
    rejected = {r["doc_id"] for r in scored.filter("predicted = 1").collect()}
    toxic = {i for i, bad in labels if bad}
    assert len(rejected & toxic) > 0.9 * len(toxic) and len(rejected - toxic) <= 4
    assert not rejected & ({1601, 1602} | set(range(15)) - toxic)
    want = (want | toxic - rejected) - rejected
    got = corpus_pipeline.run(spark, folder).collect()
    # near copies of short texts can be below the threshold
    short = {1500 + k for k in range(5) if len(docs[3 * k + 1][1].split()) < 60}
    assert {r["doc_id"] for r in got} - short == want
    library = Tokenizer.from_file(word_bpe)
    texts = dict(docs)
    for r in got:
        ids = np.array(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_five_stages_and_no_rows(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "packing"]
    folder = str(tmp_path)
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_crowded_buckets_are_compared_to_the_end(spark):
    """Texts that all share their keys and their shingles, more than the rounds get through."""
    import random

    from paysleuth.llm import fuzzy_near_dedup as fuzzy
    from paysleuth.llm.common import Scratch
    from paysleuth.llm.components import connected

    rng = random.Random(11)
    sets = [sorted(rng.sample(range(1, 25), 10)) for _ in range(60)]
    for own in sets[:20]:
        spare = rng.choice([h for h in range(1, 25) if h not in own])
        sets.append(sorted(own[1:] + [spare]))
    rng.shuffle(sets)
    bits = [0] * (fuzzy.fingerprint_bits(2) // 64)
    rows = [(i, len(own), bits, [7], own) for i, own in enumerate(sets)]
    all_rows = spark.createDataFrame(rows, "node long, size int, bits array<long>, keys array<long>, hashes array<long>")
    bodies_of = lambda nodes: all_rows.select("node", "hashes").join(nodes, "node", "left_semi")
    prints = all_rows.drop("hashes")
    edges = fuzzy.near_links(prints, bodies_of, 0.8, 2, bucket=4, rounds=1, scratch=Scratch(spark))
    got = {r["node"]: r["root"] for r in connected(edges).collect()}
    root = list(range(len(sets)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets[:a]):
                if len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)):
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: got.get(i, i) for i in range(len(sets))} == dict(enumerate(root))
    assert len(set(root)) < len(sets) - 10


def test_a_pair_meets_only_at_keys_that_can_be_the_first_it_shares(spark):
    """Texts of 100 shingles with one key: at place 20 the rest is too short for a similarity of 0.8, at place 11 not."""
    from paysleuth.llm import fuzzy_near_dedup as fuzzy
    from paysleuth.llm.common import Scratch

    bits = [0] * (fuzzy.fingerprint_bits(2) // 64)
    prints = spark.createDataFrame([(i, 100, bits) for i in range(42)], "node long, size int, bits array<long>")
    rows = [(7, i, 42, i, 11 if i in (3, 5) else 20) for i in range(42)]
    members = spark.createDataFrame(rows, "key long, node long, n long, root long, place int")
    pairs = fuzzy.Linker(prints, 0.8, 2, Scratch(spark)).across(members)
    assert [tuple(p) for p in pairs.collect()] == [(5, 3)]


def test_shingles_are_hashed_once_by_one_worker_a_task(spark):
    """A filter on the hashes had them worked out twice, by two Python workers for each task."""
    from paysleuth.llm import fuzzy_near_dedup as fuzzy
    from paysleuth.llm.common import BitTable, whole_text
    from paysleuth.llm.fuzzy_near_dedup import shingle_hashes

    texts = [(0, "a b c d e f a b c d e f"), (1, ""), (2, None), (3, "two words"), (4, "not asked for at all")]
    given = spark.createDataFrame(texts, "node long, text string").withColumn("text", whole_text("text"))
    asked = BitTable.of(given.filter("node < 4"), "node")
    some = fuzzy.hashes_of(given, 5, asked)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "EvalPython" not in plan
    want = {i: shingle_hashes(t or "", 5).view(np.int64).tolist() for i, t in texts[:4]}
    assert {r["node"]: r["hashes"] for r in some.collect()} == want
    empty = fuzzy.hashes_of(given.filter("node = 4"), 5, asked)
    assert empty.collect() == []


def test_near_stage_hashes_in_one_worker_a_task(spark, monkeypatch):
    from paysleuth.llm import fuzzy_near_dedup as fuzzy
    from paysleuth.llm.common import Scratch

    plans, table = [], Scratch.table

    def seen(self, df, label):
        if label == "near-bodies":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, label)

    monkeypatch.setattr(Scratch, "table", seen)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(3)], "doc_id long, text string")
    assert [r["doc_id"] for r in fuzzy.near_dedup(docs).collect()] == [0]
    assert plans and all(p.count("EvalPython") + p.count("MapInPandas") == 1 for p in plans)
