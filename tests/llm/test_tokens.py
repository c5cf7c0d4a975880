import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from paysleuth.llm import packing, token_files, tokens
from paysleuth.session import scratch_path


@pytest.fixture(scope="module")
def library(word_bpe):
    t = Tokenizer.from_file(word_bpe)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_word_by_word_equals_the_library(word_bpe, library):
    known = tokens.Encoder(tokens.tokenizer_spec(word_bpe), max_words=40)
    assert known.wordwise
    rng = random.Random(3)
    alphabet = ["a", "The", "É", "ß", "'s", "don't", "42", ".", ",", "!?", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0",
                "µ", "Ÿ", "İ", "日本", "é", "<|endoftext|>", "<|", "|>", "x.y", "...", "zz,", "ÿ", "·", " ", "Σς"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(known.encode(text), "<u4").tolist() == library(text), repr(text)


def want_ids(rows, library):
    return [(i, library(t or "") + [2]) for i, t, _ in rows]


def test_files_give_back_every_document(spark, awkward, word_bpe, library):
    folder = scratch_path(spark, "tokens")
    written = token_files.write_token_files(awkward, word_bpe, folder, file_bytes=40_000, sample_rows=3)
    got = sorted(token_files.read_token_files(spark, written).collect(), key=lambda r: r["start"])
    rows = want_ids([tuple(r) for r in awkward.collect()], library)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(
        ((i, len(ids), crc(ids)) for i, ids in rows), key=key
    )
    name = written.files.orderBy("part").first()["file"]
    one = token_files.TokenFile(folder, name)
    assert one.header["dictionary"] == written.dictionary
    assert one.ids(len(one.index) - 1).tolist()[-1] == 2


def test_no_rows(spark, awkward, word_bpe):
    assert token_files.token_digest(awkward.limit(0), word_bpe).count() == 0
    assert packing.pack(awkward.limit(0), word_bpe).count() == 0


def test_least_squares_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        columns = packing.fillings(12, 3, np.ones(13, dtype=bool))
        target = np.concatenate([[0], rng.integers(0, 30, 12)]).astype(float)
        x = packing.nonnegative_least_squares(columns, target)
        a = np.zeros((13, len(columns)))
        for j, c in enumerate(columns):
            for k in c:
                a[k, j] += 1
        slope = a.T @ (a @ x - target)
        assert (x >= 0).all() and (slope > -1e-4).all() and abs(slope @ x) < 1e-3


def test_every_plan_places_every_piece():
    rng = np.random.default_rng(1)
    for most in (0, 1, 5, 400):
        histogram = np.concatenate([[0], rng.integers(0, most + 1, 64)])
        plan = packing.make_plan(histogram)
        placed = np.zeros_like(histogram)
        for lengths, n in plan.patterns:
            assert sum(lengths) <= 64
            for k in lengths:
                placed[k] += n
        assert (placed == histogram).all()


def test_pieces_fill_sequences(awkward, word_bpe, library):
    rows = want_ids([tuple(r) for r in awkward.collect()], library)
    got = packing.pack(awkward, word_bpe, window=256, cells=4).collect()
    assert sum(r["length"] for r in got) == sum(len(ids) for _, ids in rows)
    pieces = sorted(
        (i is not None, i or 0, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes()), len(ids))
        for i, ids in rows
        for s in range(0, len(ids), 256)
    )
    assert pieces == sorted(
        (r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got
    )
    sequences = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 256 and sorted(sequences) == list(range(len(sequences)))


def test_packing_takes_one_kind_of_worker(awkward, word_bpe):
    """Tables from the driver are no RDDs of pickled rows: those take a second daemon with workers on each executor."""
    plan = packing.pack(awkward, word_bpe)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan


def test_the_model_is_held_once(word_bpe):
    """Words and whole texts go through one model: what is changed in one is seen in the other."""
    known = tokens.Encoder(tokens.tokenizer_spec(word_bpe))
    assert known.plain.model.dropout is None
    known.tokenizer.model.dropout = 0.5
    assert known.plain.model.dropout == 0.5
    assert known.plain.get_added_tokens_decoder() == known.tokenizer.get_added_tokens_decoder()
