import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paysleuth.llm import packed
from paysleuth.llm import token_alignment as ta


@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows, files):
    """Tokens with byte ranges, one pair after another."""
    bytewise = Tokenizer.from_file(files[0])
    bytewise.encode_special_tokens = True
    names = {i: t for t, i in bytewise.get_vocab().items()}
    # the byte a character stands for, from the tokenizer's own decoder: one byte of Latin-1 at a time
    model = sentencepiece.SentencePieceProcessor(model_file=files[1])
    table = {}
    odd = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table[chr(b)] = b
        else:
            table[chr(256 + odd)] = b
            odd += 1
    per_doc, counts = [], Counter()
    for _, text in rows:
        a = [(i, bytes(table[c] for c in names[i])) for i in bytewise.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = []
        for i in model.encode(text or ""):
            p = model.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("\u2581", " ").encode()))
        want = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            per_doc.append(([], [], [], ""))
            continue
        def ends(tokens):
            at, found = 0, {}
            for i, x in tokens:
                at += len(x)
                found[at] = i
            return found
        ea, eb = ends(a), ends(b)
        links = [(ea[e], eb[e]) for e in sorted(ea) if e in eb]
        cuts = [e for e in sorted(ea) if e in eb]
        groups, low = [], 0
        for e in cuts:
            one = [",".join(str(t[x]) for x in sorted(t) if low < x <= e) for t in (ea, eb)]
            groups.append("|".join(one))
            low = e
        per_doc.append((a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        counts.update(links)
    high = {}
    for (_, b), n in counts.items():
        high[b] = max(high.get(b, 0), n)
    result = []
    for (i, _), (a, b, links, digest) in zip(rows, per_doc, strict=True):
        best = sum(counts[p] == high[p[1]] for p in links)
        result.append((i, len(a), len(b), len(links), len(links), best, sum(counts[p] for p in links), digest))
    return result, counts, high


ODD = [None, "", " ", "  two  spaces ", "tab\tand\nline\n\n", "<|endoftext|> inside", "<s> </s> <unk> <0x41>", "\u2581 mark",
       "É straße 日本語 🙂 ﬁ x\u0301", "\x00nul", "a" * 700, "12345 67,890.5", "don't we'll", "\u3000wide \u00a0hard"]


def some_rows(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "cat", "reoush", "hewh", "antiing", "x1", "São", "42", "don't", "(a)", "zzzzz", "日本"]
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(None, "the cat"), (7, "the cat"), (7, "the cat")]


def test_documents_and_pairs_equal_plain_code(spark, files):
    rows = some_rows(120)
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, n_a int, run string").repartition(3)
    want, counts, high = plain(rows, files)
    found = ta.align_tokenizers(docs, *files, run_bytes=1500, part_bytes=1000)
    assert sorted(map(tuple, found.documents.collect()), key=str) == sorted(want, key=str)
    pairs = {(r["a_id"], r["b_id"]): (r["links"], r["best"]) for r in found.pairs.collect()}
    assert pairs == {p: (n, n == high[p[1]]) for p, n in counts.items()}
    one = ta.alignment_digest(docs, *files)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(want, key=str)
    assert any(n for _, n, *_ in want[:14]) and want[3][1] == len(Tokenizer.from_file(files[0]).encode("   two  spaces ").ids)


def test_awkward_tables(spark, files, awkward):
    got = ta.alignment_digest(awkward, *files).collect()
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows, files)[0], key=str)
    assert ta.alignment_digest(awkward.limit(0), *files).count() == 0


def test_entries_spell_the_bytes_that_the_library_decodes(files):
    known = ta.Aligner(open(files[0], encoding="utf-8").read(), open(files[1], "rb").read())
    vocabulary = json.load(open(files[0], encoding="utf-8"))["model"]["vocab"]
    assert sorted(known.a_bytes[i] for t, i in vocabulary.items() if len(t) == 1) == [bytes([b]) for b in range(256)]


def test_words_give_the_ids_of_whole_texts(files):
    """Put together from words or encoded whole: the same ids, also with few words kept."""
    rng = random.Random(12)
    known = ta.Aligner(open(files[0], encoding="utf-8").read(), open(files[1], "rb").read())
    assert known.wordwise
    known.a_words.most = known.b_words.most = 40
    marks = ["'s", "'LL", "don't", "a\n\nb", "\n", "\t x", "12ab34", "...!?", "('quoted')", "<|endoftext|>", "<0x41>", "\x1c", "\x00", "'", "_", "A" * 90]
    words = marks + ["".join(rng.choice("abcdeXYZ019.,'-") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for text, (a, b), (c, d) in zip(texts, known.tokens(texts), known._whole(texts), strict=True):
        assert a.tolist() == c.tolist() and b.tolist() == d.tolist(), text
    assert sum(known._of_words(t) is not None for t in texts) > 350


def test_merge_learns_totals_and_ties():
    runs = [np.array([(1 << 4) | 1, (1 << 4) | 2, (2 << 4) | 1]), np.array([(1 << 4) | 2]), np.array([], dtype=np.int64)]
    counts = [np.array([5, 2, 1]), np.array([3]), np.array([], dtype=np.int64)]
    found = ta.merged_counts([(packed.pack_sorted(p), packed.pack(c)) for p, c in zip(runs, counts, strict=True)], 4)
    assert [f.total.tolist() for f in found] == [[5, 5, 1], [5], []]
    assert [f.best.tolist() for f in found] == [[True, True, True], [True], []]


@given(st.lists(st.integers(0, 2**62)))
def test_packed_arrays_come_back(values):
    numbers = np.array(values, dtype=np.int64)
    assert packed.unpack(packed.pack(numbers)).tolist() == values
    assert packed.unpack_sorted(packed.pack_sorted(np.sort(numbers))).tolist() == sorted(values)
    assert packed.unpack_bits(packed.pack_bits(numbers % 2 == 1)).tolist() == [v % 2 == 1 for v in values]
