"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked id pairs.

Tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) over the same bytes meet where both end. Each such
place closes a group and links the two tokens that end there.

Counting is external. Tasks tokenise whole texts and sort the records (B id, A id, document, how often) of a few
megabytes of text, side-major, into one zstd run per radix part of the B ids; the runs are a table in the shared
folder. The pairs of each run, with their counts there, go to their part, where a heap merges all runs in order:
a pair's total is known when the pair ends, the highest total of a B id when the id ends, and both go back to the entries
of the runs they came from. Last, each run turns its records into sums for its documents.

What is exchanged is one entry for each pair and run, however many documents hold the pair; a part gets about as many
entries at every size, since parts grow in number with the text.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysleuth.llm.common import whole_text
from paysleuth.llm.packed import pack, pack_bits, pack_sorted, unpack, unpack_bits, unpack_sorted
from paysleuth.llm.tokens import tokenizer_spec
from paysleuth.session import materialized

RUN_BYTES = 8 << 20  # of text in a run
PART_BYTES = 64 << 20  # of text to a radix part
BLOCK_BYTES = 1 << 20  # of text aligned at once
AT_ONCE = 64  # texts given to a tokenizer in one call
WORDS_KEPT = 200_000  # whose ids a worker keeps, of each tokenizer

# The byte-level tokenizer's rule for words, on ASCII, and the settings under which words are encoded apart.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}



def byte_level_bytes(token: str) -> bytes:
    """Bytes of a byte-level entry: printable characters of Latin-1 are themselves, the other bytes follow from U+0100 on."""
    return bytes(_byte_of(c) for c in token)


@lru_cache(maxsize=512)
def _byte_of(c: str) -> int:
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    if ord(c) < 0x100:
        return ord(c)
    rest = [b for b in range(256) if b not in plain]
    return rest[ord(c) - 0x100]


class Numerals:
    """Decimal numerals of ids as bytes, left-justified, with room for a separator."""

    def __init__(self, ids: int):
        width = len(str(max(ids - 1, 0)))
        self.digits = np.zeros((ids, width + 1), dtype=np.uint8)
        numbers = np.arange(ids)
        self.length = np.ones(ids, dtype=np.int64)
        for k in range(1, width):
            self.length[numbers >= 10**k] = k + 1
        for k in range(width):
            has = self.length > k
            self.digits[has, k] = ord("0") + numbers[has] // 10 ** (self.length[has] - 1 - k) % 10


class Aligned(NamedTuple):
    """Of some texts: counts per text, the groups' bytes per text, and per link the text's number, A id and B id."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    text: np.ndarray
    a: np.ndarray
    b: np.ndarray


class Words:
    """Ids of words met before, as bytes of 32-bit integers; None where the tokens' bytes are not the word's."""

    def __init__(self, encode, table: list[bytes], before: bytes, most: int = WORDS_KEPT):
        """encode: words -> lists of ids; before: what the tokenizer puts in front of a word."""
        self.encode, self.table, self.before, self.most = encode, table, before, most
        self.known: dict[str, bytes | None] = {}

    def ids(self, words: list[str]) -> np.ndarray | None:
        new = [w for w in set(words) if w not in self.known]
        if new:
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = list(set(words))
            for w, ids in zip(new, self.encode(new), strict=True):
                fits = b"".join(map(self.table.__getitem__, ids)) == self.before + w.encode()
                self.known[w] = np.asarray(ids, dtype=np.int32).tobytes() if fits else None
        found = [self.known[w] for w in words]
        return None if None in found else np.frombuffer(b"".join(found), dtype=np.int32)


class Aligner:
    """Both tokenizers of a worker. byte_spec: JSON of the tokenizers library; piece_model: a sentencepiece model.

    Neither vocabulary has a token that goes on after a space it did not begin with, so the ids of a text are those of its
    words, and words repeat. Texts in ASCII with single spaces are put together from words; the libraries get new
    words, and all other texts whole.
    """

    def __init__(self, byte_spec: str, piece_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many tasks as there are cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.bytewise = Tokenizer.from_str(byte_spec)
        self.bytewise.encode_special_tokens = True
        self.piecewise = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        vocabulary = self.bytewise.get_vocab()
        added = {t.content for t in self.bytewise.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if token in added else byte_level_bytes(token)
        pieces = [self.piecewise.id_to_piece(i) for i in range(self.piecewise.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.piecewise.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_size = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.a_numerals, self.b_numerals = Numerals(len(self.a_bytes)), Numerals(len(self.b_bytes))
        settings = json.loads(byte_spec)
        rule = settings.get("pre_tokenizer") or {}
        self.wordwise = (
            settings.get("normalizer") is None
            and settings.get("post_processor") is None
            and {k: rule.get(k) for k in _BYTE_LEVEL} == _BYTE_LEVEL
            and not any("▁" in p[1:] and p.strip("▁") for p in pieces)
        )
        self.a_words = Words(self._byte_ids, self.a_bytes, b"")
        self.b_words = Words(self._piece_ids, self.b_bytes, b" ")

    def _byte_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.bytewise.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece_ids(self, texts: list[str]) -> list[list[int]]:
        return self.piecewise.encode(texts, num_threads=1)

    def _of_words(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        pieces = text.split(" ")
        if "" in pieces:
            return None
        a, b = self.a_words.ids(_WORDS.findall(" " + text)), self.b_words.ids(pieces)
        return None if a is None or b is None else (a, b)

    def _whole(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        none = np.zeros(0, dtype=np.int32)
        for text, a, b in zip(texts, self._byte_ids([" " + t for t in texts]), self._piece_ids(texts), strict=True):
            whole = b" " + text.encode()
            fits = (
                text != ""
                and b"".join(map(self.a_bytes.__getitem__, a)) == whole
                and b"".join(map(self.b_bytes.__getitem__, b)) == whole
            )
            yield (np.asarray(a, dtype=np.int32), np.asarray(b, dtype=np.int32)) if fits else (none, none)

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """A and B ids of each text; none for an empty one and where the tokens' bytes are not a space and the text."""
        found = [self._of_words(t) if self.wordwise and t.isascii() else None for t in texts]
        rest = [k for k, x in enumerate(found) if x is None]
        for i in range(0, len(rest), AT_ONCE):
            some = rest[i : i + AT_ONCE]
            for k, ids in zip(some, self._whole([texts[k] for k in some]), strict=True):
                found[k] = ids
        return found

    def align(self, texts: list[str]) -> Aligned:
        found = self.tokens(texts)
        n_a = np.array([len(a) for a, _ in found], dtype=np.int64)
        n_b = np.array([len(b) for _, b in found], dtype=np.int64)
        a = np.concatenate([np.zeros(0, dtype=np.int64), *[x for x, _ in found]])
        b = np.concatenate([np.zeros(0, dtype=np.int64), *[x for _, x in found]])
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])  # of a text all bytes are in both
        total = int(a_end[-1]) if len(a_end) else 0
        ends = np.zeros(total + 1, dtype=bool)
        ends[a_end] = True
        b_cut = ends[b_end]
        ends[:] = False
        ends[b_end] = True
        a_cut = ends[a_end]
        text = np.repeat(np.arange(len(texts)), n_a)[a_cut]
        n_links = np.bincount(text, minlength=len(texts))
        groups = self._groups(a, b, a_cut, b_cut, n_links)
        return Aligned(n_a, n_b, n_links, groups, text, a[a_cut], b[b_cut])

    def _groups(self, a, b, a_cut, b_cut, n_links) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        many = int(n_links.sum())
        a_upto = np.cumsum(np.bincount(a_group, minlength=many))
        b_upto = np.cumsum(np.bincount(b_group, minlength=many))
        a_place = np.arange(len(a)) + np.concatenate([[0], b_upto])[a_group]
        b_place = np.arange(len(b)) + a_upto[b_group]
        last = np.zeros(many, dtype=bool)  # groups that end a text
        last[(np.cumsum(n_links) - 1)[n_links > 0]] = True
        width = max(self.a_numerals.digits.shape[1], self.b_numerals.digits.shape[1])
        rows = np.zeros((len(a) + len(b), width), dtype=np.uint8)
        size = np.empty(len(rows), dtype=np.int64)
        for ids, place, cut, known, mark in ((a, a_place, a_cut, self.a_numerals, "|"), (b, b_place, b_cut, self.b_numerals, ";")):
            rows[place, : known.digits.shape[1]] = known.digits[ids]
            rows[place, known.length[ids]] = np.where(cut, ord(mark), ord(","))
            size[place] = known.length[ids] + 1
        size[b_place[b_cut][last]] -= 1
        written = rows[np.arange(width) < size[:, None]].tobytes()
        upto = np.concatenate([[0], np.cumsum(size)])
        tokens = np.zeros(len(n_links), dtype=np.int64)  # rows of each text
        group_text = np.repeat(np.arange(len(n_links)), n_links)
        np.add.at(tokens, group_text, np.diff(a_upto, prepend=0) + np.diff(b_upto, prepend=0))
        cuts = upto[np.concatenate([[0], np.cumsum(tokens)])]
        return [written[s:e] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def _aligner(byte_spec: str, piece_model: bytes) -> Aligner:
    return Aligner(byte_spec, piece_model)


def _blocks(texts: list[str], most: int):
    """Slices of neighbouring texts with about ``most`` characters."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > most:
            yield slice(start, k)
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


class Run:
    """Records of one run in the making."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.records: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list, found: Aligned, a_bits: int) -> None:
        base = len(self.docs)
        links = found.n_links.tolist()
        hashes = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(found.groups, found.n_a.tolist(), strict=True)]
        numbers = [0 if i is None else i for i in ids]
        self.docs += zip(numbers, [i is None for i in ids], found.n_a.tolist(), found.n_b.tolist(), links, links, hashes, strict=True)
        self.records.append(np.stack([found.b << a_bits | found.a, base + found.text]))

    def row(self, a_bits: int, parts: int) -> dict:
        """The run's documents, and per part its records side-major: pairs with counts, of each the documents and how often."""
        pair, doc = np.concatenate(self.records, axis=1)
        bits = len(self.docs).bit_length()
        both, often = np.unique(pair << bits | doc, return_counts=True)
        pair, doc = both >> bits, both & ((1 << bits) - 1)
        radix = (pair >> a_bits) % parts
        entries = []
        for k in np.unique(radix).tolist():
            of = np.flatnonzero(radix == k)
            first = np.flatnonzero(np.diff(pair[of], prepend=-1))
            entries.append(
                {
                    "part": k,
                    "pairs": pack_sorted(pair[of][first]),
                    "counts": pack(np.add.reduceat(often[of], first)),
                    "many": pack(np.diff(np.append(first, len(of)))),
                    "docs": pack(doc[of]),
                    "often": pack(often[of]),
                }
            )
        columns = dict(zip(_DOC_COLUMNS, map(list, zip(*self.docs, strict=True)), strict=True))
        return {"run": uuid.uuid4().hex, **columns, "entries": entries}


_DOC_COLUMNS = ("doc_id", "no_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_ENTRY = "struct<part: int, pairs: binary, counts: binary, many: binary, docs: binary, often: binary>"
_RUN_SCHEMA = (
    "run string, doc_id array<long>, no_id array<boolean>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    f"n_links array<long>, groups_sha256 array<string>, entries array<{_ENTRY}>"
)


def aligned_runs(rows: DataFrame, byte_spec: str, piece_model: bytes, a_bits: int, run_bytes: int, part_bytes: int) -> DataFrame:
    """The runs as a table in the shared folder. rows: doc_id, _text."""
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shared = rows.sparkSession.sparkContext.broadcast((byte_spec, piece_model))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _aligner(*shared.value)
        parts = max(1, min(len(known.b_bytes), -(-total // part_bytes)))
        run = Run()
        for batch in batches:
            texts = batch["_text"].tolist()
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"].astype("Int64")]
            for some in _blocks(texts, min(BLOCK_BYTES, run_bytes)):
                run.add(ids[some], known.align(texts[some]), a_bits)
                run.size += sum(map(len, texts[some]))
                if run.size >= run_bytes:
                    yield pd.DataFrame([run.row(a_bits, parts)])
                    run = Run()
        if run.docs:
            yield pd.DataFrame([run.row(a_bits, parts)])

    return materialized(rows.mapInPandas(write, _RUN_SCHEMA), "alignment-runs")


class Entries(NamedTuple):
    """Totals of one run's pairs in one part."""

    total: np.ndarray
    best: np.ndarray


def merged_counts(runs: list[tuple[bytes, bytes]], a_bits: int) -> list[Entries]:
    """Merge the runs' pairs (ascending) with a heap; each entry learns its pair's total and whether it is its B id's highest."""

    def entries(k: int):
        pairs, counts = unpack_sorted(runs[k][0]), unpack(runs[k][1])
        return ((p, k, i, c) for i, (p, c) in enumerate(zip(pairs.tolist(), counts.tolist(), strict=True)))

    sizes = [len(unpack(p)) for p, _ in runs]
    found = [Entries(np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)) for n in sizes]
    merged = heapq.merge(*[entries(k) for k in range(len(runs))])
    for _, side in itertools.groupby(merged, lambda e: e[0] >> a_bits):
        highest, holders = 0, []
        for _, same in itertools.groupby(side, lambda e: e[0]):
            where = []
            total = 0
            for _, k, i, count in same:
                total += count
                where.append((k, i))
            for k, i in where:
                found[k].total[i] = total
            if total > highest:
                highest, holders = total, where
            elif total == highest:
                holders = holders + where
        for k, i in holders:
            found[k].best[i] = True
    return found


def pair_totals(runs: DataFrame, a_bits: int) -> DataFrame:
    """run, part, totals, best: what each run's entries learn."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        found = merged_counts(list(zip(group["pairs"], group["counts"], strict=True)), a_bits)
        return pd.DataFrame(
            {
                "run": group["run"].to_numpy(),
                "part": group["part"].to_numpy(),
                "totals": [pack(f.total) for f in found],
                "best": [pack_bits(f.best) for f in found],
            }
        )

    light = runs.select("run", F.explode("entries").alias("_e")).select("run", "_e.part", "_e.pairs", "_e.counts")
    return light.groupBy("part").applyInPandas(merge, "run string, part int, totals binary, best binary")


def _with_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per document of each run: its counts, and its records' sums by what the run's entries learned."""
    for batch in batches:
        for run in batch.to_dict("records"):
            n = len(run["n_a"])
            n_best, count_sum = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            learned = {x["part"]: x for x in (run["learned"] if run["learned"] is not None else [])}
            for e in run["entries"]:
                many, doc, often = unpack(e["many"]), unpack(e["docs"]), unpack(e["often"])
                total, best = unpack(learned[e["part"]]["totals"]), unpack_bits(learned[e["part"]]["best"])
                np.add.at(count_sum, doc, often * np.repeat(total, many))
                np.add.at(n_best, doc, often * np.repeat(best, many))
            ids = pd.Series(run["doc_id"], dtype="Int64").mask(pd.Series(run["no_id"], dtype=bool))
            yield pd.DataFrame({"doc_id": ids, "n_a": run["n_a"], "n_b": run["n_b"], "n_groups": run["n_groups"], "n_links": run["n_links"], "n_best": n_best, "count_sum": count_sum, "groups_sha256": run["groups_sha256"]})


class Alignment(NamedTuple):
    """What ``align_tokenizers`` finds: a row per document, and a table of linked pairs (made when it is read)."""

    documents: DataFrame
    pairs: DataFrame


def align_tokenizers(
    docs: DataFrame,
    byte_tokenizer: str,
    piece_model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    run_bytes: int = RUN_BYTES,
    part_bytes: int = PART_BYTES,
) -> Alignment:
    """Align whole texts, as space + text by the byte-level tokenizer (A) and text by the piece model (B).

    documents, one row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest
    count of its B id, ties included), count_sum (counts of its links), groups_sha256 (of ``a1,a2|b1;a3|b2,b3``).
    pairs: a_id, b_id, links (occurrences over all documents), best.
    Null and empty texts, and texts whose tokens' bytes are not a space and the text, have zeros and ''. Repeated rows
    count as often as they occur; null ids stay null; other columns play no part; an empty table gives empty results.
    """
    spec = tokenizer_spec(byte_tokenizer)
    with open(piece_model, "rb") as f:
        model = f.read()
    settings = json.loads(spec)
    known = [*settings["model"]["vocab"].values(), *(t["id"] for t in settings["added_tokens"])]
    a_bits = max(known).bit_length()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("_text"))
    runs = aligned_runs(rows, spec, model, a_bits, run_bytes, part_bytes)
    totals = materialized(pair_totals(runs, a_bits), "alignment-totals")
    learned = totals.groupBy("run").agg(F.collect_list(F.struct("part", "totals", "best")).alias("learned"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    documents = runs.join(learned, "run", "left").mapInPandas(_with_sums, schema)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pairs, known, high in zip(batch["pairs"], batch["totals"], batch["best"], strict=True):
                pair = unpack_sorted(pairs)
                yield pd.DataFrame({"a_id": pair & ((1 << a_bits) - 1), "b_id": pair >> a_bits, "links": unpack(known), "best": unpack_bits(high)})

    light = runs.select("run", F.explode("entries").alias("_e")).select("run", "_e.part", "_e.pairs")
    pairs = light.join(totals, ["run", "part"]).mapInPandas(listed, "a_id long, b_id long, links long, best boolean").distinct()
    return Alignment(documents, pairs)


def alignment_digest(docs: DataFrame, byte_tokenizer: str, piece_model: str) -> DataFrame:
    """The documents of ``align_tokenizers``, nulls, repeats and empty tables as there."""
    return align_tokenizers(docs, byte_tokenizer, piece_model).documents
