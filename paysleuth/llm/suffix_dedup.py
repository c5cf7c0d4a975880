"""Removal of long strings that an earlier document holds too, by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts in a document of smaller id. Strings are compared
as bytes and judged on the input. The steps:

1. Chunks. Tasks write a few megabytes of text to a compressed file in the shared folder. Of equal whole texts only those
   of the smallest id go on; the others have an earlier copy of every string they hold.
2. Anchors. The anchor of a string is the shorter substring of least hash in it (two thirds of its length), so equal
   strings have equal anchors, and neighbouring strings mostly share one: these form a segment. Chunks send their
   distinct anchors as sorted differences; those that no second document has cannot belong to a repeated string. Nothing
   is decided by a hash beyond this: anchors only say which suffixes are sorted.
3. Runs. Each chunk sorts the suffixes that start at its candidate anchors (to the end of the segment, then what
   precedes the anchor), keeps one entry per distinct string with the smallest id that has it, and sends the
   entries front-coded: the length of the prefix they share with the entry before, and the rest. Splitters from
   a sample of the candidates cut the runs into ranges.
4. Merge. In each range a loser tree merges the runs of all chunks. Every entry carries the length of the prefix it
   shares with the last one that was put out, so a match compares two lengths, and only where these are equal bytes,
   from there on. Strings of one anchor come out together, equal ones as one, and each learns which of its segment's
   strings a smaller id has.
5. An anchor with more than ``MOST_STRINGS`` different surroundings (a line that very many texts hold) is left open
   there. Its segments' single suffixes, of ``length`` bytes each, are sorted, sent and merged in the same way, spread over
   all ranges.
6. Chunks turn what their entries learned into spans.

A string that many documents hold is one entry per chunk. Tasks work on a chunk, a range of anchors or a range of
strings, all of which grow in number, not in size, with the text.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysleuth.llm.common import open_folder, whole_text
from paysleuth.llm.packed import pack, pack_bits, pack_sorted, unpack, unpack_bits, unpack_sorted
from paysleuth.session import materialized, scratch_path

LENGTH = 50
CHUNK_BYTES = 8 << 20  # of text in a chunk
PART_BYTES = 16 << 20  # of text to a range of anchors
RANGE_BYTES = 16 << 20  # of text to a range of strings
MOST_STRINGS = 4096  # of one anchor that a merge holds at once
SAMPLE_CHUNKS, SAMPLE_STRINGS = 16, 2000  # for splitters: at most so many chunks, strings of each
NULL_ID = (1 << 63) - 1  # null ids are after all others
_BLOCK = 1 << 16
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _first_least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each ``width`` neighbours and the place of the first such."""
    at, span = np.arange(len(values), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)  # the last two stretches overlap
        right = values[step:] < values[: len(values) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        values = np.minimum(values[step:], values[: len(values) - step])
        span += step
    return values, at


def _hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes."""
    word, span = text.astype(np.uint64), 1
    while 2 * span <= min(8, gram):
        word = (word[:-span] << np.uint64(8 * span)) | word[span:]
        span *= 2
    n = len(text) - gram + 1
    found = np.zeros(n, dtype=np.uint64)
    offsets = list(range(0, gram - span, span)) + [gram - span]
    for k, at in enumerate(offsets):
        found += word[at : at + n] * _FACTORS[k % 4]
        if k % 4 == 3 or k == len(offsets) - 1:
            found ^= found >> np.uint64(32)
            found *= _MULTIPLY
    found ^= found >> np.uint64(29)
    return found


def gram_of(length: int) -> int:
    """Bytes of an anchor: about two thirds, and at most 61 strings to an anchor."""
    return max(1, 2 * length // 3 - 1, length - 60)


def anchor_changes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, anchors): the string at a place, and those after it up to the next, have the anchor that starts there."""
    gram = gram_of(length)
    places, hashes, anchors = [], [], []
    last = -1
    for low in range(0, len(text) - length + 1, _BLOCK):
        least, at = _first_least(_hashes(text[low : low + _BLOCK + length - 1], gram), length - gram + 1)
        new = np.flatnonzero(np.diff(at, prepend=last - low))
        last = at[-1] + low
        places.append(new + low)
        hashes.append(least[new])
        anchors.append(at[new].astype(np.int64) + low)
    if not places:
        none = np.zeros(0, dtype=np.int64)
        return none, none.view(np.uint64), none
    return np.concatenate(places), np.concatenate(hashes), np.concatenate(anchors)


class Segments(NamedTuple):
    """Neighbouring strings of one document with one anchor: first start, start after the last, anchor, its hash, document."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray


def segments(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, use: np.ndarray, length: int, bits: int) -> Segments:
    """The segments of the documents in use; hashes keep their upper ``bits``."""
    places, hashes, at = anchor_changes(text, length)
    long = np.flatnonzero(use & (sizes >= length))
    if not len(long) or not len(places):
        none = np.zeros(0, dtype=np.int64)
        return Segments(none, none, none, none, none)
    first = np.searchsorted(places, starts[long], side="right") - 1  # the segment that a document's start is in
    inner = starts[long] != places[first]
    points = np.insert(places, first[inner] + 1, starts[long][inner])
    of = np.insert(np.arange(len(places)), first[inner] + 1, first[inner])
    begins = np.append(np.searchsorted(points, starts[long]), len(points))
    doc = np.concatenate([np.full(begins[0], -1), np.repeat(long, np.diff(begins))])
    end = np.minimum(np.append(points[1:], len(text)), starts[doc] + sizes[doc] - length + 1)
    kept = np.flatnonzero((doc >= 0) & (end > points))
    of = of[kept]
    anchor = (hashes[of] >> np.uint64(64 - bits)).astype(np.int64)
    return Segments(points[kept], end[kept], at[of], anchor, doc[kept])


class Chunk(NamedTuple):
    text: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    use: np.ndarray  # not a later copy of another document


def read_chunk(folder: str, row: dict) -> Chunk:
    fs, path = open_folder(folder)
    with fs.open_input_stream(f"{path}/{row['chunk']}") as f:
        text = np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read()), dtype=np.uint8)
    ids, sizes = np.asarray(row["ids"], dtype=np.int64), np.asarray(row["sizes"], dtype=np.int64)
    use = np.ones(len(ids), dtype=bool)
    if row["copies"] is not None:
        use[np.asarray(row["copies"], dtype=np.int64)] = False
    return Chunk(text, ids, np.cumsum(sizes) - sizes, sizes, use)


class Scale(NamedTuple):
    """What the steps agree on, set by the length of all texts together."""

    length: int
    bits: int
    parts: int
    ranges: int


def scale(total: int, length: int, part_bytes: int, range_bytes: int) -> Scale:
    bits = min(60, max(16, (total // 10 + 1).bit_length() + 10))  # one in a thousand anchors meets another by chance
    return Scale(length, bits, max(1, -(-total // part_bytes)), max(1, -(-total // range_bytes)))


class Anchors(NamedTuple):
    """Distinct anchors of a chunk, ascending, whether two of its documents have them, the range of each; each segment's."""

    value: np.ndarray
    several: np.ndarray
    part: np.ndarray
    number: np.ndarray


def chunk_anchors(chunk: Chunk, found: Segments, by: Scale) -> Anchors:
    order = np.lexsort((chunk.ids[found.doc], found.anchor))
    value, ids = found.anchor[order], chunk.ids[found.doc][order]
    new = np.diff(value, prepend=-1) != 0
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(value))[: len(first)] - 1
    value = value[first]
    part = (value.astype(np.float64) * (by.parts / 2.0**by.bits)).astype(np.int64)
    return Anchors(value, ids[first] != ids[last], part, number)


def shared_anchors(runs: list[tuple[bytes, bytes]]) -> list[np.ndarray]:
    """For each run's anchors of one range whether a second document has them."""
    values = [unpack_sorted(v) for v, _ in runs]
    known, times = np.unique(np.concatenate(values), return_counts=True)
    known = known[times > 1]
    found = []
    for v, (_, several) in zip(values, runs, strict=True):
        at = np.searchsorted(known, v)
        in_others = known[np.minimum(at, len(known) - 1)] == v if len(known) else np.zeros(len(v), dtype=bool)
        found.append(unpack_bits(several) | in_others)
    return found


def shared_segments(found: Segments, anchors: Anchors, shared: dict[int, np.ndarray]) -> Segments:
    """Those whose anchor a second document has."""
    flags = np.concatenate([np.zeros(0, dtype=bool), *[shared[p] for p in np.unique(anchors.part).tolist()]])
    of = np.flatnonzero(flags[anchors.number])
    return Segments(*[x[of] for x in found])


class SegmentEntries:
    """Distinct segments of a chunk in order of their strings: least id of each; of all segments the entry's number.

    The string is what stands from the anchor to the segment's end, then what precedes the anchor, backwards, both
    filled up with zeros, then both lengths; so strings of one anchor begin alike and are neighbours.
    """

    def __init__(self, chunk: Chunk, found: Segments, length: int):
        before = length - gram_of(length)
        width = length + before + 4
        made = np.zeros((len(found.start), width), dtype=np.uint8)
        text = np.concatenate([chunk.text, np.zeros(length, dtype=np.uint8)])
        right, left = found.end - 1 + length - found.at, found.at - found.start
        for k in range(length):
            made[:, k] = np.where(k < right, text[found.at + k], 0)
        for k in range(before):
            made[:, length + k] = np.where(k < left, text[found.at - 1 - k], 0)
        made[:, -4:] = np.stack([right, left], axis=1).astype(">u2").view(np.uint8)
        order = np.argsort(made.view(f"S{width}").ravel()) if len(made) else np.zeros(0, dtype=np.int64)
        made = made[order]
        new = np.ones(len(made), dtype=bool)
        new[1:] = (made[1:] != made[:-1]).any(axis=1)
        self.number = np.empty(len(made), dtype=np.int64)
        self.number[order] = np.cumsum(new) - 1
        ids = chunk.ids[found.doc]
        self.least = np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(made) else ids
        self.made = made[new]

    def string(self, k: int) -> bytes:
        return self.made[k].tobytes()

    def strings(self, low: int, high: int) -> np.ndarray:
        return self.made[low:high]


class WindowEntries(NamedTuple):
    """Distinct single strings of a chunk in order: where one stands, least id; of all places the entry's number."""

    text: np.ndarray
    length: int
    at: np.ndarray
    least: np.ndarray
    place: np.ndarray
    number: np.ndarray
    doc: np.ndarray

    def string(self, k: int) -> bytes:
        return self.text[self.at[k] : self.at[k] + self.length].tobytes()

    def strings(self, low: int, high: int) -> np.ndarray:
        return self.text[self.at[low:high, None] + np.arange(self.length)]


def _every_place(found: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, which segment, which string of it) of all strings of the segments."""
    many = found.end - found.start
    of = np.repeat(np.arange(len(many)), many)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    return found.start[of] + turn, of, turn


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    new = np.diff(key[order], prepend=key[order[:1]]) != 0
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _covered(place: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which bytes the strings at ``place`` cover."""
    change = np.zeros(size + 1, dtype=np.int32)
    np.add.at(change, place, 1)
    np.add.at(change, place + length, -1)
    return np.cumsum(change)[:-1] > 0


def sorted_windows(chunk: Chunk, found: Segments, length: int) -> WindowEntries:
    """Sort all strings of the segments by ranks of ever longer prefixes."""
    place, of, _ = _every_place(found)
    doc = found.doc[of]
    if not len(place):
        return WindowEntries(chunk.text, length, place, place, place, place, doc)
    text = np.concatenate([chunk.text, np.zeros(length + 8, dtype=np.uint8)])
    at = np.flatnonzero(_covered(place, length, len(chunk.text)))
    index = np.zeros(len(text), dtype=np.int32)
    index[at] = np.arange(len(at), dtype=np.int32)
    word, span = np.zeros(len(at), dtype=np.int64), min(7, length)
    for k in range(span):
        word = (word << 8) | text[at + k]
    rank = _ranks(word)
    while 2 * span < length:
        later = rank[index[np.minimum(at + span, at[-1])]]
        rank = _ranks(rank * (len(at) + 1) + later)
        span *= 2
    first = index[place]
    if span < length:
        rank = _ranks(rank[first] * (len(at) + 1) + rank[index[place + length - span]])
    else:
        rank = _ranks(rank[first])
    ids = chunk.ids[doc]
    distinct = int(rank.max()) + 1
    least = np.full(distinct, NULL_ID, dtype=np.int64)
    np.minimum.at(least, rank, ids)
    where = np.empty(distinct, dtype=np.int64)
    where[rank] = place
    return WindowEntries(chunk.text, length, where, least, place, rank, doc)


def front_coded(strings: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of distinct strings in order: how long a prefix each shares with the one before, and all the rests one after another."""
    shared = np.zeros(len(strings), dtype=np.int64)
    if len(strings) > 1:
        shared[1:] = (strings[1:] != strings[:-1]).argmax(axis=1)
    return shared, strings[np.arange(strings.shape[1]) >= shared[:, None]].tobytes()


class _InOrder:
    """An entries' strings as a sequence, for bisection."""

    def __init__(self, entries):
        self.entries = entries

    def __len__(self):
        return len(self.entries.least)

    def __getitem__(self, k):
        return self.entries.string(k)


def run_ranges(entries, splitters: list[bytes]) -> Iterator[dict]:
    """The chunk's run, cut at the splitters: a front-coded piece for each range that has entries."""
    cuts = [0, *[bisect.bisect_left(_InOrder(entries), s) for s in splitters], len(entries.least)]
    for k, (low, high) in enumerate(itertools.pairwise(cuts)):
        if high > low:
            shared, rest = front_coded(entries.strings(low, high))
            ids = entries.least[low:high]
            base = int(ids.min())
            yield {
                "range": k,
                "shared": pack(shared),
                "rest": zstandard.ZstdCompressor(level=3).compress(rest),
                "base": base,
                "ids": pack((ids - base).view(np.uint64)),
            }


class LoserTree:
    """Merges sorted front-coded runs of distinct strings.

    ``known[r]`` is the length of the prefix that run r's next string shares with the last string put out by the matches
    above it; the longer one wins without a look at the strings.
    """

    def __init__(self, runs: list[tuple[list[int], bytes]], length: int):
        self.length = length
        self.shared = [s for s, _ in runs]
        self.rest = [r for _, r in runs]
        self.next = [0] * len(runs)
        self.upto = [0] * len(runs)
        self.now = [b""] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.known = [-1] * self.size  # -1: at its end
        for r in range(len(runs)):
            if self.shared[r]:
                self.known[r] = 0
                self._read(r, 0)
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _read(self, r: int, keep: int) -> None:
        end = self.upto[r] + self.length - keep
        self.now[r] = self.now[r][:keep] + self.rest[r][self.upto[r] : end]
        self.upto[r] = end

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._match(self._build(2 * node), self._build(2 * node + 1), node)

    def _match(self, a: int, b: int, node: int) -> int:
        known = self.known
        h, g = known[a], known[b]
        if h == g and h >= 0:
            x, y = self.now[a], self.now[b]
            length = self.length
            while h < length and x[h] == y[h]:
                h += 1
            if h == length or x[h] < y[h]:
                known[b] = h
                self.losers[node] = b
                return a
            known[a] = h
            self.losers[node] = a
            return b
        if h > g:
            self.losers[node] = b
            return a
        self.losers[node] = a
        return b

    def groups(self) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
        """Each string, in ascending order, with (run, place in the run) wherever it stands."""
        known, losers, now = self.known, self.losers, self.now
        length, size = self.length, self.size
        shared, rest, following, upto = self.shared, self.rest, self.next, self.upto
        ends = [len(s) for s in shared] + [0] * (size - len(shared))
        group: list[tuple[int, int]] = []
        string = b""
        r = self.winner
        while True:
            h = known[r]
            if h != length:
                if group:
                    yield string, group
                if h < 0:
                    return
                group, string = [], now[r]
            k = following[r]
            group.append((r, k))
            k += 1
            following[r] = k
            if k < ends[r]:
                h = shared[r][k]
                end = upto[r] + length - h
                now[r] = now[r][:h] + rest[r][upto[r] : end]
                upto[r] = end
            else:
                h = -1
            known[r] = h
            node = (r + size) >> 1
            while node:
                o = losers[node]
                g = known[o]
                if g > h:
                    losers[node] = r
                    r, h = o, g
                elif g == h and h >= 0:
                    x, y = now[r], now[o]
                    while h < length and x[h] == y[h]:
                        h += 1
                    if h == length or x[h] < y[h]:
                        known[o] = h
                        h = g
                    else:
                        known[r] = h
                        losers[node] = r
                        r, h = o, g
                node >>= 1


def _opened(pieces: list[dict], length: int) -> tuple[LoserTree, list[list[int]]]:
    unzip = zstandard.ZstdDecompressor()
    ids = [(unpack(p["ids"]) + p["base"]).tolist() for p in pieces]
    return LoserTree([(unpack(p["shared"]).tolist(), unzip.decompress(p["rest"])) for p in pieces], length), ids


def merge_windows(pieces: list[dict], length: int) -> list[np.ndarray]:
    """For each piece of a range whether another run has its strings with a smaller id."""
    tree, ids = _opened(pieces, length)
    beaten = [np.zeros(len(i), dtype=bool) for i in ids]
    for _, group in tree.groups():
        if len(group) > 1:
            least = min([ids[r][k] for r, k in group])
            for r, k in group:
                if ids[r][k] > least:
                    beaten[r][k] = True
    return beaten


class Learned(NamedTuple):
    """Of a piece's segments: a bit for each of their strings that a smaller id has, and whether it was left open."""

    beaten: np.ndarray
    open: np.ndarray


def _windows(string: bytes, length: int) -> list[bytes]:
    """The strings of a segment, in order."""
    before = length - gram_of(length)
    right, left = int.from_bytes(string[-4:-2], "big"), int.from_bytes(string[-2:], "big")
    text = string[length : length + before][:left][::-1] + string[:right]
    return [text[i : i + length] for i in range(len(text) - length + 1)]


def merge_segments(pieces: list[dict], length: int, most: int) -> list[Learned]:
    """For each piece of a range what its segments learn from all others with their anchors."""
    gram = gram_of(length)
    tree, ids = _opened(pieces, 2 * length - gram + 4)
    found = [Learned(np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=bool)) for i in ids]

    def close(same: list[tuple[bytes, list[tuple[int, int]], int]]) -> None:
        """All strings of one anchor are here."""
        if len(same) == 1:
            string, group, least = same[0]
            every = (1 << len(_windows(string, length))) - 1 if len(group) > 1 else 0
            for r, k in group:
                if ids[r][k] > least:
                    found[r].beaten[k] = every
            return
        windows = [_windows(string, length) for string, _, _ in same]
        first: dict[bytes, int] = {}
        for strings, (_, _, least) in zip(windows, same, strict=True):
            for w in strings:
                if first.get(w, least) >= least:
                    first[w] = least
        for strings, (_, group, _) in zip(windows, same, strict=True):
            earliest = [first[w] for w in strings]
            for r, k in group:
                own = ids[r][k]
                bits = 0
                for i, e in enumerate(earliest):
                    if e < own:
                        bits |= 1 << i
                found[r].beaten[k] = bits

    same: list[tuple[bytes, list[tuple[int, int]], int]] = []
    anchor, is_open = None, False
    for string, group in tree.groups():
        if string[:gram] != anchor:
            if same:
                close(same)
            same, anchor, is_open = [], string[:gram], False
        same.append((string, group, min([ids[r][k] for r, k in group])))
        if len(same) > most or is_open:
            is_open = True
            for _, members, _ in same:
                for r, k in members:
                    found[r].open[k] = True
            same = []
    if same:
        close(same)
    return found


def removed_spans(
    chunk: Chunk, found: Segments, entries: SegmentEntries, learned: Learned, windows: WindowEntries, beaten: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal stretches that go; those of copies are their whole texts.

    A string goes if its entry learned so, or if its own chunk has the entry with a smaller id.
    """
    place, of, turn = _every_place(found)
    entry = entries.number[of]
    gone = (learned.beaten[entry] >> turn & 1 == 1) | (entries.least[entry] < chunk.ids[found.doc[of]])
    late = beaten[windows.number] | (windows.least[windows.number] < chunk.ids[windows.doc])
    change = np.zeros(len(chunk.text) + 1, dtype=np.int32)
    for starts in (place[gone], windows.place[late]):
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
    whole = np.flatnonzero(~chunk.use & (chunk.sizes >= length))
    np.add.at(change, chunk.starts[whole], 1)
    np.add.at(change, chunk.starts[whole] + chunk.sizes[whole], -1)
    inside = np.cumsum(change) > 0
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    firsts = chunk.starts[chunk.sizes > 0]
    edge[firsts] = inside[firsts]  # a document's start parts stretches that touch
    stop = np.zeros(len(inside), dtype=bool)
    stop[1:] = inside[:-1] & ~inside[1:]
    stop[firsts[1:]] = inside[firsts[1:] - 1]
    return np.flatnonzero(edge), np.flatnonzero(stop)


_META = "chunk string, ids array<long>, no_id array<boolean>, sizes array<long>, digests array<binary>"


def write_chunks(rows: DataFrame, folder: str, chunk_bytes: int) -> DataFrame:
    """Texts in files of the shared folder; a row per file. Files of lost attempts are in no row and never read."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: list[bytes] = []
        ids: list = []
        size = 0

        def close():
            name = uuid.uuid4().hex
            fs, path = open_folder(folder)
            with fs.open_output_stream(f"{path}/{name}") as f:
                f.write(zstandard.ZstdCompressor(level=3).compress(b"".join(texts)))
            row = {
                "chunk": name,
                "ids": [NULL_ID if i is None else i for i in ids],
                "no_id": [i is None for i in ids],
                "sizes": [len(t) for t in texts],
                "digests": [hashlib.sha256(t).digest() for t in texts],
            }
            return pd.DataFrame([row])

        for batch in batches:
            for i, t in zip(batch["doc_id"].astype("Int64"), batch["_text"], strict=True):
                texts.append(t.encode())
                ids.append(None if pd.isna(i) else int(i))
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield close()
                    texts, ids, size = [], [], 0
        if texts:
            yield close()

    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    return materialized(rows.mapInPandas(write, _META), "suffix-chunks")


def _with_copies(meta: DataFrame) -> DataFrame:
    """The chunks with the places of their documents that repeat a whole text of a smaller id."""
    each = meta.select("chunk", F.posexplode(F.arrays_zip("ids", "digests")).alias("_k", "_d"))
    each = each.select("chunk", F.col("_k").alias("k"), F.col("_d.ids").alias("id"), F.col("_d.digests").alias("digest"))
    firsts = each.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    copies = each.join(firsts, "digest").filter("id > first").groupBy("chunk").agg(F.collect_list("k").alias("copies"))
    return meta.drop("digests").join(copies, "chunk", "left")


def _listed(value) -> list:
    return [] if value is None else list(value)


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *arrays])


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_dict("records")


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    chunk_bytes: int = CHUNK_BYTES,
    part_bytes: int = PART_BYTES,
    range_bytes: int = RANGE_BYTES,
    most_strings: int = MOST_STRINGS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (array of start, end: bytes that go, maximal), kept (binary).

    A byte goes if a string of ``length`` bytes over it, within one document, also starts in one of smaller id. A null
    text is an empty one; texts shorter than ``length`` stay. Equal ids (repeated rows) take nothing from each other;
    null ids count as the largest and take nothing. Other columns play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("_text"))
    folder = scratch_path(spark, "suffix-texts")
    meta = write_chunks(rows, folder, chunk_bytes)
    count, total = meta.agg(F.count(F.lit(1)), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    by = scale(total or 0, length, part_bytes, range_bytes)
    meta = materialized(_with_copies(meta), "suffix-chunks")

    def spread(chunks: DataFrame) -> DataFrame:
        return chunks.repartitionByRange(max(1, count), "chunk")  # the rows are small, the work behind them is not

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            chunk = read_chunk(folder, row)
            found = segments(chunk.text, chunk.starts, chunk.sizes, chunk.use, by.length, by.bits)
            own = chunk_anchors(chunk, found, by)
            parts, first = np.unique(own.part, return_index=True)
            pieces = [slice(a, b) for a, b in itertools.pairwise([*first.tolist(), len(own.part)])]
            yield pd.DataFrame(
                {
                    "chunk": row["chunk"],
                    "part": parts,
                    "anchors": [pack_sorted(own.value[of]) for of in pieces],
                    "several": [pack_bits(own.several[of]) for of in pieces],
                }
            )

    def share(group: pd.DataFrame) -> pd.DataFrame:
        flags = shared_anchors(list(zip(group["anchors"], group["several"], strict=True)))
        return pd.DataFrame({"chunk": group["chunk"].to_numpy(), "part": group["part"].to_numpy(), "flags": [pack_bits(f) for f in flags]})

    sent = spread(meta).mapInPandas(anchors, "chunk string, part long, anchors binary, several binary")
    flags = sent.groupBy("part").applyInPandas(share, "chunk string, part long, flags binary")
    flags = flags.groupBy("chunk").agg(F.collect_list(F.struct("part", "flags")).alias("shared"))
    meta = materialized(meta.join(flags, "chunk", "left"), "suffix-anchors")

    def open_segments(row: dict) -> tuple[Chunk, Segments]:
        chunk = read_chunk(folder, row)
        found = segments(chunk.text, chunk.starts, chunk.sizes, chunk.use, by.length, by.bits)
        own = chunk_anchors(chunk, found, by)
        return chunk, shared_segments(found, own, {x["part"]: unpack_bits(x["flags"]) for x in _listed(row["shared"])})

    def open_windows(row: dict) -> tuple[Chunk, Segments, SegmentEntries, Learned, WindowEntries]:
        chunk, found = open_segments(row)
        entries = SegmentEntries(chunk, found, by.length)
        pieces = sorted(_listed(row["learned"]), key=lambda x: x["range"])
        learned = Learned(_joined([unpack(x["beaten"]) for x in pieces], np.int64), _joined([unpack_bits(x["open"]) for x in pieces], bool))
        rest = Segments(*[x[learned.open[entries.number]] for x in found])
        return chunk, found, entries, learned, sorted_windows(chunk, rest, by.length)

    def segment_entries(row: dict) -> SegmentEntries:
        return SegmentEntries(*open_segments(row), by.length)

    def window_entries(row: dict) -> WindowEntries:
        return open_windows(row)[-1]

    def sent_runs(chunks: DataFrame, entries_of, cut: int) -> DataFrame:
        """The chunks' runs, cut into ranges by a sample of their strings, of which ``cut`` bytes count."""

        def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row in _rows(batches):
                entries = entries_of(row)
                n = len(entries.least)
                some = np.random.default_rng(0).choice(n, min(n, SAMPLE_STRINGS), replace=False)
                yield pd.DataFrame({"string": [entries.string(k)[:cut] for k in some.tolist()]})

        def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row in _rows(batches):
                for piece in run_ranges(entries_of(row), cuts.value):
                    yield pd.DataFrame([{"chunk": row["chunk"], **piece}])

        some = spread(chunks.orderBy("chunk").limit(SAMPLE_CHUNKS)).mapInPandas(sample, "string binary")
        strings = sorted(bytes(r[0]) for r in some.collect())
        splitters = sorted({strings[len(strings) * k // by.ranges] for k in range(1, by.ranges)}) if strings else []
        cuts = spark.sparkContext.broadcast(splitters)
        return spread(chunks).mapInPandas(runs, "chunk string, range long, shared binary, rest binary, base long, ids binary")

    def merge_anchored(group: pd.DataFrame) -> pd.DataFrame:
        found = merge_segments(group.to_dict("records"), by.length, most_strings)
        answers = {"beaten": [pack(f.beaten) for f in found], "open": [pack_bits(f.open) for f in found], "opened": [int(f.open.sum()) for f in found]}
        return pd.DataFrame({"chunk": group["chunk"].to_numpy(), "range": group["range"].to_numpy(), **answers})

    def merge_single(group: pd.DataFrame) -> pd.DataFrame:
        beaten = merge_windows(group.to_dict("records"), by.length)
        return pd.DataFrame({"chunk": group["chunk"].to_numpy(), "range": group["range"].to_numpy(), "beaten": [pack_bits(b) for b in beaten]})

    # strings of one anchor stay in one range
    sent = sent_runs(meta, segment_entries, gram_of(length))
    answers = sent.groupBy("range").applyInPandas(merge_anchored, "chunk string, range long, beaten binary, open binary, opened long")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("range", "beaten", "open")).alias("learned"), F.sum("opened").alias("opened"))
    meta = materialized(meta.join(answers, "chunk", "left"), "suffix-segments")
    left = meta.filter("opened > 0")
    if left.isEmpty():
        meta = meta.withColumn("last", F.lit(None).cast("array<struct<range: long, beaten: binary>>"))
    else:
        answers = sent_runs(left, window_entries, length).groupBy("range").applyInPandas(merge_single, "chunk string, range long, beaten binary")
        answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("range", "beaten")).alias("last"))
        meta = materialized(meta.join(answers, "chunk", "left"), "suffix-windows")

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            chunk, found, entries, learned, windows = open_windows(row)
            beaten = _joined([unpack_bits(x["beaten"]) for x in sorted(_listed(row["last"]), key=lambda x: x["range"])], bool)
            low, high = removed_spans(chunk, found, entries, learned, windows, beaten, by.length)
            at = np.searchsorted(low, np.append(chunk.starts, len(chunk.text)))
            begins, ends, kept = [], [], []
            for k, (begin, size) in enumerate(zip(chunk.starts.tolist(), chunk.sizes.tolist(), strict=True)):
                gone = slice(at[k], at[k + 1] if size else at[k])
                begins.append(low[gone] - begin)
                ends.append(high[gone] - begin)
                stays = zip([begin, *high[gone].tolist()], [*low[gone].tolist(), begin + size], strict=True)
                kept.append(b"".join([chunk.text[x:y].tobytes() for x, y in stays]))
            for i in range(0, len(kept), 2000):
                of = slice(i, i + 2000)
                ids = pd.Series(chunk.ids[of], dtype="Int64").mask(pd.Series(row["no_id"][of], dtype=bool))
                yield pd.DataFrame({"doc_id": ids, "n_bytes": chunk.sizes[of], "start": begins[of], "end": ends[of], "kept": kept[of]})

    done = spread(meta).mapInPandas(spans, "doc_id long, n_bytes long, start array<long>, end array<long>, kept binary")
    return done.select("doc_id", "n_bytes", F.arrays_zip("start", "end").alias("spans"), "kept")


def span_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; nulls, repeats, empty tables as above."""
    found = repeated_spans(docs, id_col, text_col, length)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
