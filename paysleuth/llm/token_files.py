"""Token ids in binary files: one compressed frame per document, one dictionary for all, an index for short access.

A file is ``TIDS1``, the header (JSON: dictionary hash, bytes per id), the frames in ascending id order, the index (one
32-byte entry per document: id, place of the frame, its length, number of ids, whether the id is null), and a trailer
that says where the index starts. The dictionary is trained on serialised ids and stored once, named by its hash.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysleuth.llm.common import open_folder, whole_text
from paysleuth.llm.tokens import broadcast_spec, encoder, ids_with_end
from paysleuth.session import materialized, scratch_path

MAGIC = b"TIDS1"
INDEX = np.dtype([("id", "<i8"), ("at", "<u8"), ("length", "<u4"), ("n", "<u4"), ("null", "<u8")])
TRAILER = np.dtype([("index_at", "<u8"), ("documents", "<u8")])


class TokenFolder(NamedTuple):
    """A written folder: its place, the hash of the dictionary, and a table with a row per file (part, file, ...)."""

    uri: str
    dictionary: str
    files: DataFrame


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary for serialised ids; empty if the samples are too few to train on."""
    try:
        return zstandard.train_dictionary(size, [s for s in samples if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _sample(docs: DataFrame, count: int, path: str, end_id: int, rows: int, longest: int) -> list[bytes]:
    """Ids of about ``rows`` short documents, drawn by a hash of the text; only the dictionary is made from them."""
    short = docs.filter(F.octet_length("_text").between(1, longest)).select("_text")
    drawn = short.filter(F.pmod(F.xxhash64("_text"), F.lit(max(1, count // rows))) == 0)
    texts = sorted(r[0] for r in drawn.limit(2 * rows).collect())
    with open(path, encoding="utf-8") as f:
        return list(ids_with_end(f.read(), texts, end_id))


def _width(ids: int) -> str:
    return "<u2" if ids <= 1 << 16 else "<u4"


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = 16 << 20,
    sample_rows: int = 400,
    sample_longest: int = 16_384,
    dictionary_bytes: int = 64 << 10,
    level: int = 3,
) -> TokenFolder:
    """Encode every whole text (null: empty), append ``end_id``, write the ids in ascending id order.

    Null ids come first; rows of equal id are ordered by a hash of the text, then the text. A file is named by its
    range and attempt: files of lost attempts are in no manifest and are never read. Other columns play no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("_text"))
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    samples = _sample(rows, count, tokenizer, end_id, sample_rows, sample_longest)
    spec = broadcast_spec(spark, tokenizer)
    ids_known = max(encoder(spec.value).ids, end_id + 1)
    width = _width(ids_known)
    dictionary = train_dictionary([np.frombuffer(s, "<u4").astype(width).tobytes() for s in samples], dictionary_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary-{digest}") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = open_folder(folder)
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}.tids"
        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=known)
        header = json.dumps({"dictionary": digest, "width": width}).encode()
        at, entries, tokens = len(MAGIC) + 4 + len(header), [], 0
        out = None
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}")
                out.write(MAGIC + len(header).to_bytes(4, "little") + header)
            nulls = batch["doc_id"].isna().to_numpy()
            keys = batch["doc_id"].fillna(0).astype("int64").to_numpy()
            found = []
            for raw in ids_with_end(spec.value, batch["_text"], end_id):
                frame = packer.compress(np.frombuffer(raw, "<u4").astype(width).tobytes())
                out.write(frame)
                found.append((at, len(frame), len(raw) // 4))
                at += len(frame)
            index = np.zeros(len(found), dtype=INDEX)
            index["id"], index["null"] = keys, nulls
            for k, column in enumerate(("at", "length", "n")):
                index[column] = [x[k] for x in found]
            entries.append(index.tobytes())
            tokens += int(index["n"].sum())
        if out is None:
            return
        for e in entries:
            out.write(e)
        documents = sum(map(len, entries)) // INDEX.itemsize
        out.write(np.array([(at, documents)], dtype=TRAILER).tobytes())
        out.close()
        yield pd.DataFrame({"part": [part], "file": [name], "documents": [documents], "tokens": [tokens]})

    parts = max(1, math.ceil(total / file_bytes))
    ordered = rows.withColumn("_tie", F.xxhash64("_text")).repartitionByRange(parts, "doc_id", "_tie")
    ordered = ordered.sortWithinPartitions("doc_id", "_tie", "_text").select("doc_id", "_text")
    files = materialized(
        ordered.mapInPandas(write, "part int, file string, documents long, tokens long"), "token-manifest"
    )
    return TokenFolder(folder, digest, files)


class TokenFile:
    """An open file: the index in memory, any document read on its own."""

    def __init__(self, folder: str, name: str, dictionary: bytes | None = None):
        fs, path = open_folder(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        head = self.file.read(len(MAGIC) + 4)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{name} is not a token file")
        self.header = json.loads(self.file.read(int.from_bytes(head[len(MAGIC) :], "little")))
        size = self.file.size()
        trailer = np.frombuffer(self.file.read_at(TRAILER.itemsize, size - TRAILER.itemsize), TRAILER)[0]
        self.frames_end = int(trailer["index_at"])
        length = int(trailer["documents"]) * INDEX.itemsize
        self.index = np.frombuffer(self.file.read_at(length, self.frames_end), INDEX)
        if dictionary is None:
            with fs.open_input_stream(f"{path}/dictionary-{self.header['dictionary']}") as f:
                dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != self.header["dictionary"]:
            raise ValueError(f"{name} was written with another dictionary")
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpacker = zstandard.ZstdDecompressor(dict_data=known)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file."""
        entry = self.index[k]
        frame = self.file.read_at(int(entry["length"]), int(entry["at"]))
        return np.frombuffer(self.unpacker.decompress(frame), self.header["width"])


def read_token_files(spark: SparkSession, written: TokenFolder) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, frame_bytes, all from the files themselves.

    start counts the ids of all documents before it; the table of files gives what lies in earlier files (one row per
    file comes to the driver).
    """
    files = sorted(written.files.collect(), key=lambda r: r["part"])
    base, listed = 0, []
    for r in files:
        listed.append((r["file"], base))
        base += r["tokens"]
    folder = written.uri

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start in zip(batch["file"], batch["base"], strict=True):
                opened = TokenFile(folder, name)
                index = opened.index
                counts = index["n"].astype(np.int64)
                starts = int(start) + np.cumsum(counts) - counts
                for lo in range(0, len(index), 5000):
                    part = slice(lo, min(lo + 5000, len(index)))
                    ids = [opened.ids(k).astype("<u4") for k in range(part.start, part.stop)]
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array(index["id"][part], dtype="Int64"),
                            "start": starts[part],
                            "n_tokens": np.array([len(x) for x in ids], dtype=np.int64),
                            "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                            "frame_bytes": index["length"][part].astype(np.int64),
                        }
                    ).assign(doc_id=lambda d, n=index["null"][part]: d["doc_id"].mask(n == 1))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long"
    table = spark.createDataFrame(listed, "file string, base long").repartition(max(1, len(listed)), "file")
    return table.mapInPandas(read, schema)


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of all documents and say of each what the files hold.

    A null text is an empty one (its end id remains); null ids come first, repeated rows each have their place, ties of
    ids go by the text. Other columns play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, tokenizer, scratch_path(spark, "token-files")))
