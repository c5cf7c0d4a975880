"""Web archives: each capture is a request, a response (or a revisit of an equal one) and a metadata record.

Writing: one gzip member per record, one file per task, named by the attempt. Reading: the records of all files become
rows, and those that name each other through ``WARC-Concurrent-To`` are joined to one nested row per capture.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysleuth.llm.common import open_folder
from paysleuth.session import materialized, scratch_path

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, type string, concurrent_to string, uri string, refers_to_uri string, page_id long, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary"
)
_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs


class ArchiveFolder(NamedTuple):
    """A written folder and a table with a row per file (file, records)."""

    uri: str
    files: DataFrame


def mark_revisits(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000
) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to, refers_to_url of every page.

    Of equal payloads of at least ``least_bytes`` the page of the largest id is the response. A null payload is empty.
    Pages that repeat the largest id are responses too; a group whose ids are all null has responses only.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).alias("_bytes"),
        F.xxhash64(payload).alias("_check"),
    )
    same = ["digest", "_bytes", "_check"]
    groups = (
        rows.filter(F.col("_bytes") >= least_bytes)
        .groupBy(*same)
        .agg(
            F.max("page_id").alias("_first"),
            F.max_by("url", F.struct("page_id", "url")).alias("_first_url"),
            F.count(F.lit(1)).alias("_n"),
        )
        .filter("_n > 1")
    )
    revisit = F.col("_n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(groups, same, "left").select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.col("_bytes").cast("long").alias("payload_bytes"),
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
        F.when(revisit, F.col("_first_url")).alias("refers_to_url"),
    )


def _uri(url: str | None) -> str:
    return quote(url or "", safe="%/:?#[]@!$&'()*+,;=~-._") or "about:blank"


def _record(kind: str, record_id: str, content_type: str, block: bytes, **headers: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}"]
    lines += [f"{name.replace('_', '-')}: {value}" for name, value in headers.items() if value is not None]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def capture_records(page: dict, name: str) -> list[bytes]:
    """The three records of a page; ``name`` makes their ids unique."""
    ids = {k: f"urn:uuid:{uuid.uuid5(_SPACE, f'{name}/{k}')}" for k in ("main", "request", "metadata")}
    target, host_and_path = _uri(page["url"]), _uri(page["url"]).partition("://")[2]
    host, _, path = host_and_path.partition("/")
    revisit = page["record_type"] == "revisit"
    body = b"" if revisit else page["payload"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['payload_bytes']}\r\n\r\n"
    main = _record(
        page["record_type"],
        ids["main"],
        "application/http; msgtype=response",
        head.encode() + body,
        WARC_Target_URI=target,
        WARC_Payload_Digest=f"sha1:{page['digest']}",
        WARC_Profile=REVISIT_PROFILE if revisit else None,
        WARC_Refers_To_Target_URI=_uri(page["refers_to_url"]) if revisit else None,
        WARC_Refers_To_Date=_DATE if revisit else None,
    )
    request = _record(
        "request",
        ids["request"],
        "application/http; msgtype=request",
        f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(),
        WARC_Target_URI=target,
        WARC_Concurrent_To=f"<{ids['main']}>",
    )
    fields = {"page-id": page["page_id"], "refers-to-page-id": page["refers_to"]}
    metadata = _record(
        "metadata",
        ids["metadata"],
        "application/warc-fields",
        "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode(),
        WARC_Target_URI=target,
        WARC_Concurrent_To=f"<{ids['main']}>",
    )
    return [request, main, metadata]


def write_archives(marked: DataFrame, folder: str) -> ArchiveFolder:
    """Write the rows of ``mark_revisits`` as .warc.gz files; files of lost attempts are in no manifest."""
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = open_folder(folder)
        part = TaskContext.get().partitionId()
        name, out, n = f"{part:06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            batch = batch.astype({"page_id": "object", "refers_to": "object"})
            for page in batch.to_dict("records"):
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}")
                for key in ("page_id", "refers_to"):
                    page[key] = None if pd.isna(page[key]) else int(page[key])
                for record in capture_records(page, f"{name}/{n}"):
                    out.write(record)
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [name], "captures": [n]})

    return ArchiveFolder(folder, materialized(marked.mapInPandas(write, "file string, captures long"), "warc-manifest"))


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            data = rest or stream.read(chunk)
            rest = b""
            if not data:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(unpacker.decompress(data))
        rest = unpacker.unused_data
        yield b"".join(parts)


def _fields(text: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in text.decode().split("\r\n") if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse_record(raw: bytes, with_payload: bool = True) -> dict:
    """A row of RECORD. A response's payload must have the digest that its header states."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = _fields(head)
    block = rest[: int(headers["content-length"])]
    bare = lambda s: s.strip("<>") if s else None
    row = dict.fromkeys(c.split()[0] for c in RECORD.split(", "))
    row |= {
        "record_id": bare(headers["warc-record-id"]),
        "type": headers["warc-type"],
        "concurrent_to": bare(headers.get("warc-concurrent-to")),
        "uri": unquote(headers.get("warc-target-uri", "")),
        "refers_to_uri": headers.get("warc-refers-to-target-uri"),
    }
    if row["type"] in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        row["payload_digest"] = headers["warc-payload-digest"].removeprefix("sha1:")
        row["payload_bytes"] = int(_fields(http)["content-length"])
        if row["type"] == "response":
            row["payload_bytes"] = len(payload)
            if hashlib.sha1(payload).hexdigest() != row["payload_digest"]:
                raise ValueError(f"record {row['record_id']} is damaged")
            row["payload"] = payload if with_payload else None
    elif row["type"] == "metadata":
        fields = _fields(block)
        row["page_id"] = int(fields["page-id"]) if "page-id" in fields else None
        row["refers_to"] = int(fields["refers-to-page-id"]) if "refers-to-page-id" in fields else None
    return row


def read_records(spark: SparkSession, written: ArchiveFolder, with_payload: bool = True, at_once: int = 500) -> DataFrame:
    """All records of the files as rows, a file a task (the manifest has one row per file)."""
    folder = written.uri

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = open_folder(folder)
        columns = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for name in batch["file"]:
                rows: list[dict] = []
                size = 0
                with fs.open_input_stream(f"{path}/{name}") as stream:
                    for raw in _members(stream):
                        rows.append(parse_record(raw, with_payload))
                        size += len(raw)
                        if len(rows) >= at_once or size >= 16 << 20:
                            yield _frame(rows, columns)
                            rows, size = [], 0
                if rows:
                    yield _frame(rows, columns)

    files = written.files.select("file")
    return files.repartition(max(1, files.count()), "file").mapInPandas(read, RECORD)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    whole = {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"}
    return pd.DataFrame(rows, columns=columns).astype(whole)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, request, response, metadata (nested), joined through concurrent-to identifiers.

    A record without such an identifier is the capture's response or revisit. Records whose capture has none of these
    are left out.
    """
    tagged = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    mains = tagged.filter(F.col("type").isin("response", "revisit"))
    main = mains.select(
        "capture_id",
        F.struct("record_id", "type", "uri", "refers_to_uri", "payload_bytes", "payload_digest", "payload").alias("response"),
    )
    request = tagged.filter("type = 'request'").select("capture_id", F.struct("record_id", "uri").alias("request"))
    metadata = tagged.filter("type = 'metadata'").select(
        "capture_id", F.struct("record_id", "page_id", "refers_to").alias("metadata")
    )
    return main.join(request, "capture_id", "left").join(metadata, "capture_id", "left")


def archive_digest(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and return what the assembled captures say of each page.

    A null page is an empty one, a null address about:blank. Null ids and repeated rows are captures of their own; of equal
    payloads the largest id is the response. Other columns play no part; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    written = write_archives(mark_revisits(pages), scratch_path(spark, "archives"))
    records = materialized(read_records(spark, written, with_payload=False).drop("payload"), "warc-records")
    captures = assemble(records.withColumn("payload", F.lit(None).cast("binary")))
    return captures.select(
        "metadata.page_id",
        "response.payload_bytes",
        "response.payload_digest",
        F.col("response.type").alias("record_type"),
        "metadata.refers_to",
    )
