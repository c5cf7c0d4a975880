import hashlib

import pytest

from paysleuth.llm import warc
from paysleuth.session import scratch_path

BIG, SMALL = "<p>" + "é" * 600 + "</p>", "<p>tiny</p>"
PAGES = [
    (1, "http://a.example/x", BIG, "k"),
    (2, "http://a.example/y z\n", BIG, "k"),
    (3, None, BIG, None),
    (4, "http://b.example/", SMALL, "k"),
    (5, "http://b.example/ü", SMALL, "k"),
    (6, "http://c.example/", None, "k"),
    (7, "http://c.example/", "", "k"),
    (8, "no address", "x\r\n\r\ny" * 400, "k"),
    (None, "http://d.example/", BIG + "!", "k"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload string").repartition(2)
    folder = scratch_path(spark, "archives")
    written = warc.write_archives(warc.mark_revisits(pages), folder)
    captures = warc.assemble(warc.read_records(spark, written)).collect()
    assert len(captures) == len(PAGES)
    seen = {c["metadata"]["page_id"]: c for c in captures}
    for page_id, _url, html, _ in PAGES:
        c, payload = seen[page_id], (html or "").encode()
        assert c["response"]["payload_bytes"] == len(payload)
        assert c["response"]["payload_digest"] == hashlib.sha1(payload).hexdigest()
        assert c["response"]["type"] == ("revisit" if page_id in (1, 2) else "response")
        assert c["metadata"]["refers_to"] == (3 if page_id in (1, 2) else None)
        if c["response"]["type"] == "response":
            assert bytes(c["response"]["payload"]) == payload
        assert c["request"]["uri"] == c["response"]["uri"]
    assert seen[5]["response"]["uri"] == "http://b.example/ü" and seen[2]["response"]["uri"] == "http://a.example/y z\n"


def test_digest_and_no_rows(spark):
    pages = spark.createDataFrame(PAGES + [PAGES[3]], "page_id long, url string, html string, payload string")
    assert warc.archive_digest(pages).count() == len(PAGES) + 1
    assert warc.archive_digest(pages.limit(0)).count() == 0


def test_damage_is_noticed():
    page = {"page_id": 1, "url": "http://a/", "payload": b"abc", "payload_bytes": 3, "record_type": "response",
            "digest": hashlib.sha1(b"abd").hexdigest(), "refers_to": None, "refers_to_url": None}
    import zlib

    raw = zlib.decompress(warc.capture_records(page, "f/0")[1], 31)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(raw)
