import hashlib

import pytest
from pyspark.sql import functions as F

from vitaloom.llm import warc

LONG = "<html>" + "é" * 200


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, value string")


def by_hand(rows):
    out, first = [], {}
    for key, _, html, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        if len(body) >= warc.MIN_BYTES:
            first.setdefault(digest, key)
        original = first.get(digest, key)
        out.append((key, len(body), digest, "response" if original == key else "revisit", None if original == key else original))
    return out


def test_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 20
    rows = [(5, "http://a", LONG, "x"), (2, "http://b", LONG, "y"), (9, "http://c", LONG, None), (1, "http://d", "short", ""), (3, "http://e", "short", ""),
            (4, None, None, ""), (6, "http://f", "", ""), (7, "http://g\r\nWARC-Type: x", tricky, ""), (8, "http://h", tricky, ""),
            (None, "http://i", LONG, ""), (10, "http://j", "z" * 3_000_000, ""), (2, "http://b", LONG, "y"), (11, "http://k", "x" * 100, ""),
            (12, "http://k", "x" * 100, ""), (13, "http://k", "x" * 99, ""), (14, "http://k", "x" * 99, "")]
    got = warc.archive_round_trip(pages(spark, rows)).select(
        F.col("source_key").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long")).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=order) == sorted(by_hand(rows), key=order)


def test_empty_table(spark):
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_parse_finds_damage(spark):
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 5\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc.parse(head + b"\r\n\r\nx" + b"\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse(b"x" + head + b"\r\n\r\nx"))
