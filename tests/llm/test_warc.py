import gzip
import hashlib
import random

import pytest

from hypothesis import given
from hypothesis import strategies as st

from tidegauge.llm import store, warc


def brute(rows):
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        r = first.get(h)
        r = r if r is not None and i is not None and r != i else None
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "response" if r is None else "revisit", r))
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, digest string, bytes int").repartition(3)


def test_pages(table):
    pages = table("pages")
    assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str) == brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_edges(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choice("aé🤯\r\n\0x") for _ in range(90000))
    rows = [(1, None, None), (2, "http://a b\r\n/", ""), (3, "u", "s" * 99), (4, "u", "s" * 99), (9, "u", "t" * 100), (7, "u", "t" * 100), (8, "u", "t" * 100), (5, "u", long), (6, "u", long + "!"), (10, "u", long), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 9000), (None, None, "n" * 200), (12, "u", "d" * 70000), (12, "u", "d" * 70000)]
    assert sorted((tuple(r) for r in warc.round_trip(made(spark, rows)).collect()), key=str) == brute(rows)
    assert warc.round_trip(made(spark, [])).count() == 0


def test_many_to_join(spark, monkeypatch):
    monkeypatch.setattr(warc, "FEW", 0)
    rows = [(i, "u", "z" * (100 + i % 4)) for i in range(40)]
    assert sorted((tuple(r) for r in warc.round_trip(made(spark, rows)).collect()), key=str) == brute(rows)


def test_segments_are_needed(spark):
    path = store.shared_dir(spark, "test") + "/a"
    warc.write(made(spark, [(1, "u", "é" * 100000)]), path)
    found = [h for (d,) in spark.read.format("binaryFile").load(path).select("content").collect() for h, _ in warc.records(bytes(d))]
    assert [h.get("warc-segment-number") for h in found] == [str(i) for i in range(1, len(found) + 1)] and len(found) > 20 and found[-1]["warc-segment-total-length"]


@given(st.binary(max_size=60000))
def test_chunks(data):
    assert warc.dechunked(warc.chunked(data)) == data
    assert b"".join(warc.segments(data)) == data


def test_ordinary_pages_are_continued_and_revisited(spark, table):
    pages = table("pages").select("page_id", "url", "html")
    twice = pages.unionByName(pages.selectExpr("page_id + 100000 as page_id", "url", "html"))
    rows = [tuple(r) for r in twice.collect()]
    want = brute(rows)
    assert sorted((tuple(r) for r in warc.round_trip(twice, segment=1024).collect()), key=str) == want
    assert sum(len((h or "").encode()) > 1024 for _, _, h in rows) > len(rows) / 2 and sum(r[3] == "revisit" for r in want) > len(rows) / 3


def members(*records):
    return b"".join(gzip.compress(r + b"\r\n\r\n") for r in records)


def test_archives_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    sha1 = "sha1:" + __import__("base64").b32encode(hashlib.sha1(b"hello").digest()).decode()
    (tmp_path / "a.warc.gz").write_bytes(members(
        warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:1>")], b"software: x"),
        warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:2>"), ("WARC-Payload-Digest", sha1)], http + b"hello"),
        warc.record([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:3>")], b"GET / HTTP/1.1\r\n\r\n"),
        warc.record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:4>"), ("WARC-Payload-Digest", sha1), ("WARC-Refers-To", "<urn:2>")], http)))
    (tmp_path / "b.warc").write_bytes(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:5>")], http + b"") + b"\r\n\r\n")
    got = sorted((tuple(r) for r in warc.read(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, 5, hashlib.sha256(b"hello").hexdigest(), "response", None), (None, None, None, "revisit", None), (None, 0, hashlib.sha256(b"").hexdigest(), "response", None)], key=str)


def test_false_revisit_is_an_error(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(members(
        warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:2>"), ("X-Page-ID", 1)], http + b"hello"),
        warc.record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:4>"), ("X-Page-ID", 2), ("X-Payload-Length", 5), ("WARC-Payload-Digest", "sha256:" + "0" * 64), ("WARC-Refers-To", "<urn:x-page:1>")], http)))
    with pytest.raises(Exception, match="a revisit is not"):
        warc.read(spark, str(tmp_path)).collect()
