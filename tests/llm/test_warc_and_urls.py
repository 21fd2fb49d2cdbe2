import datetime
import hashlib

import pytest

from clausework.llm import url_filter as U
from clausework.llm import warc as W


def pages():
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    odd = [
        (1, "http://a.example/", "x" * 150), (2, "http://b.example/", "x" * 150), (3, None, "short"), (4, "u", "short"), (5, "u\r\nWARC-Type: x", None), (6, "u", ""),
        (7, "u", "before " + inner + inner + " after"), (8, "u", "WARC/1.0\r\n"), (9, "ü", "é" * 60 + "\r\n\r\n" + inner), (10, "u", inner * 40), (11, "u", "x" * 150), (None, "u", "no id"),
        (12, "u", "\r\n\r\n"), (13, "u", "a\nb\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 9),
    ]
    return odd + [(100 + i, f"http://h/{i}", f"page {i} " * (i % 50 + 1)) for i in range(200)]


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_round_trip_with_magic_in_payloads(spark, tmp_path, split):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    path = f"file://{tmp_path}/warc"
    W.write_archives(df, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        records = W.read_archives(spark, path, with_payload=True)
        got = {r.record_page: r for r in records.collect()}
        full = {r.record_page: r for r in W.resolved(records).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == len(rows) and 999 not in got
    first = {}
    for page, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", page)
    for page, _, html in rows:
        body = html or ""
        revisit = page is not None and len(body.encode()) >= 100 and first[body] != page
        assert got[page].record_type == ("revisit" if revisit else "response")
        assert got[page].payload == ("" if revisit else body)
        assert full[page].refers_to == (first[body] if revisit else None)
        assert (full[page].payload_bytes, full[page].payload_digest) == (len(body.encode()), hashlib.sha256(body.encode()).hexdigest())


def test_repeated_ids_with_different_payloads(spark, tmp_path):
    a, b = "a" * 150, "b" * 150
    rows = [(5, "u", a, "x"), (5, "u", b, "x"), (6, "u", a, "x"), (7, "u", b, "x"), (5, "u", a, "x"), (8, "u", "long " * 400_000, "x")]
    path = f"file://{tmp_path}/warc"
    W.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string, payload_digest string").repartition(2), path)
    got = sorted(tuple(r) for r in W.resolved(W.read_archives(spark, path)).select("record_page", "record_type", "refers_to", "payload_bytes", "payload_digest").collect())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(5, "response", None, 150, digest(a)), (5, "response", None, 150, digest(a)), (5, "response", None, 150, digest(b)), (6, "revisit", 5, 150, digest(a)), (7, "revisit", 5, 150, digest(b)), (8, "response", None, 2_000_000, digest("long " * 400_000))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_archive_of_no_pages(spark, tmp_path):
    W.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), f"file://{tmp_path}/w")
    assert W.resolved(W.read_archives(spark, f"file://{tmp_path}/w")).count() == 0


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def test_captures_meet_the_entries_valid_when_fetched(spark):
    events = [("bad", "domain", "evil.example", day(10), "add"), ("bad", "domain", "evil.example", day(20), "remove"), ("bad", "domain", "evil.example", day(30), "add"), ("bad", "domain", "evil.example", day(30), "add"),
              ("spam", "prefix", "ok.example/shop/old", day(0), "add"), ("gone", "domain", "ok.example", day(5), "add"), ("gone", "domain", "ok.example", day(5), "remove"), ("late", "domain", "evil.example", day(900), "add")]
    urls = ["http://evil.example/x", "https://u@WWW.Evil.Example.:8080/a?b", "http://notevil.example/", "http://ok.example/shop/old/1?q", "http://ok.example/shop/older", "mailto:x", None, "http:///x", "http://ok.example/shop//old"]
    captures = [(i, u, day(d), "clash") for i, u in enumerate(urls) for d in (0, 9, 10, 19, 20, 29, 30, 700)] + [(50, urls[0], None, "x")]
    c = spark.createDataFrame(captures, "id int, url string, fetched date, lists string")
    e = spark.createDataFrame(events, "list string, kind string, key string, day date, action string")
    got = {(r.id, r.fetched): r["lists"] for r in U.evaluate(c, e).collect()}
    assert len(got) == len(captures)
    for (i, f), lists in got.items():
        d = (f - day(0)).days if f else None
        evil = i in (0, 1) and d is not None and (10 <= d < 20 or d >= 30)
        assert lists == (["bad"] if evil else ["spam"] if i in (3, 8) else []), (i, d)
    assert U.evaluate(c, e.limit(0)).where("size(lists) > 0").count() == 0
    assert U.evaluate(c.limit(0), e).count() == 0
