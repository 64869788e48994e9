"""Archives and URL filters against brute force and exact round trips."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.llm import urlfilter, warc

BIG = "<p>payload ä</p>" * 100
PAGES = [
    (1, "http://a.example/x", BIG),
    (2, "http://b.example/y", BIG),
    (3, "http://c.example/z", BIG),
    (4, None, None),
    (5, "", ""),
    (6, "http://d.example/\r\nX: y", "short"),
    (7, "http://e.example/", "short"),
    (8, "http://f.example/", "x" * 3_000_000),
    (9, "http://g.example/", "y" * 1000),
    (9, "http://g.example/", "y" * 1000),
    (10, "http://h.example/", "z" * 999),
    (11, "http://i.example/", "z" * 999),
    (None, "http://j.example/", BIG),
] + [(100 + k, f"http://hot.example/{k}", "hot" * 500) for k in range(50)]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(4)
    return df.withColumn("payload_digest", F.lit("clash")).withColumn("record_type", F.lit(1)).withColumn("archive", F.lit(2))


def brute(rows):
    first: dict[bytes, int] = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 1000 and i is not None:
            first[p] = max(first.get(p, i), i)
    for i, _, html in rows:
        p = (html or "").encode()
        again = p in first and first[p] != i
        yield i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", first[p] if again else None


def test_round_trip(pages):
    got = warc.round_trip(pages).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(brute(PAGES))


def test_archives_are_standard_and_payloads_come_back(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(warc.with_revisits(pages), folder, archive_bytes=2_000)
    rows = index.collect()
    assert len(rows) == len(PAGES) and len({r.archive for r in rows}) > 4
    for name in {r.archive for r in rows}:
        raw = (tmp_path / "w" / name).read_bytes()
        own = sorted((r.offset, r.length) for r in rows if r.archive == name)
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) == len(raw)
        with gzip.open(io.BytesIO(raw)) as f:
            assert f.read().count(b"WARC/1.1\r\n") == len(own)
    back = {(r.page_id, r.record_type): bytes(r.payload) for r in warc.read_records(index.filter("record_type = 'response'"), folder, payloads=True).collect()}
    assert back[8, "response"] == b"x" * 3_000_000 and back[3, "response"] == BIG.encode() and back[4, "response"] == b""
    some = index.filter("page_id in (2, 8, 120)")
    assert {r.page_id for r in warc.read_records(some, folder, gap=0, most=10).collect()} == {2, 8, 120}


def test_wrong_index_raises(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(warc.with_revisits(pages), folder)
    with pytest.raises(Exception, match="not the record|not a WARC|incorrect header|Error"):
        warc.read_records(index.withColumn("payload_digest", F.sha1(F.lit("x").cast("binary"))), folder).collect()


def test_no_pages(pages):
    assert warc.round_trip(pages.limit(0)).count() == 0


DAY = datetime(2024, 1, 1)


def at(n):
    return DAY + timedelta(days=n)


CHANGES = [
    ("host", "a.b.example", "spam", at(10), "add"),
    ("host", "a.b.example", "spam", at(20), "remove"),
    ("host", "a.b.example", "spam", at(30), "add"),
    ("host", "a.b.example", "spam", at(30), "add"),
    ("domain", "example", "all", at(15), "add"),
    ("domain", "example", "all", at(16), "remove"),
    ("domain", "b.example", "some", at(5), "remove"),
    ("domain", "b.example", "some", at(40), "add"),
    ("domain", "b.example", "some", at(40), "remove"),
    ("prefix", "a.b.example/x/", "part", at(0), "add"),
    ("prefix", "a.b.example/x/", "other", at(0), "add"),
    ("host", None, "bad", at(0), "add"),
    ("host", "c.example", None, None, "add"),
    ("host", "c.example", None, at(0), "unknown"),
]
URLS = [
    "http://a.b.example/x/y", "https://user@A.B.Example.:8080/x", "http://b.example", "http://notb.example/", "ftp://c.example/x/", "", None,
    "no url", "http:///x", "http://[::1]:80/x", "http://a.b.example/x/y/z?q=/x/#/x/",
    "http://a.b.example/x" + "/s" * 20_000, "http://" + "l." * 3_000 + "b.example/" + "q" * 50_000,
]


def brute_verdict(url, when):
    active: dict[tuple, list[tuple]] = {}
    for kind, pattern, category, day, action in CHANGES:
        if pattern and day and action in ("add", "remove"):
            active.setdefault((kind, pattern, category or ""), []).append((day, action))
    hits = []
    for (kind, pattern, category), log in active.items():
        days = sorted({d for d, _ in log if when and d <= when})
        if days and ("add" in {a for d, a in log if d == days[-1]}):
            hits.append((kind, pattern, category))
    if not url or "://" not in url:
        return 0, None, None
    rest = url.split("://", 1)[1]
    place = rest.split("?")[0].split("#")[0]
    host, slash, path = place.partition("/")
    host = host.rpartition("@")[2].lower()
    host = (host.partition("]")[0] + "]" if host.startswith("[") else host.partition(":")[0]).rstrip(".")
    found = [
        h for h in hits
        if host and ((h[0] == "host" and host == h[1]) or (h[0] == "domain" and (host == h[1] or host.endswith("." + h[1]))) or (h[0] == "prefix" and (host + slash + path).startswith(h[1])))
    ]
    best = min(((-len(p), k, p, c) for k, p, c in found), default=None)
    return len(found), f"{best[1]}:{best[2]}" if best else None, best[3] if best else None


@pytest.mark.parametrize("bound", [100_000, 0])
def test_verdicts_at_fetch_time(spark, monkeypatch, bound):
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", bound)
    rows = [(k, u, at(n), "x") for k, u in enumerate(URLS) for n in (-1, 0, 5, 10, 15, 16, 19, 20, 29, 30, 40, 41)]
    rows += [(99, URLS[0], None, "x"), (0, URLS[0], at(15), "x")]
    captures = spark.createDataFrame(rows, "id long, url string, fetched_at timestamp_ntz, category string")
    changes = spark.createDataFrame(CHANGES, "kind string, pattern string, category string, at timestamp_ntz, action string")
    got = urlfilter.judge(captures, changes).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_verdict(r.url, r.fetched_at)
        assert ((r.n_active, r.entry, r.category), r.blocked) == (want, want[0] > 0), r
    assert not any(r.blocked for r in urlfilter.judge(captures, changes.limit(0)).collect())
    assert urlfilter.judge(captures.limit(0), changes).count() == 0


def test_intervals(spark):
    changes = spark.createDataFrame(CHANGES, "kind string, pattern string, category string, at timestamp_ntz, action string")
    got = {(r.kind, r.pattern, r.category, r.since, r.until) for r in urlfilter.intervals(changes).collect()}
    assert got == {
        ("host", "a.b.example", "spam", at(10), at(20)), ("host", "a.b.example", "spam", at(30), None), ("domain", "example", "all", at(15), at(16)),
        ("domain", "b.example", "some", at(40), None), ("prefix", "a.b.example/x/", "part", at(0), None), ("prefix", "a.b.example/x/", "other", at(0), None),
    }
