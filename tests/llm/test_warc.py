import random

import pytest
from pyspark.sql import functions as F

from parley.llm import warc

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, extra int"


def test_canonical_url(spark):
    urls = ["HTTPS://WWW.Example.com:443/A/?#x", "http://example.com/A", " http://example.com/A/ ", None, "no url"]
    got = [r.c for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u")).alias("c")).collect()]
    assert got == ["http://example.com/A"] * 3 + [None, "no url"]
    urls = ["http://a.com:443/x", "https://a.com:80/x", "https://a.com:443/x", "http://A.com:80/x", "http://Me:Pass@WWW.a.com/", "ftp://www.a.com:80/B/", "https://a.com:8443/?q=A%2f", "http://www.com/"]
    got = [r.c for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u")).alias("c")).collect()]
    assert got == ["http://a.com:443/x", "http://a.com:80/x", "http://a.com/x", "http://a.com/x", "http://Me:Pass@www.a.com", "ftp://www.a.com:80/B", "http://a.com:8443/?q=A%2f", "http://www.com"]


def test_cases(spark):
    rows = [
        (1, "http://a.com/", 10, "response", '"x"', "d1", {"Server": "s", "Content-Length": "9"}, 0),
        (2, "https://www.a.com", 20, "revisit", 'W/"x"', None, {"DATE": "20", "content-length": "0"}, 0),
        (3, "http://a.com/", 30, "response", '"y"', "d2", None, 0),
        (4, "http://a.com/", 40, "revisit", '"x"', "d2", {}, 0),
        (5, "http://a.com/", 41, "revisit", None, "d2", None, 0),
        (6, "http://a.com/", 42, "revisit", None, None, None, 0),
        (7, "http://a.com/", 5, "revisit", '"x"', None, None, 0),
        (8, None, 50, "revisit", '"x"', None, None, 0),
        (9, "http://a.com/", None, "revisit", '"x"', None, None, 0),
        (10, "http://a.com/", 30, "revisit", '"y"', None, None, 0),
    ]
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(got[k].refers_to, got[k].verdict) for k in (2, 4, 5, 6, 7, 8, 9, 10)] == [
        (1, "resolved"), (3, "mismatch"), (3, "resolved"), (3, "unverified"), (None, "orphan"), (None, "orphan"), (None, "orphan"), (3, "resolved"),
    ]
    assert got[2].headers == {"server": "s", "content-length": "9", "date": "20"}
    assert got[5].headers == {} and got[4].headers is None


def test_header_names_that_differ_by_case(spark):
    rows = [
        (1, "http://a/", 1, "response", "x", None, {"Server": "s", "SERVER": "t", "Age": None}, 0),
        (2, "http://a/", 2, "revisit", "x", None, {"Date": "1", "date": "2"}, 0),
        (2, "http://a/", 2, "revisit", "x", None, {"Date": "1", "date": "2"}, 0),
    ]
    got = warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.verdict, r.headers) for r in got] == [("resolved", {"server": "t", "age": None, "date": "1"})] * 2


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("urls", [1, 7])
def test_against_brute_force(spark, urls, many_ranges):
    rng = random.Random(urls)
    rows = [(k, f"http://h/{rng.randrange(urls)}", rng.randrange(200), rng.choice(["response", "revisit"]), None, None, None, 1) for k in range(400)]
    got = {r.record_id: r.refers_to for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, url, ts, kind, *_ in rows:
        if kind == "revisit":
            before = [(t, i) for i, u, t, what, *_ in rows if what == "response" and u == url and (t, i) < (ts, k)]
            assert got[k] == (max(before)[1] if before else None)


def record(kind, number, url, date, http, body="text\r\n\r\nmore"):
    block = f"HTTP/1.1 {'304 Not Modified' if kind == 'revisit' else '200 OK'}\r\n{http}\r\n\r\n{body}"
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{number}>", f"WARC-Target-URI: {url}", f"WARC-Date: {date}", f"Content-Length: {len(block)}"]
    return "WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n" + block + "\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_records_of_files(spark, tmp_path, packed):
    import gzip

    text = "WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    text += record("response", 1, "http://a.com/x", "2024-01-01T00:00:00Z", 'ETag: "v1"\r\nServer: s\r\nX: 1\r\nx: 2\r\nContent-Length: 9')
    text += record("request", 2, "http://a.com/x", "2024-01-01T00:00:00Z", "Host: a.com")
    text += record("revisit", 3, "<https://www.a.com:443/x/>", "2024-01-02T00:00:00Z", 'etag: W/"v1"\r\nDate: now', "")
    text += record("revisit", 4, "http://a.com/x", "no date", 'etag: "v1"', "") + record("response", 5, "http://a.com/x", "2024-01-03T00:00:00Z", "Server: t", "é WARC/1.0")
    text += record("revisit", 6, "http://a.com/x", "2024-01-04T00:00:00.5Z", "Date: later", "")
    (tmp_path / ("a.warc.gz" if packed else "a.warc")).write_bytes(gzip.compress(text.encode()) if packed else text.encode())
    records = warc.read_records(spark, str(tmp_path))
    rows = sorted((r.asDict() for r in records.collect()), key=lambda r: (r["ts"] is None, r["ts"]))
    assert [r["kind"] for r in rows] == ["response", "revisit", "response", "revisit", "revisit"]
    assert rows[0]["etag"] == '"v1"' and rows[0]["headers"] == {"etag": '"v1"', "server": "s", "x": "1", "content-length": "9"} and rows[3]["ts"] == 1704326400500000
    got = {r.record_id: r for r in warc.resolve(records).collect()}
    assert [got[r["record_id"]].verdict for r in rows if r["kind"] == "revisit"] == ["resolved", "unverified", "orphan"]
    first = got[rows[1]["record_id"]]
    assert first.refers_to == rows[0]["record_id"] and first.headers == {"server": "s", "x": "1", "content-length": "9", "etag": 'W/"v1"', "date": "now"}


def test_empty(spark):
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).collect() == []
