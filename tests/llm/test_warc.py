from pyspark.sql import functions as F

from tapeline.llm import warc

SCHEMA = "record_id long, url string, captured_at long, kind string, headers map<string,string>, digest string, payload string, span string"


def test_canonical_urls(spark):
    same = ["http://www.A.example.net:80/x?b=2&a=1", "https://a.example.net/x?a=1&utm_source=feed&b=2#top", " a.example.net/x?a=1&b=2 "]
    rows = [(u,) for u in [*same, "http://h", "http://h/?gclid=3", None, "", "#x"]]
    got = [r[0] for r in spark.createDataFrame(rows, "url string").select(warc.canonical(F.col("url"))).collect()]
    assert got == ["a.example.net/x?a=1&b=2"] * 3 + ["h/"] * 2 + [None] * 3


def test_statuses_headers_and_ties(spark):
    rows = [
        (1, "http://h/a", 10, "response", {"ETag": "t1", "Content-Type": "x", "Expires": "old"}, "d1", "body1", ""), (2, "https://h/a#f", 20, "revisit", {"etag": "W/t1", "expires": "new", "Set-Cookie": "no"}, None, None, ""),
        (3, "http://h/a", 20, "response", {"ETag": "t2"}, "d2", "body2", ""), (4, "http://h/a", 20, "response", {"ETag": "t3"}, "d3", "body3", ""), (5, "http://h/a", 21, "revisit", {"ETag": "t3"}, None, None, ""),
        (6, "http://h/a", 22, "revisit", {"ETag": "other"}, None, None, ""), (7, "http://h/a", 5, "revisit", None, None, None, ""), (8, None, 30, "revisit", None, "d", None, ""), (9, "http://h/a", None, "revisit", {}, "d3", None, ""),
        (10, "http://h/a", 40, "revisit", None, "d3", None, ""), (11, "http://h/a", 41, "revisit", None, None, None, ""), (10, "http://h/a", 40, "revisit", None, "d3", None, ""), (12, "http://h/a", 50, "request", None, None, None, ""),
    ]
    got = sorted(((r.record_id, r.status, r.source_id, r.payload, r.headers) for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()), key=lambda r: r[:2])
    assert [r[:4] for r in got] == [
        (2, "resolved", 1, "body1"), (5, "resolved", 4, "body3"), (6, "mismatch", 4, None), (7, "orphan", None, None), (8, "orphan", None, None), (9, "orphan", None, None),
        (10, "resolved", 4, "body3"), (10, "resolved", 4, "body3"), (11, "unchecked", 4, None)]
    assert got[0][4] == {"Content-Type": "x", "etag": "W/t1", "expires": "new"}
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equals_scan_of_all_captures(spark):
    import random
    r = random.Random(2)
    rows = [(i, f"http://h/{r.choice([0] * 5 + list(range(9)))}", r.randrange(300), r.choice(["response", "revisit"]), {"ETag": r.choice("ab")}, None, f"p{i}", "") for i in range(900)]
    want = {}
    for i, u, t, k, h, *_ in rows:
        if k == "revisit":
            last = max(((x[2], x[0], x[4]) for x in rows if x[3] == "response" and x[1] == u and x[2] < t), default=None, key=lambda x: x[:2])
            want[i] = (last and last[1], "orphan" if not last else "resolved" if last[2] == h else "mismatch")
    got = {x.record_id: (x.source_id, x.status) for x in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
