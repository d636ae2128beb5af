import gzip
import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from slidestream.llm import warc


def rows(spark, captures):
    return spark.createDataFrame(captures, warc.CAPTURE)


def test_canonical_urls(spark):
    cases = {
        "http://www.Example.com:80/a/?b=2&a=1#x": "example.com/a?a=1&b=2", "https://example.com/a?utm_source=q&ref=1": "example.com/a", "example.com": "example.com", "http://e.com/?": "e.com",
        "http://e.com/a//": "e.com/a", "http://e.com/A?referrer=1": "e.com/A?referrer=1", "https://m.e.com/x?&&": "m.e.com/x", "": "", None: None, "http://e.com/p?u=http://z.com/": "e.com/p?u=http://z.com/",
    }
    df = spark.createDataFrame(list(cases.items()), "u string, want string")
    for r in df.select("u", "want", warc.canonical_url(F.col("u")).alias("got")).collect():
        assert r.got == r.want, r


def plain(captures):
    out = {}
    for c in captures:
        i, kind, url, at, _, headers, _, _ = c
        if kind != "revisit":
            continue
        headers = headers or {}
        best = None
        for r in captures:
            if url is not None and at is not None and r[1] == "response" and r[4] == 200 and r[2] == url and r[3] is not None and (r[3], r[0]) <= (at, i) and (best is None or (r[3], r[0]) > (best[3], best[0])):
                best = r
        if not best:
            out[i] = ("no_response", None, None)
            continue
        stored, tag, changed = best[5] or {}, headers.get("etag"), headers.get("last-modified")
        if tag is None and changed is None:
            out[i] = ("no_validator", None, None)
        elif (stored.get("etag", "").removeprefix("W/") == tag.removeprefix("W/")) if tag is not None else stored.get("last-modified") == changed:
            out[i] = ("resolved", best[0], {**stored, **{k: v for k, v in headers.items() if k in warc.PERMITTED}})
        else:
            out[i] = ("mismatch", None, None)
    return out


def captures(n=400, urls=12, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        url = rng.choice(["hot"] * 6 + [f"u{k}" for k in range(urls)] + [None])
        at = rng.choice([None] + [rng.randrange(200)] * 20)
        tag = rng.choice([None, '"a"', 'W/"a"', '"b"'])
        headers = {k: v for k, v in {"etag": tag, "last-modified": rng.choice([None, "1", "2"]), "content-length": str(i), "date": str(at), "x": rng.choice([None, "y"])}.items() if v is not None}
        out.append((i, rng.choice(["response", "revisit", "revisit", "request"]), url, at, rng.choice([200] * 4 + [304, 206, 500, None]), rng.choice([headers] * 9 + [None]), i * 10, f"sha{i}"))
    return out


def test_resolution(spark):
    c = captures()
    got = {r.capture_id: (r.status, r.response_id, r.headers) for r in warc.resolve_revisits(rows(spark, c).repartition(5)).collect()}
    assert got == plain(c)
    assert {s for s, *_ in got.values()} == {"resolved", "mismatch", "no_validator", "no_response"}


def test_one_url_spans_partitions(spark):
    """Its revisits find responses in earlier partitions."""
    c = [(0, "response", "hot", 0, 200, {"etag": "x"}, 1, "s")] + [(i, "revisit", "hot", i, 304, {"etag": "x"}, None, None) for i in range(1, 500)] + [(1000 + i, "revisit", "zzz", i, None, {"etag": "x"}, None, None) for i in range(20)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = warc.resolve_revisits(rows(spark, c)).groupBy("status").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.status: r["count"] for r in got} == {"resolved": 499, "no_response": 20}


def test_repeats_extra_columns_and_empty(spark):
    c = [(1, "response", "u", 1, 200, {"etag": "x"}, 3, "s"), (1, "response", "u", 1, 200, {"etag": "x"}, 3, "s"), (2, "revisit", "u", 2, 304, {"etag": "x"}, None, None), (2, "revisit", "u", 2, 304, {"etag": "x"}, None, None)]
    df = rows(spark, c).withColumn("part", F.lit(1)).withColumn("key", F.lit("k")).withColumn("found", F.lit(0))
    assert [r.response_id for r in warc.resolve_revisits(df).collect()] == [1, 1]
    assert warc.resolve_revisits(rows(spark, [])).count() == 0


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, None, "y"), (3, "http://b/", None), (4, "http://a", "x")], "page_id long, url string, html string")
    c = warc.captures_of_pages(pages.union(pages.where("page_id = 4")))
    got = [(r.capture_id, r.status) for r in warc.resolve_revisits(c).collect()]
    keyed = [tuple(r) for r in c.withColumn("url", warc.canonical_url(F.col("url"))).collect()]
    want = plain(keyed)
    assert len(got) == 10 and dict(got) == {i: s for i, (s, *_) in want.items()}
    assert dict(got)[9] == "no_response" and dict(got)[13] == "resolved"
    assert warc.captures_of_pages(pages.limit(0)).count() == 0


def test_all_statuses_of_pages(spark, small):
    pages = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/pages.parquet")
    got = {r.status: r["count"] for r in warc.resolve_revisits(warc.captures_of_pages(pages)).groupBy("status").count().collect()}
    assert sum(got.values()) == 500 and min(got.values()) >= 15 and len(got) == 4


AT = datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC)
FULL = b'HTTP/1.1 200 OK\r\nETag: "t"\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\nbody\r\n\r\nmore'
SMALL = b'HTTP/1.1 304 Not Modified\r\nETag: "t"\r\nExpires: never\r\nContent-Length: 0\r\n\r\n'
ONE = warc.write_record("response", "http://e.com/", AT, FULL, "1")
TWO = warc.write_record("revisit", "http://www.e.com", AT.replace(hour=4), SMALL, "2", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/server-not-modified")
THREE = warc.write_record("revisit", "http://e.com/", AT, SMALL, "3", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")


def test_files_feed_the_resolution(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(ONE + TWO + THREE + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999\r\n\r\ncut")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(ONE) + gzip.compress(TWO))
    (tmp_path / "c.warc").write_bytes(b"")
    records = warc.read_warc(spark, str(tmp_path / "*"))
    got = warc.accepted(records).collect()
    assert len(got) == 4
    r = next(x for x in got if x.kind == "response")
    assert (r.status, bytes(r.payload), r.headers["set-cookie"], r.at, r.payload_bytes) == (200, b"body\r\n\r\nmore", "a, b", int(AT.timestamp()), 12)
    c = warc.accepted(warc.read_warc(spark, str(tmp_path / "a.warc")))
    for bodies in (c, c.union(c)):  # repeated bodies don't multiply rows
        (out,) = warc.with_payload(warc.resolve_revisits(c), bodies).collect()
        assert bytes(out.payload) == b"body\r\n\r\nmore" and out.headers["expires"] == "never" and "content-length" not in out.headers and out.response_id == "<urn:uuid:1>"
    assert [(r.file.rsplit("/", 1)[1], r.reject) for r in warc.rejected(records).collect()] == [("a.warc", "record cut short")]


def test_damaged_files_keep_their_other_records(spark, tmp_path):
    bad = {
        "length": ONE.replace(b"Content-Length: ", b"Content-Length: x") + TWO, "huge": ONE.replace(b"Content-Length: ", b"Content-Length: 9" + b"9" * 5000) + TWO, "no_date": ONE.replace(b"WARC-Date", b"X-Date") + TWO,
        "bad_date": ONE.replace(b"2024-01", b"2024-99") + TWO, "no_id": ONE.replace(b"WARC-Record-ID", b"X-ID") + TWO, "junk": b"some junk\r\n" + ONE + b"more junk\n" + TWO, "no_end": b"WARC/1.0\r\nWARC-Type: response\r\n" + ONE[:40],
        "short.gz": gzip.compress(ONE) + gzip.compress(TWO)[:-30], "flip.gz": gzip.compress(ONE)[:60] + b"\xff" * 30 + gzip.compress(ONE)[90:] + gzip.compress(TWO), "one.gz": gzip.compress(ONE + TWO), "no_status": ONE.replace(b"200 OK", b"abc").replace(b"Content-Length: 7", b"Content-Length: 7"),
    }
    for name, raw in bad.items():
        (tmp_path / name).write_bytes(raw)
    got, why = {}, {}
    records = warc.read_warc(spark, str(tmp_path / "*"))
    for r in warc.accepted(records).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(r.kind)
    for r in warc.rejected(records).collect():
        why.setdefault(r.file.rsplit("/", 1)[1], []).append(r.reject)
    both, two = ["response", "revisit"], ["revisit"]
    assert got.pop("no_status", None) in (None, ["response"])  # its block is three bytes longer than said or not
    why.pop("no_status", None)
    assert got == {"length": two, "huge": two, "no_date": two, "bad_date": two, "no_id": two, "junk": both, "short.gz": ["response"], "flip.gz": two, "one.gz": both}
    assert {k: set(v) for k, v in why.items()} == {"length": {"no Content-Length"}, "huge": {"block too large"}, "no_date": {"no WARC-Date"}, "bad_date": {"no WARC-Date"}, "no_id": {"no WARC-Record-ID"}, "junk": {"no record"}, "no_end": {"header without end"}, "short.gz": {"member cut short"}, "flip.gz": {"damaged member"}}


def test_members_are_streamed():
    """A gzip file of 64 MB unpacked is parsed with little in memory."""
    import io
    import tracemalloc

    raw = gzip.compress(warc.write_record("response", "http://e.com/", AT, b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 1_000_000, "1") * 64)
    tracemalloc.start()
    n = sum(why is None for *_, why in warc.parse_records(io.BytesIO(raw)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 64 and peak < 16_000_000
