"""WARC captures, and not-modified revisits resolved to the response they stand for.

A server-not-modified revisit has no body. It is joined as-of, by canonical URL, to the latest earlier full response; if its validators
agree with that response it takes its body and its headers, updated by those headers that a 304 response may change.

The as-of join deals captures out by range of (URL, time), so one URL with a third of all captures spans as many partitions as its size
asks for. Within a partition a window finds the latest response; what a URL needs from earlier partitions is the last response of the
nearest one that has any, one row for each partition.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidestream.llm.common import BYTES_PER_BATCH, arrow_map
from slidestream.shared import cut

#: Headers of a 304 response that replace stored ones. Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't change what a URL names, as a pattern.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Statuses of a full response: a body that stands for the URL. Partial, not-modified, redirect and error responses don't.
FULL = (200,)
CAPTURE = "capture_id long, kind string, url string, at long, status int, headers map<string,string>, payload_bytes long, payload_sha256 string"


# ---------------------------------------------------------------- files

_CHUNK = 1 << 20
#: Bytes of a record's header, and of its block, beyond which it is rejected; a block is a cell of a row.
MAX_HEADER = 1 << 20
MAX_BLOCK = 1 << 30
_GZIP = b"\x1f\x8b\x08"
Chunk = tuple[bytes, str | None]  # bytes, or why there are no more


def _plain_chunks(f: BinaryIO, first: bytes) -> Iterator[Chunk]:
    while first:
        yield first, None
        first = f.read(_CHUNK)


def _members(f: BinaryIO) -> Iterator[tuple[int, Iterator[Chunk]]]:
    """(offset in the file, chunks) of each gzip member, or of the whole file if it isn't compressed. A member is unpacked chunk by chunk;
    behind a damaged one the next that starts with gzip's mark is taken up."""
    rest, at = f.read(_CHUNK), 0
    if not rest.startswith(_GZIP[:2]):
        yield 0, _plain_chunks(f, rest)
        return

    def unpacked() -> Iterator[Chunk]:
        nonlocal rest, at
        z = zlib.decompressobj(31)
        while not z.eof:
            data = rest or f.read(_CHUNK)
            if not data:
                yield b"", "member cut short"
                return
            try:
                out = z.decompress(data, _CHUNK)
            except zlib.error:
                rest, at = data[1:], at + 1
                while rest and (k := rest.find(_GZIP)) < 0:
                    at += max(0, len(rest) - 2)
                    rest = rest[-2:] + more if (more := f.read(_CHUNK)) else b""
                if rest:
                    rest, at = rest[k:], at + k
                yield b"", "damaged member"
                return
            left = z.unused_data if z.eof else z.unconsumed_tail
            at, rest = at + len(data) - len(left), left
            if out:
                yield out, None

    while rest or (rest := f.read(_CHUNK)):
        chunks = unpacked()
        yield at, chunks
        for _ in chunks:  # what the reader left
            pass


def parse_records(f: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """(offset, lower-cased WARC headers, block, reject) of each record, read as a stream: one block is in memory at a time.

    A stretch that is no record comes with why, and reading goes on at the next line that starts a record: a header without end or over
    ``MAX_HEADER``, a block over ``MAX_BLOCK``, a Content-Length that is no number, bytes that start no record, a record cut short, a
    damaged gzip member. The offset is that of the gzip member, or of the record in a file that isn't compressed.
    """
    for offset, chunks in _members(f):
        compressed = chunks.__name__ == "unpacked"
        buffer, base, why = bytearray(), 0, None

        def fill(n: int) -> bool:
            """At least ``n`` bytes in the buffer."""
            nonlocal why
            while len(buffer) < n:
                got, error = next(chunks, (b"", None))
                why = why or error
                if not got:
                    return False
                buffer.extend(got)
            return True

        def skip(n: int) -> None:
            nonlocal base
            del buffer[:n]
            base += n

        def to_next(start: int) -> None:
            """Drops bytes up to the next line that starts a record."""
            while True:
                k = buffer.find(b"\nWARC/", start)
                if k >= 0:
                    return skip(k + 1)
                skip(max(0, len(buffer) - 5))
                start = 0
                if not fill(len(buffer) + 1):
                    return skip(len(buffer))

        while True:
            while fill(1) and buffer[:1] in (b"\r", b"\n"):
                skip(1)
            place = offset if compressed else base
            if not buffer:
                break
            if not (fill(5) and buffer.startswith(b"WARC/")):
                yield place, {}, b"", "no record"
                to_next(0)
                continue
            scanned = 0
            while (end := buffer.find(b"\r\n\r\n", scanned)) < 0 and len(buffer) <= MAX_HEADER:
                scanned = max(0, len(buffer) - 3)
                if not fill(len(buffer) + 1):
                    break
            if end < 0 or end > MAX_HEADER:
                yield place, {}, b"", "header without end"
                to_next(1)
                continue
            head = _headers(bytes(buffer[:end]))
            length = head.get("content-length", "")
            if not (length.isascii() and length.isdigit()):
                yield place, head, b"", "no Content-Length"
                to_next(1)
                continue
            size = int(length[-19:]) if len(length.lstrip("0")) <= 18 else 1 << 62
            if size > MAX_BLOCK:
                yield place, head, b"", "block too large"
                to_next(1)
                continue
            if not fill(end + 4 + size):
                yield place, head, b"", why or "record cut short"
                to_next(1)
                continue
            block = bytes(buffer[end + 4 : end + 4 + size])
            skip(end + 4 + size)
            yield place, head, block, None
        if why:
            yield offset, {}, b"", why


def _headers(block: bytes) -> dict[str, str]:
    """Lines after the first; repeated names are joined by a comma."""
    out: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def write_record(kind: str, url: str, at: datetime, http: bytes, record_id: str, **more: str) -> bytes:
    """One uncompressed record; ``more`` are further WARC headers, underscores for hyphens."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {url}", f"WARC-Date: {at:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Record-ID: <urn:uuid:{record_id}>", *[f"{k.replace('_', '-')}: {v}" for k, v in more.items()], "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


REJECT = "reject"
RECORD = "file string, offset long, capture_id string, kind string, url string, at long, status int, headers map<string,string>, payload_bytes long, payload_sha256 string, payload binary, reject string"
_ARROW = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary(), pa.string())


def _seconds(date: str | None) -> int | None:
    try:
        at = datetime.fromisoformat(date or "")
    except ValueError:
        return None
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp())


def _capture(file: str, place: int, head: dict[str, str], block: bytes, why: str | None) -> tuple | None:
    """A row of ``RECORD``; none for records that are neither responses nor not-modified revisits."""
    kind = head.get("warc-type")
    if why is None and (kind not in ("response", "revisit") or (kind == "revisit" and not head.get("warc-profile", "").endswith("server-not-modified"))):
        return None
    at, name = _seconds(head.get("warc-date")), head.get("warc-record-id")
    why = why or ("no WARC-Record-ID" if not name else "no WARC-Date" if at is None else None)
    if why:
        return file, place, name, kind, head.get("warc-target-uri"), at, None, None, None, None, None, why
    http, _, body = block.partition(b"\r\n\r\n")
    first = http.split(b"\r\n", 1)[0].split()
    status = int(first[1]) if len(first) > 1 and re.fullmatch(rb"[0-9]{3}", first[1]) else None
    full = kind == "response"
    return file, place, name, kind, head.get("warc-target-uri"), at, status, list(_headers(http).items()), len(body) if full else None, hashlib.sha256(body).hexdigest() if full else None, body if full else None, None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``RECORD``: the response and not-modified revisit records of the files below ``path``, and what was rejected, see ``accepted`` and
    ``rejected``. Accepted rows have the columns of ``CAPTURE``, their id being the record's.

    ``at`` is seconds since 1970 (a date without zone is UTC). ``reject`` says why a stretch of a file at ``offset`` is no capture: what
    ``parse_records`` gives, or a record without WARC-Record-ID or WARC-Date; the rest of the file is read. A URL or HTTP status that is
    missing is null. Files are listed by Spark and opened through ``pyarrow.fs``, each read as a stream by one task, so memory holds one
    block and a batch. An empty file or folder gives no rows; repeated records give repeated rows.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]

    def rows_of(file: str) -> Iterator[tuple]:
        fs, name = pa.fs.FileSystem.from_uri(file)
        with fs.open_input_stream(name, compression=None) as f:
            for record in parse_records(f):
                if (row := _capture(file, *record)) is not None:
                    yield row

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _ARROW)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                held, size = [], 0
                for row in rows_of(file):
                    held.append(row)
                    size += 500 + (row[8] or 0)
                    if size >= BYTES_PER_BATCH:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"))
    return arrow_map(files.repartition("path"), run, RECORD)


def accepted(records: DataFrame) -> DataFrame:
    return records.where(F.col(REJECT).isNull()).drop(REJECT)


def rejected(records: DataFrame) -> DataFrame:
    return records.where(F.col(REJECT).isNotNull()).select("file", "offset", REJECT)


# ---------------------------------------------------------------- resolution


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, ``www.``, default port, tracking parameters and closing slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(place, "^([^/]*)", 1)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, "^[^/]*(.*)$", 1), "/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _plain(etag: Column) -> Column:
    """Weak comparison: without the W/ mark."""
    return F.regexp_replace(etag, "^W/", "")


def latest_response(captures: DataFrame) -> DataFrame:
    """Adds ``found`` to each row of ``captures(key, at, id, full, ...)``: the struct ``full`` of the row's own or the latest earlier
    row, by (at, id), of the same key that has one."""
    order = ["key", "at", "id"]
    dealt = cut(captures.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    last = dealt.where("full is not null").groupBy("part").agg(F.max_by(F.struct("key", "full"), F.struct(*order)).alias("tail"))
    parts = dealt.select("part").distinct().join(last, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carry = parts.select("part", F.last("tail", ignorenulls=True).over(before).alias("carry"))
    inside = Window.partitionBy("part", "key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("own", F.last("full", ignorenulls=True).over(inside))
    from_before = F.when(F.col("carry.key") == F.col("key"), F.col("carry.full"))
    return own.join(carry, "part", "left").withColumn("found", F.coalesce("own", from_before)).drop("own", "carry", "part")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """``(capture_id, canonical_url, at, status, response_id, payload_bytes, payload_sha256, headers)`` of each revisit.

    ``captures`` has the columns of ``CAPTURE``, or a string for an id; kind is ``response`` or ``revisit``, header names are lower-cased.
    Earlier means a smaller (at, capture_id). A response is full if its status is one of ``FULL``; others are passed over. ``status`` is ``resolved``; or ``no_response`` where no earlier full response of the URL exists (or the
    URL or time is null), ``no_validator`` where the revisit names neither ETag nor Last-Modified, ``mismatch`` where they disagree with
    the latest earlier response: an ETag decides alone, by weak comparison, and Last-Modified only without one. Only resolved rows have
    a response, a payload and headers. Rows of other kinds are passed over; null headers count as none; repeated revisits give repeated
    results; repeated responses are one; other columns are ignored; an empty table gives no rows. One URL may hold any share of the rows.
    """
    none = F.create_map().cast("map<string,string>")
    rows = captures.where("kind in ('response', 'revisit')").select("capture_id", "kind", canonical_url(F.col("url")).alias("key"), "at", F.col("status").alias("http"), F.coalesce("headers", none).alias("headers"), "payload_bytes", "payload_sha256")
    full = F.when((F.col("kind") == "response") & F.col("http").isin(*FULL), F.struct("capture_id", "headers", "payload_bytes", "payload_sha256"))
    asked = rows.where("key is not null and at is not null").select("key", "at", F.col("capture_id").alias("id"), "kind", full.alias("full"), F.when(F.col("kind") == "revisit", F.col("headers")).alias("headers"))
    found = latest_response(asked).where("kind = 'revisit'").select("id", "key", "at", "headers", "found")
    lost = rows.where("kind = 'revisit' and (key is null or at is null)").select(F.col("capture_id").alias("id"), "key", "at", "headers", F.lit(None).cast(found.schema["found"].dataType).alias("found"))
    etag, changed = F.col("headers")["etag"], F.col("headers")["last-modified"]
    stored = F.col("found.headers")
    agrees = F.when(etag.isNotNull(), F.coalesce(_plain(etag) == _plain(stored["etag"]), F.lit(False))).otherwise(F.coalesce(changed == stored["last-modified"], F.lit(False)))
    status = F.when(F.col("found").isNull(), "no_response").when(etag.isNull() & changed.isNull(), "no_validator").when(agrees, "resolved").otherwise("mismatch")
    new = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(new, k)), new)
    ok = F.col("status") == "resolved"
    return found.union(lost).withColumn("status", status).select(
        F.col("id").alias("capture_id"), F.col("key").alias("canonical_url"), "at", "status", *[F.when(ok, F.col(f"found.{c}")).alias(n) for c, n in (("capture_id", "response_id"), ("payload_bytes", "payload_bytes"), ("payload_sha256", "payload_sha256"))], F.when(ok, merged).alias("headers"))


def with_payload(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """Adds ``payload`` from ``bodies(capture_id, payload)`` to the resolved rows; other rows, and those whose body isn't there, get null.

    Repeated bodies of an id are one, the least of them if they differ, so rows keep their number; a null id matches nothing; other
    columns of ``bodies`` are ignored; either table may be empty. A response that many revisits stand for is a skewed key of the join, which adaptive execution splits.
    """
    one = bodies.where("capture_id is not null").groupBy(F.col("capture_id").alias("response_id")).agg(F.min("payload").alias("payload"))
    return resolved.join(one, "response_id", "left")


# ---------------------------------------------------------------- the pages table as captures

#: Pages between a page's response and its revisit, and pages that see one version of their host's front page.
REVISIT_AFTER = 40
VERSION_PAGES = 64


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Four captures of each page: ``page_id`` gives the minute, and ids are four times it and after.

    The page itself as a response, and as a revisit ``REVISIT_AFTER`` minutes later by a URL with a tracking parameter. And the front page
    of its host, as a revisit and five seconds later as a response, so a host's first revisit comes before any response, and a host with
    many pages is one URL with many captures. Front pages change every ``VERSION_PAGES`` minutes; of ten, one is partial, one not modified
    and one an error. Some revisits have a weak ETag, only Last-Modified, or no validator. A page with a null id has null ids and times; a
    null URL gives captures without URL, a null html an empty body; repeated pages give repeated captures; an empty table gives none.
    """
    i = F.col("page_id")
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    version = F.floor(i / VERSION_PAGES)
    p = p.select("page_id", "url", F.concat(F.regexp_extract("url", "^([A-Za-z]+://[^/?#]+)", 1), F.lit("/")).alias("front"), F.md5("html").alias("tag"), F.md5(F.concat(F.lit("v"), version.cast("string"))).alias("front_tag"), (version * 60 * VERSION_PAGES).cast("string").alias("front_changed"), F.octet_length("html").cast("long").alias("n"), F.sha2(F.col("html").cast("binary"), 256).alias("sha"))
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    headers = lambda **kv: F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("_", "-")), v)]), lambda k, v: v.isNotNull())
    none_s, none_n = F.lit(None).cast("string"), F.lit(None).cast("long")

    def response(id_: Column, url: Column, at: Column, status: Column, etag: Column, changed: Column) -> Column:
        h = headers(cache_control=F.lit("max-age=3600"), content_length=F.col("n").cast("string"), content_type=F.lit("text/html"), etag=etag, last_modified=changed)
        return F.struct(id_.alias("capture_id"), F.lit("response").alias("kind"), url.alias("url"), at.alias("at"), status.cast("int").alias("status"), h.alias("headers"), F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_sha256"))

    def revisit(id_: Column, url: Column, at: Column, etag: Column, changed: Column) -> Column:
        h = headers(cache_control=F.lit("max-age=7200"), content_length=F.lit("0"), content_type=F.lit("message/http"), date=at.cast("string"), etag=etag, last_modified=changed)
        return F.struct(id_.alias("capture_id"), F.lit("revisit").alias("kind"), url.alias("url"), at.alias("at"), F.lit(304).alias("status"), h.alias("headers"), none_n.alias("payload_bytes"), none_s.alias("payload_sha256"))

    tracked = F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=revisit"))
    etag = F.when(i % 11 == 5, none_s).when(i % 7 == 3, F.concat(F.lit("W/"), quoted("tag"))).otherwise(quoted("tag"))
    changed = F.when(i % 22 == 5, none_s).otherwise((60 * i).cast("string"))
    status = F.when(i % 10 == 3, 304).when(i % 10 == 6, 206).when(i % 10 == 9, 500).otherwise(200)
    rows = F.array(
        response(4 * i, F.col("url"), 60 * i, F.lit(200), quoted("tag"), (60 * i).cast("string")),
        revisit(4 * i + 1, tracked, 60 * (i + REVISIT_AFTER) + 30, etag, changed),
        revisit(4 * i + 2, F.col("front"), 60 * i + 5, F.when(i % 8 == 1, none_s).otherwise(quoted("front_tag")), F.when(i % 16 == 1, none_s).otherwise(F.col("front_changed"))),
        response(4 * i + 3, F.col("front"), 60 * i + 10, status, quoted("front_tag"), F.col("front_changed")),
    )
    return p.select(F.inline(rows))


def header_text(headers: Column) -> Column:
    """``name: value`` lines sorted by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


SQL = """
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS tag, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS sha FROM pages),
v AS (
  SELECT *, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/' AS front, md5('v' || (page_id // 64)) AS front_tag, CAST(3840 * (page_id // 64) AS VARCHAR) AS front_changed FROM p),
c AS (
  SELECT 4 * page_id AS id, 'response' AS kind, url, 60 * page_id AS ts, '"' || tag || '"' AS etag, CAST(60 * page_id AS VARCHAR) AS changed, 200 AS http, n, sha FROM v
  UNION ALL
  SELECT 4 * page_id + 1, 'revisit', url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=revisit', 60 * (page_id + 40) + 30,
         CASE WHEN page_id % 11 = 5 THEN NULL WHEN page_id % 7 = 3 THEN 'W/"' || tag || '"' ELSE '"' || tag || '"' END,
         CASE WHEN page_id % 22 = 5 THEN NULL ELSE CAST(60 * page_id AS VARCHAR) END, 304, NULL, NULL FROM v
  UNION ALL
  SELECT 4 * page_id + 2, 'revisit', front, 60 * page_id + 5, CASE WHEN page_id % 8 = 1 THEN NULL ELSE '"' || front_tag || '"' END,
         CASE WHEN page_id % 16 = 1 THEN NULL ELSE front_changed END, 304, NULL, NULL FROM v
  UNION ALL
  SELECT 4 * page_id + 3, 'response', front, 60 * page_id + 10, '"' || front_tag || '"', front_changed,
         CASE page_id % 10 WHEN 3 THEN 304 WHEN 6 THEN 206 WHEN 9 THEN 500 ELSE 200 END, n, sha FROM v),
b AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM c),
k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
         list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\\?(.*)$', 1), '&'),
                   lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS params
  FROM b),
u AS (SELECT *, place || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM k),
f AS (
  SELECT *, last_value(CASE WHEN kind = 'response' AND http = 200 THEN {'id': id, 'etag': etag, 'changed': changed, 'n': n, 'sha': sha} END IGNORE NULLS)
            OVER (PARTITION BY canonical ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
  FROM u),
s AS (
  SELECT *, CASE WHEN r IS NULL THEN 'no_response' WHEN etag IS NULL AND changed IS NULL THEN 'no_validator'
                 WHEN etag IS NOT NULL AND replace(etag, 'W/', '') = r.etag THEN 'resolved'
                 WHEN etag IS NULL AND changed = r.changed THEN 'resolved' ELSE 'mismatch' END AS status
  FROM f WHERE kind = 'revisit')
SELECT id AS capture_id, canonical AS canonical_url, ts AS "at", status,
       CASE WHEN status = 'resolved' THEN r.id END AS response_id,
       CASE WHEN status = 'resolved' THEN r.n END AS payload_bytes,
       CASE WHEN status = 'resolved' THEN r.sha END AS payload_sha256,
       CASE WHEN status = 'resolved' THEN 'cache-control: max-age=7200' || chr(10) || 'content-length: ' || r.n || chr(10) || 'content-type: text/html' || chr(10)
            || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(etag, r.etag) || chr(10) || 'last-modified: ' || coalesce(changed, r.changed) END AS headers
FROM s
"""
